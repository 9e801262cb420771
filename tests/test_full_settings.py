"""The registered tree queries run the operators' own rounds, folds and repeats."""

import inspect

from statloom.operators import predict
from statloom.plans import queries


def test_queries_keep_the_rounds_and_folds_of_the_operators(spark, monkeypatch):
    asked, signatures = {}, {x: inspect.signature(getattr(predict, x)) for x in ("risk", "predictability")}
    for name, own_name in (("risk_scores", "risk"), ("risk_models", "risk"), ("predictability", "predictability")):
        own = signatures[own_name]

        class Met(Exception):
            pass

        def record(*args, _name=name, _own=own, **more):
            bound = _own.bind(*args, **more)
            bound.apply_defaults()
            asked[_name] = (bound.arguments["rounds"], bound.arguments["folds"], bound.arguments["repeats"])
            raise Met

        monkeypatch.setattr(predict, own_name, record)
        try:
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        except Met:
            pass
    assert asked == {name: (80, 5, 3) for name in ("risk_scores", "risk_models", "predictability")}
