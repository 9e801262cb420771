"""The registered queries against their SQL at the smallest scale, and the guard around the removable subpackage."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _rows(df):
    own = df[sorted(df.columns)]
    text = lambda x: str(x) if isinstance(x, (list, np.ndarray, dict)) else "-" if pd.isna(x) else repr(float(x) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in own.itertuples(index=False))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_missing_values_of_any_kind_compare(database):
    nullable = pd.DataFrame({"a": pd.array([1, None], dtype="Int64"), "b": [float("nan"), 1.0]})
    assert _rows(nullable) == [("-", "1.0"), ("1", "-")]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    a, b = _rows(entry.queries()[name](spark, DATA).toPandas()), _rows(database.execute(entry.oracle_sql()[name]).df())
    assert len(a) == len(b)
    assert a == b or all(_near(x, y) for x, y in zip(a, b, strict=True))


def _near(x, y):
    for p, q in zip(x, y, strict=True):
        try:
            if not math.isclose(float(p), float(q), rel_tol=1e-6, abs_tol=1e-6):
                return False
        except ValueError:
            if p != q:
                return False
    return True


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    _runs(tmp_path / "repo", "")


def test_the_rest_works_without_a_library_of_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    _runs(tmp_path / "repo", "import sys; sys.modules['pyarrow.parquet'] = None; sys.modules['ahocorasick'] = None; ")


def _runs(repo, before):
    script = before + (
        "import __spark_entry__ as e; q = e.queries(); assert 'anova' in q and 'pipeline' not in q; e.oracle_sql()['anova'];"
        "from statloom.session import local_session; s = local_session(2, 2, **{'spark.driver.memory': '1g'}); assert q['anova'](s, '" + DATA + "').count() > 0; e.entry(s).collect()"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=repo, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(repo)})
    assert done.returncode == 0, done.stderr
