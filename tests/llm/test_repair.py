"""Repair of conversations against all sequences of edits of short ones, and against one pass over spilled blocks for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from statloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, gone string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")
FORM = re.compile(r"(s?(ua)+)?")


def broken(rows):
    """What the damage makes of (conv_id, turn, role, text) rows, by conversation and in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_edits(rows, kinds):
    """The least (cost, audit, repaired) over every way to edit."""
    gaps = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    own = []
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        more = 3 if kind == "truncated" else 0
        choices = [(4, "D", [])]
        if kind not in ("blank", "duplicate"):
            choices += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        own.append([(3 * len(g) + c, "I" * len(g) + a, [(x, "") for x in g] + o) for g in gaps for c, a, o in choices])
    own.append([(3 * len(g), "I" * len(g), [(x, "") for x in g]) for g in gaps])
    best = None
    for way in itertools.product(*own):
        turns = [t for _, _, o in way for t in o]
        if FORM.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
            mine = (sum(c for c, *_ in way), "".join(a for _, a, _ in way), "\n".join(f"{r}:{t}" for r, t in turns))
            best = mine if best is None or mine < best else best
    return best


def want(rows):
    out = {}
    for conv, own in broken(rows).items():
        kinds = faults(own)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, repaired = all_edits(own, kinds)
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def test_repairs_equal_all_ways_to_edit(spark):
    rng = random.Random(5)
    texts = ["Well.", "Well.", "no end", "", " \n", None, "Ä!", "Really?  ", "x" * 70_000 + "."]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "sage"]
    rows = []
    for conv in [None, *range(150)]:
        for place in range(3 if conv in (3, 50, 51, 90) else rng.choice((1, 2))):
            turn = rng.choice((place, place, 3 * place, None, 1))
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    rows += rows[:1]
    short = {c for c, own in broken(rows).items() if len(own) <= 2} | {c for c, own in broken(rows).items() if c in (3, 50, 51, 90) and len(own) == 3}
    expected = {c: v for c, v in want([r for r in rows if r[0] in short]).items() if c in short}
    assert len(expected) > 130 and len({v[6] for v in expected.values()}) > 15
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(repair.damaged(df)).collect()}
    assert set(got) == set(broken(rows))
    assert {c: got[c] for c in expected} == expected
    assert () == tuple(v for c, own in broken(rows).items() if not own for v in got[c][:6] if v)


def test_a_giant_conversation_is_spilled_and_read_back(spark):
    """Small and no limits of memory give the same, over many Arrow batches; the turns that come out are those of the report."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(conv, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"]) + (f" {i}." if i % 3 else "")) for conv, n in ((1, 9000), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    many = sorted(map(tuple, repair.repair_report(df).collect()))
    few = sorted(map(tuple, repair.repair_report(df, tape_bytes=1000).collect()))
    assert many == few and len(many) == 2 and many[0][0] == 1
    turns = repair.repair_turns(df, tape_bytes=1000)
    line = F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text"))
    again = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line"), "edit"))).alias("t"))
    again = again.select("conv_id", F.array_join("t.edit", "").alias("audit"), F.sha2(F.array_join(F.filter("t.line", lambda x: x.isNotNull()), "\n"), 256).alias("sha"))
    assert sorted(map(tuple, again.collect())) == [(r[0], r[7], r[8]) for r in many]


def test_blocks_come_back_last_to_first():
    tape = repair.Tape(limit=300)
    for block in range(5):
        tape.add([(block, "user", f"{block} {i}") for i in range(3)])
    assert [t for _, _, t in tape.reversed_rows()] == [f"{b} {i}" for b in reversed(range(5)) for i in reversed(range(3))]
    assert tape.places and tape.file
    tape.close()


@pytest.mark.parametrize("kind", [repair.FINE, repair.MUST_GO, repair.CUT_OFF])
def test_steps_are_few(kind):
    met, todo = set(), [repair.END]
    while todo:
        if (now := todo.pop()) not in met:
            met.add(now)
            todo += [repair.step(now, initial, k)[0] for initial in ("s", "u", "a", "") for k in range(3)]
    assert len(met) < 300


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(repair.damaged(empty)).count() == 0
