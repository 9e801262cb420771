"""The stages on rows that repeat, ids that come with several texts, and rows without an id, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from statloom.llm import decontamination, neardup, substrings

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    a, b, c, d, e, f, g, h = (text(120) for _ in range(8))
    near = lambda t: " ".join(["other", *t.split(" ")[1:]])
    return [
        (1, a, "en"), (1, a, "en"), (1, a, "de"), (2, near(a), "en"),  # a repeated row and its near copy
        (3, b, "en"), (3, c, "en"), (4, near(b), "en"), (5, near(c), "en"),  # one id with two texts
        (6, d, "en"), (6, near(d), "en"),  # near copies under one id
        (None, e, "en"), (None, e, "en"), (None, f, "en"), (7, near(f), "en"), (None, g, "en"), (None, near(g), "en"),
        (8, h, "en"), (9, "", "en"), (9, "", "en"), (10, "", "en"), (None, None, "en"), (None, None, "en"),
    ]


def expected(rows):
    """(doc_id, text) of the rows that stay: one of equal rows, then one of each class."""
    words = lambda t: (t or "").split()
    distinct = list(dict.fromkeys((i, t) for i, t, _ in rows))
    sets = [{tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for _, t in distinct]
    group = list(range(len(distinct)))
    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                group = [group[y] if n == group[x] else n for n in group]
    return [[row for row, n in zip(distinct, group, strict=True) if n == m] for m in sorted(set(group))]


def test_one_row_of_each_class_stays(spark, rows):
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    left = Counter((r["doc_id"], r["text"]) for r in kept)
    for members in expected(rows):
        assert sum(left[m] for m in members) == 1
        with_id = [i for i, _ in members if i is not None]
        assert next(i for i, _ in members if left[i, _]) == (min(with_id) if with_id else None)
    assert len(kept) == len(expected(rows))


def test_texts_of_one_id_are_judged_one_by_one(spark, rows):
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found)
    # kept is doc_id = component_id, row by row
    assert got[1, 1, True] == 3 and got[2, 1, False] == 1
    assert got[3, 3, True] == 2 and got[4, 3, False] == got[5, 3, False] == 1
    assert got[6, 6, True] == 2 and got[9, 9, True] == 2
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    assert all(r["kept"] is None for r in found if r["doc_id"] is None)
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)


def test_a_contaminated_text_takes_only_its_own_rows(spark, rows):
    benchmark = spark.createDataFrame([(1, rows[4][1]), (2, rows[10][1])], "item_id long, text string")
    left = decontamination.remove_contaminated(spark.createDataFrame(rows, SCHEMA), benchmark).collect()
    gone = Counter((i, t) for i, t, _ in rows) - Counter((r["doc_id"], r["text"]) for r in left)
    assert gone == Counter([(3, rows[4][1]), (4, rows[6][1]), (None, rows[10][1]), (None, rows[10][1])])


def test_the_pipeline_keeps_the_words_of_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    deduped = corpus_pipeline.near_dedup(spark, docs, "")
    left = substrings.without_repeats(deduped).collect()
    for members in expected(rows):
        own = {(i, t) for i, t in members}
        assert sum((r["doc_id"], r["text"]) in own for r in left) == 1
