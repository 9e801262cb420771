"""The whole pipeline, and each stage on what its predecessor kept, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm.units import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, row int, kept string"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(40) for _ in range(3)]
    shared, base = text(70), text(150)
    near = lambda: " ".join(w if i not in (5, 90) else text(1) for i, w in enumerate(base.split(" ")))
    texts = [
        (1, base), (2, base), (3, near()), (4, near()), (4, text(120)), (5, text(60) + " " + shared), (6, shared + "\n" + text(90)), (7, text(80) + " " + items[0] + " " + text(60)),
        (8, text(900) + " " + items[1]), (9, "too short"), (10, None), (11, ""), (12, "a b c " * 60), (None, text(100)), (None, text(110)), (13, text(3000)), (14, "?! " * 80), (15, items[2].upper() + " " + text(20)),
    ]
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, "clash") for i, t in texts]
    rows += [rows[0], rows[13]]  # repeated rows
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def near_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = words_of((t or "").lower())
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                group = [group[y] if g == group[x] else g for g in group]
    return group


def test_stages_and_run(spark, folder):
    path, rows, items = folder
    stages, docs, seen = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{path}/documents.parquet"), []
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert name == "packing" or docs.columns == columns
        docs = corpus_pipeline.written(docs, name)
        seen.append([tuple(r) for r in docs.collect()])
    kept, deduped, cut, clean, packed = seen
    # rejected rows go, all others stay as they were
    assert not Counter(kept) - Counter(rows) and {9, 10, 11, 12, 14}.isdisjoint(r[0] for r in kept) and len(kept) == len(rows) - 5
    # one row of each class
    group = near_classes(kept)
    want = Counter()
    for g in set(group):
        want[min({r for r, h in zip(kept, group, strict=True) if h == g}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))] += 1
    assert Counter(deduped) == want and {r[0] for r in deduped} >= {1, 4, 5, 6, 7, 8, 13, 15, None} and 2 not in {r[0] for r in deduped}
    # words under windows of 35 words that come twice
    count = Counter(tuple(w[i : i + 35]) for _, t, *_ in deduped for w in [words_of(t)] for i in range(len(w) - 34))
    want = Counter()
    for r in deduped:
        w = words_of(r[1])
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        t = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        want[(r[0], t, *r[2:4], len(t), *r[5:])] += 1
    assert Counter(cut) == want and any(len(words_of(r[1])) == 60 for r in cut if r[0] == 5)
    # rows with a twentieth of their words in benchmark windows of 13
    windows = {tuple(w[i : i + 13]) for t in items for w in [words_of(t.lower())] for i in range(len(w) - 12)}
    bad = lambda t: (lambda w: (lambda hit: bool(hit) and 20 * len(hit) >= len(w))({j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}))(words_of(t.lower()))
    assert Counter(clean) == Counter(r for r in cut if not bad(r[1])) and {7, 15}.isdisjoint(r[0] for r in clean) and 8 in {r[0] for r in clean}
    # every id of every text once, gapless, in sequences of 2048
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for r in clean:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[r[0], at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter(p[:5] for p in packed) == want
    used = defaultdict(list)
    for p in packed:
        used[p[5]].append((p[6], p[2]))
    for parts in used.values():
        assert sum(n for _, n in parts) <= 2048 and sorted(parts) == [(sum(n for o, n in parts if o < at), n) for at, n in sorted(parts)]
    ran = corpus_pipeline.run(spark, path)
    assert Counter(tuple(r)[:5] for r in ran.collect()) == want and set(ran.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_on_an_empty_table(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        assert docs.count() == 0
