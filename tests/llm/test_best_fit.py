"""Best-fit packing: ids against the tokeniser, sequences against the rule's plain form, and how few they are."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statloom.llm import bestfit
from statloom.llm.packing import document_ids
from statloom.llm.units import byte_bpe, byte_bpe_units, tokenizer_file

FILE = "byte_bpe_50k.json"
PARTS = ["a", "Ab", "don't", "'s", "'", "''ll", "1", "23", ".", "?!", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "ß", "日本", "\x1c", "\x00", "<|endoftext|>", "<|", "|>", "’s", "x'S", "_", "\r\n", "\x85", "😀", "١٢", "×", "Ж", "ÿ", "ſ", "´"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file(FILE))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), st.text(max_size=9)), min_size=1, max_size=4))
def test_units_give_the_ids_of_whole_texts(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, first = document_ids(np.frombuffer(b"".join(raw), np.uint8), offsets, byte_bpe(tokenizer_file(FILE)), 0, byte_bpe_units)
    whole = Tokenizer.from_file(tokenizer_file(FILE)) if not hasattr(test_units_give_the_ids_of_whole_texts, "whole") else test_units_give_the_ids_of_whole_texts.whole
    test_units_give_the_ids_of_whole_texts.whole = whole
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [[*whole.encode(x.decode(), add_special_tokens=False).ids, 0] for x in raw]


def test_pieces_and_sequences(spark, tokenizer):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["the", "Größe", "don't", "x1", "\n\n", "!"]) for _ in range(n))
    texts = [None, "", " ", "<|endoftext|> a", text(9000), text(2047), text(40_000)] + [text(rng.randint(1, 900)) for _ in range(120)]
    rows = [(None if i == 9 else i, t, "clash", "clash", 3) for i, t in enumerate(texts)]
    rows += [rows[12], (13, "another text under a repeated id", "clash", "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, piece string, start int").repartition(3)
    got = bestfit.pack_best(docs, keep_ids=True).collect()
    expected = defaultdict(int)
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 2048)
        edges = [0, *range(len(ids) - 2048 * (n - 1), len(ids) + 1, 2048)] if n > 1 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        found[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def plainly(lengths, capacity):
    """The rule, by adding up the squares for every place that has room."""
    gaps, where = [], []

    def squares(of):
        return sum(of.count(g) ** 2 for g in set(of) if g)

    for size in lengths:
        options = [(squares([*gaps[:i], g - size, *gaps[i + 1 :]]), g) for i, g in enumerate(gaps) if g >= size]
        if options:
            gap = min(options)[1]
            place = max(i for i, g in enumerate(gaps) if g == gap)
            gaps[place] -= size
        else:
            gap, place = capacity, len(gaps)
            gaps.append(capacity - size)
        where.append(gap - size)
    return where, gaps


def test_sum_of_squares_equals_the_plain_form():
    rng = np.random.default_rng(1)
    for capacity in (7, 40):
        for _ in range(30):
            lengths = rng.integers(1, capacity, 60)
            where, offset = bestfit.sum_of_squares(lengths, capacity)
            gaps_after, gaps = plainly(lengths.tolist(), capacity)
            assert (capacity - offset - lengths).tolist() == gaps_after
            assert sorted(capacity - np.bincount(where, weights=lengths).astype(int)) == sorted(gaps)


def test_groups_cost_hardly_a_sequence(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 7) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = bestfit.pack_fewest(pieces, group_pieces=256).collect()
    assert len(got) == 5000
    need = math.ceil(lengths.sum() / 2048)
    assert len({r["sequence_id"] for r in got}) <= need * 1.004 + 1
    # pieces that never share a sequence end after one round
    alone = pieces.limit(600).selectExpr("doc_id", "piece", "start", "1500L as length", "ids_crc32")
    assert bestfit.pack_fewest(alone, group_pieces=50).select("sequence_id").distinct().count() == 600


def test_no_rows(spark):
    assert bestfit.pack_best(spark.createDataFrame([], "doc_id long, text string")).count() == 0
