"""Unigram token counts by dynamic programming over a trie.

The distinct words that a task meets are inserted in a trie. Each node keeps the best score of any segmentation of its
prefix and the tokens of that segmentation, computed once for all words that share the prefix; a word's count is
read at its last node. Pieces come from a public vocabulary. The score of a piece is the log of its share, plus one smoothed, of all
tokens that the public tokeniser makes of the corpus: distinct words are counted first, each is coded once, and Spark adds up a
count for each piece of the vocabulary.

Defined cases: null and empty texts have no tokens; characters outside the vocabulary count one token a byte, each at the
score of a piece never seen; equal scores go to
the longer last piece; repeated rows are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import CACHES, per_batch
from .substrings import _bytes, _slices
from .textkernel import byte_hashes, chunks, long_column, split_words
from .units import UNIT_BYTES, UnitCache, tokenizer_file

#: Nodes that a worker keeps before it starts a new trie; words beyond LONGEST are counted without one.
MOST_NODES = 500_000
LONGEST = 200


class CountingTrie:
    """Nodes are numbers; one dictionary holds all edges, by parent and sign."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.unknown = unknown
        #: Score of each piece; None for what only ends a piece: a longer candidate may still be one.
        self.endings: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(len(piece))}
        self.endings.update(scores)
        self.clear()
        CACHES.add(self)

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def _forward(self, word: str, end: int, best: list[float], tokens: list[int], path) -> tuple[float, int]:
        """The best score and its tokens for the first ``end`` signs; ``path`` gives the places of the shorter prefixes."""
        endings, found, count, start = self.endings, None, 0, end - 1
        while start >= 0:
            score = endings.get(word[start:end], 0)
            if score == 0:
                break
            if score is not None:
                before = path[start]
                if found is None or best[before] + score >= found:
                    found, count = best[before] + score, tokens[before] + 1
            start -= 1
        if found is None or endings.get(word[end - 1]) is None:
            size, before = len(word[end - 1].encode("utf-8", "replace")), path[end - 1]
            if found is None or best[before] + size * self.unknown > found:
                found, count = best[before] + size * self.unknown, tokens[before] + size
        return found, count

    def count(self, word: str) -> int:
        if len(word) > LONGEST:
            best, tokens, path = [0.0], [0], range(len(word) + 1)
            for end in path[1:]:
                score, count = self._forward(word, end, best, tokens, path)
                best.append(score)
                tokens.append(count)
            return tokens[-1]
        if len(self.best) > MOST_NODES:
            self.clear()
        edges, node, path = self.edges, 0, [0]
        for end, sign in enumerate(word, 1):
            edge = node * 0x110000 + ord(sign)
            node = edges.get(edge, -1)
            if node < 0:
                score, count = self._forward(word, end, self.best, self.tokens, path)
                node = edges[edge] = len(self.best)
                self.best.append(score)
                self.tokens.append(count)
            path.append(node)
        return self.tokens[node]


@lru_cache(maxsize=1)
def _model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def distinct_words(docs: DataFrame) -> DataFrame:
    """word (bytes), n over all texts: each slice adds up its own first."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, counts = [], []
        for _, _, data, offsets in chunks(batch.column(0), UNIT_BYTES):
            words = split_words(data, offsets)
            _, at, n = np.unique(byte_hashes(data, words.start, words.end), return_index=True, return_counts=True)
            parts.append(_slices(data, words.start[at], words.end[at])), counts.append(n)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(parts), long_column(np.concatenate(counts))], names=["word", "n"])

    return per_batch(docs.select("text"), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, vocabulary: str) -> tuple[np.ndarray, int]:
    """How often the public tokeniser uses each piece over all texts, and the size of the vocabulary."""
    size = _model(tokenizer_file(vocabulary)).get_piece_size()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _bytes(batch.column(0))
        raw = data.tobytes()
        coded = _model(tokenizer_file(vocabulary)).encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        weight = np.repeat(batch.column(1).to_numpy(), sizes)
        sums = np.bincount(np.fromiter((i for ids in coded for i in ids), np.int64, int(sizes.sum())), weights=weight, minlength=size)
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(at), long_column(sums[at])], names=["id", "n"])

    rows = per_batch(distinct_words(docs), work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one for each piece
    counts = np.zeros(size)
    counts[[r[0] for r in rows]] = [r[1] for r in rows]
    return counts, size


def piece_scores(path: str, counts: np.ndarray) -> tuple[dict[str, float], float]:
    """The log share of each piece that is text, and of a byte."""
    model, total = _model(path), counts.sum() + len(counts)
    scores = {model.id_to_piece(i): math.log((counts[i] + 1) / total) for i in range(len(counts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return scores, -math.log(total)


@lru_cache(maxsize=1)
def _counter(path: str, counts: bytes) -> UnitCache:
    trie = CountingTrie(*piece_scores(path, np.frombuffer(counts)))
    return UnitCache(lambda words: [[trie.count("▁" + w)] for w in words])


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", remember: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for each row."""
    held = docs.sparkSession.sparkContext.broadcast(piece_counts(docs, vocabulary)[0].tobytes())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_tokens = [], []
        for _, _, data, offsets in chunks(batch.column(1), UNIT_BYTES):
            cache = _counter(tokenizer_file(vocabulary), held.value)
            words = split_words(data, offsets)
            counts, _ = cache.ids(cache.slots_of(data, words.start, words.end))
            n_words.append(words.counts())
            n_tokens.append(np.bincount(words.doc, weights=counts, minlength=words.n_docs))
        return pa.RecordBatch.from_arrays([batch.column(0), long_column(np.concatenate(n_words)), long_column(np.concatenate(n_tokens))], names=["doc_id", "n_words", "n_tokens"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_words long, n_tokens long", remember)
