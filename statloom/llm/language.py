"""Language identification by multilingual mixture inference.

Byte trigrams of letter runs, hashed into ``BUCKETS``, give each learned language a likelihood for every word. A document
is a mixture over its words: expectation-maximisation estimates the proportions, first over all languages, then over the
leading 1, 2, ... of them, until no larger set can win; the set with the best likelihood after a penalty per language is kept.

The model has languages x BUCKETS numbers whatever the corpus; its counts are summed by Spark, and it is broadcast.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was learned;
rows without lang don't train; ties go to the language first in order; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch
from .quality import held_out
from .textkernel import LOWER, chunks, split_words

BUCKETS = 1 << 15
SMOOTHING = 0.5
ITERATIONS = 6
#: Times log(words) / 2, the price of each further language.
PENALTY = 2.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """The letter runs of a chunk, and the bucket of each of their bytes with its two neighbours (space outside the run)."""
    words = split_words(data, offsets, _LETTER)
    at = np.flatnonzero(_LETTER[data])
    lower = LOWER[data].astype(np.uint32)
    before, after = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    before[1:], after[:-1] = lower[:-1], lower[1:]
    before[words.start] = 32
    after[words.end - 1] = 32
    code = (before[at] << np.uint32(16) | lower[at] << np.uint32(8) | after[at]) * np.uint32(2654435761)
    return words, (code >> np.uint32(17)).astype(np.int64)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over rows (lang, text): each task adds up its own counts first."""

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for row, stop, data, offsets in chunks(batch.column(1)):
                words, bucket = trigrams(data, offsets)
                own, code = np.unique(names[row:stop].astype(str), return_inverse=True)
                per_byte = np.repeat(code[words.doc], words.end - words.start)
                counts = np.bincount(per_byte * BUCKETS + bucket, minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS)
                for name, row_counts in zip(own.tolist(), counts, strict=True):
                    sums[name] = sums[name] + row_counts if name in sums else row_counts.copy()
        for name, row_counts in sums.items():
            at = np.flatnonzero(row_counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row_counts[at])], names=["lang", "bucket", "n"])

    parts = docs.select("lang", "text").where("lang is not null").mapInArrow(work, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Sorted languages and the log probability of each bucket in each."""
    counts = count_trigrams(docs).toPandas()  # at most languages x BUCKETS rows
    langs = sorted(counts.lang.unique())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    table[counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int), counts.bucket.to_numpy(int)] += counts.n.to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _expect(likely: np.ndarray, share: np.ndarray, doc: np.ndarray, at: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words (rows of likely) of each document; shares, and the log likelihood."""
    sizes = np.diff(np.append(at, len(doc)))[:, None]
    for _ in range(rounds):
        joint = likely * share[doc]
        share = np.add.reduceat(joint / np.maximum(joint.sum(1, keepdims=True), 1e-300), at) / sizes
    fit = np.add.reduceat(np.log(np.maximum((likely * share[doc]).sum(1), 1e-300)), at)
    return share, fit


def infer(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The proportions of all languages in each document of a chunk; zero outside the chosen set, and where there is no word."""
    n, k = len(offsets) - 1, len(model)
    out = np.zeros((n, k))
    words, bucket = trigrams(data, offsets)
    if not len(words.doc) or not k:
        return out
    first = np.concatenate([[0], np.cumsum(words.end - words.start)])[:-1]
    log = np.stack([np.add.reduceat(row[bucket], first) for row in model], 1).astype(np.float64)
    best = log.max(1, keepdims=True)
    likely = np.exp(np.maximum(log - best, -60))
    present, at, doc = np.unique(words.doc, return_index=True, return_inverse=True)
    sizes = np.diff(np.append(at, len(doc)))
    share, _ = _expect(likely, np.full((len(present), k), 1 / k), doc, at, ITERATIONS)
    order = np.argsort(-share, 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    chosen, score = share, np.full(len(present), -np.inf)
    for m in range(1, k + 1):
        price = PENALTY * (m - 1) * np.log(sizes + 1) / 2
        if (score >= -price).all():  # a likelihood here is at most 1, so no larger set can win
            break
        start = np.where(rank < m, np.maximum(share, 1e-6), 0)
        own, fit = _expect(likely, start / start.sum(1, keepdims=True), doc, at, 3 if m > 1 else 0)
        fit -= price
        better = fit > score
        chosen = np.where(better[:, None], own, chosen)
        score = np.where(better, fit, score)
    out[present] = chosen
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = []
    for row, _, data, offsets in chunks(column):
        ascii_letters = (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)
        sums = np.concatenate([[0], np.cumsum(ascii_letters)])
        own = sums[offsets[1:]] > sums[offsets[:-1]]
        for i in np.flatnonzero(~own).tolist():
            own[i] = any(map(str.isalpha, column[row + i].as_py() or ""))
        found.append(own)
    return np.concatenate(found)


def identify_languages(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions for each row; the held-out part never trains."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    langs, table = learn(rows.where("not held_out"))
    held = docs.sparkSession.sparkContext.broadcast((langs, table))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, table = held.value
        share = np.concatenate([infer(data, offsets, table) for _, _, data, offsets in chunks(batch.column(2))])
        known = has_letter(batch.column(2)) & (share.sum(1) > 0) if langs else np.zeros(batch.num_rows, bool)
        top = share.argmax(1) if langs else np.zeros(batch.num_rows, int)
        names = [langs[i] if ok else "und" for i, ok in zip(top.tolist(), known.tolist(), strict=True)]
        score = np.clip(np.where(known, share.max(1) if langs else 0, 0), 0, 1)
        sets = [[(langs[j], row[j]) for j in np.argsort(-row, kind="stable") if row[j] > 0.01] if ok else [] for row, ok in zip(share, known.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(names), pa.array(score), pa.array([[x for x, _ in s] for s in sets], pa.list_(pa.string())), pa.array([[float(p) for _, p in s] for s in sets], pa.list_(pa.float64())),
        ], names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])

    return per_batch(rows.select("doc_id", "held_out", "text"), work, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")
