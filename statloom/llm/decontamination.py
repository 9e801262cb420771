"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item, or a shorter item whole. Of the ``GRAM``-word hashes in each window
the smallest is kept as its fingerprint, so a document that holds the window holds the fingerprint too. Fingerprints of
documents and items are joined, and each hit is extended to the windows around it, which are compared by 64-bit hash.

Items shorter than a window can't be winnowed: documents are scanned for them, length by length.

The fingerprints of items are broadcast while the items have at most ``max_broadcast_windows`` windows (counted first;
20 bytes each); beyond that, fingerprints and windows are joined by shuffles, with equal results.

Defined cases: null and empty texts have no words and are clean; items without words or id are left out; repeated items
count once; repeated rows are judged row by row; an empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch, row_key, written
from .textkernel import ALNUM, LOWER, chunks, covered, inside_document, long_column, split_words, window_hashes, winnow

WINDOW = 13
GRAM = 5
MAX_BROADCAST_WINDOWS = 2_000_000

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _chunk_words(data, offsets):
    words = split_words(LOWER[data], offsets, ALNUM)
    return words, words.hashes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints_at(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all full windows."""
    windows = np.flatnonzero(inside_document(doc, WINDOW))
    grams = window_hashes(hashes, GRAM)
    if not len(windows):
        return windows, grams[:0]
    at = np.unique(winnow(grams, WINDOW - GRAM + 1)[windows])
    return at, grams[at]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, length, window) for all windows of the items, and (…, length 0, fingerprint) for their fingerprints."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lengths, values = [], [], []
        for row, _, data, offsets in chunks(batch.column(1)):
            words, hashes = _chunk_words(data, offsets)
            counts = words.counts()
            at = np.flatnonzero(inside_document(words.doc, WINDOW))
            found = [(words.doc[at], np.full(len(at), WINDOW), window_hashes(hashes, WINDOW)[at])]
            at, prints = fingerprints_at(hashes, words.doc)
            found.append((words.doc[at], np.zeros(len(at), int), prints))
            for k in range(1, WINDOW):
                short = np.flatnonzero(counts == k)
                found.append((short, np.full(len(short), k), window_hashes(hashes, k)[words.first[short]]))
            for doc, length, value in found:
                rows.append(doc + row), lengths.append(length), values.append(_signed(value))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), long_column(np.concatenate(lengths)), pa.array(np.concatenate(values))], names=["item_id", "length", "value"])

    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null")
    return per_batch(items, work, "item_id string, length long, value long").distinct()


def _hits(words, hashes, prints: np.ndarray, by_length: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, length, place in the sorted window hashes of that length) of each window found."""
    starts, lengths, places = [], [], []
    for k, known in by_length.items():
        if k == WINDOW:
            at, own = fingerprints_at(hashes, words.doc)
            at = at[_among(own, prints)[0]]
            near = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            inside = inside_document(words.doc, k)
            near = near[(near >= 0) & (near < len(inside))]
            near = near[inside[near]]
        else:
            near = np.flatnonzero(inside_document(words.doc, k))
        found, place = _among(window_hashes(hashes, k)[near], known)
        starts.append(near[found]), lengths.append(np.full(found.sum(), k)), places.append(place[found])
    if not starts:
        return (np.zeros(0, int),) * 3
    return tuple(map(np.concatenate, (starts, lengths, places)))


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return (known[place] == values if len(known) else np.zeros(len(values), bool)), place


def _known(windows: DataFrame):
    """Sorted fingerprints, sorted window hashes by length, and the items of each window; of a counted, bounded table."""
    table = windows.toPandas()
    table["value"] = table["value"].to_numpy().view(np.uint64)
    by_length, items = {}, {}
    for k, rows in table[table.length > 0].groupby("length"):
        grouped = rows.groupby("value").item_id.agg(list)
        by_length[int(k)], items[int(k)] = grouped.index.to_numpy(np.uint64), grouped.tolist()
    return np.sort(table.value[table.length == 0].unique()).astype(np.uint64), by_length, items


def _judged(column: pa.Array, known) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, hit words and sorted items of each text."""
    prints, by_length, items = known
    n_words, n_hit, found_items = [], [], []
    for _, _, data, offsets in chunks(column):
        words, hashes = _chunk_words(data, offsets)
        start, length, place = _hits(words, hashes, prints, by_length)
        hit = covered(start, length, len(words.doc))
        n_words.append(words.counts())
        n_hit.append(np.bincount(words.doc[hit], minlength=words.n_docs))
        sets: list[set] = [set() for _ in range(words.n_docs)]
        for d, k, p in set(zip(words.doc[start].tolist(), length.tolist(), place.tolist(), strict=True)):
            sets[d].update(items[k][p])
        found_items += [sorted(s) for s in sets]
    return np.concatenate(n_words), np.concatenate(n_hit), found_items


def _by_broadcast(docs: DataFrame, windows: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_known(windows))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, items = _judged(batch.column(1), held.value)
        return pa.RecordBatch.from_arrays([batch.column(0), long_column(n_words), long_column(n_hit), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return per_batch(docs.select("doc_id", "text"), work, "doc_id long, n_words long, n_hit long, items array<string>")


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same through joins: candidates by fingerprint, then windows by hash, then one row for each document."""
    lengths = [r[0] for r in windows.where("length > 0").select("length").distinct().collect()]  # at most WINDOW values
    keyed = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))

    def prints_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, values = [], []
        for row, _, data, offsets in chunks(batch.column(2)):
            words, hashes = _chunk_words(data, offsets)
            at, own = fingerprints_at(hashes, words.doc)
            rows.append(words.doc[at] + row), values.append(_signed(own))
        take = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(values))], names=["_k1", "_k2", "value"])

    known = windows.where("length = 0").select("value").distinct()
    own = per_batch(keyed.select("_k1", "_k2", "text"), prints_of, "_k1 long, _k2 long, value long").distinct()
    near = own.join(known, "value").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("value")).alias("prints"))
    distinct = keyed.dropDuplicates(["_k1", "_k2"]).join(near, ["_k1", "_k2"], "left").select("_k1", "_k2", "text", "prints")

    def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ks, values, starts = [], [], [], []
        for i in range(batch.num_rows):
            for _, _, data, offsets in chunks(batch.column(2).slice(i, 1)):
                words, hashes = _chunk_words(data, offsets)
                for k in lengths:
                    near = np.flatnonzero(inside_document(words.doc, k))
                    if k == WINDOW:
                        prints = np.sort(np.array(batch.column(3)[i].as_py() or [], np.int64).view(np.uint64))
                        at, own = fingerprints_at(hashes, words.doc)
                        at = at[_among(own, prints)[0]]
                        near = np.intersect1d(near, (at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                    rows.append(np.full(len(near), i)), ks.append(np.full(len(near), k)), starts.append(near)
                    values.append(_signed(window_hashes(hashes, k)[near]))
        if not rows:
            return None
        take = pa.array(np.concatenate(rows).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), long_column(np.concatenate(ks)), pa.array(np.concatenate(values)), long_column(np.concatenate(starts))], names=["_k1", "_k2", "length", "value", "start"])

    hits = per_batch(distinct, windows_of, "_k1 long, _k2 long, length long, value long, start long").join(windows.where("length > 0"), ["length", "value"])
    found = hits.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("start", "length")).alias("spans"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit = [], []
        for row, stop, data, offsets in chunks(batch.column(1)):
            words, _ = _chunk_words(data, offsets)
            hit = np.zeros(len(words.doc), bool)
            for i in range(row, stop):
                for span in batch.column(3)[i].as_py() or []:
                    at = words.first[i - row] + span["start"]
                    hit[at : at + span["length"]] = True
            n_words.append(words.counts()), n_hit.append(np.bincount(words.doc[hit], minlength=words.n_docs))
        return pa.RecordBatch.from_arrays([batch.column(0), long_column(np.concatenate(n_words)), long_column(np.concatenate(n_hit)), batch.column(2), batch.column(4), batch.column(5)], names=["doc_id", "n_words", "n_hit", "items", "_k1", "_k2"])

    joined = keyed.join(found, ["_k1", "_k2"], "left").select("doc_id", "text", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", "_k1", "_k2")
    return per_batch(joined, count, "doc_id long, n_words long, n_hit long, items array<string>, _k1 long, _k2 long")


_CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def _windows(benchmark: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The items' windows as a written table, and whether they are few enough to be broadcast."""
    windows = written(item_windows(benchmark), "windows")
    return windows, windows.count() <= most


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated, one row for each row of docs."""
    windows, small = _windows(benchmark, max_broadcast_windows)
    out = (_by_broadcast if small else _by_shuffle)(docs.select(F.col("doc_id").cast("long"), "text"), windows)
    return out.select("doc_id", "n_words", "n_hit", "items", F.expr(_CONTAMINATED).alias("contaminated"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The columns of the query: the items as a digest."""
    found = decontaminate(docs, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; each row is judged by its own text."""
    windows, small = _windows(benchmark, max_broadcast_windows)
    if not small:
        found = _by_shuffle(docs.select(F.col("doc_id").cast("long"), "text"), windows).where(_CONTAMINATED).select("_k1", "_k2").distinct()
        keyed = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text")))
        return keyed.join(written(found, "contaminated"), ["_k1", "_k2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast(_known(windows))
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, _ = _judged(batch.column(at), held.value)
        return batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return per_batch(docs, work, docs.schema)
