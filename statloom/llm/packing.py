"""Packing of tokenised documents into sequences of a fixed length.

Documents are cut into pieces of at most ``capacity`` ids. Randomised groups of pieces are packed on their own by
first-fit decreasing; a tournament tree over the room left in each bin finds the leftmost bin that fits in
O(log n). Only piece lengths are shuffled, never texts or ids.

Defined cases: a null or empty text has the closing id alone; rows with a repeated or null doc_id are packed row by
row; ties in length go by doc_id and start; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch, written
from .textkernel import chunks, ragged, split_words
from .units import UNIT_BYTES, tokenizer_file, word_bpe, word_bpe_units

CAPACITY = 2048
CLOSING_ID = 1
#: Documents in a group, on average: a few thousand leave FFD hardly any padding to save.
GROUP_DOCUMENTS = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def document_ids(data: np.ndarray, offsets: np.ndarray, cache, closing: int, units=None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents of a chunk in a row, closing id included, and where each begins. ``units`` says how texts are cut for the cache."""
    coded, start, end = units(data, offsets) if units else word_bpe_units(data, split_words(data, offsets))
    flat, size = cache.ids(cache.slots_of(coded, start, end))
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, start, "right") - 1
    tokens = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(tokens + 1)])
    out = np.full(first[-1], closing, np.uint32)
    out[ragged(first[:-1], tokens)] = flat
    return out, first


def cut_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, closing: int = CLOSING_ID, keep_ids: bool = False, remember: bool = False) -> DataFrame:
    """One row per piece, with the ids themselves if asked for."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = word_bpe(tokenizer_file(vocabulary))
        doc_ids = batch.column(0)
        columns: list[list] = [[], [], [], [], [], []]
        for row, _, data, offsets in chunks(batch.column(1), UNIT_BYTES):
            ids, first = document_ids(data, offsets, cache, closing)
            raw = ids.astype("<u4").tobytes()
            total = np.diff(first)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            start = ragged(np.zeros(len(n), np.int64), n) * capacity
            length = np.minimum(capacity, total[doc] - start)
            at = first[:-1][doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            for out, x in zip(columns, (doc + row, start, length, crc, total[doc]), strict=False):
                out.append(np.asarray(x, np.int64))
            if keep_ids:
                columns[5] += [ids[a : a + k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        take = pa.array(np.concatenate(columns[0]))
        arrays = [doc_ids.take(take)] + [pa.array(np.concatenate(x)) for x in columns[1:5]]
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, PIECES + ", ids array<int>" * keep_ids, remember)


class RoomTree:
    """A tournament tree over bins: each inner node has the most room of any bin below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The leftmost bin with enough room, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        found = node - self.leaves
        room[node] = had - size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the lengths must fall."""
    full = int((lengths == capacity).sum())  # these come first and fill a bin each
    where, offset = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    tree = RoomTree(max(1, len(lengths) - full), capacity)
    for i, size in enumerate(lengths[full:].tolist(), full):
        found, had = tree.place(size)
        where[i], offset[i] = full + found, capacity - had
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Sequences for the pieces; sequence_id is unique over all groups.

    Pieces, not documents, are dealt to the groups. Each row has a salt, so that rows with equal content don't meet in one group; it
    is written with the pieces, so that a task that runs again deals them alike.
    """
    pieces = written(pieces.withColumn("_salt", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // group_documents))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + where
        used = rows.groupby("sequence_id")["length"].transform("sum").to_numpy()
        rows["padded_length"] = np.where(used & (used - 1), capacity, used)
        return rows[list(names)]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_salt"), F.lit(groups))).drop("_salt")
    pieces = pieces.drop("_salt")
    names = dict.fromkeys([*pieces.columns, "sequence_id", "offset", "padded_length"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, padded_length long"
    return dealt.groupBy("_group").applyInPandas(work, schema)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, closing: int = CLOSING_ID, keep_ids: bool = False, remember: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (the filled length where that is a power of two)."""
    return pack(cut_pieces(docs, vocabulary, capacity, closing, keep_ids, remember), capacity)
