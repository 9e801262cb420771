"""Best-fit packing of tokenised documents by the sum of squares, into as few sequences as possible.

Only documents longer than a sequence are cut: into pieces of full length, of which the first may be shorter. Full pieces are
sequences of their own. The others are dealt to random groups; in each, the longest first, every piece goes to the open sequence
where the sum over all gaps of the squared number of sequences with that gap becomes smallest, the smallest gap of
equals. A new sequence is opened only if no open one has room: on random lengths this leaves one sequence in
a thousand more than the tokens need, where the textbook's form, which also opens one if that makes the sum smaller, leaves one in a hundred.

Pieces of sequences that are less than ``ENOUGH`` full after a round are dealt again to fewer groups, until one group is left or a
round doesn't halve them, so that grouping costs hardly a sequence. Only lengths are shuffled, never texts.

Defined cases: a null or empty text has the closing id alone; rows with a repeated or null doc_id are packed row by row; of equal
lengths the smaller doc_id goes first, then the smaller start; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch, written
from .packing import document_ids
from .textkernel import chunks, ragged
from .units import byte_bpe, byte_bpe_units, tokenizer_file

CAPACITY = 2048
#: Bytes of text whose units are looked up together.
CODED_BYTES = 4 << 20
CLOSING_ID = 0
#: Pieces in a group, on average: some thousands of sequences, in a few MB.
GROUP_PIECES = 8192
#: Sequences that are filled to this share aren't opened again by a later round.
ENOUGH = 0.99


def cut_from_the_end(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, closing: int = CLOSING_ID, keep_ids: bool = False, remember: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the ids themselves if asked for."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = byte_bpe(tokenizer_file(vocabulary))
        columns: list[list] = [[], [], [], [], []]
        kept: list = []
        for row, _, data, offsets in chunks(batch.column(1), CODED_BYTES):
            ids, first = document_ids(data, offsets, cache, closing, byte_bpe_units)
            raw = ids.astype("<u4", copy=False).tobytes()
            total = np.diff(first)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            piece = ragged(np.zeros(len(n), np.int64), n)
            end = total[doc] - (n[doc] - 1 - piece) * capacity
            start = np.maximum(end - capacity, 0)
            at = first[:-1][doc] + start
            spans = list(zip(at.tolist(), (end - start).tolist(), strict=True))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in spans]
            for out, x in zip(columns, (doc + row, piece, start, end - start, crc), strict=True):
                out.append(np.asarray(x, np.int64))
            if keep_ids:
                kept += [ids[a : a + k].astype(np.int32) for a, k in spans]
        take, piece, *rest = (np.concatenate(x) for x in columns)
        arrays = [batch.column(0).take(pa.array(take)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)]
        if keep_ids:
            arrays.append(pa.array(kept, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, schema, remember)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given."""
    never = np.int64(1) << np.int64(60)
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by gap
    open_now: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # what the sum grows by when a gap of size, size + 1, ... becomes 0, 1, ...; closed sequences don't count
        own = count[size:capacity]
        change = np.where(own > 0, 2 * (count[: capacity - size] - own) + 2, never)
        if len(own) and own[0]:
            change[0] = 1 - 2 * own[0]
        j = int(change.argmin()) if len(own) else 0
        if len(own) and own[j]:
            gap = size + j
            where[i] = open_now[gap].pop()
            count[gap] -= 1
        else:
            gap, where[i] = capacity, used
            used += 1
        offset[i] = capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_now[gap - size].append(int(where[i]))
    return where, offset


def _round(pieces: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Pieces with sequence_id, offset and _used, the ids in their sequence."""
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("_used", "long")
    names = schema.names

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, rows["offset"] = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["_used"] = np.bincount(where, weights=rows["length"])[where].astype(np.int64)
        rows["sequence_id"] = (number << 58) + (int(key[0]) << 20) + where
        return rows[names]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_salt", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(work, schema)


def pack_fewest(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset. Rows are dealt with a salt, written with them, so that equal rows don't meet and a task that runs again deals alike."""
    columns = pieces.columns
    pieces = written(pieces.withColumn("_salt", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("_salt"), "offset": F.lit(0).cast("long")})
    done = full.select(*columns, "sequence_id", "offset")
    rest = pieces.where(F.col("length") < capacity)
    left, number = rest.count(), 0
    while left:
        groups = -(-left // group_pieces)
        placed = _round(rest, groups, number, capacity)
        if groups > 1:
            placed = written(placed, "placed")
        poor = placed.where(F.col("_used") < ENOUGH * capacity)
        again = poor.count() if groups > 1 else 0
        last = not again or again > left // 2
        done = done.unionByName((placed if last else placed.where(F.col("_used") >= ENOUGH * capacity)).select(*columns, "sequence_id", "offset"))
        rest, left, number = poor.select(*columns, "_salt"), 0 if last else again, number + 1
    return done


def pack_best(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, closing: int = CLOSING_ID, keep_ids: bool = False, remember: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    return pack_fewest(cut_from_the_end(docs, vocabulary, capacity, closing, keep_ids, remember), capacity)
