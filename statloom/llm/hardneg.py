"""Hard-negative mining over an index of rotated one-bit codes.

Every vector is rotated, and the signs of its components are its first code. The code vector (signs of unit length) explains
as much of it as their inner product says, the stored alignment; what it leaves is rotated again and coded in the same way, ``LEVELS``
times, and the length of the last residual is stored too. An anchor is rotated alike and cut into ``PLANES`` bit planes, so that
its inner product with a code is a few AND and popcount. Their sum over the levels estimates the inner product of the vectors, and by
Cauchy-Schwarz the rest is at most the residual's length times the part of the anchor that the last code doesn't explain, plus
what the bit planes rounded off. So the true score lies in the interval with certainty. Rows whose interval can't reach what is wanted go;
those that survive are scored by their integers. No row is missed: recall is 1 (tested against brute force).

All rows are indexed, in a written table. Anchors meet all rows in blocks of at most about ``BLOCK_BYTES`` (their number is counted first): a block is
broadcast, tasks stream the index and hold for each anchor the best of what they have met, and only these few rows are shuffled.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or with a component beyond ``LARGEST`` after
scaling (whose scores may not fit a long) take no part; shorter vectors are filled up with zeros; repeated rows are rows of their own; an
anchor isn't its own positive; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import written

LEVELS = 3
PLANES = 6
SCALE = 256
LARGEST = 1 << 26
SEED = 20
BLOCK_BYTES = 32 << 20
#: Rows and anchors that are compared at a time.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 256
SCORED_AT_ONCE = 1 << 15

INDEX = "vec_id long, label long, ints binary, codes binary, parts binary"
LEAST = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, ints (array of the scaled and floored components) of the rows that take part."""
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good).select("vec_id", "label", ints.alias("ints"))


def rotations(size: int, levels: int = LEVELS, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix for each level."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(levels)])


def padded(ints: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(ints), size))
    out[:, : ints.shape[1]] = ints
    return out


def encode(ints: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, levels, words of 64 signs), and for each row its length, the alignment of each level and the length of the last residual."""
    size = turns.shape[1]
    rest = padded(ints, size)
    parts, codes = [np.linalg.norm(rest, axis=1)], []
    for turn in turns:
        rest = rest @ turn.T
        sign = rest >= 0
        aligned = np.abs(rest).sum(1) / np.sqrt(size)
        rest = rest - (aligned / np.sqrt(size))[:, None] * np.where(sign, 1.0, -1.0)
        codes.append(np.packbits(sign, axis=1, bitorder="little").view("<u8"))
        parts.append(aligned)
    return np.stack(codes, 1), np.stack([*parts, np.linalg.norm(rest, axis=1)], 1)


class Anchors:
    """A block of anchors, turned and cut into bit planes."""

    def __init__(self, ints: np.ndarray, turns: np.ndarray, planes: int = PLANES):
        self.ints, size = ints, turns.shape[1]
        rest = padded(ints, size)
        self.length = np.linalg.norm(rest, axis=1).astype(np.float32)
        bits, low, unit, total, lost = [], [], [], [], []
        for turn in turns:
            rest = rest @ turn.T
            a = rest.min(1)
            step = np.maximum((rest.max(1) - a) / ((1 << planes) - 1), 1e-12)
            whole = np.rint((rest - a[:, None]) / step[:, None]).astype(np.uint8)
            bits.append(np.stack([np.packbits(whole >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(planes)], 1))
            low.append(a), unit.append(step), total.append(whole.sum(1, dtype=np.int64))
            lost.append(np.linalg.norm(rest - (a[:, None] + step[:, None] * whole), axis=1))
        self.bits = np.stack(bits, 1)  # anchor, level, plane, word
        self.low, self.unit, self.total, self.lost = (np.stack(x, 1).astype(np.float32) for x in (low, unit, total, lost))


def interval(codes: np.ndarray, parts: np.ndarray, anchors: Anchors, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of an interval that holds the inner product of each row (down) with each of some anchors (across)."""
    levels, words = codes.shape[1:]
    root = np.float32(np.sqrt(64 * words))
    parts = parts.astype(np.float32)
    middle = np.zeros((len(codes), len(at)), np.float32)
    slack, last = np.zeros_like(middle), middle
    for k in range(levels):
        set_bits = np.bitwise_count(codes[:, k]).sum(1, dtype=np.int32)
        both = np.zeros(middle.shape, np.int32)
        for j in range(anchors.bits.shape[2]):
            plane = anchors.bits[at, k, j]
            for w in range(words):
                both += np.bitwise_count(codes[:, k, w, None] & plane[None, :, w]).astype(np.int32) << j
        low, unit, total, lost = (x[at, k] for x in (anchors.low, anchors.unit, anchors.total, anchors.lost))
        last = ((2 * set_bits - 64 * words).astype(np.float32)[:, None] * low + (2 * both - total) * unit) / root
        middle += parts[:, 1 + k, None] * last
        slack += parts[:, 1 + k, None] * lost
    length = anchors.length[at]
    explained = np.maximum(np.abs(last) - anchors.lost[at, levels - 1], 0)
    unexplained = np.sqrt(np.maximum(length * length - explained * explained, 0))
    # the last term covers the rounding of these float32 sums
    return middle, slack + parts[:, -1, None] * unexplained + parts[:, 0, None] * length * np.float32(2e-5) + np.float32(0.01)


def exact(rows: np.ndarray, row: np.ndarray, anchors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer scores of pairs."""
    out = np.zeros(len(row), np.int64)
    for a in range(0, len(row), SCORED_AT_ONCE):
        part = slice(a, a + SCORED_AT_ONCE)
        out[part] = np.einsum("ij,ij->i", rows[row[part]], anchors[anchor[part]])
    return out


class Best:
    """The first ``most`` of each slot, by falling score, then rising id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.score, self.id = np.full((slots, most), LEAST), np.full((slots, most), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        """The score that a slot's last has: one below it can't come in."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.score[slot, -1]
        slot, score, ids = slot[may], score[may], ids[may]
        if not len(slot):
            return
        own = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(own, self.most)])
        score, ids = np.concatenate([score, self.score[own].ravel()]), np.concatenate([ids, self.id[own].ravel()])
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order of whole numbers
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        take = begin[:, None] + np.arange(self.most)
        self.score[own], self.id[own] = score[take], ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > LEAST)
        return slot, self.score[slot, place], self.id[slot, place]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _opened(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Ids, labels, ints, codes and parts of index rows."""
    ids, labels = (np.asarray(batch.column(c)) for c in (0, 1))
    parts = _matrix(batch.column(4), "<f8")
    codes = _matrix(batch.column(3), "<u8").reshape(len(ids), parts.shape[1] - 2, -1)
    return ids, labels, _matrix(batch.column(2), "<i4").astype(np.int64), codes, parts


def build_index(rows: DataFrame, levels: int = LEVELS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The written index, a row of codes for each row of (vec_id, label, ints), and the rotations."""
    wide = rows.select(F.max(F.size("ints"))).first()[0] or 1
    turns = rotations(-(-wide // 64) * 64, levels, seed)
    held = rows.sparkSession.sparkContext.broadcast(turns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ints = np.zeros((n, wide), "<i4")
            row = np.repeat(np.arange(n), size)
            ints[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            codes, parts = encode(ints, held.value)
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (ints, np.ascontiguousarray(codes), np.ascontiguousarray(parts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["vec_id", "label", "ints", "codes", "parts"])

    return written(rows.mapInArrow(work, INDEX), "index"), turns


def _compared(index: DataFrame, anchors: Anchors, ids: np.ndarray, labels: np.ndarray, windows: np.ndarray | None, most: int) -> DataFrame:
    """slot, score, vec_id: what each task found best.

    Without windows, the best rows of each anchor's label, a slot an anchor. With windows (anchor, place: a positive's score, LEAST where there is none),
    the best rows of other labels with 80 % of that score up to all of it, a slot for each window.
    """
    held = index.sparkSession.sparkContext.broadcast((anchors, labels, windows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, windows = held.value
        places = 1 if windows is None else windows.shape[1]
        best = Best(len(labels) * places, most)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = _opened(batch.slice(a, ROWS_AT_ONCE))
                for b in range(0, len(labels), ANCHORS_AT_ONCE):
                    at = np.arange(b, min(b + ANCHORS_AT_ONCE, len(labels)))
                    if windows is None:
                        _meet_positives(rows, anchors, labels, at, best)
                    else:
                        _meet_negatives(rows, anchors, labels, windows, at, best)
        slot, score, found = best.rows()
        for a in range(0, len(slot), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (slot, score, found)], names=["slot", "score", "vec_id"])

    return index.mapInArrow(work, "slot long, score long, vec_id long")


def _meet_positives(rows: tuple, anchors: Anchors, labels: np.ndarray, at: np.ndarray, best: Best) -> None:
    ids, own, ints, codes, parts = rows
    for label in np.intersect1d(own, labels[at]).tolist():
        row, near = np.flatnonzero(own == label), at[labels[at] == label]
        middle, half = interval(codes[row], parts[row], anchors, near)
        wanted = best.least[near].astype(np.float64)
        if len(row) >= best.most:  # so many rows surely reach this
            wanted = np.maximum(wanted, np.partition(middle - half, len(row) - best.most, axis=0)[-best.most])
        i, j = np.nonzero(middle + half >= wanted)
        best.add(near[j], exact(ints, row[i], anchors.ints, near[j]), ids[row[i]])


def _meet_negatives(rows: tuple, anchors: Anchors, labels: np.ndarray, windows: np.ndarray, at: np.ndarray, best: Best) -> None:
    ids, own, ints, codes, parts = rows
    at = at[(windows[at] >= 0).any(1)]  # below zero, 80 % of a score is more than all of it
    if not len(at):
        return
    middle, half = interval(codes, parts, anchors, at)
    high = windows[at].max(1)
    low = np.where(windows[at] >= 0, np.maximum(-(-4 * windows[at] // 5), best.least.reshape(windows.shape)[at]), np.iinfo(np.int64).max).min(1)
    i, j = np.nonzero((middle + half >= low) & (middle - half <= high) & (own[:, None] != labels[at]))
    anchor = at[j]
    score = exact(ints, i, anchors.ints, anchor)
    for place in range(windows.shape[1]):
        top = windows[anchor, place]
        fits = (top >= 0) & (4 * top <= 5 * score) & (score <= top)
        best.add(anchor[fits] * windows.shape[1] + place, score[fits], ids[i[fits]])


def _first(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks: of each slot the first rows, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, levels: int = LEVELS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, embedding) that ``anchors`` marks."""
    spark = vectors.sparkSession
    index, turns = build_index(scaled(vectors, label), levels)
    chosen = index.where(anchors).select(*index.columns, F.monotonically_increasing_id().alias("anchor"))
    chosen = written(chosen, "anchors")
    words = turns.shape[1] // 64
    each = 8 * words * (64 + levels * PLANES) + 16 * (levels + positives)
    blocks = -(-chosen.count() * each // block_bytes)
    out = []
    for k in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == k).orderBy("vec_id", "anchor").toArrow()  # at most about block_bytes
        if not block.num_rows:
            continue
        ids, labels, ints, _, _ = _opened(block)
        held = Anchors(ints, turns)
        own = np.einsum("ij,ij->i", ints, ints)
        # one more, as an anchor is among the rows of its own label
        found = _first(_compared(index, held, ids, labels, None, positives + 1), positives + 1).select("slot", "score", "vec_id").toArrow()
        slot, score, near = (found.column(c).to_numpy() for c in range(3))
        order = np.lexsort((near, ~score, slot))
        slot, score, near = slot[order], score[order], near[order]
        itself = (near == ids[slot]) & (score == own[slot])
        itself[itself] = np.diff(slot[itself], prepend=-1) != 0  # one row, whatever its copies
        slot, score, near = slot[~itself], score[~itself], near[~itself]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        slot, score, near, place = (x[place < positives] for x in (slot, score, near, place))
        windows = np.full((len(ids), positives), LEAST)
        windows[slot, place] = score
        # one window for each score: equal ones stand side by side, and the first speaks for all
        windows[:, 1:][windows[:, 1:] == windows[:, :-1]] = LEAST
        found = written(_first(_compared(index, held, ids, labels, windows, negatives), negatives), "found")
        slot_of = slot * positives + (windows[slot] == score[:, None]).argmax(1)
        pairs = spark.createDataFrame(pa.table({"slot": slot_of, "anchor_id": ids[slot], "positive_id": near, "positive_score": score}))
        out.append(pairs.join(found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}), "slot"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = out[0].select(columns)
    for more in out[1:]:
        result = result.unionByName(more.select(columns))
    return result
