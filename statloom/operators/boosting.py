"""Gradient-boosted trees on histograms: the trees of many targets and folds grow together.

Rows are coded once (numbers by quantile bins, categories by the place of their level), numbered in the order of a hash of their key and packed into blocks
of ``BLOCK`` rows. To a target, rows with equal codes of all other features are one cell: trees tell them no further apart, and their sums by fold and level
are all that gradients and scores need. A few columns have few cells however many rows there are; then one job counts the cells of all targets, and each task
grows the trees of one target and fold over them. The number of cells is checked first; beyond ``FEW_BLOCKS`` blocks of them, and with equal results, one job
a depth adds up gradients by (tree, node, feature, bin) over all blocks and searches the sums by groups of trees, so that the driver receives the splits
alone, whatever the rows. Every ``REFRESH`` rounds the blocks are rewritten with the margins so far, so tasks evaluate few trees again.

Folds are exact: within each class of a target, rows in the order of the hash are dealt in turn, so a class's counts over the folds differ by
one at most. The number of rows of a class before a block comes from the blocks' own counts.

Permutations are keyed bijections of the row numbers (a Feistel network with cycle walking): a true permutation of the whole table, without a
sort. A row sends its codes to the row that it is mapped to. Where the used features have fewer combinations of bins than rows are judged, the guess of
each combination is worked out once and looked up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_table
from .describe import clean_numbers

BINS, BLOCK, DEPTH, RATE, LEAST_LEAF, REFRESH = 48, 8192, 3, 0.1, 20, 10
#: Levels of a category at most; columns with more are no categories.
MOST_LEVELS = 255
#: Numbers that the histograms of one job may have, and bytes of them that may meet in one task.
AT_ONCE, DIRECT_BYTES = 4_000_000, 64 << 20
#: Cells of a target as blocks at most, if the sums, margins, gradients and codes of one task aren't larger than this; with more, trees grow by one job a depth.
FEW_BLOCKS, TASK_BYTES = 48, 1 << 30
#: Counted rows and bytes of sums that a pack holds, bytes of guesses that are broadcast at most, and guesses that are worked out by one task.
PACKED_ROWS, PACKED_BYTES, FEW_BYTES, GUESSES = 200_000, 32 << 20, 16 << 20, 1 << 14
SEED = 42


@dataclass
class Target:
    """What is predicted: a number, or one of the levels of a category."""

    name: str
    levels: list[str] = field(default_factory=list)  # none: a number

    @property
    def outputs(self) -> int:
        return 1 if len(self.levels) <= 2 else len(self.levels)


@dataclass
class Coding:
    """How columns become bins: edges of numbers (values equal to an edge fall below it), levels of categories, and what stands for a missing value."""

    features: list[str]
    edges: dict[str, np.ndarray]
    levels: dict[str, dict[str, int]]
    counts: dict[str, dict[str, int]]
    missing: dict[str, int]

    def bins(self) -> list[int]:
        """How many codes each feature may have."""
        return [len(self.edges[c]) + 1 if c in self.edges else max(self.levels[c].values()) + 1 for c in self.features]


def level_codes(levels: list[str]) -> dict[str, int]:
    """Places of the sorted levels, brought down to fewer than ``BINS`` where there are more."""
    ordered = sorted(levels)
    most = max(len(ordered), BINS)
    return {x: i * BINS // most for i, x in enumerate(ordered)}


def learn_coding(df: DataFrame, numbers: list[str], categories: list[str]) -> Coding:
    """Two aggregates: quantiles of all numbers, and rows by level of all categories that have few levels."""
    df = clean_numbers(df)
    marks = [i / BINS for i in range(1, BINS)]
    row = df.agg(F.lit(0).alias("_"), *[F.percentile_approx(F.col(c).cast("double"), [0.5, *marks], 10_000).alias(f"e{i}") for i, c in enumerate(numbers)]).first()
    found = {c: np.array(row[f"e{i}"]) for i, c in enumerate(numbers) if row[f"e{i}"] is not None}
    edges = {c: np.unique(x[1:]) for c, x in found.items()}
    missing = {c: int(np.searchsorted(edges[c], x[0])) for c, x in found.items()}
    counts: dict[str, dict[str, int]] = {}
    if categories:
        near = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in categories]).first()
        few = [c for c in categories if 0 < near[c] <= MOST_LEVELS]
        if few:
            long = df.select([F.col(c).cast("string").alias(c) for c in few]).unpivot([], few, "variable", "level").where("level is not null")
            for r in long.groupBy("variable", "level").count().collect():  # at most some hundred levels a column
                counts.setdefault(r["variable"], {})[r["level"]] = r["count"]
    levels = {}
    for c, own in counts.items():
        levels[c] = level_codes(list(own))
        codes, n = np.array([levels[c][x] for x in own]), np.array(list(own.values()))
        order = np.argsort(codes)
        missing[c] = int(codes[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
    return Coding([c for c in [*numbers, *categories] if c in missing], edges, levels, counts, missing)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds _row, 0, 1, ... in the order of a hash of the key: counts of buckets give where each begins, so no task sorts all rows."""
    spark = df.sparkSession
    h = F.xxhash64(F.col(key), F.lit(SEED))
    n = df.count()
    buckets = max(1, -(-n // 50_000))
    placed = df.withColumns({"_h": h, "_bucket": F.floor((F.shiftrightunsigned(h, 32) * buckets) / F.lit(1 << 32)).cast("long")})
    if buckets == 1:
        return placed.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)).cast("long") - 1).drop("_h", "_bucket")
    sizes = {r["_bucket"]: r["count"] for r in placed.groupBy("_bucket").count().collect()} if buckets <= 100_000 else None
    if sizes is not None:
        at, starts = 0, []
        for b in range(buckets):
            starts.append((b, at))
            at += sizes.get(b, 0)
        starts = spark.createDataFrame(starts, "_bucket long, _first long")
    else:
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = placed.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    return placed.withColumn("_in", inside).join(starts, "_bucket").withColumn("_row", F.col("_first") + F.col("_in") - 1).drop("_h", "_bucket", "_first", "_in")


def packed(df: DataFrame, key: str, coding: Coding, targets: list[Target], folds: int) -> DataFrame:
    """Written blocks: block, n, keys, codes (a byte a feature and row, feature by feature), values and folds of the targets (-1: missing)."""
    columns = list(dict.fromkeys([*coding.features, *[t.name for t in targets]]))
    number = lambda c: c in coding.edges
    df = numbered(clean_numbers(df).select(F.col(key).alias("_key"), *[F.col(c).cast("double" if number(c) else "string").alias(c) for c in columns]), "_key")
    strata = [len(t.levels) or 1 for t in targets]
    places = np.concatenate([[0], np.cumsum(strata)])
    key_type = df.schema["_key"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("codes", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("counts", T.ArrayType(T.LongType()))])

    def coded(column: pa.ChunkedArray, codes: dict[str, int], missing: float) -> np.ndarray:
        """The code of each text, and of those without any what stands for a missing value."""
        place = pc.index_in(column, pa.array(list(codes), column.type)).fill_null(len(codes)).to_numpy()
        return np.array([*codes.values(), missing])[place]

    def pack(name: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("_row").to_numpy())))
        n = table.num_rows
        codes = np.zeros((len(coding.features), n), np.uint8)
        for i, c in enumerate(coding.features):
            if number(c):
                x = table.column(c).to_numpy().astype(float)
                codes[i] = np.where(np.isnan(x), coding.missing[c], np.searchsorted(coding.edges[c], x))
            else:
                codes[i] = coded(table.column(c), coding.levels[c], coding.missing[c])
        values = np.zeros((len(targets), n))
        counts = np.zeros(places[-1], np.int64)
        for i, t in enumerate(targets):
            if t.levels:
                values[i] = coded(table.column(t.name), {x: k for k, x in enumerate(t.levels)}, np.nan)
                counts[places[i] : places[i + 1]] = np.bincount(values[i][~np.isnan(values[i])].astype(int), minlength=len(t.levels))
            else:
                values[i] = table.column(t.name).to_numpy().astype(float)
                counts[places[i]] = (~np.isnan(values[i])).sum()
        own_keys = pa.concat_arrays(table.column("_key").chunks)
        keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own_keys)
        return pa.table({"block": [name[0].as_py()], "n": pa.array([n], pa.int32()), "keys": keys, "codes": [codes.tobytes()], "values": [values.tobytes()], "counts": [counts.tolist()]})

    rows = df.withColumn("block", F.expr(f"_row div {BLOCK}"))
    blocks = work_table(rows.groupBy("block").applyInArrow(pack, schema), "blocks")
    order = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", F.posexplode("counts").alias("place", "own")).withColumn("before", F.coalesce(F.sum("own").over(order), F.lit(0)))
    before = before.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "before"))), lambda x: x["before"]).alias("before"))

    def fold(batches):
        for batch in batches:
            out = []
            for raw, n, start in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
                values = np.frombuffer(raw).reshape(len(targets), n)
                dealt = np.full((len(targets), n), -1, np.int8)
                for i, t in enumerate(targets):
                    for c in range(strata[i]):
                        mine = np.flatnonzero(values[i] == c if t.levels else ~np.isnan(values[i]))
                        dealt[i, mine] = (start[places[i] + c] + np.arange(len(mine))) % folds
                out.append(dealt.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary()), pa.array([b""] * len(out), pa.binary())], names=[*schema.names[:5], "folds", "margins"])

    done = T.StructType([*schema.fields[:5], T.StructField("folds", T.BinaryType()), T.StructField("margins", T.BinaryType())])
    return work_table(blocks.join(before, "block").select(*schema.names[:5], "before").mapInArrow(fold, done), "folded")


def _added(blocks: DataFrame, work: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """The sum of work(block) over all blocks, of a small fixed size."""

    def run(batches):
        total = np.zeros(size)
        some = False
        for batch in batches:
            for row in batch.select(["n", "codes", "values", "folds", "margins"]).to_pylist():
                total += work(row)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    got = blocks.select("n", "codes", "values", "folds", "margins").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    return np.bincount(got.column("i").to_numpy(), got.column("v").to_numpy(), minlength=size) if got.num_rows else np.zeros(size)


@dataclass
class Forest:
    """Trees of all outputs: for each round, arrays (outputs, nodes) of features (-1: no split), bins and the values of the leaves."""

    targets: list[Target]
    models: int  # for each target one a fold, and the last of all rows
    base: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    gains: np.ndarray | None = None
    fits: np.ndarray | None = None  # (targets, models, 4) sums of ``_fit_sums``, where growing over cells found them

    def outputs(self) -> list[tuple[int, int, int]]:
        """(target, model, output) of each column of margins."""
        return [(i, m, k) for i, t in enumerate(self.targets) for m in range(self.models) for k in range(t.outputs)]


def leaves(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row at a depth of one tree: a comparison of bytes for each node that is split."""
    node = np.zeros(codes.shape[1], np.uint8 if depth < 8 else np.int64)
    for d in range(depth):
        first, right = (1 << d) - 1, np.zeros(codes.shape[1], bool)
        for j in range(1 << d):
            if (f := feature[first + j]) >= 0:
                beyond = codes[f] > cut[first + j]
                right |= beyond & (node == j) if d else beyond
        node += node
        node += right
    return node


def _margins(row: dict, codes: np.ndarray, base: np.ndarray, rounds: list, depth: int) -> np.ndarray:
    """Margins (outputs, rows) from those of the last rewrite and the trees since."""
    out = np.frombuffer(row["margins"]).reshape(len(base), -1).copy() if row["margins"] else np.repeat(base[:, None], row["n"], 1)
    for feature, cut, value in rounds:
        for s in range(len(base)):
            if (feature[s] >= 0).any() or value[s].any():
                out[s] += value[s][leaves(codes, feature[s], cut[s], depth)]
    return out


def _gradients(target: Target, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margins (outputs, rows)."""
    if not target.levels:
        return margin - y, np.ones_like(margin)
    if target.outputs == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return p - y, p * (1 - p)
    p = softmax(margin)
    return p - (np.arange(len(p))[:, None] == y), p * (1 - p)


def _cell_gradients(target: Target, rows: np.ndarray, sums: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``_gradients`` over the rows of each cell."""
    if not target.levels:
        return rows * margin - sums[1], rows[None]
    if target.outputs == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return rows * p - sums[1], rows * (p * (1 - p))
    p = softmax(margin)
    return rows * p - sums, rows * (p * (1 - p))


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(0))
    return e / e.sum(0)


def best_splits(hist: np.ndarray, least: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), bin, gain and the two sides' sums (g, h, n) from histograms (3, outputs, nodes, features, bins)."""
    left = np.cumsum(hist, -1)
    total = left[..., -1:]
    right = total - left
    score = lambda x: x[0] ** 2 / np.maximum(x[1], 1e-12)
    gain = score(left) + score(right) - score(total)
    gain = np.where((left[2] >= least) & (right[2] >= least) & (left[1] > 1e-9) & (right[1] > 1e-9), gain, -np.inf)
    if barred is not None:
        gain = np.where(barred[:, None, :, None], -np.inf, gain)
    flat = gain.reshape(*gain.shape[:2], -1)
    place = flat.astype(np.float32).argmax(-1)  # gains that differ by the order of sums only are equal: the first counts
    top = np.take_along_axis(flat, place[..., None], -1)[..., 0]
    feature, cut = np.divmod(place, hist.shape[-1])
    sides = np.stack([np.take_along_axis(x.reshape(*x.shape[:3], -1), place[None, ..., None], -1)[..., 0] for x in (left, right)])
    return np.where(top > 1e-9, feature, -1), cut, np.where(top > 1e-9, top, 0), sides


def splits(hist: np.ndarray, least: int, barred: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best splits, and the sums (3, outputs, nodes) of each node."""
    return *best_splits(hist, least, barred), hist[:, :, :, 0, :].sum(-1)


class Growing:
    """The trees of one round for some outputs, while they grow."""

    def __init__(self, outputs: int, depth: int, rate: float, features: int):
        self.feature, self.cut = np.full((outputs, (1 << depth) - 1), -1), np.zeros((outputs, (1 << depth) - 1), int)
        self.value, self.gains = np.zeros((outputs, 1 << depth)), np.zeros((outputs, features))
        self.depth, self.rate = depth, rate

    def take(self, d: int, split: np.ndarray, at: np.ndarray, gain: np.ndarray, sides: np.ndarray, total: np.ndarray) -> bool:
        """Split the nodes of a depth as ``splits`` found; whether any was."""
        first, step, parted = (1 << d) - 1, 1 << (self.depth - d), split >= 0
        self.feature[:, first : first + (1 << d)], self.cut[:, first : first + (1 << d)] = split, at
        np.add.at(self.gains, (np.nonzero(parted)[0], split[parted]), gain[parted])
        newton = lambda s: np.where(s[2] > 0, -self.rate * s[0] / np.maximum(s[1], 1e-12), 0.0)
        # a side's value stands on the leftmost leaf below it; a node that isn't split has its parent's side already
        self.value[:, ::step] = np.where(parted, newton(sides[0]), self.value[:, ::step] if d else newton(total))
        self.value[:, step // 2 :: step] = np.where(parted, newton(sides[1]), 0.0)
        return bool(parted.any())

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.feature, self.cut, self.value


def _start(blocks: DataFrame, targets: list[Target], folds: int) -> np.ndarray:
    """The first margin of each output: the mean, the log odds or the log shares of its training rows."""
    strata = [max(len(t.levels), 1) for t in targets]

    def work(row: dict) -> np.ndarray:
        values, dealt = np.frombuffer(row["values"]).reshape(len(targets), -1), np.frombuffer(row["folds"], np.int8).reshape(len(targets), -1)
        out = []
        for i, t in enumerate(targets):
            own = np.zeros((2, folds, strata[i]))
            known = dealt[i] >= 0
            k = values[i][known].astype(int) if t.levels else np.zeros(known.sum(), int)
            np.add.at(own[0], (dealt[i][known], k), 1)
            np.add.at(own[1], (dealt[i][known], k), 1 if t.levels else values[i][known])
            out.append(own.ravel())
        return np.concatenate(out)

    sums = np.split(_added(blocks, work, 2 * folds * sum(strata)), np.cumsum([2 * folds * s for s in strata])[:-1])
    base = []
    for t, s, own in zip(targets, strata, sums, strict=True):
        n, y = own.reshape(2, folds, s)
        for m in range(folds + 1):
            use = [j for j in range(folds) if j != m]
            count, total = n[use if m < folds else slice(None)].sum(0), y[use if m < folds else slice(None)].sum(0)
            share = np.maximum(count, 1e-9) / max(count.sum(), 1)
            base += [total[0] / max(count[0], 1)] if not t.levels else [np.log(share[1] / share[0])] if s == 2 else np.log(share).tolist()
    return np.array(base)


def fit(blocks: DataFrame, coding: Coding, targets: list[Target], folds: int, rounds: int, depth: int = DEPTH, rate: float = RATE, least: int = LEAST_LEAF, few_blocks: int = FEW_BLOCKS, margins: bool = True) -> tuple[DataFrame, Forest]:
    """The blocks with all margins, and the trees: for each target a model without each fold, and one of all rows. Without ``margins`` the blocks
    stay as they are if the trees grew over cells; fold scores don't need them then."""
    f = len(coding.features)
    base = _start(blocks, targets, folds)
    forest = Forest(targets, folds + 1, base, gains=np.zeros((len(base), f)))
    own_column = np.array([[t.name == c for c in coding.features] for t in targets])
    barred = own_column[[i for i, _, _ in forest.outputs()]]  # a target tells nothing about itself
    if (cells := _cells_of(blocks, coding, forest, folds, few_blocks)) is not None:
        _grow_apart(cells, coding, forest, folds, rounds, depth, rate, least)
        return work_table(_with_margins(blocks, forest, 0, depth), "margins") if margins else blocks, forest
    written_rounds, blocks = 0, blocks.persist()
    tasks = blocks.rdd.getNumPartitions()
    for number in range(rounds):
        if number - written_rounds == REFRESH:
            fresh = work_table(_with_margins(blocks, forest, written_rounds, depth), "margins")
            blocks.unpersist()
            blocks, written_rounds = fresh.persist(), number
        trees = Growing(len(base), depth, rate, f)
        for d in range(depth):
            if not trees.take(d, *_level(blocks, forest, written_rounds, trees.done(), d, depth, least, barred, tasks)):
                break
        forest.rounds.append(trees.done())
        forest.gains += trees.gains
        if (trees.feature < 0).all():  # nothing can be split any more
            break
    out = work_table(_with_margins(blocks, forest, written_rounds, depth), "margins")
    blocks.unpersist()
    return out, forest


def _histograms(codes: np.ndarray, node: list[np.ndarray] | None, g: np.ndarray, h: np.ndarray, nodes: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums (3, outputs, nodes, features, bins) of g, h and rows (outputs, rows), one each if ``rows`` isn't given. Without ``node`` there is one node, and all outputs have the same rows in it."""
    f, size = len(codes), nodes * BINS
    out = np.empty((3, len(g), nodes, f, BINS))
    add = lambda cell, x: np.bincount(cell, x, size).reshape(nodes, BINS)
    whole = codes.astype(np.intp)
    if node is None:
        for j in range(f):
            out[2, :, :, j] = add(whole[j], rows)
    for k in range(len(g)):
        first = None if node is None else node[k].astype(np.intp) * BINS
        for j in range(f):
            cell = whole[j] if first is None else whole[j] + first
            out[0, k, :, j], out[1, k, :, j] = add(cell, g[k]), add(cell, h[k])
            if node is not None:
                out[2, k, :, j] = out[1, k, :, j] if h[k] is rows else add(cell, rows)
    return out


def _sums_of(target: Target) -> int:
    """How many sums a cell has for each fold: rows by level, or rows, the number and its square."""
    return len(target.levels) or 3


def _centres(forest: Forest) -> list[float]:
    """What numbers are counted from: the mean of all rows."""
    first = {i: s for s, (i, m, _) in enumerate(forest.outputs()) if m == forest.models - 1}
    return [0.0 if t.levels else float(forest.base[first[i]]) for i, t in enumerate(forest.targets)]


def _others(coding: Coding, targets: list[Target]) -> list[np.ndarray]:
    """The places of the features that each target is predicted from."""
    return [np.array([j for j, c in enumerate(coding.features) if c != t.name], int) for t in targets]


def _cells_of(blocks: DataFrame, coding: Coding, forest: Forest, folds: int, few_blocks: int) -> DataFrame | None:
    """The cells of all targets in packs: target, part, codes (feature by feature) and sums (fold by fold); none if a target has more than a task takes."""
    targets, f, bins, others, centres = forest.targets, len(coding.features), coding.bins(), _others(coding, forest.targets), _centres(forest)
    n = int(blocks.agg(F.sum("n")).first()[0] or 0)
    possible = [int(np.prod([bins[j] for j in own], dtype=object)) for own in others]
    limits = [min(few_blocks * BLOCK, TASK_BYTES // (48 * t.outputs + 16 * (folds + 1) * _sums_of(t) + 32 * f)) for t in targets]

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.uint8).reshape(f, row["n"])
                values, dealt = np.frombuffer(row["values"]).reshape(len(targets), -1), np.frombuffer(row["folds"], np.int8).reshape(len(targets), -1)
                for i, t in enumerate(targets):
                    use = np.flatnonzero(dealt[i] >= 0)
                    y, own = values[i][use], np.ascontiguousarray(codes[np.ix_(others[i], use)].T)
                    cell = pa.Array.from_buffers(pa.binary(own.shape[1]), len(use), [None, pa.py_buffer(own)]).cast(pa.binary())
                    stratum = dealt[i][use].astype(np.int32) * max(len(t.levels), 1) + (y.astype(np.int32) if t.levels else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), i, np.int32)), cell, pa.array(stratum), pa.array(np.zeros(len(use)) if t.levels else y - centres[i])], names=["target", "cell", "stratum", "y"])

    sent = blocks.select("n", "codes", "values", "folds").mapInArrow(send, "target int, cell binary, stratum int, y double")
    if any(few < min(n, most) for few, most in zip(limits, possible, strict=True)):
        if min(limits) <= 0:
            return None
        near = {r["target"]: r["cells"] for r in sent.groupBy("target").agg(F.approx_count_distinct("cell", 0.02).alias("cells")).collect()}
        if any(near.get(i, 0) > few for i, few in enumerate(limits)):
            return None

    def pack(name: tuple, table: pa.Table) -> pa.Table:
        i = name[0].as_py()
        width, k = _sums_of(targets[i]), len(others[i])
        whole = np.frombuffer(b"".join(table.column("cell").to_pylist()), np.uint8).reshape(-1, k)
        codes, place = np.unique(whole, axis=0, return_inverse=True)
        place, stratum, sums = place.ravel(), table.column("stratum").to_numpy(), np.zeros((folds * width, len(codes)))
        if targets[i].levels:
            sums[stratum, place] = table.column("n").to_numpy()
        else:
            for at, c in enumerate(("n", "y", "yy")):
                sums[stratum * width + at, place] = table.column(c).to_numpy()
        return pa.table({"target": pa.array([i], pa.int32()), "part": pa.array([name[1].as_py()], pa.int64()), "codes": pa.array([codes.T.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = [max(1, -(-min(n, most * folds * (len(t.levels) or 1)) // PACKED_ROWS), -(-min(n, most, few) * 8 * folds * _sums_of(t) // PACKED_BYTES)) for t, most, few in zip(targets, possible, limits, strict=True)]
    counted = sent.groupBy("target", "cell", "stratum").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    counted = counted.withColumn("part", F.pmod(F.xxhash64("cell"), F.element_at(F.array(*[F.lit(p).cast("long") for p in parts]), F.col("target") + 1)))
    return counted.groupBy("target", "part").applyInArrow(pack, "target int, part long, codes binary, sums binary")


def _grow_apart(cells: DataFrame, coding: Coding, forest: Forest, folds: int, rounds: int, depth: int, rate: float, least: int) -> None:
    """Grow the trees over cells: one task for each target and fold. Those with most outputs begin."""
    targets, outputs, f, others, centres = forest.targets, forest.outputs(), len(coding.features), _others(coding, forest.targets), _centres(forest)
    pairs = [(i, m) for i in sorted(range(len(targets)), key=lambda i: -targets[i].outputs) for m in range(forest.models)]
    held = cells.sparkSession.sparkContext.broadcast(forest.base)

    def work(batches):
        packs = sorted((x for batch in batches for x in batch.to_pylist()), key=lambda x: x["part"])
        if not packs:
            return
        pair = packs[0]["pair"]
        i, m = pairs[pair]
        target, features = targets[i], others[i]
        mine = [s for s, (a, b, _) in enumerate(outputs) if (a, b) == (i, m)]
        codes = np.concatenate([np.frombuffer(x["codes"], np.uint8).reshape(len(features), -1) for x in packs], 1)
        sums = np.concatenate([np.frombuffer(x["sums"]).reshape(folds, _sums_of(target), -1) for x in packs], 2)
        packs.clear()
        judged = sums[m].copy() if m < folds else sums.sum(0)
        sums = sums[[j for j in range(folds) if j != m]].sum(0)
        rows = sums.sum(0) if target.levels else sums[0]
        margin = np.repeat(held.value[mine][:, None] - centres[i], codes.shape[1], 1)
        barred = np.zeros((len(mine), len(features)), bool)
        grown, gains = [], np.zeros((len(mine), f))
        for _ in range(rounds):
            trees = Growing(len(mine), depth, rate, len(features))
            g, h = _cell_gradients(target, rows, sums, margin)
            node = None
            for d in range(depth):
                if not trees.take(d, *splits(_histograms(codes, node, g, h, 1 << d, rows), least, barred)):
                    break
                node = [leaves(codes, trees.feature[k], trees.cut[k], d + 1) for k in range(len(mine))]
            for k in range(len(mine)):
                margin[k] += trees.value[k][leaves(codes, trees.feature[k], trees.cut[k], depth)]
            feature, cut, value = trees.done()
            grown.append((np.where(feature >= 0, features[feature], -1), cut, value))
            gains[:, features] += trees.gains
            if (feature < 0).all():
                break
        guess = predicted(target, margin)
        if target.levels:
            fit = [judged.sum(), judged[guess.astype(int), np.arange(len(guess))].sum(), 0, 0]
        else:
            fit = [judged[0].sum(), (judged[0] * guess**2 - 2 * judged[1] * guess + judged[2]).sum(), judged[1].sum(), judged[2].sum()]
        arrays = [np.stack(x).astype(float).tobytes() for x in zip(*grown, strict=True)] if grown else [b""] * 3
        yield pa.RecordBatch.from_arrays([pa.array([pair], pa.int32()), pa.array([len(grown)]), *[pa.array([x], pa.binary()) for x in (*arrays, gains.tobytes(), np.array(fit, float).tobytes())]], names=["pair", "rounds", "feature", "cut", "value", "gains", "fit"])

    first = {i: p for p, (i, m) in enumerate(pairs) if m == 0}
    of_target = F.element_at(F.array(*[F.lit(first[i]) for i in range(len(targets))]), F.col("target") + 1)
    copies = cells.withColumn("pair", F.explode(F.sequence(of_target, of_target + (forest.models - 1)))).drop("target")
    found = copies.repartitionById(len(pairs), "pair").mapInArrow(work, "pair int, rounds long, feature binary, cut binary, value binary, gains binary, fit binary").toArrow().to_pylist()
    most = max([r["rounds"] for r in found], default=0)
    shapes = ((1 << depth) - 1, (1 << depth) - 1, 1 << depth)
    stacked = [np.full((most, len(outputs), k), fill) for k, fill in zip(shapes, (-1.0, 0.0, 0.0), strict=True)]
    forest.fits = np.zeros((len(targets), forest.models, 4))
    for r in found:
        mine = [s for s, (a, b, _) in enumerate(outputs) if (a, b) == pairs[r["pair"]]]
        for whole, c, k in zip(stacked, ("feature", "cut", "value"), shapes, strict=True):
            whole[: r["rounds"], mine] = np.frombuffer(r[c]).reshape(r["rounds"], len(mine), k)
        forest.gains[mine] = np.frombuffer(r["gains"]).reshape(len(mine), -1)
        forest.fits[pairs[r["pair"]]] = np.frombuffer(r["fit"])
    forest.rounds = [(a.astype(int), b.astype(int), c) for a, b, c in zip(*stacked, strict=True)]


def _level(blocks: DataFrame, forest: Forest, since: int, tree: tuple, d: int, depth: int, least: int, barred: np.ndarray, tasks: int) -> tuple[np.ndarray, ...]:
    """The splits of one depth of the trees that grow. Histograms are added up and searched by groups of outputs; only what is split where reaches the driver."""
    held = blocks.sparkSession.sparkContext.broadcast((forest.base, forest.rounds[since:], tree, barred))
    targets, models, outputs, f, nodes = forest.targets, forest.models, len(forest.base), barred.shape[1], 1 << d
    each = 3 * nodes * f * BINS
    group = max(1, min(-(-outputs // 16), DIRECT_BYTES // (8 * each * tasks)))  # what all tasks found of a group meets in one
    firsts = list(range(0, outputs, group))

    def add(batches):
        base, rounds, (feature, cut, _), _ = held.value
        total, block = np.zeros((3, outputs, nodes, f, BINS)), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "n", "codes", "values", "folds", "margins")}
                block = row["block"] if block is None else min(block, row["block"])
                n = row["n"]
                codes = np.frombuffer(row["codes"], np.uint8).reshape(f, n)
                values, dealt = np.frombuffer(row["values"]).reshape(len(targets), n), np.frombuffer(row["folds"], np.int8).reshape(len(targets), n)
                margin = _margins(row, codes, base, rounds, depth)
                at = 0
                for t, y, fold in zip(targets, values, dealt, strict=True):
                    for m in range(models):
                        own, use = slice(at, at + t.outputs), np.flatnonzero((fold >= 0) & (fold != m))
                        mine = np.ascontiguousarray(codes[:, use])
                        g, h = _gradients(t, y[use], margin[own].take(use, 1))
                        node = [leaves(mine, feature[s], cut[s], d) for s in range(own.start, own.stop)] if d else None
                        total[:, own] += _histograms(mine, node, g, h, nodes)
                        at += t.outputs
        if block is not None:
            for i, s in enumerate(firsts):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([block]), pa.array([total[:, s : s + group].tobytes()], pa.binary())], names=["part", "block", "sums"])

    def split(name: tuple, found: pa.Table) -> pa.Table:
        s = firsts[name[0].as_py()]
        allowed = held.value[3][s : s + group]
        hist = np.zeros(3 * len(allowed) * nodes * f * BINS)
        for i in np.argsort(found.column("block").to_numpy()):  # always in the same order
            hist += np.frombuffer(found.column("sums")[int(i)].as_buffer())
        best = splits(hist.reshape(3, len(allowed), nodes, f, BINS), least, allowed)
        return pa.table({"part": [name[0].as_py()], "best": pa.array([np.concatenate([x.astype(float).reshape(-1, len(allowed), nodes) for x in best]).tobytes()], pa.binary())})

    parts = blocks.mapInArrow(add, "part long, block long, sums binary").groupBy("part").applyInArrow(split, "part long, best binary").toArrow().to_pylist()
    best = np.zeros((12, outputs, nodes))
    best[0] = -1  # no blocks, no split
    for r in parts:
        s = firsts[r["part"]]
        best[:, s : s + group] = np.frombuffer(r["best"]).reshape(12, -1, nodes)
    return best[0].astype(int), best[1].astype(int), best[2], best[3:9].reshape(2, 3, outputs, nodes), best[9:]


def _with_margins(blocks: DataFrame, forest: Forest, since: int, depth: int) -> DataFrame:
    held = blocks.sparkSession.sparkContext.broadcast((forest.base, forest.rounds[since:]))

    def run(batches):
        base, rounds = held.value
        for batch in batches:
            rows = batch.select(["n", "codes", "margins"]).to_pylist()
            new = [_margins(r, np.frombuffer(r["codes"], np.uint8).reshape(-1, r["n"]), base, rounds, depth).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], names=batch.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def permuted_numbers(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1: four Feistel rounds on the least even number of bits, walked until the image lies below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, key]).integers(1, 1 << 63, 4, dtype=np.uint64)
    out = numbers.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(64 - half) & low)
        out[todo] = left << np.uint64(half) | right
        todo = out >= n
    return out.astype(np.int64)


def predicted(target: Target, margin: np.ndarray) -> np.ndarray:
    """The number, or the code of the likeliest level."""
    if not target.levels:
        return margin[0]
    return (margin[0] > 0).astype(float) if target.outputs == 1 else margin.argmax(0).astype(float)


def _fit_sums(target: Target, y: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """n, what a score needs: squared errors (or hits), and the sums of y for its variance."""
    if target.levels:
        return np.array([len(y), (guess == y).sum(), 0, 0])
    return np.array([len(y), ((y - guess) ** 2).sum(), y.sum(), (y * y).sum()])


def _score(target: Target, s: np.ndarray) -> np.ndarray:
    """Accuracy or R2 from such sums (last axis)."""
    n = np.maximum(s[..., 0], 1)
    if target.levels:
        return s[..., 1] / n
    spread = s[..., 3] - s[..., 2] ** 2 / n
    return np.where(spread > 0, 1 - s[..., 1] / np.where(spread > 0, spread, 1), 0.0)


def fold_scores(blocks: DataFrame, forest: Forest, folds: int) -> np.ndarray:
    """Scores (targets, folds) of rows that the model didn't see, and (targets,) of the model of all rows."""
    targets, models = forest.targets, forest.models
    if forest.fits is not None:
        return np.stack([_score(t, s) for t, s in zip(targets, forest.fits, strict=True)])

    def work(row: dict) -> np.ndarray:
        n = row["n"]
        values, dealt = np.frombuffer(row["values"]).reshape(len(targets), n), np.frombuffer(row["folds"], np.int8).reshape(len(targets), n)
        margin = np.frombuffer(row["margins"]).reshape(-1, n)
        out, at = np.zeros((len(targets), folds + 1, 4)), 0
        for i, t in enumerate(targets):
            for m in range(models):
                use = dealt[i] == m if m < folds else dealt[i] >= 0
                out[i, m] = _fit_sums(t, values[i][use], predicted(t, margin[at : at + t.outputs][:, use]))
                at += t.outputs
        return out.ravel()

    sums = _added(blocks, work, len(targets) * (folds + 1) * 4).reshape(len(targets), folds + 1, 4)
    return np.stack([_score(t, s) for t, s in zip(targets, sums, strict=True)])


def _guesses(spark, coding: Coding, targets: list[Target], base: np.ndarray, rounds: list, judged: int, depth: int) -> dict[int, tuple[list[int], np.ndarray]]:
    """For targets whose used features have fewer combinations of bins than ``judged`` rows a feature: these features, and the guess for each combination."""
    f, bins = len(coding.features), coding.bins()
    own_rows = np.concatenate([[0], np.cumsum([t.outputs for t in targets])])
    used = np.zeros((len(base), f), bool)
    for feature, _, _ in rounds:
        s, k = np.nonzero(feature >= 0)
        used[s, feature[s, k]] = True
    kind = lambda i: np.dtype(float if not targets[i].levels else np.uint8 if len(targets[i].levels) <= 256 else np.int64)
    asked, size = {}, 0
    for i in range(len(targets)):
        features = np.flatnonzero(used[own_rows[i] : own_rows[i + 1]].any(0)).tolist()
        combinations = int(np.prod([bins[j] for j in features], dtype=object))
        own = combinations * kind(i).itemsize
        if features and combinations <= judged * len(features) and size + own <= FEW_BYTES:
            asked[i], size = (features, combinations), size + own
    chunks = [(i, at, min(at + GUESSES, n)) for i, (_, n) in sorted(asked.items(), key=lambda x: -targets[x[0]].outputs) for at in range(0, n, GUESSES)]
    if not chunks:
        return {}
    held = spark.sparkContext.broadcast((base, rounds))

    def work(batches):
        base, rounds = held.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                i, start, stop = chunks[at]
                features, rows = asked[i][0], slice(own_rows[i], own_rows[i + 1])
                codes = np.zeros((f, stop - start), np.uint8)
                codes[features] = np.unravel_index(np.arange(start, stop), [bins[j] for j in features])
                margin = np.repeat(base[rows][:, None], stop - start, 1)
                _add_trees(margin, codes, rounds, rows, depth)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([predicted(targets[i], margin).astype(kind(i)).tobytes()], pa.binary())], names=["at", "guess"])

    found = {r["at"]: np.frombuffer(r["guess"], kind(chunks[r["at"]][0])) for r in spark.range(0, len(chunks), 1, len(chunks)).mapInArrow(work, "at long, guess binary").toArrow().to_pylist()}
    return {i: (features, np.concatenate([found[at] for at, c in enumerate(chunks) if c[0] == i])) for i, (features, _) in asked.items()}


def _add_trees(margin: np.ndarray, codes: np.ndarray, rounds: list, rows: slice, depth: int) -> None:
    """Add what the trees of some outputs give to their margins."""
    for feature, cut, value in rounds:
        for k, s in enumerate(range(rows.start, rows.stop)):
            margin[k] += value[s][leaves(codes, feature[s], cut[s], depth)]


def permutation_importance(blocks: DataFrame, coding: Coding, forest: Forest, whole: np.ndarray, repeats: int = 3, depth: int = DEPTH) -> np.ndarray:
    """What the score of the model of all rows loses when a feature is permuted, the mean of some repeats: (targets, features).

    Each row receives the codes of another for a repeat, once for all features and targets. A feature that no tree uses loses nothing.
    """
    f, targets = len(coding.features), forest.targets
    n = int(blocks.agg(F.sum("n")).first()[0] or 0)
    spark = blocks.sparkSession
    last = [s for s, (_, m, _) in enumerate(forest.outputs()) if m == forest.models - 1]
    base, rounds = forest.base[last], [(a[last], b[last], c[last]) for a, b, c in forest.rounds]
    held = spark.sparkContext.broadcast((base, rounds, _guesses(spark, coding, targets, base, rounds, n * repeats, depth)))
    own_rows, bins = np.concatenate([[0], np.cumsum([t.outputs for t in targets])]), coding.bins()

    def send(batches):
        for batch in batches:
            for block, size, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "codes")), strict=True):
                codes = np.frombuffer(raw, np.uint8).reshape(f, size).T
                for r in range(repeats):
                    to = permuted_numbers(block * BLOCK + np.arange(size), n, r)
                    order = np.argsort(to)
                    blocks_, first = np.unique(to[order] // BLOCK, return_index=True)
                    ends, places = np.append(first, size).astype(np.int32), (to[order] % BLOCK).astype(np.int32)
                    packs = [pa.Array.from_buffers(pa.binary(), len(blocks_), [None, pa.py_buffer(ends * np.int32(w)), pa.py_buffer(np.ascontiguousarray(x))]) for w, x in ((4, places), (f, codes[order]))]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks_), pa.array(np.full(len(blocks_), r, np.int32)), *packs], names=["block", "repeat", "places", "codes"])

    sent = blocks.select("block", "n", "codes").mapInArrow(send, "block long, repeat int, places binary, codes binary")

    def judge(mine: pa.Table, others: pa.Table) -> pa.Table:
        base, rounds, guesses = held.value
        row = mine.to_pylist()[0]
        size = row["n"]
        codes = np.frombuffer(row["codes"], np.uint8).reshape(f, size)
        values, dealt = (np.frombuffer(row[c], t).reshape(len(targets), size) for c, t in (("values", float), ("folds", np.int8)))
        used = np.zeros((len(base), f), bool)
        for feature, _, _ in rounds:
            s, k = np.nonzero(feature >= 0)
            used[s, feature[s, k]] = True
        strides, combination = {}, {}
        for i, (features, _) in guesses.items():
            strides[i] = dict(zip(features, np.cumprod([1, *[bins[j] for j in features[:0:-1]]])[::-1].tolist(), strict=True))
            combination[i] = sum(codes[j].astype(np.int64) * step for j, step in strides[i].items())
        out = np.zeros((repeats, len(targets), f, 4))
        repeat = others.column("repeat").to_numpy()
        for r in range(repeats):
            own = others.filter(pa.array(repeat == r))
            new = np.empty((size, f), np.uint8)
            new[np.frombuffer(b"".join(own.column("places").to_pylist()), np.int32)] = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(-1, f)
            for j in range(f):
                moved = codes.copy()
                moved[j] = new[:, j]
                for i, t in enumerate(targets):
                    rows_ = slice(own_rows[i], own_rows[i + 1])
                    if not used[rows_, j].any():
                        continue
                    known = dealt[i] >= 0
                    if i in guesses:
                        guess = guesses[i][1][combination[i] + (moved[j].astype(np.int64) - codes[j]) * strides[i][j]][known]
                    else:
                        margin = np.repeat(base[rows_][:, None], size, 1)
                        _add_trees(margin, moved, rounds, rows_, depth)
                        guess = predicted(t, margin[:, known])
                    out[r, i, j] = _fit_sums(t, values[i][known], guess)
        return pa.table({"i": np.arange(out.size), "v": out.ravel()})

    own_blocks = blocks.select("block", "n", "codes", "values", "folds")
    parts = sent.groupBy("block").cogroup(own_blocks.groupBy("block")).applyInArrow(lambda a, b: judge(b, a), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    sums = np.bincount(parts.column("i").to_numpy(), parts.column("v").to_numpy(), minlength=repeats * len(targets) * f * 4).reshape(repeats, len(targets), f, 4) if parts.num_rows else np.zeros((repeats, len(targets), f, 4))
    lost = np.stack([whole[i] - _score(t, sums[:, i]) for i, t in enumerate(targets)])
    return np.where(sums[0, :, :, 0] > 0, lost.mean(1), 0.0)


def out_of_fold(blocks: DataFrame, forest: Forest, key: str, key_type) -> DataFrame:
    """key, target, fold, actual and risk (the share of the second level) of every row and target with two levels, from the model that didn't see it."""
    targets, models = forest.targets, forest.models
    first = {(i, m): s for s, (i, m, k) in enumerate(forest.outputs()) if k == 0}
    schema = T.StructType([T.StructField(key, key_type), T.StructField("target", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("actual", T.IntegerType()), T.StructField("risk", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at, row in enumerate(batch.select(["n", "values", "folds", "margins"]).to_pylist()):
                n, keys = row["n"], batch.column(batch.schema.get_field_index("keys"))[at].values
                values, dealt = np.frombuffer(row["values"]).reshape(len(targets), n), np.frombuffer(row["folds"], np.int8).reshape(len(targets), n)
                margin = np.frombuffer(row["margins"]).reshape(-1, n)
                for i, t in enumerate(targets):
                    if len(t.levels) != 2:
                        continue
                    known = np.flatnonzero(dealt[i] >= 0)
                    pick = np.array([first[i, m] for m in range(models)])[dealt[i][known]]
                    risk = 1 / (1 + np.exp(-np.clip(margin[pick, known], -40, 40)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(known)), pa.array([t.name] * len(known)), pa.array(dealt[i][known].astype(np.int32)), pa.array(values[i][known].astype(np.int32)), pa.array(risk)], names=schema.names)

    return blocks.mapInArrow(run, schema)
