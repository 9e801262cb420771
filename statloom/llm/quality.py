"""A quality classifier: random Fourier features, ridge regression from partition sums, isotonic calibration.

Statistics of each text are standardised and mapped to random Fourier features of a Gaussian kernel. Each partition
sums its part of the normal equations (a matrix of ``FEATURES`` + 1 squared, whatever the row count); the sums are added in two
steps, and the driver solves one small system. A fifth of the labelled rows is left for the calibration, which sees their scores in ``BINS`` bins.

Defined cases: null and empty texts have all-zero statistics and get a score like any other; rows of ``labels`` without
quality are left out; rows that repeat a doc_id count each; with no labelled row, or one label only, every score is the
share of label 1, or 0.5; other columns are ignored; rows with equal texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch, written
from .rules import _per_doc, dup_lines, repeat_words
from .textkernel import chunks, mix, split_words

FEATURES = 256
GAMMA = 0.08
RIDGE = 1e-3
BINS = 1000
SEED = 17

#: Fixed sets of signs.
_SETS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": map(ord, "#*$%&|<>@^~=_{}[]\\/+"), "stop": map(ord, ".!?"), "bang": map(ord, "!"), "comma": map(ord, ",;:"), "bar": map(ord, "|"), "high": range(128, 256)}
_TABLES = {}
for _name, _bytes in _SETS.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True

STATISTICS = ["log_words", "word_length", "upper", "digit", "symbol", "stop", "bang", "comma", "bar", "high", "lines", "dup_lines", "repeats", "distinct", "short_words", "capital_words", "signed_words"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each document of a chunk."""
    n = len(offsets) - 1
    words = split_words(data, offsets)
    n_words = words.counts()
    some, hashes = np.maximum(n_words, 1), words.hashes()
    size = np.maximum(np.diff(offsets), 1)
    share = {k: _per_doc(t[data], offsets) / size for k, t in _TABLES.items()}
    lengths = words.end - words.start
    by_doc = lambda flag: np.bincount(words.doc[flag], minlength=n) / some
    key = np.unique(mix(hashes + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    last = data[words.end - 1] if len(words.end) else data[:0]
    letters = _TABLES["upper"][data] | _TABLES["lower"][data]
    big = np.concatenate([[0], np.cumsum(_TABLES["upper"][data])])
    all_letters = np.concatenate([[0], np.cumsum(letters)])
    upper, alpha = big[words.end] - big[words.start], all_letters[words.end] - all_letters[words.start]
    return np.stack([
        np.log1p(n_words), np.bincount(words.doc, weights=lengths, minlength=n) / some, share["upper"], share["digit"], share["symbol"], share["stop"], share["bang"], share["comma"], share["bar"], share["high"],
        np.log1p(50 * _per_doc(data == 0x0A, offsets) / some), dup_lines(data, offsets, words.start) / np.maximum(_per_doc(data == 0x0A, offsets) + 1, 1),
        repeat_words(hashes, words.doc, n) / some, np.bincount(words.doc[key], minlength=n) / some, by_doc(lengths <= 3), by_doc((upper == alpha) & (alpha > 1)), by_doc(_TABLES["symbol"][last] | _TABLES["bang"][last]),
    ], 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(data, offsets) for _, _, data, offsets in chunks(batch.column(1))])
        flat = pa.array(x.ravel())
        ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, x array<double>")


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features, with a constant first."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], features))
    b = rng.uniform(0, 2 * np.pi, features)
    z = np.sqrt(2 / features) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b)
    return np.concatenate([np.ones((len(x), 1)), z], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(rows: DataFrame, part, schema_width: int) -> np.ndarray:
    """The sum of part(batch) over all rows: a partial sum per partition, then sums of those."""

    def first(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) if total is None else total + part(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def again(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.mapInArrow(first, "part binary").repartition(8).mapInArrow(again, "part binary").collect()  # 8 rows at most
    return sum((np.frombuffer(r[0]) for r in parts), np.zeros(schema_width))


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the middles and values of the blocks, which never fall.

    Half a success and half a failure are spread over all bins before they are pooled, so no value is quite 0 or 1.
    """
    all_rows = max(float(weight.sum()), 1.0)
    total, weight = total + weight / (2 * all_rows), weight * (1 + 1 / all_rows)
    blocks: list[list[float]] = []
    for at, t, w in zip(x.tolist(), total.tolist(), weight.tolist(), strict=True):
        blocks.append([at * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(labelled: DataFrame) -> dict[str, np.ndarray] | None:
    """Fit on rows (x, y, calibrate)."""
    stats = labelled.agg(
        F.avg("y").alias("share"), F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"),
        *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATISTICS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not stats["n"] or stats["low"] == stats["high"]:
        return {"constant": np.array([stats["share"] if stats["n"] else 0.5])}
    mean = np.array([stats[f"m{i}"] for i in range(len(STATISTICS))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(STATISTICS))])
    d = FEATURES + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = fourier(_matrix(batch.column(0)), mean, scale), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    sums = summed(labelled.where("not calibrate").select("x", "y"), normal, d * d + d + 1)
    penalty = RIDGE * max(sums[-1], 1) * np.eye(d) + 1e-9 * np.eye(d)
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + penalty, sums[d * d : -1])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw = np.clip(fourier(_matrix(batch.column(0)), mean, scale) @ weights, -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    held = summed(labelled.where("calibrate").select("x", "y"), binned, 2 * BINS)
    count, total = held[:BINS], held[BINS:]
    middle = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    seen = count > 0
    at, value = isotonic(middle[seen], total[seen], count[seen]) if seen.any() else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return {"mean": mean, "scale": scale, "weights": weights, "at": at, "value": value}


def predict(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), float(model["constant"][0]))
    raw = fourier(x, model["mean"], model["scale"]) @ model["weights"]
    return np.clip(np.interp(raw, model["at"], model["value"]), 0, 1)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == part, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; the held-out part never trains."""
    rows = written(document_statistics(docs), "statistics")
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    labelled = rows.where("not held_out").join(known, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrate"))
    model = train(written(labelled, "labelled"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = predict(_matrix(batch.column(2)), model)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return per_batch(rows.select("doc_id", "held_out", "x"), work, "doc_id long, held_out boolean, score double, predicted int")
