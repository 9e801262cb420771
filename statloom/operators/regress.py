"""Regression and ROC measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_sf, norm_sf, t_quantile, t_sf2
from . import groups
from .adjust import adjust_p
from .moments import covariance, known_numbers, summed
from .ranks import mid_ranks


def ols_all(df: DataFrame, columns: list[str], dependents: list[str] | None = None, least_rows: int | None = None) -> DataFrame:
    """Each dependent on all other columns, over complete rows: one matrix of columns x columns gives every model.

    dependent, predictor, n, b, se, beta, t, p, ci_low, ci_high, vif, intercept, r2, adj_r2, f, f_p. Fewer rows than
    ``least_rows`` (five for each predictor and ten more, unless given) give no model.
    """
    schema = "dependent string, predictor string, n long, " + ", ".join(f"{c} double" for c in ("b", "se", "beta", "t", "p", "ci_low", "ci_high", "vif", "intercept", "r2", "adj_r2", "f", "f_p"))
    n, mean, cov = covariance(df, columns)
    rows = []
    p = len(columns) - 1
    if p >= (2 if least_rows is None else 1) and n >= (5 * p + 10 if least_rows is None else least_rows) and (np.diag(cov) > 0).all():
        for y in dependents or columns:
            i = columns.index(y)
            x = [j for j in range(len(columns)) if j != i]
            sxx, sxy = cov[np.ix_(x, x)], cov[x, i]
            if np.linalg.cond(sxx / np.sqrt(np.outer(np.diag(sxx), np.diag(sxx)))) > 1e12:
                continue
            inverse = np.linalg.inv(sxx)
            b = inverse @ sxy
            r2 = float(np.clip(b @ sxy / cov[i, i], 0, 1))
            df2 = n - p - 1
            s2 = cov[i, i] * (1 - r2) * (n - 1) / df2
            se = np.sqrt(s2 * np.diag(inverse) / (n - 1))
            t = b / np.maximum(se, 1e-300)
            half = t_quantile(0.05, df2) * se
            vif = np.diag(inverse) * np.diag(sxx)
            f = r2 / p / max((1 - r2) / df2, 1e-300)
            ps, fp = t_sf2(t, df2), float(f_sf(f, p, df2))
            for k, j in enumerate(x):
                rows.append((y, columns[j], n, *map(float, (b[k], se[k], b[k] * np.sqrt(cov[j, j] / cov[i, i]), t[k], ps[k], b[k] - half[k], b[k] + half[k], vif[k], mean[i] - b @ mean[x], r2, 1 - (1 - r2) * (n - 1) / df2, f, fp))))
    return df.sparkSession.createDataFrame(rows, schema)


def roc_auc(df: DataFrame, outcome: str, scores: list[str]) -> DataFrame:
    """score, n1, n0, auc (folded to 0.5 and above), direction, se (Hanley-McNeil), ci_low, ci_high; outcome is 0 or 1."""
    y = F.col(outcome).cast("int")
    long = known_scores(df.select(y.alias("y"), *[F.col(s).cast("double").alias(s) for s in scores]).unpivot("y", scores, "score", "value"))
    ranks = mid_ranks(long, ["score"], "value")
    cells = long.groupBy("score", "value").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    s = cells.join(ranks, ["score", "value"]).groupBy("score").agg(F.sum("ones").alias("n1"), F.sum("zeros").alias("n0"), F.sum(F.col("ones") * F.col("rank")).alias("r1"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    raw = (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)
    t = s.where("n1 >= 5 and n0 >= 5").withColumns({"raw": raw, "auc": F.greatest(raw, 1 - raw)})
    a = F.col("auc")
    q1, q2 = a / (2 - a), 2 * a**2 / (1 + a)
    se = F.sqrt((a * (1 - a) + (n1 - 1) * (q1 - a**2) + (n0 - 1) * (q2 - a**2)) / (n1 * n0))
    return t.select("score", "n1", "n0", "auc", F.when(F.col("raw") >= 0.5, "higher").otherwise("lower").alias("direction"), se.alias("se"), F.greatest(F.lit(0.0), a - 1.96 * se).alias("ci_low"), F.least(F.lit(1.0), a + 1.96 * se).alias("ci_high"))


def roc_auc_by(df: DataFrame, keys: str, outcome: str, score: str) -> DataFrame:
    """keys, n1, n0, auc of one score within each value of a column, not folded: high scores speak for 1."""
    y = F.col(outcome).cast("int")
    known = known_scores(df.select(keys, y.alias("y"), F.col(score).cast("double").alias("value")))
    ranks = mid_ranks(known, [keys], "value")
    ones = known.groupBy(keys, "value").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    s = ones.join(ranks, [keys, "value"]).groupBy(keys).agg(F.sum("ones").alias("n1"), F.sum("zeros").alias("n0"), F.sum(F.col("ones") * F.col("rank")).alias("r1"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return s.where("n1 > 0 and n0 > 0").select(keys, "n1", "n0", ((F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def known_scores(long: DataFrame) -> DataFrame:
    """Rows with an outcome and a value; NaN is missing."""
    return long.where("y is not null and value is not null and not isnan(value)")


def youden(df: DataFrame, outcome: str, score: str) -> DataFrame:
    """One row: cutoff, sensitivity, specificity, j at the largest difference, the highest cutoff of equals.

    Classes are counted per distinct score; only those counts meet in the running sum.
    """
    y = F.col(outcome).cast("int")
    counts = df.select(y.alias("y"), F.col(score).cast("double").alias("cutoff")).where("y is not null and cutoff is not null and not isnan(cutoff)").groupBy("cutoff").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    cuts = counts.agg(F.percentile_approx("cutoff", [i / 64 for i in range(1, 64)]).alias("_cuts"))
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("cutoff")))).drop("_cuts")
    totals = placed.groupBy("_b").agg(F.sum("ones").alias("o"), F.sum("zeros").alias("z"))  # 64 rows at most
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    offsets = totals.select("_b", F.coalesce(F.sum("o").over(above), F.lit(0)).alias("o0"), F.coalesce(F.sum("z").over(above), F.lit(0)).alias("z0"), F.sum("o").over(whole).alias("n1"), F.sum("z").over(whole).alias("n0"))
    inside = Window.partitionBy("_b").orderBy(F.col("cutoff").desc())
    rates = placed.join(F.broadcast(offsets), "_b").select("cutoff", ((F.col("o0") + F.sum("ones").over(inside)) / F.col("n1")).alias("tpr"), ((F.col("z0") + F.sum("zeros").over(inside)) / F.col("n0")).alias("fpr"))
    best = rates.agg(F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("j"), "cutoff", "tpr", "fpr")).alias("m"))
    return best.select(F.col("m.cutoff").alias("cutoff"), F.col("m.tpr").alias("sensitivity"), (1 - F.col("m.fpr")).alias("specificity"), F.col("m.j").alias("j"))


#: The normal quantile of a 95 % interval.
Z975 = 1.959963984540054
#: Fixed gates: rows of each class, standard errors beyond which an outcome counts as separated, rows of an interaction model.
LEAST_CLASS, SEPARATED, LEAST_MODERATED = 5, 1000.0, 30
#: Newton steps, and the change of the deviance that ends them.
STEPS, SETTLED = 50, 1e-10
#: Models whose sums go through one pass.
MODELS_AT_ONCE = 20_000


def binary_outcomes(df: DataFrame, categories: list[str]) -> dict[str, tuple[str, str]]:
    """The columns with exactly two levels and the levels in order; the second is the event. A few levels a column reach the driver."""
    if not categories:
        return {}
    found = df.agg(*[F.min(F.col(c).cast("string")).alias(f"a{i}") for i, c in enumerate(categories)], *[F.max(F.col(c).cast("string")).alias(f"b{i}") for i, c in enumerate(categories)]).first()
    ends = {c: (found[f"a{i}"], found[f"b{i}"]) for i, c in enumerate(categories)}
    able = [c for c, (a, b) in ends.items() if a is not None and a != b]
    if not able:
        return {}
    others = df.agg(*[F.bool_or(~F.col(c).cast("string").isin(*ends[c])).alias(c) for c in able]).first()
    return {c: ends[c] for c in able if not others[c]}


def logistic_all(df: DataFrame, numbers: list[str], outcomes: list[str]) -> DataFrame:
    """Every outcome with two levels on all numbers, by Newton steps that all models take together: outcome, event, predictor, b, se, odds_ratio, ci_low,
    ci_high, p, p corrections, mcfadden_r2, auc (in sample, by ranks), n, n_events, reason.

    One pass a step adds up, for each model, the information matrix and the score over rows that know the outcome and all numbers; numbers are centred and scaled
    first. A model that has settled leaves the passes. Outcomes of fewer than 10 (p + 1) rows or max(5, 5 p) in a class, and separated ones (standard errors that
    aren't finite or exceed 1000, or no convergence) have a row with their reason instead.
    """
    spark = df.sparkSession
    schema = "outcome string, event string, predictor string, b double, se double, odds_ratio double, ci_low double, ci_high double, p double, mcfadden_r2 double, n long, n_events long, reason string"
    levels = binary_outcomes(df, outcomes)
    names, k = list(levels), len(numbers)
    if not names or not k:
        return adjust_p(spark.createDataFrame([], schema).withColumn("auc", F.lit(None).cast("double")))
    coded = df.select(*[F.when(F.col(c).cast("string") == levels[c][1], 1.0).when(F.col(c).isNotNull(), 0.0).alias(f"_y{i}") for i, c in enumerate(names)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numbers)])
    full = known_numbers(coded, coded.columns).where(" and ".join(f"_x{i} is not null" for i in range(k)))
    size = k + 1

    def first(d: np.ndarray) -> np.ndarray:
        """For each outcome: rows, events, and the sums and squares of the numbers."""
        y, x = d[:, : len(names)], d[:, len(names) :]
        known = ~np.isnan(y)
        return np.concatenate([np.stack([known.sum(0), np.where(known, y, 0).sum(0)]).ravel(), (known.T @ x).ravel(), (known.T @ (x * x)).ravel()])

    got = summed(full, first, 2 * len(names) + 2 * len(names) * k)
    n, events = got[: 2 * len(names)].reshape(2, -1)
    sx, sxx = got[2 * len(names) :].reshape(2, len(names), k)
    rows = []
    able = []
    for i, c in enumerate(names):
        need, need_class = 10 * (k + 1), max(LEAST_CLASS, 5 * k)
        if n[i] < need or min(events[i], n[i] - events[i]) < need_class:
            rows.append((c, levels[c][1], None, *[None] * 7, int(n[i]), int(events[i]), f"n={int(n[i])}, events={int(events[i])}: {need} rows and {need_class} in each class are needed"))
        else:
            able.append(i)
    centre = sx / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(sxx / np.maximum(n, 1)[:, None] - centre**2, 0))
    spread = np.where(spread > 1e-12 * (np.abs(centre) + 1e-300), spread, 0.0)
    share = np.clip(events / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    beta = np.zeros((len(names), size))
    beta[:, 0] = np.log(share / (1 - share))
    null = -2 * (events * np.log(share) + (n - events) * np.log(1 - share))
    last, failed, covariance_of = np.full(len(names), np.inf), set(), {}
    going = [i for i in able if (spread[i] > 0).all()]
    failed |= set(able) - set(going)
    for _ in range(STEPS):
        if not going:
            break
        held = (list(going), beta[going].copy(), centre[going], spread[going])

        def step(d: np.ndarray, held=held) -> np.ndarray:
            out = []
            for i, b, m, s in zip(*held, strict=True):
                y = d[:, i]
                use = ~np.isnan(y)
                x = np.column_stack([np.ones(use.sum()), (d[use, len(names) :] - m) / s])
                at = x @ b
                p = 1 / (1 + np.exp(-np.clip(at, -700, 700)))
                out += [((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (y[use] - p), [2 * (np.logaddexp(0, at) - y[use] * at).sum()]]
            return np.concatenate(out)

        sums = summed(full, step, len(going) * (size * size + size + 1)).reshape(len(going), -1)
        still = []
        for i, own in zip(going, sums, strict=True):
            information, score, deviance = own[: size * size].reshape(size, size), own[size * size : -1], own[-1]
            if not np.isfinite(own).all() or np.linalg.cond(information) > 1e14:
                failed.add(i)
                continue
            covariance_of[i] = np.linalg.inv(information)
            if abs(last[i] - deviance) <= SETTLED * (abs(deviance) + 0.1):
                last[i] = deviance
                continue
            move = covariance_of[i] @ score
            beta[i] += move * min(1.0, 10 / max(np.abs(move).max(), 1e-300))
            last[i] = deviance
            still.append(i)
        going = still
    failed |= set(going)
    fitted = []
    for i in able:
        c = names[i]
        se = np.sqrt(np.maximum(np.diag(covariance_of[i])[1:], 0)) / spread[i] if i in covariance_of and i not in failed else None
        if se is None or not np.isfinite(se).all() or se.max() > SEPARATED:
            rows.append((c, levels[c][1], None, *[None] * 7, int(n[i]), int(events[i]), "separated or not converged"))
            continue
        fitted.append(i)
        b = beta[i, 1:] / spread[i]
        z, r2 = b / np.maximum(se, 1e-300), 1 - last[i] / null[i]
        half = Z975 * se
        for j, x in enumerate(numbers):
            p = 2 * float(norm_sf(np.abs(z[j])))
            rows.append((c, levels[c][1], x, *map(float, (b[j], se[j], np.exp(b[j]), np.exp(b[j] - half[j]), np.exp(b[j] + half[j]), p, r2)), int(n[i]), int(events[i]), None))
    table = spark.createDataFrame(rows, schema)
    parts = [full.where(f"_y{i} is not null").select(F.lit(names[i]).alias("outcome"), F.col(f"_y{i}").alias("y"), sum((F.col(f"_x{j}") * float(beta[i, 1 + j] / spread[i, j]) for j in range(1, k)), F.col("_x0") * float(beta[i, 1] / spread[i, 0])).alias("score")) for i in fitted]
    auc = roc_auc_by(reduce(DataFrame.unionByName, parts), "outcome", "y", "score").select("outcome", "auc") if parts else spark.createDataFrame([], "outcome string, auc double")
    return adjust_p(table.join(auc, "outcome", "left")).orderBy("outcome", "p")


def logistic(df: DataFrame, outcome: str, columns: list[str]) -> DataFrame:
    """predictor, odds_ratio, ci_low, ci_high, p, mcfadden_r2, auc, n of one outcome; no row for too few events or a separated outcome."""
    return logistic_all(df, columns, [outcome]).where("reason is null").select("predictor", "odds_ratio", "ci_low", "ci_high", "p", "mcfadden_r2", "auc", "n")


def interactions_all(df: DataFrame, numbers: list[str], categories: list[str] | tuple = ()) -> DataFrame:
    """y, x, z, n, b (of x times z), p with its corrections, delta_r2, r2: standardised moderation models of every number by every pair of the other numbers and
    of the categories with two levels (the second is 1), each over the rows that know all three.

    One pass adds up, for each pair, the products of (1, x, z, xz) over the rows that also know y, for all y at once as a product of matrices; so many pairs share a pass that
    their sums stay small. Models of under 30 rows, without variation or with collinear terms are left out.
    """
    levels = binary_outcomes(df, list(categories))
    coded = [F.when(F.col(c).cast("string") == b, 1.0).when(F.col(c).isNotNull(), 0.0).alias(f"{c} ({b}=1)") for c, (_, b) in levels.items()]
    names = [*numbers, *[f"{c} ({b}=1)" for c, (_, b) in levels.items()]]
    known = df.select(*[F.col(c).cast("double").alias(c) for c in numbers], *coded)
    known = known.select([F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) for c in names])
    y_count, schema = len(numbers), "y string, x string, z string, n long, b double, p double, delta_r2 double, r2 double"
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if len(names) < 3 or not numbers:
        return adjust_p(df.sparkSession.createDataFrame([], schema))
    c = known.agg(*[f(F.col(f"`{v}`")) for v in names for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = np.array([v or 0.0 for v in c[0::2]]), np.array([v or 1.0 for v in c[1::2]])
    rows = []
    each = 15 * y_count
    for at in range(0, len(pairs), max(1, MODELS_AT_ONCE // y_count)):
        part = pairs[at : at + max(1, MODELS_AT_ONCE // y_count)]

        def mixed(d: np.ndarray, part=part) -> np.ndarray:
            there = ~np.isnan(d)
            scaled = np.where(there, (d - mean) / sd, 0.0)
            y, there_y = scaled[:, :y_count], there[:, :y_count].astype(float)
            squares = y * y
            out = []
            for i, j in part:
                use = there[:, i] & there[:, j]
                x, z = scaled[use, i], scaled[use, j]
                f = np.column_stack([np.ones(len(x)), x, z, x * z])
                products = np.column_stack([f[:, a] * f[:, b] for a in range(4) for b in range(a, 4)])
                out += [(products.T @ there_y[use]).ravel(), (f.T @ y[use]).ravel(), squares[use].sum(0)]
            return np.concatenate(out)

        for (i, j), own in zip(part, summed(known, mixed, each * len(part)).reshape(len(part), -1), strict=True):
            gram, fy, yy = own[: 10 * y_count].reshape(10, y_count), own[10 * y_count : 14 * y_count].reshape(4, y_count), own[14 * y_count :]
            for t in range(y_count):
                if t not in (i, j) and (found := _moderated(gram[:, t], fy[:, t], yy[t])):
                    rows.append((numbers[t], names[i], names[j], *found))
    return adjust_p(df.sparkSession.createDataFrame(rows, schema)).orderBy("p", "y", "x", "z")


def _moderated(gram: np.ndarray, fy: np.ndarray, yy: float) -> tuple | None:
    """n, b, p, delta_r2 and r2 of y on x, z and xz from the sums of their products."""
    g = np.zeros((5, 5))
    g[:4, :4][np.triu_indices(4)] = gram
    g[:4, :4] += np.triu(g[:4, :4], 1).T
    g[:4, 4] = g[4, :4] = fy
    g[4, 4] = yy
    n = int(round(g[0, 0]))
    if n < LEAST_MODERATED:
        return None
    cov = (g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n) / (n - 1)
    full, less, xy = cov[:3, :3], cov[:2, :2], cov[:3, 3]
    scale = np.sqrt(np.maximum(np.diag(full), 1e-300))
    if min(np.diag(cov)) <= 1e-12 or np.linalg.cond(full / np.outer(scale, scale)) > 1e12:
        return None
    b = np.linalg.solve(full, xy)
    r2, r2_less = b @ xy / cov[3, 3], np.linalg.solve(less, xy[:2]) @ xy[:2] / cov[3, 3]
    se = np.sqrt(max(cov[3, 3] * (1 - r2) * (n - 1) / (n - 4) * np.linalg.inv(full)[2, 2] / (n - 1), 0.0))
    # other centres change no product term's test, and other scales only its unit
    unit = np.sqrt(cov[0, 0] * cov[1, 1] / cov[3, 3])
    return n, float(b[2] * unit), float(t_sf2(b[2] / max(se, 1e-100), n - 4)), float(r2 - r2_less), float(r2)


def interactions(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """The models of ``interactions_all`` for one dependent number."""
    names = [y, *[c for c in columns if c != y]]
    return interactions_all(df, names).where(F.col("y") == y).select("y", "x", "z", "n", "b", "p", "delta_r2", "r2")


def roc_all(df: DataFrame, numbers: list[str], outcomes: list[str]) -> DataFrame:
    """outcome, event, marker, n1, n0, auc (folded), direction, ci_low, ci_high, label, cutoff, sensitivity, specificity, p (Mann-Whitney) with its corrections, reason, by falling auc.

    All outcomes with two levels by all numbers, in shared passes over counts by value. Classes of under five rows and constant markers have a reason instead.
    """
    spark = df.sparkSession
    levels = binary_outcomes(df, outcomes)
    if not levels or not numbers:
        return spark.createDataFrame([], "outcome string, event string, marker string, auc double, p double, reason string")
    events = spark.createDataFrame([(c, a, b) for c, (a, b) in levels.items()], "category string, _none string, event string")
    keys = ["category", "number"]
    long = groups.pairs_long(df, list(levels), numbers)
    cells = long.join(events, "category").groupBy(*keys, "event", "value").agg(F.count_if(F.col("grp") == F.col("event")).alias("ones"), F.count_if(F.col("grp") != F.col("event")).alias("zeros"))
    size = cells.groupBy(*keys, "event").agg(F.sum("ones").alias("n1"), F.sum("zeros").alias("n0"), (F.min("value") < F.max("value")).alias("varies"))
    u = groups.mann_whitney_p(groups.rank_sums(long)).select(*keys, "u", "p")
    planned = spark.createDataFrame([(c, x) for c in levels for x in numbers], "category string, number string").join(events.select("category", F.col("event").alias("_event")), "category")
    t = planned.join(size, keys, "left").join(u, keys, "left")
    n1, n0 = F.coalesce("n1", F.lit(0)).cast("double"), F.coalesce("n0", F.lit(0)).cast("double")
    reason = F.when(F.least(n1, n0) < LEAST_CLASS, F.concat(F.lit("class sizes "), n1.cast("long").cast("string"), F.lit(" and "), n0.cast("long").cast("string"))).when(~F.col("varies"), "constant marker")
    raw = 1 - F.col("u") / (n1 * n0)  # u counts for the first level, the event is the second
    t = t.withColumns({"reason": reason, "raw": F.when(reason.isNull(), raw)}).withColumn("auc", F.greatest("raw", 1 - F.col("raw")))
    a = F.col("auc")
    se = F.sqrt((a * (1 - a) + (n1 - 1) * (a / (2 - a) - a**2) + (n0 - 1) * (2 * a**2 / (1 + a) - a**2)) / (n1 * n0))
    best = _youden_by(cells.join(t.where("reason is null").select(*keys, F.when(F.col("raw") >= 0.5, 1.0).otherwise(-1.0).alias("sign")), keys))
    found = t.join(best, keys, "left").select(
        F.col("category").alias("outcome"), F.col("_event").alias("event"), F.col("number").alias("marker"), n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "auc", F.when(F.col("raw") >= 0.5, "higher").when(F.col("raw") < 0.5, "lower").alias("direction"),
        F.greatest(F.lit(0.0), a - 1.96 * se).alias("ci_low"), F.when(a.isNotNull(), F.least(F.lit(1.0), a + 1.96 * se)).alias("ci_high"), F.when(a.isNotNull(), label_auc(a)).alias("label"),
        "cutoff", "sensitivity", "specificity", F.when(F.col("reason").isNull(), F.col("p")).alias("p"), "reason",
    ).withColumn("ci_low", F.when(F.col("auc").isNotNull(), F.col("ci_low")))
    return adjust_p(found).orderBy(F.desc_nulls_last("auc"), "outcome", "marker")


def _youden_by(cells: DataFrame, buckets: int = 64) -> DataFrame:
    """category, number, cutoff, sensitivity, specificity: the largest difference of the rates of each marker, read in the direction of its sign; the first of equals."""
    keys = ["category", "number"]
    signed = cells.withColumn("s", F.col("sign") * F.col("value"))
    cuts = signed.groupBy(*keys).agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)]).alias("_cuts"))
    placed = signed.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("s")))).drop("_cuts")
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_b").agg(F.sum("ones").alias("o"), F.sum("zeros").alias("z"))
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("o").over(above), F.lit(0)).alias("o0"), F.coalesce(F.sum("z").over(above), F.lit(0)).alias("z0"), F.sum("o").over(whole).alias("n1"), F.sum("z").over(whole).alias("n0"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("s"))
    rates = placed.withColumns({"o": F.sum("ones").over(inside), "z": F.sum("zeros").over(inside)}).join(offsets, [*keys, "_b"])
    tpr, fpr = (F.col("o0") + F.col("o")) / F.col("n1"), (F.col("z0") + F.col("z")) / F.col("n0")
    best = rates.groupBy(*keys).agg(F.max(F.struct(F.round(tpr - fpr, 12).alias("j"), "s", tpr.alias("tpr"), fpr.alias("fpr"), "sign")).alias("m"))
    return best.select(*keys, (F.col("m.s") * F.col("m.sign")).alias("cutoff"), F.col("m.tpr").alias("sensitivity"), (1 - F.col("m.fpr")).alias("specificity"))


def label_auc(a: Column) -> Column:
    return F.when(a < 0.6, "none").when(a < 0.7, "poor").when(a < 0.8, "acceptable").when(a < 0.9, "good").otherwise("excellent")
