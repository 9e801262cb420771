"""How well each column is predicted by all others, and risk models of all outcomes: boosted trees whose targets and folds grow together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .boosting import Coding, Target
from .regress import roc_auc_by

#: Fixed limits of the layer.
LEAST_ROWS, LEAST_VALUES, LEAST_LEVEL, PREDICTABLE, FOLDS, ROUNDS, REPEATS = 25, 5, 5, 0.15, 5, 80, 3
LEAST_CLASS, LEAST_AUC, TOP_RISKS, TOP = 10, 0.7, 10, 5

SCORES = "target string, kind string, n long, score double, baseline double, gain double, predictable boolean, top array<struct<variable:string,importance:double>>, reason string"
MODELS = "outcome string, risky string, n long, n_risky long, top array<struct<variable:string,importance:double>>, by_gain array<string>"


def _strongest(names: list[str], values) -> list[tuple[str, float]]:
    """Up to five features with a positive importance, the largest first."""
    return [(c, float(v)) for c, v in sorted(zip(names, values, strict=True), key=lambda p: (-p[1], p[0])) if v > 0][:TOP]


def _batches(coding: Coding, targets: list[Target], folds: int) -> list[list[Target]]:
    """Targets whose histograms fit one job together."""
    each = 3 * (folds + 1) * (1 << (boosting.DEPTH - 1)) * len(coding.features) * boosting.BINS
    out, size = [], boosting.AT_ONCE
    for t in targets:
        if size + each * t.outputs > boosting.AT_ONCE:
            out.append([])
            size = 0
        out[-1].append(t)
        size += each * t.outputs
    return out


def predictability(df: DataFrame, key: str, numbers: list[str], categories: list[str] | tuple = (), targets: list[str] | None = None, rounds: int = ROUNDS, folds: int = FOLDS, repeats: int = REPEATS) -> DataFrame:
    """target, kind, n, score (the mean of R2 or accuracy over folds of unseen rows), baseline (0, or the share of the most frequent level), gain,
    predictable, top (what permuting a feature costs the model of all rows), reason (why a target was left out, else null).

    Missing numbers take the median and missing levels the median place. All targets are tried; those that share a job are as many as
    ``boosting.AT_ONCE`` allows. A row per target reaches the driver. Defined cases: targets with under 25 known rows, numbers with under 5 values,
    categories with under 2 levels, a level of under 5 rows or too many levels, and tables with under 3 columns are left out with their reason.
    """
    spark = df.sparkSession
    numbers, categories = list(numbers), list(categories)
    coding = boosting.learn_coding(df, numbers, categories)
    wanted = [c for c in (targets or [*numbers, *categories])]
    clean = boosting.clean_numbers(df)
    asked = [c for c in wanted if c in coding.edges]
    stats = clean.agg(F.lit(0).alias("_"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(asked)], *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(asked)]).first()
    n = {c: stats[f"n{i}"] for i, c in enumerate(asked)} | {c: sum(own.values()) for c, own in coding.counts.items()}
    found, rows = [], []
    for c in wanted:
        own = coding.counts.get(c, {})
        reason = (
            "no values, or too many levels" if c not in coding.features
            else "fewer than two other columns" if len([x for x in coding.features if x != c]) < 2
            else f"fewer than {LEAST_ROWS} rows" if n[c] < LEAST_ROWS
            else f"fewer than {LEAST_VALUES} values" if c in coding.edges and stats[f"d{asked.index(c)}"] < LEAST_VALUES
            else "one level" if own and len(own) < 2
            else f"a level with fewer than {LEAST_LEVEL} rows" if own and min(own.values()) < LEAST_LEVEL else None
        )
        if reason:
            rows.append((c, "regression" if c in numbers else "classification", n.get(c, 0), None, None, None, None, None, reason))
        else:
            found.append(Target(c, sorted(own)))
    for batch in _batches(coding, found, folds):
        blocks = boosting.packed(df, key, coding, batch, folds)
        blocks, forest = boosting.fit(blocks, coding, batch, folds, rounds, margins=False)
        scores = boosting.fold_scores(blocks, forest, folds)
        lost = boosting.permutation_importance(blocks, coding, forest, scores[:, -1], repeats)
        for t, own, importance in zip(batch, scores, lost, strict=True):
            score = float(own[:folds].mean())
            base = max(coding.counts[t.name].values()) / n[t.name] if t.levels else 0.0
            rows.append((t.name, "classification" if t.levels else "regression", n[t.name], score, base, score - base, score - base >= PREDICTABLE, _strongest(coding.features, importance), None))
    return spark.createDataFrame(rows, SCORES)


def risk(df: DataFrame, key: str, outcomes: list[str], numbers: list[str], categories: list[str] | tuple = (), rounds: int = ROUNDS, folds: int = FOLDS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold risks (key, outcome, fold, actual, risk) of every row with a known outcome, and a row per outcome: outcome, risky (its rarer level), n, n_risky,
    auc, strength, top (by permutation), by_gain (by what splits on a feature gained).

    All outcomes with exactly two levels of ten rows or more are modelled in one go, each from all numbers, categories and other outcomes;
    folds are dealt within each level, so their counts differ by one at most. Of equal levels the first in order is the risky one.
    """
    spark = df.sparkSession
    categories = list(dict.fromkeys([*categories, *outcomes]))
    coding = boosting.learn_coding(df, list(numbers), categories)
    targets = []
    for c in outcomes:
        own = coding.counts.get(c, {})
        if len(own) == 2 and min(own.values()) >= LEAST_CLASS and len([x for x in coding.features if x != c]) >= 2:
            rare = min(own, key=lambda x: (own[x], x))
            targets.append(Target(c, [next(x for x in own if x != rare), rare]))
    key_type = df.schema[key].dataType
    scores, rows = None, []
    for batch in _batches(coding, targets, folds):
        blocks, forest = boosting.fit(boosting.packed(df, key, coding, batch, folds), coding, batch, folds, rounds)
        own = boosting.out_of_fold(blocks, forest, key, key_type)
        scores = own if scores is None else scores.unionByName(own)
        lost = boosting.permutation_importance(blocks, coding, forest, boosting.fold_scores(blocks, forest, folds)[:, -1], repeats)
        last = {i: s for s, (i, m, _) in enumerate(forest.outputs()) if m == folds}
        for i, t in enumerate(batch):
            counts = coding.counts[t.name]
            rows.append((t.name, t.levels[1], sum(counts.values()), counts[t.levels[1]], _strongest(coding.features, lost[i]), [c for c, _ in _strongest(coding.features, forest.gains[last[i]])]))
    if scores is None:
        scores = df.where("false").select(key, F.lit("").alias("target"), F.lit(0).alias("fold"), F.lit(0).alias("actual"), F.lit(0.0).alias("risk"))
    scores = scores.withColumnRenamed("target", "outcome")
    auc = roc_auc_by(scores, "outcome", "actual", "risk")
    models = spark.createDataFrame(rows, MODELS).join(auc.select("outcome", "auc"), "outcome", "left")
    a = F.col("auc")
    strength = F.when(a >= 0.9, "excellent").when(a >= 0.8, "good").when(a >= LEAST_AUC, "fair").otherwise("weak")
    return scores, models.select("outcome", "risky", "n", "n_risky", "auc", strength.alias("strength"), "top", "by_gain")


def riskiest(scores: DataFrame, models: DataFrame, key: str, most: int = TOP_RISKS) -> DataFrame:
    """outcome, rank, key, risk, actual: a report of the ten riskiest rows of each model with an AUC of 0.7 or more."""
    order = Window.partitionBy("outcome").orderBy(F.desc("risk"), key)
    top = scores.join(models.where(F.col("auc") >= LEAST_AUC).select("outcome", "risky"), "outcome").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("outcome", "risky", "rank", key, "risk", "actual")
