"""Choosing tests by rules, and saying their results in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import recommend

MOST_TESTS, LEAST_PAIRS, LEAST_CELLS, MOST_LEVELS, PREDICTORS = 40, 5, 10, 10, 5
FAMILIES = ["group", "correlation", "association", "regression"]


def plan_tests(kinds: DataFrame, groups: DataFrame, pairs: DataFrame, tables: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """family, dv, iv, test, extra, rationale, number, candidates: the first ``most`` tests by family and the places of their columns, out of ``candidates``.

    Inputs have a row per variable or pair: ``kinds`` (variable, kind, role, and place, else variables go by name), ``groups`` (number, category, k, normal, levene_p), ``pairs``
    (a, b, n, a_normal, b_normal, on the rows that know both) and ``tables`` (a, b, n, n_rows, n_columns, least_expected). Variables with the role exclude take no
    part; a role dv asks for a regression. Correlations take five rows, tables ten and two to ten levels.
    """
    place = F.col("place") if "place" in kinds.columns else F.col("variable")
    active = kinds.where("role <> 'exclude'").select("variable", "kind", "role", place.alias("place"))
    measured = active.where(F.col("kind").isin("continuous", "ordinal"))
    levels = active.where(F.col("kind").isin("binary", "nominal"))
    side = lambda df, name: df.select(F.col("variable").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("place").alias(f"{name}_at"))
    other = {"a": "b", "b": "a", "a_normal": "b_normal", "b_normal": "a_normal"}
    either = lambda df: df.unionByName(df.select(*[F.col(other.get(c, c)).alias(c) for c in df.columns]))
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))

    g = side(measured, "dv").crossJoin(F.broadcast(side(levels, "iv")))  # both sides have a row per variable
    g = g.join(groups.select(F.col("number").alias("dv"), F.col("category").alias("iv"), "k", F.col("normal").alias("_normal"), "levene_p"), ["dv", "iv"]).where("k >= 2")
    test = recommend(F.col("k"), F.col("_normal") & (F.col("dv_kind") == "continuous"), F.col("levene_p") > 0.05, welch_for_many=False)
    cause = (
        F.when(F.col("dv_kind") == "ordinal", " is ordinal").when(~F.col("_normal"), " isn't normal in at least one group")
        .when(F.col("levene_p") > 0.05, " is normal in every group, with equal variances").otherwise(" is normal in every group, but the variances differ")
    )
    group = g.select(F.lit("group").alias("family"), "dv", "iv", test.alias("test"), F.concat(quoted("dv"), cause).alias("rationale"), F.col("iv_at").alias("_one"), F.col("dv_at").alias("_two"))

    pair = lambda df: side(df, "dv").join(side(df, "iv"), (F.col("dv_at") < F.col("iv_at")) | (F.col("dv_at") == F.col("iv_at")) & (F.col("dv") < F.col("iv")))
    c = pair(measured).join(either(pairs).select(F.col("a").alias("dv"), F.col("b").alias("iv"), "n", "a_normal", "b_normal"), ["dv", "iv"]).where(F.col("n") >= LEAST_PAIRS)
    scale = (F.col("dv_kind") == "continuous") & (F.col("iv_kind") == "continuous")
    both = scale & F.coalesce(F.col("a_normal") & F.col("b_normal"), F.lit(False))
    cause = F.when(both, "both are normal on their common rows").when(scale, "not both are normal on their common rows").otherwise("at least one is ordinal")
    correlation = c.select(F.lit("correlation").alias("family"), "dv", "iv", F.when(both, "pearson").otherwise("spearman").alias("test"), cause.alias("rationale"), F.col("dv_at").alias("_one"), F.col("iv_at").alias("_two"))

    t = pair(levels).join(either(tables).select(F.col("a").alias("dv"), F.col("b").alias("iv"), "n", "n_rows", "n_columns", "least_expected"), ["dv", "iv"])
    t = t.where((F.col("n") >= LEAST_CELLS) & F.col("n_rows").between(2, MOST_LEVELS) & F.col("n_columns").between(2, MOST_LEVELS))
    exact = (F.col("n_rows") == 2) & (F.col("n_columns") == 2) & (F.col("least_expected") < 5)
    cause = F.when(exact, "an expected count of the 2x2 table is below 5").when(F.col("least_expected") < 5, "some expected counts are below 5: read with care").otherwise("all expected counts are 5 or more")
    association = t.select(F.lit("association").alias("family"), "dv", "iv", F.when(exact, "fisher").otherwise("chi_square").alias("test"), cause.alias("rationale"), F.col("dv_at").alias("_one"), F.col("iv_at").alias("_two"))

    marked = active.where("kind = 'continuous' and role = 'dv'").select(F.col("variable").alias("dv"), F.col("place").alias("_one"))
    names = active.where("kind = 'continuous'").agg(F.array_sort(F.collect_list(F.struct("place", "variable"))).alias("_all"))  # a name per column
    extra = F.slice(F.filter(F.transform("_all", lambda v: v["variable"]), lambda v: v != F.col("dv")), 1, PREDICTORS)
    regression = marked.crossJoin(F.broadcast(names)).select(
        F.lit("regression").alias("family"), "dv", F.lit(None).cast("string").alias("iv"), F.lit("linear_regression").alias("test"), extra.alias("extra"),
        F.concat(quoted("dv"), F.lit(" is marked as dependent")).alias("rationale"), "_one", F.col("_one").alias("_two"),
    ).where(F.size("extra") >= 2)

    plans = group.unionByName(correlation).unionByName(association).unionByName(regression, allowMissingColumns=True)
    family = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    order = Window.orderBy(family, "_one", "_two", "dv", "iv")  # a row per candidate test
    numbered = plans.withColumns({"number": F.row_number().over(order), "candidates": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return numbered.where(F.col("number") <= most).drop("_one", "_two")


def plan_notes(plans: DataFrame) -> DataFrame:
    """note: that only the first tests of all possible ones are run, or that there is none."""
    n = plans.agg(F.count("*").alias("n"), F.max("candidates").alias("all"))
    cut = F.when(F.col("all") > F.col("n"), F.format_string("the first %d of %d possible tests are run", F.col("n"), F.col("all")))
    return n.select(F.when(F.col("n") == 0, "no pair of variables suits a test").otherwise(cut).alias("note")).where("note is not null")


def plan_table(df: DataFrame, kinds: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """The plan of a table whose variables have kinds and roles: normality and spread by group, normality on the common rows of pairs, and cross tables are looked up for all at once.

    Names of columns reach the driver.
    """
    from . import cube
    from .describe import as_number
    from .groups import LEAST_GROUP, levene, p_f, pairs_long
    from .normality import balanced_normality

    spark, at = df.sparkSession, {c: i for i, c in enumerate(df.columns)}
    own = [r for r in kinds.where("role <> 'exclude'").collect() if r["variable"] in at]  # a row per column
    numbers, levels = ([r["variable"] for r in own if r["kind"] in of] for of in (("continuous", "ordinal"), ("binary", "nominal")))
    placed = kinds.drop("place").join(spark.createDataFrame(list(at.items()), "variable string, place int"), "variable")
    checks = spark.createDataFrame([], "number string, category string, k long, normal boolean, levene_p double")
    if numbers and levels:
        long = pairs_long(df, levels, numbers)
        spread = levene(long).select("number", "category", "k", p_f(F.col("levene"), F.col("df1"), F.col("df2")).alias("levene_p"))
        each = balanced_normality(long, ["category", "number", "grp"]).where(F.col("n") >= LEAST_GROUP)
        checks = spread.join(each.groupBy("number", "category").agg(F.every("normal").alias("normal")), ["number", "category"])
    pairs = spark.createDataFrame([], "a string, b string, n long, a_normal boolean, b_normal boolean")
    if len(numbers) > 1:
        both = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
        rows = df.select([as_number(df, c).alias(c) for c in numbers]).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in both])).alias("p")).select("p.*")
        known = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
        shape = balanced_normality(known.unpivot(["a", "b"], ["x", "y"], "side", "value"), ["a", "b", "side"])
        one = lambda s: F.max(F.when(F.col("side") == s, F.col("normal")))
        pairs = shape.groupBy("a", "b").agg(F.max("n").alias("n"), one("x").alias("a_normal"), one("y").alias("b_normal"))
    tables = cube.association_pairs(df, levels).where("reason is null") if len(levels) > 1 else spark.createDataFrame([], "a string, b string, n long, n_rows long, n_columns long, least_expected double")
    return plan_tests(placed, checks, pairs, tables.select("a", "b", "n", "n_rows", "n_columns", "least_expected"), most)


def plan_issues(plans: DataFrame, results: DataFrame) -> DataFrame:
    """severity, message: no plan, or no result with a p from 0 to 1, blocks; a plan without a result warns."""
    n = plans.agg(F.count("*").alias("planned"))
    ok = results.agg(F.count_if(F.col("p").between(0, 1)).alias("valid"), F.count_if(F.col("p").isNotNull() & ~F.col("p").between(0, 1)).alias("wrong"), F.count_if(F.col("p").isNull()).alias("failed"))
    say = lambda when, severity, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    found = F.array_compact(F.array(
        say(F.col("planned") == 0, "block", "no test could be planned"), say((F.col("planned") > 0) & (F.col("valid") == 0), "block", "no test gave a valid p"),
        say(F.col("wrong") > 0, "block", "a p lies outside 0 to 1"), say(F.col("failed") > 0, "warn", "some tests failed"),
    ))
    return n.crossJoin(ok).select(F.inline(found))


def format_p(p: Column) -> Column:
    """p < .001, or three decimals without the leading zero."""
    return F.when(p.isNull(), "p = ?").when(p < 0.001, "p < .001").otherwise(F.concat(F.lit("p = "), F.replace(F.format_string("%.3f", p), F.lit("0."), F.lit("."))))


def format_statistic(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), "?").otherwise(F.format_string(f"%.{digits}f", x))


def format_df(df: Column) -> Column:
    """One or two degrees of freedom of an array: whole numbers bare, others with one decimal."""
    one = lambda d: F.when(d % 1 == 0, d.cast("long").cast("string")).otherwise(F.format_string("%.1f", d))
    return F.array_join(F.transform(df, one), ", ")


#: Fixed letters of the statistics and wording of the sentences.
LETTERS = {"student_t": "t", "welch_t": "t", "mann_whitney": "U", "anova": "F", "kruskal_wallis": "H", "chi_square": "χ²", "fisher": "OR", "pearson": "r", "spearman": "ρ", "linear_regression": "F"}


def result_sentence(findings: DataFrame, lang: str = "en") -> DataFrame:
    """findings (family, test, dv, iv, statistic, df, p, p_adjusted, effect, effect_name, r2, significant) with a sentence."""
    letters = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    c, sig = F.col, F.coalesce(F.col("significant"), F.lit(False))
    adjusted = F.replace(format_p(c("p_adjusted")), F.lit("p"), F.lit("p-düz" if lang == "tr" else "p-adj"))
    detail = F.concat(
        F.coalesce(F.try_element_at(letters, c("test")), F.lit("stat")), F.when(c("df").isNotNull(), F.concat(F.lit("("), format_df(c("df")), F.lit(")"))).otherwise(""), F.lit(" = "), format_statistic(c("statistic")), F.lit(", "), format_p(c("p")),
        F.when(c("p_adjusted").isNotNull() & (c("p_adjusted") != c("p")), F.concat(F.lit(", "), adjusted)).otherwise(""),
        F.when(c("effect").isNotNull() & (c("effect_name") != ""), F.concat(F.lit(", "), c("effect_name"), F.lit(" = "), format_statistic(c("effect")))).otherwise(""),
    )
    fit = F.when(c("r2").isNotNull(), F.concat(F.lit(", R² = "), format_statistic(c("r2")))).otherwise("")
    up, group, correlation, association = c("statistic") > 0, c("family") == "group", c("family") == "correlation", c("family") == "association"
    say = lambda text, what: F.concat(F.format_string(text, *what), F.lit(" ("), detail, F.lit(")."))
    iv = F.coalesce("iv", F.lit(""))
    if lang == "tr":
        verb = F.when(sig, "anlamlı bir fark göstermiştir").otherwise("anlamlı bir fark göstermemiştir")
        link = F.when(sig, F.concat(F.when(up, "pozitif yönde ").otherwise("negatif yönde "), F.lit("anlamlı bir ilişki"))).otherwise("anlamlı olmayan bir ilişki")
        found = F.when(sig, "anlamlı bir ilişki bulunmuştur").otherwise("anlamlı bir ilişki bulunmamıştır")
        model = F.concat(F.format_string("'%s' için kurulan regresyon modeli %s (", c("dv"), F.when(sig, "anlamlıdır").otherwise("anlamlı değildir")), detail, fit, F.lit(")."))
        text = (
            F.when(group, say("'%s', '%s' gruplarına göre %s", (c("dv"), iv, verb))).when(correlation, say("'%s' ile '%s' arasında %s bulunmuştur", (c("dv"), iv, link)))
            .when(association, say("'%s' ile '%s' arasında %s", (c("dv"), iv, found))).otherwise(model)
        )
    else:
        verb = F.when(sig, "differed significantly").otherwise("did not differ significantly")
        link = F.when(sig, F.when(up, "A significant positive correlation").otherwise("A significant negative correlation")).otherwise("No significant correlation")
        found = F.when(sig, "A significant association").otherwise("No significant association")
        model = F.concat(F.format_string("The regression model for '%s' %s (", c("dv"), F.when(sig, "was significant").otherwise("was not significant")), detail, fit, F.lit(")."))
        text = (
            F.when(group, say("'%s' %s across '%s' groups", (c("dv"), verb, iv))).when(correlation, say("%s was found between '%s' and '%s'", (link, c("dv"), iv)))
            .when(association, say("%s was found between '%s' and '%s'", (found, c("dv"), iv))).otherwise(model)
        )
    return findings.withColumn("sentence", text)
