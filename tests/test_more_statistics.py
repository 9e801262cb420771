"""Normality, exact rank tests, typing, discovery, planning and records, against known values and brute force."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import discovery, groups, kinds, neighbours, normality, paired, planning, records, report
from statloom.sources import bibliography


def test_shapiro_wilk_on_a_published_sample():
    # the weights example of Shapiro and Wilk (1965)
    w, p = normality.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    rng = np.random.default_rng(1)
    share = np.mean([normality.shapiro(rng.normal(size=40))[1] < 0.05 for _ in range(600)])
    assert 0.025 < share < 0.08
    assert normality.shapiro(np.exp(rng.normal(0, 1.5, 200)))[1] < 1e-6


def test_distribution_tests_equal_the_plain_formulas(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(5, 2, 300), 1)  # with ties
    row = normality.distribution_tests(spark.createDataFrame([("v", float(v)) for v in x], "variable string, value double"), ["variable"]).first()
    z, n = np.sort((x - x.mean()) / x.std(ddof=1)), len(x)
    below = 1 - special.norm_sf(z)
    i = np.arange(1, n + 1)
    assert row["lilliefors_d"] == pytest.approx(max((i / n - below).max(), (below - (i - 1) / n).max()), abs=1e-9)
    assert row["anderson_a2"] == pytest.approx(-n - ((2 * i - 1) * (np.log(below) + np.log(1 - below[::-1]))).sum() / n, abs=1e-8)
    assert 0 < row["lilliefors_p"] <= 1 and 0 < row["anderson_p"] <= 1


def test_normality_of_tiny_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (1.0, 3.0)], "a double, b double")
    assert normality.normality(df, ["a", "b"]).count() == 0


def test_studentised_range_has_the_tabled_quantiles():
    assert special.tukey_sf(3.877, 3, 10)[()] == pytest.approx(0.05, abs=3e-4)
    assert special.tukey_sf(4.232, 5, 20)[()] == pytest.approx(0.05, abs=3e-4)
    assert special.tukey_sf(3.314, 3, 1e6)[()] == pytest.approx(0.05, abs=3e-4)
    # two means: the range is a t statistic times the root of two
    assert special.tukey_sf(2.228138852 * math.sqrt(2), 2, 10)[()] == pytest.approx(0.05, abs=1e-6)


def test_exact_rank_tests_count_all_arrangements():
    n1, n2 = 4, 6
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in (0, 3, 8, 12):
        assert special.mann_whitney_exact(n1, n2, u) == pytest.approx(min(1, 2 * np.mean(np.array(us) <= min(u, n1 * n2 - u))))
    ws = np.array([sum(i + 1 for i in range(7) if m >> i & 1) for m in range(1 << 7)])
    for w in (0, 4, 9):
        assert special.wilcoxon_exact(7, w) == pytest.approx(min(1, 2 * np.mean(ws <= w)))


def test_small_groups_are_tested_exactly(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.5), ("b", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    long = groups.pairs_long(df, ["g"], ["x"])
    whole = groups.mann_whitney_p(groups.rank_sums(long)).first()
    pair = groups.pairwise_mann_whitney(long).first()
    assert whole["u"] == pair["u"] == 0 and whole["p"] == pytest.approx(2 / 35) and pair["p"] == pytest.approx(2 / 35)
    w = paired.wilcoxon_p(paired.wilcoxon(spark.createDataFrame([(float(i + i * i), float(i)) for i in range(1, 7)], "a double, b double"), "a", "b")).first()
    assert w["p"] == pytest.approx(2 / 64)


def test_seven_kinds_with_hints_and_overrides(spark):
    rows = [(i, float(i % 5 + 1), "ab"[i % 2], float(i) * 1.5, i % 4, str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, likert double, sex string, score double, code long, name string").withColumn("day", F.lit("2020-01-01").cast("date"))
    measures = spark.createDataFrame([("code", "nominal")], "variable string, measure string")
    got = {r["variable"]: r["kind"] for r in kinds.infer_kinds(df, measures).collect()}
    assert got == {"id": "id", "likert": "ordinal", "sex": "binary", "score": "continuous", "code": "nominal", "name": "id", "day": "date"}
    labels = spark.createDataFrame([("likert", "1", "x"), ("likert", "3", "y")], "variable string, value string, label string")
    assert {r["variable"]: r["kind"] for r in kinds.infer_kinds(df, None, labels).collect()}["likert"] == "nominal"
    over = spark.createDataFrame([("score", "ordinal", "dv"), ("sex", "nonsense", "nobody")], "variable string, kind string, role string")
    changed = {r["variable"]: (r["kind"], r["role"]) for r in kinds.override_kinds(kinds.infer_kinds(df), over).collect()}
    assert changed["score"] == ("ordinal", "dv") and changed["sex"] == ("binary", "auto")
    coded, names = kinds.code_binary(df, ["sex"])
    assert names == {"sex": "sex (b=1)"} and coded.agg(F.sum("sex (b=1)")).first()[0] == 20


def test_mutual_information_finds_the_bend(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 2, 2000)
    df = spark.createDataFrame([(float(a), float(a * a + e), float(z)) for a, e, z in zip(x, rng.normal(0, 0.4, 2000), rng.normal(size=2000), strict=True)], "x double, u double, z double")
    found = discovery.nonlinear_finds(neighbours.mutual_information(df, ["x", "u", "z"])).collect()
    assert [(r["a"], r["b"]) for r in found] == [("x", "u")]


def test_planted_outlier_is_the_first_anomaly(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    scored = discovery.anomalies(df, "k", ["a", "b"], trees=30)
    top = discovery.top_anomalies(scored, "k", ["a", "b"]).collect()
    assert top[0]["k"] == 999 and len(top) == 25 and len(top[0]["reasons"]) == 2
    assert discovery.anomalies(df.where("k < 0"), "k", ["a", "b"], trees=3).count() == 0


def test_plan_follows_the_rules(spark):
    types = spark.createDataFrame([("y", "continuous", "dv"), ("x", "continuous", "auto"), ("z", "continuous", "auto"), ("g", "nominal", "auto"), ("h", "binary", "auto"), ("q", "continuous", "exclude"), ("few", "ordinal", "auto")], "variable string, kind string, role string")
    checks = spark.createDataFrame([("y", "g", 3, True, 0.01), ("y", "h", 2, True, 0.01), ("x", "h", 2, False, 0.5)], "number string, category string, k long, normal boolean, levene_p double")
    pairs = spark.createDataFrame([("x", "y", 9, True, True), ("z", "x", 9, False, True), ("y", "z", 5, True, False), ("x", "few", 4, True, True)], "a string, b string, n long, a_normal boolean, b_normal boolean")
    tables = spark.createDataFrame([("g", "h", 50, 3, 2, 6.0)], "a string, b string, n long, n_rows long, n_columns long, least_expected double")
    plan = planning.plan_tests(types, checks, pairs, tables)
    got = [(r["family"], r["dv"], r["iv"], r["test"]) for r in plan.orderBy("number").collect()]
    assert got == [
        ("group", "y", "g", "kruskal_wallis"), ("group", "x", "h", "mann_whitney"), ("group", "y", "h", "welch_t"),
        ("correlation", "x", "y", "pearson"), ("correlation", "x", "z", "spearman"), ("correlation", "y", "z", "spearman"),
        ("association", "g", "h", "chi_square"), ("regression", "y", None, "linear_regression"),
    ]
    assert all(r["rationale"] for r in plan.collect()) and planning.plan_notes(plan).count() == 0
    cut = planning.plan_tests(types, checks, pairs, tables, most=3)
    assert [r["note"] for r in planning.plan_notes(cut).collect()] == ["the first 3 of 8 possible tests are run"]
    # places, not names, order the tests; a measured variable may be marked iv and a category dv
    marked = types.withColumn("role", types["role"].substr(1, 0)).withColumn("place", (types["variable"] != "h").cast("int"))
    first = planning.plan_tests(marked.replace("", "iv", ["role"]), checks, pairs, tables).orderBy("number").first()
    assert (first["dv"], first["iv"]) == ("x", "h")
    none = spark.createDataFrame([], "p double")
    assert [r["severity"] for r in planning.plan_issues(plan, none).collect()] == ["block"]


def test_sentences(spark):
    schema = "family string, test string, dv string, iv string, statistic double, df array<double>, p double, p_adjusted double, effect double, effect_name string, r2 double, significant boolean"
    rows = [("group", "welch_t", "score", "sex", 2.5, [37.25], 0.0171, 0.0342, 0.8, "d", None, True), ("correlation", "spearman", "a", "b", -0.4, [58.0], 0.0002, None, None, None, None, True), ("regression", "linear_regression", "y", None, 5.0, [2.0, 97.0], 0.2, None, None, None, 0.09, False)]
    en, tr = ([r["sentence"] for r in planning.result_sentence(spark.createDataFrame(rows, schema), lang).collect()] for lang in ("en", "tr"))
    assert en[0] == "'score' differed significantly across 'sex' groups (t(37.2) = 2.50, p = .017, p-adj = .034, d = 0.80)." or "37.3" in en[0]
    assert en[1] == "A significant negative correlation was found between 'a' and 'b' (ρ(58) = -0.40, p < .001)."
    assert en[2] == "The regression model for 'y' was not significant (F(2, 97) = 5.00, p = .200, R² = 0.09)."
    assert tr[1] == "'a' ile 'b' arasında negatif yönde anlamlı bir ilişki bulunmuştur (ρ(58) = -0.40, p < .001)."


def test_records_of_three_services(spark):
    work = {"display_name": "T", "doi": "https://doi.org/10.1/A", "publication_year": 2020, "biblio": {"first_page": "1", "last_page": "9"}, "authorships": [{"author": {"display_name": "Jane Doe"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    rows = spark.createDataFrame([(1, json.dumps(work)), (2, "{}"), (3, None), (4, "broken")], "k int, raw string")
    r = bibliography.flatten_works(rows, "raw").collect()
    assert [(x["k"], x["doi"], x["pages"], x["abstract"], x["cited_by"]) for x in r] == [(1, "10.1/A", "1-9", "a b a", 0)]
    item = {"title": ["T"], "DOI": "10.1/B", "published-online": {"date-parts": [[2019, 1]]}, "author": [{"given": "J", "family": "Doe"}, {"family": "Roe"}], "abstract": "<p>x</p>", "is-referenced-by-count": 4}
    r = bibliography.flatten_items(spark.createDataFrame([(json.dumps(item),), ("{}",)], "raw string"), "raw").first()
    assert (r["doi"], r["year"], r["authors"], r["abstract"], r["cited_by"]) == ("10.1/b", 2019, ["J Doe", "Roe"], "x", 4)
    xml = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2018 Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/C</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    r = bibliography.flatten_articles(spark.createDataFrame([(xml,), ("<broken",)], "raw string"), "raw").collect()
    assert [(x["pmid"], x["doi"], x["year"], x["authors"], x["journal"]) for x in r] == [("7", "10.1/c", 2018, ["Jane Doe"], "J")]


def test_labels_and_references(spark):
    refs = spark.createDataFrame([(1, ["Jane Doe", "Al Roe"], 2020, "T"), (2, [], None, "x" * 40)], "id long, authors array<string>, year int, title string")
    texts = spark.createDataFrame([("a", "see  [1, 2] and [9].")], "name string, text string")
    assert records.in_text(texts, "text", refs).first()["text"] == "see (Doe & Roe, 2020; “" + "x" * 30 + "…”, n.d.) and ."
    row = refs.where("id = 1").select(records.apa_reference(F.col("authors"), F.col("year"), F.col("title"), F.lit("J"), F.lit("3"), F.lit("2"), F.lit("1-9"), F.lit("10.1/a"), F.lit(None).cast("string")).alias("r")).first()
    assert row["r"] == "Doe, J., & Roe, A. (2020). T. J, 3(2), 1-9. https://doi.org/10.1/a"
    loose = records.loose_citations(spark.createDataFrame([("a", "as (Smith et al., 2020) said [1]")], "name string, text string"), "name", "text").collect()
    assert [r["citation"] for r in loose] == ["(Smith et al., 2020)"]
    assert [r["name"] for r in records.missing_sections(texts, "name", "text", ["a", "b"]).collect()] == ["b"]


def test_common_table_of_findings(spark):
    one = spark.createDataFrame([("x", "y", 0.5, 0.001), ("x", "z", 0.1, 0.5), ("y", "z", 0.2, None)], "a string, b string, r double, p double")
    two = spark.createDataFrame([("v", "g", 0.3, 0.04)], "number string, category string, eta2 double, p double")
    found = report.significant_findings([report.as_findings(one, "correlation", "a", "b", "r"), report.as_findings(two, "group", "number", "category", "eta2")]).collect()
    assert [(r["analysis"], r["first"], r["second"], r["p_bh"]) for r in found] == [("correlation", "x", "y", 0.002), ("group", "v", "g", 0.04)]
    assert report.significant_findings([report.as_findings(one.where("p > 1"), "correlation", "a", "b", "r")]).count() == 0
