"""Bibliographic records and citation markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed pattern of a citation marker: ids in brackets.
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"


#: Fixed letters of the words that relevance compares.
WORD = "[a-zçğıöşü]+"


def title_key(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 80)


def record_key(doi: Column, title: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(doi, F.lit(""))), F.concat(F.lit("t:"), title_key(title)))


def dedup_records(records: DataFrame) -> DataFrame:
    """Records (seq, doi, title, abstract, cited_by, findings, score, and pmid if it is there) merged by key: the first wins, gaps are filled from later
    ones (an empty abstract or pmid is a gap), citations take the maximum, findings the sorted union; the first record's score stays."""
    keyed = records.withColumn("key", record_key(F.col("doi"), F.col("title")))
    # a set of findings, not their repeats, meets in a key
    named = keyed.select("key", F.explode("findings").alias("f")).groupBy("key").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    first_known = lambda c: F.min_by(c, F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0, F.col("seq"))).alias(c)
    merged = keyed.groupBy("key").agg(
        F.min("seq").alias("seq"), F.min_by("doi", "seq").alias("doi"), F.min_by("title", "seq").alias("title"), *[first_known(c) for c in ("abstract", "pmid") if c in records.columns],
        F.max("cited_by").alias("cited_by"), F.min_by("score", "seq").alias("score"), F.count("*").alias("merged"),
    )
    return merged.join(named, "key", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))


def relevance(query_terms: Column, title: Column, cited_by: Column, year: Column, abstract: Column, this_year: int) -> Column:
    """Twice the share of the query's terms that the title has, citations on a log scale, how recent it is, and half a point for an abstract."""
    asked = F.array_distinct(query_terms)
    overlap = F.size(F.array_intersect(asked, F.regexp_extract_all(F.lower(title), F.lit(WORD), 0))) / F.greatest(F.size(asked), F.lit(1))
    age = F.least(F.lit(1.0), F.coalesce(F.greatest(F.lit(0.0), 1 - (F.lit(this_year) - year) / 20), F.lit(0.0)))
    known = F.coalesce(F.length(abstract.cast("string")), F.lit(0)) > 0
    return 2 * F.coalesce(overlap, F.lit(0.0)) + F.log1p(F.coalesce(cited_by, F.lit(0))) / 10 + age + F.when(known, 0.5).otherwise(0.0)


#: Fixed size of the pool of records for the introduction.
INTRODUCTION, INTRODUCTION_POOL = "INTRO", 8


def top_per_target(scored: DataFrame, target: str, k: int, pools: dict[str, int] | None = None) -> DataFrame:
    """The first records of each target by falling score, then key, with their rank: ``k`` of them, or as many as ``pools`` says for a target (eight for the introduction)."""
    pools = {INTRODUCTION: INTRODUCTION_POOL} if pools is None else pools
    most = F.lit(k)
    for name, size in pools.items():
        most = F.when(F.col(target) == name, F.lit(size)).otherwise(most)
    w = Window.partitionBy(target).orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def markers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, id for each marker id of a text in order."""
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), lambda m: F.split(m, r"\s*,\s*")))
    return texts.select(key, F.posexplode(ids).alias("pos", "id")).select(key, F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"))


def invalid_markers(found: DataFrame, references: DataFrame) -> DataFrame:
    return found.join(references.select("id"), "id", "left_anti")


def first_appearance(found: DataFrame, order: list[str]) -> DataFrame:
    """old, new: ids numbered by where they appear first. A row per reference meets in one window."""
    first = found.groupBy("id").agg(F.min(F.struct(*order)).alias("at"))
    return first.select(F.col("id").alias("old"), F.row_number().over(Window.orderBy("at")).cast("long").alias("new"))


def renumber(texts: DataFrame, key: str, text: str, numbers: DataFrame) -> DataFrame:
    """Texts with their markers rewritten: sorted new ids, once each; a marker without any is dropped."""
    table = numbers.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))  # the reference list
    pieces = F.split(F.regexp_replace(text, MARKER, "\u0001[$1\u0001"), "\u0001")
    joined = texts.crossJoin(F.broadcast(table))

    def piece(p: Column) -> Column:
        ids = F.transform(F.split(F.substring(p, 2, 10**6), r"\s*,\s*"), lambda i: F.try_element_at(F.col("_map"), i.cast("long")))
        new = F.array_sort(F.array_distinct(F.array_compact(ids)))
        return F.when(p.rlike(r"^\[\d+(\s*,\s*\d+)*$"), F.when(F.size(new) > 0, F.concat(F.lit("["), F.array_join(new.cast("array<string>"), ", "), F.lit("]"))).otherwise("")).otherwise(p)

    return joined.withColumn(text, F.array_join(F.transform(pieces, piece), "")).drop("_map")


def short_sections(texts: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, n_words of the texts under ``least`` words."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    return texts.select(key, n.alias("n_words")).where(F.col("n_words") < least)


def collapsed(before: DataFrame, after: DataFrame, key: str, text: str, least: int = 30, share: float = 0.6) -> DataFrame:
    n = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    j = before.select(key, n(F.col(text)).alias("n_before")).join(after.select(key, n(F.col(text)).alias("n_after")), key)
    return j.where((F.col("n_before") >= least) & (F.col("n_after") < share * F.col("n_before")))


def unmatched_p_values(texts: DataFrame, key: str, text: str, p_values: DataFrame) -> DataFrame:
    """key, quoted for each 'p = .xxx' that no finding has at two or three decimals."""
    quoted = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\bp\s*=\s*0?(\.\d+)"), 1)).alias("quoted")).distinct()
    forms = p_values.select(F.explode(F.array(F.format_number("p", 2), F.format_number("p", 3))).alias("form")).select(F.regexp_replace("form", "^0", "").alias("quoted")).distinct()
    return quoted.join(forms, "quoted", "left_anti").select(key, "quoted")


def apa_authors(authors: Column) -> Column:
    def one(name: Column) -> Column:
        parts = F.filter(F.split(name, r"\s+"), lambda p: p != "")
        initials = F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")
        return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit(", "), initials)).otherwise(name)

    names, n = F.transform(authors, one), F.size(authors)
    return F.when(n == 1, names[0]).when(n > 20, F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), F.element_at(names, -1))).when(n > 1, F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))


def apa_reference(authors: Column, year: Column, title: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi: Column, pmid: Column, no_year: str = "(t.y.).") -> Column:
    """One reference: authors, year, title, journal with volume, issue and pages, and the DOI or else the PubMed link."""
    has = lambda c: c.isNotNull() & (c != "")
    names = F.when(F.size(F.coalesce(authors, F.array())) > 0, apa_authors(authors))
    dated = F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(").")))
    dated, named = F.coalesce(dated, F.lit(no_year)), F.concat(F.rtrim(title, F.lit(".")), F.lit("."))
    head = F.when(names.isNotNull(), F.concat_ws(" ", names, dated, named)).otherwise(F.concat_ws(" ", named, dated))
    place = F.concat(
        F.regexp_replace(journal, "[,. ]+$", ""), F.when(has(volume), F.concat(F.lit(", "), volume, F.when(has(issue), F.concat(F.lit("("), issue, F.lit(")"))).otherwise(""))).otherwise(""),
        F.when(has(pages), F.concat(F.lit(", "), pages)).otherwise(""), F.lit("."),
    )
    link = F.when(has(doi), F.concat(F.lit("https://doi.org/"), doi)).when(has(pmid), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))
    return F.concat_ws(" ", head, F.when(has(journal), place), link)


def in_text_label(authors: Column, year: Column, title: Column, lang: str = "en") -> Column:
    """The label of a citation: one or two last names, or the first and others; 30 characters of the title where no author is known."""
    no_year, joiner, others = {"tr": ("t.y.", " ve ", " vd.")}.get(lang, ("n.d.", " & ", " et al."))
    last = lambda n: F.coalesce(F.try_element_at(F.filter(F.split(F.replace(n, F.lit(","), F.lit(" ")), r"\s+"), lambda p: p != ""), F.lit(-1)), n)
    names = F.transform(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != ""), last)
    short = F.concat(F.lit("“"), F.substring(title, 1, 30), F.when(F.length(title) > 30, "…").otherwise(""), F.lit("”"))
    who = F.when(F.size(names) == 0, short).when(F.size(names) == 1, names[0]).when(F.size(names) == 2, F.array_join(names, joiner)).otherwise(F.concat(names[0], F.lit(others)))
    return F.concat(who, F.lit(", "), F.coalesce(year.cast("string"), F.lit(no_year)))


def in_text(texts: DataFrame, text: str, references: DataFrame, lang: str = "en") -> DataFrame:
    """Texts with their markers replaced by labels of references (id, authors, year, title); unknown ids go, runs of spaces shrink."""
    labels = references.select(F.col("id").cast("long").alias("id"), in_text_label(F.col("authors"), F.col("year"), F.col("title"), lang).alias("label"))
    table = labels.agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("_labels"))  # the reference list of one manuscript
    pieces = F.split(F.regexp_replace(text, MARKER, "\u0001[$1\u0001"), "\u0001")

    def piece(p: Column) -> Column:
        found = F.array_compact(F.transform(F.split(F.substring(p, 2, 10**6), r"\s*,\s*"), lambda i: F.try_element_at(F.col("_labels"), i.try_cast("long"))))
        return F.when(p.rlike(r"^\[\d+(\s*,\s*\d+)*$"), F.when(F.size(found) > 0, F.concat(F.lit("("), F.array_join(found, "; "), F.lit(")"))).otherwise("")).otherwise(p)

    joined = texts.crossJoin(F.broadcast(table))
    return joined.withColumn(text, F.regexp_replace(F.array_join(F.transform(pieces, piece), ""), " {2,}", " ")).drop("_labels")


#: Author-year citations outside the marker system (fixed pattern).
AUTHOR_YEAR = r"\((?:e\.g\.,?\s*)?[A-ZÇĞİÖŞÜ][\wçğıöşü]+(?:\s+(?:et\s+al\.|vd\.|ve\s+ark\.|&\s+[A-ZÇĞİÖŞÜ][\wçğıöşü]+))?,?\s+(?:19|20)\d{2}[a-z]?\)"


def loose_citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, citation for each author-year citation of a text."""
    return texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(AUTHOR_YEAR), F.lit(0))).alias("citation"))


def changed_markers(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """key of the texts whose set of markers isn't the same in both versions."""
    ids = lambda df, name: df.select(key, F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), lambda m: F.split(m, r"\s*,\s*").cast("array<long>"))))).alias(name))
    return ids(before, "_x").join(ids(after, "_y"), key).where(~F.col("_x").eqNullSafe(F.col("_y"))).select(key)


def missing_sections(texts: DataFrame, name: str, text: str, required: list[str]) -> DataFrame:
    """Required names without a text that isn't blank."""
    wanted = texts.sparkSession.createDataFrame([(n,) for n in required], f"{name} string")
    return wanted.join(texts.where(F.trim(text) != "").select(name), name, "left_anti")


def select_references(candidates: DataFrame, per_target: int = 5) -> tuple[DataFrame, DataFrame]:
    """References (id, key, title, score) and links (target, id) from candidates (target, key, seq, title, score).

    The best of each target are kept, records with one key are one, and ids follow the score. Only chosen records are numbered.
    """
    best = candidates.groupBy("target", "key").agg(F.max("score").alias("score"), F.min_by("title", "seq").alias("title"))
    chosen = top_per_target(best, "target", per_target)
    merged = chosen.groupBy("key").agg(F.max("score").alias("score"), F.min("title").alias("title"))
    references = merged.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "key")).cast("long").alias("id"), "key", "title", "score")  # a row per chosen record
    return references, chosen.join(references.select("key", "id"), "key").select("target", "id")


def references_of(links: DataFrame, references: DataFrame, targets: DataFrame, fallback: int = 8) -> DataFrame:
    """target, id, title: the references linked to each target, or the first ``fallback`` of all for a target without any."""
    linked = targets.join(links, "target").join(references, "id").select("target", "id", "title")
    first = references.orderBy("id").limit(fallback).select("id", "title")
    return linked.unionByName(targets.join(links, "target", "left_anti").crossJoin(F.broadcast(first)).select("target", "id", "title"))  # ``fallback`` rows


def exclusion_key(doi: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(doi, F.lit("")), F.concat(F.lit("t:"), F.lower(F.substring(title, 1, 60))))


def added_references(found: DataFrame, existing: DataFrame) -> DataFrame:
    """id, doi, title of found records (seq, doi, title) that the list (id, doi, title) hasn't, numbered on from its highest id."""
    known = existing.select(exclusion_key(F.col("doi"), F.col("title")).alias("key")).distinct()
    new = found.withColumn("key", exclusion_key(F.col("doi"), F.col("title"))).join(known, "key", "left_anti")
    new = new.groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("doi", "seq").alias("doi"), F.min_by("title", "seq").alias("title"))
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    return new.crossJoin(F.broadcast(last)).select((F.col("last") + F.row_number().over(Window.orderBy("seq"))).cast("long").alias("id"), "doi", "title")


def incomplete(references: DataFrame) -> DataFrame:
    """One row: n, without_year, without_authors, incomplete (either)."""
    no_year, nobody = F.col("year").isNull(), F.size(F.coalesce("authors", F.array())) == 0
    return references.agg(F.count("*").alias("n"), F.count_if(no_year).alias("without_year"), F.count_if(nobody).alias("without_authors"), F.count_if(no_year | nobody).alias("incomplete"))


def list_order(authors: Column, year: Column) -> list[Column]:
    """Sort keys of the reference list: the first author's last name, then the year; records without authors come last."""
    first = F.try_element_at(F.coalesce(authors, F.array().cast("array<string>")), F.lit(1))
    return [F.coalesce(F.lower(F.element_at(F.split(F.trim(first), r"\s+"), -1)), F.lit("zzz")), F.coalesce(year, F.lit(0))]


def keywords(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """findings (dv, iv, extra, ...) with keywords, the labels of their variables in order, and the queries made of the first three.

    ``labels`` (variable, label) has a row per variable.
    """
    table = labels.where("label <> ''").agg(F.map_from_entries(F.collect_list(F.struct("variable", "label"))).alias("_l"))
    names = F.array_compact(F.concat(F.array("dv", "iv"), F.coalesce("extra", F.array().cast("array<string>"))))
    words = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.coalesce(F.try_element_at(F.col("_l"), n), n))
    first = F.slice("keywords", 1, 3)
    related = F.when(F.size("keywords") >= 2, F.concat_ws(" ", F.col("keywords")[0], F.col("keywords")[1], F.lit("relationship")))
    queries = F.when(F.size("keywords") > 0, F.array_compact(F.array(F.array_join(first, " "), related))).otherwise(F.array().cast("array<string>"))
    return findings.crossJoin(F.broadcast(table)).withColumn("keywords", words).withColumn("queries", queries).drop("_l")
