"""Raw bibliographic records, as JSON or XML texts in a column, flattened to one schema:
doi, pmid, title, authors, year, journal, volume, issue, pages, abstract, cited_by, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_AUTHORS, ABSTRACT_CHARS = 20, 2000

#: Fixed formats of the three services.
WORK = """display_name string, doi string, publication_year int, cited_by_count bigint, authorships array<struct<author: struct<display_name: string>>>,
primary_location struct<source: struct<display_name: string>>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>, abstract_inverted_index map<string, array<int>>"""
_DATE = "struct<`date-parts`: array<array<int>>>"
ITEM = f"""title array<string>, DOI string, author array<struct<given: string, family: string>>, `published-print` {_DATE}, `published-online` {_DATE}, issued {_DATE},
`container-title` array<string>, volume string, issue string, page string, abstract string, `is-referenced-by-count` bigint"""
ARTICLE = """PubmedArticle array<struct<MedlineCitation: struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<Volume: string, Issue: string, PubDate: struct<Year: string, MedlineDate: string>>>,
Pagination: struct<MedlinePgn: string>, Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>>,
PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>>>"""


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _record(source: str, **columns: Column) -> list[Column]:
    order = ["doi", "pmid", "title", "authors", "year", "journal", "volume", "issue", "pages", "abstract", "cited_by"]
    empty = {"pmid": F.lit(None).cast("string"), "cited_by": F.lit(0).cast("long")}
    return [(columns | {k: v for k, v in empty.items() if k not in columns})[c].alias(c) for c in order] + [F.lit(source).alias("source")]


def _with_keys(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """The other columns and the parsed record as _r."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], parsed.alias("_r"))


def _keys(df: DataFrame, column: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != column]


def flatten_works(df: DataFrame, column: str) -> DataFrame:
    """Works with an inverted abstract index: word -> positions. Records without a title go."""
    r = _with_keys(df, column, F.from_json(column, WORK))
    words = F.flatten(F.transform(F.map_entries("_r.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    first, last = F.nullif(F.col("_r.biblio.first_page"), F.lit("")), F.nullif(F.col("_r.biblio.last_page"), F.lit(""))
    return r.select(*_keys(df, column), *_record(
        "works", doi=F.nullif(F.replace(F.col("_r.doi"), F.lit("https://doi.org/"), F.lit("")), F.lit("")), title=F.col("_r.display_name"),
        authors=F.transform(F.slice(F.coalesce("_r.authorships", F.array()), 1, MOST_AUTHORS), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), year=F.col("_r.publication_year"),
        journal=F.col("_r.primary_location.source.display_name"), volume=F.col("_r.biblio.volume"), issue=F.col("_r.biblio.issue"), pages=F.when(first.isNotNull(), F.concat_ws("-", first, last)),
        abstract=F.nullif(F.substring(F.array_join(F.transform(F.array_sort(words), lambda p: p["w"]), " "), 1, ABSTRACT_CHARS), F.lit("")), cited_by=F.coalesce("_r.cited_by_count", F.lit(0).cast("long")),
    )).where("title <> ''")


def flatten_items(df: DataFrame, column: str) -> DataFrame:
    """Journal items with date parts; markup leaves the abstract; the first usable of the print, online and issue years counts."""
    r = _with_keys(df, column, F.from_json(column, ITEM))
    year = lambda c: F.nullif(F.try_element_at(F.try_element_at(F.col(f"_r.`{c}`.`date-parts`"), F.lit(1)), F.lit(1)), F.lit(0))
    return r.select(*_keys(df, column), *_record(
        "items", doi=F.nullif(F.lower("_r.DOI"), F.lit("")), title=F.try_element_at("_r.title", F.lit(1)),
        authors=F.transform(F.slice(F.coalesce("_r.author", F.array()), 1, MOST_AUTHORS), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))),
        year=F.coalesce(year("published-print"), year("published-online"), year("issued")), journal=F.try_element_at("_r.`container-title`", F.lit(1)), volume=F.col("_r.volume"), issue=F.col("_r.issue"), pages=F.col("_r.page"),
        abstract=F.nullif(F.substring(F.trim(F.regexp_replace("_r.abstract", "<[^>]+>", " ")), 1, ABSTRACT_CHARS), F.lit("")), cited_by=F.coalesce(F.col("_r.`is-referenced-by-count`"), F.lit(0).cast("long")),
    )).where("title is not null")


def flatten_articles(df: DataFrame, column: str) -> DataFrame:
    """Article sets in XML, a row per article; a malformed text gives no rows."""
    r = _with_keys(df, column, F.from_xml(column, ARTICLE))
    a = r.select(*_keys(df, column), F.explode("_r.PubmedArticle").alias("a"))
    art = F.col("a.MedlineCitation.Article")
    date = art["Journal"]["JournalIssue"]["PubDate"]
    ids = F.filter(F.coalesce(F.col("a.PubmedData.ArticleIdList.ArticleId"), F.array()), lambda i: (i["_IdType"] == "doi") & (i["_VALUE"] != ""))
    named = F.slice(F.coalesce(art["AuthorList"]["Author"], F.array()), 1, MOST_AUTHORS)
    return a.select(*_keys(df, column), *_record(
        "articles", doi=F.lower(F.trim(F.try_element_at(ids, F.lit(-1))["_VALUE"])), pmid=_filled(F.col("a.MedlineCitation.PMID")), title=_filled(art["ArticleTitle"]),
        authors=F.transform(F.filter(named, lambda n: n["LastName"] != ""), lambda n: F.concat_ws(" ", F.nullif(n["ForeName"], F.lit("")), n["LastName"])),
        year=F.nullif(F.regexp_extract(F.coalesce(_filled(date["Year"]), date["MedlineDate"]), r"(?:^|\s)(\d{4})", 1), F.lit("")).cast("int"), journal=art["Journal"]["Title"],
        volume=art["Journal"]["JournalIssue"]["Volume"], issue=art["Journal"]["JournalIssue"]["Issue"], pages=art["Pagination"]["MedlinePgn"],
        abstract=F.nullif(F.substring(F.trim(F.array_join(F.transform(art["Abstract"]["AbstractText"], F.trim), " ")), 1, ABSTRACT_CHARS), F.lit("")),
    )).where("title is not null")

