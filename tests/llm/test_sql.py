"""The corpus queries against their SQL at the smallest scale, and the columns that SQL can express of the others."""

import duckdb
import pytest

from statloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).apply(lambda c: c.map(lambda x: int(x) if isinstance(x, float) else x)).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, database, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(database.execute(queries.ORACLE_SQL[name]).df())


def test_base_rules_equal_sql(spark, database):
    sql = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        runs AS (SELECT doc_id, a, array_to_string(w[a:a + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS a FROM d WHERE len(w) > 2)),
        twice AS (SELECT doc_id, a FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM runs) WHERE n > 1),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(a, a + 3)) AS x FROM twice) GROUP BY doc_id),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
            coalesce(hit.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)"""
    got = queries.op9_quality_rules(spark, DATA).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").toPandas()
    assert rows(got) == rows(database.execute(sql).df())
