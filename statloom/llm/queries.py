"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, decontamination, hardneg, language, neardup, packing, quality, repair, rules, substrings, tokencount, warc
from .inputs import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), remember=True)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.conversation_digest(turns.unionByName(marked))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), remember=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), remember=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_language_id, op3_decontamination, op4_warc, op5_token_counts, op6_quality_classifier, op7_chat_format, op8_substring_dedup, op9_quality_rules, op10_packing, op11_hard_negatives, op12_best_fit_packing, op13_conversation_repair)}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Languages, quality, fertility verdicts and token ids (2, 5, 6, 9, 10, 12) need a model or a vocabulary, which SQL hasn't.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
            FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, least.b) AS component_id, d.doc_id = least(d.doc_id, least.b) AS kept
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON d.doc_id = least.a""",
    "op3_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS s FROM (
            SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a FROM i WHERE len(w) > 0)),
        hits AS (SELECT p.doc_id, p.a, p.k, windows.item_id FROM (
            SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)) p
            JOIN windows ON p.k = windows.k AND p.s = windows.s),
        words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS x FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS target,
            list_transform(range(0, 8), lambda i: ('0x' || h[1 + 5 * i:5 + 5 * i])::INTEGER) AS v FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((x >> k) & 31)]), '')), '') AS payload_digest,
            CASE WHEN target IS DISTINCT FROM page_id AND target IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN target IS DISTINCT FROM page_id THEN target END AS refers_to
        FROM q""",
    "op7_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        -- a backslash for each backslash and for each control string
        m AS (SELECT *, list_sum(list_transform([role, text], lambda x: length(x) + list_sum(list_transform(['\', '<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<start_of_turn>', '<end_of_turn>'],
            lambda c: (length(x) - length(replace(x, c, ''))) // length(c))))) AS size FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(size + length('<|role|>') + length('<|body|>') + 1 + length('<|end|>') + 1)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, a, sha256(array_to_string(w[a:a + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS a FROM d WHERE len(w) >= 35)),
        twice AS (SELECT doc_id, a FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
        gone AS (SELECT doc_id, list(DISTINCT x) AS xs FROM (SELECT doc_id, unnest(range(a, a + 35)) AS x FROM twice) GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.x) AS kept FROM words ANTI JOIN (SELECT doc_id, unnest(xs) AS x FROM gone) g ON words.doc_id = g.doc_id AND words.x = g.x GROUP BY words.doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(xs), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
            s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT * FROM n WHERE rank <= 5""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS t),
        keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) AS key FROM conversations),
        kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(key, lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]), 4294967295), 4294967295) % 20 AS kind FROM keyed, bits),
        rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS x, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM rows),
        faulty AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY x) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY x) AS pair, count(*) OVER (PARTITION BY conv_id) - x AS k FROM placed),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
        -- states: 0 nothing yet, 1 system, 2 user, 3 assistant; up to two inserts stand before a row's own edit
        inserts(state, cost, audit, lines, now) AS (VALUES (0, 0, '', '', 0), (1, 0, '', '', 1), (2, 0, '', '', 2), (3, 0, '', '', 3),
            (0, 3, 'I', 'user:' || chr(10), 2), (1, 3, 'I', 'user:' || chr(10), 2), (2, 3, 'I', 'assistant:' || chr(10), 3), (3, 3, 'I', 'user:' || chr(10), 2),
            (0, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
            (2, 6, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 2), (3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3)),
        edits(now, edit, cost, initial, role, later) AS (VALUES (0, 'K', 0, 's', NULL, 1), (0, 'K', 0, 'u', NULL, 2), (1, 'K', 0, 'u', NULL, 2), (2, 'K', 0, 'a', NULL, 3), (3, 'K', 0, 'u', NULL, 2),
            (0, 'R', 3, NULL, 'user', 2), (1, 'R', 3, NULL, 'user', 2), (2, 'R', 3, NULL, 'assistant', 3), (3, 'R', 3, NULL, 'user', 2),
            (0, 'D', 4, NULL, NULL, 0), (1, 'D', 4, NULL, NULL, 1), (2, 'D', 4, NULL, NULL, 2), (3, 'D', 4, NULL, NULL, 3)),
        moves AS (SELECT i.state, i.cost + e.cost AS cost, i.audit || e.edit AS audit, i.lines, e.edit, e.initial, e.role, e.later FROM inserts i JOIN edits e ON i.now = e.now),
        best AS (
            SELECT conv_id, 0::BIGINT AS k, e.state, {'cost': e.cost, 'audit': e.audit, 'lines': e.lines} AS s
            FROM (SELECT DISTINCT conv_id FROM faulty), (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) e(state, cost, audit, lines)
            UNION ALL
            SELECT b.conv_id, b.k + 1, m.state, min({'cost': m.cost + b.s.cost + CASE WHEN f.fault = 't' AND m.edit <> 'D' THEN 3 ELSE 0 END, 'audit': m.audit || b.s.audit,
                'lines': m.lines || CASE WHEN m.edit = 'D' THEN '' ELSE coalesce(m.role, f.role) || ':' || f.text || chr(10) END || b.s.lines})
            FROM best b JOIN faulty f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.k = f.k
            JOIN moves m ON m.later = b.state AND (m.initial IS NULL OR m.initial = left(f.role, 1)) AND (m.edit = 'D' OR f.fault NOT IN ('b', 'd'))
            GROUP BY b.conv_id, b.k, m.state)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit, sha256(CASE WHEN s.lines IS NULL OR s.lines = '' THEN '' ELSE s.lines[:-2] END) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
        LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = n.n AND b.state = 0""",
}
