"""The registered queries of the dealt operators: (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversations, decontaminate, near_dedup, packing, permutation_index, pii, quality, sketch_search, substring_dedup, suffix_tree, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack_mixture(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.contamination(
        _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")).drop("doc")


def op3_warc_index(spark, sf_dir):
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op4_sentence_spans(spark, sf_dir):
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc")


def op5_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, _read(spark, sf_dir, "labels")).drop("doc")


def op6_near_duplicates(spark, sf_dir):
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_permutation_index(spark, sf_dir):
    return permutation_index.nearest(_read(spark, sf_dir, "embeddings"))


def op8_suffix_scores(spark, sf_dir):
    return suffix_tree.suffix_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark, sf_dir):
    return quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op10_pseudonyms(spark, sf_dir):
    return pii.pseudonymized(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc")


def op11_grammar_repair(spark, sf_dir):
    return conversations.repair_digest(conversations.damaged(_read(spark, sf_dir, "conversations")), _read(spark, sf_dir, "conversations"))


def op12_tree_bpe(spark, sf_dir):
    return bpe_codec.round_trip(_read(spark, sf_dir, "documents"))


def op13_sketch_search(spark, sf_dir):
    return sketch_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pack_mixture": op1_pack_mixture,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_index": op3_warc_index,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_permutation_index": op7_permutation_index,
    "op8_suffix_scores": op8_suffix_scores,
    "op9_quality": op9_quality,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_grammar_repair": op11_grammar_repair,
    "op12_tree_bpe": op12_tree_bpe,
    "op13_sketch_search": op13_sketch_search,
}
ORACLE: dict[str, str] = {
    "op3_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN largest <> page_id THEN largest END AS refers_to
        FROM t""",
    "op13_sketch_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL),
        s AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM d WHERE len(t) > 0),
        f AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n
              FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term, all_docs),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM benchmark WHERE text IS NOT NULL),
        r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op11_grammar_repair": r"""
        WITH RECURSIVE
        steps AS (SELECT n, 0 AS k, n AS c FROM (SELECT unnest(range(256)) AS n)
                  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
        tab AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        hit AS (SELECT raw.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS d FROM raw, tab),
        dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                       CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE d <> 0),
        num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                       row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                       regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM dam),
        f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
                     CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault FROM num),
        nxt(r, ini, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        ins(p, r, k, letters, added) AS (VALUES
            (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 1, 'I', chr(10) || 'user:'), (1, 2, 1, 'I', chr(10) || 'user:'), (3, 2, 1, 'I', chr(10) || 'user:'),
            (2, 3, 1, 'I', chr(10) || 'assistant:'), (0, 3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        edits AS (
            SELECT conv_id, i, r, r AS q, 2 AS cost, 'D' AS letter, '' AS added FROM f, (SELECT unnest([0, 1, 2, 3]) AS r)
            UNION ALL SELECT conv_id, i, r, q, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM f JOIN nxt USING (ini) WHERE fault IN ('.', 't')
            UNION ALL SELECT conv_id, i, r, q, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', chr(10) || CASE nxt.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
                FROM f, nxt WHERE fault IN ('.', 't') AND nxt.ini IN ('u', 'a')),
        dp AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS p, 0 AS cost, '' AS audit, '' AS made FROM f
            UNION ALL
            SELECT conv_id, i, q, cost, audit, made FROM (
                SELECT dp.conv_id, e.i, e.q, dp.cost + 5 * k + e.cost AS cost, dp.audit || letters || e.letter AS audit, dp.made || ins.added || e.added AS made
                FROM dp JOIN ins ON ins.p = dp.p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.r = ins.r)
            QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
        total AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
                         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                         count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        best AS (SELECT dp.conv_id, dp.cost + 5 * k AS cost, audit || letters AS audit, made || added AS made
                 FROM dp JOIN total t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.n = dp.i JOIN ins ON ins.p = dp.p AND (ins.r = 3 OR ins.r = 0 AND ins.p = 0)
                 QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * k, audit || letters) = 1),
        every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made[2:], '')) AS repaired_sha256
        FROM every LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM every.conv_id""",
}
