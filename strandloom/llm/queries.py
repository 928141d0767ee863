"""Registered queries of the corpus operators, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.collocations import mine_collocations
from strandloom.llm.conversation_repair import damaged, repair_conversations
from strandloom.llm.decontaminate import find_leaks
from strandloom.llm.exact_dedup import exact_groups
from strandloom.llm.html_extract import extract_pages
from strandloom.llm.jaccard_join import link_groups
from strandloom.llm.license_scan import BASE_PHRASES, TEMPLATES, key_at, scan_licenses, words_of
from strandloom.llm.ngram_model import score_texts
from strandloom.llm.packing import pack_documents
from strandloom.llm.quality import score_documents
from strandloom.llm.sharding import shard_documents
from strandloom.llm.substring_dedup import dedup_substrings
from strandloom.llm.url_filter import RULES, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_crc32")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 40)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op11_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extract, op2_packing, op3_decontaminate, op4_substring_dedup, op5_exact_dedup, op6_sharding, op7_quality, op8_license_scan, op9_jaccard_join, op10_url_filter, op11_ngram_model, op12_conversation_repair, op13_collocations)
    return {f.__name__: f for f in found}


SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_url_filter": r"""
        WITH u AS (SELECT page_id,
                          coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
             r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             m AS (SELECT page_id, host, path, h || p AS rule, v,
                          row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
                   FROM u LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_substring_dedup"] = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
         win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
         least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
         gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN least USING (h) WHERE m < doc_id),
         words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
         kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

SQL["op9_jaccard_join"] = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
         sh AS MATERIALIZED (
            SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 4], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
            UNION ALL SELECT doc_id, md5_number(array_to_string(ws, ' ')) FROM d WHERE len(ws) BETWEEN 1 AND 4),
         n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
         both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
         l AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
         e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
         reach AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, root FROM reach JOIN e ON e.a = reach.doc_id),
         c AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    """The same labels without an index: every place of every key phrase is tried."""
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ", ".join(f"('{t.label}', {words(ws := words_of(t.text))}, {words(key := words_of(t.key_phrase))}, {key_at(ws, key)})" for t in TEMPLATES)
    phrases = ", ".join(f"('{label}', {words(words_of(p))})" for p, label in BASE_PHRASES.items())
    return rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_SEPARATORS}'), lambda x: x <> '') AS ws FROM documents),
         p(label, ps) AS (VALUES {phrases}), t(label, ts, ks, ka) AS (VALUES {templates}),
         s AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d),
         b AS (SELECT doc_id, label, ws, ps, unnest(range(1, len(ws) - len(ps) + 2)) AS i FROM s JOIN p ON contains(line, ' ' || array_to_string(ps, ' ') || ' ')),
         base AS MATERIALIZED (SELECT doc_id, label, i - 1 AS i FROM b WHERE ws[i:i + len(ps) - 1] = ps),
         k AS (SELECT doc_id, label, ws, ts, ks, ka, unnest(range(1, len(ws) - len(ks) + 2)) AS i FROM s JOIN t ON contains(line, ' ' || array_to_string(ks, ' ') || ' ')),
         m AS (SELECT doc_id, label, len(list_filter(range(1, len(ts) + 1), lambda j: i - ka + j - 1 >= 1 AND ws[i - ka + j - 1] = ts[j]))::DOUBLE / len(ts) AS share FROM k WHERE ws[i:i + len(ks) - 1] = ks),
         own AS (SELECT doc_id, label, share FROM m WHERE share >= 0.6),
         x AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
         y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM own UNION ALL SELECT doc_id, label, 0.6 FROM base) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""


SQL["op8_license_scan"] = _license_sql()


#: CRC-32 of short ASCII texts: the table of all bytes, and a fold over the codes of the letters.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"

SQL["op12_conversation_repair"] = rf"""
    WITH RECURSIVE
         c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS k,
                      {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, {_CRC_TABLE}),
         a AS (SELECT k, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
               FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c)),
         o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM a),
         f AS MATERIALIZED (SELECT *, left(role, 1) AS s, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
                                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
         ins(q, p, letters, extra, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
                (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'), (3, 2, 'I', 2, chr(10) || 'user:'), (2, 3, 'I', 2, chr(10) || 'assistant:'),
                (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
         edit(e, p, s, p2, price, as_role) AS (SELECT 'D', p, NULL::VARCHAR, p, 3, NULL::VARCHAR FROM range(4) t(p) UNION ALL SELECT 'R', p, NULL, CASE p WHEN 2 THEN 3 ELSE 2 END, 2, CASE p WHEN 2 THEN 'assistant' ELSE 'user' END FROM range(4) t(p)
                UNION ALL SELECT * FROM (VALUES ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 3, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL))),
         best(k, i, q, b) AS (
            SELECT DISTINCT k, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': '', 'rep': ''}} FROM c
            UNION ALL
            SELECT best.k, best.i + 1, p2::BIGINT, min({{'cost': b.cost + extra + price + (e <> 'D' AND fault = 'truncated')::BIGINT, 'audit': b.audit || letters || e,
                        'rep': b.rep || lines || CASE WHEN e = 'D' THEN '' ELSE chr(10) || coalesce(as_role, role) || ':' || text END}})
            FROM best JOIN f ON f.k = best.k AND f.i = best.i + 1 JOIN ins ON ins.q = best.q JOIN edit ON edit.p = ins.p AND (edit.s IS NULL OR edit.s = f.s) AND (e = 'D' OR fault NOT IN ('blank', 'duplicate'))
            GROUP BY best.k, best.i, p2),
         n AS (SELECT k, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
               FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY i) || s NOT IN ('su', 'ua', 'au') AS illegal FROM f) GROUP BY k),
         done AS (SELECT best.k, min({{'cost': b.cost + extra, 'audit': b.audit || letters, 'rep': b.rep || lines}}) AS b FROM best LEFT JOIN n USING (k) JOIN ins USING (q) WHERE best.i = coalesce(n.n, 0) AND p IN (0, 3) GROUP BY best.k)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           b.cost AS cost, b.audit AS audit, sha256(b.rep[2:]) AS repaired_sha256
    FROM (SELECT DISTINCT k, conv_id FROM c) JOIN done USING (k) LEFT JOIN n USING (k)"""


SQL["op13_collocations"] = rf"""
    WITH p AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w
               FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
         t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
         c AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f
               FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) r(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
         q AS (SELECT lang, phrase, f AS a, words, string_split(phrase, ' ') AS w FROM c WHERE words > 1),
         s AS (SELECT q.lang, q.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
               FROM (SELECT *, unnest(range(1, words)) AS k FROM q) q JOIN c x ON x.lang = q.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN c y ON y.lang = q.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS f FROM (SELECT *, unnest(range(1, words - k + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS k FROM q)) GROUP BY ALL),
         o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN g USING (lang, phrase) WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
