"""The registered queries of the ten operators, and their SQL for the checks.

Every query applies its operator to the whole intended table with the
parameters below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import (
    embedding_dedup,
    hamming_search,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    url_filter,
)
from chronoloom.llm.shared import fold, read_table

#: The key of the pseudonyms; a deployment passes its own secret one.
DEMO_KEY = b"chronoloom demonstration key"
NEIGHBOURS = 10
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: The blocklist of the query: whole sites, by the name of the junk they carry.
LISTED = [f"{name}.example.{top}/" for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), DEMO_KEY)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), listed, RULES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    return quality.score_quality(docs, labels, learn=~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_lines(docs)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read_table(spark, sf_dir, "embeddings").select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.top_k(codes, codes.where("vec_id % 100 = 0"), NEIGHBOURS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, where=~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_pii,
            op2_url_filter,
            op3_quality,
            op4_line_dedup,
            op5_embedding_dedup,
            op6_ngram_join,
            op7_mixing,
            op8_hamming_search,
            op9_language_id,
            op10_packing,
        )
    }


def _url_sql() -> str:
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.action}')" for r in RULES)
    listed = ", ".join(f"('{u}')" for u in LISTED)
    return f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, rid, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM parts),
rules(rule, rhost, rpath, action) AS (VALUES {rules}),
listed(entry) AS (VALUES {listed}),
fits AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid),
junk AS (
  SELECT DISTINCT rid FROM split JOIN listed ON host || '/' = entry OR ends_with(host || '/', '.' || entry))
SELECT page_id, host, path, rule, junk.rid IS NOT NULL AS listed,
  coalesce(action, CASE WHEN junk.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits USING (rid) LEFT JOIN junk USING (rid)"""


_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(n, m) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN comp ON n = vec_id LEFT JOIN deg ON a = vec_id"""

_NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
half AS (SELECT a, b FROM common WHERE 100 * o >= 85 * (na + nb - o)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(n, m) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN comp ON n = doc_id"""

_HAMMING_SQL = f"""
WITH codes AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:64], lambda x: (x > 0)::INT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
packed AS (
  SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(c, lambda x, i: x::UBIGINT << (i - 1)::UBIGINT)), lambda p, q: p | q) AS code
  FROM codes),
near AS (
  SELECT q.vec_id AS query_id, p.vec_id, bit_count(xor(q.code, p.code))::INT AS distance
  FROM packed q JOIN packed p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank
FROM near QUALIFY rank <= {NEIGHBOURS}"""

_LINES_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, pos, list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\r\x0b\x0c]+'), lambda w: w <> '')) AS s FROM raw),
full_sets AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, s, len(s) AS n FROM sets WHERE len(s) > 0),
uses AS (SELECT w, count(*) AS k FROM (SELECT unnest(s) AS w FROM full_sets) GROUP BY w),
ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY k, w) AS place
  FROM (SELECT id, n, unnest(s) AS w FROM full_sets) JOIN uses USING (w)),
prefix AS (SELECT id, n, w FROM ranked WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT y.doc_id, y.pos FROM pairs JOIN full_sets x ON x.id = a JOIN full_sets y ON y.id = b
  WHERE 10 * len(list_intersect(x.s, y.s)) >= 8 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS text, count(*) AS n_lines,
    count(gone.pos) AS n_removed
  FROM raw LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _url_sql(),
        "op4_line_dedup": _LINES_SQL,
        "op5_embedding_dedup": _EMBEDDING_SQL,
        "op6_ngram_join": _NGRAM_SQL,
        "op8_hamming_search": _HAMMING_SQL,
    }
