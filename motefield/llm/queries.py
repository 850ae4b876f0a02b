"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm import bpe, divergence, embeddings, lines, matroska, minhash, packing, pieces, runs, substrings, toolcalls, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), g AS (
  SELECT vec_id, v FROM e WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, field).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


TOOL_SCHEMAS = [
    ("answer", "prompt", "string", True, None, None),
    ("answer", "chars", "integer", True, 1.0, 150.0),
    ("answer", "opening", "string", False, None, None),
    ("explain", "prompt", "string", True, None, None),
    ("explain", "chars", "integer", True, 1.0, 1000.0),
    ("explain", "opening", "string", False, None, None),
]


def op5_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "tool string, argument string, type string, required boolean, minimum double, maximum double")
    linked = toolcalls.link_tool_calls(*toolcalls.conversation_calls(table(spark, sf_dir, "conversations")), schemas)
    return toolcalls.in_order(linked).select("conv_id", "call_id", "name", "turn", "result_turn", "level", "status", F.array_join("violations", "; ").alias("violations"), "record")


OP5_SQL = r"""
WITH u AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, coalesce(text, '') AS prompt, length(coalesce(text, '')) AS chars,
         CASE WHEN length(coalesce(text, '')) > 200 THEN 'explain' ELSE 'answer' END AS name,
         turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain
  FROM conversations WHERE role = 'user'
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM u
), r AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name, c.turn, r.turn AS result_turn, c.level,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
       CASE WHEN c.call_id IS NULL THEN NULL WHEN chars < 1 OR chars > CASE name WHEN 'answer' THEN 150 ELSE 1000 END THEN 'range of chars' ELSE '' END AS violations,
       '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE
         '{"chars":' || chars || ',"opening":' || CAST(to_json(substring(prompt, 1, 16)) AS VARCHAR) || ',"prompt":' || CAST(to_json(prompt) AS VARCHAR) || '}' END
       || ',"id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR) || ',"level":' || coalesce(CAST(c.level AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END
       || ',"result":' || CASE WHEN r.text IS NULL THEN 'null' ELSE CAST(to_json(r.text) AS VARCHAR) END || '}' AS record
FROM c FULL JOIN r ON c.call_id = r.call_id
"""


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join("keep_runs", ",").alias("keep_runs"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone
  FROM k LEFT JOIN c ON k.key = c.key
), t AS (
  SELECT doc_id, pos, gone, CASE WHEN coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) <> gone THEN 1 ELSE 0 END AS turn FROM m
), n AS (
  SELECT doc_id, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t
), r AS (
  SELECT doc_id, run, count(*) AS size FROM n GROUP BY doc_id, run
), b AS (
  SELECT doc_id, CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(size, ',' ORDER BY run) AS keep_runs FROM r GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM m GROUP BY doc_id
)
SELECT g.*, b.keep_runs FROM g JOIN b ON g.doc_id = b.doc_id
"""

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), m AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC) AS n
  FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT m.a, m.b FROM m JOIN n x ON x.doc_id = m.a JOIN n y ON y.doc_id = m.b WHERE shared >= 0.8 * (x.n + y.n - shared)
  UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON coalesce(x.text, '') = coalesce(y.text, '') AND x.doc_id <> y.doc_id
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM documents LEFT JOIN c ON c.a = doc_id
"""


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM i
), m AS (
  SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM h JOIN m USING (h) WHERE least < doc_id
), e AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), k AS (
  SELECT e.doc_id, e.word, e.p, c.p IS NOT NULL AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p
), s AS (
  SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM k GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term
), s AS (
  SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS n FROM g LEFT JOIN o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS count, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (s.n + v.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1)::HUGEINT // (v.n + v.v) AS whole
  FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), q AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), e AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - whole) * (p - whole) // whole AS value FROM p WHERE count > 0 AND p > whole
), u AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM q UNION ALL SELECT * FROM e)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= 200
"""


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of documents whose number's CRC-32 ends in 0, the words from a place on repeat a period of them."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = docs.select("doc_id", "text", (crc % 10 == 0).alias("chosen"), F.floor(crc / 10).alias("g"))
    at = at.select("doc_id", "text", "g", F.when(F.col("chosen"), words).alias("w"))
    at = at.select("doc_id", "text", "g", "w", F.size("w").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    at = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return at.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(planted_repeats(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) AS h
  FROM documents
), e AS (
  SELECT *, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g FROM d
), f AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e
), p AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f
), w AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[1 + a + (i - a) % p] END) END AS ws FROM p
), s AS (
  SELECT doc_id, ws, unnest(range(0, n - 15)) AS i FROM w WHERE n >= 24
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 16], ' ')) AS k FROM s
), m AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i
), l AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m
), o AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM l GROUP BY doc_id, q, stretch
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM o WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         arg_min({'s': start, 'n': length, 'p': period}, {'e': -(length / period), 's': start, 'p': period}) AS best
  FROM r GROUP BY doc_id
), x AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), t AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM w
), c AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.doc_id = x.doc_id AND t.i = x.i GROUP BY t.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_embeddings": op1_embeddings,
    "op2_matroska": op2_matroska,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_toolcalls": op5_toolcalls,
    "op6_lines": op6_lines,
    "op7_urls": op7_urls,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_substrings": op10_substrings,
    "op11_divergence": op11_divergence,
    "op12_runs": op12_runs,
    "op13_pieces": op13_pieces,
}

ORACLE_SQL: dict[str, str] = {"op1_embeddings": OP1_SQL, "op5_toolcalls": OP5_SQL, "op6_lines": OP6_SQL, "op7_urls": OP7_SQL, "op9_minhash": OP9_SQL, "op10_substrings": OP10_SQL, "op11_divergence": OP11_SQL, "op12_runs": OP12_SQL}
