"""One registered query per corpus operator, over whole tables, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.llm import alignment, block_naming, bpe, divergence, jaccard_join, language_id, line_dedup, packing, secret_scan, sharding, token_store, vector_file, warc
from vintagerisk.llm.frames import hex_sha256, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_store.write_shards(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.read_shards(spark, folder).select(
        "doc_id", "start", F.expr("length(ids) DIV 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.duplicates(table(spark, sf_dir, "documents"))


NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
SQL["op3_block_naming"] = f"""
WITH n AS (SELECT doc_id, {NORMAL} AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""


@query
def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{k:04d}" for k in range(256)]
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), shards).select("doc_id", "slot", "shard")


@query
def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.recode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op2_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 3)
    model = language_id.fit(docs.where("fold <> 1"))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query
def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0)


@query
def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl, archive = scratch(spark, "crawl"), scratch(spark, "warc")
    lines = warc.write_monolithic(table(spark, sf_dir, "pages"), crawl)
    files = warc.normalise(spark, crawl, warc.revisits(lines), archive)
    return warc.read_archives(spark, archive, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc_normaliser"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS head FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
FROM m
"""


@query
def op9_vector_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_file.search(vectors, vectors.where("vec_id % 100 = 0"))


SQL["op9_vector_file_search"] = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS double)) AS bigint) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS bigint) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_scan.create_ledger(spark, scratch(spark, "ledger"))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ledger, path="doc_id")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        F.col("path").alias("doc_id"), *[of(k) for k in base],
        hex_sha256(secret_scan.listing(F.col("spans"), base)).alias("base_sha256"), secret_scan.listing(F.col("spans")).alias("spans"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, value: str, least: int) -> str:
    """Spans of one kind in DuckDB: the gaps between the matches and the matches' lengths, added up."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - n AS start, e AS stop FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(hit) + 1), lambda i: CAST(list_sum(list_transform(gap[:i], lambda g: length(g))) + list_sum(list_transform(hit[:i], lambda h: length(h))) AS bigint))) AS e,
             unnest(list_transform(hit, lambda h: length(h))) AS n, unnest(list_transform(val, lambda h: length(h))) AS size
      FROM (SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS gap, regexp_extract_all(body, '{pattern}') AS hit, {value} AS val FROM d)
    ) WHERE size >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX, _PEM = "AKIA[A-Z0-9]+", "[0-9a-f]+", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
SQL["op10_blob_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS ({_sql_spans('assign', 0, _ASSIGN, f"regexp_extract_all(body, '{_ASSIGN}', 2)", 6)} UNION ALL {_sql_spans('access', 1, _ACCESS, 'hit', 20)}
  UNION ALL {_sql_spans('hex', 2, _HEX, 'hit', 24)} UNION ALL {_sql_spans('pem', 3, _PEM, 'hit', 1)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return alignment.Alignment(docs, vocabulary("byte_bpe_50k.json"), model).documents()


@query
def op12_line_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, so that the second one's keys ask the filters of the first."""
    docs, store = table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.LineStore(spark)
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0))
    for k in (0, 1):
        store.insert(docs.where(half == k))
    return store.cleaned(docs).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


SQL["op12_line_store"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
x AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS head FROM x WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT x.*, h.head IS NULL OR h.head = doc_id AS stays FROM x LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN held USING (lang, source) GROUP BY g.lang, g.source),
rated AS (SELECT t.lang, t.source, kept.term, coalesce(h.c, 0) AS c, 1 + (1000000000::hugeint * (coalesce(h.c, 0) + 1)) // (t.n + l.v) AS p,
                 1 + (1000000000::hugeint * (kept.c + 1)) // (l.n + l.v) AS q
          FROM totals t JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN held h ON h.lang = t.lang AND h.source = t.source AND h.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM rated WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS bigint) AS value, CAST(rank AS integer) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
