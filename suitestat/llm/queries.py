"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suitestat.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.sentencepiece_bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, with_ids=False, with_text=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.quality_rules import STATS, quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *STATS, "base_failed", "kept", "rule")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.embedding_cells import link

    return link(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from suitestat.llm.line_join import removed_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = removed_lines(docs)
    out = docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(found["k"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.toxicity_ftrl import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.prob_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of a document's original text that go, and its size in code points."""
    from pyspark.sql import functions as F

    from suitestat.llm.line_hash import removed_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_passages(docs)
    sizes = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    out = sizes.join(gone, sizes["doc_id"].eqNullSafe(gone["k"]), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    return out.select("doc_id", "n_chars", F.size(spans).cast("long").alias("n_removed"), F.coalesce("words", F.lit(0)).cast("long").alias("removed_words"), spans.alias("removed_spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.language_cnn import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).drop("text", "lang")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text, of which one in ten has its tail repeated first: their number, the one of the greatest exponent, digests."""
    from pyspark.sql import functions as F

    from suitestat.llm.basic_factors import periodic_runs, repeat_tail

    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=repeat_tail)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best).select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", lines.alias("lines"), "collapsed")
    return out.withColumn("exponent_milli", F.expr("1000 * length div period")).withColumn("runs_sha256", F.sha2("lines", 256)).withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("lines", "collapsed")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from suitestat.llm.jacobi_davidson import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when read back, with one more conversation whose texts hold control strings."""
    from suitestat.llm.chat_format import format_chats, read_digests

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": OP4_SQL, "op5_line_dedup": OP5_SQL, "op10_warc": OP10_SQL, "op13_chat_formatting": OP13_SQL}


#: The digest in base 32: 40 hex digits as 160 bits, five at a time.
OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(to_base(CAST(instr('0123456789abcdef', substr(sha, i, 1)) - 1 AS BIGINT), 2), 4, '0')), 'string_agg', '') AS bits FROM p),
d AS (
  SELECT page_id, payload_bytes, sha, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) + 1, 1)), 'string_agg', '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY sha) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY sha) THEN min(page_id) OVER (PARTITION BY sha) END AS refers_to
FROM d
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.id),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id
"""

OP5_SQL = """
WITH l AS (
  SELECT doc_id, u.pos - 1 AS pos, regexp_extract_all(u.line, '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, pos)),
s AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS t
  FROM l WHERE len(w) > 0),
f AS (SELECT t, min((doc_id, pos)) AS first, row_number() OVER (ORDER BY t) AS id, len(t) AS n FROM s GROUP BY t),
e AS (SELECT id, n, unnest(t) AS x FROM f),
p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
k AS (SELECT f.id, count(p.b) AS links, least(any_value(f.first), coalesce(min(g.first), any_value(f.first))) AS first
  FROM f LEFT JOIN p ON p.a = f.id LEFT JOIN f g ON g.id = p.b GROUP BY f.id),
r AS (SELECT s.doc_id, s.pos, k.links, (s.doc_id, s.pos) <> k.first AS gone FROM s JOIN f ON f.t = s.t JOIN k ON k.id = f.id),
d AS (SELECT doc_id, count(*) AS n_lines, sum(links) AS n_links, count(*) FILTER (gone) AS n_removed,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN d USING (doc_id)
"""

#: Quoted code points: each backslash, each # that follows a #, the slash of a control string; headers and ends by their lengths.
OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, role)),
q AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</turn>', '/turn>')))
    + list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: length(x) - 1)) AS quoted,
    length('### ' || role || ': ' || ' </turn>') + 1 AS around
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(coalesce(quoted, length(text)) + around) AS BIGINT) AS formatted_chars
FROM q GROUP BY conv_id
"""
