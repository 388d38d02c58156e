"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.llm import (graph_search, jaccard, language_id, language_model, leakage, lexical_search, mixing, packing, periodic_runs,
                             secret_scan, sharding, substrings, warc)
from tracewright.llm.common import WORD, columns, remainder_of_id, table
from tracewright.session import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_secrets")
def op1(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = written(F.filter("spans", lambda s: s["kind"] != "network"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op2_sharding")
def op2(spark, sf_dir):
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = sharding.assign_shards(docs, sharding.SHARDS).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard")
    return sharding.add_slots(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_repeated_bytes")
def op3(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_model")
def op5(spark, sf_dir):
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = remainder_of_id(F.col("doc_id"), 7) == 2
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_model.score_texts(rows, ~F.col("held_out"), ["doc_id", "held_out"])


@query("op6_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d""")
def op6(spark, sf_dir):
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).drop("url")


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held_out = remainder_of_id(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query("op8_jaccard_join")
def op8(spark, sf_dir):
    return jaccard.set_groups(table(spark, sf_dir, "documents"), jaccard.Rule(words=4, percent=85))


@query("op9_nearest")
def op9(spark, sf_dir):
    found = graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


@query("op10_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
    CAST(coalesce(sum(3 * source_size) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left
  FROM r WINDOW u AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST)),
t AS (
  SELECT source, source_size, budget,
    least(CAST(3 * source_size AS DOUBLE), w * max(CAST(budget - before AS DOUBLE) / w_left) OVER ()) AS target FROM o),
q AS (
  SELECT d.*, t.source_size, t.target, t.budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, pass, CAST(pass * source_size + upto AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1), (2)) p(pass) WHERE target > 0),
run AS (SELECT finish, budget, sum(size) OVER (ORDER BY finish) AS total FROM c),
cut AS (SELECT max(finish) AS f FROM run WHERE total <= budget),
n AS (SELECT doc_id, key, count(*) AS copies FROM c, cut WHERE finish <= f GROUP BY doc_id, key)
SELECT q.doc_id, q.size, q.source_size, q.target,
  CAST(CASE WHEN q.target > 0 THEN coalesce(copies, 0) ELSE 1 END * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.key = n.key""")
def op10(spark, sf_dir):
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_lexical_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark),
s AS (SELECT count(*) AS total, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
q AS (SELECT item, term, count(*) AS repeats FROM (SELECT item, unnest(ts) AS term FROM i) GROUP BY item, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, total),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ts) * total) // words AS m FROM d, s WHERE len(ts) > 0),
g AS (
  SELECT item, m.r, m.doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN m ON p.r = m.r GROUP BY item, m.r, m.doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o JOIN i USING (item) WHERE rank <= 10""")
def op11(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_packing")
def op12(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        pieces = packing.pack(table(spark, sf_dir, "documents"), file.read())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_periods(docs):
    """The texts, with those whose crc32(doc_id as text) is divisible by 10 made periodic from some word on; a null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    drawn = docs.where((h % 10 == 0) & F.col("text").isNotNull()).select("doc_id", words.alias("words"), F.floor(h / 10).alias("g"))
    sized = drawn.withColumn("n", F.size("words"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    new = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.where((h % 10 != 0) | h.isNull() | F.col("text").isNull()).select("doc_id", "text").unionByName(
        placed.select("doc_id", F.array_join(new, " ").alias("text")))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    found = periodic_runs.find_runs(with_periods(columns(table(spark, sf_dir, "documents"), "doc_id", "text")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
