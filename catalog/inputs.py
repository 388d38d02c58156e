"""How the given tables are read as labelled logs, vectors and predictions.

The SQL fragments below state the same readings for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import labels as lb
from tracewright.functions import text as tx
from tracewright.session import new_path

# Class list of the event labels, sorted.
CLASSES = ["brute_force", "data_leak", "port_scan", "privilege_escalation", "sql_injection"]

FILE_OF_TYPE = {
    "click": "web/logs/apache2/shop-access.log",
    "view": "gate/logs/openvpn.log",
    "error": "intranet_server/logs/apache2/intranet-error.log.1",
    "signup": "intranet_server/logs/auth.log.2",
    "purchase": "internal_share/logs/audit/audit.log",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One log line per event with a raw JSON label text."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    e = e.select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value", k.alias("k"))
    parts = F.concat_ws(
        ",",
        F.when((F.col("event_type") == "error") & (F.col("k") < 30), '"Brute-Force"'),
        F.when(F.col("value") > 150, '" data_LEAK "'),
        F.when(F.col("k") % 7 == 0, '"port-scan"'),
        F.when((F.col("event_type") == "purchase") & (F.col("k") < 20), '"SQL-Injection"'),
        F.when((F.col("event_type") == "signup") & (F.col("value") < 2), '"privilege_escalation"'))
    label_json = (F.when(F.col("k") == 13, '"port-scan"').when(F.col("k") == 17, "not json")
                  .when(F.col("k") == 19, "null").when(F.col("k") == 23, '["", "port-scan", null]')
                  .otherwise(F.concat(F.lit("["), parts, F.lit("]"))))
    file = F.create_map(*[F.lit(x) for pair in FILE_OF_TYPE.items() for x in pair])[F.col("event_type")]
    path = F.concat(F.lit("tenant"), (F.col("user_id") % 4).cast("string"), F.lit("/"), file)
    line = F.concat_ws(" ", F.concat(F.lit("[T"), F.col("k").cast("string")), F.col("event_type"),
                       F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("]")),
                       F.concat(F.lit(" amount "), F.round(F.col("value") * 100).cast("bigint").cast("string")))
    return e.select("*", label_json.alias("label_json"), path.alias("rel_path"), line.alias("line"))


EVENTS = """ev AS (
  SELECT event_id AS row_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
raw AS (
  SELECT *,
    CASE WHEN k = 13 THEN '"port-scan"' WHEN k = 17 THEN 'not json' WHEN k = 19 THEN 'null'
         WHEN k = 23 THEN '["", "port-scan", null]'
         ELSE '[' || concat_ws(',',
           CASE WHEN event_type = 'error' AND k < 30 THEN '"Brute-Force"' END,
           CASE WHEN value > 150 THEN '" data_LEAK "' END,
           CASE WHEN k % 7 = 0 THEN '"port-scan"' END,
           CASE WHEN event_type = 'purchase' AND k < 20 THEN '"SQL-Injection"' END,
           CASE WHEN event_type = 'signup' AND value < 2 THEN '"privilege_escalation"' END) || ']' END AS label_json,
    'tenant' || (user_id % 4) || '/' || CASE event_type
      WHEN 'click' THEN 'web/logs/apache2/shop-access.log' WHEN 'view' THEN 'gate/logs/openvpn.log'
      WHEN 'error' THEN 'intranet_server/logs/apache2/intranet-error.log.1'
      WHEN 'signup' THEN 'intranet_server/logs/auth.log.2'
      WHEN 'purchase' THEN 'internal_share/logs/audit/audit.log' END AS rel_path,
    '[T' || k || ' ' || event_type || ' user=' || user_id || ']  amount ' || CAST(round(value * 100) AS BIGINT) AS line
  FROM ev),
lab AS (
  SELECT *,
    CASE WHEN NOT json_valid(label_json) OR json_type(label_json) = 'NULL' THEN []::VARCHAR[]
         WHEN json_type(label_json) = 'ARRAY' THEN list_sort(list_distinct(list_transform(
           list_filter(json_extract_string(label_json, '$[*]'), lambda x: x IS NOT NULL AND x <> ''),
           lambda x: trim(lower(replace(x, '-', '_'))))))
         ELSE [trim(lower(replace(json_extract_string(label_json, '$'), '-', '_')))] END AS labels,
    CASE event_type WHEN 'click' THEN 'wp-access' WHEN 'view' THEN 'vpn' WHEN 'error' THEN 'wp-error'
      WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'audit' END AS log_type
  FROM raw)"""


def labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.withColumn("labels", lb.labels_from_json(F.col("label_json"))).withColumn(
        "log_type", tx.log_type(F.col("rel_path")))


def event_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled events with class list, true bits, scores and predicted bits.

    The score mixes the truth with a fixed pattern over ids, in steps of 1/10000.
    """
    e = labelled_events(spark, sf)
    classes = F.array(*[F.lit(c) for c in CLASSES])
    e = e.withColumn("classes", classes).withColumn("y_true", lb.label_vector(F.col("labels"), F.col("classes")))
    steps = F.transform("y_true", lambda y, i: ((F.col("row_id") * 7919 + i * 104729) % 1000) * 6 + y * 4000)
    e = e.withColumn("scores", F.transform(steps, lambda s: s / F.lit(10000.0)))
    return e.withColumn("y_pred", F.transform("scores", lambda s: (s >= 0.5).cast("tinyint")))


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (event, class): y_true, score, y_pred."""
    e = labelled_events(spark, sf).select("row_id", "log_type", "labels")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("class")) for i, c in enumerate(CLASSES)]))
    c = e.select("row_id", "log_type", "labels", each.alias("c"))
    y = F.array_contains("labels", F.col("c.class")).cast("int")
    c = c.select("row_id", "log_type", F.col("c.class").alias("class"), y.alias("y_true"),
                 ((F.col("row_id") * 7919 + F.col("c.idx") * 104729) % 1000 * 6).alias("step"))
    step = F.col("step") + F.col("y_true") * 4000
    return c.select("row_id", "log_type", "class", "y_true", (step / F.lit(10000.0)).alias("score"),
                    (step >= 5000).cast("int").alias("y_pred"))


CELLS = EVENTS + """,
cls(idx, class) AS (VALUES (0, 'brute_force'), (1, 'data_leak'), (2, 'port_scan'), (3, 'privilege_escalation'),
  (4, 'sql_injection')),
cell0 AS (
  SELECT row_id, log_type, idx, class, CAST(list_contains(labels, class) AS INTEGER) AS y_true FROM lab, cls),
cell AS (
  SELECT row_id, log_type, class, y_true,
    (((row_id * 7919 + idx * 104729) % 1000) * 6 + y_true * 4000) / 10000.0::DOUBLE AS score,
    CAST(((row_id * 7919 + idx * 104729) % 1000) * 6 + y_true * 4000 >= 5000 AS INTEGER) AS y_pred
  FROM cell0),
conf AS (
  SELECT class, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn
  FROM cell GROUP BY class)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


VEC = "vec AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("message"),
                                                "lang", "source")


_TREES: dict = {}
# Files of a tree that a task writes, on average. Their number decides and not their bytes, since most of them are small.
FILES_A_TASK = 32


def by_files(lines: DataFrame, files: int, *keys: str) -> DataFrame:
    """Rows of one file in one task, and tasks in proportion to the files; a given number isn't merged again into a few large tasks."""
    return lines.repartition(max(1, -(-files // FILES_A_TASK)), *keys)


def log_tree(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Write documents as a tree of log files and labels as a tree of JSON label files; once per session and scale.

    One file holds the lines of one source and one run of 1000 documents.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        root = new_path(spark, "tree")
        docs = table(spark, sf, "documents")
        place = [F.col("source").alias("tenant"), F.floor(F.col("doc_id") / 1000).alias("host")]
        files = docs.select(*place).distinct().count()
        lines = docs.select(*place, "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
        (by_files(lines, files, "tenant", "host").sortWithinPartitions("tenant", "host", "doc_id", "pos")
         .select("tenant", "host", "value").write.partitionBy("tenant", "host").text(f"{root}/logs"))
        marks = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id")
        names = F.array_compact(F.array(F.when(F.col("toxic") == 1, "Toxic-Text"), F.when(F.col("quality") == 0, "low_quality")))
        item = F.to_json(F.struct((F.col("doc_id") % 97 + 1).alias("line"), names.alias("labels")))
        value = F.when(F.col("doc_id") % 50 == 0, '{"line": 5').otherwise(item)
        (by_files(marks.select(*place, "doc_id", value.alias("value")), files, "tenant", "host")
         .sortWithinPartitions("tenant", "host", "doc_id").select("tenant", "host", "value")
         .write.partitionBy("tenant", "host").text(f"{root}/labels"))
        _TREES[key] = (f"{root}/logs", f"{root}/labels")
    return _TREES[key]


def odd_tree(spark: SparkSession, sf: str) -> str:
    """Documents as gzipped logs by language: French below a folder whose name begins with _, German with a NUL in every line."""
    key = (spark.sparkContext.applicationId, sf, "odd")
    if key not in _TREES:
        root = new_path(spark, "odd")
        docs = table(spark, sf, "documents").withColumn("host", F.floor(F.col("doc_id") / 1000))
        lines = docs.select("lang", "host", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
        for place, mine in (("fr/_kept", F.col("lang") == "fr"), ("de/binary", F.col("lang") == "de"),
                            ("other/plain", ~F.coalesce(F.col("lang").isin("fr", "de"), F.lit(False)))):
            value = F.concat(F.lit("\0"), "value") if place.startswith("de") else F.col("value")
            (lines.where(mine).repartition("host").sortWithinPartitions("host", "doc_id", "pos").select("host", value.alias("value"))
             .write.partitionBy("host").option("compression", "gzip").text(f"{root}/{place}"))
        lines.limit(0).select("value").write.text(f"{root}/labels")
        _TREES[key] = root
    return _TREES[key]


def folder(path):
    """Folder of a relative path; the file names inside are chosen by the writer."""
    return F.regexp_replace(path, "/[^/]*$", "")


TREE = """split AS (
  SELECT 'tenant=' || source || '/host=' || CAST(floor(doc_id / 1000) AS BIGINT) AS folder, doc_id,
    string_split(text, chr(10)) AS parts FROM documents),
tline AS (
  SELECT folder, doc_id, unnest(parts) AS value, generate_subscripts(parts, 1) AS pos FROM split),
num AS (
  SELECT folder, value, row_number() OVER (PARTITION BY folder ORDER BY doc_id, pos) AS line_no FROM tline),
tlab AS (
  SELECT 'tenant=' || d.source || '/host=' || CAST(floor(d.doc_id / 1000) AS BIGINT) AS folder, d.doc_id % 97 + 1 AS line_no,
    list_filter([CASE WHEN toxic = 1 THEN 'Toxic-Text' END, CASE WHEN quality = 0 THEN 'low_quality' END],
      lambda x: x IS NOT NULL) AS labels,
    row_number() OVER (PARTITION BY d.source, CAST(floor(d.doc_id / 1000) AS BIGINT), d.doc_id % 97 ORDER BY d.doc_id DESC) AS rn
  FROM labels l JOIN documents d USING (doc_id) WHERE d.doc_id % 50 <> 0),
tlast AS (SELECT folder, line_no, labels FROM tlab WHERE rn = 1)"""
