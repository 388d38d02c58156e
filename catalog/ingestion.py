"""Log and label trees, compact tables, feature tables, manifests, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    CELLS, EVENTS, TREE, event_vectors, events, folder, labelled_events, log_tree, odd_tree, table, vectors)
from catalog.registry import query
from tracewright.functions import text as tx
from tracewright.operators import checks as ck
from tracewright.operators.joining import remaining
from tracewright.plans import ingest
from tracewright.session import new_path
from tracewright.sources import logs as lg
from tracewright.sources import tables as tb


@query("s01_s14_file_listing", f"WITH {TREE} SELECT folder, count(*) AS n_lines FROM num GROUP BY 1")
def file_listing(spark, sf):
    """Files below the root, each with its number of lines."""
    logs, _ = log_tree(spark, sf)
    files = lg.list_files(spark, logs).select("rel_path", "bytes")
    lines = lg.number_lines(lg.scan_lines(spark, logs), logs).groupBy("rel_path").agg(F.max("line_no").alias("n_lines"))
    return files.join(lines, "rel_path").select(folder("rel_path").alias("folder"), "n_lines")


@query("s02_s03_line_numbers", f"WITH {TREE} SELECT folder, line_no, md5(value) AS digest FROM num WHERE trim(value) <> ''")
def line_numbers(spark, sf):
    logs, _ = log_tree(spark, sf)
    return lg.read_log_lines(spark, logs).select(folder("rel_path").alias("folder"), "line_no", F.md5("value").alias("digest"))


@query("s04_s05_label_rows", f"WITH {TREE} SELECT folder, line_no, array_to_string(labels, ',') AS labels FROM tlast")
def label_rows(spark, sf):
    _, labels = log_tree(spark, sf)
    return lg.read_labels(spark, labels).select(folder("rel_path").alias("folder"), "line_no",
                                                F.array_join("labels", ",").alias("labels"))


@query("s06_text_files", f"WITH {TREE} SELECT DISTINCT folder FROM num")
def text_files(spark, sf):
    logs, _ = log_tree(spark, sf)
    return lg.text_files(lg.scan_lines(spark, logs), logs).select(folder("rel_path").alias("folder"))


@query("s06_text_and_binary", """SELECT DISTINCT CASE WHEN lang = 'fr' THEN 'fr/_kept' ELSE 'other/plain' END || '/host=' || floor(doc_id / 1000)::BIGINT AS folder
  FROM documents WHERE lang IS DISTINCT FROM 'de'""")
def text_and_binary_files(spark, sf):
    """Files with NUL bytes aren't text, those below a folder whose name begins with _ are."""
    root = odd_tree(spark, sf)
    return lg.text_files(lg.scan_lines(spark, root), root).select(folder("rel_path").alias("folder")).distinct()


@query("j01_labelled_lines", f"""WITH {TREE} SELECT n.folder, split_part(n.folder, '/', 1) AS tenant, n.line_no,
  array_to_string(list_transform(coalesce(t.labels, []), lambda x: lower(replace(x, '-', '_'))), ',') AS labels
  FROM num n LEFT JOIN tlast t USING (folder, line_no) WHERE trim(n.value) <> ''""")
def labelled_lines(spark, sf):
    """Whole ingestion job: scan, number, label, type, compact. Label files carry another name, so match by folder."""
    logs, labels = log_tree(spark, sf)
    named = F.concat(folder("rel_path"), F.lit("/access.log"))
    lines = lg.read_log_lines(spark, logs).withColumn("rel_path", named)
    out = ingest.compact_records(lines, lg.read_labels(spark, labels).withColumn("rel_path", named))
    return out.select(folder("rel_path").alias("folder"), "tenant", "line_no", F.array_join("labels", ",").alias("labels"))


@query("r07_ingest_job", """WITH l AS (SELECT doc_id, lang, floor(doc_id / 1000)::BIGINT AS host, unnest(string_split(text, chr(10))) AS v,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE lang IS DISTINCT FROM 'de'),
  p AS (SELECT *, CASE WHEN lang = 'fr' THEN 'fr/_kept' ELSE 'other/plain' END AS place FROM l),
  n AS (SELECT place || '/host=' || host AS folder, v, row_number() OVER (PARTITION BY place, host ORDER BY doc_id, pos) AS line_no,
    regexp_extract(v, '^(\\S+\\s+\\S+\\s+\\S+)', 1) AS h FROM p)
  SELECT folder, split_part(folder, '/', 1) AS tenant, line_no, CASE WHEN h = '' THEN 'N/A' ELSE h END AS log_ts_text,
    md5(regexp_replace(substr(v, length(h) + 1), '^\\s+|\\s+$', '', 'g')) AS message_digest, 0 AS n_labels
  FROM n WHERE regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> ''""")
def ingest_job(spark, sf):
    """The ingestion plan as it stands: hidden folder read, binary files left out, no label files."""
    root = odd_tree(spark, sf)
    out = ingest.labelled_logs(spark, root, f"{root}/labels")
    return out.select(folder("rel_path").alias("folder"), "tenant", "line_no", "log_ts_text", F.md5("message").alias("message_digest"),
                      F.size("labels").alias("n_labels"))


@query("j02_label_file_match", f"""WITH {EVENTS}, f AS (SELECT DISTINCT rel_path AS p, regexp_extract(rel_path, '[^/]*$') AS name,
    'lab/' || rel_path || CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.json' ELSE '.7' END AS lp FROM raw),
  l AS (SELECT DISTINCT p, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.[^.]*$') AS suf FROM f),
  c AS (SELECT DISTINCT lp, regexp_extract(lp, '[^/]*$') AS name, regexp_extract(lp, '\\.[^./]*$') AS suf FROM f),
  m AS (SELECT l.p, c.lp, row_number() OVER (PARTITION BY l.p ORDER BY CASE WHEN l.suf = c.suf THEN 0
    WHEN regexp_matches(l.suf, '^\\.[0-9]+$') AND regexp_matches(c.suf, '^\\.[0-9]+$') THEN 1 ELSE 2 END, c.lp) AS rn
    FROM l JOIN c ON starts_with(c.name, l.stem))
  SELECT p AS log_path, lp AS label_path FROM m WHERE rn = 1""")
def label_file_match(spark, sf):
    e = events(spark, sf)
    ending = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, ".json").otherwise(".7")
    labels = e.select(F.concat(F.lit("lab/"), F.col("rel_path"), ending).alias("rel_path")).distinct()
    return lg.match_label_files(e.select("rel_path").distinct(), labels)


@query("j05_features_with_labels", f"""WITH {CELLS} SELECT v.vec_id AS row_id, round(list_sum(v.embedding::DOUBLE[]), 6) AS total,
  max(y_true) AS is_attack FROM embeddings v JOIN cell c ON c.row_id = v.vec_id GROUP BY v.vec_id, v.embedding""")
def features_with_labels(spark, sf):
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    left = vectors(spark, sf).select("row_id", F.round(total, 6).alias("total"))
    right = event_vectors(spark, sf).select("row_id", F.array_max("y_true").cast("int").alias("is_attack"))
    return left.join(right, "row_id")


@query("j09_s13_missing_outputs", f"""WITH {EVENTS}, m AS (SELECT log_type, 'part' || (k % 4) AS artefact FROM lab WHERE k % 4 < 2 OR event_type <> 'click')
  SELECT DISTINCT log_type FROM lab WHERE log_type NOT IN (SELECT log_type FROM m GROUP BY 1 HAVING count(DISTINCT artefact) = 4)""")
def missing_outputs(spark, sf):
    e = labelled_events(spark, sf)
    manifest = e.where((F.col("k") % 4 < 2) | (F.col("event_type") != "click")).select(
        "log_type", F.concat(F.lit("part"), (F.col("k") % 4).cast("string")).alias("artefact"))
    return tb.missing_outputs(e.select("log_type").distinct(), manifest, [f"part{i}" for i in range(4)])


@query("u04_remaining_labels", f"""WITH {EVENTS}, d AS (SELECT DISTINCT log_type, unnest(labels) AS label FROM lab)
  SELECT log_type, label FROM d WHERE label NOT IN (SELECT label FROM d WHERE log_type = 'auth')""")
def remaining_labels(spark, sf):
    pairs = labelled_events(spark, sf).select("log_type", F.explode("labels").alias("label")).distinct()
    return remaining(pairs, pairs.where(F.col("log_type") == "auth"), ["label"]).select("log_type", "label")


@query("s07_s08_compact_table", f"""WITH {EVENTS} SELECT log_type, count(*) AS n, count(DISTINCT rel_path) AS n_files,
  sum(len(labels))::BIGINT AS n_labels FROM lab WHERE log_type IN ('wp-error', 'vpn') GROUP BY 1""")
def compact_table(spark, sf):
    """Write the compact table by type, read two types back."""
    path = new_path(spark, "compact")
    rows = labelled_events(spark, sf).select("rel_path", F.col("row_id").alias("line_no"), F.col("line").alias("value"), "labels")
    tb.write_compact(ingest.compact_records(rows.drop("labels"), rows.select("rel_path", "line_no", "labels")), path)
    both = tb.read_compact(spark, path, "vpn").unionByName(tb.read_compact(spark, path, "wp-error"))
    return both.groupBy("log_type").agg(F.count("*").alias("n"), F.count_distinct("rel_path").alias("n_files"),
                                        F.sum(F.size("labels")).alias("n_labels"))


@query("s09_s10_feature_tables", """SELECT 'class' || label AS log_type, 'plain' AS embedding_type, count(*) AS n FROM embeddings
  WHERE label % 2 = 0 GROUP BY 1, 2""")
def feature_tables(spark, sf):
    """Write features by type, read them back, keep the pairs that also have labels."""
    path = new_path(spark, "features")
    rows = vectors(spark, sf).select("row_id", F.col("vec").alias("embedding"), F.lit("plain").alias("embedding_type"),
                                     F.concat(F.lit("class"), "label").alias("log_type"), F.array(F.col("label")).alias("label_vector"))
    tb.write_features(rows, path)
    back = tb.read_features(spark, path, embedding_type="plain")
    labels = rows.where(F.col("label_vector")[0] % 2 == 0).select("log_type", "embedding_type")
    pairs = tb.available_pairs(back, labels)
    return back.join(pairs, ["log_type", "embedding_type"], "left_semi").groupBy("log_type", "embedding_type").agg(F.count("*").alias("n"))


@query("s12_result_sinks", f"""WITH {EVENTS} SELECT log_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM lab GROUP BY 1""")
def result_sinks(spark, sf):
    """Metrics to CSV and JSON and back."""
    path = new_path(spark, "sinks")
    out = labelled_events(spark, sf).groupBy("log_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    tb.write_csv(out, f"{path}/csv")
    tb.write_json(out, f"{path}/json")
    a = spark.read.schema("log_type string, n bigint, mean_value double").option("header", True).csv(f"{path}/csv")
    b = spark.read.schema("log_type string, n bigint, mean_value double").json(f"{path}/json")
    return a.join(b, ["log_type", "n", "mean_value"], "left_semi")


@query("s14_size_classes", f"""WITH {EVENTS}, s AS (SELECT log_type, floor(sum(length(line)) / 100)::BIGINT AS estimated_rows FROM lab GROUP BY 1)
  SELECT log_type, estimated_rows, CASE WHEN estimated_rows < 10000 THEN 'small' WHEN estimated_rows < 100000 THEN 'medium'
    WHEN estimated_rows < 500000 THEN 'large' ELSE 'very_large' END AS size_class FROM s""")
def size_classes(spark, sf):
    files = labelled_events(spark, sf).groupBy("log_type", "rel_path").agg(F.sum(F.length("line")).alias("bytes"))
    return tb.estimate_sizes(files)


@query("s14_exact_sizes", """SELECT lang AS log_type, count(*) AS n_rows, CASE WHEN count(*) < 10000 THEN 'small'
  WHEN count(*) < 100000 THEN 'medium' WHEN count(*) < 500000 THEN 'large' ELSE 'very_large' END AS size_class FROM documents GROUP BY 1""")
def exact_sizes(spark, sf):
    return tb.count_sizes(table(spark, sf, "documents").withColumnRenamed("lang", "log_type"))


@query("p04_hidden_files", """SELECT count(*) FILTER (page_id % 5 <> 0) AS kept FROM pages""")
def hidden_files(spark, sf):
    name = F.concat(F.lit("a/"), F.when(F.col("page_id") % 5 == 0, ".").otherwise(""), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select(name.alias("p")).where(~tx.is_hidden(F.col("p"))).agg(F.count("*").alias("kept"))


VALID = """chk AS (SELECT rel_path AS file, row_id, CASE WHEN k = 3 THEN '' ELSE line END AS log,
    (k = 3)::INTEGER AS bad_log, CASE WHEN json_valid(label_json) THEN (json_type(label_json) <> 'ARRAY')::INTEGER ELSE 1 END AS bad_labels,
    (k = 5)::INTEGER AS bad_type FROM raw)"""


def _records(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("rel_path").alias("file"), F.col("row_id").alias("line_no"),
                    F.when(F.col("k") == 3, "").otherwise(F.col("line")).alias("log"), F.col("label_json").alias("labels"),
                    F.when(F.col("k") != 5, "x").alias("log_type"))


@query("r01_validate_records", f"""WITH {EVENTS}, {VALID} SELECT file, count(*) AS n_records, sum(bad_log)::BIGINT AS bad_log,
  sum(bad_labels)::BIGINT AS bad_labels, sum(bad_type)::BIGINT AS bad_type, sum(bad_log + bad_labels + bad_type) = 0 AS valid FROM chk GROUP BY 1""")
def validate_records(spark, sf):
    return ck.validate_files(_records(spark, sf))


@query("r01_t09_validate_heads", f"""WITH {EVENTS}, {VALID}, h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_id) AS rn FROM chk)
  SELECT file, count(*) AS n_records, sum(bad_log)::BIGINT AS bad_log, sum(bad_labels)::BIGINT AS bad_labels,
  sum(bad_type)::BIGINT AS bad_type, sum(bad_log + bad_labels + bad_type) = 0 AS valid FROM h WHERE rn <= 5 GROUP BY 1""")
def validate_heads(spark, sf):
    return ck.validate_files(_records(spark, sf), head=5)


@query("r02_validate_dataset", f"""WITH {EVENTS}, {VALID}, f AS (SELECT file, sum(bad_log + bad_labels + bad_type) = 0 AS valid FROM chk GROUP BY 1)
  SELECT count(*) AS n_files, coalesce(bool_and(valid), false) AS valid FROM f""")
def validate_dataset(spark, sf):
    return ck.validate_dataset(ck.validate_files(_records(spark, sf)))
