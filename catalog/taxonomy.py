"""Taxonomy lookups, mapping and path prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import EVENTS, VEC, event_vectors, labelled_events, vectors
from catalog.registry import query
from tracewright.operators import taxonomy as tn
from tracewright.session import settle


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else
                                     "[" + ", ".join(f"'{c}'" for c in v) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'"
                                     for v in r) + ")" for r in rows)


NODES = f"nodes(level, name, parent, children) AS (VALUES {_values(tn.NODES)})"



def _named(spark, sf):
    """Every distinct token of the event types and labels, with its number of rows."""
    e = labelled_events(spark, sf)
    names = e.select(F.explode(F.concat("labels", F.array(F.concat("event_type", F.lit("_attacks"))))).alias("label"))
    return names.groupBy("label").agg(F.count("*").alias("n"))


NAMED = EVENTS + """, nm AS (SELECT label, count(*) AS n FROM (SELECT unnest(list_concat(labels, [event_type || '_attacks'])) AS label FROM lab) GROUP BY 1)"""


@query("h01_level_nodes", f"""WITH {NAMED}, {NODES}, l AS (SELECT level, array_to_string(list(name ORDER BY name), ',') AS nodes FROM nodes GROUP BY 1),
  m AS (SELECT nodes.level, sum(n)::BIGINT AS n_rows FROM nm JOIN nodes ON nodes.name = nm.label GROUP BY 1) SELECT level, nodes, coalesce(n_rows, 0)::BIGINT AS n_rows FROM l LEFT JOIN m USING (level)""")
def level_nodes(spark, sf):
    """Nodes per level with the number of log rows labelled with one of them."""
    tax = tn.taxonomy_table(spark)
    used = tn.node_level(_named(spark, sf).withColumnRenamed("label", "name"), tax)
    hits = _named(spark, sf).withColumnRenamed("label", "name").join(used, "name").groupBy("level").agg(F.sum("n").alias("n_rows"))
    return tn.level_nodes(tax).join(hits, "level", "left").select("level", F.array_join("nodes", ",").alias("nodes"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


@query("h02_root_paths", f"""WITH RECURSIVE {NAMED}, {NODES}, walk(name, path) AS (SELECT name, name FROM nodes WHERE parent IS NULL
    UNION ALL SELECT n.name, w.path || '/' || n.name FROM nodes n JOIN walk w ON n.parent = w.name)
  SELECT label, coalesce(path, 'none') AS path, n FROM nm LEFT JOIN walk ON walk.name = nm.label""")
def root_paths(spark, sf):
    paths = tn.root_paths(tn.taxonomy_table(spark)).select(F.col("name").alias("label"), F.array_join("path", "/").alias("path"))
    return _named(spark, sf).join(paths, "label", "left").select("label", F.coalesce("path", F.lit("none")).alias("path"), "n")


@query("h03_levels_children", f"""WITH {NAMED}, {NODES} SELECT nm.label AS name, coalesce(level, -1) AS level, coalesce(array_to_string(children, ','), '') AS children
  FROM nm LEFT JOIN nodes ON nodes.name = nm.label""")
def levels_children(spark, sf):
    out = tn.node_level(_named(spark, sf).select(F.col("label").alias("name")), tn.taxonomy_table(spark))
    return out.select("name", "level", F.array_join("children", ",").alias("children"))


@query("h04_j07_type_mapping", f"""WITH {NAMED}, {NODES}, w AS (SELECT label, list_filter(string_split(translate(lower(label), '_-', '  '), ' '), lambda x: x <> '') AS words FROM nm),
  s AS (SELECT label, name, level, list_position([{", ".join(f"'{n[1]}'" for n in tn.NODES)}], name) AS ord, len(list_intersect(list_distinct(words), string_split(name, '_')))::DOUBLE / greatest(len(words), 1) AS score FROM w, nodes),
  b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn FROM s WHERE score > 0.3)
  SELECT w.label, coalesce(name, 'anomaly') AS node, round(coalesce(score, 0), 6) AS score FROM w LEFT JOIN b ON b.label = w.label AND rn = 1""")
def type_mapping(spark, sf):
    return tn.map_attack_types(_named(spark, sf)).withColumn("score", F.round("score", 6))


def _levels(spark, sf):
    """Level classes and confidences made of an event's numbers."""
    e = event_vectors(spark, sf)
    return e.select("row_id", (F.col("k") % 3).alias("class_0"), (0.3 + (F.col("k") % 10) * 0.07).alias("confidence_0"),
                    (F.col("user_id") % 5).cast("int").alias("class_1"), (0.2 + (F.col("row_id") % 10) * 0.08).alias("confidence_1"),
                    (F.col("row_id") % 6).cast("int").alias("class_2"), (0.25 + (F.col("user_id") % 7) * 0.1).alias("confidence_2"))


CHILD = "CASE WHEN len(children) = 0 THEN NULL WHEN {c} < len(children) THEN children[{c} + 1] ELSE children[1] END"
PATHS = f"""{EVENTS}, {NODES}, lv AS (SELECT row_id, k % 3 AS c0, k % 10 >= 3 AS ok0, user_id % 5 AS c1, row_id % 10 >= 4 AS ok1, row_id % 6 AS c2, user_id % 7 >= 3 AS ok2,
    0.3 + (k % 10) * 0.07 AS f0, 0.2 + (row_id % 10) * 0.08 AS f1, 0.25 + (user_id % 7) * 0.1 AS f2 FROM lab),
p1 AS (SELECT lv.*, CASE WHEN ok0 THEN {CHILD.format(c='c0')} END AS n1 FROM lv JOIN nodes ON nodes.name = 'root'),
p2 AS (SELECT p1.*, CASE WHEN ok1 THEN {CHILD.format(c='c1')} END AS n2 FROM p1 LEFT JOIN nodes ON nodes.name = n1),
p3 AS (SELECT p2.*, CASE WHEN ok2 THEN {CHILD.format(c='c2')} END AS n3 FROM p2 LEFT JOIN nodes ON nodes.name = n2),
path AS (SELECT row_id, concat_ws('/', 'root', n1, n2, n3) AS path, 1 + (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT AS len,
    (1 + CASE WHEN n1 IS NOT NULL THEN f0 ELSE 0 END + CASE WHEN n2 IS NOT NULL THEN f1 ELSE 0 END + CASE WHEN n3 IS NOT NULL THEN f2 ELSE 0 END)::DOUBLE AS fsum,
    coalesce(n3, n2, n1, 'unknown') AS final_prediction, n1, n2, n3,
    CASE WHEN n1 IS NULL THEN 0.5 WHEN n1 = 'anomaly' THEN 0.7 + CASE WHEN n2 IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN n3 IS NOT NULL THEN 0.1 ELSE 0 END ELSE 0.0 END::DOUBLE AS score FROM p3)"""


def _paths(spark, sf):
    return tn.predict_paths(_levels(spark, sf), [(f"class_{i}", f"confidence_{i}") for i in range(3)], 0.5)


@query("h07_h08_j06_predicted_paths", f"WITH {PATHS} SELECT row_id, path, final_prediction, round(score, 4) AS anomaly_score FROM path")
def predicted_paths(spark, sf):
    return _paths(spark, sf).select("row_id", F.array_join("path", "/").alias("path"), "final_prediction", F.round("anomaly_score", 4).alias("anomaly_score"))


@query("a15_prediction_summary", f"""WITH {PATHS} SELECT count(*) AS n_samples, round(avg(fsum / len), 6) AS average_confidence, round(avg(len), 6) AS average_path_length,
  round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM path""")
def prediction_summary(spark, sf):
    out = tn.prediction_summary(_paths(spark, sf))
    return out.select("n_samples", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("a15_prediction_distribution", f"WITH {PATHS} SELECT final_prediction, count(*) AS n_rows FROM path GROUP BY 1")
def prediction_distribution(spark, sf):
    return tn.prediction_distribution(_paths(spark, sf))


@query("a16_level_distribution", f"""WITH {PATHS}, l AS (SELECT 0 AS level, 'root' AS node FROM path UNION ALL SELECT 1, coalesce(n1, 'unknown') FROM path UNION ALL SELECT 2, coalesce(n2, 'unknown') FROM path)
  SELECT level, node, count(*) AS n_rows, round(sum(count(*) FILTER (node <> 'unknown')) OVER (PARTITION BY level) / sum(count(*)) OVER (PARTITION BY level), 6) AS coverage FROM l GROUP BY 1, 2""")
def level_distribution(spark, sf):
    return tn.level_distribution(_paths(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query("h10_path_consistency", f"""WITH {PATHS}, c AS (SELECT path, string_split(path, '/') AS s, count(*) AS n FROM path GROUP BY 1), t AS (SELECT sum(n) AS n FROM c)
  SELECT round((SELECT sum(CASE WHEN a.path = b.path THEN a.n * (a.n - 1) ELSE a.n * b.n END * (len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))))) FROM c a, c b) / (n * (n - 1)), 6) AS path_consistency FROM t""")
def path_consistency(spark, sf):
    return tn.path_consistency(_paths(spark, sf)).select(F.round("path_consistency", 6).alias("path_consistency"))


@query("h11_level_hit_rate", f"""WITH {PATHS} SELECT level, 1.0::DOUBLE AS hit_rate, (SELECT max(len) FROM path) / 4.0::DOUBLE AS level_coverage
  FROM (SELECT DISTINCT unnest(range(len))::INTEGER AS level FROM path)""")
def level_hit_rate(spark, sf):
    return tn.level_hit_rate(_paths(spark, sf))


@query("h05_h09_trained_paths")
def trained_paths(spark, sf):
    """Train all levels on the vectors and predict."""
    rows = settle(vectors(spark, sf).select("row_id", "vec"), "rows")
    out = tn.fit_predict(rows, "vec")
    return out.select("row_id", "path", "final_prediction", "anomaly_score")


@query("h06_outlier_cut", f"""WITH {VEC}, u AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
  c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT -list_distance(vec, c) AS s FROM vec JOIN c USING (label)),
  r AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM s) SELECT round(s, 5) AS threshold FROM r WHERE rn = ceil(n * 0.1)""")
def outlier_cut(spark, sf):
    rows = settle(vectors(spark, sf).withColumnRenamed("label", "cluster"), "rows")
    return tn.outlier_cut(rows, "vec").select(F.round("threshold", 5).alias("threshold"))
