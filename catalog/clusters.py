"""Clusters, neighbours and cluster quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import VEC, documents, vectors
from catalog.registry import query
from tracewright.functions import vectors as vc
from tracewright.operators import clustering as cl
from tracewright.operators import isolation as iso
from tracewright.operators import linkage as lk
from tracewright.operators import shared_scan as ss
from tracewright.operators.neighbors import nearest
from tracewright.operators.vector_stats import mean_agg, standardize
from tracewright.session import settle

NEAR = f"""{VEC}, near AS (SELECT a.row_id AS query_id, a.label AS mine, b.row_id AS neighbor_id, b.label AS their, list_distance(a.vec, b.vec) AS d,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.vec, b.vec), b.row_id) AS rank FROM vec a JOIN vec b ON a.row_id <> b.row_id)"""

STD = f"""{VEC}, su AS (SELECT row_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec),
ss AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM su GROUP BY 1),
sv AS (SELECT row_id, list((x - m) / d ORDER BY i) AS z FROM su JOIN ss USING (i) GROUP BY 1)"""


@query("j08_nearest", f"WITH {NEAR} SELECT query_id, rank, neighbor_id, round(d, 5) AS distance FROM near WHERE rank <= 5")
def nearest_rows(spark, sf):
    v = vectors(spark, sf)
    out = nearest(v, v, 5)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", F.round("distance", 5).alias("distance"))


@query("j08_nearest_of_class", f"""WITH {VEC}, n AS (SELECT a.row_id AS query_id, b.row_id AS neighbor_id,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.vec, b.vec), b.row_id) AS rank
  FROM vec a JOIN vec b ON a.row_id <> b.row_id AND a.label = b.label) SELECT query_id, rank, neighbor_id FROM n WHERE rank <= 3""")
def nearest_of_class(spark, sf):
    v = vectors(spark, sf)
    return nearest(v, v, 3, by="label").select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id")


# Clusters depend on draws; what must hold for any draw is compared: ids without a gap, and hardly any row that lies nearer
# to the mean of another cluster than to that of its own.
def _numbered_sql(k: str) -> str:
    return f"SELECT count(*) AS n_rows, {k} AS as_many_as_asked, true AS numbered_without_gap, true AS near_their_means FROM embeddings"


def _means(long, *keys):
    """Size, mean and mean squared length of every cluster, from labels as they were written."""
    return long.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), mean_agg("vec", 64).alias("m"), F.avg(vc.dot(F.col("vec"), F.col("vec"))).alias("mq"))


def _numbered(rows, k=None):
    rows = settle(rows.select("row_id", "cluster", vc.as_doubles(F.col("vec")).alias("vec")), "labelled")
    means = _means(rows).agg(F.collect_list(F.struct("cluster", "m")).alias("t")).scalar()  # at most twenty clusters
    near = F.array_min(F.transform("means", lambda c: F.struct(vc.squared_distance(F.col("vec"), c["m"]).alias("d"), c["cluster"].alias("c"))))
    strays = rows.withColumn("means", means).agg(F.count_if(near["c"] != F.col("cluster")).alias("s")).scalar()
    gapless = (F.min("cluster") == 0) & (F.max("cluster") + 1 == F.count_distinct("cluster")) & (F.count_distinct("row_id") == F.count("*"))
    many = F.count_distinct("cluster").between(2, 20) if k is None else F.count_distinct("cluster") == k
    return rows.agg(F.count("*").alias("n_rows"), many.alias("as_many_as_asked"), gapless.alias("numbered_without_gap"), F.count("*").alias("n")).select(
        "n_rows", "as_many_as_asked", "numbered_without_gap", (strays * 50 <= F.col("n")).alias("near_their_means"))


@query("c01_pseudo_labels", _numbered_sql("true"))
def pseudo_labels(spark, sf):
    """The number of clusters is searched from 2 to 20; labels on standardized vectors."""
    scaled = settle(standardize(vectors(spark, sf), "vec"), "scaled")
    found = cl.pseudo_labels(scaled, "vec").select("row_id", "cluster", F.col("scaled").alias("vec"))
    return _numbered(found)


@query("c02_silhouette_by_k", "SELECT unnest(range(2, least(20, (SELECT count(*) FROM embeddings) // 10)::INTEGER + 1))::INTEGER AS k, true AS as_by_labels")
def silhouette_by_k(spark, sf):
    """Every silhouette is taken again from the written labels: the mean squared distance to a cluster is
    q + mean(q of its rows) - 2 x * mean(x of its rows)."""
    rows = settle(standardize(vectors(spark, sf), "vec").select("row_id", F.col("scaled").alias("vec")), "scaled")
    found = cl.k_search(rows, "vec")
    labelled = settle(ss.assign(rows, "vec", {f"k{m.k}": m for m, _ in found}), "labelled")
    again = ss.labelled_silhouettes(labelled, "vec", [f"k{m.k}" for m, _ in found]).select(F.substring("labels", 2, 3).cast("int").alias("k"), F.col("silhouette").alias("again"))
    told = spark.createDataFrame([(m.k, s) for m, s in found], "k int, silhouette double")
    return told.join(again, "k").select("k", (F.abs(F.col("silhouette") - F.col("again")) < 1e-9).alias("as_by_labels"))


EPS = 9.2


DENSE = f"""{STD}, pr AS (SELECT a.row_id AS a, b.row_id AS b FROM sv a JOIN sv b ON list_distance(a.z, b.z) <= {EPS}),
  core AS (SELECT a FROM pr GROUP BY a HAVING count(*) >= 3),
  ed AS (SELECT a, b FROM pr WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
  reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, e.b FROM reach r JOIN ed e ON r.b = e.a),
  comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
  lab AS (SELECT a AS row_id, c FROM comp UNION ALL SELECT p.a, min(c.c) FROM pr p JOIN comp c ON p.b = c.a WHERE p.a NOT IN (SELECT a FROM core) GROUP BY p.a),
  num AS (SELECT c, (dense_rank() OVER (ORDER BY c) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT c FROM lab)),
  got AS (SELECT row_id, cluster FROM lab JOIN num USING (c))"""


@query("c03_dbscan", f"WITH RECURSIVE {DENSE} SELECT v.row_id, coalesce(cluster, -1) AS cluster FROM vec v LEFT JOIN got USING (row_id)")
def dbscan(spark, sf):
    rows = settle(standardize(vectors(spark, sf), "vec"), "scaled")
    return cl.dbscan(rows, "scaled", EPS, 3, fill_noise=False).select("row_id", "cluster")


@query("c03_dbscan_noise_filled", f"""WITH RECURSIVE {DENSE}, far AS (SELECT n.row_id, g.cluster,
    row_number() OVER (PARTITION BY n.row_id ORDER BY list_distance(n.z, o.z), o.row_id) AS rn
    FROM sv n JOIN sv o ON n.row_id NOT IN (SELECT row_id FROM got) JOIN got g ON g.row_id = o.row_id)
  SELECT row_id, cluster FROM got UNION ALL SELECT row_id, cluster FROM far WHERE rn = 1""")
def dbscan_filled(spark, sf):
    rows = settle(standardize(vectors(spark, sf), "vec"), "scaled")
    return cl.dbscan(rows, "scaled", EPS, 3).select("row_id", "cluster")


@query("c04_level_clusters", _numbered_sql("true"))
def level_clusters(spark, sf):
    scaled = settle(standardize(vectors(spark, sf), "vec"), "scaled")
    return _numbered(cl.level_clusters(scaled, "vec", 4).select("row_id", "cluster", F.col("scaled").alias("vec")), 4)


@query("c05_bisecting_clusters", "SELECT count(*) AS n_rows, 4 AS n_clusters, count(*) * 0 AS centroids_off FROM embeddings")
def bisecting_clusters(spark, sf):
    """Rows and clusters of the summary, and centroids that aren't the mean of their rows."""
    out = settle(cl.level_clusters(vectors(spark, sf), "vec", 4, method="bisecting"), "clusters")
    means = out.groupBy("cluster").agg(F.avg(F.col("vec")[0].cast("double")).alias("m"))
    rows = cl.cluster_summary(out, "cluster", "vec").join(means, "cluster")
    return rows.agg(F.sum("n_rows").alias("n_rows"), F.count("*").cast("int").alias("n_clusters"),
                    F.count_if(F.abs(F.col("centroid")[0] - F.col("m")) > 1e-9).alias("centroids_off"))


@query("c06_level_pseudo_labels")
def level_pseudo_labels(spark, sf):
    return cl.level_pseudo_labels(vectors(spark, sf), "vec").select("row_id", "level_0", "level_1", "level_2")


@query("c06_levels", """SELECT level, true AS as_many_as_asked, true AS numbered_without_gap, true AS near_their_means, count(*) AS n_rows
  FROM embeddings, (SELECT unnest([0, 1, 2]) AS level) GROUP BY level""")
def levels_of_pseudo_labels(spark, sf):
    """The number of clusters of a level is min(8, max(2, n / (10 * (level + 1))))."""
    rows = settle(cl.level_pseudo_labels(vectors(spark, sf), "vec"), "levels")
    n = rows.count()
    parts = [_numbered(rows.withColumn("cluster", F.col(f"level_{i}")), min(8, max(2, n // (10 * (i + 1))))).withColumn("level", F.lit(i)) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c05_ward_merges", """WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT i, avg(x) AS m FROM u GROUP BY 1)
  SELECT (SELECT count(*) FROM embeddings) - 1 AS n_merges, (SELECT count(*) FROM embeddings) - 1 AS n_joined,
    (SELECT count(*) FROM embeddings) AS largest, round(sum((x - m) * (x - m)), 3) AS squares FROM u JOIN m USING (i)""")
def ward_merges(spark, sf):
    """Half the squared heights of all merges add up to the sum of squares around the mean of all rows."""
    merges = settle(lk.ward_merges(vectors(spark, sf), "vec"), "merges")
    return merges.agg(F.count("*").alias("n_merges"), F.count_distinct("b").alias("n_joined"), F.max("size").alias("largest"),
                      F.round(F.sum(F.col("height") * F.col("height")) / 2, 3).alias("squares"))


@query("c05_agglomerative_clusters", "SELECT count(*) AS n_rows, 4 AS n_clusters, 0 AS first, 3 AS last FROM embeddings")
def agglomerative_clusters(spark, sf):
    return cl.level_clusters(vectors(spark, sf), "vec", 4, method="agglomerative").agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster").cast("int").alias("n_clusters"), F.min("cluster").alias("first"), F.max("cluster").alias("last"))


@query("h06_isolation_forest", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 250 = 0) AS p FROM embeddings)
  SELECT n AS n_rows, ceil(n * 0.1)::BIGINT - 1 AS n_flagged, p AS n_planted, p AS planted_first FROM n""")
def isolation_forest(spark, sf):
    """Every 250th row is moved far out. All of these must be ranked first, and the cut must flag the rows below a tenth."""
    moved = F.transform(vc.as_doubles(F.col("vec")), lambda x: F.when(F.col("row_id") % 250 == 0, x * 12).otherwise(x))
    rows = settle(vectors(spark, sf).select("row_id", moved.alias("vec")), "moved")
    scored = settle(iso.flag_outliers(iso.score(rows, "vec", iso.fit(rows, "vec")), 0.1), "scored")
    planted = F.col("row_id") % 250 == 0
    others = scored.where(~planted).agg(F.max("outlier_score").alias("m")).scalar()
    return scored.agg(F.count("*").alias("n_rows"), F.count_if("is_outlier").alias("n_flagged"), F.count_if(planted).alias("n_planted"),
                      F.count_if(planted & (F.col("outlier_score") > others)).alias("planted_first"))


@query("c07_cluster_quality")
def cluster_quality(spark, sf):
    c = settle(cl.kmeans(vectors(spark, sf), "vec", 5), "clustered")
    return (cl.silhouette(c, "vec", "cluster").withColumn("ari", cl.adjusted_rand(c, "label", "cluster").scalar())
            .withColumn("nmi", cl.mutual_information(c, "label", "cluster").scalar()))


@query("c08_silhouette", f"""WITH {VEC}, d AS (SELECT a.row_id, a.label AS l, b.label AS o, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n
    FROM vec a JOIN vec b ON a.row_id <> b.row_id GROUP BY 1, 2, 3),
  q AS (SELECT row_id, max(s / n) FILTER (l = o) AS a, min(s / n) FILTER (l <> o) AS b FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM q""")
def silhouette(spark, sf):
    return cl.silhouette(vectors(spark, sf), "vec", "label").select(F.round("silhouette", 5).alias("silhouette"))


@query("c08_silhouette_squared", f"""WITH {VEC}, d AS (SELECT a.row_id, a.label AS l, b.label AS o, sum(list_distance(a.vec, b.vec) ** 2) AS s, count(*) AS n
    FROM vec a JOIN vec b ON a.row_id <> b.row_id GROUP BY 1, 2, 3),
  q AS (SELECT row_id, max(s / n) FILTER (l = o) AS a, min(s / n) FILTER (l <> o) AS b FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM q""")
def silhouette_squared(spark, sf):
    return cl.silhouette_squared(vectors(spark, sf), "vec", "label").select(F.round("silhouette", 5).alias("silhouette"))


CONT = """ct AS (SELECT lang AS t, source AS c, count(*) AS n FROM documents GROUP BY 1, 2),
rt AS (SELECT t, sum(n) AS n FROM ct GROUP BY 1), rc AS (SELECT c, sum(n) AS n FROM ct GROUP BY 1), al AS (SELECT sum(n) AS n FROM ct)"""


@query("c09_adjusted_rand", f"""WITH {CONT}, p AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS s, (SELECT sum(n * (n - 1) / 2.0) FROM rt) AS a,
    (SELECT sum(n * (n - 1) / 2.0) FROM rc) AS b, (SELECT n * (n - 1) / 2.0 FROM al) AS z)
  SELECT round((s - a * b / z) / ((a + b) / 2 - a * b / z), 6) AS ari FROM p""")
def adjusted_rand(spark, sf):
    return cl.adjusted_rand(documents(spark, sf), "lang", "source").select(F.round("ari", 6).alias("ari"))


@query("c10_mutual_information", f"""WITH {CONT}, mi AS (SELECT sum(ct.n / al.n * ln(ct.n * al.n / (rt.n * rc.n))) AS x FROM ct JOIN rt USING (t) JOIN rc USING (c), al),
  h AS (SELECT (SELECT -sum(rt.n / al.n * ln(rt.n / al.n)) FROM rt, al) AS t, (SELECT -sum(rc.n / al.n * ln(rc.n / al.n)) FROM rc, al) AS c)
  SELECT round(x / ((t + c) / 2), 6) AS nmi FROM mi, h""")
def mutual_information(spark, sf):
    return cl.mutual_information(documents(spark, sf), "lang", "source").select(F.round("nmi", 6).alias("nmi"))


@query("h06_outlier_scores", f"""WITH {VEC}, u AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
  c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT row_id, round(list_distance(vec, c), 5) AS outlier_score FROM vec JOIN c USING (label)""")
def outlier_scores(spark, sf):
    return cl.distance_to_centroid(vectors(spark, sf), "label", "vec").select("row_id", F.round("outlier_score", 5).alias("outlier_score"))
