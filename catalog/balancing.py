"""Oversampling variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.clusters import NEAR
from catalog.inputs import VEC, event_vectors, vectors
from catalog.registry import query
from tracewright.functions import vectors as vc
from tracewright.operators import balance as bl
from tracewright.operators import counts as ct
from tracewright.plans import oversample as ov
from tracewright.session import new_path, settle
from tracewright.sources import tables as tb

COUNTS = """cnt AS (SELECT label, count(*) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM vec GROUP BY label)) - count(*) AS need FROM vec GROUP BY label),
need AS (SELECT * FROM cnt WHERE need > 0)"""

SAME = """same AS (SELECT a.row_id AS query_id, b.row_id AS neighbor_id, b.vec AS nvec,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.vec, b.vec), b.row_id) AS rank FROM vec a JOIN vec b ON a.row_id <> b.row_id AND a.label = b.label)"""

EVEN = """rk AS (SELECT row_id, label, vec, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS rank, count(*) OVER (PARTITION BY label) AS gn FROM seeds),
share AS (SELECT rk.*, CAST(floor(need / gn) AS BIGINT) + (rank <= need % gn)::INTEGER AS copies FROM rk JOIN need USING (label))"""

MADE = """cp AS (SELECT row_id, label, vec, unnest(range(1, copies + 1)) AS copy FROM share WHERE copies > 0),
ky AS (SELECT *, md5('42:' || row_id || ':' || copy) AS key FROM cp),
made AS (SELECT k.row_id AS seed_id, k.copy, s.neighbor_id, k.label, ('0x' || substr(key, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, k.vec, s.nvec
  FROM ky k JOIN same s ON s.query_id = k.row_id AND s.rank <= 5 AND s.rank = ('0x' || substr(key, 9, 8))::BIGINT % 5 + 1)"""

SHOW = """SELECT seed_id, copy, neighbor_id, label, round(vec[1] + u * (nvec[1] - vec[1]), 5) AS v1,
  round(list_sum(vec) + u * (list_sum(nvec) - list_sum(vec)), 4) AS total FROM made"""


def _shown(made):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return made.select("seed_id", "copy", "neighbor_id", "label", F.round(F.col("vec")[0], 5).alias("v1"), F.round(total, 4).alias("total"))


@query("a10_b01_deficits", f"WITH {VEC}, {COUNTS} SELECT label, n, need FROM need")
def deficits(spark, sf):
    return bl.deficits(vectors(spark, sf))


@query("b01_smote", f"WITH {VEC}, {COUNTS}, {SAME}, seeds AS (SELECT v.* FROM vec v JOIN need USING (label)), {EVEN}, {MADE} {SHOW}")
def smote(spark, sf):
    return _shown(bl.smote(vectors(spark, sf)))


OTHERS = """oth AS (SELECT n.query_id AS row_id, n.mine AS label, count(*) FILTER (their <> mine AND rank <= 10) AS o10, count(*) FILTER (their <> mine AND rank <= 5) AS o5
  FROM near n JOIN need ON need.label = n.mine GROUP BY 1, 2)"""


RARE = "CASE WHEN label < 8 THEN 0 ELSE label END AS label"


def _rare(sql):
    """The same SQL over labels 0 to 7 taken as one large class."""
    return sql.replace("label FROM embeddings", f"{RARE} FROM embeddings")


def _rare_vectors(spark, sf):
    return vectors(spark, sf).withColumn("label", F.when(F.col("label") < 8, 0).otherwise(F.col("label")))


@query("b02_borderline_smote", _rare(f"""WITH {NEAR}, {COUNTS}, {SAME}, {OTHERS},
  seeds AS (SELECT v.* FROM vec v JOIN oth USING (row_id) WHERE o10 >= 5 AND o10 < 10), {EVEN}, {MADE} {SHOW}"""))
def borderline_smote(spark, sf):
    return _shown(bl.borderline_smote(_rare_vectors(spark, sf)))


@query("b03_adasyn", _rare(f"""WITH {NEAR}, {COUNTS}, {SAME}, {OTHERS}, tot AS (SELECT label, sum(o5) AS t FROM oth GROUP BY 1),
  share AS (SELECT v.*, CAST(round_even(o5 * need / t::DOUBLE, 0) AS BIGINT) AS copies FROM vec v JOIN oth USING (row_id) JOIN tot ON tot.label = v.label JOIN need ON need.label = v.label),
  {MADE} {SHOW}"""))
def adasyn(spark, sf):
    return _shown(bl.adasyn(_rare_vectors(spark, sf)))


# Which rows are seeds depends on a trained model; the rows made per class must meet the deficit.
MET = f"WITH {VEC}, {COUNTS} SELECT label, need AS n FROM need WHERE need > 0"


@query("b04_svm_smote", MET)
def svm_smote(spark, sf):
    return bl.svm_smote(vectors(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("b05_kmeans_smote", MET)
def kmeans_smote(spark, sf):
    return bl.kmeans_smote(vectors(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


BOTH = f"""{VEC}, {COUNTS}, {SAME}, seeds AS (SELECT v.* FROM vec v JOIN need USING (label)), {EVEN}, {MADE},
allv AS (SELECT row_id, 0 AS copy, label, vec FROM vec UNION ALL SELECT seed_id, copy, label,
    list_transform(list_zip(vec, nvec), lambda p: p[1] + u * (p[2] - p[1])) FROM made),
idv AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id || ':' || copy), row_id, copy) AS id FROM allv),
nn AS (SELECT a.id, a.label, b.id AS nid, b.label AS nl, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank
  FROM idv a JOIN idv b ON a.id <> b.id)"""


@query("b06_smote_enn", f"""WITH {BOTH} SELECT row_id, copy, label FROM idv WHERE id NOT IN (SELECT id FROM nn WHERE rank <= 3 AND nl <> label)""")
def smote_enn(spark, sf):
    return bl.smote_enn(vectors(spark, sf)).select("row_id", "copy", "label")


@query("b07_smote_tomek", f"""WITH {BOTH}, f AS (SELECT * FROM nn WHERE rank = 1) SELECT row_id, copy, label FROM idv WHERE id NOT IN (
  SELECT a.id FROM f a JOIN f b ON a.nid = b.id AND b.nid = a.id WHERE a.label <> b.label)""")
def smote_tomek(spark, sf):
    return bl.smote_tomek(vectors(spark, sf)).select("row_id", "copy", "label")


@query("b08_random_oversample", f"""WITH {VEC.replace('label FROM', '(label % 4 = 0)::INTEGER AS label FROM')}, {COUNTS}, low AS (SELECT * FROM need WHERE n < (n + need) * 0.5),
  seeds AS (SELECT v.* FROM vec v JOIN low USING (label)), {EVEN} SELECT row_id, label, unnest(range(1, copies + 1)) AS copy FROM share WHERE copies > 0""")
def random_oversample(spark, sf):
    rows = vectors(spark, sf).withColumn("label", (F.col("label") % 4 == 0).cast("int"))
    return bl.random_oversample(rows)


@query("b09_balance_groups")
def balance_groups(spark, sf):
    """Vectors with the label bits of the event of the same id, balanced group by group."""
    e = event_vectors(spark, sf).select("row_id", "classes", F.col("y_true").alias("label_vector"))
    rows = settle(vectors(spark, sf).select("row_id", "vec").join(e, "row_id"), "rows")
    types = rows.select(F.explode("classes").alias("label")).distinct()
    out = bl.balance_groups(rows, ct.attack_groups(types))
    return out.groupBy("is_synthetic", F.array_join(F.col("label_vector").cast("array<string>"), "").alias("bits")).agg(F.count("*").alias("n"))


@query("b11_u03_balanced_table", f"""WITH {VEC}, {COUNTS} SELECT label, is_synthetic, n FROM (
  SELECT label, false AS is_synthetic, n FROM cnt UNION ALL SELECT label, true, need FROM need)""")
def balanced_table(spark, sf):
    return bl.balance(vectors(spark, sf), "smote").groupBy("label", "is_synthetic").agg(F.count("*").alias("n"))


@query("b12_synthetic_quality", f"""WITH {VEC}, {COUNTS}, {SAME}, seeds AS (SELECT v.* FROM vec v JOIN need USING (label)), {EVEN}, {MADE},
  pt AS (SELECT seed_id, copy, list_transform(list_zip(vec, nvec), lambda p: p[1] + u * (p[2] - p[1])) AS vec FROM made),
  d AS (SELECT seed_id, copy, min(list_distance(pt.vec, v.vec)) AS d FROM pt, vec v GROUP BY 1, 2) SELECT round(1 / (1 + avg(d)), 5) AS synthetic_quality FROM d""")
def synthetic_quality(spark, sf):
    v = settle(vectors(spark, sf), "rows")
    return bl.synthetic_quality(v, settle(bl.smote(v), "made")).select(F.round("synthetic_quality", 5).alias("synthetic_quality"))


@query("b11_b12_variants", f"""WITH {VEC}, {COUNTS}, t AS (SELECT sum(n)::BIGINT AS n, (SELECT coalesce(sum(need), 0)::BIGINT FROM need) AS made FROM cnt)
  SELECT variant, n + made AS n_rows, made AS n_synthetic, true AS in_range FROM t, (VALUES ('smote'), ('svm_smote'), ('kmeans_smote')) v(variant)""")
def variants(spark, sf):
    """Variants that meet every deficit, with their quality and diversity in range."""
    out = bl.balance_variants(vectors(spark, sf), ["smote", "svm_smote", "kmeans_smote"])
    ok = (F.col("balance_improvement") > 0) & F.col("synthetic_quality").between(0, 1) & F.col("diversity_score").between(-1, 1)
    return out.select("variant", "n_rows", "n_synthetic", ok.alias("in_range"))


@query("b11_oversampling_batch", """WITH f AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'auth' ELSE 'vpn' END AS log_type, label, e AS embedding_type
    FROM embeddings, (SELECT unnest(['raw', 'turned']) AS e)),
  c AS (SELECT log_type, embedding_type, label, count(*) AS n FROM f GROUP BY ALL)
  SELECT log_type, embedding_type, v AS variant, 'done' AS status, sum(n)::BIGINT AS n_before, (max(n) * count(*))::BIGINT AS n_after, 1.0::DOUBLE AS max_ratio_after,
    (max(n) * count(*))::BIGINT AS rows_read
  FROM c, (SELECT unnest(['smote', 'svm_smote']) AS v) GROUP BY 1, 2, 3""")
def oversampling_batch(spark, sf):
    """Two log types, two embeddings, two variants that meet deficits exactly; the job is stopped after three cells and started again."""
    v = vectors(spark, sf).select(F.col("row_id").cast("string").alias("row_id"), F.when(F.col("row_id") % 3 == 0, "auth").otherwise("vpn").alias("log_type"), vc.as_doubles(F.col("vec")).alias("embedding"),
                                  F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i == F.col("label")).cast("tinyint")).alias("label_vector"))
    turned = v.withColumn("embedding", F.reverse("embedding"))
    store, out = new_path(spark, "features"), new_path(spark, "batch")
    tb.write_features(v.withColumn("embedding_type", F.lit("raw")).unionByName(turned.withColumn("embedding_type", F.lit("turned"))), store)
    ov.run(spark, store, out, ["smote", "svm_smote"], most_cells=3)
    ov.run(spark, store, out, ["smote", "svm_smote"])
    read = ov.read_balanced(spark, out).groupBy(*ov.CELL).agg(F.count("*").alias("rows_read"))
    return ov.read_manifest(spark, out).join(read, ov.CELL, "left").select(*ov.CELL, "status", "n_before", "n_after", "max_ratio_after", "rows_read")
