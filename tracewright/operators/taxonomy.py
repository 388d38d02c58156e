"""The attack taxonomy as an edge table, and prediction along it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import labels as lb
from tracewright.functions import text as tx
from tracewright.functions import vectors as vc
from tracewright.operators import isolation as iso
from tracewright.operators.clustering import distance_to_centroid, level_clusters
from tracewright.operators.joining import explode_values
from tracewright.operators.ranking import exact_quantile
from tracewright.session import settle

# Level, node, parent and children in order.
NODES = [
    (0, "root", None, ["normal", "anomaly"]),
    (1, "normal", "root", []),
    (1, "anomaly", "root", ["web_attacks", "network_attacks", "system_attacks", "data_attacks"]),
    (2, "web_attacks", "anomaly", ["injection_attacks", "xss_attacks", "csrf_attacks", "file_inclusion"]),
    (2, "network_attacks", "anomaly", ["dos_attacks", "scan_attacks", "brute_force", "flooding"]),
    (2, "system_attacks", "anomaly", ["privilege_escalation", "backdoor", "trojan", "rootkit"]),
    (2, "data_attacks", "anomaly", ["exfiltration", "theft", "breach", "leak"]),
    (3, "injection_attacks", "web_attacks", ["sql_injection", "command_injection", "ldap_injection", "xpath_injection"]),
    (3, "xss_attacks", "web_attacks", ["stored_xss", "reflected_xss", "dom_xss"]),
    (3, "csrf_attacks", "web_attacks", ["csrf_get", "csrf_post", "csrf_ajax"]),
    (3, "file_inclusion", "web_attacks", ["lfi", "rfi", "path_traversal"]),
    (3, "dos_attacks", "network_attacks", ["tcp_flood", "udp_flood", "icmp_flood", "syn_flood"]),
    (3, "scan_attacks", "network_attacks", ["port_scan", "network_scan", "vulnerability_scan"]),
    (3, "brute_force", "network_attacks", ["password_brute", "ssh_brute", "ftp_brute"]),
    (3, "flooding", "network_attacks", ["bandwidth_flood", "connection_flood", "request_flood"]),
]

NODE_SCHEMA = "level int, name string, parent string, children array<string>"


def taxonomy_table(spark: SparkSession, nodes=NODES) -> DataFrame:
    return spark.createDataFrame(nodes, NODE_SCHEMA)


def level_nodes(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.groupBy("level").agg(F.sort_array(F.collect_list("name")).alias("nodes"))


def edges(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select(F.col("name").alias("parent"), F.posexplode("children").alias("pos", "child"))


def root_paths(taxonomy: DataFrame) -> DataFrame:
    """(name, path) with the full path from the root."""
    return taxonomy.sparkSession.sql("""
        WITH RECURSIVE walk(name, path) AS (
            SELECT name, array(name) FROM {nodes} WHERE parent IS NULL
            UNION ALL
            SELECT n.name, concat(w.path, array(n.name)) FROM {nodes} n JOIN walk w ON n.parent = w.name)
        SELECT name, path FROM walk""", nodes=taxonomy)


def literal_paths(taxonomy: DataFrame) -> DataFrame:
    """(name, path) with at most the direct parent."""
    return taxonomy.select("name", F.array_compact(F.array("parent", "name")).alias("path"))


def node_level(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Level of each name, -1 if it is not a node."""
    known = taxonomy.select("name", "level", "children")
    return names.join(known, "name", "left").select(
        "name", F.coalesce("level", F.lit(-1)).alias("level"),
        F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def map_attack_types(types: DataFrame, column: str = "label", nodes=NODES, floor: float = 0.3) -> DataFrame:
    """Best node per attack type by share of common words; first node in level order wins ties.

    The node list is a small constant, so each type is scored in place.
    """
    table = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n[1]).alias("name"),
                               F.array(*[F.lit(w) for w in n[1].split("_")]).alias("words"))
                      for i, n in enumerate(sorted(nodes, key=lambda n: n[0]))])
    size = F.greatest(F.size(F.filter(F.split(F.lower(F.translate(column, "_-", "  ")), r"\s+"), lambda w: w != "")),
                      F.lit(1))
    scored = F.transform(table, lambda n: F.struct(
        (F.size(F.array_intersect(tx.word_set(F.col(column)), n["words"])) / size).alias("score"),
        (-n["at"]).alias("order"), n["name"].alias("name")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > floor))
    return types.select(column, F.coalesce(best["name"], F.lit("anomaly")).alias("node"),
                        F.coalesce(best["score"], F.lit(0.0)).alias("score"))


def child_at(parent: Column, index: Column, nodes=NODES) -> Column:
    """Child of a node at a position; positions past the end mean the first child. Null for leaves."""
    pairs = [(F.lit(n[1]), F.array(*[F.lit(c) for c in n[3]])) for n in nodes if n[3]]
    children = F.create_map(*[x for p in pairs for x in p])[parent]
    return F.coalesce(F.get(children, index), F.get(children, F.lit(0)))


def path_score(path: Column) -> Column:
    """Anomaly score of a path: 0.5 if only the root, 0.7 to 1.0 through ``anomaly``, else 0."""
    deep = (F.lit(0.7) + F.when(F.size(path) > 2, 0.2).otherwise(0.0) + F.when(F.size(path) > 3, 0.1).otherwise(0.0))
    return (F.when(F.size(path) <= 1, 0.5)
            .when(F.array_contains(path, "anomaly"), F.least(deep, F.lit(1.0))).otherwise(0.0))


def predict_paths(rows: DataFrame, levels: list[tuple[str, str]], threshold: float = 0.5, nodes=NODES) -> DataFrame:
    """Descend the taxonomy by per-level (class index, confidence) columns.

    A level is taken while its confidence reaches the threshold and the node
    has children; the first failure stops the descent. Only column
    expressions, no join.
    """
    out = (rows.withColumn("path", F.array(F.lit("root"))).withColumn("confidences", F.array(F.lit(1.0)))
           .withColumn("open_", F.lit(True)))
    for index, confidence in levels:
        step = child_at(F.element_at("path", -1), F.col(index), nodes)
        go = F.col("open_") & (F.col(confidence) >= threshold) & step.isNotNull()
        out = (out.withColumn("go_", go).withColumn("step_", step)
               .withColumn("path", F.when(F.col("go_"), F.concat("path", F.array("step_"))).otherwise(F.col("path")))
               .withColumn("confidences", F.when(F.col("go_"), F.concat("confidences", F.array(
                   F.col(confidence).cast("double")))).otherwise(F.col("confidences")))
               .withColumn("open_", F.col("go_")))
    final = F.when(F.size("path") > 1, F.element_at("path", -1)).otherwise("unknown")
    levels_map = F.map_from_arrays(F.sequence(F.lit(0), F.size("path") - 1), F.col("path"))
    return (out.drop("open_", "go_", "step_").withColumn("final_prediction", final)
            .withColumn("anomaly_score", path_score(F.col("path"))).withColumn("level_predictions", levels_map))


def prediction_summary(results: DataFrame) -> DataFrame:
    """Averages over rows: confidence, path length, and the spread of the score."""
    mean_confidence = F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x) / F.size("confidences")
    return results.agg(
        F.count("*").alias("n_samples"), F.avg(mean_confidence).alias("average_confidence"),
        F.avg(F.size("path")).alias("average_path_length"), F.avg("anomaly_score").alias("score_mean"),
        F.stddev_pop("anomaly_score").alias("score_std"), F.min("anomaly_score").alias("score_min"),
        F.max("anomaly_score").alias("score_max"))


def prediction_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("final_prediction").agg(F.count("*").alias("n_rows"))


def level_distribution(results: DataFrame, levels: int = 3) -> DataFrame:
    """(level, node, n_rows, coverage): predictions per level, missing levels as ``unknown``."""
    named = F.array(*[F.struct(F.lit(i).alias("level"), F.coalesce(F.get("path", F.lit(i)), F.lit("unknown")).alias("node"))
                      for i in range(levels)])
    counts = explode_values(results, [], named, "p").groupBy("p.level", "p.node").agg(F.count("*").alias("n_rows"))
    totals = counts.groupBy("level").agg(
        (F.sum(F.when(F.col("node") != "unknown", F.col("n_rows")).otherwise(0)) / F.sum("n_rows")).alias("coverage"))
    return counts.join(totals, "level")


def level_hit_rate(results: DataFrame, depth: int = 4) -> DataFrame:
    """Share of rows with a non-empty prediction among rows that have the level; levels reached / depth."""
    pairs = results.select(F.explode("level_predictions").alias("level", "node"))
    rates = pairs.groupBy("level").agg(F.avg((F.col("node") != "").cast("int")).alias("hit_rate"))
    deepest = results.agg(F.max(F.size("level_predictions")).alias("m")).scalar()
    return rates.withColumn("level_coverage", deepest / F.lit(depth))


def path_consistency(results: DataFrame) -> DataFrame:
    """Mean Jaccard similarity over all pairs of rows; 1 for fewer than two rows.

    Rows are first counted per distinct path. There are at most as many paths
    as taxonomy nodes, so pairing the counts inside one small array is exact.
    """
    paths = results.groupBy("path").agg(F.count("*").alias("n"))
    table = paths.agg(F.collect_list(F.struct("path", "n")).alias("t"))

    def similarity(a, b):
        pairs = F.when(a["path"] == b["path"], a["n"] * (a["n"] - 1)).otherwise(a["n"] * b["n"])
        return pairs * lb.jaccard(a["path"], b["path"])

    outer = F.aggregate("t", F.lit(0.0), lambda acc, a: acc + F.aggregate(
        "t", F.lit(0.0), lambda inner, b: inner + similarity(a, b)))
    n = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, a: acc + a["n"])
    summed = table.select(outer.alias("s"), n.alias("n"))
    return summed.select(F.when(F.col("n") < 2, 1.0).otherwise(F.col("s") / (F.col("n") * (F.col("n") - 1)))
                         .alias("path_consistency"))


def train_level(rows: DataFrame, vector: str, level: int, nodes=NODES, hidden=(256, 128, 64), epochs: int = 50,
                method: str = "kmeans", seed: int = 42):
    """Cluster one level, learn to predict the clusters; returns (model, labelled rows)."""
    n_next = sum(1 for n in nodes if n[0] == level + 1)
    labelled = settle(level_clusters(rows, vector, n_next, method, "cluster", seed), "level")
    k = labelled.agg(F.max("cluster").alias("m")).first()["m"] + 1
    data = labelled.select(array_to_vector(vc.as_doubles(F.col(vector))).alias("features"),
                           F.col("cluster").cast("double").alias("label"))
    width = labelled.select(F.size(vector).alias("n")).first()["n"]
    model = MultilayerPerceptronClassifier(layers=[width, *hidden, k], maxIter=epochs, seed=seed,
                                           probabilityCol="probability").fit(data)
    return model, labelled


def score_level(rows: DataFrame, model, vector: str, level: int) -> DataFrame:
    """Add ``class_<level>`` and ``confidence_<level>``."""
    scored = model.transform(rows.withColumn("features", array_to_vector(vc.as_doubles(F.col(vector)))))
    p = vector_to_array("probability")
    return (scored.withColumn("p_", p)
            .withColumn(f"class_{level}", (F.array_position("p_", F.array_max("p_")) - 1).cast("int"))
            .withColumn(f"confidence_{level}", F.array_max("p_"))
            .drop("features", "rawPrediction", "probability", "prediction", "p_"))


def outlier_cut(labelled: DataFrame, vector: str, share: float = 0.1) -> DataFrame:
    """Low percentile of an inlier score (minus the distance to the cluster centroid)."""
    scored = distance_to_centroid(labelled, "cluster", vector)
    scored = scored.select((-F.col("outlier_score")).alias("inlier"))
    return exact_quantile(scored, "inlier", share).select(F.col("quantile").alias("threshold"))


def isolation_cut(rows: DataFrame, vector: str, share: float = 0.1, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Low percentile of the inlier score (the negated score) of an isolation forest fitted on the rows."""
    forest = iso.fit(rows, vector, row_id=row_id, seed=seed)
    scored = iso.score(rows, vector, forest).select((-F.col("outlier_score")).alias("inlier"))
    return exact_quantile(scored, "inlier", share).select(F.col("quantile").alias("threshold"))


def fit_predict(rows: DataFrame, vector: str, levels: int = 3, threshold: float = 0.5, nodes=NODES,
                hidden=(256, 128, 64), epochs: int = 50, seed: int = 42) -> DataFrame:
    """Train every level on the rows and predict their paths."""
    models = [train_level(rows, vector, level, nodes, hidden, epochs, seed=seed)[0] for level in range(levels)]
    scored = reduce(lambda df, lm: score_level(df, lm[1], vector, lm[0]), enumerate(models), rows)
    return predict_paths(scored, [(f"class_{i}", f"confidence_{i}") for i in range(levels)], threshold, nodes)
