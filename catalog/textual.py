"""Tokens, pooled vectors and vector statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.inputs import EVENTS, VEC, documents, labelled_events, table, vectors
from catalog.registry import query
from tracewright.functions import labels as lb
from tracewright.functions import text as tx
from tracewright.functions import vectors as vc
from tracewright.operators import embedding as em
from tracewright.operators import masked as mk
from tracewright.operators import skipgram as sg
from tracewright.operators import vector_stats as vs
from tracewright.plans import features as ft
from tracewright.session import settle

WIDTH = 64

TOKENS = """tok AS (SELECT doc_id AS row_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}_]+'),
  lambda x: length(x) BETWEEN 2 AND 15 AND NOT starts_with(x, '_')) AS tokens FROM documents),
one AS (SELECT row_id, unnest(tokens) AS token FROM tok),
vocab AS (SELECT token, count(*) AS n FROM one GROUP BY 1 HAVING count(*) >= 5),
vec8 AS (SELECT token, d, (('0x' || substr(md5('42:' || token || ':' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1)::FLOAT::DOUBLE AS x
  FROM vocab, (SELECT unnest(range(8)) AS d))"""


def _tokens(spark, sf):
    return em.tokenize(documents(spark, sf))


def _floats(vectors):
    return vectors.withColumn("vec", F.col("vec").cast("array<float>"))


_VECTORS: dict = {}


def word_vectors(spark, sf):
    """A table of 300 numbers for every word that occurs five times; it stands for a trained one and is made once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VECTORS:
        words = em.vocabulary_counts(_tokens(spark, sf).select("tokens"), min_count=5)
        _VECTORS[key] = settle(_floats(em.hashed_vectors(words.select("token"), 300)), "word-vectors")
    return _VECTORS[key]


@query("f01_x03_tokens", f"WITH {TOKENS} SELECT row_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM tok")
def tokens(spark, sf):
    return _tokens(spark, sf).select("row_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                                     F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("f03_vocabulary_counts", f"WITH {TOKENS} SELECT token, n FROM vocab")
def vocabulary_counts(spark, sf):
    return em.vocabulary_counts(_tokens(spark, sf), min_count=5)


@query("f02_j04_mean_pool", f"""WITH {TOKENS}, p AS (SELECT row_id, d, avg(x) AS m FROM one JOIN vec8 USING (token) GROUP BY 1, 2)
  SELECT t.row_id, coalesce(max(round(m, 4)) FILTER (d = 0), 0) AS m0, coalesce(max(round(m, 4)) FILTER (d = 7), 0) AS m7
  FROM tok t LEFT JOIN p USING (row_id) GROUP BY 1""")
def mean_pool(spark, sf):
    rows = settle(_tokens(spark, sf).select("row_id", "tokens"), "tokens")
    out = em.mean_pool(rows, word_vectors(spark, sf), 300)
    v = F.col("embedding").cast("array<double>")
    return out.select("row_id", F.round(v[0], 4).alias("m0"), F.round(v[7], 4).alias("m7"))


@query("f04_subword_pool", f"""WITH {TOKENS}, rare AS (SELECT DISTINCT token FROM one WHERE token NOT IN (SELECT token FROM vocab)),
  mark AS (SELECT token, '<' || token || '>' AS w FROM rare),
  gram AS (SELECT token, substr(w, i, n) AS g FROM mark, (SELECT unnest(range(3, 7)) AS n), (SELECT unnest(range(1, 18)) AS i) WHERE i + n - 1 <= length(w)),
  slot AS (SELECT token, ('0x' || substr(md5('42:' || g), 1, 8))::BIGINT % 1000 AS bucket FROM gram),
  built AS (SELECT token, avg((('0x' || substr(md5('42:' || bucket || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1)::FLOAT::DOUBLE) AS x FROM slot GROUP BY 1),
  full0 AS (SELECT token, x FROM vec8 WHERE d = 0 UNION ALL SELECT token, x FROM built),
  p AS (SELECT row_id, avg(x) AS m FROM one JOIN full0 USING (token) GROUP BY 1)
  SELECT row_id, coalesce(round(m, 4), 0) AS m0 FROM tok LEFT JOIN p USING (row_id)""")
def subword_pool(spark, sf):
    rows = settle(_tokens(spark, sf).select("row_id", "tokens"), "tokens")
    buckets = _floats(em.hashed_vectors(spark.range(1000).select(F.col("id").cast("int").alias("bucket")), 300, "bucket"))
    out = em.subword_pool(rows, word_vectors(spark, sf), buckets, 1000, 300)
    return out.select("row_id", F.round(F.col("embedding").cast("array<double>")[0], 4).alias("m0"))


@query("f04_trained_subwords", f"WITH {TOKENS} SELECT count(*) + 3 AS n_words, true AS alike_near, true AS inflection_near FROM vocab")
def trained_subwords(spark, sf):
    """Vectors are trained on all texts, in which every third use of a frequent word is replaced by a made-up one, and a row
    with a third made-up word is added for each text. Both words of a pair are used alike, so they must be nearer to each
    other than to nine of ten other words; an inflection that was never seen must be near its stem."""
    rows = settle(_tokens(spark, sf).select("row_id", "tokens"), "tokens")
    common = em.vocabulary_counts(rows).orderBy(F.desc("n"), "token").offset(8).limit(1).first()["token"]
    turned = F.transform("tokens", lambda t, i: F.when((t == common) & ((i + F.col("row_id")) % 3 == 0), F.lit("qwzyxk")).when((t == common) & ((i + F.col("row_id")) % 3 == 1), F.lit("vujhgm")).otherwise(t))
    planted = rows.select("row_id", turned.alias("tokens")).unionByName(spark.range(5).select((-F.col("id") - 1).alias("row_id"), F.array(F.lit("qqlonely"), F.lit("qqlonely")).alias("tokens")))
    vocab, buckets = sg.train(planted, width=64, buckets=100_000, epochs=5)
    asked = spark.createDataFrame([(1, ["vujhgms"]), (2, ["vujhgm"]), (3, ["qwzyxk"])], "row_id bigint, tokens array<string>")
    found = {r["row_id"]: list(r["embedding"]) for r in em.subword_pool(asked, vocab, buckets, 100_000, 64).collect()}
    near = lambda i: vc.cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in found[i]]))
    told = vocab.select("token", near(1).alias("inflection"), near(2).alias("alike"))
    value = lambda name, column: F.max(F.when(F.col("token") == name, F.col(column)))
    tenth = lambda column: F.percentile_approx(F.when(~F.col("token").isin("vujhgm", "qwzyxk"), F.col(column)), 0.9, 10_000)
    return told.agg(F.count("*").alias("n_words"), (value("qwzyxk", "alike") > tenth("alike")).alias("alike_near"),
                    (value("vujhgm", "inflection") > tenth("inflection")).alias("inflection_near"))


@query("f03_trained_vectors", f"WITH {TOKENS} SELECT token, 300 AS width FROM vocab")
def trained_vectors(spark, sf):
    """Which tokens get a vector, and its width; the numbers in it depend on draws."""
    return em.train_vectors(_tokens(spark, sf)).select("token", F.size("vec").alias("width"))


@query("f05_label_embedding", f"""WITH {EVENTS}, w AS (SELECT DISTINCT unnest(labels) AS label FROM lab),
  t AS (SELECT label, unnest(string_split(label, '_')) AS token FROM w),
  x AS (SELECT label, avg(('0x' || substr(md5('42:' || token || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) AS x FROM t GROUP BY 1),
  p AS (SELECT row_id, avg(x) AS m FROM (SELECT row_id, unnest(labels) AS label FROM lab) JOIN x USING (label) GROUP BY 1)
  SELECT row_id, coalesce(round(m, 4), 0) AS m0 FROM lab LEFT JOIN p USING (row_id)""")
def label_embedding(spark, sf):
    e = labelled_events(spark, sf).select("row_id", "labels")
    words = e.select(F.explode("labels").alias("l")).select(F.explode(F.split("l", "_")).alias("token")).distinct()
    out = em.embed_labels(e, em.hashed_vectors(words, 4), 4)
    return out.select("row_id", F.round(F.col("label_embedding")[0], 4).alias("m0"))


SEQ = """seq AS (SELECT conv_id AS row_id, turn AS pos, (turn % 3 <> 2)::INTEGER AS mask, length(text)::DOUBLE AS a,
  length(role)::DOUBLE - turn AS b FROM conversations)"""


@query("f06_sequence_pool", f"""WITH {SEQ} SELECT row_id, arg_min(a, pos) AS first_a, round(sum(a * mask) / greatest(sum(mask), 1e-9), 6) AS mean_a,
  max(CASE WHEN mask > 0 THEN a ELSE -1e9 END) AS max_a, arg_min(b, pos) AS first_b,
  round(sum(b * mask) / greatest(sum(mask), 1e-9), 6) AS mean_b, max(CASE WHEN mask > 0 THEN b ELSE -1e9 END) AS max_b FROM seq GROUP BY 1""")
def sequence_pool(spark, sf):
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("row_id"), F.col("turn").alias("pos"), (F.col("turn") % 3 != 2).cast("int").alias("mask"),
        F.array(F.length("text").cast("double"), F.length("role").cast("double") - F.col("turn")).alias("vec"))
    out = em.pool_sequences(t, 2)
    return out.select("row_id", *[c for i, n in enumerate("ab") for c in (
        F.col("first_vec")[i].alias(f"first_{n}"), F.round(F.col("mean_vec")[i], 6).alias(f"mean_{n}"), F.col("max_vec")[i].alias(f"max_{n}"))])


@query("f07_top_attention", f"""WITH {SEQ}, s AS (SELECT row_id, list(a ORDER BY pos) AS v FROM seq GROUP BY 1),
  t AS (SELECT row_id, list_sort(list_reverse_sort(v[2:])[1:3]) AS b FROM s)
  SELECT row_id, coalesce(b[1], 0) AS a1, coalesce(b[2], 0) AS a2, coalesce(b[3], 0) AS a3 FROM t""")
def top_attention(spark, sf):
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("row_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"].cast("double")).alias("v"))
    top = rows.select("row_id", vc.top_attention(F.col("v"), 3).alias("t"))
    return top.select("row_id", *[F.col("t")[i].alias(f"a{i + 1}") for i in range(3)])


@query("f08_concat_blocks", f"WITH {VEC} SELECT row_id, len(vec) * 2 + 1 AS width, round(list_sum(vec) * 3 + label, 6) AS total FROM vec")
def concat_blocks(spark, sf):
    doubled = F.transform(vc.as_doubles(F.col("vec")), lambda x: x * 2)
    rows = vectors(spark, sf).select("row_id", vc.concat_blocks(F.col("vec"), doubled, F.array("label")).alias("v"))
    return rows.select("row_id", F.size("v").cast("bigint").alias("width"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("f09_fixed_length", f"""WITH {TOKENS} SELECT row_id, least(len(tokens), 128) AS n_real, 128 AS n_all,
  coalesce(tokens[128], '[PAD]') AS last FROM tok""")
def fixed_length(spark, sf):
    out = em.fixed_length(_tokens(spark, sf))
    return out.select("row_id", F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
                      F.size("tokens").alias("n_all"), F.element_at("tokens", 128).alias("last"))


@query("f10_masked_features", f"""WITH {VEC}, u AS (SELECT row_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vec)
  SELECT row_id, count(*) FILTER (h < 2516582) AS n_masked, round(sum(CASE WHEN h < 2516582 THEN 0 ELSE x END), 6) AS total
  FROM (SELECT *, ('0x' || substr(md5('42:' || row_id || ':' || i), 1, 6))::BIGINT AS h FROM u) GROUP BY 1""")
def masked_features(spark, sf):
    m = vectors(spark, sf).select("row_id", vc.mask_features(F.col("vec"), F.col("row_id")).alias("m"))
    return m.select("row_id", F.size(F.filter("m", lambda x: x == 0.0)).cast("bigint").alias("n_masked"),
                    F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("f11_standardized", f"""WITH {VEC}, u AS (SELECT row_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec),
  s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM u GROUP BY 1)
  SELECT row_id, round(max((x - m) / d) FILTER (i = 1), 5) AS z1, round(sum(((x - m) / d) ** 2), 4) AS energy
  FROM u JOIN s USING (i) GROUP BY 1""")
def standardized(spark, sf):
    z = vs.standardize(vectors(spark, sf), "vec")
    return z.select("row_id", F.round(F.col("scaled")[0], 5).alias("z1"), F.round(vc.dot(F.col("scaled"), F.col("scaled")), 4).alias("energy"))


@query("f12_projection", f"WITH {VEC} SELECT row_id, 2 AS n_components, round(list_dot_product(vec, vec), 4) AS squared_length FROM vec")
def projection(spark, sf):
    """Signs of components are free; with all of them the squared length must stay."""
    rows = vs.project(vectors(spark, sf), "vec", 2)
    whole = vs.project(rows, "vec", WIDTH, "whole")
    return whole.select("row_id", F.size("projected").alias("n_components"), F.round(vc.dot(F.col("whole"), F.col("whole")), 4).alias("squared_length"))


@query("f13_v04_reconstruction_anomalies", "SELECT count(*) AS n_rows, count(*) - ceil(count(*) * 0.95)::BIGINT AS n_flagged, 0::BIGINT AS n_negative FROM embeddings")
def reconstruction_anomalies(spark, sf):
    scored = vs.flag_above_share(vs.reconstruction_scores(vectors(spark, sf), "vec", 8), "score", 0.95)
    return scored.agg(F.count("*").alias("n_rows"), F.sum("is_anomaly").alias("n_flagged"), F.count_if(F.col("score") < 0).alias("n_negative"))


@query("a12_a14_class_means", f"""WITH {VEC}, u AS (SELECT label, row_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec),
  m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2)
  SELECT label, max(n) AS n_rows, round(max(m) FILTER (i = 1), 6) AS c1, round(sum(m), 5) AS total FROM m GROUP BY 1""")
def class_means(spark, sf):
    c = vs.cluster_centroids(vectors(spark, sf), "label", "vec", WIDTH)
    return c.select("label", "n_rows", F.round(F.col("centroid")[0], 6).alias("c1"),
                    F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("a13_matrix_stats", f"""WITH {VEC}, u AS (SELECT unnest(vec) AS x FROM vec)
  SELECT (SELECT count(*) FROM vec) AS n_rows, (SELECT max(len(vec)) FROM vec)::INTEGER AS width, round(min(x), 6) AS min,
    round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM u""")
def matrix_stats(spark, sf):
    out = vs.matrix_stats(vectors(spark, sf), "vec", WIDTH)
    return out.select("n_rows", "width", *[F.round(c, 6).alias(c) for c in ["min", "max", "mean", "std"]])


@query("x14_unit_vectors", f"WITH {VEC} SELECT row_id, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) AS u1, round(sqrt(list_dot_product(vec, vec)), 6) AS length FROM vec")
def unit_vectors(spark, sf):
    return vectors(spark, sf).select("row_id", F.round(vc.normalize(F.col("vec"))[0], 6).alias("u1"), F.round(vc.norm(F.col("vec")), 6).alias("length"))


@query("x15_cosine_to_class_mean", f"""WITH {VEC}, u AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vec),
  m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
  SELECT row_id, round(list_cosine_similarity(vec, c) / 0.5, 5) AS similarity FROM vec JOIN c USING (label)""")
def cosine_to_class_mean(spark, sf):
    v = vectors(spark, sf)
    c = vs.cluster_centroids(v, "label", "vec", WIDTH).select("label", "centroid")
    return v.join(c, "label").select("row_id", F.round(vc.cosine(F.col("vec"), F.col("centroid"), 0.5), 5).alias("similarity"))


@query("p08_score_flags", """SELECT vec_id AS row_id, (embedding[1]::DOUBLE > 0.05)::INTEGER AS is_anomaly FROM embeddings""")
def score_flags(spark, sf):
    v = vectors(spark, sf).withColumn("score", F.col("vec")[0].cast("double"))
    return vs.flag_anomalies(v, "score", 0.05).select("row_id", "is_anomaly")


@query("p09_valid_vectors", f"""WITH {EVENTS} SELECT log_type, count(*) AS n FROM lab WHERE len(labels) > 0 GROUP BY 1""")
def valid_vectors(spark, sf):
    rows = labelled_events(spark, sf).withColumn("v", F.transform("labels", lambda x: F.length(x)))
    return rows.where(F.size("v") > 0).groupBy("log_type").agg(F.count("*").alias("n"))


@query("p09_stacked_features", f"""WITH {EVENTS} SELECT log_type, e AS embedding_type, count(*) AS n, sum(len(labels))::BIGINT AS bits
  FROM lab, (SELECT unnest(['a', 'b']) AS e) WHERE len(labels) > 0 GROUP BY 1, 2""")
def stacked_features(spark, sf):
    """Two feature tables are stacked and given the classes of both; rows without any label go, with their vectors."""
    rows = labelled_events(spark, sf).where(F.size("labels") > 0).select("row_id", "log_type", "labels", F.array(F.col("value")).alias("embedding"))
    out = ft.realign({"a": rows, "b": rows})
    ones = F.aggregate("label_vector", F.lit(0).cast("bigint"), lambda n, b: n + b)
    return out.where(lb.has_any_bit(F.col("label_vector")) == 1).groupBy("log_type", "embedding_type").agg(F.count("*").alias("n"), F.sum(ones).alias("bits"))


@query("x11_word_set", "SELECT page_id AS row_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(translate(url, '_-/', '   ')), '\\s+'), lambda x: x <> ''))), ' ') AS words FROM pages")
def word_set(spark, sf):
    text = F.translate("url", "/", " ")
    return table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.array_join(F.array_sort(tx.word_set(text)), " ").alias("words"))


@query("f13_masked_reconstruction", """SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 100 = 0) AS n_planted, count(*) FILTER (vec_id % 100 = 0) AS planted_first,
  true AS better_than_mean FROM embeddings""")
def masked_reconstruction(spark, sf):
    """Sixteen entries that depend on four numbers of each row; every hundredth row has them in reverse order, so that its entries
    don't go together. These rows must have the largest errors, and the others must be predicted better than by the mean."""
    part = lambda i, k: F.lit(float(np.cos(1.7 * i * (k + 1) + k)))
    entries = [sum((part(i, k) * F.col("vec")[k].cast("double") for k in range(4)), F.col("vec")[i].cast("double") * 0.02) for i in range(16)]
    rows = vectors(spark, sf).select("row_id", F.array(*entries).alias("v"))
    rows = settle(rows.select("row_id", F.when(F.col("row_id") % 100 == 0, F.reverse("v")).otherwise(F.col("v")).alias("v")), "low-rank")
    scored = settle(mk.score(rows, "v", mk.fit(rows, "v", 4)), "scored")
    planted = F.col("row_id") % 100 == 0
    n = scored.where(planted).count()
    first = scored.orderBy(F.desc("score"), "row_id").limit(n).agg(F.count_if(planted).alias("n")).scalar()
    spread = vs.matrix_stats(rows, "v", 16).select("std").scalar()
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(planted).alias("n_planted"), F.avg(F.when(~planted, F.col("score"))).alias("error")).select(
        "n_rows", "n_planted", first.alias("planted_first"), (F.col("error") * 4 < spread * spread).alias("better_than_mean"))
