"""Labels, class lists, distributions, imbalance, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import CELLS, CLASSES, EVENTS, VEC, documents, event_vectors, events, labelled_events, table, vectors
from catalog.registry import query
from tracewright.functions import labels as lb
from tracewright.functions import text as tx
from tracewright.functions.numbers import percentage, ratio_to_at_least_one, size_class
from tracewright.operators import counts as ct
from tracewright.operators import embedding as em
from tracewright.operators import ranking as rk

def _sorted_labels():
    return F.array_join(F.array_sort("labels"), ",")



@query("x01_x02_labels_from_json", f"WITH {EVENTS} SELECT row_id, array_to_string(labels, ',') AS labels FROM lab")
def labels_from_json(spark, sf):
    return labelled_events(spark, sf).select("row_id", _sorted_labels().alias("labels"))


@query("x04_label_json_round_trip",
       f"WITH {EVENTS} SELECT row_id, '[' || array_to_string(list_transform(labels, lambda x: '\"' || x || '\"'), ',') || ']' "
       "AS label_json, len(labels) AS n FROM lab")
def label_json(spark, sf):
    text = lb.labels_to_json(F.array_sort("labels"))
    rows = labelled_events(spark, sf).select("row_id", text.alias("label_json"))
    back = F.size(F.from_json("label_json", "array<string>"))
    return rows.withColumn("n", back.cast("bigint"))


@query("p01_log_type", f"WITH {EVENTS} SELECT row_id, log_type, CASE event_type WHEN 'error' THEN 'intranet-error' "
       "WHEN 'purchase' THEN 'share' ELSE log_type END AS strict_type FROM lab")
def log_type(spark, sf):
    path = F.upper("rel_path")
    return events(spark, sf).select("row_id", tx.log_type(path).alias("log_type"), tx.log_type(path, True).alias("strict_type"))


@query("p01_log_type_of_urls", """SELECT CASE WHEN regexp_matches(u, 'openvpn\\.log') THEN 'vpn'
  WHEN regexp_matches(u, 'access\\.log') THEN 'wp-access' WHEN regexp_matches(u, 'error\\.log') THEN 'wp-error'
  WHEN regexp_matches(u, 'auth\\.log') THEN 'auth' WHEN regexp_matches(u, 'audit\\.log') THEN 'audit'
  WHEN regexp_matches(u, 'dnsmasq\\.log') THEN 'dns' WHEN regexp_matches(u, 'system\\.cpu\\.log') THEN 'monitor'
  WHEN regexp_matches(u, 'dummy_log\\.log') THEN 'dummy_log' ELSE 'unknown' END AS log_type, count(*) AS n
  FROM (SELECT lower(url || CASE page_id % 4 WHEN 0 THEN '/Access.LOG' WHEN 1 THEN '/system.cpu.log.1'
    WHEN 2 THEN '/dnsmasq.log' ELSE '' END) AS u FROM pages) GROUP BY 1""")
def log_type_of_urls(spark, sf):
    tail = (F.when(F.col("page_id") % 4 == 0, "/Access.LOG").when(F.col("page_id") % 4 == 1, "/system.cpu.log.1")
            .when(F.col("page_id") % 4 == 2, "/dnsmasq.log").otherwise(""))
    pages = table(spark, sf, "pages").select(tx.log_type(F.concat("url", tail)).alias("log_type"))
    return pages.groupBy("log_type").agg(F.count("*").alias("n"))


@query("p02_x05_path_parts", f"""WITH {EVENTS} SELECT DISTINCT split_part(rel_path, '/', 1) AS tenant,
  regexp_extract(rel_path, '[^/]*$') AS name,
  regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]*$', '') AS stem,
  regexp_extract(rel_path, '\\.[^./]*$') AS suffix,
  regexp_matches(rel_path, '\\.[0-9]+$') AS numeric_suffix FROM raw""")
def path_parts(spark, sf):
    name = tx.file_name(F.col("rel_path"))
    return events(spark, sf).select(
        tx.tenant(F.col("rel_path")).alias("tenant"), name.alias("name"), tx.stem(name).alias("stem"),
        tx.suffix(name).alias("suffix"), tx.numeric_suffix(name).alias("numeric_suffix")).distinct()


@query("p03_compact_line", f"""WITH {EVENTS} SELECT row_id, '[T' || k || ' ' || event_type || ' user=' || user_id || ']'
  || chr(9) || 'amount ' || CAST(round(value * 100) AS BIGINT) AS log FROM raw""")
def compact_line(spark, sf):
    return events(spark, sf).select("row_id", tx.compact_line(F.col("line")).alias("log"))


@query("p03_compact_document_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents),
  m AS (SELECT doc_id, v, regexp_extract(v, '^(\\S+\\s+\\S+\\s+\\S+)', 1) AS h FROM l)
  SELECT doc_id, sum(CASE WHEN h = '' THEN 1 ELSE 0 END)::BIGINT AS short_lines,
    sum(length(CASE WHEN h = '' THEN 'N/A' ELSE h END))::BIGINT AS ts_chars,
    sum(length(CASE WHEN h = '' THEN regexp_replace(v, '^\\s+|\\s+$', '', 'g')
      ELSE regexp_replace(substr(v, length(h) + 1), '^\\s+|\\s+$', '', 'g') END))::BIGINT AS message_chars
  FROM m GROUP BY doc_id""")
def compact_document_lines(spark, sf):
    lines = documents(spark, sf).select(F.col("row_id").alias("doc_id"), F.explode(F.split("message", "\n")).alias("v"))
    ts, msg = tx.timestamp_text(F.col("v")), tx.message_text(F.col("v"))
    cut = lines.select("doc_id", ts.alias("ts"), msg.alias("msg"))
    return cut.groupBy("doc_id").agg(F.count_if(F.col("ts") == "N/A").alias("short_lines"),
                                     F.sum(F.length("ts")).alias("ts_chars"), F.sum(F.length("msg")).alias("message_chars"))


@query("p05_a04_one_log_type", f"""WITH {EVENTS} SELECT log_type, count(*) FILTER (len(labels) > 0) AS attack_rows,
  count(*) FILTER (len(labels) = 0) AS normal_rows FROM lab WHERE log_type = 'auth' GROUP BY 1""")
def one_log_type(spark, sf):
    rows = labelled_events(spark, sf).where(F.col("log_type") == "auth")
    return ct.attack_normal_counts(rows, "log_type").select("log_type", "attack_rows", "normal_rows")


@query("p06_any_bit", f"WITH {CELLS} SELECT row_id, max(y_true) AS is_attack FROM cell GROUP BY row_id")
def any_bit(spark, sf):
    return event_vectors(spark, sf).select("row_id", lb.has_any_bit(F.col("y_true")).alias("is_attack"))


@query("p07_display_label", f"""WITH {EVENTS} SELECT CASE WHEN len(labels) > 0 THEN 'Attack' ELSE 'Normal' END AS shown,
  count(*) AS n FROM lab GROUP BY 1""")
def display_label(spark, sf):
    return (labelled_events(spark, sf).groupBy(lb.display_label(F.col("labels")).alias("shown"))
            .agg(F.count("*").alias("n")))


@query("x06_label_vector", f"""WITH {CELLS} SELECT row_id, string_agg(y_true::VARCHAR, '' ORDER BY class) AS bits
  FROM cell GROUP BY row_id""")
def label_vector(spark, sf):
    return event_vectors(spark, sf).select("row_id", F.array_join(F.col("y_true").cast("array<string>"), "").alias("bits"))


@query("x07_x08_single_class", f"""WITH {CELLS}, b AS (SELECT row_id, list(y_true ORDER BY class) AS v FROM cell GROUP BY row_id)
  SELECT row_id, CASE WHEN list_max(v) = 0 THEN -1 ELSE list_position(v, 1) - 1 END AS cls,
    CASE WHEN list_max(v) = 0 THEN 0 ELSE list_position(v, 1) - 1 END AS literal_cls,
    array_to_string(list_transform(range(5), lambda i: CASE WHEN list_max(v) > 0 AND i = list_position(v, 1) - 1 THEN 1 ELSE 0 END), '') AS hot
  FROM b""")
def single_class(spark, sf):
    v = F.col("y_true")
    rows = event_vectors(spark, sf).select("row_id", lb.single_class(v).alias("cls"), lb.single_class(v, True).alias("literal_cls"))
    return rows.withColumn("hot", F.array_join(lb.one_hot(F.col("cls"), len(CLASSES)).cast("array<string>"), ""))


@query("x09_jaccard", f"""WITH {EVENTS}, p AS (SELECT user_id, k % 10 AS g, list_sort(list_distinct(flatten(list(labels)))) AS s
  FROM lab GROUP BY 1, 2)
  SELECT a.user_id, a.g, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE
    len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS similarity
  FROM p a JOIN p b ON a.user_id = b.user_id AND b.g = a.g + 1""")
def jaccard(spark, sf):
    rows = labelled_events(spark, sf).select("user_id", (F.col("k") % 10).alias("g"), F.explode_outer("labels").alias("l"))
    sets = rows.groupBy("user_id", "g").agg(F.array_sort(F.collect_set("l")).alias("s"))
    nxt = sets.select("user_id", (F.col("g") - 1).alias("g"), F.col("s").alias("t"))
    return sets.join(nxt, ["user_id", "g"]).select("user_id", "g", F.round(lb.jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))


@query("x12_x17_guarded_numbers", f"""WITH {EVENTS} SELECT user_id, round(coalesce(100.0 * sum(value) FILTER (len(labels) > 0) / nullif(sum(value), 0), 0), 4) AS pct,
  round(count(*) FILTER (len(labels) = 0)::DOUBLE / greatest(count(*) FILTER (len(labels) > 0), 1), 6) AS ratio,
  CASE WHEN sum(k) * 100 < 10000 THEN 'small' WHEN sum(k) * 100 < 100000 THEN 'medium' WHEN sum(k) * 100 < 500000 THEN 'large' ELSE 'very_large' END AS size_class
  FROM lab GROUP BY user_id""")
def guarded_numbers(spark, sf):
    attack = F.size("labels") > 0
    rows = labelled_events(spark, sf).groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(attack, F.col("value"))), F.lit(0.0)).alias("a"), F.sum("value").alias("t"),
        F.count_if(attack).alias("na"), F.count_if(~attack).alias("nn"), F.sum("k").alias("k"))
    return rows.select("user_id", F.round(percentage(F.col("a"), F.col("t")), 4).alias("pct"),
                       F.round(ratio_to_at_least_one(F.col("nn"), F.col("na")), 6).alias("ratio"),
                       size_class(F.col("k") * 100).alias("size_class"))


@query("a01_class_list", f"WITH {EVENTS} SELECT DISTINCT l AS label FROM (SELECT unnest(labels) AS l FROM lab) WHERE l <> ''")
def class_list(spark, sf):
    return ct.distinct_labels(labelled_events(spark, sf))


@query("a02_s11_class_index", f"""WITH {EVENTS}, d AS (SELECT DISTINCT log_type, unnest(labels) AS class FROM lab)
  SELECT log_type, (row_number() OVER (PARTITION BY log_type ORDER BY class) - 1)::INTEGER AS idx, class FROM d""")
def class_index(spark, sf):
    from tracewright.sources.tables import class_index as index
    return index(ct.class_lists_by(labelled_events(spark, sf)))


@query("j03_type_vectors", f"""WITH {EVENTS}, d AS (SELECT DISTINCT log_type, unnest(labels) AS class FROM lab),
  c AS (SELECT log_type, list(class ORDER BY class) AS classes FROM d GROUP BY 1)
  SELECT row_id, array_to_string(list_transform(c.classes, lambda x: CAST(list_contains(labels, x) AS INTEGER)), '') AS bits
  FROM lab LEFT JOIN c USING (log_type)""")
def type_vectors(spark, sf):
    rows = labelled_events(spark, sf)
    out = ct.attach_label_vectors(rows, ct.class_lists_by(rows))
    return out.select("row_id", F.array_join(F.col("label_vector").cast("array<string>"), "").alias("bits"))


@query("a03_label_frequency", f"""WITH {EVENTS} SELECT label, count(*) AS n_rows,
  round(100.0 * count(*) / (SELECT count(*) FROM lab), 6) AS pct FROM (SELECT unnest(labels) AS label FROM lab) GROUP BY label""")
def label_frequency(spark, sf):
    return ct.label_frequency(labelled_events(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("a04_attack_normal", f"""WITH {EVENTS} SELECT count(*) FILTER (len(labels) > 0) AS attack_rows,
  count(*) FILTER (len(labels) = 0) AS normal_rows, round(100.0 * count(*) FILTER (len(labels) > 0) / count(*), 6) AS attack_pct,
  round(100.0 * count(*) FILTER (len(labels) = 0) / count(*), 6) AS normal_pct FROM lab""")
def attack_normal(spark, sf):
    out = ct.attack_normal_counts(labelled_events(spark, sf))
    return out.withColumn("attack_pct", F.round("attack_pct", 6)).withColumn("normal_pct", F.round("normal_pct", 6))


@query("a05_type_distribution", f"""WITH {EVENTS} SELECT log_type, count(*) AS n_rows,
  round(100.0 * count(*) / (SELECT count(*) FROM lab), 6) AS pct FROM lab GROUP BY 1""")
def type_distribution(spark, sf):
    return ct.value_distribution(labelled_events(spark, sf), "log_type").withColumn("pct", F.round("pct", 6))


@query("a06_files_per_type", f"WITH {EVENTS} SELECT log_type, count(DISTINCT rel_path) AS n_files FROM lab GROUP BY 1")
def files_per_type(spark, sf):
    return ct.files_per_type(labelled_events(spark, sf).select("rel_path", "log_type").distinct())


@query("a07_t03_top_combinations", f"""WITH {EVENTS}, c AS (SELECT CASE WHEN len(labels) = 0 THEN 'normal' ELSE array_to_string(labels, ', ') END AS combination,
  count(*) AS n_rows FROM lab GROUP BY 1)
  SELECT combination, n_rows, round(100.0 * n_rows / (SELECT sum(n_rows) FROM c), 6) AS pct,
    greatest((SELECT count(*) FROM c) - 10, 0)::BIGINT AS more_combinations FROM c ORDER BY n_rows DESC, combination LIMIT 10""")
def top_combinations(spark, sf):
    return ct.top_combinations(labelled_events(spark, sf)).withColumn("pct", F.round("pct", 6)).withColumn(
        "more_combinations", F.col("more_combinations").cast("bigint"))


@query("a08_imbalance_overall", f"""WITH {CELLS}, r AS (SELECT row_id, max(y_true) AS a FROM cell GROUP BY 1)
  SELECT count(*) AS total_samples, count(*) FILTER (a = 0) AS normal_samples, count(*) FILTER (a = 1) AS attack_samples,
  round(count(*) FILTER (a = 0)::DOUBLE / greatest(count(*) FILTER (a = 1), 1), 6) AS imbalance_ratio FROM r""")
def imbalance_overall(spark, sf):
    return ct.imbalance_overall(event_vectors(spark, sf), "y_true").withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


@query("a09_imbalance_per_class", f"""WITH {CELLS} SELECT class, sum(y_true)::BIGINT AS positive, sum(1 - y_true)::BIGINT AS negative,
  round(sum(1 - y_true)::DOUBLE / greatest(sum(y_true), 1), 6) AS imbalance_ratio, round(avg(y_true), 8) AS prevalence FROM cell GROUP BY 1""")
def imbalance_per_class(spark, sf):
    out = ct.imbalance_per_class(event_vectors(spark, sf), "y_true")
    return out.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6)).withColumn("prevalence", F.round("prevalence", 8))


@query("a03_a05_label_rollup", f"""WITH {EVENTS}, p AS (SELECT log_type, unnest(labels) AS label FROM lab)
  SELECT log_type, label, count(*) AS n_labels, grouping(log_type, label)::INTEGER AS level FROM p GROUP BY ROLLUP (log_type, label)""")
def label_rollup(spark, sf):
    return ct.label_rollup(labelled_events(spark, sf))


@query("a10_balance_of_labels", """WITH h AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  g AS (SELECT coalesce(h.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(label) FROM embeddings) + 1)) AS label) i LEFT JOIN h USING (label)),
  h2 AS (SELECT (CASE WHEN label % 3 = 1 THEN label - 1 ELSE label END) AS label, count(*) AS n FROM embeddings GROUP BY 1),
  g2 AS (SELECT coalesce(h2.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(label) FROM h2) + 1)) AS label) i LEFT JOIN h2 USING (label)),
  b AS (SELECT stddev_pop(n) / avg(n) AS x FROM g2), a AS (SELECT stddev_pop(n) / avg(n) AS x FROM g)
  SELECT round(b.x, 6) AS balance_before, round(a.x, 6) AS balance_after, round((b.x - a.x) / (b.x + 1e-8), 6) AS balance_improvement FROM a, b""")
def balance_of_labels(spark, sf):
    rows = vectors(spark, sf)
    merged = rows.withColumn("label", F.when(F.col("label") % 3 == 1, F.col("label") - 1).otherwise(F.col("label")))
    out = ct.balance_improvement(merged, rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a11_oversampling_quality", f"""WITH {VEC}, b AS (SELECT label, count(*) AS n FROM vec GROUP BY 1), m AS (SELECT max(n) AS m FROM b),
  a AS (SELECT label, n + CASE WHEN n < m THEN m - n ELSE 0 END AS n FROM b, m)
  SELECT round((SELECT sum(n) FROM a)::DOUBLE / (SELECT sum(n) FROM b), 6) AS sample_increase,
    round((SELECT max(n)::DOUBLE / min(n) FROM b), 6) AS max_ratio_before, round((SELECT max(n)::DOUBLE / min(n) FROM a), 6) AS max_ratio_after,
    round((SELECT max(n)::DOUBLE / min(n) FROM b) / (SELECT max(n)::DOUBLE / min(n) FROM a), 6) AS improvement_factor""")
def oversampling_quality(spark, sf):
    from tracewright.operators.balance import random_oversample
    rows = vectors(spark, sf)
    after = rows.select("label").unionByName(random_oversample(rows, below=None).select("label"))
    out = ct.oversampling_quality(rows, after)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a18_fingerprint", """SELECT left(md5(count(*) || '_' || arg_min(text, doc_id) || '_' || arg_max(text, doc_id)), 16) AS fingerprint,
  sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::BIGINT AS content_sum FROM documents""")
def fingerprint(spark, sf):
    return ct.fingerprint(documents(spark, sf), "message", ["row_id"])


@query("b10_u04_attack_groups", f"""WITH {EVENTS}, t AS (SELECT DISTINCT unnest(labels) AS label FROM lab UNION SELECT DISTINCT event_type || '_flood' FROM events
    UNION SELECT DISTINCT event_type FROM events),
  g(grp, pat) AS (VALUES ('web_attacks', 'xss|sql|injection|csrf|lfi|rfi'), ('network_attacks', 'dos|ddos|scan|brute|flood'),
    ('system_attacks', 'privilege|escalation|backdoor|trojan'), ('data_attacks', 'exfiltration|leak|theft|breach')),
  m AS (SELECT label, grp FROM t JOIN g ON regexp_matches(lower(label), pat))
  SELECT label, grp AS "group" FROM m UNION ALL SELECT label, 'other' FROM t WHERE label NOT IN (SELECT label FROM m)""")
def attack_groups(spark, sf):
    e = labelled_events(spark, sf)
    kinds = table(spark, sf, "events").select("event_type").distinct()
    types = (ct.distinct_labels(e).unionByName(kinds.select(F.concat("event_type", F.lit("_flood")).alias("label")))
             .unionByName(kinds.select(F.col("event_type").alias("label"))).distinct())
    return ct.attack_groups(types)


@query("u01_union_embeddings", """SELECT embedding_type, count(*) AS n, round(sum(s), 4) AS total FROM (
  SELECT 'plain' AS embedding_type, list_sum(embedding::DOUBLE[]) AS s FROM embeddings UNION ALL
  SELECT 'unit', list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FROM embeddings) GROUP BY 1""")
def union_embeddings(spark, sf):
    from tracewright.functions.vectors import normalize
    v = vectors(spark, sf)
    both = em.union_embeddings({"plain": v.withColumn("vec", F.col("vec").cast("array<double>")),
                                "unit": v.withColumn("vec", normalize(F.col("vec")))})
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return both.groupBy("embedding_type").agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("total"))


@query("u02_realigned_vectors", f"""WITH {EVENTS}, d AS (SELECT list(DISTINCT l ORDER BY l) AS classes FROM (SELECT unnest(labels) AS l FROM lab))
  SELECT row_id, log_type, array_to_string(list_transform(classes, lambda x: CAST(list_contains(labels, x) AS INTEGER)), '') AS bits FROM lab, d""")
def realigned_vectors(spark, sf):
    e = labelled_events(spark, sf).select("row_id", "log_type", "labels")
    return ct.attach_label_vectors(e, ct.class_list(e), None).select("row_id", "log_type", F.array_join(F.col("label_vector").cast("array<string>"), "").alias("bits"))


RANKED = """r AS (SELECT {id} AS row_id, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY md5('42:' || {id}), {id}) AS rn,
  count(*) OVER (PARTITION BY {group}) AS n FROM {table})"""


@query("t04_sample_per_class", f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN len(labels) > 0 THEN 'Attack' ELSE 'Normal' END AS shown FROM lab),
  p AS (SELECT row_id, shown, row_number() OVER (PARTITION BY shown ORDER BY md5('42:' || row_id)) AS rn FROM s)
  SELECT row_id, shown FROM p WHERE rn <= 1500 ORDER BY md5('42:' || row_id) LIMIT 2500""")
def sample_per_class(spark, sf):
    rows = labelled_events(spark, sf).select("row_id", lb.display_label(F.col("labels")).alias("shown"))
    return rk.sample_per_class(rows, "shown", ["row_id"], 1500, 2500)


@query("t05_exact_sample", f"WITH {RANKED.format(id='event_id', group='1', table='events')} SELECT row_id FROM r WHERE rn <= 5000")
def exact_sample(spark, sf):
    return rk.sample_rows(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), 5000, ["row_id"])


@query("t06_exact_split", f"""WITH {RANKED.format(id='event_id', group='1', table='events')}
  SELECT row_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")
def exact_split(spark, sf):
    return rk.split_rows(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), ["row_id"])


@query("t07_stratified_split", f"""WITH {RANKED.format(id='vec_id', group='label', table='embeddings')}
  SELECT row_id, g AS label, CASE WHEN rn <= n - floor(n * 0.2 + 0.5) THEN 'train' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, sf):
    return rk.stratified_split(vectors(spark, sf).select("row_id", "label"), "label", ["row_id"])


@query("v02_stratified_folds", f"""WITH {RANKED.format(id='event_id', group='event_type', table='events')}
  SELECT row_id, g AS event_type, ((rn - 1) % 5)::INTEGER AS fold FROM r""")
def stratified_folds(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type")
    return rk.stratified_folds(rows, "event_type", ["row_id"])


@query("x13_md5_prefix", "SELECT doc_id AS row_id, left(md5(text), 16) AS digest FROM documents")
def md5_prefix(spark, sf):
    return documents(spark, sf).select("row_id", tx.md5_prefix(F.col("message")).alias("digest"))
