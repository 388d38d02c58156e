"""Label frequencies, class lists, distributions and imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions import labels as lb
from tracewright.functions.numbers import percentage, ratio_to_at_least_one, safe_ratio
from tracewright.operators.joining import explode_values, lookup_join

# Attack groups and the terms that put an attack type into them.
ATTACK_GROUPS = [
    ("web_attacks", ["xss", "sql", "injection", "csrf", "lfi", "rfi"]),
    ("network_attacks", ["dos", "ddos", "scan", "brute", "flood"]),
    ("system_attacks", ["privilege", "escalation", "backdoor", "trojan"]),
    ("data_attacks", ["exfiltration", "leak", "theft", "breach"]),
]


def with_total(counts: DataFrame, rows: DataFrame, name: str = "total") -> DataFrame:
    """Attach the row count of ``rows`` as a scalar subquery."""
    return counts.withColumn(name, rows.agg(F.count("*").alias("n")).scalar())


def distinct_labels(rows: DataFrame) -> DataFrame:
    label = explode_values(rows, [], "labels", "label")
    return label.where(F.col("label") != "").distinct()


def class_list(rows: DataFrame) -> DataFrame:
    """One row: the sorted list of all labels."""
    return distinct_labels(rows).agg(F.sort_array(F.collect_list("label")).alias("classes"))


def class_lists_by(rows: DataFrame, key: str = "log_type") -> DataFrame:
    """One sorted label list per key; keys without any label get an empty list."""
    pairs = rows.select(key, F.explode_outer("labels").alias("label")).distinct()
    named = F.when(F.col("label") != "", F.col("label"))
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(named)).alias("classes"))


def attach_label_vectors(rows: DataFrame, lists: DataFrame, key: str | None = "log_type") -> DataFrame:
    """Add ``classes`` and the binary ``label_vector``.

    ``lists`` has one row per log type, or a single row when ``key`` is None;
    the latter is attached as a scalar subquery. The per-type table is measured
    and broadcast, so rows aren't shuffled by type.
    """
    if key is None:
        joined = rows.withColumn("classes", lists.select("classes").scalar())
    else:
        joined = lookup_join(rows, lists.select(key, "classes"), [key], "left")
    return joined.withColumn("label_vector", lb.label_vector(F.col("labels"), F.col("classes")))


def label_frequency(rows: DataFrame) -> DataFrame:
    counts = explode_values(rows, [], "labels", "label").groupBy("label").agg(F.count("*").alias("n_rows"))
    counts = with_total(counts, rows)
    return (counts.select("label", "n_rows", percentage(F.col("n_rows"), F.col("total")).alias("pct"))
            .orderBy(F.desc("n_rows"), "label"))


def attack_normal_counts(rows: DataFrame, *keys: str) -> DataFrame:
    attack = F.count_if(F.size("labels") > 0)
    normal = F.count_if(F.size("labels") == 0)
    total = F.count("*")
    return rows.groupBy(*keys).agg(
        attack.alias("attack_rows"), normal.alias("normal_rows"),
        percentage(attack, total).alias("attack_pct"), percentage(normal, total).alias("normal_pct"))


def value_distribution(rows: DataFrame, column: str) -> DataFrame:
    counts = with_total(rows.groupBy(column).agg(F.count("*").alias("n_rows")), rows)
    return (counts.select(column, "n_rows", percentage(F.col("n_rows"), F.col("total")).alias("pct"))
            .orderBy(F.desc("n_rows"), column))


def files_per_type(files: DataFrame) -> DataFrame:
    return files.groupBy("log_type").agg(F.count("*").alias("n_files"))


def label_rollup(rows: DataFrame) -> DataFrame:
    """Label counts per log type, per type total and overall in one pass."""
    pairs = explode_values(rows, ["log_type"], "labels", "label")
    return (pairs.rollup("log_type", "label")
            .agg(F.count("*").alias("n_labels"), F.grouping_id().cast("int").alias("level")))


def top_combinations(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent label combinations, with how many more exist."""
    combos = (rows.groupBy(lb.label_combination(F.col("labels")).alias("combination"))
              .agg(F.count("*").alias("n_rows")))
    others = combos.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n")).scalar()
    top = combos.orderBy(F.desc("n_rows"), "combination").limit(n)
    top = with_total(top, rows)
    return top.select("combination", "n_rows", percentage(F.col("n_rows"), F.col("total")).alias("pct"),
                      others.alias("more_combinations"))


def imbalance_overall(rows: DataFrame, vector: str = "label_vector") -> DataFrame:
    attack = F.count_if(lb.has_any_bit(F.col(vector)) == 1)
    normal = F.count("*") - attack
    return rows.agg(F.count("*").alias("total_samples"), normal.alias("normal_samples"),
                    attack.alias("attack_samples"),
                    ratio_to_at_least_one(normal, attack).alias("imbalance_ratio"))


def imbalance_per_class(rows: DataFrame, vector: str = "label_vector", classes: str = "classes") -> DataFrame:
    bits = explode_values(rows, [], F.arrays_zip(F.col(classes).alias("class"), F.col(vector).alias("bit")), "z")
    positive = F.sum(F.col("z.bit").cast("bigint"))
    total = F.count("*")
    return bits.groupBy(F.col("z.class").alias("class")).agg(
        positive.alias("positive"), (total - positive).alias("negative"),
        ratio_to_at_least_one(total - positive, positive).alias("imbalance_ratio"),
        (positive / total).alias("prevalence"))


def class_histogram(rows: DataFrame, label: str = "label") -> DataFrame:
    """Counts for every id from 0 to the largest, absent ids as 0."""
    counts = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    ids = counts.agg(F.explode(F.sequence(F.lit(0), F.max("label"))).alias("label"))
    return ids.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def spread(counts: Column) -> Column:
    return safe_ratio(F.stddev_pop(counts), F.avg(counts))


def balance_improvement(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Relative drop of population deviation / mean of the class histogram."""
    b0 = class_histogram(before, label).agg(spread(F.col("n")).alias("balance_before"))
    b1 = class_histogram(after, label).agg(spread(F.col("n")).alias("b")).scalar()
    both = b0.withColumn("balance_after", b1)
    gain = (F.col("balance_before") - F.col("balance_after")) / (F.col("balance_before") + F.lit(1e-8))
    return both.withColumn("balance_improvement", gain)


def oversampling_quality(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Size ratio, largest class ratio before and after, and their quotient."""
    def ratios(rows, tag):
        counts = rows.groupBy(label).agg(F.count("*").alias("n"))
        return counts.agg(F.sum("n").alias(f"rows_{tag}"), (F.max("n") / F.min("n")).alias(f"max_ratio_{tag}"))
    old = ratios(before, "before")
    new = ratios(after, "after")
    both = old.withColumn("new", new.select(F.struct("rows_after", "max_ratio_after")).scalar())
    return both.select(
        (F.col("new.rows_after") / F.col("rows_before")).alias("sample_increase"),
        F.col("max_ratio_before"), F.col("new.max_ratio_after").alias("max_ratio_after"),
        (F.col("max_ratio_before") / F.col("new.max_ratio_after")).alias("improvement_factor"))


def label_distributions(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    old = before.groupBy(label).agg(F.count("*").alias("n_before"))
    new = after.groupBy(label).agg(F.count("*").alias("n_after"))
    return old.join(new, label, "full").select(
        label, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def attack_groups(types: DataFrame, column: str = "label", groups=ATTACK_GROUPS) -> DataFrame:
    """(attack type, group); a type can be in several groups, types in none are in ``other``."""
    hits = F.filter(F.array(*[F.when(lb.contains_any(F.col(column), terms), name) for name, terms in groups]),
                    lambda g: g.isNotNull())
    hits = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other")))
    return types.select(column, F.explode(hits).alias("group"))


def fingerprint(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Row count, first and last text hashed to 16 hex digits, and a hash over all rows."""
    key = F.struct(*order)
    joined = F.concat_ws("_", F.count("*").cast("string"), F.min_by(text, key), F.max_by(text, key))
    # A slice of every row digest is summed, so an edit anywhere shows.
    every = F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"))
    return rows.agg(F.left(F.md5(joined), F.lit(16)).alias("fingerprint"), every.alias("content_sum"))


def top_per_key(rows: DataFrame, key: str, value: str, tie: str, n: int = 5) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
