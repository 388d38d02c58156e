"""Trees of raw log files and of line-level JSON label files."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracewright.functions import text as tx
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

LABEL_SCHEMA = T.StructType([
    T.StructField("line", T.LongType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("rules", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# One row per block (some 128 MB of text), so this bound is tens of terabytes of logs.
MAX_BROADCAST_BLOCKS = 200_000

# File name endings that stand for a text type.
TEXT_SUFFIXES = tuple(sorted(e for e, t in mimetypes.MimeTypes().types_map[True].items() if t.startswith("text/")))


def relative_path(path: Column, root: str, encoded: bool = False) -> Column:
    """Path below ``root``; file URIs come back with one or three slashes, metadata paths URL-encoded."""
    if encoded:
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(path, r"^file:/+", "/")
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    at = F.instr(plain, base)
    return F.when(at > 0, F.substring(plain, at + len(base), F.length(plain))).otherwise(plain)


def tree_roots(spark: SparkSession, root: str) -> list[str]:
    """``root``, and the folders below it that Spark's listing passes over because their names begin with _ or a dot.

    Files whose names begin with a dot are left out by rule. A file that begins
    with _ can't be read by Spark's sources at all: unless it is empty (a
    success mark), that is an error rather than silent loss.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    roots, level = [root], root.rstrip("/")
    while True:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/[_.]*")) or []
        for status in found:
            path = status.getPath()
            name = path.getName()
            if name.startswith("_") and "=" in name:
                continue
            if status.isDirectory():
                roots.append(path.toString())
            elif name.startswith("_") and status.getLen():
                raise ValueError(f"Spark's readers pass over files that begin with _: {path.toString()}")
        level += "/*"
        if not len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(level)) or []):
            return roots


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, rel_path, bytes of every file below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(tree_roots(spark, root)).select("path", relative_path(F.col("path"), root).alias("rel_path"),
                                     F.col("length").alias("bytes"))
    return files.where(~tx.is_hidden(F.col("rel_path")))


def scan_lines(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Raw lines with file, block and a position that grows in reading order within a block.

    ``file`` is the path as Spark reports it; relative paths and everything
    else that depends on the file alone are worked out on file-level tables.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(tree_roots(spark, root)).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_BLOCKS else table


def block_table(lines: DataFrame) -> DataFrame:
    """file, block, first_pos, n_lines and lines_before of every block, one small row each; written once and read from there.

    A task reads a block front to back, so ``pos`` counts up by one inside a
    block, and first position and line count turn it into a file-wide number.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return settle(blocks.withColumn("lines_before", F.coalesce(F.sum("n_lines").over(before), F.lit(0))), "blocks")


def _line_number() -> Column:
    offset = F.col("pos") - F.col("first_pos")
    inside = (offset >= 0) & (offset < F.col("n_lines"))
    return F.when(inside, F.col("lines_before") + offset + 1).otherwise(
        F.raise_error(F.lit("line position outside its block")).cast("bigint"))


def number_lines(lines: DataFrame, root: str, strict_types: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """(rel_path, tenant, log_type, line_no, value) with 1-based line numbers per file.

    No line is shuffled or sorted: the block rows (``block_table``, made here
    unless given) carry path, tenant, type and the lines before. Both uses of
    ``lines`` read one file listing, hence the same task layout; a mismatch
    would put the position outside the block and fails the job.
    """
    blocks = block_table(lines) if blocks is None else blocks
    blocks = blocks.withColumn("rel_path", relative_path(F.col("file"), root, encoded=True))
    blocks = blocks.withColumn("tenant", tx.tenant(F.col("rel_path"))).withColumn(
        "log_type", tx.log_type(F.col("rel_path"), strict_types))
    return (lines.join(_small(blocks), ["file", "block"])
            .select("rel_path", "tenant", "log_type", _line_number().alias("line_no"), "value"))


def read_log_lines(spark: SparkSession, root: str, pattern: str | None = None, strict_types: bool = False) -> DataFrame:
    """Numbered non-blank lines; numbers count physical lines, blank ones included."""
    numbered = number_lines(scan_lines(spark, root, pattern), root, strict_types)
    return numbered.where(~tx.is_blank(F.col("value")))


def text_files(lines: DataFrame, root: str, text_suffixes: tuple[str, ...] = TEXT_SUFFIXES,
               blocks: DataFrame | None = None) -> DataFrame:
    """rel_path of files that look like text: a text suffix, or no NUL in the first 1024 bytes.

    Only the first 1024 lines of a file can start inside that window, so rows
    are cut by position before the shuffle and the running byte offset is over
    a bounded group.
    """
    blocks = block_table(lines) if blocks is None else blocks
    first = blocks.where(F.col("block") == 0).select("file", "first_pos")
    opening = (lines.where(F.col("block") == 0).join(_small(first), "file").where(F.col("pos") < F.col("first_pos") + 1024)
               .select("file", "pos", F.col("value").cast("binary").alias("raw")))
    upto = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    opening = opening.withColumn("start", F.coalesce(F.sum(F.octet_length("raw") + 1).over(upto), F.lit(0)))
    window = F.greatest(F.lit(1024) - F.col("start"), F.lit(0)).cast("int")
    has_nul = F.hex(F.substring(F.col("raw"), F.lit(1), window)).rlike("^(?:..)*?00")
    flags = opening.groupBy("file").agg(F.bool_or(has_nul).alias("binary"))
    flags = flags.withColumn("rel_path", relative_path(F.col("file"), root, encoded=True))
    named = F.lit(False)
    for ending in text_suffixes:
        named = named | F.endswith(F.lower("rel_path"), F.lit(ending))
    return flags.where(named | ~F.col("binary")).select("rel_path")


def parse_label_lines(lines: DataFrame, root: str) -> DataFrame:
    """(rel_path, line_no, labels), one row per line; malformed lines dropped, last duplicate wins.

    A file counts if one of its first five physical lines parses as JSON. A
    single label in place of a list counts as a list of one, null as no label.
    Lines are read twice: for the block table, and for labels and openings.
    """
    number = _line_number()
    numbered = lines.join(_small(block_table(lines)), ["file", "block"]).withColumn("n", number)
    parses = F.try_parse_json(F.nullif(tx.strip(F.col("value")), F.lit(""))).isNotNull()
    item = F.from_json("value", "line bigint, labels string")
    named = F.coalesce(F.array_contains(F.json_object_keys("value"), "labels"), F.lit(False))
    rows = settle(numbered.select(
        "file", "block", "pos", ((F.col("n") <= 5) & parses).alias("opens"), named.alias("named"), item["line"].alias("line_no"), item["labels"].alias("text"))
        .where(F.col("opens") | (F.col("named") & F.col("line_no").isNotNull())), "label-lines")
    files = settle(rows.where("opens").select("file").distinct(), "label-files")
    rows = rows.where(F.col("named") & F.col("line_no").isNotNull()).join(_small(files), "file", "left_semi")
    as_list = F.from_json("text", "array<string>")
    labels = (F.when(F.col("text").isNull(), F.array().cast("array<string>"))
              .when(F.startswith("text", F.lit("[")), F.coalesce(as_list, F.array("text"))).otherwise(F.array("text")))
    rows = rows.withColumn("labels", labels)
    last = rows.groupBy("file", "line_no").agg(F.max_by("labels", F.struct("block", "pos")).alias("labels"))
    return last.select(relative_path(F.col("file"), root, encoded=True).alias("rel_path"), "line_no", "labels")


def read_labels(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    return parse_label_lines(scan_lines(spark, root, pattern), root)


def read_label_rules(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, line, label, rule), one row per rule named for a label."""
    rows = (spark.read.schema(LABEL_SCHEMA).option("recursiveFileLookup", True).json(tree_roots(spark, root))
            .select(relative_path(F.col("_metadata.file_path"), root, encoded=True).alias("rel_path"), "line", "rules"))
    return (rows.select("rel_path", "line", F.explode("rules").alias("label", "ids"))
            .select("rel_path", "line", "label", F.explode("ids").alias("rule")))


def match_label_files(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """log_path -> label_path: label name starts with the log stem, in any folder.

    Preference: same suffix, then both suffixes numeric, then path order; a
    single candidate needs no preference. Each label name is expanded into its
    own prefixes, so candidates are found by equality. The best label per
    prefix and kind is picked first; a log file then looks up one row per kind,
    however many files share its stem.
    """
    name = tx.file_name(F.col("rel_path"))
    left = logs.select(F.col("rel_path").alias("log_path"), tx.stem(name).alias("stem"),
                       tx.suffix(name).alias("ending"), tx.numeric_suffix(name).alias("numbered"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))
    right = labels.select(F.col("rel_path").alias("path"), tx.suffix(name).alias("ending"),
                          tx.numeric_suffix(name).alias("numbered"), F.explode(prefixes).alias("stem"))
    by_any = right.groupBy("stem").agg(F.min("path").alias("any_path"),
                                       F.min(F.when(F.col("numbered"), F.col("path"))).alias("numbered_path"))
    by_ending = right.groupBy("stem", "ending").agg(F.min("path").alias("same_path"))
    found = lookup_join(left, by_any, ["stem"], "inner")
    found = lookup_join(found, by_ending, ["stem", "ending"], "left")
    best = F.coalesce("same_path", F.when(F.col("numbered"), F.col("numbered_path")), "any_path")
    return found.select("log_path", best.alias("label_path"))


def join_labels(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Every line with its labels; lines without a label get an empty list.

    The key (file, line) is nearly unique, so one huge file still spreads evenly.
    """
    joined = lines.join(labels.select("rel_path", "line_no", "labels"), ["rel_path", "line_no"], "left")
    return joined.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
