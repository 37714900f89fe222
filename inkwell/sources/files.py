"""File sources and sinks.

Readers declare their schema (no inference).  Writers are Spark's own
writers: JSON Lines, CSV, parquet, partitioned by the grouping columns;
nothing is gathered into one task or the driver to write it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.ordering import rank_within
from inkwell.session import materialize, read_parquet_if_there

LABELLED_SCHEMA = T.StructType([T.StructField("text", T.StringType()),
                                T.StructField("result", T.StringType())])


# --- S1 / S2 / S12: labelled JSON ------------------------------------------------

def read_labelled_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """``{text, result}`` records; ``result`` may be a number or a
    string ("0"/"1") and is cast to INT (M10, ``try_cast``: dirty labels
    become null and are dropped by the label split).  ``array_file`` reads
    the reference layout (one pretty-printed JSON array per file)."""
    df = spark.read.schema(LABELLED_SCHEMA).option("multiLine", array_file).json(path)
    return df.select("text", F.expr("try_cast(result AS INT)").alias("result"))


def label_split(df: DataFrame, label: str = "result") -> tuple[DataFrame, DataFrame]:
    """(human, machine) rows; other labels are dropped silently."""
    return df.where(F.col(label) == 0), df.where(F.col(label) == 1)


def write_labelled_json(df: DataFrame, path: str, partition_by: list[str] | None = None,
                        mode: str = "overwrite") -> None:
    """JSON Lines (UTF-8, non-ASCII kept), one folder per
    partition value (e.g. ``language``/``generator``)."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


# --- S3: CSV with multi-line quoted text -----------------------------------------

def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: header row, quoted fields that may contain newlines and doubled
    quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                 .option("quote", '"').option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("quoteAll", True).csv(path))


# --- S4: line-aligned text files ----------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file (or of a folder of part files) with their
    position: ``file_idx`` (rank of the file path) and ``line`` (0-based in
    the file).  Lines keep their trailing newline, as ``readlines`` does.
    Files are read by splittable scans; a line's number is its rank by (block
    of the file, place in the block), counted by range partitions."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    ranked = rank_within(raw, ["file"], ["_block", "_at"], "line")
    # The last line has no newline if the lines with one each exceed the file.
    files = ranked.groupBy("file").agg(F.count("*").alias("_n"), (F.sum(F.octet_length("value") + 1) > F.max("_size")).alias("_open"))
    files = files.withColumn("file_idx", F.dense_rank().over(Window.orderBy("file")) - 1)  # one row per file
    last = (F.col("line") == F.col("_n")) & F.col("_open")
    return ranked.join(files, "file").select(
        "file_idx", (F.col("line") - 1).cast("int").alias("line"),
        F.when(last, F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("value"))


def write_lines(df: DataFrame, path: str, order_col: str, value_col: str, n_files: int | None = None,
                max_records: int = 100_000) -> None:
    """Text sink of one column: rows go to part file ``hash(order_col) mod
    n_files`` sorted by ``order_col`` — a deterministic function of the
    row, so every column written this way lines up file by file and line
    by line (range bounds, being sampled, would not be guaranteed to).
    Without ``n_files``, as many as hold ``max_records`` lines on average."""
    n_files = n_files or max(1, -(-df.count() // max_records))
    (df.repartition(n_files, order_col).sortWithinPartitions(order_col)
       .select(F.col(value_col).alias("value"))
       .write.mode("overwrite").option("maxRecordsPerFile", max_records).text(path))


def write_aligned(df: DataFrame, path: str, order_cols: list[str], columns: list[str], lines_per_file: int = 100_000) -> None:
    """S4 sink of several columns: ``path/<column>/file_no=k`` holds lines
    k * lines_per_file ... of that column in the order of ``order_cols`` (a
    total order), one text file each; ``path/manifest`` says where each file
    starts and how many lines it has.

    Rows are numbered once, by prefix counts over range partitions, and all
    columns are written from that numbered table: their lines agree whatever
    tasks are retried, and the number of files follows the rows.  A null is an
    empty line; a value with a line break is an error."""
    rows = rank_within(df.select(*dict.fromkeys([*order_cols, *columns])), None, order_cols, "_n")
    rows = materialize(rows.withColumn("file_no", F.expr(f"cast((_n - 1) div {lines_per_file} as int)")))
    files = rows.groupBy("file_no").agg((F.min("_n") - 1).alias("first_line"), F.count("*").alias("n_lines"))
    files.write.mode("overwrite").parquet(f"{path}/manifest")
    n_files = max(1, files.count())
    placed = rows.repartition(n_files, "file_no").sortWithinPartitions("file_no", "_n")
    for c in columns:
        line = F.coalesce(F.col(c), F.lit(""))
        one = F.when(F.contains(line, F.lit("\n")), F.raise_error(F.lit(f"a value of {c} has a line break"))).otherwise(line)
        placed.select("file_no", one.alias("value")).write.mode("overwrite").partitionBy("file_no").text(f"{path}/{c}")


def read_aligned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of :func:`write_aligned` again, joined by file and line, with
    ``line_no`` counted over all files.  A file that does not have the lines
    the manifest names is an error."""
    manifest = spark.read.parquet(f"{path}/manifest")
    out = None
    for c in columns:
        raw = spark.read.schema("value string, file_no int").option("lineSep", "\n").text(f"{path}/{c}").select(
            "file_no", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
            F.col("value").alias(c))
        lines = rank_within(raw, ["file_no"], ["_block", "_at"], "_line").select("file_no", "_line", c)
        got = lines.groupBy("file_no").agg(F.count("*").alias("_got"))
        sizes = manifest.join(got, "file_no", "left").select("file_no", "first_line", F.when(
            F.col("_got").eqNullSafe(F.col("n_lines")), F.col("n_lines")).otherwise(
            F.raise_error(F.lit(f"a file of {c} does not have the lines of the manifest")).cast("long")).alias("_ok"))
        lines = lines.join(sizes, "file_no").where("_line <= _ok").withColumn("line_no", F.col("first_line") + F.col("_line") - 1)
        lines = lines.select("line_no", c)
        out = lines if out is None else out.join(lines, "line_no")
    return out


def read_line_pair(spark: SparkSession, left: str, right: str, names=("prompt", "story")) -> DataFrame:
    """S4 + J3: two line-aligned files joined on (file, line)."""
    a = read_lines(spark, left).withColumnRenamed("value", names[0])
    b = read_lines(spark, right).withColumnRenamed("value", names[1])
    return a.join(b, ["file_idx", "line"])


# --- S5 / S6 / S17: paired corpora and run arguments --------------------------------

PAIR_SCHEMA = "pair_id long, original string, sampled string"
PERTURBED_SCHEMA = ("original string, sampled string, perturbed_original array<string>, "
                    "perturbed_sampled array<string>")
COLUMNAR_SCHEMA = "original array<string>, sampled array<string>"


def write_pairs(pairs: DataFrame, prefix: str, args: dict) -> None:
    """Pairs as JSON Lines rows (``{prefix}.raw_data``) and the run
    arguments as a one-row JSON table (``{prefix}.args``)."""
    pairs.write.mode("overwrite").json(f"{prefix}.raw_data")
    spark = pairs.sparkSession
    spark.createDataFrame([args]).coalesce(1).write.mode("overwrite").json(f"{prefix}.args")


def read_pairs(spark: SparkSession, prefix: str, columnar: bool = False,
               perturbed: bool = False, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, args).  ``columnar`` reads the reference layout
    ``{original: [...], sampled: [...]}`` (D5) and numbers the pairs by
    position (``posexplode(arrays_zip)``); ``perturbed`` reads the list
    form with perturbation arrays (D6: a JSON array of records, or with
    ``rows`` the splittable record-a-line form that ``write_pairs`` makes)."""
    args = spark.read.json(f"{prefix}.args")
    if perturbed and rows:
        return spark.read.schema(f"pair_id long, {PERTURBED_SCHEMA}").json(f"{prefix}.raw_data"), args
    if perturbed:
        d = spark.read.schema(PERTURBED_SCHEMA).option("multiLine", True).json(f"{prefix}.raw_data")
        return d, args
    if not columnar:
        return spark.read.schema(PAIR_SCHEMA).json(f"{prefix}.raw_data"), args
    d = spark.read.schema(COLUMNAR_SCHEMA).option("multiLine", True).json(f"{prefix}.raw_data")
    z = d.select(F.posexplode(F.arrays_zip("original", "sampled")).alias("pair_id", "p"))
    return z.select(F.col("pair_id").cast("long"), "p.original", "p.sampled"), args


# --- S7 / E21: directory glob with keys from the path --------------------------------

def read_with_path(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """A glob of JSON files with each row's source path."""
    return (spark.read.schema(schema).json(pattern)
                 .withColumn("path", F.col("_metadata.file_path")))


def hive_key(path_col: str, key: str):
    """E21 for partitioned folders: the value of ``key=...`` in a path."""
    return F.regexp_extract(F.col(path_col), f"{key}=([^/]+)", 1)


# --- S11: cached feature tables ---------------------------------------------------------

def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read a parquet feature table, or compute, write and read it
    when the path is absent."""
    found = read_parquet_if_there(spark, path)
    if found is None:
        compute().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


# --- S16: layer-partitioned vectors -------------------------------------------------------

def write_by_layer(df: DataFrame, path: str) -> None:
    """One folder per layer, so a fixed-layer read is pruned."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)


# --- S18: appended result records ---------------------------------------------------------

RESULT_SCHEMA = ("sampling_model_name string, scoring_model_name string, dataset_path string, "
                 "auroc double, batch string")


def append_results(records: DataFrame, path: str) -> None:
    """Append result records; earlier runs' records stay."""
    records.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All records so far; a missing store is empty, and so is a file of
    it that is corrupt (other failures are raised)."""
    found = read_parquet_if_there(spark, path, RESULT_SCHEMA)
    if found is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).option("ignoreCorruptFiles", True).parquet(path)


# --- S13 / S22: score files and training logs ----------------------------------------------

def read_score_file(spark: SparkSession, path: str) -> DataFrame:
    """``{human_probs: [...], llm_probs: [...]}`` -> labelled rows."""
    d = spark.read.schema("human_probs array<double>, llm_probs array<double>") \
        .option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    h = d.select("path", F.explode("human_probs").alias("score"), F.lit(0).alias("label"))
    m = d.select("path", F.explode("llm_probs").alias("score"), F.lit(1).alias("label"))
    return h.unionByName(m)


def parse_training_log(lines: DataFrame, value_col: str = "value", order_col: str = "line") -> DataFrame:
    """``layer_num = k`` header lines and ``Epoch [e/E], Loss: x,
    Validation Accuracy: y`` lines -> (layer, epoch, loss, val_acc); the
    layer is carried forward from the last header line."""
    v = F.col(value_col)
    x = lines.select(
        order_col,
        F.when(v.rlike(r"^layer_num\s*=\s*\d+"),
               F.regexp_extract(v, r"^layer_num\s*=\s*(\d+)", 1).cast("int")).alias("_layer"),
        F.regexp_extract(v, r"Epoch \[(\d+)/\d+\]", 1).alias("_ep"),
        F.regexp_extract(v, r"Loss: ([-0-9.eE]+)", 1).alias("_loss"),
        F.regexp_extract(v, r"Validation Accuracy: ([-0-9.eE]+)", 1).alias("_acc"))
    # One ordered pass over a training log (a few lines per layer and
    # epoch of one experiment: bounded by the experiment, not the corpus).
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("layer", F.last("_layer", ignorenulls=True).over(w))
    return (x.where(F.col("_ep") != "")
             .select("layer", F.col("_ep").cast("int").alias("epoch"),
                     F.col("_loss").cast("double").alias("loss"), F.col("_acc").cast("double").alias("val_acc")))
