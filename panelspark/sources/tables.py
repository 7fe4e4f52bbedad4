"""Scans and sinks: Parquet, CSV, JSON, globs, immutable JSON, two-audience reports, content manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.contracts import safe_projection


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a temporary one in local sessions without that."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, made_by: str = "an earlier step") -> DataFrame:
    """A Parquet table; a missing one names the step that makes it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing: {made_by} writes it") from e


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to a scratch folder and read back: many jobs can share it, and lost executors lose none of it."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tables(spark: SparkSession, folder: str, glob: str = "*.parquet", columns: Sequence[str] = ()) -> DataFrame:
    """All files of a folder that fit, as one table; the columns asked for must be there."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder)
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"{folder} lacks columns: {sorted(missing)}")
    return df


def read_binary_targets(spark: SparkSession, folder: str, target: str = "y_true") -> DataFrame:
    """All files of a folder but those whose target isn't 0 or 1."""
    df = spark.read.option("recursiveFileLookup", True).parquet(folder).withColumn("_file", F.col("_metadata.file_path"))
    good = df.groupBy("_file").agg(F.bool_and(F.coalesce(F.col(target).isin(0, 1), F.lit(False))).alias("ok")).where("ok").select("_file")
    return df.join(good, "_file", "left_semi").drop("_file")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """By extension; an absent file is an empty table."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.schema(schema)
    try:
        df = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)
        df.isEmpty()
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_once(df: DataFrame, path: str) -> None:
    """Evidence that is never overwritten."""
    df.write.mode("errorifexists").json(path)


def write_two_lane(detail: DataFrame, private: str, public: str, allowed: Sequence[str]) -> None:
    """The whole table for one audience; listed, rounded columns for the other."""
    write_table(detail, private)
    safe_projection(detail, allowed).write.mode("overwrite").json(public)


def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path and status of each file: ok, missing, unexpected or changed."""
    now, then = build_manifest(spark, folder).alias("n"), manifest.alias("t")
    status = F.when(F.col("n.path").isNull(), "missing").when(F.col("t.path").isNull(), "unexpected").when(F.col("n.sha256") != F.col("t.sha256"), "changed").otherwise("ok")
    return now.join(then, F.col("n.path") == F.col("t.path"), "full").select(F.coalesce("n.path", "t.path").alias("path"), status.alias("status"))


def rate_csv(spark: SparkSession, path: str, series: str, start_year: int) -> DataFrame:
    """A rate series from CSV files with a preamble: the header row starts with "Time Period"; the column is found by exact, suffix or contained name."""
    lines = spark.read.text(path).withColumns({"file": F.col("_metadata.file_path"), "n": F.monotonically_increasing_id()})
    head = lines.where(F.regexp_replace("value", '"', "").startswith("Time Period")).groupBy("file").agg(F.min_by(F.split(F.regexp_replace("value", '"', ""), ","), "n").alias("names"), F.min("n").alias("head"))
    names = F.transform("names", lambda x: F.trim(x))

    def first(test):
        return F.array_position(F.transform(names, test), True)

    at = F.coalesce(F.nullif(first(lambda x: x == series), F.lit(0)), F.nullif(first(lambda x: x.endswith(series)), F.lit(0)), F.nullif(first(lambda x: x.contains(series)), F.lit(0)))
    rows = lines.join(F.broadcast(head.withColumn("at", at.cast("int"))), "file").where("n > head AND at IS NOT NULL")  # a header a file
    cells = F.split(F.regexp_replace("value", '"', ""), ",")
    out = rows.select(F.trim(F.get(cells, F.lit(0))).try_cast("date").alias("date"), F.trim(F.get(cells, F.col("at") - 1)).try_cast("double").alias("value"))
    return out.where(F.col("date").isNotNull() & F.col("value").isNotNull() & (F.year("date") >= start_year))
