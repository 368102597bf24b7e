"""Readers and sinks of flat files, with schemas given and never inferred; resumable batch sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.session import bounded


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, broken ones raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_postal(spark: SparkSession, path: str) -> DataFrame:
    """(zip, place, state) of a tab-separated postal file with the zip second, the place third and the state code fifth."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") > 4)
    return f.select(F.col("f")[1].alias("zip"), F.col("f")[2].alias("place"), F.col("f")[4].alias("state")).where(F.col("zip").rlike(r"^\d+$"))


def read_words(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Distinct alphabetic words of ``least`` letters or more, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= least)).distinct()


def read_yearly_names(spark: SparkSession, path: str, first: int = 1940, last: int = 1985, least: int = 200) -> DataFrame:
    """Names of yearly files ``…YYYY.txt`` with rows name,sex,count that reach ``least`` in a year of the span."""
    raw = spark.read.schema("name string, sex string, n long").csv(path).withColumn("year", F.regexp_extract(F.input_file_name(), r"(\d{4})\.\w+$", 1).cast("int"))
    return raw.where(F.col("year").between(first, last) & (F.col("n") >= least)).select("name").distinct()


def last_log_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows read from several logs the last one of each key by ``order`` stays."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report table as Markdown; a report of more than ``most`` rows raises, none is dropped."""
    rows = bounded(df, most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def write_model_record(spark: SparkSession, path: str, engine: str, preset: str, model: str) -> None:
    """The one-row record beside an output that says what made it: ``<path>.model.json``."""
    row = spark.createDataFrame([(engine, preset, model)], "engine string, preset string, model string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}.model.json")


def read_model_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("engine string, preset string, model string").json(f"{path}.model.json")


def write_bundle(spark: SparkSession, path: str, reports: dict[str, DataFrame], rows: dict[str, DataFrame], provenance: dict) -> DataFrame:
    """A result bundle: each report as CSV and Markdown, each row table as gzipped JSON lines, the provenance, and ``SHA256SUMS`` of all parts.

    Returns (file, sha256, bytes). Row tables are written by the executors; only reports, which are short, pass through the driver.
    """
    for name, df in reports.items():
        df.write.mode("errorifexists").csv(f"{path}/{name}.csv", header=True)
        spark.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{name}.md")
    for name, df in rows.items():
        df.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", False).json(f"{path}/{name}.jsonl")
    spark.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/provenance.json")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    sums = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    sums.select(F.concat_ws("  ", "sha256", "file")).coalesce(1).write.mode("errorifexists").text(f"{path}/SHA256SUMS")
    return sums


def header_digest(header: dict) -> str:
    return hashlib.sha256(json.dumps(header, sort_keys=True).encode()).hexdigest()


def append_batch(df: DataFrame, path: str, header: dict, batch_id: int, key: str) -> int:
    """Appends the rows whose key the sink does not hold yet; a resumed run must bring the same header.

    A batch that was written twice changes nothing, so a run that broke off can start over.
    """
    spark = df.sparkSession
    want = header_digest(header)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    old = spark.read.parquet(path) if there else None  # any other fault of reading is an error, not an empty sink
    if old is not None:
        if old.where(F.col("_header") != want).limit(1).count():
            raise ValueError("the sink was begun with another header")
        df = df.join(old.select(key), key, "left_anti")
    new = df.withColumn("_header", F.lit(want)).withColumn("_batch", F.lit(batch_id))
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("_batch") == batch_id).count()
