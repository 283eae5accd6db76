"""Writers: canonical tables with counts from the same pass, splits, gate outputs, reports and text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions.text import mark_line_ends
from tidewright.sources.files import report_path, write_atomic


def write_table(df: DataFrame, path: str) -> dict:
    """Writes canonical rows and gives total, benign and malicious, counted while writing."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("total"), F.sum((F.col("label") == 0).cast("long")).alias("benign"), F.sum((F.col("label") == 1).cast("long")).alias("malicious")]
    df.select(*schema.COLUMNS).observe(seen, *counts).write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def write_splits(df: DataFrame, path: str) -> None:
    """One folder a split, so that a reader of a split prunes the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_verdicts(judged: DataFrame, path: str) -> None:
    """Passed, rejected and quarantined rows in one pass, a folder each; only the last two carry a reason that is not null."""
    judged.write.mode("overwrite").partitionBy("verdict").parquet(path)


def write_report(df: DataFrame, root: str, name: str) -> str:
    """A short table as a JSON list in the report's place on the driver."""
    path = report_path(root, name)
    rows = [json.loads(r) for r in df.toJSON().collect()]
    write_atomic(path, json.dumps(rows, indent=2, ensure_ascii=False).encode())
    return path


def write_csv_report(df: DataFrame, path: str) -> None:
    """A short table as one CSV file, floats with five decimals."""
    shown = [F.format_string("%.5f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_corpus_text(df: DataFrame, path: str, raw: str = "raw") -> int:
    """One request a line with its line ends marked; gives the number of replacement characters met."""
    seen = Observation()
    text = mark_line_ends(raw)
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    df.select(text.alias("value")).filter("value IS NOT NULL").observe(seen, F.sum(F.length("value") - F.length(F.replace("value", F.lit("�"), F.lit("")))).alias("bad")).write.mode("overwrite").text(path)
    return seen.get["bad"] or 0


def manifest(spark, entries: list[dict]) -> DataFrame:
    """What was acquired: name, path, status, size, rows, licence and time."""
    names = ["name", "path", "status", "n_bytes", "n_rows", "licence"]
    rows = [tuple(e.get(n) for n in names) for e in entries]
    df = spark.createDataFrame(rows, "name string, path string, status string, n_bytes long, n_rows long, licence string")
    return df.withColumn("acquired_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def put(spark, path: str, content: bytes) -> None:
    """A small file of the driver's, in any file system that Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_arrow(df: DataFrame, path: str) -> None:
    """A short table as one Arrow file, uncompressed, for readers that map it into memory."""
    table, buffer = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_file(buffer, table.schema) as out:
        out.write_table(table)
    put(df.sparkSession, path, buffer.getvalue().to_pybytes())
