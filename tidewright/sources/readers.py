"""Readers of raw files. All return DataFrames; what a reader can't read it skips or reports as its docstring says."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.requests import request_blocks


def read_csv(spark: SparkSession, path: str, separator: str = ",", recursive: bool = True) -> DataFrame:
    """Delimited text with a header; every column is a string, unreadable files are skipped."""
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"')
    return reader.option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).csv(path)


def read_delimited(spark: SparkSession, folder: str) -> DataFrame:
    """Every .csv and .tsv below a folder as one table; columns that a file lacks are null."""
    found = None
    for pattern, separator in (("*.csv", ","), ("*.tsv", "\t")):
        reader = spark.read.option("header", True).option("sep", separator).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        part = reader.option("multiLine", True).option("escape", '"').csv(folder)
        if part.columns:
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise FileNotFoundError(f"no .csv or .tsv below {folder}")
    return found


def read_requests_text(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Requests of files of concatenated requests, each from a verb at a line's beginning; one label a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.explode(request_blocks("value")).alias("raw"), F.lit(label).alias("label"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An attribute-relation file: attributes name the columns, % lines are comments, rows follow @data."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^%.*$", "").alias("v"))
    head = F.regexp_extract("v", r"(?ism)\A(.*?)^@data\s*$", 1)
    names = F.regexp_extract_all(head, F.lit(r"(?im)^@attribute\s+'?([^\s']+)'?"), 1)
    first = lines.select(names.alias("n")).first()
    columns = first["n"] if first else []
    body = F.regexp_extract("v", r"(?ism)^@data\s*$(.*)\z", 1)
    rows = lines.select(F.explode(F.split(body, r"\r?\n")).alias("line")).filter(F.trim("line") != "")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.select(F.from_csv("line", schema, {"quote": "'", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """text and family (the file's stem) of files of one JSON object a line; malformed lines go."""
    rows = spark.read.schema("text string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.select("text", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("family")).filter("text IS NOT NULL")


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One payload a line; blank lines and lines of # are left out; each as the id of a GET request."""
    lines = spark.read.text(path).select(F.trim("value").alias("payload")).filter("payload <> '' AND NOT startswith(payload, '#')")
    raw = F.concat(F.lit("GET /test?id="), "payload", F.lit(" HTTP/1.1\r\n"))
    return lines.select("payload", F.concat(F.lit("id="), "payload").alias("query_string"), raw.alias("raw"), F.lit(1).alias("label"))


def read_parquet_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every Parquet file below a folder; unreadable ones are skipped."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", True)
    return reader.option("mergeSchema", True).parquet(folder)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow files below a path, whose columns the schema names; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(content.as_buffer())) as file:
                    for k in range(file.num_record_batches):
                        yield file.get_batch(k)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, schema)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, expected: str) -> bool:
    """Whether a file has that checksum; an empty expectation is always met."""
    return not expected or checksums(spark, path).first()["sha256"] == expected.lower()


_VERBS = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"PATCH ", b"HEAD ", b"OPTIONS ")


def packets(content: bytes) -> Iterator[bytes]:
    """Link-layer frames of a classic capture file, either byte order; of other formats none."""
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(content[:4])
    at = 24
    while order and at + 16 <= len(content):
        size = struct.unpack_from(order + "I", content, at + 8)[0]
        yield content[at + 16 : at + 16 + size]
        at += 16 + size


def tcp_payload(frame: bytes) -> bytes:
    """The payload of a TCP segment in IPv4 in Ethernet; empty for anything else."""
    if len(frame) < 54 or frame[12:14] != b"\x08\x00" or frame[23] != 6:
        return b""
    ip = 14 + (frame[14] & 15) * 4
    if ip + 13 > len(frame):
        return b""
    end = 14 + int.from_bytes(frame[16:18], "big")
    return frame[ip + (frame[ip + 12] >> 4) * 4 : end]


def read_pcap(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """method, uri, headers (map) and body of the requests in capture files: of all packets, or of the first `most` a file.

    With `most`, packets_left tells how many packets of a request's file were not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(0):
                frames = list(packets(content.as_py()))
                looked = frames if most is None else frames[:most]
                for payload in map(tcp_payload, looked):
                    if not payload.startswith(_VERBS):
                        continue
                    head, _, body = payload.partition(b"\r\n\r\n")
                    first, *lines = head.decode("latin-1").split("\r\n")
                    parts = first.split(" ")
                    if len(parts) >= 2:
                        named = dict(x.split(":", 1) for x in lines if ":" in x)
                        rows.append((parts[0], parts[1], [(a.strip(), b.strip()) for a, b in named.items()], body.decode("latin-1"), len(frames) - len(looked)))
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["method", "path", "headers", "body", "packets_left"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    found = files.mapInArrow(run, "method string, path string, headers map<string,string>, body string, packets_left long")
    return found.drop("packets_left") if most is None else found
