"""Queries of readers and writers: tables are written to the shared folder in a raw format and read back by the reader."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from tidewright.functions import grammar
from tidewright.operators import gate, requests, splits
from tidewright.plans.corpus import LABELLED, labelled
from tidewright.plans.registry import query
from tidewright.session import scratch, table
from tidewright.sources import files, readers, sinks


def as_requests(spark, sf_dir):
    """Documents with labels as canonical requests: the text is the body of a POST."""
    rows = labelled(spark, sf_dir).withColumns({"method": F.lit("POST"), "path": F.concat(F.lit("/doc/"), "id"), "body": F.col("raw"), "raw": F.lit("")})
    return requests.normalise(rows.withColumn("id", F.col("id").cast("string")))


@query("csv_scan", "SELECT CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def csv_scan(spark, sf_dir):
    """Two delimited files with quotes and line ends in fields, read as one table of strings."""
    folder = scratch(spark, "csv")
    kept = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.options(**kept).csv(f"{folder}/a")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("item_id"), F.col("r_name").alias("text")).write.options(**kept).csv(f"{folder}/b")
    return readers.read_csv(spark, folder)


@query(
    "delimited_scan",
    "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, NULL AS region FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), NULL, r_name FROM region",
)
def delimited_scan(spark, sf_dir):
    """A comma-separated and a tab-separated file by their endings; a column that one lacks is null."""
    folder = scratch(spark, "delimited")
    for name, end, separator, column in (("nation", "csv", ",", "name"), ("region", "tsv", "\t", "region")):
        rows = [separator.join(("id", column)), *(f"{r[0]}{separator}{r[1]}" for r in table(spark, sf_dir, name).collect())]
        sinks.put(spark, f"{folder}/{name}.{end}", "\n".join(rows).encode())
    return readers.read_delimited(spark, folder)


@query("request_text_scan", "SELECT 'GET /nation/' || n_nationkey || ' HTTP/1.1' || chr(10) || 'X-Name: ' || n_name AS raw, 1 AS label FROM nation")
def request_text_scan(spark, sf_dir):
    """A file of requests one after another, cut at the verbs."""
    folder = scratch(spark, "requests")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("GET /nation/"), "n_nationkey", F.lit(" HTTP/1.1\nX-Name: "), "n_name", F.lit("\n")))
    rows.coalesce(1).write.text(folder)
    return readers.read_requests_text(spark, folder, 1)


@query("arff_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def arff_scan(spark, sf_dir):
    """An attribute-relation file with comments and quoted values."""
    path = scratch(spark, "arff")
    head = ["% a comment", "@relation nations", "@attribute key numeric", "@attribute 'name' string", "@ATTRIBUTE region numeric", "@data", "% another"]
    sinks.put(spark, path, "\n".join([*head, *(f"{r['n_nationkey']},'{r['n_name']}',{r['n_regionkey']}" for r in table(spark, sf_dir, "nation").collect())]).encode())
    return readers.read_arff(spark, path)


@query("predicate_scan", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def predicate_scan(spark, sf_dir):
    """Two columns under a predicate, which the Parquet scan takes over."""
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "quality")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "orders", "lineitem", "events")))
def row_counts(spark, sf_dir):
    """Rows of tables; a scan for them reads no column."""
    out = None
    for t in ("documents", "pages", "orders", "lineitem", "events"):
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("fallback_scan", "SELECT n_nationkey, n_name FROM nation")
def fallback_scan(spark, sf_dir):
    """The first of some tables that is there."""
    return spark.read.parquet(readers.first_existing(spark, [f"{sf_dir}/{t}.parquet" for t in ("deduplicated_nation", "filtered_nation", "nation", "region")])).select("n_nationkey", "n_name")


@query("parquet_tree_scan", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def parquet_tree_scan(spark, sf_dir):
    """Every Parquet file below a folder, whatever its columns; a file that is none is skipped."""
    folder = scratch(spark, "tree")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")).write.parquet(f"{folder}/a/b")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).write.parquet(f"{folder}/c")
    sinks.put(spark, f"{folder}/notes.txt", b"no table")
    return readers.read_parquet_tree(spark, folder)


def _capture(payloads: list[bytes]) -> bytes:
    """A capture file of one TCP segment a payload, and one packet of another protocol."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for k, payload in enumerate([*payloads, b""]):
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), k, 0, 64, 6 if payload else 17, 0, b"\x0a\x00\x00\x01", b"\x0a\x00\x00\x02")
        frame = bytes(12) + b"\x08\x00" + ip + struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x18, 8192, 0, 0) + payload
        out.append(struct.pack("<IIII", k, 0, len(frame), len(frame)) + frame)
    return b"".join(out)


@query("arrow_scan", "SELECT item_id, text, length(text) AS size FROM benchmark")
def arrow_scan(spark, sf_dir):
    """A table through an Arrow file."""
    path = scratch(spark, "arrow")
    sinks.write_arrow(table(spark, sf_dir, "benchmark").select("item_id", "text", F.length("text").cast("long").alias("size")), path)
    return readers.read_arrow(spark, path, "item_id long, text string, size long")


@query("capture_scan", "SELECT 'POST' AS method, '/nation/' || n_nationkey AS path, n_name AS host, 'name=' || n_name AS body FROM nation")
def capture_scan(spark, sf_dir):
    """Requests of a capture file; packets that hold none are passed over."""
    path = scratch(spark, "capture")
    rows = table(spark, sf_dir, "nation").collect()
    requests_ = [f"POST /nation/{r['n_nationkey']} HTTP/1.1\r\nHost: {r['n_name']}\r\n\r\nname={r['n_name']}".encode() for r in rows]
    sinks.put(spark, path, _capture([*requests_, b"\x16\x03\x01 no request"]))
    return readers.read_pcap(spark, path).select("method", "path", F.col("headers")["Host"].alias("host"), "body")


@query("jsonl_scan", "SELECT n_name AS text, 'nations' AS family FROM nation UNION ALL SELECT r_name, 'regions' FROM region")
def jsonl_scan(spark, sf_dir):
    """Files of one object a line, the family by the file's name; a broken line goes."""
    folder = scratch(spark, "jsonl")
    for name, t, column in (("nations", "nation", "n_name"), ("regions", "region", "r_name")):
        lines = [json.dumps({"text": r[column]}) for r in table(spark, sf_dir, t).collect()]
        sinks.put(spark, f"{folder}/{name}.jsonl", "\n".join([*lines, '{"text": '] if name == "nations" else lines).encode())
    return readers.read_jsonl(spark, folder)


@query("wordlist_scan", "SELECT n_name AS payload, 'id=' || n_name AS query_string, 'GET /test?id=' || n_name || ' HTTP/1.1' || chr(13) || chr(10) AS raw, 1 AS label FROM nation")
def wordlist_scan(spark, sf_dir):
    """One payload a line, without comments and blank lines, each in a request."""
    folder = scratch(spark, "words")
    lines = F.explode(F.array(F.lit("# a comment"), F.lit("   "), F.concat(F.lit(" "), "n_name", F.lit("  "))))
    table(spark, sf_dir, "nation").select(lines).write.text(folder)
    return readers.read_wordlist(spark, folder)


@query("grammar_scan", "SELECT n_nationkey AS i, 'GET /' || n_nationkey || '?q=(a)' AS text FROM nation")
def grammar_scan(spark, sf_dir):
    """A grammar file of the driver's whose only sentence each row gets behind its key."""
    spec = {"pcfg_grammars": {"one": {"start": "S", "rules": {"S": [[1, ["t:?q=", "n:ARGUMENT"]]], "ARGUMENT": [[2, ["t:(", "n:NAME", "t:)"]]], "NAME": [[1, ["t:a"]]]}}}}
    one = grammar.grammars(json.loads(json.dumps(spec))["pcfg_grammars"])["one"]
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    drawn = grammar.sample_texts(spark, one, 25, fillers=False)
    return n.join(drawn, "i").select("i", F.concat(F.lit("GET /"), "i", "text").alias("text"))


@query("config_scan", "SELECT * FROM (VALUES ('model.d_model', 64.0), ('model.n_heads', 8.0), ('splits.test', 0.25), ('splits.train', 0.75)) t(name, value)")
def config_scan(spark, sf_dir):
    """A checked configuration as dotted names and numbers."""
    from tidewright.operators.ranking import flattened

    config = files.checked_config({"splits": {"train": 0.75, "test": 0.25}, "model": {"d_model": 64, "n_heads": 8}, "path": "${NO_SUCH_NAME}/x"})
    return spark.createDataFrame(flattened(config), "name string, value double")


@query("archive_scan", "SELECT n_name AS payload FROM nation")
def archive_scan(spark, sf_dir):
    """A packed word list, unpacked by the driver and read."""
    import tempfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("lists/words.txt", "\n".join(r["n_name"] for r in table(spark, sf_dir, "nation").collect()))
    folder = scratch(spark, "archive")
    with tempfile.TemporaryDirectory() as own:  # the driver's alone: what was in the archive goes to the shared folder
        files.write_atomic(f"{own}/a.zip", buffer.getvalue())
        for k, path in enumerate(files.extract(f"{own}/a.zip", f"{own}/out")):
            with open(path, "rb") as f:
                sinks.put(spark, f"{folder}/{k}", f.read())
    return readers.read_wordlist(spark, folder).select("payload")


@query("file_checksums", "SELECT sha256(r_name) AS sha256, octet_length(encode(r_name)) AS n_bytes, true AS verified FROM region")
def file_checksums(spark, sf_dir):
    """Digest and size of each file of a folder, and whether it is the expected one."""
    folder = scratch(spark, "sums")
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf_dir, "region").collect()}
    for key, name in names.items():
        sinks.put(spark, f"{folder}/{key}", name.encode())
    wanted = table(spark, sf_dir, "region").select(F.sha2("r_name", 256).alias("wanted"))
    every = all(readers.verified(spark, f"{folder}/{key}", "") for key in names)
    found = readers.checksums(spark, folder).join(wanted, F.col("sha256") == F.col("wanted"), "left")
    return found.select("sha256", "n_bytes", (F.col("wanted").isNotNull() & F.lit(every)).alias("verified"))


@query(
    "written_table",
    f"WITH {LABELLED} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS size, (SELECT count(*) FROM labelled) AS total FROM labelled WHERE trim(raw, ' ') <> '' GROUP BY label",
)
def written_table(spark, sf_dir):
    """Canonical rows written and counted in one pass, then read again."""
    path = scratch(spark, "table")
    counts = sinks.write_table(as_requests(spark, sf_dir), path)
    rows = spark.read.parquet(path).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("size"))
    return rows.withColumn("total", F.lit(counts["total"]).cast("long")).filter(F.lit(counts["benign"] + counts["malicious"] == counts["total"]))


SPLIT = "CASE WHEN place < 0.02 THEN 'canary' WHEN place < 0.05 THEN 'adversarial' WHEN place < 0.15 THEN 'test' WHEN place < 0.3 THEN 'val' ELSE 'train' END"


@query(
    "written_splits",
    f"""
    WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY lang) AS place FROM documents)
    SELECT doc_id, lang FROM r WHERE {SPLIT} = 'test'
    """,
)
def written_splits(spark, sf_dir):
    """A folder a split; the reader of one split opens its folder alone."""
    path = scratch(spark, "splits")
    sinks.write_splits(splits.exact_quota_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang"), path)
    return spark.read.parquet(path).filter("split = 'test'").select("doc_id", "lang")


@query(
    "written_verdicts",
    """
    SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 10 THEN 'rejected' WHEN doc_id % 7 = 0 THEN 'rejected' WHEN length('GET /' || doc_id || ' ' || text) > 8192 THEN 'rejected' ELSE 'passed' END AS verdict,
           CASE WHEN length(coalesce(text, '')) < 10 THEN 'format:too_short' WHEN doc_id % 7 = 0 THEN 'format:invalid_method' WHEN length('GET /' || doc_id || ' ' || text) > 8192 THEN 'format:too_long' END AS reason FROM documents
    """,
)
def written_verdicts(spark, sf_dir):
    """Rows by verdict in folders of their own, read again with their reasons."""
    short = F.length(F.coalesce("text", F.lit(""))) < 10
    raw = F.when(short, "GET").when(F.col("doc_id") % 7 == 0, F.concat(F.lit("FETCH /item/"), "doc_id")).otherwise(F.concat(F.lit("GET /"), "doc_id", F.lit(" "), "text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", gate.format_reason(raw).alias("reason"))
    path = scratch(spark, "verdicts")
    sinks.write_verdicts(rows.withColumn("verdict", F.when(F.col("reason").isNull(), "passed").otherwise("rejected")), path)
    return spark.read.parquet(path).select("doc_id", "verdict", "reason")


@query("report_files", "SELECT lang, count(*) AS n, printf('%.5f', avg(length(text))) AS mean FROM documents GROUP BY lang")
def report_files(spark, sf_dir):
    """A report as a JSON list of the driver's and as a CSV file with five decimals; both say the same."""
    import tempfile

    found = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"))
    with tempfile.TemporaryDirectory() as own:
        rows = files.load_json(sinks.write_report(found, own, "corpus_stats"))
    folder = scratch(spark, "report")
    sinks.write_csv_report(found, folder)
    shown = spark.read.option("header", True).schema("lang string, n long, mean string").csv(folder)
    told = spark.createDataFrame([(r.get("lang"), r["n"]) for r in rows], "lang string, n long")
    return shown.join(told.withColumnRenamed("lang", "_lang").withColumnRenamed("n", "_n"), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("n") == F.col("_n"))).select("lang", "n", "mean")


@query("corpus_text", "SELECT replace(replace(replace(text, chr(13) || chr(10), ' [CRLF] '), chr(10), ' [LF] '), chr(13), ' [CR] ') AS line FROM benchmark WHERE text <> ''")
def corpus_text(spark, sf_dir):
    """One text a line with its line ends marked."""
    path = scratch(spark, "corpus")
    sinks.write_corpus_text(table(spark, sf_dir, "benchmark").filter("text <> ''"), path, "text")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("manifest_rows", "SELECT 'region' AS name, 'done' AS status, count(*) AS n_rows, true AS dated FROM region")
def manifest_rows(spark, sf_dir):
    n = table(spark, sf_dir, "region").count()
    rows = sinks.manifest(spark, [{"name": "region", "path": f"{sf_dir}/region.parquet", "status": "done", "n_rows": n}])
    return rows.select("name", "status", "n_rows", F.col("acquired_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$").alias("dated"))
