"""The canonical table of requests and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query_string", T.StringType()),
        T.StructField("headers", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("label", T.ByteType()),
        T.StructField("attack_class", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
COLUMNS = [f.name for f in REQUEST_SCHEMA]

#: The classes of the taxonomy.
ATTACK_CLASSES = ["sqli", "xss", "lfi", "rfi", "ssrf", "cmdi", "xxe", "ssti", "path_traversal", "header_injection"]

#: Other names of the classes.
CLASS_ALIASES = {
    "sql injection": "sqli",
    "sql_injection": "sqli",
    "sqli": "sqli",
    "cross-site scripting": "xss",
    "cross_site_scripting": "xss",
    "xss": "xss",
    "local file inclusion": "lfi",
    "lfi": "lfi",
    "remote file inclusion": "rfi",
    "rfi": "rfi",
    "server-side request forgery": "ssrf",
    "ssrf": "ssrf",
    "command injection": "cmdi",
    "cmd injection": "cmdi",
    "cmdi": "cmdi",
    "xml external entity": "xxe",
    "xxe": "xxe",
    "server-side template injection": "ssti",
    "ssti": "ssti",
    "path traversal": "path_traversal",
    "directory traversal": "path_traversal",
    "path_traversal": "path_traversal",
    "header injection": "header_injection",
    "header_injection": "header_injection",
    "normal": "benign",
    "legitimate": "benign",
    "benign": "benign",
    "injection": "unknown",
    "manipulation": "unknown",
    "scanning for vulnerable software": "unknown",
    "fake the source of data": "unknown",
    "http abusion": "unknown",
    "anomalous": "unknown",
    "attack": "unknown",
    "malicious": "unknown",
    "unknown": "unknown",
}

#: Request envelopes of bare payloads by class: method, path, parameter.
ENVELOPES = {
    "sqli": ("GET", "/search", "q"),
    "xss": ("GET", "/search", "q"),
    "lfi": ("GET", "/view", "file"),
    "rfi": ("GET", "/include", "file"),
    "cmdi": ("GET", "/exec", "cmd"),
    "path_traversal": ("GET", "/download", "path"),
    "ssrf": ("GET", "/fetch", "url"),
    "header_injection": ("POST", "/submit", "data"),
    "ssti": ("GET", "/render", "template"),
    "xxe": ("POST", "/api/xml", "data"),
    "benign": ("GET", "/search", "q"),
    "unknown": ("GET", "/search", "q"),
}

#: Where a label may be found, in this order.
LABEL_COLUMNS = ["label", "Label", "classification", "class", "Class", "target", "Target"]
PAYLOAD_COLUMNS = ["sentence", "Sentence", "payload", "Payload", "text", "Text", "request", "Request"]
TYPE_COLUMNS = ["type", "Type", "attack_type", "attack_class", "category", "Category", "class", "Class"]
BENIGN_LABELS = ["0", "normal", "benign"]


def lookup(key: Column, table: dict, default) -> Column:
    """A value of a small fixed table by key."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default))


def canonical_class(c: Column | str) -> Column:
    """The canonical class of any spelling; unknown where there is none."""
    name = F.col(c) if isinstance(c, str) else c
    return lookup(F.lower(F.trim(F.coalesce(name, F.lit("")))), CLASS_ALIASES, "unknown")


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among a table's columns."""
    return next((c for c in candidates if c in columns), None)
