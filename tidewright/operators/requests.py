"""Parsing, building and normalising HTTP requests, and the adapters of raw sources. One projection each, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions.text import blank_to, target_path, target_query, text_or_empty, without_category_number

METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
_VERB = "|".join(METHODS)
_MAP = "map<string,string>"


def headers_map(headers: Column | str) -> Column:
    """Headers as a map; an empty one where the JSON is malformed."""
    return F.coalesce(F.from_json(headers, _MAP), F.create_map().cast(_MAP))


def build_raw(method: Column, path: Column, query: Column, headers: Column, body: Column) -> Column:
    """The request as sent: request line, header lines, and after a blank line the body, if there is one."""
    target = F.when(text_or_empty(query) != "", F.concat(path, F.lit("?"), query)).otherwise(path)
    line = F.concat(method, F.lit(" "), target, F.lit(" HTTP/1.1"))
    listed = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    shown = F.when(F.size(listed) > 0, F.array_join(listed, "\r\n"))
    return F.concat_ws("\r\n", line, shown, F.lit(""), F.nullif(text_or_empty(body), F.lit("")))


def _last_wins(pairs: Column) -> Column:
    """A map of entries (key, value) in first-seen order of keys, each with its last value."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, values)


def parsed(raw: Column | str) -> Column:
    """Struct of method, path, query_string, headers (map) and body of a raw request."""
    lines = F.split(F.replace(text_or_empty(raw), F.lit("\r\n"), F.lit("\n")), "\n")
    pattern = r"(?U)^(\w+)\s+(\S+)(?:\s+HTTP/[\d.]+)?$"
    first = F.trim(F.element_at(lines, 1))
    url = F.regexp_extract(first, pattern, 2)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    blank = F.array_position(rest, "").cast("int")
    head = F.when(blank > 0, F.slice(rest, 1, F.greatest(blank - 1, F.lit(0)))).otherwise(rest)
    body = F.when((blank > 0) & (F.size(rest) > blank), F.array_join(F.slice(rest, blank + 1, F.greatest(F.size(rest) - blank, F.lit(0))), "\n")).otherwise("")
    named = F.transform(
        F.filter(head, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value")),
    )
    return F.struct(
        blank_to(F.upper(F.regexp_extract(first, pattern, 1)), "GET").alias("method"),
        blank_to(target_path(url), "/").alias("path"),
        target_query(url).alias("query_string"),
        _last_wins(named).alias("headers"),
        body.alias("body"),
    )


def request_id(*parts: Column | str) -> Column:
    """A stable id of a row's content: the same on every run and retry."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replaces a raw column by the request's parts, and raw by its rebuilt form."""
    p = F.col("_parsed")
    return (
        df.withColumn("_parsed", parsed(raw))
        .withColumns({c: p[c] for c in ("method", "path", "query_string", "body")} | {"headers": F.to_json(p["headers"]), "_map": p["headers"]})
        .withColumn("raw", build_raw(F.col("method"), F.col("path"), F.col("query_string"), F.col("_map"), F.col("body")))
        .drop("_parsed", "_map")
    )


def binary_label(c: Column | str) -> Column:
    """0 for the benign spellings, else 1; a null counts as malicious, as any unknown spelling does."""
    value = F.lower(F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("nan"))))
    return F.when(value.isin(schema.BENIGN_LABELS), 0).otherwise(1).cast("byte")


def class_or_label(columns: list[str], label: Column) -> Column:
    """The class column where the table has one, else benign or unknown by the label."""
    if "attack_class" in columns:
        return F.lower(F.trim(F.col("attack_class").cast("string")))
    return F.when(label == 0, "benign").otherwise("unknown")


def normalise(df: DataFrame) -> DataFrame:
    """The canonical table: trimmed fields, defaults, canonical classes, rebuilt raw where it was blank; blank rows go.

    A benign class makes the label 0; a malicious class does not make it 1. A label other than 0 or 1 becomes 0.
    """
    have = set(df.columns)
    given = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    cls = schema.canonical_class(given("attack_class"))
    label = F.coalesce(given("label").try_cast("int"), F.lit(0))
    label = F.when(cls == "benign", 0).when(label.isin(0, 1), label).otherwise(0).cast("byte")
    out = df.select(
        F.upper(blank_to(given("method"), "GET")).alias("method"),
        blank_to(given("path"), "/").alias("path"),
        blank_to(given("query_string"), "").alias("query_string"),
        blank_to(given("headers"), "{}").alias("headers"),
        blank_to(given("body"), "").alias("body"),
        text_or_empty(given("raw")).alias("_raw"),
        label.alias("label"),
        cls.alias("attack_class"),
        blank_to(given("source"), "").alias("source"),
        blank_to(given("split"), "").alias("split"),
        given("id").alias("_id"),
    )
    rebuilt = build_raw(F.col("method"), F.col("path"), F.col("query_string"), headers_map("headers"), F.col("body"))
    out = out.withColumn("raw", F.when(F.trim("_raw") == "", rebuilt).otherwise(F.col("_raw"))).filter(F.trim("raw") != "")
    out = out.withColumn("id", blank_to("_id", request_id("source", "raw")))
    return out.select(*schema.COLUMNS)


def rejected_labels(df: DataFrame) -> DataFrame:
    """Rows whose label is neither 0 nor 1."""
    return df.filter(F.col("label").isNull() | ~F.col("label").isin(0, 1))


#: Columns of the one-column-a-header delivery and the headers that they hold.
HEADER_COLUMNS = {
    "User-Agent": "User-Agent",
    "Pragma": "Pragma",
    "Cache-Control": "Cache-Control",
    "Accept": "Accept",
    "Accept-encoding": "Accept-Encoding",
    "Accept-charset": "Accept-Charset",
    "language": "Accept-Language",
    "host": "Host",
    "cookie": "Cookie",
    "content-type": "Content-Type",
    "connection": "Connection",
    "lenght": "Content-Length",
}


def _labelled(df: DataFrame, label: str | None) -> tuple[DataFrame, Column]:
    name = label if label in df.columns else schema.first_present(df.columns, schema.LABEL_COLUMNS)
    if name is None:
        raise ValueError(f"no label column among {df.columns}")
    return df, binary_label(F.col(f"`{name}`"))


def _finished(df: DataFrame, source: str) -> DataFrame:
    raw = build_raw(F.col("method"), F.col("path"), F.col("query_string"), F.col("_headers"), F.col("body"))
    return normalise(df.withColumns({"raw": raw, "headers": F.to_json("_headers"), "source": F.lit(source)}))


def adapt_request_table(df: DataFrame, source: str, label: str | None = None) -> DataFrame:
    """Requests in a raw or request column, or with a column for each header."""
    df, found = _labelled(df, label)
    cls = class_or_label(df.columns, found)
    raw = schema.first_present(df.columns, ["raw", "request"])
    if raw:
        rows = df.select(F.col(raw).alias("raw"), found.alias("label"), cls.alias("attack_class")).filter(F.trim(text_or_empty("raw")) != "")
        return normalise(parse(rows).withColumn("source", F.lit(source)))
    get = lambda c, default: text_or_empty(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(default))) if c in df.columns else F.lit(default)
    entries = []
    for column, header in HEADER_COLUMNS.items():
        if column in df.columns:
            value = F.regexp_replace(F.trim(text_or_empty(F.col(f"`{column}`").cast("string"))), f"(?i)^{header}: ", "")
            entries.append(F.struct(F.lit(header).alias("key"), F.when(~F.lower(value).isin("", "nan"), value).alias("value")))
    pairs = F.array(*entries) if entries else F.array().cast("array<struct<key:string,value:string>>")
    rows = df.select(
        F.upper(get("Method", "GET")).alias("method"),
        blank_to(target_path(get("URL", "/")), "/").alias("path"),
        target_query(get("URL", "/")).alias("query_string"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_headers"),
        get("content", "").alias("body"),
        found.alias("label"),
        cls.alias("attack_class"),
    )
    return _finished(rows, source)


#: Fields of the one-line delivery, and those that are headers.
LINE_FIELDS = "Method|Host|Body|Content-Type|User-Agent|Referer|Cookie|Accept-Encoding|Accept-Language|Accept"
LINE_HEADERS = ["Content-Type", "User-Agent", "Referer", "Cookie", "Accept", "Accept-Encoding", "Accept-Language"]


def line_fields(text: Column | str) -> Column:
    """Map of lower-case field names to values of a `Field: value Field: value` line; the last of a name wins."""
    mark = rf"(?i)(?<!\S)({LINE_FIELDS})\s*:"
    keys = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(mark), 1), F.lower)
    values = F.split(text_or_empty(text), mark)
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.trim(F.get(values, i + 1)).alias("value")))
    return _last_wins(pairs)


def adapt_line_table(df: DataFrame, source: str, label: str | None = None) -> DataFrame:
    """Requests as one line of fields in a text column; Host holds path and query."""
    df, found = _labelled(df, label)
    cls = without_category_number("category") if "category" in df.columns else class_or_label(df.columns, found)
    rows = df.filter(F.trim(text_or_empty("text")) != "").select(line_fields("text").alias("f"), found.alias("label"), cls.alias("attack_class"))
    f = F.col("f")
    host = F.trim(F.coalesce(f["host"], F.lit("/")))
    entries = F.array(*[F.struct(F.lit(h).alias("key"), text_or_empty(f[h.lower()]).alias("value")) for h in LINE_HEADERS])
    rows = rows.select(
        F.upper(F.element_at(F.split(blank_to(f["method"], "GET"), r"\s+"), 1)).alias("method"),
        blank_to(F.substring_index(host, "?", 1), "/").alias("path"),
        F.when(F.contains(host, F.lit("?")), F.regexp_replace(host, r"(?s)^[^?]*\?", "")).otherwise("").alias("query_string"),
        F.map_from_entries(F.filter(entries, lambda p: p["value"] != "")).alias("_headers"),
        F.trim(text_or_empty(f["body"])).alias("body"),
        "label",
        "attack_class",
    )
    return _finished(rows, source)


def in_envelope(payload: Column, cls: Column) -> dict[str, Column]:
    """The parts of a request that carries a bare payload as its class does."""
    at = lambda k: schema.lookup(cls, {c: e[k] for c, e in schema.ENVELOPES.items()}, schema.ENVELOPES["unknown"][k])
    method, pair = at(0), F.concat(at(2), F.lit("="), payload)
    get = method == "GET"
    lit_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return {
        "method": method,
        "path": at(1),
        "query_string": F.when(get, pair).otherwise(""),
        "_headers": F.when(get, lit_map({"Host": "localhost", "Accept": "*/*"})).otherwise(
            lit_map({"Host": "localhost", "Content-Type": "application/x-www-form-urlencoded"})
        ),
        "body": F.when(get, "").otherwise(pair),
    }


def adapt_payload_table(df: DataFrame, source: str, label: str | None = None) -> DataFrame:
    """Bare payloads with a type column, each in the envelope of its class."""
    df, found = _labelled(df, label)
    payload = schema.first_present(df.columns, PAYLOADS := schema.PAYLOAD_COLUMNS)
    if payload is None:
        raise ValueError(f"none of {PAYLOADS} among {df.columns}")
    kind = schema.first_present(df.columns, schema.TYPE_COLUMNS)
    named = F.lower(F.trim(text_or_empty(F.col(f"`{kind}`").cast("string")))) if kind else F.lit("")
    by_label = F.when(found == 0, "benign").otherwise("unknown")
    rows = df.select(
        F.trim(text_or_empty(F.col(f"`{payload}`").cast("string"))).alias("payload"),
        found.alias("label"),
        F.when(named != "", schema.canonical_class(named)).otherwise(by_label).alias("attack_class"),
    ).filter("payload <> ''")
    parts = in_envelope(F.col("payload"), F.col("attack_class"))
    return _finished(rows.select("label", "attack_class", *[c.alias(n) for n, c in parts.items()]), source)


#: Adapters by name, each (table, source, label column) to the canonical table.
ADAPTERS = {"request_table": adapt_request_table, "line_table": adapt_line_table, "payload_table": adapt_payload_table}


def request_blocks(text: Column | str) -> Column:
    """Array of the requests in a text, each from a verb at the beginning of a line to the next; what precedes the first goes."""
    parts = F.split(text_or_empty(text), rf"(?m)^(?=(?:{_VERB})\s)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x.rlike(rf"^(?:{_VERB})\b"))


def seed_payloads(df: DataFrame) -> DataFrame:
    """The payload of each malicious row: its query string, else its body; rows without either go."""
    payload = F.coalesce(F.nullif("query_string", F.lit("")), F.nullif("body", F.lit("")))
    return df.filter("label = 1").withColumn("payload", payload).filter("payload IS NOT NULL")
