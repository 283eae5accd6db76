"""Synthesis, obfuscation and framing of requests. Choices are hashes of seed, row and slot: one plan, no driver state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions import tampers
from tidewright.functions.seeded import pick, uniform, weighted
from tidewright.operators.requests import build_raw, request_id


def _swap(*pairs: tuple[str, str]) -> Callable[[Column], Column]:
    return lambda s: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, s)


#: Class-specific rewrites.
OBFUSCATORS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "sqli": {
        "apostrophe_mask": _swap(("'", "UTF8MB4_UNICODE_CI")),
        "modsecurity_safe": _swap(("=", " LIKE "), ("OR", "||")),
        "between": _swap(("=1", " BETWEEN 0 AND 2")),
        "ifnull2ifisnull": _swap(("IFNULL(", "IF(ISNULL(")),
        "multiplespaces": _swap((" ", "   ")),
        "space2dash": _swap((" ", "--\n")),
        "space2mssqlblank": _swap((" ", "\t")),
    },
    "xss": {
        "tag_case": _swap(("<script", "<Script"), ("<img", "<Img"), ("<svg", "<Svg")),
        "js_comment": _swap(("alert(", "alert/*xss*/(")),
        "backtick_exec": _swap(("alert(1)", "alert`1`")),
        "attr_double_encode": _swap(("alert", "&#x61;lert")),
        "null_byte_event": _swap(("onerror=", "on\x00error="), ("onload=", "on\x00load=")),
    },
    "lfi": {
        "double_encode": _swap(("../", "%252e%252e%252f")),
        "overlong_utf8": _swap(("../", "%c0%ae%c0%ae/")),
        "dotdotslash": _swap(("../", "....//")),
        "null_byte": lambda s: F.concat(s, F.lit("%00")),
        "backslash_mix": _swap(("../", "..\\")),
    },
    "cmdi": {
        "ifs_space": _swap((" ", "${IFS}")),
        "brace_expand": lambda s: F.regexp_replace(s, r"\b(cat|ls|id|whoami|uname|wget|curl)\b", r"{$1,}"),
        "quote_break": tampers.quote_break,
        "hex_cmd": _swap(("cat", r"$'\x63\x61\x74'"), ("id", r"$'\x69\x64'")),
    },
    "ssrf": {
        "ip_decimal": tampers.ip_decimal,
        "ip_octal": tampers.ip_octal,
        "ip_hex": tampers.ip_hex,
        "proto_confusion": _swap(("http://", "http:///")),
        "ipv6_mapped": _swap(("127.0.0.1", "[::ffff:127.0.0.1]"), ("169.254.169.254", "[::ffff:169.254.169.254]")),
    },
}
#: Second rewrites that do not undo a first one.
STACKABLE = {"lfi": "null_byte", "ssrf": "proto_confusion"}
ENCODERS: dict[str, Callable[[Column, Column], Column]] = {
    "url_encode": lambda s, key: tampers.url_encode(s),
    "double_url_encode": lambda s, key: tampers.double_url_encode(s),
    "partial_url_encode": tampers.partial_url_encode,
    "hex_encode": lambda s, key: tampers.hex_encode(s),
    "unicode_escape": lambda s, key: tampers.unicode_escape(s),
    "html_entity": lambda s, key: tampers.html_entity(s),
    "comment_insertion": lambda s, key: tampers.comment_insertion(s),
    "case_variation": tampers.random_case,
    "whitespace_bypass": tampers.whitespace_bypass,
}


def obfuscated(payload: Column, cls: Column, key: Column, seed: int = 42) -> Column:
    """One rewrite of the payload's class, picked by the key; payloads of other classes stay."""
    out = None
    for name, options in OBFUSCATORS.items():
        u = F.floor(uniform(seed, key) * len(options))
        chosen = reduce(lambda c, k: F.when(u == k[0], k[1](payload)).otherwise(c), enumerate(options.values()), payload)
        out = F.when(cls == name, chosen) if out is None else out.when(cls == name, chosen)
    return out.otherwise(payload)


def encoded(payload: Column, key: Column, seed: int = 43) -> Column:
    u = F.floor(uniform(seed, key) * len(ENCODERS))
    return reduce(lambda c, k: F.when(u == k[0], k[1](payload, key)).otherwise(c), enumerate(ENCODERS.values()), payload)


def mutated(df: DataFrame, payload: str = "payload", cls: str = "attack_class", key: str = "i", seed: int = 42) -> DataFrame:
    """Obfuscate, at times stack a second rewrite, encode, and at times encode again. Each step is a column of its own, so
    a step's expression is planned once however often the next one names it."""
    k = F.col(key)
    rows = df.withColumn(payload, obfuscated(F.col(payload), F.col(cls), k, seed))
    stacked = F.col(payload)
    for name, second in STACKABLE.items():
        stacked = F.when((F.col(cls) == name) & (uniform(seed + 1, k) < 0.3), OBFUSCATORS[name][second](F.col(payload))).otherwise(stacked)
    rows = rows.withColumn(payload, stacked)
    rows = rows.withColumn(payload, encoded(F.col(payload), k, seed + 2))
    return rows.withColumn(payload, F.when(uniform(seed + 3, k) < 0.3, encoded(F.col(payload), k, seed + 4)).otherwise(F.col(payload)))


def query_string(pairs: Column) -> Column:
    """name=value joined by ampersands, as given: nothing is escaped, and pairs without a value are left out."""
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def from_templates(rows: DataFrame, prefixes: list[str], payloads: list[str], suffixes: list[str], seed: int = 42, key: str = "i") -> DataFrame:
    """prefix, payload and suffix picked for each row."""
    part = lambda options, k: pick(options, seed + k, F.col(key))
    return rows.withColumn("text", F.concat(part(prefixes, 0), part(payloads, 1), part(suffixes, 2)))


def fill_gaps(gaps: DataFrame, cls: str = "attack_class") -> DataFrame:
    """A row (class, i) for each that a class lacks, from a table of class and gap."""
    return gaps.filter("gap > 0").select(cls, F.explode(F.sequence(F.lit(1).cast("long"), F.col("gap").cast("long"))).alias("i"))


def to_records(df: DataFrame, source: str, payload: str = "payload", cls: str = "attack_class") -> DataFrame:
    """Payloads in the envelope of their class as canonical rows with label 1; an entity payload is the whole body."""
    from tidewright.operators.requests import in_envelope

    parts = in_envelope(F.col(payload), F.col(cls))
    rows = df.select(F.lit(1).cast("byte").alias("label"), F.col(cls).alias("attack_class"), F.col(payload).alias("_p"), *[c.alias(n) for n, c in parts.items()])
    rows = rows.withColumn("body", F.when(F.col("attack_class") == "xxe", F.col("_p")).otherwise(F.col("body")))
    return _canonical(rows, F.concat(F.lit(source + "_"), F.col("attack_class")))


def _canonical(rows: DataFrame, source: Column) -> DataFrame:
    rows = rows.withColumn("source", source)
    rows = rows.withColumn("raw", build_raw(F.col("method"), F.col("path"), F.col("query_string"), F.col("_headers"), F.col("body")))
    rows = rows.withColumns({"id": request_id("source", "raw"), "headers": F.to_json("_headers"), "split": F.lit("")})
    return rows.select(*schema.COLUMNS)


AGENTS = [(f"agent/{k}.0 (platform {k % 3})", 1.0 / (k + 1)) for k in range(8)]
ENDPOINTS = [("/api/v1/items", "id"), ("/api/v1/users", "user"), ("/search", "q"), ("/login", "name"), ("/reports/{id}", "range"), ("/files", "path")]
SITES = ["query_param", "post_body", "path_segment", "cookie", "json_nested", "multipart", "host_header", "header", "raw_body"]


def framed(
    df: DataFrame,
    payload: str = "payload",
    key: str = "i",
    label: Column | None = None,
    cls: str = "attack_class",
    sites: list[tuple[str, float]] | None = None,
    agents: list[tuple[str, float]] | None = None,
    seed: int = 42,
    source: str = "aug_framed",
) -> DataFrame:
    """Payloads at one of nine places of a whole request: endpoint, other parameters and headers are drawn alike for all rows.

    agents: fitted weights of user agents, such as the frequencies of a traffic profile.
    """
    k = F.col(key)
    draw = lambda slot: uniform(seed + slot, k)
    number = lambda slot, most: F.floor(draw(slot) * most).cast("string")
    rows = df.withColumn("_site", weighted(sites or [(s, 1.0) for s in SITES], seed, k))
    index = (F.floor(draw(1) * len(ENDPOINTS)) + 1).cast("int")
    rows = rows.withColumn("_path", F.replace(F.element_at(F.array(*[F.lit(p) for p, _ in ENDPOINTS]), index), F.lit("{id}"), number(2, 1000)))
    rows = rows.withColumn("_name", F.element_at(F.array(*[F.lit(n) for _, n in ENDPOINTS]), index))
    p, name, site = F.col(payload), F.col("_name"), F.col("_site")
    filler = F.concat(F.lit("page="), number(3, 100), F.lit("&limit="), number(4, 50))
    boundary = F.concat(F.lit("----boundary"), F.substring(F.sha2(k.cast("string"), 256), 1, 16))
    in_body = site.isin("post_body", "json_nested", "multipart", "raw_body")
    json = F.to_json(F.create_map(name, p, F.lit("limit"), number(4, 50)))
    multipart = F.concat(
        F.lit("--"), boundary, F.lit('\r\nContent-Disposition: form-data; name="file"; filename="'), p,
        F.lit('"\r\nContent-Type: application/octet-stream\r\n\r\n\r\n--'), boundary, F.lit("--"),
    )
    extra = {
        "Cookie": F.when(site == "cookie", F.concat(F.lit("session="), F.substring(F.sha2(k.cast("string"), 256), 17, 16), F.lit("; "), name, F.lit("="), p)),
        "X-Forwarded-For": F.when(site == "header", p),
        "Content-Type": F.when(site.isin("post_body", "json_nested"), "application/json").when(site == "multipart", F.concat(F.lit("multipart/form-data; boundary="), boundary)).when(site == "raw_body", "application/xml"),
    }
    entry = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    listed = F.array(
        entry("Host", F.when(site == "host_header", p).otherwise(F.concat(F.lit("www"), number(5, 100), F.lit(".example")))),
        entry("User-Agent", weighted(agents or AGENTS, seed + 6, k)),
        entry("Accept", pick(["*/*", "text/html", "application/json"], seed + 7, k)),
        *[entry(n, v) for n, v in extra.items()],
    )
    rows = rows.withColumns(
        {
            "method": F.when(in_body, "POST").otherwise("GET"),
            "path": F.when(site == "path_segment", F.concat(F.lit("/api/v1/items/"), p)).otherwise(F.col("_path")),
            "query_string": F.when(in_body, "").when(site == "query_param", F.concat(filler, F.lit("&"), name, F.lit("="), p)).otherwise(filler),
            "_headers": F.map_from_entries(F.filter(listed, lambda e: e["value"].isNotNull())),
            "body": F.when(site == "post_body", json).when(site == "json_nested", F.concat(F.lit('{"data":'), json, F.lit("}"))).when(site == "multipart", multipart).when(site == "raw_body", p).otherwise(""),
            "label": (F.lit(1) if label is None else label).cast("byte"),
            "attack_class": F.col(cls),
        }
    )
    return _canonical(rows, F.lit(source))


def benign_requests(spark, n: int, seed: int = 42, agents: list[tuple[str, float]] | None = None) -> DataFrame:
    """n harmless requests, framed as attacks are."""
    rows = spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("value"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)).cast("string")).alias("payload"), F.lit("benign").alias("attack_class"))
    return framed(rows, label=F.lit(0), seed=seed, source="aug_benign", agents=agents)


def tampered(df: DataFrame, names: tuple[str, ...], key: str = "id") -> DataFrame:
    """Requests whose query string and body went through the named rewrites, with raw rebuilt."""
    from tidewright.operators.requests import headers_map

    change = lambda c: F.when(F.coalesce(c, F.lit("")) != "", tampers.apply_chain(c, F.col(key), names)).otherwise(c)
    rows = df.withColumn("query_string", change(F.col("query_string"))).withColumn("body", change(F.col("body")))
    return rows.withColumn("raw", build_raw(F.col("method"), F.col("path"), F.col("query_string"), headers_map("headers"), F.col("body")))


def listed_payloads(text: Column) -> Column:
    """Payloads of a model's answer: a JSON list (fences removed), or else its lines without bullets and numbers."""
    bare = F.trim(F.regexp_replace(text, r"(?s)```[a-zA-Z]*", ""))
    lines = F.filter(F.transform(F.split(bare, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.coalesce(F.from_json(bare, "array<string>"), lines)
