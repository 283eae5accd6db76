"""Request queries over pages, benchmark and events: url parts, raw requests, rules, signatures, the gate, tampers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions import tampers
from tidewright.functions.text import mark_line_ends, path_depth, query_param_count, target_path, target_query, without_category_number
from tidewright.operators import gate, profile, requests, rules, splits
from tidewright.plans.corpus import LABELLED, labelled
from tidewright.plans.registry import query
from tidewright.session import table


@query(
    "url_parse",
    r"""
    SELECT page_id, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 1), ';[^/]*$', '') AS path,
           regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 2) AS query_string,
           greatest(0, length(url) - length(replace(url, '/', '')) - 1) AS depth,
           CASE WHEN regexp_extract(url, '\?([^\s#]+)', 1) = '' THEN 0
                ELSE length(regexp_extract(url, '\?([^\s#]+)', 1)) - length(replace(regexp_extract(url, '\?([^\s#]+)', 1), '&', '')) + 1 END AS params
    FROM pages
    """,
)
def url_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", target_path("url").alias("path"), target_query("url").alias("query_string"),
        path_depth("url").cast("long").alias("depth"), query_param_count("url").cast("long").alias("params"),
    )


def _raw_pages(spark, sf_dir):
    """A raw request for each page: its url as target, two headers and, for every third page, a body."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\r\n\r\nid="), F.col("page_id").cast("string"), F.lit("\r\nend"))).otherwise("")
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, "post ").otherwise("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: a.example\r\nX-Id: 1\r\nX-Id: 2"), body)
    return p.select("page_id", raw.alias("raw"))


@query(
    "parse_request",
    r"""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
           CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path,
           regexp_extract(url, '\?([^#]*)', 1) AS query_string, '{"Host":"a.example","X-Id":"2"}' AS headers,
           CASE WHEN page_id % 3 = 0 THEN 'id=' || page_id || chr(10) || 'end' ELSE '' END AS body FROM pages
    """,
)
def parse_request(spark, sf_dir):
    return requests.parse(_raw_pages(spark, sf_dir)).select("page_id", "method", "path", "query_string", "headers", "body")


@query(
    "build_raw",
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST ' ELSE 'GET ' END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END
           || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: a.example' || chr(13) || chr(10) || 'X-Id: 2' || chr(13) || chr(10)
           || CASE WHEN page_id % 3 = 0 THEN chr(13) || chr(10) || 'id=' || page_id || chr(10) || 'end' ELSE '' END AS raw FROM p
    """,
)
def build_raw(spark, sf_dir):
    return requests.parse(_raw_pages(spark, sf_dir)).select("page_id", "raw")


@query(
    "canonical_classes",
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'sqli' WHEN 'de' THEN 'path_traversal' WHEN 'fr' THEN 'unknown' ELSE 'benign' END AS attack_class FROM documents
    """,
)
def canonical_classes(spark, sf_dir):
    spelled = F.when(F.col("lang") == "en", " SQL Injection").when(F.col("lang") == "de", "Directory Traversal ").when(F.col("lang") == "fr", "zzz").otherwise("Normal")
    return table(spark, sf_dir, "documents").select("doc_id", schema.canonical_class(spelled).alias("attack_class"))


@query(
    "normalised_labels",
    f"""
    WITH {LABELLED}
    SELECT id, CASE WHEN attack_class = 'en' THEN label ELSE 0 END AS label, CASE WHEN attack_class = 'en' THEN 'sqli' ELSE 'benign' END AS attack_class, 'GET' AS method, '/d/' || id AS path,
           '' AS query_string, '{{}}' AS headers, '' AS body, raw, source, '' AS split FROM labelled WHERE trim(raw, ' ') <> ''
    """,
)
def normalised_labels(spark, sf_dir):
    """The normaliser over labelled rows; languages other than English stand for benign classes."""
    rows = labelled(spark, sf_dir).withColumn("attack_class", F.when(F.col("attack_class") == "en", "sqli").otherwise("benign"))
    rows = rows.withColumns({"method": F.lit(" get "), "path": F.concat(F.lit(" /d/"), "id"), "query_string": F.lit("  "), "headers": F.lit(None).cast("string")})
    return requests.normalise(rows).withColumns({"id": F.col("id").cast("long"), "label": F.col("label").cast("int")})


@query(
    "adapt_payloads",
    """
    SELECT count(*) AS n, method, path, label FROM (
        SELECT CASE WHEN kind = 'xxe' THEN 'POST' ELSE 'GET' END AS method,
               CASE kind WHEN 'xxe' THEN '/api/xml' WHEN 'lfi' THEN '/view' ELSE '/search' END AS path, CASE WHEN kind = 'benign' THEN 0 ELSE 1 END AS label
        FROM (SELECT CASE item_id % 4 WHEN 0 THEN 'xxe' WHEN 1 THEN 'lfi' WHEN 2 THEN 'benign' ELSE 'sqli' END AS kind FROM benchmark WHERE trim(text) <> ''))
    GROUP BY method, path, label
    """,
)
def adapt_payloads(spark, sf_dir):
    k = F.col("item_id") % 4
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("payload"), F.when(k == 0, "XML external entity").when(k == 1, "LFI").when(k == 2, "normal").otherwise("sqli").alias("type"),
        F.when(k == 2, "normal").otherwise("anomalous").alias("label"),
    )
    out = requests.adapt_payload_table(rows, "params")
    return out.groupBy("method", "path", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query(
    "adapt_lines",
    r"""
    SELECT page_id, 'PUT' AS method, CASE WHEN regexp_extract(url, '^[^?]*', 0) = '' THEN '/' ELSE regexp_extract(url, '^[^?]*', 0) END AS path,
           regexp_replace(CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?(.*)$', 1) ELSE '' END, '\s+$', '') AS query_string,
           '{"Content-Type":"text/plain","User-Agent":"agent ' || page_id || '"}' AS headers, 'a=b c' AS body FROM pages
    """,
)
def adapt_lines(spark, sf_dir):
    line = F.concat(F.lit("Method: put Host: "), F.col("url"), F.lit(" User-Agent: agent "), F.col("page_id").cast("string"), F.lit(" Content-Type: text/plain Body: a=b c"))
    rows = table(spark, sf_dir, "pages").select(line.alias("text"), F.lit("1").alias("label"), F.col("page_id").cast("string").alias("category"))
    fields = requests.line_fields("text")
    kept = rows.select(F.col("category").cast("long").alias("page_id"), fields.alias("f"))
    f, host = F.col("f"), F.col("f")["host"]
    return kept.select(
        "page_id", F.upper(f["method"]).alias("method"), F.substring_index(host, "?", 1).alias("path"),
        F.when(F.contains(host, F.lit("?")), F.regexp_replace(host, r"(?s)^[^?]*\?", "")).otherwise("").alias("query_string"),
        F.to_json(F.struct(f["content-type"].alias("Content-Type"), f["user-agent"].alias("User-Agent"))).alias("headers"), f["body"].alias("body"),
    )


@query(
    "category_names",
    r"SELECT doc_id, trim(lower(lang)) || ' - x' AS category FROM documents",
)
def category_names(spark, sf_dir):
    raw = F.concat(F.lit(" 12 - "), F.upper("lang"), F.lit(" - x "))
    return table(spark, sf_dir, "documents").select("doc_id", without_category_number(raw).alias("category"))


@query(
    "line_end_marks",
    "SELECT doc_id, replace(replace(replace(text, chr(13) || chr(10), ' [CRLF] '), chr(10), ' [LF] '), chr(13), ' [CR] ') AS marked FROM documents",
)
def line_end_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mark_line_ends("text").alias("marked"))


def _sql_quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_sql(r: rules.Rule) -> str:
    """A rule as a DuckDB condition on `low`; the look-ahead becomes a test of every match."""
    if r.id == 931100:
        found = r"list_filter(regexp_extract_all(low, '(?i)https?://[^/\s]{4,}/[^\s]*\.(?:php|asp|jsp)'), lambda m: NOT regexp_matches(m, '^https?://(?:localhost|127\.0\.0\.1)'))"
        return f"len({found}) > 0"
    return f"regexp_matches(low, {_sql_quoted('(?i)' + r.pattern)})"


def _score_sql(level: int) -> str:
    return " + ".join(f"CASE WHEN {_rule_sql(r)} THEN {r.severity} ELSE 0 END" for r in rules.active(level))


@query(
    "crs_score",
    "WITH t AS (SELECT page_id, lower(html) AS low FROM pages) SELECT page_id, "
    + ", ".join(f"{_score_sql(n)} AS score_pl{n}, CASE WHEN {_score_sql(n)} >= 5 THEN 1 ELSE 0 END AS pred_pl{n}" for n in rules.LEVELS)
    + ", concat_ws(' ', " + ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r.id}' END" for r in rules.RULES) + ") AS matched_rules FROM t",
)
def crs_score(spark, sf_dir):
    out = rules.crs_scores(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return out.drop("html").withColumn("matched_rules", F.array_join(F.col("matched_rules").cast("array<string>"), " "))


@query(
    "crs_level_sweep",
    "WITH " + LABELLED.strip() + ", t AS (SELECT lower(raw) AS low, label FROM labelled), s AS (SELECT label, "
    + ", ".join(f"CASE WHEN {_score_sql(n)} >= 5 THEN 1 ELSE 0 END AS p{n}" for n in rules.LEVELS)
    + " FROM t), l AS ("
    + " UNION ALL ".join(f"SELECT {n} AS level, {len(rules.active(n))} AS n_active, label, p{n} AS pred FROM s" for n in rules.LEVELS)
    + """)
    SELECT level, n_active, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
           count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM l GROUP BY level, n_active
    """,
)
def crs_level_sweep(spark, sf_dir):
    return rules.level_sweep(labelled(spark, sf_dir)).select("level", "n_active", "tp", "fp", "tn", "fn")


@query(
    "crs_rule_join",
    "WITH t AS (SELECT item_id, lower('q=' || text || ' union select 1; id') AS low FROM benchmark) SELECT item_id, CAST("
    + " + ".join(f"CASE WHEN {_rule_sql(r)} THEN {r.severity} ELSE 0 END" for r in rules.RULES)
    + " AS BIGINT) AS score FROM t",
)
def crs_rule_join(spark, sf_dir):
    """Scores under a rule table that is read as data: a nested-loop join with a broadcast table of nineteen rows."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("q="), "text", F.lit(" union select 1; id")).alias("raw"))
    return rules.cross_scores(rows, rules.rule_table(spark), "item_id").withColumn("score", F.col("score").cast("long"))


@query(
    "signature_match",
    "SELECT page_id, CASE WHEN " + " OR ".join(f"contains(lower(html), {_sql_quoted(s)})" for s in rules.SIGNATURES) + " THEN 1 ELSE 0 END AS hit FROM pages",
)
def signature_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.signature_hit("html").alias("hit"))


@query(
    "structural_features",
    "SELECT page_id, "
    + ", ".join(f"CAST(regexp_matches(url, {_sql_quoted('(?i)' + p)}) AS DOUBLE) AS {n}" for n, p in rules.FEATURES.items())
    + r""", least(length(url), 10000) / 10000 AS scaled_length,
    CASE WHEN length(regexp_extract(url, '\?([^\s#]+)', 1)) - length(replace(regexp_extract(url, '\?([^\s#]+)', 1), '&', '')) + 1 > 10 THEN 1.0 ELSE 0.0 END AS has_many_params FROM pages""",
)
def structural_features(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *rules.structural_features("url"))


GATED = f"""
{LABELLED}, g AS (
    SELECT id, 'GET /q?t=' || raw AS raw, label, CASE WHEN attack_class = 'en' THEN 'sqli' ELSE 'lfi' END AS attack_class, source FROM labelled)
"""


def _gated(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.select(
        "id", F.concat(F.lit("GET /q?t="), "raw").alias("raw"), "label", F.when(F.col("attack_class") == "en", "sqli").otherwise("lfi").alias("attack_class"), "source",
        F.lit("").alias("query_string"), F.lit("").alias("body"),
    )


def _hits_sql() -> str:
    return " OR ".join(f"regexp_matches(raw, {_sql_quoted('(?i)' + p)})" for p in gate.HEURISTICS.values())


_VALID_SQL = (
    f"CASE attack_class WHEN 'sqli' THEN regexp_matches(raw, {_sql_quoted(gate.TOKENS['sqli'])}) "
    "AND length(raw) - length(replace(raw, '(', '')) = length(raw) - length(replace(raw, ')', '')) "
    f"ELSE regexp_matches(raw, {_sql_quoted(gate.TOKENS['lfi'])}) END"
)


@query(
    "quality_gate",
    f"""
    WITH {GATED}, v AS (
        SELECT id, CASE WHEN length(raw) < 10 THEN 'format:too_short' WHEN length(raw) > 8192 THEN 'format:too_long'
                        WHEN label = 1 AND NOT ({_VALID_SQL}) THEN 'invalid_structure:' || attack_class
                        WHEN label = 0 AND ({_hits_sql()}) AND NOT contains(lower(source), 'edge') THEN 'label_conflict' END AS reason,
               label = 1 AND NOT ({_hits_sql()}) AS flagged, source FROM g)
    SELECT id, CASE WHEN reason IS NULL THEN 'passed' WHEN reason = 'label_conflict' THEN 'quarantined' ELSE 'rejected' END AS verdict,
           split_part(reason, ':', 1) AS reason_code, CASE WHEN reason IS NULL AND flagged THEN source || '_crs_flagged' ELSE source END AS source FROM v
    """,
)
def quality_gate(spark, sf_dir):
    from tidewright.functions.text import reason_code

    return gate.verdicts(_gated(spark, sf_dir)).select("id", "verdict", reason_code("rejection_reason").alias("reason_code"), "source")


@query(
    "gate_summary",
    f"""
    WITH {GATED}, v AS (
        SELECT CASE WHEN length(raw) < 10 THEN 'format' WHEN length(raw) > 8192 THEN 'format' WHEN label = 1 AND NOT ({_VALID_SQL}) THEN 'invalid_structure'
                    WHEN label = 0 AND ({_hits_sql()}) THEN 'label_conflict' END AS reason FROM g)
    SELECT CASE WHEN reason IS NULL THEN 'passed' WHEN reason = 'label_conflict' THEN 'quarantined' ELSE 'rejected' END AS verdict, reason, count(*) AS n FROM v GROUP BY 1, 2
    """,
)
def gate_summary(spark, sf_dir):
    return gate.gate_summary(gate.verdicts(_gated(spark, sf_dir)))


@query(
    "label_consistency",
    f"""
    WITH {GATED}, h AS (SELECT label, source, CASE WHEN {_hits_sql()} THEN 1 ELSE 0 END AS any_hit FROM g)
    SELECT label, any_hit, CASE WHEN label = 0 AND any_hit = 1 THEN 'quarantine' WHEN label = 1 AND any_hit = 0 THEN 'keep_flagged' ELSE 'pass' END AS policy, count(*) AS n
    FROM h GROUP BY 1, 2, 3
    """,
)
def label_consistency(spark, sf_dir):
    return gate.consistency_matrix(_gated(spark, sf_dir))


@query(
    "source_buckets",
    "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'aug_llm' ELSE 'real_other' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
)
def source_buckets(spark, sf_dir):
    s = F.when(F.col("source") == "src1", "aug_api_llm_x").when(F.col("source") == "src2", "AUG_LOCAL_LLM").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(splits.source_bucket(s).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "traffic_profile",
    """
    WITH v AS (SELECT 'method' AS facet, event_type AS value FROM events UNION ALL SELECT 'path_depth', CAST(event_id % 3 AS VARCHAR) FROM events
               UNION ALL SELECT 'user_agent', 'k' || json_extract_string(props, '$.k') FROM events),
    c AS (SELECT facet, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT facet, value, n, n / sum(n) OVER (PARTITION BY facet) AS share FROM c
    QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= CASE WHEN facet = 'path_depth' THEN 10 ELSE 50 END
    """,
)
def traffic_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    agent = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    rows = e.select(F.col("event_type").alias("method"), F.concat(F.lit("/x"), F.repeat(F.lit("/y"), (F.col("event_id") % 3).cast("int"))).alias("path"), F.create_map(F.lit("User-Agent"), agent).alias("h"))
    return profile.traffic_profile(rows, F.col("h"))


@query(
    "header_rates",
    "SELECT avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 1.0 ELSE 0.0 END) AS authorization, 1.0 AS referer FROM events",
)
def header_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    big = F.get_json_object("props", "$.k").cast("int") > 50
    h = F.map_from_entries(F.filter(F.array(F.struct(F.lit("Referer").alias("k"), F.lit("x").alias("v")), F.when(big, F.struct(F.lit("Authorization").alias("k"), F.lit("y").alias("v")))), lambda x: x.isNotNull()))
    return profile.header_rates(e.select(h.alias("h")), F.col("h"), ["authorization", "referer"])


TAMPER_SQL = {
    "url_encode": "url_encode(text)",
    "double_url_encode": "url_encode(url_encode(text))",
    "space2comment": "replace(text, ' ', '/**/')",
    "between_comments": "array_to_string(string_split(text, ''), '/**/')",
    "base64_param": "base64(encode(text))",
    "hex_encode": r"array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '\p{L}') THEN '0x' || lower(to_hex(unicode(c))) ELSE c END), '')",
    "unicode_escape": r"array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '\p{L}') THEN '\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END), '')",
}
for _name, _sql in TAMPER_SQL.items():

    @query(f"tamper_{_name}", f"SELECT item_id, {_sql} AS tampered FROM benchmark")
    def _tamper(spark, sf_dir, name=_name):
        return table(spark, sf_dir, "benchmark").select("item_id", tampers.TAMPERS[name](F.col("text"), F.col("item_id")).alias("tampered"))


@query(
    "tamper_chain",
    "SELECT item_id, url_encode(replace(text, ' ', '/**/')) AS tampered FROM benchmark",
)
def tamper_chain(spark, sf_dir):
    pair = tampers.chains(["space2comment", "charencode", "url_encode"])[0]
    return table(spark, sf_dir, "benchmark").select("item_id", tampers.apply_chain(F.col("text"), F.col("item_id"), pair).alias("tampered"))


@query(
    "tamper_random_case",
    "SELECT item_id, lower(replace(text, 'ß', 's')) AS folded, length(text) AS size FROM benchmark",
)
def tamper_random_case(spark, sf_dir):
    """Seeded case changes keep everything but the case; the sharp s, whose upper case is two letters, is taken out first."""
    mixed = tampers.random_case(F.replace("text", F.lit("ß"), F.lit("s")), F.col("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower(mixed).alias("folded"), F.length(mixed).cast("long").alias("size"))


@query(
    "ip_forms",
    """
    SELECT page_id, 'http://' || (CAST(192 AS BIGINT) * 16777216 + 168 * 65536 + (page_id % 200) * 256 + 7) || '/x' AS decimal_form,
           'http://0xc0a8' || lpad(lower(to_hex(page_id % 200)), 2, '0') || '07/x' AS hex_form FROM pages
    """,
)
def ip_forms(spark, sf_dir):
    u = F.concat(F.lit("http://192.168."), (F.col("page_id") % 200).cast("string"), F.lit(".7/x"))
    return table(spark, sf_dir, "pages").select("page_id", tampers.ip_decimal(u).alias("decimal_form"), tampers.ip_hex(u).alias("hex_form"))


@query(
    "comment_insertion",
    r"SELECT item_id, regexp_replace(text, '\s+', '/**/', 'g') AS tampered FROM benchmark",
)
def comment_insertion(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tampers.comment_insertion("text").alias("tampered"))


@query(
    "request_blocks",
    r"""
    SELECT page_id, CAST(2 AS INTEGER) AS n, 'GET ' || url || ' HTTP/1.1' AS first FROM pages
    """,
)
def request_blocks(spark, sf_dir):
    text = F.concat(F.lit("junk\nGET "), F.col("url"), F.lit(" HTTP/1.1\n\nPOST /x HTTP/1.1\nA: GET \n\nGETTY"))
    blocks = requests.request_blocks(text)
    return table(spark, sf_dir, "pages").select("page_id", F.size(blocks).alias("n"), F.element_at(blocks, 1).alias("first"))
