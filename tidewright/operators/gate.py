"""The quality gate: a cascade of verdicts over one table, then the leakage filter against the held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import count_of, last_index, reason_code, text_or_empty
from tidewright.operators.rules import may_match

#: Class patterns of the consistency check, ignoring case.
HEURISTICS = {
    "sqli": r"(UNION\s+(?:ALL\s+)?SELECT|SELECT\s+.+\s+FROM|DROP\s+TABLE|INSERT\s+INTO|UPDATE\s+.+\s+SET|DELETE\s+FROM|OR\s+1\s*=\s*1|AND\s+1\s*=\s*1|OR\s+'[^']+'='[^']+'|SLEEP\s*\(|BENCHMARK\s*\(|WAITFOR\s+DELAY|EXTRACTVALUE\s*\(|UPDATEXML\s*\(|information_schema|mysql\.user|pg_sleep)",
    "xss": r"(<\s*script|onerror\s*=|onload\s*=|onfocus\s*=|ontoggle\s*=|javascript\s*:|data\s*:\s*text/html|<\s*iframe|alert\s*\(|document\.cookie|<\s*svg\s+on)",
    "lfi": r"(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.\.%2f|%252e%252e|php://filter|php://input|data://text|/etc/passwd|/etc/shadow|\\windows\\system32)",
    "ssrf": r"(169\.254\.169\.254|metadata\.google\.internal|localhost(?::\d+)?/admin|127\.0\.0\.1/|0\.0\.0\.0/|\[::1\]/|dict://|gopher://)",
    "cmdi": r"(;\s*(?:id|whoami|cat\s|ls\s|uname|ps\s|env\b)|\|\s*(?:id|whoami|cat\s|ls\s|uname)|`(?:id|whoami|cat\s|ls\s)`|\$\((?:id|whoami|ls\s)|bash\s+-i\s+>&|nc\s+-e\s+/bin)",
}

#: Of each class pattern, what a lower-case text has to hold for a match, as in rules.NEEDS.
NEEDS = {
    "sqli": [
        ("union", "select"), ("select", "from"), ("drop", "table"), ("insert", "into"), ("update", "set"), ("delete", "from"), ("1", "=", ("or", "and")), ("'='",),
        (("sleep", "benchmark", "extractvalue", "updatexml"), "("), ("waitfor", "delay"), (("information_schema", "mysql.user", "pg_sleep"),),
    ],
    "xss": [("<", ("script", "iframe")), ("<", "svg", "on"), (("onerror", "onload", "onfocus", "ontoggle"), "="), (":", ("javascript", "data")), ("alert", "("), ("document.cookie",)],
    "lfi": [(("../", "..\\", "%2e%2e%2f", "%2e%2e/", "..%2f", "%252e%252e", "php://filter", "php://input", "data://text", "/etc/passwd", "/etc/shadow", "\\windows\\system32"),)],
    "ssrf": [(("169.254.169.254", "metadata.google.internal", "127.0.0.1/", "0.0.0.0/", "[::1]/", "dict://", "gopher://"),), ("localhost", "/admin")],
    "cmdi": [((";", "|", "`", "$("), ("id", "whoami", "cat", "ls", "uname", "ps", "env")), ("bash", "-i"), ("nc", "-e")],
}

#: Tokens that a payload of a class has to keep; the inline flag marks those that ignore case.
TOKENS = {
    "sqli": r"(?i)(union\b|select\b|sleep\s*\(|benchmark\s*\(|waitfor\b|\bor\b|\band\b|=|--|#|/\*)",
    "xss": r"(?i)(<\s*[a-z]|on[a-z]+\s*=|javascript\s*:|data\s*:\s*text/html)",
    "lfi": r"(?i)(\.\./|\.\.\\|%2e%2e|%252e|/etc/|/proc/|php://|data://|\\windows\\)",
    "path_traversal": r"(?i)(\.\./|\.\.\\|%2e%2e|%252e|/etc/|/proc/|php://|data://|\\windows\\)",
    "ssrf": r"(?i)(https?://|file://|dict://|gopher://|ftp://|169\.254\.169\.254|metadata\.google\.internal|localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|192\.168\.|10\.0\.|\d{8,})",
    "cmdi": r"([;|&`]|\$\(|\bbash\b|\bnc\b|\n)",
    "header_injection": r"(?i)(%0d%0a|%0d|%0a|\r\n|\r|\n)",
    "ssti": r"(\{\{|\}\}|\$\{|#\{|<%|%>|\*\{|@\()",
}

LEAST_LENGTH, MOST_LENGTH, MOST_UNKNOWN = 10, 8192, 0.15
_VERB = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s"


def format_reason(raw: Column | str) -> Column:
    """Why a raw request is malformed, or null: too short, no known verb, too long, in that order."""
    t = text_or_empty(raw)
    return (
        F.when(F.length(t) < LEAST_LENGTH, "format:too_short")
        .when(~t.rlike(_VERB), "format:invalid_method")
        .when(F.length(t) > MOST_LENGTH, "format:too_long")
    )


def payload_text(query: Column | str, body: Column | str, raw: Column | str) -> Column:
    """What a validity check looks at: query string and body, or else the raw request."""
    both = F.trim(F.concat_ws(" ", text_or_empty(query), text_or_empty(body)))
    return F.coalesce(F.nullif(both, F.lit("")), text_or_empty(raw))


def valid_for_class(cls: Column | str, text: Column | str) -> Column:
    """Whether a payload still has its class's structure; classes without a check pass."""
    c = F.col(cls) if isinstance(cls, str) else cls
    t = text_or_empty(text)
    has = lambda name: F.rlike(t, F.lit("(?d)" + TOKENS[name]))
    low = F.lower(t)
    checks = {
        "sqli": has("sqli") & (count_of(t, "(") == count_of(t, ")")),
        "xss": has("xss") & (last_index(t, "<") <= last_index(t, ">")),
        "xxe": F.contains(low, F.lit("<!doctype")) & F.contains(low, F.lit("<!entity")),
        **{name: has(name) for name in ("lfi", "path_traversal", "ssrf", "cmdi", "header_injection", "ssti")},
    }
    out = None
    for name, check in checks.items():
        out = F.when(c == name, check) if out is None else out.when(c == name, check)
    return out.otherwise(F.lit(True))


def heuristic_classes(raw: Column | str, low: Column | None = None) -> Column:
    """Sorted names of the classes whose pattern is found; a text meets a pattern only where it holds what that needs.

    low: the text in lower case, where the table has it as a column (else it is made for each class).
    """
    text = text_or_empty(raw)
    low = F.lower(text) if low is None else low
    found = F.array(*[F.when(may_match(low, NEEDS[n]) & F.rlike(text, F.lit("(?id)" + HEURISTICS[n])), F.lit(n)) for n in sorted(HEURISTICS)])
    return F.filter(found, lambda x: x.isNotNull())


def with_classes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The table with _classes, the names of heuristic_classes."""
    return df.withColumn("_low", F.lower(text_or_empty(raw))).withColumn("_classes", heuristic_classes(raw, F.col("_low"))).drop("_low")


def label_policy(label: Column, source: Column, classes: Column) -> Column:
    """pass, keep_flagged or quarantine: a benign row with hits is quarantined unless it is an edge case by its source."""
    some, edge = F.size(classes) > 0, F.contains(F.lower(text_or_empty(source)), F.lit("edge"))
    return (
        F.when((label == 0) & some & ~edge, "quarantine")
        .when((label == 0) & some & edge, "keep_flagged")
        .when((label == 1) & ~some, "keep_flagged")
        .otherwise("pass")
    )


def unknown_rate(ids: Column, unknown_id: int, pad_id: int) -> Column:
    real = F.filter(ids, lambda x: x != pad_id)
    return F.size(F.filter(real, lambda x: x == unknown_id)) / F.greatest(F.lit(1), F.size(real))


def verdicts(df: DataFrame, token_ids: str | None = None, unknown_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The table with verdict (passed, rejected or quarantined), rejection_reason and the flagged source.

    Checks in order: format, unknown-token rate (where a column of token ids is given), class structure, label policy.
    """
    rate = unknown_rate(F.col(token_ids), unknown_id, pad_id) if token_ids else F.lit(0.0)
    shown = F.concat(F.lit("high_unk_rate:"), F.format_string("%.3f", rate))
    text = payload_text("query_string", "body", "raw")
    rows = with_classes(df)
    rows = rows.withColumn("_policy", label_policy(F.col("label"), F.col("source"), F.col("_classes")))
    conflict = F.concat(F.lit("label_conflict:benign_matches:"), F.array_join("_classes", ","))
    rows = rows.withColumn(
        "rejection_reason",
        F.coalesce(
            format_reason("raw"),
            F.when(rate > MOST_UNKNOWN, shown),
            F.when((F.col("label") == 1) & ~valid_for_class("attack_class", text), F.concat(F.lit("invalid_structure:"), F.col("attack_class"))),
            F.when(F.col("_policy") == "quarantine", conflict),
        ),
    )
    code = reason_code("rejection_reason")
    return rows.withColumn(
        "verdict", F.when(F.col("rejection_reason").isNull(), "passed").when(code == "label_conflict", "quarantined").otherwise("rejected")
    ).withColumn(
        "source", F.when((F.col("verdict") == "passed") & (F.col("_policy") == "keep_flagged"), F.concat("source", F.lit("_crs_flagged"))).otherwise(F.col("source"))
    ).drop("_classes", "_policy")


def gate_summary(judged: DataFrame) -> DataFrame:
    """Rows by verdict and reason code."""
    return judged.groupBy("verdict", reason_code("rejection_reason").alias("reason")).agg(F.count("*").alias("n"))


def conflict_classes(reason: Column | str) -> Column:
    """The class names of a label conflict."""
    return F.split(F.replace(reason, F.lit("label_conflict:benign_matches:"), F.lit("")), ",")


def consistency_matrix(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Counts by label, whether any pattern hits, and policy."""
    rows = with_classes(df, raw)
    rows = rows.select("label", (F.size("_classes") > 0).cast("int").alias("any_hit"), label_policy(F.col("label"), F.col("source"), F.col("_classes")).alias("policy"))
    return rows.groupBy("label", "any_hit", "policy").agg(F.count("*").alias("n"))


def review(quarantined: DataFrame, decisions: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Restored (A), relabelled (B) and discarded (D) rows by reviewers' decisions, and the decisions that do not fit.

    decisions: key and decision. bad: unknown codes; extra: keys without a row; missing: rows without a decision.
    """
    known = decisions.filter(F.col("decision").isin("A", "B", "D"))
    met = quarantined.join(known, key)
    restored = met.filter("decision = 'A'").drop("decision").withColumn("source", F.concat("source", F.lit("_reviewed_benign")))
    relabelled = met.filter("decision = 'B'").drop("decision").withColumn("label", F.lit(1).cast("byte"))
    return {
        "restored": restored,
        "relabelled": relabelled,
        "discarded": met.filter("decision = 'D'").drop("decision"),
        "bad": decisions.filter(~F.coalesce(F.col("decision").isin("A", "B", "D"), F.lit(False))),
        "extra": decisions.join(quarantined.select(key), key, "left_anti"),
        "missing": quarantined.join(decisions, key, "left_anti"),
    }
