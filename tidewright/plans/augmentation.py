"""Queries of synthesis, obfuscation, framing, tokenizers and probes."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewright import schema
from tidewright.functions import grammar, seeded
from tidewright.operators import augment, gate, metrics, probes, profile
from tidewright.plans.corpus import labelled
from tidewright.plans.registry import query
from tidewright.session import table

#: A small recursive grammar with matched quotes and fillers.
SAMPLE_GRAMMAR = {
    "clause": {
        "start": "START",
        "max_depth": 5,
        "rules": {
            "START": [[0.5, ["openq", "t: OR ", "n:COND", "t: --"]], [0.5, ["t:(", "n:COND", "t:)"]]],
            "COND": [[0.5, ["t:§COL#a§=§COL#a§"]], [0.3, ["n:COND", "t: AND ", "n:COND"]], [0.2, ["t:§INT§=", "t:1"]]],
        },
    }
}


def _items(spark, sf_dir):
    """item_id of each benchmark row as i, and the number of draws that holds them all."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"))
    return rows, rows.agg(F.max("i")).first()[0] + 1


@query("grammar_samples", "SELECT item_id AS i, true AS valid, true AS formed, true AS again FROM benchmark")
def grammar_samples(spark, sf_dir):
    """A draw of a grammar for each item: it keeps its class's structure, has the form of a sentence, and is drawn again alike."""
    g = grammar.grammars(SAMPLE_GRAMMAR)["clause"]
    rows, n = _items(spark, sf_dir)
    form = r"^((['\"]) OR (.+?) --|\((.+?)\))$"
    drawn = grammar.sample_texts(spark, g, n).select("i", "text")
    second = grammar.sample_texts(spark, g, n + 7).select("i", F.col("text").alias("t2"))
    met = rows.join(drawn, "i").join(second, "i")
    return met.select("i", gate.valid_for_class(F.lit("sqli"), F.col("text")).alias("valid"), F.rlike("text", F.lit(form)).alias("formed"), (F.col("text") == F.col("t2")).alias("again"))


@query("grammar_top_up", "SELECT 'x' AS text UNION ALL SELECT 'fallback' || k FROM (SELECT unnest(range((SELECT count(*) - 1 FROM benchmark))) AS k)")
def grammar_top_up(spark, sf_dir):
    """A grammar of one string asked for as many as there are items: one draw, and the rest of the fallback."""
    one = grammar.Grammar({"START": [(1.0, [("t", "x")])]})
    n = table(spark, sf_dir, "benchmark").count()
    return grammar.sample_with_top_up(spark, one, n, lambda r: r.select("i", F.concat(F.lit("fallback"), F.col("i").cast("string")).alias("text"))).select("text")


@query(
    "gap_fill",
    """
    WITH need AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT lang AS attack_class, greatest(0, 700 - coalesce(n, 0)) AS n FROM need LEFT JOIN c USING (lang) WHERE greatest(0, 700 - coalesce(n, 0)) > 0
    """,
)
def gap_fill(spark, sf_dir):
    found = profile.inventory(table(spark, sf_dir, "documents"), "lang", ["en", "de", "fr", "es", "it"], target=700)
    rows = augment.fill_gaps(found.withColumnRenamed("lang", "attack_class"))
    return rows.groupBy("attack_class").agg(F.count("*").alias("n"))


def _replaced(*pairs):
    out = "text"
    for old, new in pairs:
        out = f"replace({out}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in (old, new)) + ")"
    return out


OBFUSCATED_SQL = {
    ("sqli", "apostrophe_mask"): _replaced(("'", "UTF8MB4_UNICODE_CI")),
    ("sqli", "modsecurity_safe"): _replaced(("=", " LIKE "), ("OR", "||")),
    ("sqli", "between"): _replaced(("=1", " BETWEEN 0 AND 2")),
    ("sqli", "ifnull2ifisnull"): _replaced(("IFNULL(", "IF(ISNULL(")),
    ("sqli", "multiplespaces"): _replaced((" ", "   ")),
    ("sqli", "space2dash"): "replace(text, ' ', '--' || chr(10))",
    ("sqli", "space2mssqlblank"): "replace(text, ' ', chr(9))",
    ("xss", "tag_case"): _replaced(("<script", "<Script"), ("<img", "<Img"), ("<svg", "<Svg")),
    ("xss", "js_comment"): _replaced(("alert(", "alert/*xss*/(")),
    ("xss", "backtick_exec"): _replaced(("alert(1)", "alert`1`")),
    ("xss", "attr_double_encode"): _replaced(("alert", "&#x61;lert")),
    ("xss", "null_byte_event"): "replace(replace(text, 'onerror=', 'on' || chr(0) || 'error='), 'onload=', 'on' || chr(0) || 'load=')",
    ("lfi", "double_encode"): _replaced(("../", "%252e%252e%252f")),
    ("lfi", "overlong_utf8"): _replaced(("../", "%c0%ae%c0%ae/")),
    ("lfi", "dotdotslash"): _replaced(("../", "....//")),
    ("lfi", "null_byte"): "text || '%00'",
    ("lfi", "backslash_mix"): _replaced(("../", "..\\")),
    ("cmdi", "ifs_space"): _replaced((" ", "${IFS}")),
    ("cmdi", "brace_expand"): r"regexp_replace(text, '\b(cat|ls|id|whoami|uname|wget|curl)\b', '{\1,}', 'g')",
    ("cmdi", "quote_break"): r"regexp_replace(text, '(?s)^(.*?)(^|[^\p{L}\p{Nd}_])([a-z])([a-z]+)($|[^\p{L}\p{Nd}_])', '\1\2\3'||chr(39)||chr(39)||'\4\5')",
    ("cmdi", "hex_cmd"): r"replace(replace(text, 'cat', '$' || chr(39) || '\x63\x61\x74' || chr(39)), 'id', '$' || chr(39) || '\x69\x64' || chr(39))",
    ("ssrf", "ip_decimal"): _replaced(("127.0.0.1", "2130706433"), ("169.254.169.254", "2852039166")),
    ("ssrf", "ip_octal"): _replaced(("127.0.0.1", "0177.00.00.01"), ("169.254.169.254", "0251.0376.0251.0376")),
    ("ssrf", "ip_hex"): _replaced(("127.0.0.1", "0x7f000001"), ("169.254.169.254", "0xa9fea9fe")),
    ("ssrf", "proto_confusion"): _replaced(("http://", "http:///")),
    ("ssrf", "ipv6_mapped"): _replaced(("127.0.0.1", "[::ffff:127.0.0.1]"), ("169.254.169.254", "[::ffff:169.254.169.254]")),
}
#: What the rewrites change, behind each text.
REWRITABLE = "' OR 1=1 IFNULL(a) <script>alert(1)</script> <img onerror=x> ../etc cat id http://127.0.0.1/ 169.254.169.254"


@query(
    "obfuscators",
    "WITH b AS (SELECT item_id, text || ' " + REWRITABLE.replace("'", "''") + "' AS text FROM benchmark) "
    + " UNION ALL ".join(f"SELECT item_id, '{n}' AS name, {sql} AS text FROM b" for (_, n), sql in OBFUSCATED_SQL.items()),
)
def obfuscators(spark, sf_dir):
    """Every rewrite of every class on each text."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" " + REWRITABLE)).alias("text"))
    options = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("text")).alias("text")) for named in augment.OBFUSCATORS.values() for n, f in named.items()])
    return t.select("item_id", F.explode(options).alias("x")).select("item_id", "x.name", "x.text")


@query("mutation_chain", "SELECT item_id AS i, true AS filled, true AS again FROM benchmark")
def mutation_chain(spark, sf_dir):
    """Payloads through rewrites and encodings: none is lost, and each comes out the same on another partitioning."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("payload"), seeded.pick(list(augment.OBFUSCATORS), 1, "item_id").alias("attack_class"))
    second = augment.mutated(rows.repartition(3)).select("i", F.col("payload").alias("p2"))
    return augment.mutated(rows).join(second, "i").select("i", (F.length("payload") > 0).alias("filled"), (F.col("payload") == F.col("p2")).alias("again"))


@query("framed_requests", "SELECT item_id AS i, true AS well_formed, 'sqli' AS attack_class, 1 AS label FROM benchmark")
def framed_requests(spark, sf_dir):
    """Payloads framed at one of nine places: each is in its request, and each request passes the format check."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.concat(F.lit("pay"), F.col("item_id").cast("string"), F.lit("load")).alias("payload"), F.lit("sqli").alias("attack_class"))
    out = augment.framed(rows)
    return out.select(F.regexp_extract("raw", r"pay(\d+)load", 1).cast("long").alias("i"), gate.format_reason("raw").isNull().alias("well_formed"), "attack_class", F.col("label").cast("int").alias("label"))


@query("injection_sites", "SELECT s, true AS near_its_share FROM (SELECT unnest(" + str(augment.SITES) + ") AS s)")
def injection_sites(spark, sf_dir):
    """The place that each order's payload would get: every place comes up, about as often as every other."""
    site = seeded.weighted([(s, 1.0) for s in augment.SITES], 42, F.col("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(site.alias("s"))
    mean = F.broadcast(rows.agg((F.count("*") / len(augment.SITES)).alias("m")))
    return rows.groupBy("s").agg(F.count("*").alias("n")).crossJoin(mean).select("s", (F.abs(F.col("n") - F.col("m")) < 6 * F.sqrt("m")).alias("near_its_share"))


@query("benign_requests", "SELECT 0 AS label, 'benign' AS attack_class, true AS well_formed, true AS has_value FROM pages")
def benign_requests(spark, sf_dir):
    """As many harmless requests as there are pages: each is well formed and carries a plain value."""
    out = augment.benign_requests(spark, table(spark, sf_dir, "pages").count())
    return out.select(F.col("label").cast("int").alias("label"), "attack_class", gate.format_reason("raw").isNull().alias("well_formed"), F.rlike("raw", F.lit(r"value\d+")).alias("has_value"))


@query(
    "payload_records",
    """
    SELECT CASE WHEN item_id % 2 = 0 THEN 'xxe' ELSE 'lfi' END AS attack_class, count(*) AS n, CAST(sum(CASE WHEN item_id % 2 = 0 THEN length(text) ELSE length(text) + 5 END) AS BIGINT) AS size
    FROM benchmark GROUP BY 1
    """,
)
def payload_records(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("payload"), F.when(F.col("item_id") % 2 == 0, "xxe").otherwise("lfi").alias("attack_class"))
    out = augment.to_records(rows, "aug_synthesis")
    return out.groupBy("attack_class").agg(F.count("*").alias("n"), F.sum(F.length(F.concat("query_string", "body"))).alias("size"))


@query(
    "answer_lists",
    "SELECT item_id, ['p' || text, 'b'] AS payloads FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, ['x' || item_id, 'y'] FROM benchmark WHERE item_id % 2 = 1",
)
def answer_lists(spark, sf_dir):
    """Model answers as JSON lists for even items and as bulleted lines for odd ones."""
    t = table(spark, sf_dir, "benchmark")
    as_json = F.concat(F.lit("```json\n"), F.to_json(F.array(F.concat(F.lit("p"), "text"), F.lit("b"))), F.lit("\n```"))
    as_lines = F.concat(F.lit("- x"), F.col("item_id").cast("string"), F.lit("\n\n2. y\n"))
    return t.select("item_id", augment.listed_payloads(F.when(F.col("item_id") % 2 == 0, as_json).otherwise(as_lines)).alias("payloads"))


FORMS = {
    "HOST": r"[a-z0-9]+\.[a-z]+\.(com|org|net)", "IP": r"\d{1,3}(\.\d{1,3}){3}", "PORT": r"\d{2,5}", "PATH": r"(/[a-z]+)+", "PARAM": r"[a-z]+(_[a-z]+)?", "IDENT": r"[a-z]+_\d+",
    "STR": r"[a-z]+\d+", "INT": r"\d+", "COL": r"[a-z]+_[a-z]+", "WORD": r"[a-z]+", "JS_BODY": r"console\.log\(.+\)",
}


@query("filler_draws", "SELECT item_id AS i, unnest(" + str(sorted(FORMS)) + ") AS kind, true AS formed, true AS tags_agree, true AS again FROM benchmark")
def filler_draws(spark, sf_dir):
    """A draw of each kind of filler for each item: of its form, one value for a tag in a text, and the same when drawn again."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i in part["i"]:
                for kind in sorted(FORMS):
                    a, b, c = grammar.fill(f"§{kind}#a§\u0001§{kind}#a§\u0001§{kind}§", grammar.row_random(1, int(i))).split("\u0001")
                    again = grammar.fill(f"§{kind}#a§", grammar.row_random(1, int(i)))
                    rows.append((i, kind, c, a == b, a == again))
            yield pd.DataFrame(rows, columns=["i", "kind", "value", "tags_agree", "again"])

    drawn = _items(spark, sf_dir)[0].mapInPandas(run, "i long, kind string, value string, tags_agree boolean, again boolean")
    form = F.element_at(F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv]), F.col("kind"))
    return drawn.select("i", "kind", F.rlike("value", F.concat(F.lit("^("), form, F.lit(")$"))).alias("formed"), "tags_agree", "again")


@query("logistic_probe")
def logistic_probe(spark, sf_dir):
    """Metrics of a logistic probe on labelled documents, fitted and scored on hashed halves."""
    rows = probes.prepared(labelled(spark, sf_dir)).withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    model = probes.logistic_probe(rows.filter("half = 0"), structural=True)
    out = probes.scores(model, rows.filter("half = 1"))
    return metrics.binary_metrics(out).crossJoin(metrics.auc_rank(out).select("auc_roc"))


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    """Sizes of clusters of principal components of the embeddings."""
    out = probes.error_clusters(table(spark, sf_dir, "embeddings"))
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("ngram_features", r"""
    WITH w AS (SELECT item_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM benchmark),
    g AS (SELECT item_id, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2)),
          list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) AS gram FROM w)
    SELECT item_id, gram, count(*) AS n FROM g GROUP BY item_id, gram
    """)  # fmt: skip
def ngram_features(spark, sf_dir):
    """How often each character n-gram of a text's padded words is in it."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(probes.word_ngrams("text")).alias("gram"))
    return rows.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("hashed_features", "SELECT item_id, true AS unit_length, true AS no_negative FROM benchmark")
def hashed_features(spark, sf_dir):
    """Hashed n-grams of each text: of unit length, none negative."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", probes.word_ngrams("text").alias("grams"))
    vectors = vector_to_array(F.col("hashed"))
    out = Pipeline(stages=probes.hashed(1 << 12)).fit(rows).transform(rows)
    length = F.aggregate(vectors, F.lit(0.0), lambda s, x: s + x * x)
    return out.select("item_id", (F.abs(length - 1) < 1e-9).alias("unit_length"), (~F.exists(vectors, lambda x: x < 0)).alias("no_negative"))


@query("request_schema", "SELECT unnest(" + str(schema.COLUMNS) + ") AS name")
def request_schema(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in schema.COLUMNS], "name string")
