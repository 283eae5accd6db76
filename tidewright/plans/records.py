"""Queries of requests, the gate, tampers and synthesis, over rows made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import grammar, tampers
from tidewright.operators import augment, dedup, gate, leakage, profile, requests, splits
from tidewright.plans.corpus import GRAMS, LABELLED, labelled
from tidewright.plans.files import as_requests
from tidewright.plans.registry import query
from tidewright.session import table

# ---------------------------------------------------------------- requests and labels


@query("header_maps", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS host, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS n FROM pages")
def header_maps(spark, sf_dir):
    """Headers as JSON of even pages, and a broken text for odd ones, which is an empty map."""
    t = table(spark, sf_dir, "pages")
    given = F.when(F.col("page_id") % 2 == 0, F.to_json(F.create_map(F.lit("Host"), "url", F.lit("Age"), F.lit("7")))).otherwise(F.concat(F.lit('{"Host": '), "url"))
    found = requests.headers_map(given)
    return t.select("page_id", found["Host"].alias("host"), F.size(found).alias("n"))


@query("rejected_labels", "SELECT doc_id, toxic + doc_id % 3 AS label FROM labels WHERE toxic + doc_id % 3 NOT IN (0, 1)")
def rejected_labels(spark, sf_dir):
    return requests.rejected_labels(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") + F.col("doc_id") % 3).alias("label")))


@query(
    "tolerant_build",
    f"""
    WITH {LABELLED}
    SELECT CAST(id AS VARCHAR) AS id, 'POST' AS method, '/doc/' || id AS path, CASE WHEN attack_class = 'benign' THEN 0 ELSE label END AS label FROM labelled
    """,
)
def tolerant_build(spark, sf_dir):
    """Canonical rows from a table with columns that the schema does not know."""
    rows = as_requests(spark, sf_dir)
    return rows.select("id", "method", "path", F.col("label").cast("int").alias("label"))


@query(
    "header_table",
    """
    SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/n/' || n_nationkey AS path, 'name=' || n_name AS query_string,
           '{"User-Agent":"agent ' || n_nationkey || '","Host":"' || lower(n_name) || '.example"' || CASE WHEN n_nationkey % 2 = 1 THEN ',"Content-Length":"4"' ELSE '' END || '}' AS headers,
           CASE WHEN n_nationkey % 2 = 1 THEN 'a=b1' ELSE '' END AS body, CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 0 END AS label FROM nation
    """,
)
def header_table(spark, sf_dir):
    """Requests with a column a header: repeated names, blank and nan values, and a misspelt length."""
    n, odd = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 2 == 1
    given = n.select(
        F.when(odd, "post").otherwise("get").alias("Method"),
        F.concat(F.lit("http://x.example/n/"), "n_nationkey", F.lit("?name="), "n_name").alias("URL"),
        F.concat(F.lit("User-Agent: agent "), "n_nationkey").alias("User-Agent"),
        F.lit("nan").alias("Pragma"),
        F.lit(" ").alias("cookie"),
        F.concat(F.lit("HOST: "), F.lower("n_name"), F.lit(".example")).alias("host"),
        F.when(odd, "Content-Length: 4").alias("lenght"),
        F.when(odd, "a=b1").alias("content"),
        F.when(odd, "Anomalous").otherwise("Normal").alias("classification"),
    )
    return requests.adapt_request_table(given, "s", "classification").select("method", "path", "query_string", "headers", "body", F.col("label").cast("int").alias("label"))


@query(
    "attack_classes",
    "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'benign' ELSE 'unknown' END AS by_label, lower(n_name) AS by_column FROM nation",
)
def attack_classes(spark, sf_dir):
    """The class of a table with a class column, and of one without."""
    n = table(spark, sf_dir, "nation").withColumn("attack_class", F.concat(F.lit("  "), "n_name", F.lit(" ")))
    label = requests.binary_label(F.when(F.col("n_nationkey") % 3 == 0, " Normal").otherwise("attack"))
    return n.select(F.col("n_nationkey").alias("key"), requests.class_or_label([], label).alias("by_label"), requests.class_or_label(n.columns, label).alias("by_column"))


@query(
    "strata",
    f"""
    WITH {LABELLED} SELECT concat_ws('_', label, attack_class, CASE WHEN id % 2 = 0 THEN 'aug_synthesis' ELSE 'real_kaggle' END) AS stratum, count(*) AS n,
    count(*) >= 2 AS can_split FROM labelled GROUP BY 1
    """,
)
def strata(spark, sf_dir):
    """Composite strata, their rows, and whether they have enough to be split."""
    source = F.when(F.col("id") % 2 == 0, "aug_synthesis_x").otherwise("some_Kaggle_set")
    rows = labelled(spark, sf_dir).select(splits.stratum("label", "attack_class", splits.source_bucket(source)).alias("stratum"))
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("can_split"))


@query(
    "payload_texts",
    """
    SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text, ' ') WHEN 1 THEN trim('a=b ' || text, ' ') WHEN 2 THEN 'a=b' ELSE text END AS payload,
           CASE item_id % 4 WHEN 0 THEN text WHEN 3 THEN NULL ELSE 'a=b' END AS seed FROM benchmark
    """,
)
def payload_texts(spark, sf_dir):
    """What validity looks at, and the seed of a malicious row, by which parts a request has."""
    kind = F.col("item_id") % 4
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.when(kind.isin(1, 2), "a=b").otherwise("").alias("query_string"), F.when(kind.isin(0, 1), F.col("text")).alias("body"), F.col("text").alias("raw"), F.lit(1).alias("label")
    )
    shown = rows.select("item_id", gate.payload_text("query_string", "body", "raw").alias("payload"))
    return shown.join(requests.seed_payloads(rows).select("item_id", F.col("payload").alias("seed")), "item_id", "left")


@query("conflict_reasons", "SELECT item_id, unnest(CASE WHEN item_id % 2 = 0 THEN ['sqli', 'xss'] ELSE ['lfi'] END) AS cls FROM benchmark")
def conflict_reasons(spark, sf_dir):
    reason = F.when(F.col("item_id") % 2 == 0, "label_conflict:benign_matches:sqli,xss").otherwise("label_conflict:benign_matches:lfi")
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(gate.conflict_classes(reason)).alias("cls"))


IDS = "list_transform(string_split(text, ' '), lambda w: CAST(length(w) % 6 AS INTEGER))"


def word_ids(text):
    """A stand-in for token ids that SQL can make as well: lengths of words, of which 0 is a pad and 1 is unknown."""
    return F.transform(F.split(text, " "), lambda w: (F.length(w) % 6).cast("int"))


@query(
    "unknown_rates",
    f"""
    WITH i AS (SELECT item_id, list_filter({IDS}, lambda x: x <> 0) AS ids FROM benchmark)
    SELECT item_id, round(len(list_filter(ids, lambda x: x = 1)) / greatest(1, len(ids)), 9) AS rate, len(list_filter(ids, lambda x: x = 1)) / greatest(1, len(ids)) > 0.15 AS rejected FROM i
    """,
)
def unknown_rates(spark, sf_dir):
    rate = gate.unknown_rate(word_ids("text"), 1, 0)
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(rate, 9).alias("rate"), (rate > gate.MOST_UNKNOWN).alias("rejected"))


VALID = {
    **{c: f"regexp_matches(t, '{p}')" for c, p in gate.TOKENS.items()},
    "sqli": f"regexp_matches(t, '{gate.TOKENS['sqli']}') AND length(replace(t, '(', '')) = length(replace(t, ')', ''))",
    "xss": f"regexp_matches(t, '{gate.TOKENS['xss']}') AND instr(reverse(t), '>') <= CASE WHEN contains(t, '<') THEN instr(reverse(t), '<') ELSE 999999999 END AND (contains(t, '>') OR NOT contains(t, '<'))",
    "xxe": "contains(lower(t), '<!doctype') AND contains(lower(t), '<!entity')",
    "other": "true",
}
ENDINGS = ["", "<B onload=x>", "<i", "<!DOCTYPE a [<!Entity b>", " OR (1)", " ../x", " {{7}}", " http://a", "; cat", "%0D%0a"]


@query(
    "class_validity",
    f"""
    WITH t AS (SELECT item_id, k, text || e AS t FROM benchmark, (SELECT unnest(range({len(ENDINGS)})) AS k, unnest({ENDINGS}) AS e))
    """
    + " UNION ALL ".join(f"SELECT item_id, k, '{c}' AS cls, {sql} AS valid FROM t" for c, sql in VALID.items()),
)
def class_validity(spark, sf_dir):
    """Whether texts with different endings keep the structure of each class."""
    ends = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(ENDINGS) - 1)).alias("k"), F.array(*map(F.lit, ENDINGS)).alias("e"))).alias("x")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", ends).select("item_id", "x.k", F.concat("text", "x.e").alias("t"))
    rows = rows.withColumn("cls", F.explode(F.array(*map(F.lit, VALID))))
    return rows.select("item_id", "k", "cls", gate.valid_for_class("cls", "t").alias("valid"))


@query("augmented_rows", "SELECT doc_id, 'AUG_api_LLM_' || lang AS source, true AS by_model FROM documents WHERE doc_id % 3 = 0")
def augmented_rows(spark, sf_dir):
    """Rows that a generator made, and whether a language model did, by their source."""
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("AUG_api_LLM_"), "lang")).otherwise(F.concat(F.lit("real_"), "lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source"))
    return rows.filter(F.lower("source").startswith("aug")).withColumn("by_model", F.contains(F.lower("source"), F.lit("llm")))


# ---------------------------------------------------------------- similarity and review


@query(
    "signature_similarity",
    """
    SELECT item_id, len(list_filter(range(1, 33), lambda i: substr(rpad(text, 40, '.'), i, 1) = substr(rpad(text, 40, '.'), i + 2, 1))) / 32 AS similarity FROM benchmark
    """,
)
def signature_similarity(spark, sf_dir):
    """Share of equal slots of two signatures: the characters of a text, and those two places on."""
    t = F.rpad("text", 40, ".")
    slots = lambda shift: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.substring(t, i + shift, F.lit(1)))
    return table(spark, sf_dir, "benchmark").select("item_id", dedup.signature_similarity(slots(0), slots(2)).alias("similarity"))


@query(
    "point_lookup",
    f"""
    WITH g AS (SELECT doc_id, text, {GRAMS} AS g FROM documents WHERE text IS NOT NULL), p AS (SELECT g FROM g ORDER BY doc_id LIMIT 1),
    s AS (SELECT doc_id, len(list_intersect(g.g, p.g)) / (len(g.g) + len(p.g) - len(list_intersect(g.g, p.g))) AS s FROM g, p)
    SELECT doc_id, round(s, 9) AS similarity FROM s WHERE s >= 0.3
    """,
)
def point_lookup(spark, sf_dir):
    """Documents that are similar to the first one."""
    docs = table(spark, sf_dir, "documents")
    probe = docs.filter("text IS NOT NULL").orderBy("doc_id").first()["text"]
    return dedup.similar_to(docs.filter("text IS NOT NULL"), probe, "doc_id", "text", 0.3).withColumn("similarity", F.round("similarity", 9))


@query(
    "review_outcomes",
    """
    SELECT CASE item_id % 5 WHEN 0 THEN 'restored' WHEN 1 THEN 'relabelled' WHEN 2 THEN 'discarded' WHEN 3 THEN 'bad' ELSE 'missing' END AS outcome, item_id AS id,
           CASE item_id % 5 WHEN 0 THEN 's_reviewed_benign' WHEN 3 THEN NULL ELSE 's' END AS source, CASE item_id % 5 WHEN 1 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS label FROM benchmark
    UNION ALL SELECT 'extra', -1, NULL, NULL
    """,
)
def review_outcomes(spark, sf_dir):
    """Reviewers' decisions on quarantined rows: restored, relabelled, discarded, and those that do not fit."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("s").alias("source"), F.lit(0).cast("byte").alias("label"))
    code = F.element_at(F.array(*map(F.lit, "ABDZ")), (F.col("id") % 5 + 1).cast("int"))
    decisions = rows.filter("id % 5 < 4").select("id", code.alias("decision")).unionAll(spark.createDataFrame([(-1, "A")], "id long, decision string"))
    out = None
    for name, part in gate.review(rows, decisions).items():
        have = part.columns
        part = part.select(
            F.lit(name).alias("outcome"), "id", (F.col("source") if "source" in have else F.lit(None).cast("string")).alias("source"),
            (F.col("label").cast("int") if "label" in have else F.lit(None).cast("int")).alias("label"),
        )
        if name == "missing":
            part = part.filter("id % 5 = 4")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "combined_counts",
    """
    WITH c AS (SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE lang <> 'en' UNION ALL SELECT lang FROM documents WHERE lang <> 'en' AND doc_id % 5 = 0) GROUP BY lang)
    SELECT lang, n, n < 500 AS low FROM c
    """,
)
def combined_counts(spark, sf_dir):
    """Rows of each class of a table and its augmentation together, the benign class left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = docs.unionByName(docs.filter("doc_id % 5 = 0")).filter("lang <> 'en'")
    return profile.value_counts(both, "lang").select("lang", "n", (F.col("n") < 500).alias("low"))


# ---------------------------------------------------------------- tampers


@query("partial_encoding", "SELECT item_id, text, true AS fewer FROM benchmark")
def partial_encoding(spark, sf_dir):
    """Partly encoded texts decode to what they were, with no more marks than wholly encoded ones."""
    t = table(spark, sf_dir, "benchmark").withColumn("e", tampers.partial_url_encode("text", "item_id"))
    decoded = F.url_decode(F.replace("e", F.lit("+"), F.lit("%2B")))
    marks = lambda c: F.regexp_count(c, F.lit(r"%[0-9A-F]{2}"))
    return t.select("item_id", decoded.alias("text"), (marks("e") <= marks(tampers.url_encode("text"))).alias("fewer"))


@query(
    "html_entities",
    r"SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '^\p{L}$') THEN '&#' || ord(c) || ';' ELSE c END), '') AS text FROM benchmark",
)
def html_entities(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tampers.html_entity("text").alias("text"))


@query("space_swaps", r"SELECT item_id, regexp_replace(text, '[\t\n+ ]', ' ', 'g') AS text FROM benchmark")
def space_swaps(spark, sf_dir):
    """Texts whose spaces became something else, with each of these turned back into a space."""
    swapped = tampers.whitespace_bypass("text", "item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(swapped, r"%20|%09|/\*\*/|[\t\n+ ]", " ").alias("text"))


@query("quote_breaks", r"SELECT item_id, regexp_replace(text, '(?s)^(.*?)(^|[^\p{L}\p{Nd}_])([a-z])([a-z]+)($|[^\p{L}\p{Nd}_])', '\1\2\3''''\4\5') AS text FROM benchmark")
def quote_breaks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tampers.quote_break("text").alias("text"))


OCTETS = "page_id % 224, page_id * 7 % 256, page_id * 13 % 256, page_id * 31 % 256"


@query(
    "address_forms",
    """
    WITH o AS (SELECT page_id, page_id % 224 AS a, page_id * 7 % 256 AS b, page_id * 13 % 256 AS c, page_id * 31 % 256 AS d FROM pages)
    SELECT page_id, 'http://' || (a * 16777216 + b * 65536 + c * 256 + d) || '/x' AS as_decimal, 'http://' || printf('0%o.0%o.0%o.0%o', a, b, c, d) || '/x' AS as_octal,
           'http://' || printf('0x%02x%02x%02x%02x', a, b, c, d) || '/x' AS as_hex FROM o
    """,
)
def address_forms(spark, sf_dir):
    """An address in a url as one number, in octal and in hexadecimal digits."""
    parts = [F.expr(x).cast("string") for x in OCTETS.split(", ")]
    t = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://"), F.concat_ws(".", *parts), F.lit("/x")).alias("u"))
    return t.select("page_id", tampers.ip_decimal("u").alias("as_decimal"), tampers.ip_octal("u").alias("as_octal"), tampers.ip_hex("u").alias("as_hex"))


@query(
    "stacked_rewrites",
    "SELECT item_id, replace('../' || text, '../', '....//') || '%00' AS lfi, 'http:///[::ffff:127.0.0.1]/' || item_id AS ssrf FROM benchmark",
)
def stacked_rewrites(spark, sf_dir):
    """A rewrite of a class and its second pass, which does not undo the first."""
    twice = lambda c, first, s: augment.OBFUSCATORS[c][augment.STACKABLE[c]](augment.OBFUSCATORS[c][first](s))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", twice("lfi", "dotdotslash", F.concat(F.lit("../"), "text")).alias("lfi"), twice("ssrf", "ipv6_mapped", F.concat(F.lit("http://127.0.0.1/"), "item_id")).alias("ssrf")
    )


@query(
    "tampered_records",
    "SELECT 'n' || n_nationkey AS id, 'GET /n?' || url_encode('q=' || n_name || ' (x)') || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || chr(13) || chr(10) AS raw FROM nation",
)
def tampered_records(spark, sf_dir):
    """Requests whose query string went through a rewrite, with the whole request rebuilt."""
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("GET").alias("method"), F.lit("/n").alias("path"), F.concat(F.lit("q="), "n_name", F.lit(" (x)")).alias("query_string"),
        F.lit('{"Host": "h"}').alias("headers"), F.lit("").alias("body"),
    )
    return augment.tampered(rows, ("url_encode",)).select("id", "raw")


# ---------------------------------------------------------------- synthesis


@query("placeholder_list", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN ['HOST', 'INT'] ELSE [] END AS names FROM benchmark")
def placeholder_list(spark, sf_dir):
    shown = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("§INT§ "), "text", F.lit(" §HOST#a§§HOST§"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", grammar.placeholders(shown).alias("names"))


@query(
    "swapped_fillers",
    r"""
    SELECT page_id, regexp_replace(regexp_replace('from 10.1.2.3 to ' || url, '\b\d{1,3}(?:\.\d{1,3}){3}\b', '9.9.9.9', 'g'),
           '(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|app|local|internal|test|example|site|online|info|biz|co|uk|de|fr|ru|cn|xyz|top)\b', 'host.example', 'g').regexp_replace('\b\d{2,}\b', '11', 'g') AS neutral,
           true AS changed FROM pages
    """,
)
def swapped_fillers(spark, sf_dir):
    """Freshly filled texts differ from the given ones, and are the same with one constant a kind."""
    t = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("from 10.1.2.3 to "), "url").alias("text"), F.concat(F.lit("from 10.1.2.3 to "), "url").alias("before"))
    return leakage.swapped(t, "text", "page_id").select("page_id", leakage.neutralised("text").alias("neutral"), (F.col("text") != F.col("before")).alias("changed"))


@query("query_strings", "SELECT 'key=' || n_nationkey || '&name=' || n_name AS q FROM nation")
def query_strings(spark, sf_dir):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    return table(spark, sf_dir, "nation").select(augment.query_string(F.array(pair("key", F.col("n_nationkey")), pair("none", F.lit(None)), pair("name", F.col("n_name")))).alias("q"))


@query("template_texts", "SELECT item_id, true AS listed, 3 AS most_prefixes FROM benchmark")
def template_texts(spark, sf_dir):
    """Texts of prefix, payload and suffix: each is one of the products, and all prefixes come up."""
    prefixes, payloads, suffixes = ["' ", '" ', ""], ["OR 1=1", "AND 2=2"], [" --", " #"]
    rows = augment.from_templates(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i")), prefixes, payloads, suffixes)
    every = [a + b + c for a in prefixes for b in payloads for c in suffixes]
    count = rows.select(F.countDistinct(F.regexp_extract("text", "^['\"]?", 0)).cast("int").alias("most_prefixes"))
    return rows.select(F.col("i").alias("item_id"), F.col("text").isin(every).alias("listed")).crossJoin(F.broadcast(count))


@query(
    "reframed_seeds",
    "SELECT 'q=' || text AS payload FROM benchmark",
)
def reframed_seeds(spark, sf_dir):
    """Seeds (a query string as it stood) framed again as one parameter: what the new request carries is the seed."""
    rows = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("label"), F.concat(F.lit("q="), "text").alias("query_string"), F.lit("").alias("body"), F.col("item_id").alias("i"), F.lit("sqli").alias("attack_class"))
    out = augment.framed(requests.seed_payloads(rows), sites=[("query_param", 1.0)])
    return out.select(F.regexp_extract("query_string", r"(?s)^page=\d+&limit=\d+&\w+=(.*)$", 1).alias("payload"))


@query(
    "adapted_line_table",
    "SELECT 'PUT' AS method, '/n/' || n_nationkey AS path, 'x=' || n_name AS query_string, '{\"User-Agent\":\"a b\",\"Cookie\":\"c=1\"}' AS headers, 'the body' AS body, 'sqli' AS attack_class, 1 AS label FROM nation",
)
def adapted_line_table(spark, sf_dir):
    """One-line requests through the adapter of that name."""
    line = F.concat(F.lit("Method: put Host: /n/"), "n_nationkey", F.lit("?x="), "n_name", F.lit(" User-Agent: a b Cookie: c=1 Body: the body"))
    given = table(spark, sf_dir, "nation").select(line.alias("text"), F.lit("2 - SQL Injection").alias("category"), F.lit("attack").alias("label"))
    return requests.ADAPTERS["line_table"](given, "s", "label").select("method", "path", "query_string", "headers", "body", "attack_class", F.col("label").cast("int").alias("label"))


FAMILIES = {
    "graphql": ({"START": [[1, ["t:{__schema{", "n:FIELD", "t:}}"]]], "FIELD": [[2, ["t:types{name}"]], [1, ["t:queryType{", "n:FIELD", "t:}"]]]}, r"\{__schema\{(queryType\{)*types\{name\}\}+"),
    "nosql": ({"START": [[1, ["t:{\"§IDENT§\":{\"", "n:OP", "t:\":§INT§}}"]]], "OP": [[1, ["t:$gt"]], [1, ["t:$ne"]], [1, ["t:$lt"]]]}, r'\{"\w+":\{"\$(gt|ne|lt)":\d+\}\}'),
    "ldap": ({"START": [[1, ["t:*)(", "n:TERM", "t:)"]]], "TERM": [[1, ["t:uid=§WORD§"]], [1, ["t:|(", "n:TERM", "t:)"]]]}, r"\*\)\((\|\()*uid=\w+\)+"),
    "prototype": ({"START": [[1, ["n:WAY", "t:[§COL§]=§STR§"]]], "WAY": [[1, ["t:__proto__"]], [1, ["t:constructor.prototype"]]]}, r"(__proto__|constructor\.prototype)\[\w+\]=\w+"),
    "smuggling": ({"START": [[1, ["t:Transfer-Encoding:", "n:GAP", "t:chunked"]]], "GAP": [[1, ["t: "]], [1, ["t:\t"]], [1, ["t: x, "]]]}, r"Transfer-Encoding:( |\t| x, )chunked"),
    "token": ({"START": [[1, ["t:eyJhbGciOiJub25lIn0.§STR§.", "n:SIGN"]]], "SIGN": [[1, ["t:"]], [1, ["t:§WORD§"]]]}, r"eyJhbGciOiJub25lIn0\.\w+\.\w*"),
}


@query("novel_families", "SELECT f AS family, item_id AS i, true AS fits FROM benchmark, (SELECT unnest(" + str(list(FAMILIES)) + ") AS f)")
def novel_families(spark, sf_dir):
    """Attacks of families that no other generator makes, each from a grammar and drawn by row: all fit their family's form."""
    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"))
    n, out = keys.agg(F.max("i")).first()[0] + 1, None
    for k, (family, (rules, form)) in enumerate(FAMILIES.items()):
        drawn = grammar.sample_texts(spark, grammar.grammars({family: {"rules": rules}})[family], n, seed=k)
        part = keys.join(drawn, "i").select(F.lit(family).alias("family"), "i", F.rlike("text", F.lit(f"^(?:{form})$")).alias("fits"))
        out = part if out is None else out.unionAll(part)
    return out
