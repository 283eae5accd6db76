"""Column functions over text: url parts, percent encoding, entropy, tokens and bounded parses. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any url or request target: group 1 the path, group 2 the query. Never raises, unlike parse_url.
_TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Where tokens are cut: white space and punctuation of requests.
TOKEN_BREAK = r"[\s?&=/.;:(){}\[\]<>#'\"%,|\\+*`]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank_to(c: Column | str, default: Column | str) -> Column:
    """The trimmed value, or the default where it is null or blank."""
    other = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), other)


def target_path(url: Column | str) -> Column:
    """The path of a url or request target, without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(text_or_empty(url), "(?s)" + _TARGET, 1), ";[^/]*$", "")


def target_query(url: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(url), "(?s)" + _TARGET, 2)


def path_depth(uri: Column | str) -> Column:
    """Slashes after the first one; never negative."""
    return F.greatest(F.lit(0), count_of(uri, "/") - 1)


def count_of(text: Column | str, needle: str) -> Column:
    """Occurrences of a fixed string that do not overlap."""
    t = text_or_empty(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def query_param_count(raw: Column | str) -> Column:
    """Parameters of the first query string in a text: ampersands and one, or 0 without a query."""
    query = F.regexp_extract(text_or_empty(raw), r"\?([^\s#]+)", 1)
    return F.when(query == "", 0).otherwise(count_of(query, "&") + 1)


def quote(s: Column | str) -> Column:
    """Percent encoding of everything but unreserved characters (form encoding put right)."""
    form = F.url_encode(col(s))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("+", "%20"), ("*", "%2A"), ("%7E", "~")], form)


def byte_entropy(s: Column | str) -> Column:
    """Shannon entropy in bits of the bytes of a text; 0 for an empty one."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text_or_empty(s), "UTF-8")), F.lit("(..)"), 1)
    n = F.size(pairs).cast("double")
    # Sorting puts equal bytes side by side, so one pass over the runs counts them.
    state = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    add = lambda total, run: total + F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    folded = F.aggregate(
        F.array_sort(pairs),
        state,
        lambda a, x: F.when(x == a["last"], F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(
            F.struct(x.alias("last"), F.lit(1.0).alias("run"), add(a["sum"], a["run"]).alias("sum"))
        ),
        lambda a: add(a["sum"], a["run"]),
    )
    return F.when(n > 0, F.log2(n) - folded / n).otherwise(0.0)


def tokens(text: Column | str) -> Column:
    """Lower-case tokens between breaks, without empty ones."""
    return F.filter(F.split(F.lower(text_or_empty(text)), TOKEN_BREAK), lambda x: x != "")


def mark_line_ends(text: Column | str) -> Column:
    """Line ends as words, so that a tokenizer sees them: CRLF first, then LF and CR."""
    out = col(text)
    for end, mark in (("\r\n", " [CRLF] "), ("\n", " [LF] "), ("\r", " [CR] ")):
        out = F.replace(out, F.lit(end), F.lit(mark))
    return out


def last_index(text: Column | str, needle: str) -> Column:
    """0-based place of the last occurrence of a character, -1 without one."""
    t = text_or_empty(text)
    return F.length(t) - F.length(F.substring_index(t, needle, -1)) - 1


def without_category_number(c: Column | str) -> Column:
    """Lower case, trimmed, without a leading number and dash."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text_or_empty(c))), r"^\d+\s*[-–]\s*", ""))


def reason_code(reason: Column | str) -> Column:
    """What precedes the first colon."""
    return F.substring_index(col(reason), ":", 1)


def preview(text: Column | str, size: int = 200) -> Column:
    """The beginning of a text on one line, for samples in reports."""
    return F.regexp_replace(F.substring(text_or_empty(text), 1, size), r"[\r\n]+", " ")


def escaped(text: Column | str) -> Column:
    """A text as it has to stand in HTML."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text_or_empty(text))


def highlighted(text: Column | str, pattern: str) -> Column:
    """The escaped text with what the pattern (of escaped text) finds, ignoring case, in mark elements."""
    return F.regexp_replace(escaped(text), f"(?i)({pattern})", "<mark>$1</mark>")
