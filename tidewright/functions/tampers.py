"""Rewrites of payloads that keep their meaning: encodings, comments, case, white space, and class-specific obfuscation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.seeded import uniform
from tidewright.functions.text import col, quote

COMMENT = "/**/"


def characters(s: Column | str) -> Column:
    return F.filter(F.split(col(s), ""), lambda c: c != "")


def _each_letter(s: Column | str, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(characters(s), lambda c: F.when(c.rlike(r"^\p{L}$"), change(c)).otherwise(c)), "")


def _code(c: Column) -> Column:
    """Code point of a character."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def _lower_hex(c: Column, least: int) -> Column:
    digits = F.lower(F.hex(_code(c).cast("long")))
    return F.when(F.length(digits) < least, F.lpad(digits, least, "0")).otherwise(digits)


def url_encode(s: Column | str) -> Column:
    return quote(s)


def double_url_encode(s: Column | str) -> Column:
    return quote(quote(s))


def hex_encode(s: Column | str) -> Column:
    """Letters as 0x and their code."""
    return _each_letter(s, lambda c: F.concat(F.lit("0x"), _lower_hex(c, 2)))


def unicode_escape(s: Column | str) -> Column:
    return _each_letter(s, lambda c: F.concat(F.lit("\\u"), _lower_hex(c, 4)))


def html_entity(s: Column | str) -> Column:
    return _each_letter(s, lambda c: F.concat(F.lit("&#"), _code(c).cast("string"), F.lit(";")))


def space_to_comment(s: Column | str) -> Column:
    return F.replace(col(s), F.lit(" "), F.lit(COMMENT))


def comment_insertion(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"(?U)\s+", COMMENT)


def between_comments(s: Column | str) -> Column:
    return F.array_join(characters(s), COMMENT)


def base64_param(s: Column | str) -> Column:
    return F.replace(F.base64(F.encode(col(s), "UTF-8")), F.lit("\r\n"), F.lit(""))


def random_case(s: Column | str, key: Column | str, seed: int = 42) -> Column:
    """Each character in upper or lower case by a coin of the row and the place; one whose other case is not one character stays."""

    def one(c: Column, other: Column) -> Column:
        return F.when(F.length(other) == 1, other).otherwise(c)

    return F.array_join(F.transform(characters(s), lambda c, k: F.when(uniform(seed, col(key), k) > 0.5, one(c, F.upper(c))).otherwise(one(c, F.lower(c)))), "")


def partial_url_encode(s: Column | str, key: Column | str, seed: int = 42) -> Column:
    """Each character that is no letter or digit is encoded by a coin of the row and the place."""
    return F.array_join(
        F.transform(characters(s), lambda c, k: F.when(~c.rlike(r"^[\p{L}\p{N}]$") & (uniform(seed, col(key), k) < 0.5), quote(c)).otherwise(c)), ""
    )


#: What may stand for a space.
SPACES = [" ", "\t", "\n", "%20", "%09", "+", "/**/"]


def whitespace_bypass(s: Column | str, key: Column | str, seed: int = 42) -> Column:
    options = F.array(*[F.lit(x) for x in SPACES])
    place = lambda k: (F.floor(uniform(seed, col(key), k) * len(SPACES)) + 1).cast("int")
    return F.array_join(F.transform(characters(s), lambda c, k: F.when(c == " ", F.element_at(options, place(k))).otherwise(c)), "")


def quote_break(s: Column | str) -> Column:
    """The first lower-case word gets two quotes after its first letter."""
    return F.regexp_replace(col(s), r"(?s)^(.*?)\b([a-z])([a-z]+)\b", "$1$2''$3")


def _rewrite_ipv4(s: Column | str, form: Callable[[list[Column]], Column]) -> Column:
    """Each IPv4 address in another form: texts between matches and rewritten matches, joined again."""
    pattern = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"
    between = F.split(col(s), pattern)
    found = F.regexp_extract_all(col(s), F.lit(f"({pattern})"), 1)
    new = F.transform(found, lambda a: form([F.element_at(F.split(a, r"\."), k).cast("long") for k in (1, 2, 3, 4)]))
    return F.array_join(F.transform(F.arrays_zip(between.alias("t"), new.alias("m")), lambda p: F.concat(p["t"], F.coalesce(p["m"], F.lit("")))), "")


def ip_decimal(s: Column | str) -> Column:
    return _rewrite_ipv4(s, lambda o: (o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]).cast("string"))


def ip_octal(s: Column | str) -> Column:
    return _rewrite_ipv4(s, lambda o: F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(x.cast("string"), 10, 8)) for x in o]))


def ip_hex(s: Column | str) -> Column:
    return _rewrite_ipv4(s, lambda o: F.concat(F.lit("0x"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in o]))


#: The named rewrites of the robustness runs; each takes the payload and a row key.
TAMPERS: dict[str, Callable[[Column, Column], Column]] = {
    "space2comment": lambda s, key: space_to_comment(s),
    "randomcase": random_case,
    "url_encode": lambda s, key: url_encode(s),
    "double_url_encode": lambda s, key: double_url_encode(s),
    "hex_encode": lambda s, key: hex_encode(s),
    "between_comments": lambda s, key: between_comments(s),
    "base64_param": lambda s, key: base64_param(s),
    "unicode_escape": lambda s, key: unicode_escape(s),
}


def chains(names: list[str], most: int = 4) -> list[tuple[str, str]]:
    """The first adjacent pairs of known rewrites."""
    known = [n for n in names if n in TAMPERS]
    return list(zip(known, known[1:]))[:most]


def apply_chain(s: Column, key: Column, names: tuple[str, ...]) -> Column:
    for name in names:
        s = TAMPERS[name](s, key)
    return s
