"""Scalar expressions: text, hashes, JSON paths. All built-in, all null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Unicode words in lower case; a text without any gives an empty array."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def shingles(w: Column | str, n: int, short: str = "whole") -> Column:
    """Distinct n-word shingles of an array of words. Fewer words give one short shingle ('whole') or nothing ('none').

    w should be a column, not an expression: it is looked at once per shingle.
    """
    w = col(w)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    few = F.array(F.array_join(w, " ")) if short == "whole" else F.array().cast("array<string>")
    return F.when(F.size(w) >= n, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<string>"))


def collapse(text: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def plain_quotes(text: Column | str) -> Column:
    """Typographic quotes and dashes made plain, lowered, collapsed."""
    return collapse(F.lower(F.translate(col(text), "“”„«»‘’‚–—", "\"\"\"\"\"'''--")))


def truncated(text: Column | str, most: int, hint: str = "") -> Column:
    """Cut after most characters with a mark that says how many are missing."""
    c = col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… ["), (F.length(c) - most).cast("string"), F.lit(f" more{hint}]"))).otherwise(c)


def head_tail(text: Column | str, head: int, tail: int) -> Column:
    """Both ends of a long text with … between."""
    c = col(text)
    return F.when(F.length(c) > head + tail, F.concat(F.left(c, F.lit(head)), F.lit(" … "), F.right(c, F.lit(tail)))).otherwise(c)


def cause(text: Column | str) -> Column:
    """An error text without what differs each time: hex, quoted strings, digits."""
    c = F.regexp_replace(col(text), r"\b(?:0x)?[0-9a-fA-F]{8,}\b", "HEX")
    c = F.regexp_replace(c, r"'[^']*'|\"[^\"]*\"", "STR")
    return F.regexp_replace(c, r"[0-9]+", "N")


def safe_id(text: Column | str) -> Column:
    """Only letters, digits, dot, dash and underscore; no dots at the ends."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")


def size_bucket(n: Column | str) -> Column:
    """0, 1, 2-9, 10-99, 100-999, 1000+; negative numbers count as 0."""
    c = col(n)
    return F.when(c <= 0, "0").when(c == 1, "1").when(c < 10, "2-9").when(c < 100, "10-99").when(c < 1000, "100-999").when(c >= 1000, "1000+")


def hex_int(text: Column, digits: int) -> Column:
    """The first hex digits of sha-256 as a number (up to 15 digits)."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, digits), 16, 10).cast("bigint")


def hash_order(seed: str, key: Column | str) -> Column:
    """A text to sort by: the same pseudo-random order wherever and however often it's computed."""
    return F.sha2(F.concat(F.lit(seed + "|"), col(key).cast("string")), 256)


def digest_id(cols: Sequence[Column | str], length: int = 16) -> Column:
    """Content id: sha-256 over the columns with fixed separators; null is not the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("~")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length)


def dotted(json: Column | str, path: str) -> Column:
    """The value at a dotted path (keys and list places) of a JSON text, as text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(col(json), f"${steps}")


def resolved(json: Column | str, path: str) -> Column:
    """(present, value) at a dotted path: a JSON null is present, an absent key isn't."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    v = F.try_variant_get(F.try_parse_json(col(json)), f"${steps}", "variant")
    return F.struct(v.isNotNull().alias("present"), F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string")).alias("value"))


def first_present(json: Column | str, keys: Sequence[str]) -> Column:
    """The value of the first key that is present, even if it is null, empty or 0."""
    picks = [resolved(json, k) for k in keys]
    out = F.when(picks[0]["present"], picks[0]["value"])
    for p in picks[1:]:
        out = out.when(p["present"], p["value"])
    return out


def unmapped(json: Column | str, used: Sequence[str]) -> Column:
    """What of a JSON object a converter hasn't used, as JSON; null if nothing is left."""
    m = F.try_variant_get(F.try_parse_json(col(json)), "$", "map<string,variant>")
    rest = F.map_filter(m, lambda k, v: ~k.isin(*used)) if used else m
    return F.when(F.size(rest) > 0, F.to_json(rest))


def without_scaffold(text: Column | str, tags: Sequence[str]) -> Column:
    """Wrapper elements of these names removed with what they hold."""
    return F.trim(F.regexp_replace(col(text), r"(?s)<(" + "|".join(tags) + r")(?:\s[^>]*)?>.*?</\1>", ""))


def same_kind_equal(a: Column, b: Column) -> Column:
    """Equality of variants that tells 0, false and "" apart."""
    return F.schema_of_variant(a).eqNullSafe(F.schema_of_variant(b)) & F.to_json(a).eqNullSafe(F.to_json(b))


def answer_matches(answer: Column | str, gold: Column | str) -> Column:
    """Equal after dropping case, articles and punctuation, or gold inside an answer at most twice as long."""

    def norm(c):
        c = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]", " ")
        return collapse(F.regexp_replace(c, r"\b(?:a|an|the)\b", " "))

    a, g = norm(answer), norm(gold)
    inside = F.concat(F.lit(" "), a, F.lit(" ")).contains(F.concat(F.lit(" "), g, F.lit(" ")))
    return F.when(g == "", F.lit(False)).otherwise((a == g) | (inside & (F.length(a) <= 2 * F.length(g))))


def graded(kind: Column, answer: Column, expected: Column, allowed: Column, tolerance: Column, relative: Column) -> Column:
    """Deterministic grader: exact, allowed_set or numeric. An answer that can't be read fails."""
    norm = lambda c: collapse(F.lower(c))
    a, e = F.regexp_replace(answer, "[,$% ]", "").try_cast("double"), F.regexp_replace(expected, "[,$% ]", "").try_cast("double")
    near = F.abs(a - e) <= F.greatest(F.coalesce(tolerance, F.lit(0.0)), F.coalesce(relative, F.lit(0.0)) * F.abs(e))
    return F.coalesce(F.when(kind == "exact", norm(answer) == norm(expected)).when(kind == "allowed_set", F.array_contains(F.transform(allowed, norm), norm(answer))).when(kind == "numeric", near), F.lit(False))


def iso_duration(text: Column | str) -> Column:
    """Seconds of PnDTnHnMnS; null if it isn't one."""
    p = r"^P(?=.)(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    c = col(text)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(c.rlike(p), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def unix_nanos(text: Column | str) -> Column:
    """Nanoseconds since 1970 of an OTLP time (a number or its digits); 0, negative or unreadable give null."""
    n = col(text).cast("string").try_cast("bigint")
    return F.when(n > 0, n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones have 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of a that is in b."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common part of the smaller one."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))
