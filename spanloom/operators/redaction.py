"""Secrets and addresses in text: redaction with issues, leak and secret scans.

A rule is what stays before (head), what is replaced (body) and what must follow (tail), in patterns both
regex engines read alike. redact_column() applies the rules one after another as built-in expressions.
redact() also opens JSON: every string literal is decoded, redacted for itself (again as JSON if it is some,
up to MAX_LEVELS deep) and written back in its place, so that what was JSON stays JSON and what holds nothing
stays byte for byte. The text under a key that names a secret is replaced whole. Stretches of one text that
overlap become one, named for the longest. Nothing recurses over the depth of a value. null stays null.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 8
# Local parts and domains of mail that stand for nobody, in alphabetical order.
ROLE_LOCALS = ("do-not-reply", "donotreply", "git", "no-reply", "noreply")
RESERVED_DOMAINS = ("example.com", "example.net", "example.org", "localhost")
# Names of secrets: a word that is one, or a carrier with a word that says what it opens.
SECRET_WORDS = ("credential", "passcode", "passphrase", "passwd", "password", "pwd", "secret")
CARRIERS, OPENS = ("key", "token"), ("access", "api", "auth", "client", "private", "refresh", "session", "signing")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


SECRET_NAME = rf"(?:(?:{_any(SECRET_WORDS)})s?|(?:{_any(OPENS)})[ _.-]?(?:{_any(CARRIERS)})s?)"


@dataclass(frozen=True)
class Rule:
    """accept: whether a match counts; only redact() asks it."""

    kind: str
    body: str
    head: str = ""
    tail: str = ""
    accept: Callable[[str], bool] | None = None

    @property
    def pattern(self) -> str:
        return f"({self.head})(?:{self.body})" + (f"(?={self.tail})" if self.tail else "")


_NAMED = rf"(?i:\b|_)(?i:{SECRET_NAME})[\"']?\s{{0,8}}[:=]\s{{0,8}}"
RULES = (
    # public token formats, fixed by those who issue them
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]{0,30}PRIVATE KEY-----|$(?!\n))"),
    Rule("bearer", r"[A-Za-z0-9._~+/=-]{12,}", r"(?i:\bbearer)\s{1,8}"),
    Rule("api_key", r"sk-[A-Za-z0-9_-]{12,}", r"\b"),
    Rule("aws_key", r"A(?:KIA|SIA)[A-Z0-9]{16}\b", r"\b"),
    # a quoted value runs to its closing quote, any other to the next blank or bracket
    Rule("named_secret", r"[^\"\n\\]{4,}", _NAMED + r"\"", r"\""),
    Rule("named_secret", r"[^'\n\\]{4,}", _NAMED + "'", "'"),
    Rule("named_secret", r"[^\s\"'\\,;}{\[]{4,}", _NAMED),
    # not right after a backslash, which would be left without its letter; the last label is letters only
    Rule(
        "email",
        rf"(?!(?i:{_any(ROLE_LOCALS)})@)[A-Za-z0-9._%+-]{{1,64}}+@(?!(?i:(?:[a-z0-9-]+\.)*(?:{_any(RESERVED_DOMAINS)}))(?![A-Za-z0-9.-]*[A-Za-z0-9]))(?:[A-Za-z0-9-]{{1,63}}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9-]|\.[A-Za-z0-9])",
        r"(?<![\\A-Za-z0-9._%+-])",
    ),
)
#: Named sets of rules; mail is often what a task is about, so it can be left alone.
RULESETS = {"default": RULES, "secrets_only": tuple(r for r in RULES if r.kind != "email")}

_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"')
_COLON = re.compile(r"\s*:\s*")
_KEY = re.compile(rf"(?i)(?:^|[^a-z0-9]|(?<=[a-z])(?=[A-Z])){SECRET_NAME}$")


def stretches(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is to be replaced in plain text; what overlaps is one stretch."""
    found = [(m.end(1), m.end(), r.kind) for r in rules for m in re.finditer(r.pattern, text) if r.accept is None or r.accept(text[m.end(1) : m.end()])]
    out: list[list] = []
    for a, b, kind in sorted(found):
        if out and a < out[-1][1]:
            last = out[-1]
            if b - a > last[3]:
                last[2:] = kind, b - a
            last[1] = max(last[1], b)
        else:
            out.append([a, b, kind, b - a])
    return [(a, b, kind) for a, b, kind, _ in out]


def _is_json(text: str) -> bool:
    s = text.lstrip()
    if s[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except RecursionError:  # too deep to parse; its literals can be told all the same
        return s.rstrip()[-1:] in ("}", "]")
    except ValueError:
        return False
    return True


def _edits(text: str, rules: tuple[Rule, ...], level: int) -> Iterator[tuple[int, int, str, list[tuple[int, str]]]]:
    """(start, end, replacement, kinds with their places), in order."""
    if level >= MAX_LEVELS or not _is_json(text):
        # a text of several lines may have JSON in some of them
        lines = text.split("\n") if level < MAX_LEVELS and "\n" in text else []
        opened = [i for i, x in enumerate(lines) if _is_json(x)]
        if opened:
            at, begin = 0, 0
            places = []
            for x in lines:
                places.append(at)
                at += len(x) + 1
            for i in [*opened, len(lines)]:
                end = places[i] if i < len(lines) else len(text)
                yield from ((begin + a, begin + b, new, [(begin + p, k) for p, k in kinds]) for a, b, new, kinds in _plain(text[begin:end], rules))
                if i < len(lines):
                    yield from ((end + a, end + b, new, [(end + p, k) for p, k in kinds]) for a, b, new, kinds in _edits(lines[i], rules, level))
                    begin = end + len(lines[i])
        else:
            yield from _plain(text, rules)
        return
    named = next((r.kind for r in rules if r.kind == "named_secret"), None)
    key, after = "", 0
    for m in _LITERAL.finditer(text):
        value = json.loads(m.group())
        is_key = _COLON.match(text, m.end()) is not None
        if named and not is_key and len(value) >= 4 and _KEY.search(key) and _COLON.fullmatch(text, after, m.start()):
            yield m.start(), m.end(), f'"[{named}]"', [(m.start(), named)]
        else:
            new, kinds = _spliced(value, rules, level + 1)
            if kinds:
                yield m.start(), m.end(), json.dumps(new, ensure_ascii=False), [(m.start(), k) for _, k in kinds]
        key, after = value if is_key else "", m.end()


def _plain(text: str, rules: tuple[Rule, ...]) -> Iterator[tuple[int, int, str, list[tuple[int, str]]]]:
    return ((a, b, f"[{k}]", [(a, k)]) for a, b, k in stretches(text, rules))


def _spliced(text: str, rules: tuple[Rule, ...], level: int) -> tuple[str, list[tuple[int, str]]]:
    out, at, kinds = [], 0, []
    for a, b, new, k in _edits(text, rules, level):
        out += (text[at:a], new)
        at = b
        kinds += k
    return "".join([*out, text[at:]]), kinds


def redacted(text: str, rules: tuple[Rule, ...] = RULES) -> tuple[str, list[tuple[int, str]]]:
    """(text, issues as (line, kind)), lines counted in the text as it came."""
    new, kinds = _spliced(text, rules, 0)
    breaks = [m.start() for m in re.finditer("\n", text)] if kinds else []
    return new, [(bisect_right(breaks, at - 1) + 1, k) for at, k in kinds]


def redact(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, text, kinds, lines): the redacted text, and of each match its kind and line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                new, issues = redacted(t, rules) if isinstance(t, str) else (None, [])
                rows.append((k, new, [x for _, x in issues], [n for n, _ in issues]))
            yield pd.DataFrame(rows, columns=[key, text, "kinds", "lines"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string, kinds array<string>, lines array<int>")


def redact_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Each rule in turn as a built-in expression, for plain text. What one rule replaced no other looks at."""
    for r in rules:
        text = F.regexp_replace(text, r.pattern, f"$1[{r.kind}]")
    return text


def _has_secret(text: Column, rule: Rule) -> Column:
    return F.coalesce(text.rlike(rule.pattern), F.lit(False))


def secrets(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULESETS["secrets_only"]) -> DataFrame:
    """(key, kind): which kinds of secrets a text holds, by built-in matching (mail not among them)."""
    kinds = F.array_distinct(F.array_compact(F.array(*[F.when(_has_secret(F.col(text), r), r.kind) for r in rules])))
    return df.select(key, F.explode(kinds).alias("kind"))


def withheld(df: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, withheld): rows with a secret in any of the texts go to the second, scrubbed."""
    bad = F.lit(False)
    for t in texts:
        for r in RULESETS["secrets_only"]:
            bad = bad | _has_secret(F.col(t), r)
    scrubbed = df.where(bad).withColumns({t: redact_column(F.col(t)) for t in texts})
    return df.where(~bad), scrubbed


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def leaks(files: DataFrame, hidden: DataFrame, least: int = 60) -> DataFrame:
    """(task_id, path, rule, detail): hidden values that visible files of the same task give away.

    files: (task_id, path, content); hidden: (task_id, name, value, is_file). Rules: identical_copy (a hidden file's
    very bytes), verbatim_run (a stretch of least characters of it, looked for at every half of that), hidden_value
    (a value of four or more characters as words of their own), answer_label ('answer: value'), answer_file (a file named
    for the answer). Every rule is a join on something both sides have: bytes, the hash of a stretch, the value's longest
    word, the first word after a label. So a task with many files and many values costs what they share, not their product.
    """
    f = files.where("content is not null").select("task_id", "path", _norm(F.col("content")).alias("c"), F.sha2("content", 256).alias("h"))
    h = hidden.where("value is not null").select("task_id", "name", _norm(F.col("value")).alias("v"), F.sha2("value", 256).alias("h"), F.coalesce("is_file", F.lit(False)).alias("is_file"))
    same = f.join(h.where("is_file"), ["task_id", "h"]).select("task_id", "path", F.lit("identical_copy").alias("rule"), F.col("name").alias("detail"))
    # stretches
    at = lambda text, starts: F.array_distinct(F.transform(starts, lambda s: F.xxhash64(F.substring(text, s, F.lit(least)))))
    run = h.where(F.col("is_file") & (F.length("v") >= least))
    run = run.select("task_id", "name", F.col("h").alias("_h"), F.explode(at(F.col("v"), F.sequence(F.lit(1), F.length("v") - least + 1, F.lit(max(1, least // 2))))).alias("_run"))
    seen = f.where(F.length("c") >= least).join(h.where("is_file").select("task_id").distinct(), "task_id", "left_semi")
    seen = seen.select("task_id", "path", "h", F.explode(at(F.col("c"), F.sequence(F.lit(1), F.length("c") - least + 1))).alias("_run"))
    runs = seen.join(run, ["task_id", "_run"]).where("h <> _h").select("task_id", "path", F.lit("verbatim_run").alias("rule"), F.col("name").alias("detail"))
    # values
    words = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}.]+", " "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    value = h.where("not is_file and length(v) >= 4").select("task_id", "name", words(F.col("v")).alias("v")).where("v <> ''")
    value = value.withColumn("_word", F.expr("array_max(transform(split(v, ' '), w -> struct(length(w) as n, w)))")["w"])
    said = f.select("task_id", "path", words(F.col("c")).alias("c")).join(value.select("task_id").distinct(), "task_id", "left_semi")
    met = said.select("task_id", "path", F.explode(F.array_distinct(F.split("c", " "))).alias("_word")).join(value, ["task_id", "_word"]).select("task_id", "path", "name", "v")
    values = met.join(said, ["task_id", "path"]).where(padded(F.col("c")).contains(padded(F.col("v")))).select("task_id", "path", F.lit("hidden_value").alias("rule"), F.col("name").alias("detail"))
    # labels
    first = lambda c: F.regexp_extract(c, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]*)", 1)
    after = F.slice(F.split("c", r"\b(?:answer|expected|solution|correct|gold)\b\W{1,6}"), 2, 1_000_000)
    labelled = f.select("task_id", "path", F.explode(after).alias("_text")).withColumn("_word", first(F.col("_text"))).distinct()
    short = h.where("not is_file and v <> ''").select("task_id", "name", "v", first(F.col("v")).alias("_word"))
    labels = labelled.join(short, ["task_id", "_word"]).where(F.startswith("_text", "v")).select("task_id", "path", F.lit("answer_label").alias("rule"), F.col("name").alias("detail"))
    last = F.element_at(F.split("path", "/"), -1)
    named = files.where(F.lower(last).rlike(r"(?:^|[._-])(?:answers?|solutions?|expected|gold|oracle)(?:[._-]|$)")).select("task_id", "path", F.lit("answer_file").alias("rule"), last.alias("detail"))
    return same.unionByName(runs).unionByName(values).unionByName(labels).unionByName(named).distinct()
