"""Rollouts and tool use: histories, evidence in shell commands, order of reading and writing."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import head_tail


def step_rows(turns: DataFrame, last: int = 8, head: int = 400, tail: int = 200) -> DataFrame:
    """turns (traj, pos, role, text) of assistants, each with the last turns before it as clipped history."""
    w = W.partitionBy("traj").orderBy("pos").rowsBetween(-last, -1)
    line = F.concat("role", F.lit(": "), head_tail(F.coalesce("text", F.lit("")), head, tail))
    x = turns.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))  # at most `last` rows each
    return x.where("role = 'assistant'")


def search_steps(turns: DataFrame, most: int) -> DataFrame:
    """(traj, pos, call, reply, rank): assistant turns with a call and the tool's reply right after, the first most."""
    w = W.partitionBy("traj").orderBy("pos")
    x = turns.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("text").over(w)})
    x = x.where("role = 'assistant' and call is not null and next_role = 'tool'").withColumn("rank", F.row_number().over(w))
    return x.where(F.col("rank") <= most).select("traj", "pos", "call", "reply", "rank")


def summary(r: DataFrame) -> DataFrame:
    """(n, ended, correct, abstained, mean_turns, correct_if_seen, correct_if_unseen) of rollouts (ended, correct, turns, answer, seen)."""
    abstain = F.lower("answer").rlike(r"\b(?:(?:i )?(?:don'?t|do not|cannot|can'?t|could not|couldn'?t) (?:know|determine|find|answer)|unknown|insufficient (?:information|evidence)|not enough (?:information|evidence))\b")
    good = F.col("correct").cast("double")
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ended").cast("double")).alias("ended"), F.avg(good).alias("correct"), F.avg(F.coalesce(abstain, F.lit(False)).cast("double")).alias("abstained"), F.avg("turns").alias("mean_turns"),
        F.avg(F.when(F.col("seen"), good)).alias("correct_if_seen"), F.avg(F.when(~F.col("seen"), good)).alias("correct_if_unseen"),
    )


def per_question(r: DataFrame, metrics: list[str]) -> DataFrame:
    """(query_id, n, the mean of each metric)."""
    return r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def compared(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, questions, mean_a, mean_b, diff) over the questions of both arms."""
    x = per_question(a, metrics).alias("a").join(per_question(b, metrics).alias("b"), "query_id")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("a"), F.col(f"b.{m}").alias("b")) for m in metrics])
    y = x.select(F.explode(rows).alias("r")).select("r.*")
    return y.groupBy("metric").agg(F.count(F.lit(1)).alias("questions"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("diff"))


# What commands do with the files they name.
READERS = frozenset("cat head tail less more grep egrep rg awk sed wc sort uniq cut diff jq xxd file stat nl tac strings".split())
WRITERS = frozenset("tee touch cp mv mkdir rm ln truncate install".split())
SETUP = frozenset("apt apt-get pip pip3 npm yarn conda brew cargo make cmake".split())
OPAQUE = frozenset("python python3 node bash sh perl ruby eval source xargs".split())
_SPLIT = re.compile(r"\s*(?:&&|\|\||[;|\n])\s*")


def command_facts(command: str) -> list[tuple[int, str, str | None]]:
    """(segment, fact, path): reads, writes, setup and opaque segments of a shell command, in order.

    A segment that can't be split into words, or runs code, is opaque: what it touches isn't known.
    """
    out = []
    for n, part in enumerate(p for p in _SPLIT.split(command or "") if p.strip()):
        try:
            words = shlex.split(part, comments=False)
        except ValueError:
            out.append((n, "opaque", None))
            continue
        while words and (re.fullmatch(r"\w+=.*", words[0]) or words[0] in ("sudo", "time", "nohup", "env")):
            words = words[1:]
        rest, i = [], 0
        while i < len(words):
            m = re.fullmatch(r"(?:\d|&)?(>>?|<)(?!&)(.*)", words[i])
            if m:
                target = m.group(2) or (words[i + 1] if i + 1 < len(words) else "")
                i += 1 if m.group(2) else 2
                if target and not target.startswith("&") and target != "/dev/null":
                    out.append((n, "write" if m.group(1) != "<" else "read", target))
                continue
            rest.append(words[i])
            i += 1
        if not rest:
            continue
        name, args = rest[0].rpartition("/")[2], [a for a in rest[1:] if not a.startswith("-")]
        if name in READERS:
            paths = args[1:] if name in ("grep", "egrep", "rg", "awk", "sed", "jq") else args
            kind = "write" if name == "sed" and any(a.startswith("-i") for a in rest[1:]) else "read"
            out += [(n, kind, a) for a in paths if not a.isdigit()]
        elif name in ("cp", "mv", "ln") and len(args) >= 2:
            out += [(n, "read", a) for a in args[:-1]] + [(n, "write", args[-1])]
        elif name in WRITERS:
            out += [(n, "write", a) for a in args]
        elif name in SETUP:
            out.append((n, "setup", None))
        elif name in OPAQUE:
            out.append((n, "opaque", None))
    return out


def shell_facts(calls: DataFrame) -> DataFrame:
    """(traj, seq, segment, fact, path) of calls (traj, seq, command)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, s, *x) for t, s, c in zip(f["traj"], f["seq"], f["command"]) if isinstance(c, str) for x in command_facts(c)]
            yield pd.DataFrame(rows, columns=["traj", "seq", "segment", "fact", "path"])

    kind = calls.schema["traj"].dataType.simpleString()
    return calls.select("traj", "seq", "command").mapInPandas(run, f"traj {kind}, seq int, segment int, fact string, path string")


def read_before_write(facts: DataFrame) -> DataFrame:
    """(traj, path, first_read, first_write, blind): whether a file was written before it was ever read, and nothing
    opaque came before that could have read it.
    """
    at = F.struct("seq", "segment")
    opaque = facts.where("fact = 'opaque'").groupBy("traj").agg(F.min(at).alias("opaque"))
    x = facts.where("path is not null").groupBy("traj", "path").agg(F.min(F.when(F.col("fact") == "read", at)).alias("first_read"), F.min(F.when(F.col("fact") == "write", at)).alias("first_write"))
    y = x.join(opaque, "traj", "left")
    blind = F.col("first_write").isNotNull() & (F.col("first_read").isNull() | (F.col("first_read") > F.col("first_write"))) & (F.col("opaque").isNull() | (F.col("opaque") > F.col("first_write")))
    return y.select("traj", "path", "first_read", "first_write", blind.alias("blind"))
