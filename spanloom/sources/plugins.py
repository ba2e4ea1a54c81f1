"""Parsers brought along: Python that turns files into trajectories, run on every file, its errors grouped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.corpus import error_groups

SCHEMA = "file string, n int, traj_id string, trajectory string, covers array<string>, error string"


def run_parser(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """(file, n, traj_id, trajectory, covers, error): what parse yields for each file (path, content).

    A trajectory is an object with id, steps (a list) and covers, the record ids it stands for. One that isn't,
    or an exception, becomes an error row; what a parser yielded before it failed is kept.
    """

    def one(name: str, data: bytes) -> list[tuple]:
        rows, n = [], 0
        try:
            for t in parse(name, data):
                bad = None if isinstance(t, dict) else "not an object"
                bad = bad or (None if isinstance(t.get("id"), str) else "no id") or (None if isinstance(t.get("steps"), list) else "no steps")
                rows.append((name, n, None if bad else t["id"], None if bad else json.dumps(t, ensure_ascii=False), [] if bad else [str(c) for c in t.get("covers", [])], f"contract: {bad}" if bad else None))
                n += 1
        except Exception as e:  # the parser is not ours
            rows.append((name, n, None, None, [], f"{type(e).__name__}: {e}"))
        return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for name, data in zip(f["path"], f["content"]) for r in one(name, bytes(data))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def parse_report(parsed: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trajectories, error groups, orphans): orphans are records (record_id) that no trajectory covers."""
    good = parsed.where("error is null")
    covered = good.select(F.explode("covers").alias("record_id")).distinct()
    return good, error_groups(parsed.where("error is not null"), "error", "file"), records.join(covered, "record_id", "left_anti")


def steps(parsed: DataFrame) -> DataFrame:
    """(traj_id, pos, source, message, calls): the steps of parsed trajectories."""
    s = F.from_json(F.get_json_object("trajectory", "$.steps"), "array<struct<source: string, message: string, tool_calls: variant>>")
    return parsed.where("error is null").select("traj_id", F.posexplode(s).alias("pos", "s")).select("traj_id", "pos", "s.source", "s.message", F.to_json("s.tool_calls").alias("calls"))
