"""Raw files to records: JSON documents and lines, delimited and plain text, anything else as bytes.

Nothing is dropped in silence: each stretch that can't be read comes out as a row with an issue and its
first line. Files are handled one per task and have to fit its memory; lines of JSONL too large for
that are read by json_lines(), which splits files.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, pos int, line int, record string, issue string"
JSON_TYPES = ("json", "jsonl", "ndjson")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length): every file below path in order of name; hidden files and folders are left out."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    return x.where(~F.col("file").rlike(r"/[._][^/]*(?:/|$)")).orderBy("file")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, readable) of JSONL: split by Spark, blank lines left out, no line numbers."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim(F.translate("value", "\ufeff", "")).alias("record"))
    return x.where("record <> ''").withColumn("readable", F.try_parse_json("record").isNotNull())


def split_json(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(line, record, issue) of a document, lines or concatenated values; an array's entries are records."""
    decoder, n, at, line = json.JSONDecoder(), len(text), 0, 1
    seen_to = 0
    while True:
        while at < n and text[at] in " \t\r\n":
            at += 1
        line += text.count("\n", seen_to, at)
        seen_to = at
        if at >= n:
            return
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            # skip to the next line that could start a value
            nxt = text.find("\n", at)
            while nxt >= 0 and text[nxt + 1 : nxt + 2] not in ("{", "["):
                nxt = text.find("\n", nxt + 1)
            end = n if nxt < 0 else nxt + 1
            last = line + text.count("\n", at, max(at, end - 1))
            yield line, None, f"malformed_json: lines {line} to {last}" if last > line else f"malformed_json: line {line}"
            at = end
            continue
        if isinstance(value, list) and text[at] == "[":
            for x in value:
                yield line, json.dumps(x, ensure_ascii=False), None
        else:
            yield line, text[at:end], None
        at = end


def decoded(data: bytes) -> tuple[str, int]:
    """The text of bytes without BOM, and how many bytes were no UTF-8."""
    text = data.decode("utf-8", "replace").removeprefix("\ufeff")
    return text, text.count("\ufffd") - data.count("\ufffd".encode())


def of_file(name: str, data: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(line, record as JSON, issue) of one file, by its extension."""
    kind = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    if b"\0" in data[:8192]:
        yield None, json.dumps({"bytes": len(data)}), None
        return
    text, bad = decoded(data)
    if bad:
        yield None, None, f"invalid_utf8: {bad} bytes replaced"
    if kind in JSON_TYPES:
        yield from split_json(text)
    elif kind in ("csv", "tsv"):
        rows = csv.DictReader(io.StringIO(text), delimiter="\t" if kind == "tsv" else ",")
        for r in rows:
            extra = r.pop(None, None)
            yield rows.line_num, json.dumps(r | ({"_extra": extra} if extra else {}), ensure_ascii=False), None
    else:
        for i, s in enumerate(text.splitlines(), 1):
            if s.strip():
                yield i, json.dumps({"text": s}, ensure_ascii=False), None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line, record, issue): records of all files below path; pos counts a file's records from 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows, pos = [], 0
                for line, record, issue in of_file(name, bytes(data)):
                    rows.append((name, pos if record is not None else None, line, record, issue))
                    pos += record is not None
                yield pd.DataFrame(rows, columns=["file", "pos", "line", "record", "issue"]).astype({"pos": "Int32", "line": "Int32"})

    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/[._][^/]*(?:/|$)"))
    return x.select("path", "content").mapInPandas(run, SCHEMA)


def record_ids(records: DataFrame) -> DataFrame:
    """records with record_id, the name of the file and the place in it."""
    return records.withColumn("record_id", F.concat(F.element_at(F.split("file", "/"), -1), F.lit("#"), F.col("pos").cast("string")))


def bundled(spark: SparkSession, path: str) -> DataFrame:
    """(pos, file, record): a folder of one-document JSON files, in order of name."""
    x = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), F.to_json(F.try_parse_json("value")).alias("record"))
    from pyspark.sql import Window as W

    return x.withColumn("pos", F.row_number().over(W.orderBy("file")) - 1).select("pos", "file", "record")


def record_shapes(records: DataFrame) -> DataFrame:
    """(shape, n, example): records by their sorted keys."""
    keys = F.array_join(F.array_sort(F.json_object_keys("record")), ",")
    return records.where("record is not null").groupBy(keys.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("example"))


# --- detection ------------------------------------------------------------------------------------

def _has(path: str) -> str:
    return f"get_json_object(record, '$.{path}') is not null"


#: Shapes in the order in which they are tried, as SQL over record.
SHAPES = {
    "otlp": f"{_has('resourceSpans')} or {_has('resource_spans')}",
    "session_events": f"{_has('session_id')} and {_has('events')} and {_has('schema_version')}",
    "span_tree": f"{_has('spans[0].child_spans')} or ({_has('trace_id')} and {_has('spans[0].span_attributes')})",
    "phoenix": f"{_has('context.trace_id')} or {_has('data[0].context.trace_id')} or {_has('spans[0].context.trace_id')}",
    "langfuse": _has("observations"),
    "langsmith": f"{_has('run_type')} or {_has('runs[0].run_type')}",
    "flat_spans": f"{_has('trace_id')} and {_has('span_id')} and {_has('attributes')}",
    "session_log": f"{_has('sessionId')} and ({_has('message')} or {_has('type')})",
    "chat": f"{_has('messages')} or {_has('conversations')} or {_has('conversation')} or {_has('contents')} or ({_has('role')} and ({_has('content')} or {_has('tool_calls')} or {_has('parts')})) or ({_has('from')} and {_has('value')})",
}


def detected(records: DataFrame, sample: int = 10, tolerance: float = 0.3) -> DataFrame:
    """(file, source, known, unknown): each file's source from the structure of at most sample records.

    source is null if none is recognised, several are, or more than tolerance of the sample is unknown.
    Summaries of session logs are noise and don't count.
    """
    shape = F.lit(None).cast("string")
    for name, test in reversed(SHAPES.items()):
        shape = F.when(F.expr(test), name).otherwise(shape)
    noise = F.coalesce(F.get_json_object("record", "$.type").isin("summary", "system", "file-history-snapshot"), F.lit(False)) & F.get_json_object("record", "$.message").isNull()
    x = records.where(f"record is not null and pos < {sample}").where(~noise).withColumn("shape", shape)
    y = x.groupBy("file").agg(F.count("shape").alias("known"), F.count(F.when(F.col("shape").isNull(), 1)).alias("unknown"), F.min("shape").alias("a"), F.max("shape").alias("b"))
    ok = (F.col("a") == F.col("b")) & (F.col("unknown") <= tolerance * (F.col("known") + F.col("unknown")))
    return y.select("file", F.when(ok, F.col("a")).alias("source"), "known", "unknown")
