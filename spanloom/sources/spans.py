"""Span exports of several formats to one table of decoded spans.

Every reader takes (file, pos, record) rows and gives DECODED rows. JSON work is done by expressions
where a record is flat; records that nest spans in spans are flattened by Arrow batch in Python.
Times are nanoseconds; what isn't a time is null. Records that hold no span give no row; issues() names
the spans that lack an id, a trace or a start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import iso_duration, unix_nanos
from spanloom.operators.trees import classified

DECODED = "file string, pos int, idx int, trace_id string, span_id string, parent_span_id string, name string, start_ns bigint, end_ns bigint, attributes string, error boolean, role string, label string"


def iso_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 of an ISO time with up to nine digits; without zone it's UTC."""
    p = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d{1,9})\d*)?\s*(Z|[+-]\d\d:?\d\d)?$"
    whole = F.concat(F.regexp_extract(text, p, 1), F.lit("T"), F.regexp_extract(text, p, 2), F.lit("Z"))
    sec = F.unix_seconds(F.try_to_timestamp(whole))
    zone = F.regexp_replace(F.regexp_extract(text, p, 4), "[Z:]", "")
    off = F.when(zone == "", 0).otherwise((F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    frac = F.rpad(F.regexp_extract(text, p, 3), 9, "0").cast("bigint")
    return F.when(text.rlike(p), (sec - off) * 1_000_000_000 + F.coalesce(frac, F.lit(0)))


def _time(text: Column) -> Column:
    return F.coalesce(unix_nanos(text), iso_nanos(text))


def _get(path: str, json: str = "node") -> Column:
    return F.get_json_object(json, path)


def _roles(attributes: Column | str = "attributes") -> tuple[Column, Column]:
    a = F.col(attributes) if isinstance(attributes, str) else attributes
    from spanloom.operators.trees import CONVENTIONS

    return classified({k: F.get_json_object(a, f"$['{k}']") for k, _ in CONVENTIONS}, F.coalesce(F.get_json_object(a, "$['gen_ai.request.model']"), F.get_json_object(a, "$['llm.model_name']")))


def _finish(x: DataFrame) -> DataFrame:
    role, label = _roles()
    x = x.withColumns({"role": F.coalesce("role", role) if "role" in x.columns else role, "label": label})
    return x.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DECODED.split(", ")])


def flat(records: DataFrame) -> DataFrame:
    """One span a record (spans_flat)."""
    g = lambda p: _get(p, "record")
    x = records.where(g("$.span_id").isNotNull()).select("file", "pos", F.lit(0).alias("idx"), g("$.trace_id").alias("trace_id"), g("$.span_id").alias("span_id"), g("$.parent_span_id").alias("parent_span_id"), g("$.name").alias("name"), _time(g("$.start_time")).alias("start_ns"), _time(g("$.end_time")).alias("end_ns"), F.coalesce(g("$.attributes"), F.lit("{}")).alias("attributes"))
    return _finish(x.withColumn("error", F.get_json_object("attributes", "$.status").eqNullSafe("error")))


def otlp(records: DataFrame) -> DataFrame:
    """OTLP export requests; a span's attributes lie over its resource's. Entries that are no objects are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, pos, record in zip(f["file"], f["pos"], f["record"]):
                request = json.loads(record)
                idx = 0
                for rs in _dicts(_first(request, "resourceSpans", "resource_spans")):
                    resource = attributes(_first(rs.get("resource") if isinstance(rs.get("resource"), dict) else {}, "attributes"))
                    for sc in _dicts(_first(rs, "scopeSpans", "scope_spans", "instrumentationLibrarySpans")):
                        for s in _dicts(sc.get("spans")):
                            own = resource | attributes(s.get("attributes"))
                            status = s.get("status") if isinstance(s.get("status"), dict) else {}
                            bad = status.get("code") in (2, "2", "STATUS_CODE_ERROR", "ERROR")
                            scope = sc.get("scope") if isinstance(sc.get("scope"), dict) else {}
                            if scope.get("name"):
                                own = {"otel.scope.name": scope["name"]} | own
                            rows.append((file, pos, idx, _text(s.get("traceId")), _text(s.get("spanId")), _text(s.get("parentSpanId")), _text(s.get("name")), _int(s.get("startTimeUnixNano")), _int(s.get("endTimeUnixNano")), json.dumps(own, ensure_ascii=False), bad))
                            idx += 1
            names = ["file", "pos", "idx", "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "attributes", "error"]
            cols = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
            yield pd.DataFrame({n: pd.array(list(v), dtype="Int64") if n.endswith("_ns") else pd.Series(list(v), dtype=object) for n, v in cols.items()})

    shape = "file string, pos int, idx int, trace_id string, span_id string, parent_span_id string, name string, start_ns bigint, end_ns bigint, attributes string, error boolean"
    x = records.where("record is not null").where(F.try_parse_json("record").isNotNull()).select("file", "pos", "record").mapInPandas(run, shape)
    zero = lambda c: F.when(~F.col(c).rlike("^0*$"), F.col(c))
    return _finish(x.withColumns({"parent_span_id": zero("parent_span_id"), "trace_id": zero("trace_id"), "span_id": zero("span_id")}))


def _dicts(x) -> list[dict]:
    return [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []


def _first(x, *keys):
    return next((x[k] for k in keys if isinstance(x, dict) and x.get(k) is not None), None)


def _text(x) -> str | None:
    return x if isinstance(x, str) and x else None if x in (None, "") else str(x)


def _int(x) -> int | None:
    try:
        n = int(x)
    except (TypeError, ValueError):
        return None
    return n if 0 < n < 2**63 else None


def any_value(v):
    """An OTLP AnyValue as a JSON value; 64-bit integers may be written as text."""
    if not isinstance(v, dict):
        return v
    for k, x in v.items():
        if k in ("stringValue", "boolValue", "bytesValue"):
            return x
        if k == "intValue":
            return int(x) if str(x).lstrip("-").isdigit() else x
        if k == "doubleValue":
            return float(x) if isinstance(x, (int, float)) else x
        if k == "arrayValue":
            return [any_value(y) for y in (x or {}).get("values") or []]
        if k == "kvlistValue":
            return attributes((x or {}).get("values"))
    return None


def attributes(entries) -> dict:
    """A list of key and AnyValue as an object; of repeated keys the last counts."""
    return {e["key"]: any_value(e.get("value")) for e in _dicts(entries) if isinstance(e.get("key"), str)}


#: Where nested formats keep their nodes and children, ids and parents.
NESTS = {
    "langfuse": (("observations",), ("children", "childObservations"), ("id",), ("parentObservationId", "parent_observation_id")),
    "langsmith": (("runs",), ("child_runs",), ("id", "run_id"), ("parent_run_id",)),
    "phoenix": (("data", "spans"), (), ("context.span_id",), ("parent_id",)),
    "span_tree": (("spans",), ("child_spans",), ("span_id",), ("parent_span_id",)),
}
NODE = "file string, pos int, idx int, wrapper string, up string, node string"


def _dig(x: dict, path: str):
    for p in path.split("."):
        x = x.get(p) if isinstance(x, dict) else None
    return x


def nodes(records: DataFrame, source: str) -> DataFrame:
    """(file, pos, idx, wrapper, up, node): every node of nested records in pre-order, with the id of the node it
    is written under. A record that is a node itself is its own wrapper. Depth is bounded by memory only.
    """
    wrappers, inside, ids, _ = NESTS[source]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, pos, record in zip(f["file"], f["pos"], f["record"]):
                top = json.loads(record)
                if not isinstance(top, dict):
                    continue
                listed = _first(top, *wrappers)
                wrapper = json.dumps({k: v for k, v in top.items() if k not in wrappers}, ensure_ascii=False) if listed is not None else record
                stack, idx = [(x, None) for x in reversed(_dicts(listed) if listed is not None else [top])], 0
                while stack:
                    x, up = stack.pop()
                    own = next((str(v) for i in ids if (v := _dig(x, i)) is not None), None)
                    kids = [k for name in inside for k in _dicts(x.get(name))]
                    rows.append((file, pos, idx, wrapper, up, json.dumps({k: v for k, v in x.items() if k not in inside}, ensure_ascii=False)))
                    idx += 1
                    stack += [(k, own) for k in reversed(kids)]
            yield pd.DataFrame(rows, columns=["file", "pos", "idx", "wrapper", "up", "node"])

    return records.where("record is not null").where(F.try_parse_json("record").isNotNull()).select("file", "pos", "record").mapInPandas(run, NODE)


def _parent(*paths: str) -> Column:
    return F.coalesce(*[_get(p) for p in paths], F.col("up"))


def langfuse(records: DataFrame) -> DataFrame:
    """Observations, nested or listed. The observation type decides the role; level ERROR is an error."""
    x = nodes(records, "langfuse").where(_get("$.id").isNotNull())
    x = x.select("file", "pos", "idx", F.coalesce(_get("$.traceId"), _get("$.trace_id"), _get("$.trace_id", "wrapper"), _get("$.id", "wrapper")).alias("trace_id"), _get("$.id").alias("span_id"), _parent("$.parentObservationId", "$.parent_observation_id").alias("parent_span_id"), _get("$.name").alias("name"), _time(F.coalesce(_get("$.startTime"), _get("$.start_time"))).alias("start_ns"), _time(F.coalesce(_get("$.endTime"), _get("$.end_time"))).alias("end_ns"),
        F.to_json(F.struct(_get("$.type").alias("langfuse.observation.type"), _get("$.model").alias("gen_ai.request.model"), _get("$.input").alias("input.value"), _get("$.output").alias("output.value"), _get("$.metadata").alias("metadata"))).alias("attributes"), (F.upper(_get("$.level")) == "ERROR").alias("error"))
    return _finish(x)


def langsmith(records: DataFrame) -> DataFrame:
    """Runs with their child runs. llm is a model call, tool a tool call, anything else a step."""
    kind = F.lower(_get("$.run_type"))
    role = F.when(kind == "llm", "model").when(kind == "tool", "tool").when(kind == "embedding", "none").otherwise("step")
    own = F.coalesce(_get("$.id"), _get("$.run_id"))
    x = nodes(records, "langsmith").where(own.isNotNull())
    x = x.select("file", "pos", "idx", F.coalesce(_get("$.trace_id"), _get("$.trace_id", "wrapper"), _get("$.id", "wrapper"), own).alias("trace_id"), own.alias("span_id"), _parent("$.parent_run_id").alias("parent_span_id"), _get("$.name").alias("name"), _time(_get("$.start_time")).alias("start_ns"), _time(_get("$.end_time")).alias("end_ns"),
        F.to_json(F.struct(_get("$.inputs").alias("input.value"), _get("$.outputs").alias("output.value"), _get("$.run_type").alias("run_type"))).alias("attributes"), (_get("$.error").isNotNull() | F.coalesce(_get("$.status") == "error", F.lit(False))).alias("error"), role.alias("role"))
    return _finish(x)


def phoenix(records: DataFrame) -> DataFrame:
    """Spans, listed under data or spans or one a record."""
    x = nodes(records, "phoenix").where(_get("$.context.span_id").isNotNull())
    none = F.expr("cast(map() as map<string,variant>)")
    kind = F.create_map(F.lit("openinference.span.kind"), F.parse_json(F.concat(F.lit('"'), F.upper(_get("$.span_kind")), F.lit('"'))))
    own = F.coalesce(F.from_json(_get("$.attributes"), "map<string,variant>"), none)
    attrs = F.to_json(F.map_concat(own, F.when(_get("$.span_kind").isNotNull() & ~F.map_contains_key(own, "openinference.span.kind"), kind).otherwise(none)))
    x = x.select("file", "pos", "idx", _get("$.context.trace_id").alias("trace_id"), _get("$.context.span_id").alias("span_id"), _get("$.parent_id").alias("parent_span_id"), _get("$.name").alias("name"), _time(_get("$.start_time")).alias("start_ns"), _time(_get("$.end_time")).alias("end_ns"), attrs.alias("attributes"), (F.upper(_get("$.status_code")) == "ERROR").alias("error"))
    return _finish(x)


def span_tree(records: DataFrame) -> DataFrame:
    """One nested tree a record; the end is the start plus an ISO duration."""
    x = nodes(records, "span_tree").where(_get("$.span_id").isNotNull())
    start = _time(_get("$.timestamp"))
    x = x.select("file", "pos", "idx", F.coalesce(_get("$.trace_id"), _get("$.trace_id", "wrapper")).alias("trace_id"), _get("$.span_id").alias("span_id"), _parent("$.parent_span_id").alias("parent_span_id"), _get("$.span_name").alias("name"), start.alias("start_ns"), (start + (iso_duration(_get("$.duration")) * 1e9).cast("bigint")).alias("end_ns"), F.coalesce(_get("$.span_attributes"), F.lit("{}")).alias("attributes"), F.lower(_get("$.status_code")).eqNullSafe("error").alias("error"))
    return _finish(x)


def session_events(records: DataFrame) -> DataFrame:
    """(file, pos, session_id, event_id, at, event_type, payload): the events of session transcripts, one a row."""
    g = lambda p: _get(p, "record")
    e = F.from_json(g("$.events"), "array<struct<id: string, ts: string, event_type: string, payload: variant>>")
    x = records.where(g("$.session_id").isNotNull()).select("file", "pos", g("$.session_id").alias("session_id"), F.posexplode(e).alias("idx", "e"))
    return x.select("file", "pos", "session_id", "idx", F.col("e.id").alias("event_id"), _time(F.col("e.ts")).alias("at_ns"), "e.event_type", F.to_json("e.payload").alias("payload"))


#: Opener and closer of each kind of paired event.
PAIRS = {"model_request": "model_response", "tool_call": "tool_result", "step_start": "step_end", "agent_start": "agent_end", "approval_request": "approval_response", "retrieval_start": "retrieval_end"}


def paired_events(events: DataFrame, pairs: dict[str, str] | None = None, key: str = "call_id", second: str = "correlation_id") -> DataFrame:
    """(session_id, kind, key, opened_ns, closed_ns, status): openers with their closers.

    A pair needs exactly one opener and one closer of a key, the closer not before the opener. Events
    without the first key pair by the second. status: paired, open, stray, ambiguous or reversed.
    """
    pairs = pairs or PAIRS
    opener, kind = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for a, b in pairs.items():
        opener = F.when(F.col("event_type") == a, True).when(F.col("event_type") == b, False).otherwise(opener)
        kind = F.when(F.col("event_type").isin(a, b), a).otherwise(kind)
    k = F.coalesce(F.concat(F.lit("1:"), F.get_json_object("payload", f"$.{key}")), F.concat(F.lit("2:"), F.get_json_object("payload", f"$.{second}")))
    x = events.withColumns({"_o": opener, "kind": kind, "key": k}).where("kind is not null and key is not null")
    g = x.groupBy("session_id", "kind", "key").agg(F.count(F.when(F.col("_o"), 1)).alias("a"), F.count(F.when(~F.col("_o"), 1)).alias("b"), F.min(F.when(F.col("_o"), F.col("at_ns"))).alias("opened_ns"), F.max(F.when(~F.col("_o"), F.col("at_ns"))).alias("closed_ns"))
    status = F.when((F.col("a") > 1) | (F.col("b") > 1), "ambiguous").when(F.col("b") == 0, "open").when(F.col("a") == 0, "stray").when(F.col("closed_ns") < F.col("opened_ns"), "reversed").otherwise("paired")
    return g.select("session_id", "kind", F.substring("key", 3, 1 << 30).alias("key"), "opened_ns", "closed_ns", status.alias("status"))


READERS = {"otlp": otlp, "flat_spans": flat, "langfuse": langfuse, "langsmith": langsmith, "phoenix": phoenix, "span_tree": span_tree}


def load(records: DataFrame, source: str) -> DataFrame:
    """Decoded spans by a reader's name; an unknown name is an error, as is a source that holds no spans."""
    if source not in READERS:
        raise ValueError(f"no span reader for {source!r}; there are {', '.join(READERS)}")
    return READERS[source](records)


def issues(spans: DataFrame) -> DataFrame:
    """(kind, detail): spans without id, trace or start, and ends before starts; none of them is dropped."""
    where = F.concat(F.col("file"), F.lit("#"), F.col("pos").cast("string"), F.lit("/"), F.col("idx").cast("string"))
    kinds = F.array_compact(F.array(F.when(F.col("span_id").isNull(), "no_span_id"), F.when(F.col("trace_id").isNull(), "no_trace_id"), F.when(F.col("start_ns").isNull(), "no_start"), F.when(F.col("end_ns") < F.col("start_ns"), "ends_before_start")))
    return spans.select(F.explode(kinds).alias("kind"), where.alias("detail"))


def split_traces(spans: DataFrame) -> DataFrame:
    """(trace_id, records): traces whose spans come from more than one record."""
    return spans.where("trace_id is not null").groupBy("trace_id").agg(F.countDistinct("file", "pos").alias("records")).where("records > 1")
