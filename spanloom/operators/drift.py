"""Feeds whose fields are added, renamed, removed or retyped from file to file, read as one table.

Rescue-column ingestion in two steps. ingest() enforces the target schema: a field written under its
usual name with its usual JSON type lands in its typed column; everything else of the record (unknown
names, values of another type) is kept as JSON in _rescued. replay() promotes approved fields: names
from the approved list, or new names sharing words with the field they replace, are taken out of
_rescued and cast into the typed column, opening one-element lists and objects.

Nothing is lost. A line that can't be read, or holds nothing at this level, gives one row whose places
are null and whose _rescued has the line under _raw; an entry that is no object likewise, with its
place. Unknown fields around a scope (of its entry, its resource's entry, the line) are in the scope
table's _rescued under scopeSpans.*, resourceSpans.* and line.*. A JSON null under a usual name is a
null in its column; under another it stays in _rescued.

changes() reports per file and watched field what differs from the collector's file before it. How a
record writes a field is read off what ingest() and replay() made of it: typed at once, promoted or
still rescued, under which name and of which JSON type. These forms are counted per file with a
map-side combine; what is compared afterwards is one row per file and field, so a hot collector or
file costs no more than any other.

A form counts for a file if most of its eligible records have it, so single odd or late lines change
nothing. Unreadable or null records don't count. null under a name is no evidence of either kind.
Of equally frequent forms the first by name counts. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Watched:
    """A field: the usual path, the key it ends in, its usual JSON type (as in _TYPE), its column's type, and approved other names."""

    path: str
    key: str
    json: str
    kind: str
    approved: tuple[str, ...] = ()
    where: str = "true"  # eligible records, over the columns of ingest()


@dataclass(frozen=True)
class Feed:
    name: str
    payload: str
    level: dict[str, tuple[Watched, ...]] = field(default_factory=dict)  # record level -> fields
    known: dict[str, dict[str, str]] = field(default_factory=dict)  # record level -> other names of the target schema: string, or json for any value


_CHAT = "not array_contains(_names, 'gen_ai.tool.call.arguments') and not array_contains(_names, 'gen_ai.tool.call.result')"
TRACES = Feed(
    "traces", "attributes",
    {"attributes": (
        Watched("attributes.gen_ai.operation.name", "gen_ai.operation.name", "STRING", "string", ("gen_ai.operation_name", "operation.name", "gen_ai.request.operation")),
        Watched("attributes.gen_ai.request.model", "gen_ai.request.model", "STRING", "string", ("gen_ai.model_id", "llm.model"), _CHAT),
        Watched("attributes.gen_ai.usage.input_tokens", "gen_ai.usage.input_tokens", "NUMBER", "bigint", ("gen_ai.usage.prompt_tokens", "tokens.input"), _CHAT),
    )},
    {"attributes": {"task": "string", "gen_ai.completion": "string", "gen_ai.response.finish_reasons": "json", "gen_ai.tool.call.arguments": "json", "gen_ai.tool.call.result": "json", "status": "string"}},
)
_SPAN = {k: "string" for k in ("traceId", "spanId", "parentSpanId", "name", "startTimeUnixNano", "endTimeUnixNano")} | {k: "json" for k in ("kind", "attributes", "events", "links", "status")}
_SCOPE = {"name": "string", "version": "string", "attributes": "json"}
_KIND = Watched("scopeSpans.spans.kind", "kind", "NUMBER", "string", ("spanKind", "span_kind"))
VERCEL = Feed(
    "vercel", "payload",
    {
        "spans": (Watched("scopeSpans.spans.name", "name", "STRING", "string", ("operationName", "spanName", "span_name")), _KIND),
        "scope": (Watched("scopeSpans.scope.name", "name", "STRING", "string", ("library", "scopeName")),),
    },
    {"spans": _SPAN, "scope": _SCOPE},
)
OPENLLMETRY_LEGACY = Feed(
    "openllmetry_legacy", "payload",
    {
        "spans": (_KIND, Watched("scopeSpans.spans.startTimeUnixNano", "startTimeUnixNano", "STRING", "bigint", ("startTime", "start_ns"))),
        "scope": (Watched("scopeSpans.scope.version", "version", "STRING", "string", ("libVersion", "schemaVersion", "scope_version")),),
    },
    {"spans": _SPAN, "scope": _SCOPE},
)
FEEDS = (TRACES, VERCEL, OPENLLMETRY_LEGACY)
ID = ("collector", "file_name", "file_seq")


_NONE = "cast(map() as map<string,variant>)"
_MAP = "try_variant_get({}, '$', 'map<string,variant>')"
_LIST = "try_variant_get({}, '$', 'array<variant>')"
_TYPE = "nullif(regexp_replace(regexp_replace(schema_of_variant({}), '<.*', ''), '^(?!ARRAY|OBJECT|STRING|BOOLEAN|VOID).+', 'NUMBER'), 'VOID')"
_IS = {"STRING": "schema_of_variant({0}) = 'STRING'", "NUMBER": "(schema_of_variant({0}) in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith(schema_of_variant({0}), 'DECIMAL'))"}
_FILLED = "({0} is not null and not is_variant_null({0}))"


def json_type(v: Column) -> Column:
    """string, number, boolean, array or object; null for a JSON null."""
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(kind.isin("ARRAY", "OBJECT", "STRING", "BOOLEAN"), F.lower(kind)).when(kind != "VOID", "number")


def _names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _others(fields: str, known: list[str], prefix: str) -> str:
    return f"coalesce(transform_keys(map_filter({fields}, (k, v) -> k not in ({_names(known)})), (k, v) -> '{prefix}' || k), {_NONE})"


def _part(name: str, value: str, when: str) -> str:
    """A map of one entry, or none."""
    return f"if({when}, map('{name}', {value}), {_NONE})"


def records(df: DataFrame, feed: Feed, level: str, keep: tuple[str, ...] = ID) -> DataFrame:
    """One row per object of a level: keep, its places, fields (name -> variant), around (what else must be kept), raw.

    fields is null and raw the text where a line or an entry is no such object.
    """
    x = df.select(*keep, F.col(feed.payload).alias("_p"), F.try_parse_json(feed.payload).alias("_v"))
    text = "coalesce(_p, 'null')"
    if level == "attributes":
        return x.selectExpr(*keep, f"{_MAP.format('_v')} fields", f"{_NONE} around", "_p").selectExpr(*keep, "fields", "around", f"if(fields is null, {text}, null) raw")
    x = x.selectExpr(*keep, "_p", f"{_MAP.format('_v')} _line").selectExpr("*", "_line['resourceSpans'] _rs")
    x = x.selectExpr("*", f"posexplode_outer({_LIST.format('_rs')}) as (resource_pos, _r)").selectExpr("*", f"{_MAP.format('_r')} _rm").selectExpr("*", "_rm['scopeSpans'] _ss")
    x = x.selectExpr("*", f"posexplode_outer({_LIST.format('_ss')}) as (scope_pos, _s)").selectExpr("*", f"{_MAP.format('_s')} _sm")
    if level == "scope":
        x = x.selectExpr("*", "_sm['scope'] _scope", "_sm['spans'] _spans")
        around = ", ".join([
            _others("_line", ["resourceSpans"], "line."), _others("_rm", ["resource", "scopeSpans"], "resourceSpans."), _others("_sm", ["scope", "spans"], "scopeSpans."),
            _part("resourceSpans.scopeSpans", "_ss", f"{_FILLED.format('_ss')} and {_LIST.format('_ss')} is null"), _part("scopeSpans.spans", "_spans", f"{_FILLED.format('_spans')} and {_LIST.format('_spans')} is null"),
            _part("scopeSpans.scope", "_scope", f"{_FILLED.format('_scope')} and {_MAP.format('_scope')} is null"),
        ])
        # a line without such an entry, and entries that are no objects
        raw = f"case when resource_pos is null then {text} when _rm is null then to_json(_r) when scope_pos is not null and _sm is null then to_json(_s) end raw"
        return x.selectExpr(*keep, "resource_pos", "scope_pos", f"if(_sm is null, null, coalesce({_MAP.format('_scope')}, {_NONE})) fields", f"if(resource_pos is null, {_NONE}, map_concat({around})) around", "to_json(_rm['resource']) resource", raw)
    # a line without any span gives one row; scopes without spans have theirs in the scope table
    some = f"exists({_LIST.format('_rs')}, r -> exists({_LIST.format("try_variant_get(r, '$.scopeSpans')")}, s -> coalesce(size({_LIST.format("try_variant_get(s, '$.spans')")}), 0) > 0))"
    x = x.selectExpr(*keep, "_p", "_rs", "resource_pos", "scope_pos", f"posexplode_outer({_LIST.format("_sm['spans']")}) as (span_pos, _x)")
    x = x.where(f"span_pos is not null or (coalesce(resource_pos, 0) = 0 and coalesce(scope_pos, 0) = 0 and not coalesce({some}, false))").selectExpr("*", f"{_MAP.format('_x')} fields")
    places = [f"if(span_pos is null, null, {c}) {c}" for c in ("resource_pos", "scope_pos", "span_pos")]
    return x.selectExpr(*keep, *places, "fields", f"{_NONE} around", f"case when span_pos is null then {text} when fields is null then to_json(_x) end raw")


def _own_words(key: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1_\2", key).lower()) if len(w) > 2 and w != "gen"]


def written_as(feed: Feed, level: str, w: Watched, names: str) -> str:
    """Under which of names a record has the field: usual, approved, or a new one sharing words; null if none."""
    taken = {x for o in feed.level[level] for x in (o.key, *o.approved)} | set(feed.known.get(level, ()))
    own = _own_words(w.key)
    # the words of a name: camel humps and separators split, lowered; more than half of the field's must be there
    words = "split(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '$1_$2')), '[^a-z0-9]+')"
    alike = f"filter({names}, n -> n not in ({_names(sorted(taken))}) and size(array_intersect({words}, array({_names(own)}))) * 2 > {len(own)})"
    return f"coalesce(get(array_intersect(array({_names((w.key, *w.approved))}), {names}), 0), get(sort_array({alike}), 0))"


def forms(df: DataFrame, feed: Feed) -> DataFrame:
    """(collector, file_name, file_seq, field_path, name, json_type, n): how often each form was written, as ingest() and replay() found it."""
    out = None
    for level, fields in feed.level.items():
        x = replay(ingest(df, feed, level, ID), feed, level).where("_names is not null")
        x = x.selectExpr(*ID, "_forms", f"array({', '.join(w.where for w in fields)}) _ok").groupBy(*ID, "_forms", "_ok").agg(F.count(F.lit(1)).alias("n"))
        x = x.selectExpr(*ID, "n", "explode(arrays_zip(_forms, _ok)) f").selectExpr(*ID, "n", "f._forms.*", "f._ok")
        # a null JSON value is no evidence, so no form at all
        x = x.where("_ok and (name is null or json_type is not null)").groupBy(*ID, "field_path", "name", "json_type").agg(F.sum("n").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


def changes(df: DataFrame, feed: Feed) -> DataFrame:
    """(feed, file_name, field_path, change_kind): fields written otherwise than in the file before."""
    by_file = W.partitionBy("collector", "file_seq", "file_name", "field_path").orderBy(F.desc("n"), F.asc_nulls_last("name"), "json_type")
    usual = forms(df, feed).withColumn("_k", F.row_number().over(by_file)).where("_k = 1")
    by = W.partitionBy("collector", "field_path").orderBy("file_seq", "file_name")
    x = usual.withColumns({"_first": F.row_number().over(by) == 1, "_name": F.lag("name").over(by), "_type": F.lag("json_type").over(by)})
    kind = (
        F.when(F.col("_name").isNull() & F.col("name").isNotNull(), "added")
        .when(F.col("_name").isNotNull() & F.col("name").isNull(), "removed")
        .when(F.col("_name") != F.col("name"), "renamed")
        .when(F.col("_type") != F.col("json_type"), "type_changed")
    )
    return x.where("not _first").select(F.lit(feed.name).alias("feed"), "file_name", "field_path", kind.alias("change_kind")).where("change_kind is not null")


def _open(v: str) -> str:
    """A value that may be wrapped in a one-element list or an object, as text."""
    get = lambda path: f"try_variant_get({v}, '$.{path}', 'string')"
    return f"case {_TYPE.format(v)} when 'ARRAY' then try_variant_get({v}, '$[0]', 'string') when 'OBJECT' then coalesce({', '.join(map(get, ('value', 'stringValue', 'name', 'id')))}) else try_variant_get({v}, '$', 'string') end"


def _column(path: str) -> str:
    return path.replace(".", "_").lower()


def column_name(w: Watched) -> str:
    return _column(w.path.rpartition("scopeSpans.")[2].removeprefix("attributes."))


def known_column(level: str, key: str) -> str:
    return _column(key if level == "attributes" else f"{level}_{key}")


def ingest(df: DataFrame, feed: Feed, level: str, keep: tuple[str, ...]) -> DataFrame:
    """Target schema enforced: a typed column per field of it, all else in _rescued. _names: all names of the record."""
    r = records(df, feed, level, keep)
    extra = [c for c in r.columns if c.endswith("_pos") or c == "resource"]
    watched = feed.level[level]
    known = {k: kind for k, kind in feed.known.get(level, {}).items() if k not in {w.key for w in watched}}
    cols, any_of, text_of = [], [k for k, kind in known.items() if kind == "json"], [k for k, kind in known.items() if kind == "string"]
    for w in watched:
        v = f"fields['{w.key}']"
        cols.append(f"if({_IS[w.json].format(v)}, try_variant_get({v}, '$', '{w.kind}'), null) {column_name(w)}")
    for k, kind in known.items():
        v = f"fields['{k}']"
        cols.append((f"if({_FILLED.format(v)}, to_json({v}), null) " if kind == "json" else f"if({_IS['STRING'].format(v)}, try_variant_get({v}, '$', 'string'), null) ") + known_column(level, k))
    # a null is a null in its column; of a watched field the name it stands under is kept
    placed = f"case when k in ({_names(any_of)}) then true when k in ({_names(text_of)}) then schema_of_variant(v) in ('STRING', 'VOID') "
    placed += " ".join(f"when k = '{w.key}' then {_IS[w.json].format('v')} and try_variant_get(v, '$', '{w.kind}') is not null" for w in watched) + " else false end"
    # of names that clash with what stood around it the record's own value is kept
    around = "map_filter(around, (k, v) -> not coalesce(map_contains_key(fields, k), false))"
    held = f"map_concat(coalesce(map_filter(fields, (k, v) -> not {placed}), {_NONE}), {around}, {_part('_raw', 'cast(raw as variant)', 'raw is not null')})"
    return r.selectExpr(*keep, *extra, *cols, "map_keys(fields) _names", f"{held} _held").selectExpr(*keep, *extra, *[c.rpartition(" ")[2] for c in cols], "_names", "if(size(_held) > 0, to_json(_held), null) _rescued")


def replay(x: DataFrame, feed: Feed, level: str) -> DataFrame:
    """Approved fields promoted out of _rescued into their typed columns; what remains stays rescued.

    _forms: of each watched field its path, and the name and JSON type it was found under.
    """
    fields = list(enumerate(feed.level[level]))
    columns = x.columns
    x = x.selectExpr("*", "from_json(_rescued, 'map<string,variant>') _held").selectExpr("*", "coalesce(map_keys(_held), cast(array() as array<string>)) _new")
    x = x.selectExpr("*", *[f"case when {column_name(w)} is not null then '{w.key}' when size(_new) > 0 then {written_as(feed, level, w, '_new')} end _n{i}" for i, w in fields])
    x = x.selectExpr("*", *[f"_held[_n{i}] _v{i}" for i, _ in fields])
    found = ", ".join(f"named_struct('field_path', '{w.path}', 'name', _n{i}, 'json_type', if({column_name(w)} is not null, '{w.json}', {_TYPE.format(f'_v{i}')}))" for i, w in fields)
    typed = {column_name(w): f"coalesce({column_name(w)}, try_cast({_open(f'_v{i}')} as {w.kind})) {column_name(w)}" for i, w in fields}
    x = x.selectExpr(*[typed.get(c, c) for c in columns], "_held", *[f"_n{i}" for i, _ in fields], f"array({found}) _forms")
    # out of _rescued once the value has found its place
    left = " and ".join(f"not (k <=> _n{i} and {column_name(w)} is not null)" for i, w in fields)
    x = x.selectExpr(*[c for c in columns if c != "_rescued"], "_forms", f"map_filter(_held, (k, v) -> {left}) _held")
    return x.selectExpr(*[c for c in columns if c != "_rescued"], "_forms", "if(size(_held) > 0, to_json(_held), null) _rescued")


def steady_table(df: DataFrame, feed: Feed, level: str, keep: tuple[str, ...]) -> DataFrame:
    """One consistent table of a feed's level: keep, places, the fields of the target schema typed, and _rescued."""
    return replay(ingest(df, feed, level, keep), feed, level).drop("_names", "_forms")
