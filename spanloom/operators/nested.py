"""Nested records to related flat tables by columnar shredding.

Each leaf path of the nested column becomes a stream of (repetition level, definition level, value).
The repetition level names the list in which an entry continues, the definition level how far down
the path something is present. A table per repeated ancestor is then rebuilt from those level
sequences alone: an entry whose repetition level is at most the ancestor's depth and whose definition
level reaches it starts a row; running counts over the repetition levels give the row's place in each
enclosing list, and so the link to its parent row.

All of it is numpy over Arrow offsets, one pass per batch of records, without a shuffle.

Null and empty lists give no rows, a null entry of a list gives a row whose values are null (so that
later places stay right), absent structs give null values. An empty table gives empty tables. Extra
top-level columns are ignored unless named as keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Leaf:
    """One leaf path: levels per entry, and for each entry the place of its value or -1."""

    path: tuple[str, ...]
    rep: np.ndarray
    dfn: np.ndarray
    at: np.ndarray
    values: pa.Array
    lists: tuple[tuple[int, int], ...]  # of each enclosing list: definition level of an entry's place, of an entry


def shred(array: pa.Array, name: str) -> list[Leaf]:
    """The leaves of a nested column; record i starts at the i-th entry of repetition level 0."""
    n = len(array)
    out: list[Leaf] = []
    _walk(array, (name,), np.zeros(n, np.int32), np.zeros(n, np.int32), np.arange(n, dtype=np.int64), 0, (), out)
    return out


def _valid(array: pa.Array, at: np.ndarray) -> np.ndarray:
    ok = at >= 0
    if array.null_count:
        ok[ok] = np.asarray(array.is_valid())[at[ok]]
    return ok


def _walk(array, path, rep, dfn, at, level, lists, out) -> None:
    """level: the definition level of a value that is present here."""
    kind = array.type
    ok = _valid(array, at)
    dfn = dfn + ok
    level += 1
    at = np.where(ok, at, -1)
    if pa.types.is_struct(kind):
        for i in range(kind.num_fields):
            _walk(array.field(i), (*path, kind.field(i).name), rep, dfn, at, level, lists, out)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = np.asarray(array.offsets).astype(np.int64)
        start = np.where(ok, offsets[np.where(ok, at, 0)], 0) if len(array) else np.zeros(len(at), np.int64)
        size = np.where(ok, offsets[np.where(ok, at, 0) + 1], 0) - start if len(array) else np.zeros(len(at), np.int64)
        slots = np.maximum(size, 1)
        first = np.cumsum(slots) - slots
        of = np.repeat(np.arange(len(at)), slots)
        place = np.arange(len(of)) - first[of]
        filled = size[of] > 0
        inner = np.where(filled, start[of] + place, -1)
        depth = len(lists) + 1
        # array.values ignores the slice's offset, as the offsets do
        _walk(array.values, path, np.where(place == 0, rep[of], depth).astype(np.int32), dfn[of] + filled, inner, level + 1, (*lists, (level + 1, level + 2)), out)
    else:
        out.append(Leaf(path, rep, dfn, at, array, lists))


def starts(leaf: Leaf, depth: int) -> np.ndarray:
    """Entries of the leaf at which a row of its depth-th enclosing list starts (0: a record)."""
    if depth == 0:
        return np.flatnonzero(leaf.rep == 0)
    return np.flatnonzero((leaf.rep <= depth) & (leaf.dfn >= leaf.lists[depth - 1][0]))


def places(leaf: Leaf, depth: int) -> list[np.ndarray]:
    """For each row of the depth-th list: its record, then its 0-based place in list 1 .. depth."""
    rows = starts(leaf, depth)
    out = [np.cumsum(leaf.rep == 0)[rows] - 1]
    for k in range(1, depth + 1):
        moves = leaf.rep <= k  # an entry that starts, or could start, an element of list k
        count = np.cumsum(moves)
        begin = np.maximum.accumulate(np.where(leaf.rep < k, np.arange(len(leaf.rep)), 0)) if len(leaf.rep) else rows
        out.append((count - count[begin])[rows] if len(rows) else rows)
    return out


def present(leaf: Leaf, depth: int) -> np.ndarray:
    """Whether the entry behind each row of the depth-th list is not null."""
    return leaf.dfn[starts(leaf, depth)] >= leaf.lists[depth - 1][1]


def column(leaf: Leaf, depth: int) -> pa.Array:
    """The leaf's value for each row of the depth-th list."""
    at = leaf.at[starts(leaf, depth)]
    return leaf.values.take(pa.array(np.where(at < 0, 0, at), mask=at < 0))


def assemble(leaves: list[Leaf], n: int, kind: pa.DataType, name: str) -> list:
    """Inverse of shred: the n records rebuilt from levels and values alone (used to prove the round trip)."""

    def build(kind, path, group, level, depth):
        """group: for each leaf under path its entries (indices) of one value."""
        leaf, at = group[0]
        if leaf.dfn[at[0]] < level + 1:
            return None
        if pa.types.is_struct(kind):
            return {f.name: build(f.type, (*path, f.name), [(x, i) for x, i in group if x.path[: len(path) + 1] == (*path, f.name)], level + 1, depth) for f in kind}
        if pa.types.is_list(kind):
            if leaf.dfn[at[0]] < level + 2:
                return []
            parts = []
            for x, i in group:
                cuts = [*np.flatnonzero(x.rep[i] <= depth + 1).tolist(), len(i)] if x.rep[i[0]] <= depth + 1 else []
                parts.append([(x, i[a:b]) for a, b in zip(cuts, cuts[1:])])
            return [build(kind.value_type, path, list(p), level + 2, depth + 1) for p in zip(*parts)]
        return leaf.values[int(leaf.at[at[0]])].as_py()

    records = []
    cuts = [[*np.flatnonzero(x.rep == 0).tolist(), len(x.rep)] for x in leaves]
    for r in range(n):
        group = [(x, np.arange(c[r], c[r + 1])) for x, c in zip(leaves, cuts)]
        records.append(build(kind, (name,), group, 0, 0))
    return records


# The tables of an export: name -> (path of the list, its depth)
_OWNERS = {"resource": (("resource_spans", "resource", "attributes"), 2), "span": (("resource_spans", "scopeSpans", "spans", "attributes"), 4), "event": (("resource_spans", "scopeSpans", "spans", "events", "attributes"), 5)}
TABLES = {
    "resources": (("resource_spans",), 1),
    "scopes": (("resource_spans", "scopeSpans"), 2),
    "spans": (("resource_spans", "scopeSpans", "spans"), 3),
    "events": (("resource_spans", "scopeSpans", "spans", "events"), 4),
    **{f"{o}_attributes": at for o, at in _OWNERS.items()},
    # what an attribute's own list holds: one row per entry
    **{f"{o}_attribute_{c}_items": ((*path, "value", f"{c}Value", "values"), depth + 1) for o, (path, depth) in _OWNERS.items() for c in ("array", "kvlist")},
}
SCALARS = {"string": "stringValue", "int": "intValue", "double": "doubleValue", "bool": "boolValue"}
LISTS = {"array": "arrayValue", "kvlist": "kvlistValue"}


def _text(x: pa.Array) -> pa.Array:
    """As text; a whole double keeps its .0, so that it doesn't pass for an integer."""
    import pyarrow.compute as pc

    if pa.types.is_string(x.type):
        return x
    text = x.cast(pa.string())
    return pc.if_else(pc.match_substring_regex(text, r"^-?\d+$"), pc.binary_join_element_wise(text, "0", "."), text) if pa.types.is_floating(x.type) else text


def _first_text(leaves: dict[tuple, Leaf], base: tuple, depth: int) -> pa.Array:
    """An AnyValue's scalar as text, whichever of its fields is filled."""
    import pyarrow.compute as pc

    cols = [_text(column(leaves[(*base, s)], depth)) for s in SCALARS.values() if (*base, s) in leaves]
    return pc.coalesce(*cols) if cols else pa.nulls(0, pa.string())


def _filled_kind(leaves: dict[tuple, Leaf], base: tuple, depth: int) -> pa.Array:
    """Which of an AnyValue's fields is filled: a scalar, or a list that has its own table."""
    out = None
    for kind, name in (SCALARS | LISTS).items():
        leaf = next((x for p, x in leaves.items() if p[: len(base) + 1] == (*base, name)), None)
        if leaf is not None:
            # the field's definition level is one for each part of its path and two for each list before it
            filled = leaf.dfn[starts(leaf, depth)] >= len(base) + 1 + 2 * depth
            out = np.where(filled & (out == ""), kind, out) if out is not None else np.where(filled, kind, "")
    return pa.array(np.where(out == "", None, out), pa.string()) if out is not None else pa.nulls(0, pa.string())


def _batches(name: str, key: str, fixed: dict[str, tuple[str, ...]], path: tuple[str, ...], depth: int, names: list[str], value: tuple[str, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = {x.path: x for x in shred(batch.column(batch.schema.get_field_index(name)), name)}
            any_leaf = next(x for p, x in leaves.items() if p[: len(path)] == path and len(x.lists) >= depth)
            rows = places(any_leaf, depth)
            cols = {key: batch.column(batch.schema.get_field_index(key)).take(pa.array(rows[0]))}
            cols |= {n: pa.array(p.astype(np.int32)) for n, p in zip(names, rows[1:])}
            cols["present"] = pa.array(present(any_leaf, depth))
            cols |= {n: _text(column(leaves[p], depth)) for n, p in fixed.items() if p in leaves}
            if value is not None:
                cols["value_kind"] = _filled_kind(leaves, value, depth)
                cols["value"] = _first_text(leaves, value, depth)
            yield pa.RecordBatch.from_pydict(cols)

    return run


def flat_table(exports: DataFrame, table: str, key: str = "export_id", column_name: str = "resource_spans") -> DataFrame:
    """One of TABLES: key, 0-based places in the enclosing lists (the parent link), values as text.

    An attribute says in value_kind which field of its value is filled; of array and kvlist the entries
    are rows of their own tables, under the attribute's place.
    """
    path, depth = TABLES[table]
    path = (column_name, *path[1:])
    owner = table.split("_attribute")[0]
    tops = ["resource_pos", "scope_pos", "span_pos"]
    names = {"resource": tops[:1], "resources": tops[:1], "scopes": tops[:2], "event": [*tops, "event_pos"], "events": [*tops, "event_pos"]}.get(owner, tops)
    names = [*names, *(["attribute_pos"] if "_attribute" in table else []), *(["item_pos"] if table.endswith("items") else [])]
    fixed = {
        "scopes": {"scope_name": ("scope", "name"), "scope_version": ("scope", "version")}, "events": {"name": ("name",), "time_unix_nano": ("timeUnixNano",)},
        "spans": {
            "trace_id": ("traceId",), "span_id": ("spanId",), "parent_span_id": ("parentSpanId",), "name": ("name",), "kind": ("kind",), "start_time_unix_nano": ("startTimeUnixNano",),
            "end_time_unix_nano": ("endTimeUnixNano",), "status_code": ("status", "code"), "status_message": ("status", "message"),
        },
    }.get(table, {"key": ("key",)} if table.endswith(("attributes", "kvlist_items")) else {})
    fixed = {n: (*path, *p) for n, p in fixed.items()}
    value = None if "_attribute" not in table else path if table.endswith("array_items") else (*path, "value")
    schema = T.StructType([exports.schema[key], *[T.StructField(n, T.IntegerType()) for n in names], T.StructField("present", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in [*fixed, *(["value_kind", "value"] if value else [])]]])
    return exports.select(key, column_name).mapInArrow(_batches(column_name, key, fixed, path, depth, names, value), schema)


def _looked_up(at: tuple[np.ndarray, ...], values: np.ndarray, wanted: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first value at each wanted place, or None; at is in ascending order. Size and time follow the entries."""
    both = [np.concatenate(x) for x in zip(at, wanted)]
    new = np.zeros(len(both[0]), bool)
    order = np.lexsort(both[::-1])
    for x in both:
        new[1:] |= np.diff(x[order]) != 0
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    have, want = number[: len(at[0])], number[len(at[0]) :]
    out = np.full(len(want), None, object)
    if len(have):
        i = np.minimum(np.searchsorted(have, want), len(have) - 1)
        there = have[i] == want
        out[there] = values[i[there]]
    return out


def span_rows(exports: DataFrame, key: str = "export_id", column_name: str = "resource_spans", resource_key: str = "service.name", extra: dict[str, str] | None = None) -> DataFrame:
    """Spans with the scope they stand in and one attribute of their resource, tied by the level sequences.

    Of several attributes of that key the first with a scalar value counts. extra: more resource
    attributes, as output column -> key.
    """
    spans = (column_name, "scopeSpans", "spans")
    wanted = {"resource_value": resource_key} | (extra or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = {x.path: x for x in shred(batch.column(batch.schema.get_field_index(column_name)), column_name)}
            one = leaves[(*spans, "spanId")]
            record, r, s, p = places(one, 3)
            scope = leaves[(column_name, "scopeSpans", "scope", "name")]
            srec, sr, ss = places(scope, 2)
            attr = leaves[(column_name, "resource", "attributes", "key")]
            arec, ar, _ = places(attr, 2)
            keys = column(attr, 2).to_numpy(zero_copy_only=False)
            texts = _first_text(leaves, (column_name, "resource", "attributes", "value"), 2).to_numpy(zero_copy_only=False)
            cols = {key: batch.column(batch.schema.get_field_index(key)).take(pa.array(record)), "resource_pos": pa.array(r.astype(np.int32)), "scope_pos": pa.array(s.astype(np.int32)), "span_pos": pa.array(p.astype(np.int32)), "present": pa.array(present(one, 3))}
            cols |= {n: _text(column(leaves[(*spans, f)], 3)) for n, f in (("trace_id", "traceId"), ("span_id", "spanId"), ("parent_span_id", "parentSpanId"), ("start_time_unix_nano", "startTimeUnixNano"))}
            # places are in the order of the records, so each span's scope and resource are found among theirs by search
            cols["scope_name"] = pa.array(_looked_up((srec, sr, ss), column(scope, 2).to_numpy(zero_copy_only=False), (record, r, s)), pa.string())
            for n, k in wanted.items():
                hit = np.flatnonzero((keys == k) & (texts != None))  # noqa: E711 - elementwise
                cols[n] = pa.array(_looked_up((arec[hit], ar[hit]), texts[hit], (record, r)), pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    text = ["trace_id", "span_id", "parent_span_id", "start_time_unix_nano", "scope_name", *wanted]
    schema = T.StructType([exports.schema[key], *[T.StructField(n, T.IntegerType()) for n in ("resource_pos", "scope_pos", "span_pos")], T.StructField("present", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in text]])
    return exports.select(key, column_name).mapInArrow(run, schema)


def linked_spans(exports: DataFrame) -> DataFrame:
    """Every non-null span entry with its parent's kind of link: root, linked or orphan.

    A parent that is absent, blank or only zeros names none. The records are shredded once, into a table in the
    shared folder. Parents asked for and spans there meet in one combinable aggregate over identifiers, so a hot
    parent is one row per task; only parents that are found are joined back.
    """
    from pyspark.sql import functions as F

    from spanloom.session import cut

    parent = F.lower(F.trim(F.coalesce("parent_span_id", F.lit(""))))
    spans = span_rows(exports).where("present").drop("start_time_unix_nano").withColumn("_parent", F.when(parent.rlike("^0*$"), "").otherwise(parent)).withColumn("_trace", F.lower(F.trim("trace_id")))
    spans = cut(spans, "spans")
    asked = spans.select("_trace", "_parent", F.lit(False).alias("there"), F.lit(True).alias("asked"))
    there = spans.select("_trace", F.lower(F.trim("span_id")).alias("_parent"), F.lit(True), F.lit(False)).toDF(*asked.columns)
    found = asked.unionByName(there).where("_trace is not null and _parent <> ''").groupBy("_trace", "_parent").agg(F.max("there").alias("there"), F.max("asked").alias("asked")).where("there and asked")
    out = spans.join(found.select("_trace", "_parent", F.lit(True).alias("_found")), ["_trace", "_parent"], "left")
    return out.select(
        "export_id", "resource_pos", "scope_pos", "span_pos",
        F.coalesce("span_id", F.lit("")).alias("span_id"),
        F.when(F.col("_parent") == "", "").otherwise(F.coalesce("parent_span_id", F.lit(""))).alias("parent_span_id"),
        F.when(F.col("_parent") == "", "root").when(F.col("_found"), "linked").otherwise("orphan").alias("link_kind"),
        F.coalesce("scope_name", F.lit("")).alias("scope_name"),
        F.coalesce("resource_value", F.lit("")).alias("service_name"),
    )
