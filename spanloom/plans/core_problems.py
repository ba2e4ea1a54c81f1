"""Queries p2, p4, p5 and p7, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import drift, instants, nested, redelivery
from spanloom.session import table

IDS, ORDER = ["trace_id", "span_id"], ["received_at", "delivery_id"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_spans(table(spark, d, "langchain"))


def p2_table(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(table(spark, d, "langchain"), name)

    return run


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spans = nested.span_rows(table(spark, d, "braintrust"), extra={"zone": "host.timezone"})
    a = spans.where("present and span_id is not null").select(F.lit("braintrust").alias("src"), F.col("span_id").alias("row_key"), F.col("start_time_unix_nano").alias("t"), F.col("zone").alias("z"))
    b = table(spark, d, "session_log").select(F.lit("session_log").alias("src"), F.col("record_id").cast("string").alias("row_key"), F.col("ts").alias("t"), F.col("client_tz").alias("z"))
    c = table(spark, d, "failproofai").select(F.lit("failproofai").alias("src"), F.col("event_id").cast("string").alias("row_key"), F.get_json_object("payload", "$.timestamp").alias("t"), F.col("host_tz").alias("z"))
    return instants.with_instant(a.unionByName(b).unionByName(c), "t", "z").where("utc_us is not null").select("src", "row_key", "utc_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for feed in drift.FEEDS:
        x = drift.changes(table(spark, d, feed.name), feed)
        out = x if out is None else out.unionByName(x)
    return out


def p5_steady(feed: drift.Feed, level: str, key: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return drift.steady_table(table(spark, d, feed.name), feed, level, (key, "file_name"))

    return run


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.redelivered(spark, f"{d}/traces.parquet", IDS, ORDER).select(*IDS)


def p7_once(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.read_once(spark, f"{d}/traces.parquet", IDS, ORDER)


QUERIES = {
    "p2_found": p2_found,
    **{f"p2_{t}": p2_table(t) for t in nested.TABLES},
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_traces": p5_steady(drift.TRACES, "attributes", "delivery_id"), "p5_vercel_spans": p5_steady(drift.VERCEL, "spans", "line_id"), "p5_vercel_scopes": p5_steady(drift.VERCEL, "scope", "line_id"),
    "p5_legacy_spans": p5_steady(drift.OPENLLMETRY_LEGACY, "spans", "line_id"), "p5_legacy_scopes": p5_steady(drift.OPENLLMETRY_LEGACY, "scope", "line_id"),
    "p7_found": p7_found, "p7_once": p7_once,
}

_RES = "r as (select export_id, unnest(resource_spans) rs, (generate_subscripts(resource_spans, 1) - 1)::int resource_pos from langchain)"
_SC = _RES + ", s as (select export_id, resource_pos, rs.resource res, unnest(rs.scopeSpans) sc, (generate_subscripts(rs.scopeSpans, 1) - 1)::int scope_pos from r)"
_SP = _SC + ", p as (select export_id, resource_pos, scope_pos, res, sc.scope scope, unnest(sc.spans) x, (generate_subscripts(sc.spans, 1) - 1)::int span_pos from s)"
_ZERO = "regexp_matches(coalesce(x.parentSpanId, ''), '^0*$')"
_PLAIN = "lower(translate(trim({0}), '-{{}} ', ''))"
_T, _S = _PLAIN.format("trace_id"), _PLAIN.format("span_id")



def _drift_sql() -> str:
    """p5_found over the approved names: forms per record, the usual form per file, compared with the file before."""
    parts = []
    for feed in drift.FEEDS:
        for level, fields in feed.level.items():
            each = f"(select *, {feed.payload}::json j from {feed.name} where json_valid({feed.payload}))"
            if level == "scope":
                each = f"(select * exclude (j), coalesce(u -> '$.scope', '{{}}'::json) j from (select *, unnest(json_extract(j, '$.resourceSpans[*].scopeSpans[*]')) u from {each}))"
            elif level == "spans":
                each = f"(select * exclude (j), u j from (select *, unnest(json_extract(j, '$.resourceSpans[*].scopeSpans[*].spans[*]')) u from {each}))"
            for w in fields:
                at = lambda k: "'$.\"" + k + "\"'"
                found = " ".join(f"when json_exists(j, {at(k)}) then {{'n': '{k}', 't': json_type(j, {at(k)})}}" for k in (w.key, *w.approved))
                chat = f"not json_exists(j, {at('gen_ai.tool.call.arguments')}) and not json_exists(j, {at('gen_ai.tool.call.result')})" if w.where != "true" else "true"
                parts.append(f"select '{feed.name}' feed, collector, file_seq, file_name, '{w.path}' field_path, case {found} else {{'n': null, 't': ''}} end f from {each} where json_type(j) = 'OBJECT' and {chat}")
    kind = "case when f.t in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then 'NUMBER' when f.t = 'VARCHAR' then 'STRING' else f.t end"
    return f"""with a as ({' union all '.join(parts)}), c as (select feed, collector, file_seq, file_name, field_path, f.n n, {kind} t, count(*) k from a where f.t <> 'NULL' group by all),
        u as (select * from c qualify row_number() over (partition by feed, collector, file_seq, file_name, field_path order by k desc, n nulls last, t) = 1),
        l as (select *, lag(n) over w bn, lag(t) over w bt, row_number() over w i from u window w as (partition by feed, collector, field_path order by file_seq, file_name))
        select feed, file_name, field_path, case when bn is null then 'added' when n is null then 'removed' when n <> bn then 'renamed' else 'type_changed' end change_kind
        from l where i > 1 and (n is distinct from bn or t is distinct from bt)"""


def _value_sql(v: str) -> str:
    kind = f"case when {v}.stringValue is not null then 'string' when {v}.intValue is not null then 'int' when {v}.doubleValue is not null then 'double' when {v}.boolValue is not null then 'bool'"
    return f"{kind} when {v}.arrayValue is not null then 'array' when {v}.kvlistValue is not null then 'kvlist' end value_kind, coalesce({v}.stringValue, {v}.intValue, {v}.doubleValue::varchar, {v}.boolValue::varchar) \"value\""


_TOPS = "export_id, resource_pos, scope_pos, span_pos"
_ATTRIBUTES = {
    "resource": (f"{_RES}, o as (select export_id, resource_pos, rs.resource.attributes l from r)", "export_id, resource_pos"),
    "span": (f"{_SP}, o as (select {_TOPS}, x.attributes l from p)", _TOPS),
    "event": (f"{_SP}, e as (select {_TOPS}, unnest(x.events) v, (generate_subscripts(x.events, 1) - 1)::int event_pos from p), o as (select {_TOPS}, event_pos, v.attributes l from e)", f"{_TOPS}, event_pos"),
}


def _attributes_sql(owner: str, child: str = "") -> str:
    before, at = _ATTRIBUTES[owner]
    sql = f"with {before}, a as (select {at}, unnest(l) a, (generate_subscripts(l, 1) - 1)::int attribute_pos from o)"
    if not child:
        return f"{sql} select {at}, attribute_pos, a is not null present, a.key \"key\", {_value_sql('a.value')} from a"
    inner = f"a.value.{child}Value.values"
    sql += f", i as (select {at}, attribute_pos, unnest({inner}) i, (generate_subscripts({inner}, 1) - 1)::int item_pos from a)"
    key, value = ("", "i") if child == "array" else ("i.key \"key\", ", "i.value")
    value = _value_sql(value).replace(f" when {value}.arrayValue is not null then 'array' when {value}.kvlistValue is not null then 'kvlist'", "")
    return f"{sql} select {at}, attribute_pos, item_pos, i is not null present, {key}{value} from i"


ORACLE = {
    "p5_found": _drift_sql(),
    **{f"p2_{o}_attributes": _attributes_sql(o) for o in _ATTRIBUTES},
    **{f"p2_{o}_attribute_{c}_items": _attributes_sql(o, c) for o in _ATTRIBUTES for c in ("array", "kvlist")},
    "p2_found": f"""with {_SP}, k as (select distinct x.traceId t, x.spanId i from p where x.traceId is not null)
        select export_id, resource_pos, scope_pos, span_pos, coalesce(x.spanId, '') span_id, case when {_ZERO} then '' else x.parentSpanId end parent_span_id,
        case when {_ZERO} then 'root' when k.i is not null then 'linked' else 'orphan' end link_kind, coalesce(scope.name, '') scope_name,
        coalesce(list_filter(res.attributes, lambda a: a.key = 'service.name' and a.value.stringValue is not null)[1].value.stringValue, '') service_name
        from p left join k on k.t = x.traceId and k.i = x.parentSpanId where x is not null""",
    "p2_spans": f"""with {_SP} select export_id, resource_pos, scope_pos, span_pos, x is not null present, x.traceId trace_id, x.spanId span_id, x.parentSpanId parent_span_id, x.name "name", x.kind kind,
        x.startTimeUnixNano start_time_unix_nano, x.endTimeUnixNano end_time_unix_nano, x.status.code status_code, x.status.message status_message from p""",
    "p2_resources": f"with {_RES} select export_id, resource_pos, rs is not null present from r",
    "p2_scopes": f"with {_SC} select export_id, resource_pos, scope_pos, sc is not null present, sc.scope.name scope_name, sc.scope.version scope_version from s",
    "p2_events": f"""with {_SP}, e as (select export_id, resource_pos, scope_pos, span_pos, unnest(x.events) v, (generate_subscripts(x.events, 1) - 1)::int event_pos from p)
        select export_id, resource_pos, scope_pos, span_pos, event_pos, v is not null present, v.name "name", v.timeUnixNano time_unix_nano from e""",
    "p7_found": f"select {_T} trace_id, {_S} span_id from traces where coalesce({_T}, '') <> '' and coalesce({_S}, '') <> '' group by 1, 2 having count(*) > 1",
    "p7_once": f"""select * exclude (k) from (select *, case when coalesce({_T}, '') = '' or coalesce({_S}, '') = '' then 1 else row_number() over (partition by {_T}, {_S} order by received_at, delivery_id) end k from traces) where k = 1""",
}
