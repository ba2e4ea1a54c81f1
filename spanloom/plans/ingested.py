"""Queries of the readers and pipelines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import checks as K
from spanloom.operators import messages as M
from spanloom.operators import redaction as R
from spanloom.operators import trees as T
from spanloom.operators import workflow as X
from spanloom.plans.catalog import spans
from spanloom.session import table
from spanloom.sources import chat as C
from spanloom.sources import spans as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Raw export lines as records."""
    return table(spark, d, name).select(F.col("file_name").alias("file"), F.col("line_id").cast("int").alias("pos"), F.col("payload").alias("record"))


_OTLP = """r as (select line_id, payload from {t} where json_valid(payload)), a as (select line_id, unnest(json_extract(payload, '$.resourceSpans[*]')) rs from r), b as (select line_id, unnest(json_extract(rs, '$.scopeSpans[*]')) sc from a), s as (select line_id, unnest(json_extract(sc, '$.spans[*]')) x from b)"""


@query(f"with {_OTLP.format(t='vercel')} select line_id::int pos, x->>'$.traceId' trace_id, x->>'$.spanId' span_id, nullif(x->>'$.parentSpanId', '') parent_span_id, try_cast(x->>'$.endTimeUnixNano' as bigint) end_ns from s")
def otlp_decoded(spark, d):
    return S.otlp(lines(spark, d, "vercel")).select("pos", "trace_id", "span_id", "parent_span_id", "end_ns")


@query(f"with {_OTLP.format(t='openllmetry_legacy')} select coalesce(x->'$.status'->>'$.code', '0') = '2' error, count(*) n from s group by 1")
def otlp_errors(spark, d):
    return S.otlp(lines(spark, d, "openllmetry_legacy")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query()
def otlp_issues(spark, d):
    return S.issues(S.otlp(lines(spark, d, "vercel"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("select session_id, event_type, count(*) n, min(event_id) first_event from failproofai group by 1, 2")
def session_event_types(spark, d):
    return table(spark, d, "failproofai").groupBy("session_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def chat_messages(spark, d):
    x = table(spark, d, "session_log").where("session_id is not null")
    return C.messages(x.select(F.col("session_id").alias("file"), F.col("record_id").cast("int").alias("pos"), F.col("message").alias("record")))


@query("""select lower(message->>'$.role') said, count(*) n from session_log where session_id is not null and json_valid(message) and lower(message->>'$.role') in ('user', 'human', 'assistant', 'ai', 'system') and json_exists(message, '$.content') and not (message->'$.content')::varchar like '%"tool_result"%' group by 1""")
def message_roles(spark, d):
    raw = table(spark, d, "session_log").where("session_id is not null").select(F.col("record_id").cast("int").alias("pos"), F.lower(F.get_json_object("message", "$.role")).alias("said"))
    x = chat_messages(spark, d).where("role is not null and role <> 'tool'").join(raw, "pos")
    return x.groupBy("said").agg(F.count(F.lit(1)).alias("n"))


@query("""with b as (select session_id, record_id, unnest(json_extract(message, '$.content[*]')) x from session_log where session_id is not null and json_valid(message) and json_type(message, '$.content') = 'ARRAY'),
    c as (select distinct session_id, x->>'$.id' id from b where x->>'$.type' = 'tool_use'), r as (select distinct session_id, x->>'$.tool_use_id' id from b where x->>'$.type' = 'tool_result')
    select c.session_id, c.id call_id, r.id is not null answered from c left join r using (session_id, id)""")
def calls_answered(spark, d):
    m = chat_messages(spark, d)
    c = m.where("calls is not null").select(F.col("file").alias("session_id"), F.explode(F.from_json("calls", "array<struct<id: string>>")).alias("c")).select("session_id", F.col("c.id").alias("call_id")).distinct()
    r = m.where("role = 'tool' and call_id is not null").select(F.col("file").alias("session_id"), "call_id").distinct().withColumn("answered", F.lit(True))
    return c.join(r, ["session_id", "call_id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


@query("""select direction, count(*) n from (select unnest(['input', 'output']) direction, attributes a from traces where json_valid(attributes)) where direction = 'output' and coalesce(trim(a->>'$."gen_ai.completion"'), '') not in ('', '""', '[]')
    and not (regexp_matches(a->>'$."gen_ai.completion"', '^\\s*(\\{"|\\[\\{|\\["|\\[\\[)') and not json_valid(a->>'$."gen_ai.completion"')) group by 1""")
def model_messages(spark, d):
    x = M.normalised(table(spark, d, "traces").select("trace_id", F.col("delivery_id").cast("string").alias("span_id"), "attributes"))
    return x.where("direction = 'output' and n = 0 and trim(content) <> '' and content <> '\"\"'").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"


@query(f"select delivery_id, len(regexp_extract_all(attributes, '{_EMAIL}')) n from traces where regexp_matches(attributes, '{_EMAIL}')")
def mail_like(spark, d):
    n = F.size(F.regexp_extract_all("attributes", F.lit(f"({_EMAIL})"), 1))
    return table(spark, d, "traces").select("delivery_id", n.cast("bigint").alias("n")).where("n > 0")


@query()
def redacted_results(spark, d):
    """Rows with a rule's match: kinds and how many, after reserved domains are left out."""
    x = R.redact(table(spark, d, "session_log").where("message is not null"), "record_id", "message")
    return x.where(F.size("kinds") > 0).select("record_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def evidence_links(spark, d):
    """Tool results of traces that later completions of the same trace repeat."""
    from spanloom.functions.scalars import dotted

    s = spans(spark, d)
    at = F.unix_micros(F.try_to_timestamp("start_time"))
    x = s.select("trace_id", "span_id", at.alias("start_ns"), F.coalesce(F.unix_micros(F.try_to_timestamp("end_time")), at).alias("end_ns"), F.get_json_object("attributes", "$['gen_ai.tool.call.result']").alias("output"), F.get_json_object("attributes", "$['gen_ai.completion']").alias("text"))
    assert dotted
    return X.link_counts(X.text_links(x.where("output is not null"), x.where("text is not null")))


@query("""with t as (select trace_id t, attributes->>'$.task' task from traces where json_valid(attributes)), g as (select lower(translate(trim(t), '-{} ', '')) trace_id, trim(task) task from t where trim(task) <> '')
    select trace_id, case when count(distinct task) = 1 then min(task) end task, case when count(distinct task) = 1 then 'declared' else 'conflict' end source from g group by 1""")
def declared_tasks(spark, d):
    from spanloom.operators.redelivery import plain_id

    x = table(spark, d, "traces").where(F.try_parse_json("attributes").isNotNull()).select(plain_id("trace_id").alias("trace_id"), F.get_json_object("attributes", "$.task").alias("task"))
    return X.resolved_task(x)


@query()
def argument_leaves(spark, d):
    """Paths of tool arguments, with how many calls have them."""
    x = table(spark, d, "traces").select("delivery_id", F.get_json_object("attributes", "$['gen_ai.tool.call.arguments']").alias("a")).where("a is not null")
    return X.field_options(x, "delivery_id", "a", ["query", "id"]).select("path", "records", "values")


@query()
def broken_conversations(spark, d):
    """Rules that whole sessions break."""
    x = table(spark, d, "session_log").where("session_id is not null and message is not null")
    rec = F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.date_format(F.col("loaded_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.parse_json("message").alias("message")))
    m = C.session_messages(x.select(F.lit("log").alias("file"), F.col("record_id").cast("int").alias("pos"), rec.alias("record")))
    from spanloom.session import cut

    m = cut(m, "messages")
    r = K.conversation_rules(m, C.calls(m))
    return r.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive r as (select n_nationkey::varchar id, 'r' || n_regionkey up from nation union all select 'r' || r_regionkey, 'world' from region union all select 'world', null) select id span_id, case when up is null then 0 when up = 'world' then 1 else 2 end depth from r""")
def hierarchy_depth(spark, d):
    n = table(spark, d, "nation").select(F.lit("w").alias("trace_id"), F.col("n_nationkey").cast("string").alias("span_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_span_id"))
    r = table(spark, d, "region").select(F.lit("w").alias("trace_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("span_id"), F.lit("world").alias("parent_span_id"))
    top = spark.createDataFrame([("w", "world", None)], "trace_id string, span_id string, parent_span_id string")
    return T.lineage(n.unionByName(r).unionByName(top)).select("span_id", "depth")
