"""Queries over the test tables for the general operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import corpus as C
from spanloom.operators import evaluation as E
from spanloom.operators import similarity as M
from spanloom.operators import trees as T
from spanloom.operators.prefix import running, whole_groups
from spanloom.operators.redelivery import plain_id
from spanloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


# --- corpus queries -------------------------------------------------------------------------------


@query("select event_type grp, count(*) n from events group by 1")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return C.group_count(table(spark, d, "events"), "event_type")


@query("select event_id, event_type from events where (props->>'$.k')::int > 50")
def json_path_filter(spark, d):
    return C.query(table(spark, d, "events"), "cast(get_json_object(props, '$.k') as int) > 50").select("event_id", "event_type")


@query("select event_id, json_exists(props, '$.k') present, props->>'$.k' as \"value\", props->>'$.absent' as missing from events")
def json_path_resolved(spark, d):
    r = S.resolved("props", "k")
    return table(spark, d, "events").select("event_id", r["present"].alias("present"), r["value"].alias("value"), S.dotted("props", "absent").alias("missing"))


@query("select lang, count(*) n from documents where regexp_matches(text, 'retr(y|ied)|queue') group by 1")
def grep_count(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("retr(y|ied)|queue")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("select date_trunc('hour', ts) grp, count(*) n from events group by 1")
def expr_group(spark, d):
    return C.group_count(table(spark, d, "events"), "cast(date_trunc('hour', ts) as timestamp_ntz)")


@query("select count(*) filter (where try_cast(props->>'$.k' as int) is null) errors from events")
def expression_errors(spark, d):
    return C.unreadable(table(spark, d, "events"), "try_cast(get_json_object(props, '$.k') as int) > 0")


@query("""select doc_id, lang, turn::int turn from (select doc_id, lang, row_number() over (partition by lang order by sha256('s|' || doc_id), doc_id) turn from documents)
    where turn <= 40 order by turn, lang nulls first limit 40""")
def stratified_sample(spark, d):
    return C.stratified(table(spark, d, "documents"), ["lang"], "doc_id", 40).select("doc_id", "lang", "turn")


@query("select source, doc_id, rank::int rank from (select source, doc_id, row_number() over (partition by source order by sha256('s|' || doc_id), doc_id) rank from documents) where rank <= 3")
def seeded_topk(spark, d):
    return C.top_by_hash(table(spark, d, "documents"), ["source"], "doc_id", 3).select("source", "doc_id", "rank")


@query("""with t as (select doc_kind, doc_id, row_number() over (partition by doc_kind order by doc_id) k, count(*) over (partition by doc_kind) n from documents)
    select doc_kind, doc_id from t where k = 1 or k = n or k = n // 2 + 1""")
def first_last_middle(spark, d):
    return C.first_last_middle(table(spark, d, "documents"), "doc_kind", "doc_id").select("doc_kind", "doc_id")


@query("""with t as (select event_id, event_type = 'error' f, row_number() over (partition by event_type = 'error' order by sha256('s|' || event_id), event_id) rank from events)
    select event_id, case when f and rank <= 5 then 0 when not f then 1 else 2 end turn from t where rank <= 20 order by 2, rank limit 20""")
def failures_first(spark, d):
    return C.failures_first(table(spark, d, "events"), "event_type = 'error'", "event_id", 20, 5).select("event_id", "turn")


@query("select case when n_chars <= 0 then '0' when n_chars = 1 then '1' when n_chars < 10 then '2-9' when n_chars < 100 then '10-99' when n_chars < 1000 then '100-999' else '1000+' end bucket, count(*) n from documents group by 1")
def size_bucket(spark, d):
    return table(spark, d, "documents").groupBy(S.size_bucket("n_chars").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_CAUSE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\b(?:0x)?[0-9a-fA-F]{{8,}}\b', 'HEX', 'g'), '''[^'']*''|"[^"]*"', 'STR', 'g'), '[0-9]+', 'N', 'g')"""


@query(f"with t as (select {_CAUSE.format('payload')} cause, event_id from failproofai where event_type ilike '%error%' or event_type ilike '%end%') select cause, count(*) n, (list(event_id order by event_id))[1:3] examples from t group by 1")
def error_groups(spark, d):
    x = table(spark, d, "failproofai").where("event_type ilike '%error%' or event_type ilike '%end%'")
    return C.error_groups(x, "payload", "event_id")


@query("""with b as (select event_type, count(*) n from events where ts < timestamp '2024-01-15' group by 1), a as (select event_type, count(*) n from events where ts >= timestamp '2024-01-15' group by 1)
    select coalesce(a.event_type, b.event_type) event_type, coalesce(b.n, 0) "before", coalesce(a.n, 0) "after", coalesce(a.n, 0) - coalesce(b.n, 0) delta from a full join b on a.event_type = b.event_type""")
def delta_runs(spark, d):
    e = table(spark, d, "events").withColumn("n", F.lit(1).cast("bigint"))
    cut_at = F.lit("2024-01-15").cast("timestamp_ntz")
    return C.delta(e.where(F.col("ts") < cut_at), e.where(F.col("ts") >= cut_at), "event_type", "n")


@query("select lang, source, doc_id, turn::int turn from (select lang, source, doc_id, row_number() over (partition by lang, source order by n_chars desc, doc_id) turn from documents) where turn <= 50 order by turn, lang nulls first, source nulls first limit 50")
def balanced_select(spark, d):
    return C.balanced(table(spark, d, "documents"), ["lang", "source"], [F.desc("n_chars"), F.asc("doc_id")], 50).select("lang", "source", "doc_id", "turn")


@query("select lang, doc_kind, doc_id, rank::int rank from (select lang, doc_kind, doc_id, row_number() over (partition by lang, doc_kind order by doc_id) rank from documents) where rank <= 2")
def trim_classes(spark, d):
    return C.at_most(table(spark, d, "documents"), ["lang", "doc_kind"], ["doc_id"], 2).select("lang", "doc_kind", "doc_id", "rank")


@query("""with g as (select user_id, count(*) n from events group by 1), t as (select user_id, n, coalesce(sum(n) over (order by sha256('g|' || user_id), user_id rows between unbounded preceding and 1 preceding), 0) b from g)
    select event_id, user_id from events join t using (user_id) where b < 500""")
def whole_group_sample(spark, d):
    return whole_groups(table(spark, d, "events"), "user_id", S.hash_order("g", "user_id"), 500).select("event_id", "user_id")


@query("""select delivery_id, case when n > 0 then span_id || '#' || n else span_id end unique_id from (select delivery_id, span_id, row_number() over (partition by span_id order by delivery_id) - 1 n from traces)""")
def numbered_ids(spark, d):
    return C.numbered_ids(table(spark, d, "traces"), "span_id", "delivery_id").select("delivery_id", "unique_id")


@query("""select doc_id, lang, n_chars from documents where doc_id % 10 <> 0 and lang is not null union all select doc_id, 'new', 0::bigint from documents where doc_id % 10 = 0""")
def upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("lang"), F.lit(0).cast("bigint").alias("n_chars"))
    return C.upsert(docs, new, ["doc_id"], "lang is null")


@query("select span_id, count(distinct trace_id) contents from traces group by 1 having count(distinct trace_id) > 1")
def id_clashes(spark, d):
    return C.clashes(table(spark, d, "traces"), ["span_id"], ["trace_id"])


@query("""with e as (select distinct session_id from traces where session_id is not null), s as (select distinct l_orderkey k from lineitem)
    select o_orderkey, case when o_orderkey % 7 = 0 then 'excluded' when s.k is not null then 'used' else 'unaccounted' end outcome from orders left join s on s.k = o_orderkey""")
def outcome_priority(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return C.outcomes(o, "o_orderkey", {"excluded": o.where("o_orderkey % 7 = 0"), "used": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))})


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def covered_anti(spark, d):
    return C.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""select l_returnflag, count(*) filter (where l_linestatus = 'O') "O", count(*) filter (where l_linestatus = 'F') "F", count(*) total from lineitem group by 1""")
def status_matrix(spark, d):
    return C.matrix(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("""with q as (select source, target_share, 1000 * target_share / sum(target_share) over () q from mix_targets where mix_name = 'base'), t as (select *, floor(q)::bigint b, 1000 - sum(floor(q)) over () l, row_number() over (order by q - floor(q) desc, source) n from q)
    select source, b + (n <= l)::bigint as share from t""")
def apportioned(spark, d):
    return C.apportioned(table(spark, d, "mix_targets").where("mix_name = 'base'"), "source", "target_share", 1000)


_PLAINT, _PLAINS, _PLAINP = (f"nullif(lower(translate(trim({c}), '-{{}} ', '')), '')" for c in ("trace_id", "span_id", "parent_span_id"))
_FIRST = f"s as (select * from (select {_PLAINT} t, {_PLAINS} s, {_PLAINP} p, delivery_id, case when json_valid(attributes) then attributes end a, span_name, row_number() over (partition by {_PLAINT}, {_PLAINS} order by received_at, delivery_id) k from traces) where k = 1)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """traces as distinct spans with plain ids."""
    x = table(spark, d, "traces").select(plain_id("trace_id").alias("trace_id"), plain_id("span_id").alias("span_id"), plain_id("parent_span_id").alias("parent_span_id"), "received_at", "delivery_id", "span_name", "start_time", "end_time", "attributes")
    return T.first_copies(x, ["received_at", "delivery_id"])[0]


@query(f"with {_FIRST} select t trace_id, s span_id, delivery_id from s")
def first_copy_wins(spark, d):
    return spans(spark, d).select("trace_id", "span_id", "delivery_id")


@query(f"""with recursive {_FIRST}, top as (select t, s from s where p is null or not exists (select 1 from s o where o.t = s.t and o.s = s.p)),
    r as (select t, s, s root, 0 depth from top union all select s.t, s.s, r.root, r.depth + 1 from s join r on s.t = r.t and s.p = r.s)
    select s.t trace_id, s.s span_id, r.root root_id, r.depth, r.root is null "cyclic" from s left join r on s.t = r.t and s.s = r.s""")
def tree_closure(spark, d):
    return T.lineage(spans(spark, d))


@query(f"with {_FIRST} select t trace_id, min_by(s, (received, s)) root_id from (select s.*, delivery_id received from s where p is null or not exists (select 1 from s o where o.t = s.t and o.s = s.p)) group by 1")
def episode_roots(spark, d):
    return T.episode_roots(spans(spark, d), ["delivery_id"])


_OP = """coalesce(a->>'$."gen_ai.operation.name"[0]', a->>'$."gen_ai.operation.name"')"""
_ROLE = """case when coalesce(a->>'$."gen_ai.operation.name"', '') in ('chat', 'text_completion', 'generate_content', 'response') then 'model' when a->>'$."gen_ai.operation.name"' = 'execute_tool' then 'tool'
    when a->>'$."gen_ai.operation.name"' in ('invoke_agent', 'invoke_workflow') then 'step' else 'none' end"""


def with_role(spark, d):
    x = spans(spark, d)
    op = F.get_json_object("attributes", "$['gen_ai.operation.name']")
    role, label = T.classified({"gen_ai.operation.name": op})
    return x.withColumns({"role": role, "label": label})


@query(f"with {_FIRST} select {_ROLE} as role, count(*) n from s group by 1")
def span_roles(spark, d):
    return with_role(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_FIRST}, w as (select t, s, p, span_name, {_ROLE} as role from s) select span_name, role, count(*) calls, count(*) filter (where exists (select 1 from w o where o.t = w.t and o.s = w.p)) linked from w group by 1, 2""")
def calls_by_name(spark, d):
    x = with_role(spark, d)
    there = x.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct().withColumn("_l", F.lit(1))
    return x.join(there, ["trace_id", "parent_span_id"], "left").groupBy("span_name", "role").agg(F.count(F.lit(1)).alias("calls"), F.count("_l").alias("linked"))


@query()
def span_buckets(spark, d):
    return T.bucketed(with_role(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query()
def trace_shapes(spark, d):
    return T.shape_stats(spans(spark, d), F.col("span_name"))


# --- windows --------------------------------------------------------------------------------------


@query("select event_id, lag(event_type) over w prev1, lag(event_type, 2) over w prev2 from events window w as (partition by user_id order by ts, event_id)")
def two_step_history(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("prev1"), F.lag("event_type", 2).over(w).alias("prev2"))


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 repeated from events")
def repeat_actions(spark, d):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) > 1).alias("repeated"))


@query("""with t as (select event_id, user_id, case when event_type = 'error' then -value else value end / 100 r, ts from events),
    u as (select *, sum(greatest(r, 0)) over w up, sum(greatest(-r, 0)) over w down from t window w as (partition by user_id order by ts, event_id))
    select event_id, round((least(up, 3.0) - least(up - greatest(r, 0), 3.0)) - (least(down, 3.0) - least(down - greatest(-r, 0), 3.0)), 6) capped from u""")
def running_caps(spark, d):
    e = table(spark, d, "events").withColumn("r", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")) / 100)
    return E.capped_rewards(e, "user_id", ["ts", "event_id"], "r", 3.0).select("event_id", r6("capped").alias("capped"))


@query("""with t as (select event_id, user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours then 1 else 0 end n from events)
    select event_id, user_id, sum(n) over (partition by user_id order by ts, event_id)::bigint "session" from t""")
def session_lineage(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")
    x = table(spark, d, "events").withColumn("n", F.when(gap, 1).otherwise(0))
    return x.select("event_id", "user_id", F.sum("n").over(w).cast("bigint").alias("session"))


@query("""select event_type action, evidence, count(*) cells from
    (select event_type, coalesce(string_agg(event_type, '>') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), '') evidence from events) group by 1, 2""")
def decision_cells(spark, d):
    x = E.histories(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return x.groupBy(F.col("event_type").alias("action"), "evidence").agg(F.count(F.lit(1)).alias("cells"))


@query("""with t as (select record_id, session_id, rec_type, loaded_at from session_log where rec_type in ('user', 'assistant') and session_id is not null)
    select record_id, max(case when rec_type = 'assistant' then record_id end) over (partition by session_id order by loaded_at, record_id rows between unbounded preceding and 1 preceding) anchor from t qualify rec_type = 'user'""")
def user_turn_anchor(spark, d):
    w = W.partitionBy("session_id").orderBy("loaded_at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    x = table(spark, d, "session_log").where("rec_type in ('user', 'assistant') and session_id is not null")
    x = x.withColumn("anchor", F.max(F.when(F.col("rec_type") == "assistant", F.col("record_id"))).over(w))
    return x.where("rec_type = 'user'").select("record_id", "anchor")


@query("""with s as (select user_id, ts, event_id from events where event_type = 'error'), c as (select user_id, ts, event_id from events where event_type = 'click')
    select s.event_id, (select c.event_id from c where c.user_id = s.user_id and c.ts > s.ts order by c.ts, c.event_id limit 1) claimed from s""")
def asof_claim(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)
    x = table(spark, d, "events").where("event_type in ('error', 'click')")
    x = x.withColumn("claimed", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w))
    return x.where("event_type = 'error'").select("event_id", "claimed")


@query("""with g as (select user_id, ts::date as day, count(*) filter (where event_type = 'signup') o, count(*) filter (where event_type = 'purchase') c, min(ts) filter (where event_type = 'signup') a, max(ts) filter (where event_type = 'purchase') b from events group by 1, 2)
    select user_id, day, a opened, b closed from g where o = 1 and c = 1 and b >= a""")
def opener_closer_pairs(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    when = lambda k, v: F.when(F.col("event_type") == k, v)
    g = e.groupBy("user_id", "day").agg(F.count(when("signup", 1)).alias("o"), F.count(when("purchase", 1)).alias("c"), F.min(when("signup", F.col("ts"))).alias("opened"), F.max(when("purchase", F.col("ts"))).alias("closed"))
    return g.where("o = 1 and c = 1 and closed >= opened").select("user_id", "day", "opened", "closed")


# --- evaluation -----------------------------------------------------------------------------------

_PY = "p as (select doc_id, lang, source, least(n_chars, 1000) / 1000.0::double p, (doc_id % 3 = 0)::int y from documents)"


def scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", (F.least(F.col("n_chars"), F.lit(1000)) / 1000).alias("p"), (F.col("doc_id") % 3 == 0).cast("int").alias("y"))


@query(f"with {_PY} select lang, count(*) n, round(avg((p - y) * (p - y)), 6) brier, round(avg(-ln(greatest(case when y = 1 then p else 1 - p end, 1e-15))), 6) nll from p group by 1")
def brier_nll(spark, d):
    return E.binary_scores(scored(spark, d), "p", "y", ["lang"]).select("lang", "n", r6("brier").alias("brier"), r6("nll").alias("nll"))


@query(f"with {_PY}, b as (select least(floor(p * 10), 9)::bigint bin, count(*) n, avg(p) mp, avg(y::double) r from p group by 1) select g.bin, coalesce(n, 0) n, round(mp, 6) mean_p, round(r, 6) rate from (select unnest(range(10)) bin) g left join b using (bin)")
def reliability_bins(spark, d):
    return E.reliability_bins(scored(spark, d), "p", "y").select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query(f"with {_PY}, b as (select least(floor(p * 10), 9) bin, count(*) n, avg(p) mp, avg(y::double) r from p group by 1) select round(sum(n * abs(mp - r)) / sum(n), 6) ece from b")
def calibration_error(spark, d):
    return E.calibration_error(scored(spark, d), "p", "y").select(r6("ece").alias("ece"))


@query("""with t as (select doc_kind g, case when n_chars < 400 then 'note' when n_chars < 900 then 'guide' else 'summary' end q from documents), l as (select g l from t union select q from t)
    select count(*) labels, round(avg(2.0 * (select count(*) from t where g = l and q = l) / ((select count(*) from t where g = l) + (select count(*) from t where q = l))), 6) macro_f1 from l""")
def macro_f1(spark, d):
    q = F.when(F.col("n_chars") < 400, "note").when(F.col("n_chars") < 900, "guide").otherwise("summary")
    return E.macro_f1(table(spark, d, "documents").withColumn("q", q), "doc_kind", "q").select("labels", r6("macro_f1").alias("macro_f1"))


@query(f"""with {_PY}, r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 k from p), s as (select sum(y)::bigint a, (count(*) - sum(y))::bigint b, sum(case when y = 1 then k end) u from r)
    select a positives, b negatives, round((u - a * (a + 1) / 2.0) / (a::double * b), 6) auc from s""")
def auc(spark, d):
    return E.auc(scored(spark, d), "p", "y").select("positives", "negatives", r6("auc").alias("auc"))


@query(f"""with {_PY}, g as (select lang, sum(case when b.p < a.p then 1.0 when b.p = a.p then 0.5 else 0 end) / count(*) v from p a join p b using (lang) where a.y = 1 and b.y = 0 group by 1) select count(*) as "groups", round(avg(v), 6) mean_auc from g""")
def auc_within(spark, d):
    return E.auc_within(scored(spark, d).where("lang is not null"), "lang", "p", "y").select("groups", r6("mean_auc").alias("mean_auc"))


@query("""with g as (select user_id, event_type, count(*) n from events group by 1, 2), u as (select user_id, sum(n) gn from g group by 1), o as (select event_type, sum(n) on_ from g group by 1), t as (select sum(n) tn from g)
    select user_id, round(sum(abs(coalesce(n, 0) / gn - on_ / tn)) / 2, 6) tv from u cross join o cross join t left join g using (user_id, event_type) group by 1""")
def tv_distance(spark, d):
    return E.total_variation(table(spark, d, "events"), "user_id", "event_type").select("user_id", r6("tv").alias("tv"))


@query(f"with {_PY} select count(*) n, round(avg(((p > 0.5)::int = y)::int), 6) mean_a, round(avg(case when doc_id % 5 = 0 then 0 else ((p > 0.3)::int = y)::int end), 6) mean_b, round(avg(((p > 0.5)::int = y)::int - case when doc_id % 5 = 0 then 0 else ((p > 0.3)::int = y)::int end), 6) mean_diff from p")
def paired_diff(spark, d):
    x = scored(spark, d)
    right = lambda t: (((F.col("p") > t).cast("int")) == F.col("y")).cast("int")
    a, b = x.withColumn("v", right(0.5)), x.where("doc_id % 5 <> 0").withColumn("v", right(0.3))
    y = E.paired_difference(a, b, "doc_id", "v")
    return y.select("n", *[r6(c).alias(c) for c in ("mean_a", "mean_b", "mean_diff")])


@query("""with g as (select source, sum(n_chars) s, count(*) n, row_number() over (order by source) - 1 idx from documents where source is not null group by 1), k as (select count(*) k from g),
    w as (select d.draw, ('0x' || substr(sha256('b|' || d.draw || '|' || s.slot), 1, 8))::bigint % k.k idx from (select unnest(range(200)) draw) d cross join k cross join (select unnest(range(1000)) slot) s where s.slot < k.k),
    m as (select draw, sum(g.s)::double / sum(g.n) m from w join g using (idx) group by 1), o as (select m, row_number() over (order by m, draw) - 1 k from m)
    select (select round(sum(s)::double / sum(n), 6) from g) mean, max(m) filter (where k = 4) low, max(m) filter (where k = 194) high from (select round(m, 6) m, k from o)""")
def bootstrap_ci(spark, d):
    return E.bootstrap(table(spark, d, "documents").withColumn("v", F.col("n_chars").cast("double")), "source", "v").select(*[r6(c).alias(c) for c in ("mean", "low", "high")])


@query("""with t as (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 k, count(*) over (partition by source) n from documents)
    select source, n, max(n_chars) filter (where k = n // 2) p50, max(n_chars) filter (where k = least(n - 1, floor(0.99 * n))) p99, max(n_chars) filter (where k = floor(0.9 * (n - 1))) p90, max(n_chars) filter (where k = greatest(0, ceil(0.95 * n - 1e-9) - 1)) p95 from t group by 1, 2""")
def positional_quantiles(spark, d):
    return E.positional(table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("~"))), ["source"], "n_chars", {"p50": E.HALF, "p99": E.P99, "p90": E.P90_INNER, "p95": E.NEAREST_RANK.format(q=0.95)}).withColumn("source", F.nullif("source", F.lit("~")))


@query("with g as (select doc_kind, source, count(*) n from documents where source is not null group by 1, 2), t as (select doc_kind, sum(n) t from g group by 1) select doc_kind, count(*) kinds, round(-sum(n / t * log2(n / t)), 6) bits from g join t using (doc_kind) group by 1")
def source_entropy(spark, d):
    return E.entropy(table(spark, d, "documents").where("source is not null"), ["doc_kind"], "source").select("doc_kind", "kinds", r6("bits").alias("bits"))


@query("""with s as (select user_id, string_agg(event_type, '>' order by ts, event_id) sig from events group by 1), g as (select sig, count(*) n from s group by 1)
    select count(*) kinds, round(-sum(n / t * log2(n / t)), 6) bits from g cross join (select sum(n) t from g)""")
def signature_entropy(spark, d):
    s = E.signatures(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return E.entropy(s, [], "sig").select("kinds", r6("bits").alias("bits"))


@query("select event_id, round(value - avg(value) over (partition by user_id), 9) advantage from events")
def group_advantage(spark, d):
    return E.advantages(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 9).alias("advantage"))


@query("select user_id, event_type, round(count(*) / sum(count(*)) over (partition by user_id), 6) as share from events group by 1, 2")
def vote_shares(spark, d):
    return E.vote_shares(table(spark, d, "events"), "user_id", "event_type").select("user_id", "event_type", r6("share").alias("share"))


@query(f"with {_PY}, t as (select y = 1 t, p > 0.5 v from p) select count(*) n, count(*) filter (where t = v) agree, count(*) filter (where v and not t) false_accept, count(*) filter (where t and not v) false_reject from t")
def judge_agreement(spark, d):
    return E.agreement(scored(spark, d).select((F.col("y") == 1).alias("t"), (F.col("p") > 0.5).alias("v")), "t", "v")


@query("""with g as (select user_id, event_type, count(*) n, min(event_id) p from events group by 1, 2), m as (select user_id, max(n) m from g group by 1)
    select user_id, min_by(event_type, p) top, case when count(*) = 1 then min(event_type) end gold, count(*) ties from g join m using (user_id) where n = m group by 1""")
def argmax_and_ties(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("pos"))
    return E.tops(g, "user_id", "event_type", "n", "pos")


_B = "('0x' || substr(sha256({0}::varchar), 1, {1}))::bigint"


@query(f"select doc_id, case when {_B.format('doc_id', 2)} / 256 < 0.7 then 'train' when {_B.format('doc_id', 2)} / 256 < 0.8 then 'calibration' when {_B.format('doc_id', 2)} / 256 < 0.9 then 'validation' else 'test' end split from documents")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", E.hash_split(F.col("doc_id"), [("train", 0.7), ("calibration", 0.8), ("validation", 0.9)], "test").alias("split"))


@query("select distinct source, (('0x' || substr(sha256(source), 1, 8))::hugeint * 4294967296 + ('0x' || substr(sha256(source), 9, 8))::hugeint) % 3 = 0 held from documents where source is not null")
def heldout_split(spark, d):
    return table(spark, d, "documents").where("source is not null").select("source").distinct().withColumn("held", E.held_out(F.col("source")))


@query(f"select doc_id, {_B.format('doc_id', 8)} % 20 bucket from documents")
def hash_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", E.bucket_of(F.col("doc_id"), 20).alias("bucket"))


@query("""with t as (select doc_id, text, lang, source, doc_kind from documents), i as (select doc_id, count(*) n from t group by 1), c as (select text, doc_kind k2, count(distinct lang) l, min(doc_id) f from t group by 1, 2), s as (select source, count(distinct doc_kind) k from t group by 1)
    select t.doc_id, case when i.n > 1 then 'duplicate_id' when c.l > 1 then 'conflict' when t.doc_id <> c.f then 'repeat' else 'kept' end status from t join i using (doc_id) join c on c.text = t.text and c.k2 = t.doc_kind""")
def import_quarantine(spark, d):
    x = table(spark, d, "documents").withColumn("split", F.lit("one"))
    return C.duplicate_quarantine(x, "doc_id", ["text", "doc_kind"], "lang", "source", "split").select("doc_id", "status")


@query("select o_orderkey, o_custkey, coalesce(sum(o_custkey) over (order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as \"before\" from orders")
def prefix_sums(spark, d):
    return running(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], {"before": F.col("o_custkey")}).select("o_orderkey", "o_custkey", "before")


@query("""select l_returnflag, l_linestatus, l_shipmode, rows, round(total, 2) total from (
    select l_returnflag, null l_linestatus, null l_shipmode, count(*) rows, sum(l_extendedprice) total from lineitem group by 1 union all select null, l_linestatus, null, count(*), sum(l_extendedprice) from lineitem group by l_linestatus union all select null, null, year(l_shipdate)::varchar, count(*), sum(l_extendedprice) from lineitem group by year(l_shipdate))""")
def ledger_rollup(spark, d):
    x = table(spark, d, "lineitem").withColumn("l_shipmode", F.year("l_shipdate").cast("string"))
    x.createOrReplaceTempView("spanloom_ledger")
    return spark.sql("select l_returnflag, l_linestatus, l_shipmode, count(*) rows, round(sum(l_extendedprice), 2) total from spanloom_ledger group by grouping sets ((l_returnflag), (l_linestatus), (l_shipmode))")


@query("""select p_partkey, case when abs(p_retailprice - (900 + p_partkey / 10.0)) <= greatest(1.0, 0.01 * abs(900 + p_partkey / 10.0)) then true else false end passed from part""")
def grader_numeric(spark, d):
    p = table(spark, d, "part")
    none = F.lit(None).cast("array<string>")
    return p.select("p_partkey", S.graded(F.lit("numeric"), F.col("p_retailprice").cast("string"), (900 + F.col("p_partkey") / 10.0).cast("string"), none, F.lit(1.0), F.lit(0.01)).alias("passed"))


# --- similarity -----------------------------------------------------------------------------------

_W = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_GRAMS = "unnest(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))))"


@query(f"""with d as (select doc_id, {_W.format("text")} w from documents), r as (select min(doc_id) over (partition by w) rep, doc_id, w from d), u as (select doc_id, w from r where rep = doc_id),
    s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from u),
    e as (select doc_id, unnest(g) g, len(g) n from s), c as (select a.doc_id a, b.doc_id b, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2), p as (select a, b from c where k / (na + nb - k) >= 0.8),
    l as (select a x, b y from p union all select b, a from p), m as (with recursive z as (select x, x y from l union select z.x, l.y from z join l on l.x = z.y) select x, min(y) c from z group by 1)
    select r.doc_id, coalesce(m.c, r.rep) class_id, count(*) over (partition by r.rep) copies, (select count(*) from l where l.x = r.rep) links from r left join m on m.x = r.rep""")
def near_dup_classes(spark, d):
    return M.near_duplicates(table(spark, d, "documents"))


@query(f"""with d as (select doc_id, {_W.format("text")} w from documents), e as (select doc_id, {_GRAMS.format(n=8)} gram from d where len(w) >= 8) select gram, count(*) docs from e group by 1 having count(*) >= greatest(3, 0.005 * (select count(*) from d))""")
def ngram_docfreq(spark, d):
    return M.document_frequency(table(spark, d, "documents"), "doc_id", "text", 8, share=0.005)


_TEXTS = "i as (select item_id * 2 text_id, prompt t from eval_items union all select item_id * 2 + 1, answer from eval_items)"
_HELD = f"{_TEXTS}, h as (select text_id item_id, {_W.format('t')} w from i), hg as (select item_id, {_GRAMS.format(n=8)} gram from h where len(w) >= 8), d as (select doc_id, {_W.format('text')} w from documents), dg as (select doc_id, {_GRAMS.format(n=8)} gram from d where len(w) >= 8)"


def item_texts(spark, d):
    """Prompts and answers, each with an id of its own."""
    i = table(spark, d, "eval_items")
    return i.select((F.col("item_id") * 2).alias("text_id"), F.col("prompt").alias("held")).unionByName(i.select((F.col("item_id") * 2 + 1).alias("text_id"), F.col("answer").alias("held")))


@query(f"with {_HELD} select distinct doc_id from dg where gram in (select gram from hg)")
def contaminated_docs(spark, d):
    return M.containing(table(spark, d, "documents"), "doc_id", "text", item_texts(spark, d), "held")


@query(f"""with {_HELD}, b as (select gram from dg group by 1 having count(*) >= greatest(3, 0.05 * (select count(*) from documents))), x as (select * from dg where gram not in (select gram from b)), y as (select * from hg where gram not in (select gram from b)),
    c as (select doc_id, item_id, count(*) n from x join y using (gram) group by 1, 2) select doc_id, item_id, round(n / least(nx, ny), 6) as share from c join (select doc_id, count(*) nx from x group by 1) using (doc_id) join (select item_id, count(*) ny from y group by 1) using (item_id) where n / least(nx, ny) >= 0.5""")
def decontam_overlap(spark, d):
    x = M.copied(table(spark, d, "documents"), "doc_id", "text", item_texts(spark, d), "text_id", "held")
    return x.select("doc_id", F.col("text_id").alias("item_id"), r6("share").alias("share"))


@query(f"""with d as (select lang, {_W.format("text")} w from documents), e as (select lang, {_GRAMS.format(n=3)} gram from d where len(w) >= 3) select lang, count(*) grams, count(distinct gram) distinct_grams, round(count(distinct gram) / count(*), 6) ratio from e group by 1""")
def distinct_3gram_ratio(spark, d):
    return M.diversity(table(spark, d, "documents"), "lang", "text").withColumn("ratio", r6("ratio"))


@query(f"""with i as (select item_id, list_distinct({_W.format('prompt')}) q from eval_items where item_id % 50 = 0), d as (select doc_id, list_distinct({_W.format('text')}) w from documents),
    s as (select item_id, doc_id, len(list_intersect(w, q)) score from i cross join d) select item_id, doc_id, score::int score, rank::int rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from s where score > 0) where rank <= 5""")
def word_overlap_topk(spark, d):
    return M.word_search(table(spark, d, "eval_items").where("item_id % 50 = 0"), "item_id", "prompt", table(spark, d, "documents"), "doc_id", "text")


@query("""with s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) score from embeddings v cross join embeddings q where q.vec_id % 50 = 0)
    select query_id, vec_id, round(score, 5) score, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 10""")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return M.nearest_vectors(v, v.where("vec_id % 50 = 0")).withColumn("score", F.round("score", 5))


@query("""select doc_id, item_id from documents join eval_items on trim(answer) <> '' and contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(answer, '\\s+', ' ', 'g')))""")
def text_containment(spark, d):
    return M.holding(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "answer")


@query(f"""with d as (select item_id, {_W.format("prompt")} w from eval_items where prompt is not null), r as (select min(item_id) over (partition by w) rep, item_id, w from d), u as (select item_id, w from r where rep = item_id),
    s as (select item_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from u),
    e as (select item_id, unnest(g) g, len(g) n from s), c as (select a.item_id a, b.item_id b, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.g = b.g and a.item_id < b.item_id group by 1, 2), p as (select a, b from c where k / (na + nb - k) >= 0.25),
    l as (select a x, b y from p union all select b, a from p), m as (with recursive z as (select x, x y from l union select z.x, l.y from z join l on l.x = z.y) select x, min(y) c from z group by 1)
    select r.item_id, coalesce(m.c, r.rep) as label from r left join m on m.x = r.rep""")
def prompt_clusters(spark, d):
    return M.single_link(table(spark, d, "eval_items"), "item_id", "prompt")
