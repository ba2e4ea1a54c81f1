"""Queries of profiles, rollouts and curation over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import checks as K
from spanloom.operators import curation as Q
from spanloom.operators import profiles as P
from spanloom.operators import rollouts as R
from spanloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_KEYS = """k as (select collector, delivery_id, unnest(json_keys(attributes)) "key", attributes from traces where json_valid(attributes))"""


@query(f"""with {_KEYS}, t as (select collector, count(distinct delivery_id) t from k group by 1) select collector, "key", count(distinct delivery_id) records, round(count(distinct delivery_id) / any_value(t), 6) as share from k join t using (collector) group by 1, 2""")
def attribute_keys(spark, d):
    m = F.try_variant_get(F.try_parse_json("attributes"), "$", "map<string,variant>")
    x = table(spark, d, "traces").select("collector", "delivery_id", F.explode(F.map_keys(m)).alias("path"), F.lit("").alias("value"))
    return P.field_profile(x, "delivery_id", ["collector"]).select("collector", F.col("path").alias("key"), "records", F.round("share", 6).alias("share"))


@query(f"""with {_KEYS}, y as (select "key", case json_type(attributes, '$."' || "key" || '"') when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' when 'NULL' then null else 'number' end kind from k)
    select "key", array_to_string(list(distinct kind order by kind), ',') types from y where kind is not null group by 1 having count(distinct kind) > 1""")
def loose_types(spark, d):
    from spanloom.operators.drift import json_type

    m = F.try_variant_get(F.try_parse_json("attributes"), "$", "map<string,variant>")
    x = table(spark, d, "traces").select(F.explode(F.map_entries(m)).alias("e")).select(F.lit("traces").alias("tool"), F.col("e.key").alias("name"), json_type(F.col("e.value")).alias("kind"))
    return P.loose_types(x).select(F.col("name").alias("key"), F.array_join("types", ",").alias("types"))


@query("""with n as (select doc_kind tool, lang "value", count(*) n from documents where lang is not null group by 1, 2), g as (select tool, count(*) k, sum(n) n from n group by 1 having count(*) <= 40) select tool, array_to_string(list("value" order by "value"), ',') as "values" from n where tool in (select tool from g where n >= 5 * k) group by 1""")
def enumerated_values(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_kind").alias("tool"), F.lit("lang").alias("name"), F.col("lang").alias("value"))
    return P.enumerated_arguments(x, 5, 40).select("tool", F.array_join("values", ",").alias("values"))


@query("""with t as (select user_id, max_by(event_type, ts) last from events group by 1), n as (select last, count(*) n from t group by 1) select last text, n, round(n / (select count(*) from t), 6) rate from n where n >= greatest(3, 0.05 * (select count(*) from t))""")
def endings(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("traj"), F.col("ts").alias("pos"), F.col("event_type").alias("text"))
    return P.wrap_ups(x).select("text", "n", F.round("rate", 6).alias("rate"))


@query("""with a as (select user_id q, avg(value) v from events where event_type = 'view' group by 1), b as (select user_id q, avg(value) v from events where event_type = 'click' group by 1) select 'value' metric, count(*) questions, round(avg(a.v), 6) mean_a, round(avg(b.v), 6) mean_b, round(avg(a.v - b.v), 6) diff from a join b using (q)""")
def arms_compared(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "query_id")
    x = R.compared(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["value"])
    return x.select("metric", "questions", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff")])


@query("""with t as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) > 1 r from events) select case when r or event_type = 'error' then 'negative' when value > 100 then 'positive' else 'none' end "label", count(*) n from t group by 1""")
def step_labels(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("rollout"), F.col("event_id").alias("pos"), F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "Error").otherwise("ok").alias("observation"), (F.col("value") > 100).alias("new_evidence"))
    return K.step_labels(x).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 a, count(*) over (partition by source) n from documents where source is not null), w as (select t.*, k from t, (select unnest([1, 2]) k) where k < n)
    select w.doc_id, t.doc_id sibling from w join t on t.source = w.source and t.a = (w.a + k) % w.n""")
def siblings(spark, d):
    return Q.siblings(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id", "source")


@query("""with t as (select user_id, event_id, event_type, lead(event_type) over w nt, lead(value) over w nv, row_number() over w n from events window w as (partition by user_id order by event_id)), f as (select user_id, event_id, nv, row_number() over (partition by user_id order by event_id) rank from t where event_type = 'click' and nt = 'view') select user_id, event_id, nv, rank::int rank from f where rank <= 3""")
def calls_with_replies(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("traj"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", "assistant").when(F.col("event_type") == "view", "tool").otherwise("user").alias("role"), F.col("value").alias("text"), F.when(F.col("event_type") == "click", "c").alias("call"))
    return R.search_steps(x, 3).select(F.col("traj").alias("user_id"), F.col("pos").alias("event_id"), F.col("reply").alias("nv"), "rank")


@query("""select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'O') and l_quantity > 45""")
def large_open_lines(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000 and o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").where("l_quantity > 45").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""select n_name, l_returnflag, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2""")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    x = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return x.groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
