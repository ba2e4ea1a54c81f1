"""Span trees: classification, ancestors, cycles, steps, shapes.

Spans are rows (trace_id, span_id, parent_span_id, …). What holds along ancestor chains is computed by
pointer doubling: each round every span looks twice as far up, so a chain of length n takes log n
rounds of equi-joins and no trace is ever gathered in one task. Rounds are cut in the shared folder.

A parent that is null or not in the trace makes its span a top. Spans on a cycle, or below one, never
reach a top: they are cyclic. Repeated spans have to be resolved before (first_copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import cut

# Declared kinds, in the order in which the keys are looked at.
CONVENTIONS = (
    ("gen_ai.operation.name", {"model": "chat text_completion generate_content response", "tool": "execute_tool", "step": "invoke_agent invoke_workflow", "none": "create_agent embeddings"}),
    ("openinference.span.kind", {"model": "LLM", "tool": "TOOL", "step": "CHAIN AGENT RETRIEVER RERANKER GUARDRAIL", "none": "EMBEDDING PROMPT UNKNOWN", "excluded": "EVALUATOR"}),
    ("traceloop.span.kind", {"tool": "tool", "step": "task workflow agent"}),
    ("llm.request.type", {"model": "chat completion"}),
    ("langfuse.observation.type", {"model": "GENERATION", "tool": "TOOL", "step": "CHAIN AGENT SPAN RETRIEVER GUARDRAIL", "none": "EMBEDDING EVENT", "excluded": "EVALUATOR"}),
    ("ai.operationId", {"model": "ai.generateText.doGenerate ai.generateObject.doGenerate ai.streamText.doStream ai.streamObject.doStream", "tool": "ai.toolCall", "step": "ai.generateText ai.streamText ai.generateObject ai.streamObject", "none": "ai.embed ai.embed.doEmbed ai.embedMany ai.embedMany.doEmbed"}),
)


def classified(kinds: dict[str, Column], model: Column | None = None) -> tuple[Column, Column]:
    """(role, label) from the values under the convention keys: model, tool, step, none or excluded.

    The first key with a known value decides; an excluded value anywhere wins; a model without operation
    name whose model name holds 'embed' is none. label says which key decided, else the first declared
    unknown value, else 'no declared kind'.
    """
    role, label, unknown, excluded = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for key, roles in reversed(CONVENTIONS):
        v = kinds.get(key, F.lit(None).cast("string"))
        tag = F.concat(F.lit(f"{key}="), v)
        for r, names in roles.items():
            hit = v.isin(*names.split())
            role, label = F.when(hit, r).otherwise(role), F.when(hit, tag).otherwise(label)
            if r == "excluded":
                excluded = excluded | F.coalesce(hit, F.lit(False))
        unknown = F.coalesce(tag, unknown)
    if model is not None:
        named = kinds.get("gen_ai.operation.name", F.lit(None).cast("string")).isNotNull()
        role = F.when((role == "model") & ~named & F.lower(model).contains("embed"), "none").otherwise(role)
    return F.when(excluded, "excluded").otherwise(F.coalesce(role, F.lit("none"))), F.coalesce(label, unknown, F.lit("no declared kind"))


def first_copies(spans: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, issues): the first copy of each (trace, span), and one issue per copy dropped."""
    x = spans.withColumn("_n", F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy(*order)))
    return x.where("_n = 1").drop("_n"), x.where("_n > 1").select(F.lit("duplicate_span").alias("kind"), F.concat_ws("/", "trace_id", "span_id").alias("detail"))


def lineage(spans: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """(trace_id, span_id, root_id, depth, cyclic, one boolean per flag: whether any ancestor has it)."""
    flags = flags or {}
    s = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("_p"), *[F.coalesce(v, F.lit(False)).alias(f"_f_{k}") for k, v in flags.items()])
    here = s.select("trace_id", F.col("span_id").alias("_p"), F.lit(True).alias("_is"))
    x = s.join(here, ["trace_id", "_p"], "left").select("trace_id", "span_id", F.when(F.col("_is"), F.col("_p")).alias("up"), *[f"_f_{k}" for k in flags])
    # jump: how far up; top: the highest ancestor seen so far; any: flags of the ancestors passed
    own = x.select("trace_id", F.col("span_id").alias("up"), *[F.col(f"_f_{k}").alias(f"_u_{k}") for k in flags])
    x = x.join(own, ["trace_id", "up"], "left").select("trace_id", "span_id", "up", F.coalesce("up", "span_id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), *[F.coalesce(f"_u_{k}", F.lit(False)).alias(k) for k in flags])
    x = cut(x, "lineage")
    most = x.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not x.where("up is not null").isEmpty():
        above = x.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_d"), *[F.col(k).alias(f"_a_{k}") for k in flags])
        x = x.join(above, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), *[(F.col(k) | F.coalesce(f"_a_{k}", F.lit(False))).alias(k) for k in flags])
        x = cut(x, "lineage")
        reach *= 2
    cyclic = F.col("up").isNotNull()
    return x.select("trace_id", "span_id", F.when(~cyclic, F.col("top")).alias("root_id"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"), *flags)


def marked_upwards(spans: DataFrame, flag: Column) -> DataFrame:
    """(trace_id, span_id): spans with a flagged span beneath them. A round per level, each span marked once."""
    parents = cut(spans.select("trace_id", "span_id", "parent_span_id").where("parent_span_id is not null"), "parents")
    known = cut(spans.select("trace_id", "span_id"), "known")
    new = spans.where(flag).select("trace_id", F.col("parent_span_id").alias("span_id")).where("span_id is not null").distinct().join(known, ["trace_id", "span_id"], "left_semi")
    done = new = cut(new, "marked")
    while not new.isEmpty():
        up = new.join(parents, ["trace_id", "span_id"]).select("trace_id", F.col("parent_span_id").alias("span_id")).distinct().join(known, ["trace_id", "span_id"], "left_semi")
        new = cut(up.join(done, ["trace_id", "span_id"], "left_anti"), "marked")
        done = cut(done.unionByName(new), "marked")
    return done


def tops(spans: DataFrame) -> DataFrame:
    """Spans whose parent is absent from their trace."""
    there = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    return spans.join(there, ["trace_id", "parent_span_id"], "left_anti").select(spans.columns)


def episode_roots(spans: DataFrame, order: list[str]) -> DataFrame:
    """(trace_id, root_id): the first top of each trace."""
    return tops(spans).groupBy("trace_id").agg(F.min_by("span_id", F.struct(*order, "span_id")).alias("root_id"))


def pipeline_steps(spans: DataFrame) -> DataFrame:
    """Outermost steps with no model or tool call beneath. spans have a role."""
    acting = marked_upwards(spans, F.col("role").isin("model", "tool"))
    idle = spans.where("role = 'step'").join(acting, ["trace_id", "span_id"], "left_anti").select("trace_id", "span_id").withColumn("idle", F.lit(True))
    x = spans.join(idle, ["trace_id", "span_id"], "left").withColumn("idle", F.coalesce("idle", F.lit(False)))
    under = lineage(x, {"under": F.col("idle")}).where("not under and not cyclic").select("trace_id", "span_id")
    return x.where("idle").join(under, ["trace_id", "span_id"], "left_semi").drop("idle")


def bucketed(spans: DataFrame) -> DataFrame:
    """Each span with exactly one bucket: cyclic, model, tool, excluded, pipeline_step, covered, container, root_step, unrepresented."""
    line = lineage(spans, {"out": F.col("role") == "excluded"})
    steps = pipeline_steps(spans).select("trace_id", "span_id").withColumn("is_step", F.lit(True))
    acting = marked_upwards(spans, F.col("role").isin("model", "tool")).withColumn("acts", F.lit(True))
    x = spans.join(line, ["trace_id", "span_id"]).join(steps, ["trace_id", "span_id"], "left").join(acting, ["trace_id", "span_id"], "left")
    covered = lineage(x.select(*spans.columns, "is_step"), {"inside": F.col("is_step")}).select("trace_id", "span_id", "inside")
    x = x.join(covered, ["trace_id", "span_id"])
    bucket = (
        F.when(F.col("cyclic"), "cyclic").when(F.col("out") | (F.col("role") == "excluded"), "excluded").when(F.col("role").isin("model", "tool"), F.col("role")).when(F.col("is_step"), "pipeline_step")
        .when(F.col("inside"), "covered").when((F.col("role") == "step") & F.col("acts"), "container").when((F.col("role") == "step") & (F.col("depth") == 0), "root_step").otherwise("unrepresented")
    )
    return x.withColumn("bucket", bucket).select(*spans.columns, "root_id", "depth", "bucket")


def shapes(spans: DataFrame, name: Column) -> DataFrame:
    """(trace_id, shape_id): a digest of the tree of names that ignores order and repeats.

    Bottom up, one level a round; a parent holds the distinct digests of its children, of which there are as
    many as there are different subtrees.
    """
    x = spans.join(lineage(spans).where("not cyclic").select("trace_id", "span_id", "depth"), ["trace_id", "span_id"])
    x = cut(x.select("trace_id", "span_id", "depth", F.when(F.col("depth") > 0, F.col("parent_span_id")).alias("up"), F.coalesce(name, F.lit("")).alias("name")), "shapes")
    deepest = x.agg(F.max("depth")).first()[0]
    if deepest is None:
        return x.select("trace_id", F.lit("").alias("shape_id"))
    kids = None
    for d in range(deepest, -1, -1):
        level = x.where(F.col("depth") == d)
        level = level.withColumn("_kids", F.array().cast("array<string>")) if kids is None else level.join(kids, ["trace_id", "span_id"], "left").withColumn("_kids", F.coalesce("_kids", F.array().cast("array<string>")))
        level = level.withColumn("digest", F.sha2(F.concat(F.col("name"), F.lit("("), F.array_join("_kids", ","), F.lit(")")), 256))
        group = ["trace_id", "up"] if d else ["trace_id"]
        kids = cut(level.groupBy(*group).agg(F.sort_array(F.collect_set("digest")).alias("_kids")), "level")
        if d:
            kids = kids.withColumnRenamed("up", "span_id")
    return kids.select("trace_id", F.substring(F.sha2(F.array_join("_kids", ","), 256), 1, 16).alias("shape_id"))


def shape_stats(spans: DataFrame, name: Column) -> DataFrame:
    """(shape_id, traces, example), most frequent first."""
    return shapes(spans, name).groupBy("shape_id").agg(F.count(F.lit(1)).alias("traces"), F.min("trace_id").alias("example")).orderBy(F.desc("traces"), "shape_id")


def collapsed_wrappers(spans: DataFrame, gap_us: int = 50_000, share: float = 0.05) -> DataFrame:
    """spans without model spans whose only child is a model span of the same model and status that starts and
    ends within min(gap, share of the duration). The child takes the place of its wrapper. spans have role, model, status, start_us, end_us.
    """
    kids = spans.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("role", "model", "status", "start_us", "end_us")).alias("k"), F.min(F.col("span_id")).alias("kid"))
    kids = kids.where("span_id is not null and n = 1")
    x = spans.join(kids, ["trace_id", "span_id"])
    near = F.least(F.lit(gap_us), ((F.col("end_us") - F.col("start_us")) * share).cast("bigint"))
    twin = (F.col("role") == "model") & (F.col("k.role") == "model") & F.col("model").eqNullSafe(F.col("k.model")) & F.col("status").eqNullSafe(F.col("k.status")) & (F.abs(F.col("k.start_us") - F.col("start_us")) <= near) & (F.abs(F.col("end_us") - F.col("k.end_us")) <= near)
    gone = cut(x.where(twin).select("trace_id", "span_id", "parent_span_id"), "wrappers")
    # a child of wrappers in a row climbs past all of them
    up = lineage_past(gone)
    y = spans.join(gone.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")
    y = y.join(up.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("to").alias("_to"), F.lit(True).alias("_moved")), ["trace_id", "parent_span_id"], "left")
    return y.withColumn("parent_span_id", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("parent_span_id"))).select(spans.columns)


def lineage_past(gone: DataFrame) -> DataFrame:
    """(trace_id, span_id, to): the first ancestor above a run of dropped spans."""
    x = gone.select("trace_id", "span_id", F.col("parent_span_id").alias("to"))
    for _ in range(64):  # doubling: longer runs than 2 to the 64 don't exist, circles end here
        above = x.select("trace_id", F.col("span_id").alias("to"), F.col("to").alias("_to"))
        y = x.join(above, ["trace_id", "to"], "left").select("trace_id", "span_id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("_more"))
        y = cut(y, "past")
        if y.where("_more").isEmpty():
            break
        x = y.drop("_more")
    return y.drop("_more")


def invocation_candidates(spans: DataFrame, order: list[str]) -> DataFrame:
    """(trace_id, span_id, rank): outermost spans once containers are looked through, first started first.

    spans have role and container. Containers, model and tool calls and excluded spans are none; nor is a span below
    one that is no container, or on a circle.
    """
    line = lineage(spans, {"under": ~F.coalesce("container", F.lit(False))}).where("not under and not cyclic").select("trace_id", "span_id")
    x = spans.where("not coalesce(container, false) and role not in ('model', 'tool', 'excluded')").join(line, ["trace_id", "span_id"], "left_semi")
    return x.select("trace_id", "span_id", F.row_number().over(W.partitionBy("trace_id").orderBy(*order, "span_id")).alias("rank"))
