"""A folder of exports to a corpus: spans in buckets, issues, accounting and health.

Reading and decoding are narrow; the spans are shuffled by trace once, for first copies, and tree work
builds on that partitioning. Every span read ends in exactly one bucket: accounted() proves it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import trees
from spanloom.session import cut
from spanloom.sources import records as R
from spanloom.sources import spans as S


@dataclass
class Corpus:
    spans: DataFrame  # each with its bucket
    issues: DataFrame  # (kind, detail)
    read: DataFrame  # (spans): how many were read


def load_corpus(spark: SparkSession, path: str, source: str = "auto") -> Corpus:
    """Read everything below path. auto: each file by its own structure; files of no known source are issues."""
    rec = cut(R.read_records(spark, path), "records")
    bad = rec.where("issue is not null").select(F.regexp_extract("issue", "^([^:]*)", 1).alias("kind"), F.concat_ws(" ", "file", "issue").alias("detail"))
    if source == "auto":
        found = R.detected(rec)
        names = [r["source"] for r in found.select("source").distinct().collect()]
        unknown = found.where("source is null").select(F.lit("unknown_source").alias("kind"), F.col("file").alias("detail"))
        parts = [S.load(rec.join(found.where(F.col("source") == n).select("file"), "file", "left_semi"), n) for n in names if n in S.READERS]
        other = found.where(~F.coalesce(F.col("source"), F.lit("otlp")).isin(*S.READERS)).select(F.lit("no_spans_in_source").alias("kind"), F.concat_ws(" ", "file", "source").alias("detail"))
        bad = bad.unionByName(unknown).unionByName(other)
    else:
        parts = [S.load(rec, source)]
    if not parts:
        empty = spark.createDataFrame([], S.DECODED + ", root_id string, depth int, bucket string")
        return Corpus(empty, bad, spark.createDataFrame([(0,)], "spans bigint"))
    decoded = parts[0]
    for p in parts[1:]:
        decoded = decoded.unionByName(p)
    decoded = cut(decoded, "decoded")
    named = decoded.where("trace_id is not null and span_id is not null")
    kept, copies = trees.first_copies(named, ["file", "pos", "idx"])
    kept = cut(kept, "kept")
    bucketed = trees.bucketed(kept)
    lost = decoded.where("trace_id is null or span_id is null").withColumns({"root_id": F.lit(None).cast("string"), "depth": F.lit(None).cast("int"), "bucket": F.lit("malformed")})
    more = named.join(kept.select("file", "pos", "idx"), ["file", "pos", "idx"], "left_anti").withColumns({"root_id": F.lit(None).cast("string"), "depth": F.lit(None).cast("int"), "bucket": F.lit("duplicate")})
    cols = bucketed.columns
    spans = cut(bucketed.unionByName(lost.select(*cols)).unionByName(more.select(*cols)), "spans")
    cyclic = spans.where("bucket = 'cyclic'").select(F.lit("cyclic_span").alias("kind"), F.concat_ws("/", "trace_id", "span_id").alias("detail"))
    issues = bad.unionByName(S.issues(decoded)).unionByName(copies).unionByName(cyclic)
    return Corpus(spans, issues, decoded.agg(F.count(F.lit(1)).alias("spans")))


def report(corpus: Corpus) -> DataFrame:
    """(bucket, n); partial counts combine, so reports of parts add up to the report of the whole."""
    return corpus.spans.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def accounted(corpus: Corpus) -> bool:
    """Whether the buckets hold every span that was read, once."""
    n = report(corpus).agg(F.sum("n").alias("n")).first()["n"] or 0
    return n == corpus.read.first()["spans"]


def issue_counts(corpus: Corpus, examples: int = 3) -> DataFrame:
    """(kind, n, examples): one row a kind, with its first details."""
    from pyspark.sql import Window as W

    x = corpus.issues.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("detail")))
    few = x.where(F.col("_n") <= examples).groupBy("kind").agg(F.sort_array(F.collect_list("detail")).alias("examples"))
    return corpus.issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(few, "kind")


def health(spans: DataFrame) -> DataFrame:
    """(level, rule, n): fatal and warning rules over model and tool calls. No row means healthy."""
    m, t = F.col("role") == "model", F.col("role") == "tool"
    at = lambda k: F.get_json_object("attributes", f"$['{k}']")
    given = F.coalesce(*[at(k) for k in ("input.value", "gen_ai.input.messages", "gen_ai.prompt", "gen_ai.prompt.0.content", "llm.input_messages.0.message.content")])
    gave = F.coalesce(*[at(k) for k in ("output.value", "gen_ai.output.messages", "gen_ai.completion", "gen_ai.completion.0.content", "llm.output_messages.0.message.content")])
    g = spans.agg(F.count(F.when(m | t, 1)).alias("calls"), F.count(F.when(m, 1)).alias("models"), F.count(F.when(m & given.isNull(), 1)).alias("no_input"), F.count(F.when(m & gave.isNull(), 1)).alias("no_output"), F.count(F.when(t & F.coalesce(at("gen_ai.tool.call.result"), at("output.value")).isNull(), 1)).alias("no_result"), F.count(F.when(F.col("end_ns").isNull(), 1)).alias("no_end"))
    rules = F.array(
        F.when(F.col("calls") == 0, F.struct(F.lit("fatal").alias("level"), F.lit("no_calls").alias("rule"), F.lit(0).cast("bigint").alias("n"))),
        F.when((F.col("models") > 0) & (F.col("no_input") == F.col("models")), F.struct(F.lit("fatal").alias("level"), F.lit("no_model_has_input").alias("rule"), F.col("no_input").alias("n"))),
        F.when((F.col("no_input") > 0) & (F.col("no_input") < F.col("models")), F.struct(F.lit("warning").alias("level"), F.lit("model_without_input").alias("rule"), F.col("no_input").alias("n"))),
        F.when(F.col("no_output") > 0, F.struct(F.lit("warning").alias("level"), F.lit("model_without_output").alias("rule"), F.col("no_output").alias("n"))),
        F.when(F.col("no_result") > 0, F.struct(F.lit("warning").alias("level"), F.lit("tool_without_result").alias("rule"), F.col("no_result").alias("n"))),
        F.when(F.col("no_end") > 0, F.struct(F.lit("warning").alias("level"), F.lit("span_without_end").alias("rule"), F.col("no_end").alias("n"))),
    )
    return g.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")
