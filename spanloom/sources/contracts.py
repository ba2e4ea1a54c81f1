"""What a session transcript and its events must have, as validation columns; and the archive of redacted sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.redaction import RULES, Rule, redact

# Versions and the fields each requires as text.
REQUIRED = {"1": ("session_id", "agent_id", "environment", "started_at"), "2": ("assignment_id", "session_id", "session_revision_id", "agent_id", "environment", "started_at", "ended_at")}


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("NONE"))


def envelope_problems(record: Column) -> Column:
    """The problems of a transcript (JSON text) in the order in which they are looked for; empty if it's sound."""
    v = F.try_parse_json(record)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    version = F.when(_kind(get("schema_version")) == "STRING", text("schema_version"))
    out = [F.when(v.isNull(), "not readable"), F.when(v.isNotNull() & ~F.coalesce(version.isin(*REQUIRED), F.lit(False)), "schema_version is not one of 1, 2")]
    for known, fields in REQUIRED.items():
        out += [F.when((version == known) & (_kind(get(k)) != "STRING"), f"{k} must be a string") for k in fields]
    ended = F.try_to_timestamp(text("ended_at"))
    events, n = get("events"), F.try_variant_get(v, "$.event_count", "bigint")
    out += [
        F.when(version.isNotNull() & (_kind(get("started_at")) == "STRING") & F.try_to_timestamp(text("started_at")).isNull(), "started_at is not a time"),
        F.when((version == "1") & ~_kind(get("ended_at")).isin("NONE", "VOID") & ended.isNull(), "ended_at is neither a time nor null"),
        F.when((_kind(events) != "ARRAY") & ~((version == "1") & (_kind(events) == "NONE")), "events must be a list"),
        F.when((version == "2") & (~F.coalesce(_kind(get("event_count")) == "BIGINT", F.lit(False)) | (n < 0)), "event_count must be a whole number"),
        F.when((version == "2") & (_kind(events) == "ARRAY") & (n >= 0) & (n != F.size(F.try_variant_get(events, "$", "array<variant>"))), "event_count is not the number of events"),
    ]
    return F.array_compact(F.array(*out))


def event_problems(event: Column, version: Column) -> Column:
    """The problems of one event (JSON text) of a transcript of that version; empty if it's sound. An absent payload is an empty one in version 1."""
    v = F.try_parse_json(event)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    id_kind, payload = _kind(get("id")), _kind(get("payload"))
    whole = (id_kind == "BIGINT") | ((id_kind == "STRING") & text("id").rlike(r"^\s*[+-]?\d+\s*$"))
    broken = F.array(F.lit("not an event object"))
    out = F.array_compact(
        F.array(
            F.when((version == "1") & ~whole, "id must be an integer").when((version != "1") & (id_kind != "STRING"), "id must be a string"),
            F.when((_kind(get("ts")) != "STRING") | F.try_to_timestamp(text("ts")).isNull(), "ts must be a time"),
            F.when(_kind(get("event_type")) != "STRING", "event_type must be a string"),
            F.when((payload != "OBJECT") & ~((version == "1") & (payload == "NONE")), F.when(payload == "VOID", "payload must be an object (it is null)").otherwise("payload must be an object")),
        )
    )
    return F.when(F.coalesce(_kind(v) == "OBJECT", F.lit(False)), out).otherwise(broken)


def archived(records: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(source, manifest): the redacted records (file, pos, record), and per file what was there before and after.

    manifest: (file, records, redactions, original, redacted), the last two digests that don't depend on how the file's
    records are spread: sums of four hashes of place and text, so a large file isn't gathered.
    """
    keyed = records.withColumn("_id", F.struct("file", "pos", F.col("record").alias("_was")))
    r = redact(keyed.select(F.to_json("_id").alias("_id"), "record"), "_id", "record", rules).withColumn("_id", F.from_json("_id", "struct<file: string, pos: bigint, _was: string>"))
    x = r.select("_id.file", "_id.pos", "record", F.col("_id._was").alias("_was"), F.size("kinds").alias("_n"))
    sums = lambda c: [F.sum(F.xxhash64(F.lit(i), "pos", F.coalesce(c, F.lit(""))).cast("decimal(38,0)")).cast("string") for i in range(4)]
    digest = lambda c: F.sha2(F.concat_ws(",", *sums(c)), 256)
    manifest = x.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum("_n").alias("redactions"), digest("_was").alias("original"), digest("record").alias("redacted"))
    return x.select("file", "pos", "record"), manifest
