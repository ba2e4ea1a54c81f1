"""Mixing sources to target shares of tokens by hash-threshold histograms.

Tokens are counted once per document with a public tokenizer and written, with a hash of doc_id, as a
narrow table. For each source the tokens are summed by the top BITS of the hash; on those histograms
(bounded by sources times 2**BITS) the driver finds the threshold under which a source's tokens make
up its budget. Only the bucket that the threshold falls into is summed again by the next BITS, until
the budget is met to the document or the hash is used up. The draw is then a filter on the hash:
nothing is sorted and no document is moved. Thresholds of different mixes cut the same order, so a
smaller budget's draw is always contained in a larger one's.

The total of a mix is the largest at which every source keeps its exact share within its limit of
repeats; it can be lowered by a parameter. A budget beyond a source's tokens is met by whole rounds
and a threshold for the rest: a document below it appears once more than one above.

Sources are compared in lower case, trimmed, with _ for - and blanks. Documents without source or
text, or with a null doc_id, take part in no mix; an empty text has no tokens and is drawn like any
other. A source without tokens but with a target makes the mix empty, with shares 0. Empty tables
give no rows. Documents with the same hash are drawn together, so shares are met to one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

BITS, LEVELS = 12, 5  # 60 bits of the hash
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("spanloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(col: str | Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(F.col(col) if isinstance(col, str) else col)), r"[-\s]+", "_")
    return F.nullif(c, F.lit(""))


def counted(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, h): h is 60 bits of a hash of doc_id, uniform whatever the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    x = documents.select("doc_id", source_name("source").alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    x = x.mapInArrow(run, "doc_id bigint, source string, tokens bigint")
    return x.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS))


def threshold(docs: DataFrame, budgets: dict[tuple[str, str], tuple[str, int]]) -> dict[tuple[str, str], int]:
    """For each (mix, source) the hash below which the source's tokens come nearest to the budget.

    budgets: (mix, source) -> (source, tokens). All budgets are refined together, a level at a time.
    """
    low = dict.fromkeys(budgets, 0)  # all hashes below are in
    left = {k: n for k, (_, n) in budgets.items()}
    spark = docs.sparkSession
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        wanted = sorted({(budgets[k][0], low[k] >> (shift + BITS)) for k in budgets if left[k] > 0})
        if not wanted:
            break
        # one row per source and boundary bucket of the level before: at most one per budget
        inside = spark.createDataFrame(wanted, "source string, above bigint")
        x = docs.withColumn("above", F.shiftright("h", shift + BITS)).join(F.broadcast(inside), ["source", "above"])
        rows = x.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens")).collect()
        sums: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in rows:
            sums.setdefault((r["source"], r["bucket"] >> BITS), []).append((r["bucket"], r["tokens"]))
        for k in budgets:
            if left[k] <= 0:
                continue
            here = sorted(sums.get((budgets[k][0], low[k] >> (shift + BITS)), []))
            at = (low[k] >> shift) + (1 << BITS)  # past the last bucket if all of it is in
            for bucket, n in here:
                if n > left[k]:
                    at = bucket
                    break
                left[k] -= n
            else:
                left[k] = 0
            low[k] = at << shift
            if level == LEVELS - 1 and left[k] > 0:
                # one hash is left: in if that comes nearer to the budget
                n = next((n for b, n in here if b == at), 0)
                low[k] += int(2 * left[k] >= n)
    return low


def plan(docs: DataFrame, targets: DataFrame, total_tokens: dict[str, int] | None = None) -> list[dict]:
    """Per mix and source: available tokens, budget, whole rounds and the threshold for one round more."""
    have = {r["source"]: (r["tokens"], r["docs"]) for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).join(F.broadcast(targets.select(source_name("source").alias("source")).distinct()), "source").collect()}
    want = [r.asDict() for r in targets.where("mix_name is not null and source is not null").withColumn("source", source_name("source")).collect()]
    out, budgets = [], {}
    for mix in sorted({w["mix_name"] for w in want}):
        rows = [w for w in want if w["mix_name"] == mix and (w["target_share"] or 0) > 0]
        size = min((have.get(w["source"], (0, 0))[0] * (w["max_repeats"] or 0) / w["target_share"] for w in rows), default=0)
        size = min(size, (total_tokens or {}).get(mix, size))
        for w in rows:
            tokens, docs_n = have.get(w["source"], (0, 0))
            budget = round(size * w["target_share"])
            rounds = min(w["max_repeats"], budget // tokens) if tokens else 0
            rest = budget - rounds * tokens if tokens and rounds < w["max_repeats"] else 0
            out.append(w | {"tokens_available": tokens, "docs_available": docs_n, "budget": budget, "rounds": int(rounds)})
            budgets[(mix, w["source"])] = (w["source"], int(rest))
    cuts = threshold(docs, budgets)
    return [w | {"below": cuts[(w["mix_name"], w["source"])]} for w in out]


SCHEMA = "mix_name string, source string, target_share double, max_repeats int, tokens_available bigint, docs_available bigint, budget bigint, rounds int, below bigint"


def draw(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: mix_name, doc_id, source, tokens, copies. report: shares beside their targets."""
    spark = documents.sparkSession
    docs = cut(counted(documents, tokenizer), "tokens")
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [tuple(w[f] for f in fields) for w in plan(docs, targets, total_tokens)]
    cuts = spark.createDataFrame(rows, SCHEMA)  # as many rows as mix_targets
    drawn = docs.join(F.broadcast(cuts), "source").withColumn("copies", F.col("rounds") + (F.col("h") < F.col("below")).cast("int")).where("copies > 0")
    sums = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.count(F.lit(1)).alias("docs_drawn"), F.max("copies").alias("repeats"))
    whole = sums.groupBy("mix_name").agg(F.sum("tokens_drawn").alias("tokens_mix"))
    report = cuts.join(sums, ["mix_name", "source"], "left").join(whole, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.coalesce(F.col("tokens_drawn") / F.col("tokens_mix"), F.lit(0.0)).alias("actual_share"), "max_repeats", F.coalesce("repeats", F.lit(0)).alias("repeats"),
        "tokens_available", F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), "docs_available", F.coalesce("docs_drawn", F.lit(0)).alias("docs_drawn"),
    )
    return drawn.select("mix_name", "doc_id", "source", "tokens", "copies"), report
