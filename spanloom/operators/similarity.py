"""Similarity of texts and vectors: exact set-similarity joins, n-gram statistics, searches.

Exact copies are first put together by a hash of their words, so a text that is a third of the corpus
is one representative. Distinct texts are joined exactly by prefix filtering: of each set only the
rarest shingles are compared, few enough that no pair above the threshold is missed, and every
candidate pair is verified on the whole sets. null texts take part in nothing; texts without words
are copies of each other; shorter texts than a shingle are one shingle. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import collapse, shingles, words
from spanloom.operators.graphs import components
from spanloom.session import cut

N, LEAST = 5, 0.8


def representatives(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rep): the smallest key with the same words in the same order."""
    x = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.sha2(F.array_join(words(text), " "), 256).alias("_d"))
    return x.join(x.groupBy("_d").agg(F.min(key).alias("rep")), "_d").select(key, "rep")


def sets(docs: DataFrame, key: str, text: str, n: int = N) -> DataFrame:
    """(id, grams, size): distinct shingles as 64-bit hashes."""
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), words(text).alias("__w"))
    x = x.select("id", F.transform(shingles("__w", n), lambda s: F.xxhash64(s)).alias("grams"))
    return x.withColumn("size", F.size("grams"))


def grams_of(docs: DataFrame, text: str, n: int, *keep: str) -> DataFrame:
    """(keep, gram): the distinct n-grams of each text, one a row; shorter texts have none."""
    return docs.select(*keep, words(text).alias("__w")).where(F.size("__w") >= n).select(*keep, F.explode(shingles("__w", n, "none")).alias("gram"))


def similar_pairs(s: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) of all pairs of sets with Jaccard similarity of at least least; a < b."""
    s = cut(s, "sets")  # read three times
    each = s.select("id", "size", F.explode("grams").alias("g"))
    common = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # the prefix: enough of the rarest shingles that two similar sets must share one of them
    ranked = each.join(common, "g").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("r"))
    prefix = ranked.select("id", "size", F.posexplode(F.slice("r", F.lit(1), F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + 1)).alias("pos", "p")).where("p.df > 1").select("id", "size", "pos", F.col("p.g").alias("g"))
    # sizes of similar sets are in the same or neighbouring bands, so a hot shingle is split by size before it is joined
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / least))).cast("int") if least < 1 else F.col("size")
    a = prefix.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa"), "g", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = prefix.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"), "g", band.alias("band"))
    # what can still be shared from here on must be enough
    enough = f"1 + least(sa - pa - 1, sb - pb - 1) + least(pa, pb) >= {least / (1 + least)} * (sa + sb) - 1e-9"
    pairs = a.join(b, ["g", "band"]).where(f"a < b and least(sa, sb) >= {least} * greatest(sa, sb) - 1e-9 and {enough}").select("a", "b").distinct()
    x = pairs.join(s.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(s.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return x.select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, least: float = LEAST) -> DataFrame:
    """(key, class_id, copies, links): per document its class, how many exact copies its text has, and how many
    other texts are similar to it. class_id is the smallest representative of the class.
    """
    reps = cut(representatives(docs, key, text), "reps")
    distinct = docs.join(reps.where(F.col(key) == F.col("rep")).select(key), key, "left_semi")
    pairs = cut(similar_pairs(sets(distinct, key, text, n), least).where("a <> b"), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = components(pairs).select(F.col("node").alias("rep"), "component")
    copies = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    x = reps.join(copies, "rep").join(degree, "rep", "left").join(classes, "rep", "left")
    return x.select(key, F.coalesce("component", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def first_of_class(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no earlier similar one precedes, kept or not. On chains that's fewer than greedy_kept()."""
    reps = representatives(docs, key, text).where(F.col(key) == F.col("rep"))
    distinct = docs.join(reps.select(key), key, "left_semi")
    later = similar_pairs(sets(distinct, key, text)).select(F.col("b").alias(key)).distinct()
    return distinct.join(later, key, "left_anti")


def greedy_kept(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: str | None = None, n: int = N, least: float = LEAST) -> DataFrame:
    """The documents that are similar to none kept before them, in the order of key (greedy dropping); the first of copies.

    bucket: a column, such as an action signature; only documents of the same bucket are compared, null being one.
    Each round keeps what has no open earlier similar one and drops what is similar to those; the first open
    document is settled in every round, so it ends, at the latest after half as many rounds as the longest chain has links.
    """
    x = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    b = F.lit(None).cast("string") if bucket is None else F.col(bucket)
    same = x.groupBy(b.alias("_b"), F.sha2(F.array_join(words(text), " "), 256).alias("_d")).agg(F.min(key).alias(key))
    distinct = x.join(same.select(key), key, "left_semi")
    s = sets(distinct, key, text, n)
    if bucket is not None:  # shingles of different buckets are different
        s = s.join(distinct.select(F.col(key).alias("id"), b.alias("_b")), "id").select("id", F.transform("grams", lambda g: F.xxhash64(F.struct("_b"), g)).alias("grams"), "size")
    links = cut(similar_pairs(s, least).select("a", "b"), "links")
    dropped = links.select(F.col("b").alias(key)).limit(0)
    while not links.isEmpty():
        kept = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti")
        gone = cut(links.join(kept, "a", "left_semi").select(F.col("b").alias(key)).distinct(), "gone")
        dropped = cut(dropped.unionByName(gone), "dropped")
        links = links.join(gone.select(F.col(key).alias("b")), "b", "left_anti").join(gone.select(F.col(key).alias("a")), "a", "left_anti")
        links = cut(links.select("a", "b"), "links")
    return distinct.join(dropped, key, "left_anti")


def _shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, other, na, nb, common): pairs of sets() of a and b with a common shingle."""
    x, y = a.select("id", F.col("size").alias("na"), F.explode("grams").alias("g")), b.select(F.col("id").alias("other"), F.col("size").alias("nb"), F.explode("grams").alias("g"))
    return x.join(y, "g").groupBy("id", "other", "na", "nb").agg(F.count(F.lit(1)).alias("common"))


def nearest_texts(docs: DataFrame, seeds: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, nearest, of_seed, similarity): of each text the most similar other text or seed by Jaccard.

    Of equals texts come before seeds, smaller keys first. If nothing has a common shingle, nearest is null and
    similarity 0. seeds has key and text as docs does; every pair with a common shingle is compared.
    """
    own, other = sets(docs, key, text, n), sets(seeds, key, text, n)
    pairs = _shared(own, own).where("id <> other").withColumn("of_seed", F.lit(False)).unionByName(_shared(own, other).withColumn("of_seed", F.lit(True)))
    by = F.struct((F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"), F.struct("of_seed", "other").alias("what"))
    best = pairs.select("id", by.alias("p")).groupBy("id").agg(F.max("p.similarity").alias("similarity"), F.min_by("p.what", F.struct(-F.col("p.similarity"), F.col("p.what"))).alias("what"))
    return own.select("id").join(best, "id", "left").select(F.col("id").alias(key), F.col("what.other").alias("nearest"), "what.of_seed", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def seed_containment(docs: DataFrame, seeds: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, largest, others): the largest share of a text's shingles that one seed has, and the mean share that each other text has.

    0 without seeds or shingles; others is null if there is only one text.
    """
    own = sets(docs, key, text, n)
    share = F.col("common") / F.col("na")
    near = _shared(own, sets(seeds, key, text, n)).groupBy("id").agg(F.max(share).alias("largest"))
    pair = _shared(own, own).where("id <> other").groupBy("id").agg(F.sum(share).alias("_sum"))
    total = own.agg(F.count(F.lit(1)).alias("_n"))
    x = own.select("id").join(near, "id", "left").join(pair, "id", "left").crossJoin(F.broadcast(total))
    return x.select(F.col("id").alias(key), F.coalesce("largest", F.lit(0.0)).alias("largest"), F.when(F.col("_n") > 1, F.coalesce("_sum", F.lit(0.0)) / (F.col("_n") - 1)).alias("others"))


def document_frequency(docs: DataFrame, key: str, text: str, n: int, least: int = 3, share: float = 0.05) -> DataFrame:
    """(gram, docs): n-grams in at least max(least, share of all) documents (boilerplate)."""
    total = docs.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("_t"))
    g = grams_of(docs, text, n).groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    return g.crossJoin(F.broadcast(total)).where(F.col("docs") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_t"))).select("gram", "docs")


def containing(docs: DataFrame, key: str, text: str, held: DataFrame, held_text: str, n: int = 8) -> DataFrame:
    """(key): documents that share an n-gram with any held-out text. Shorter texts have no n-gram."""
    grams = grams_of(held, held_text, n).distinct()
    return grams_of(docs, text, n, key).join(grams, "gram", "left_semi").select(key).distinct()


def copied(docs: DataFrame, key: str, text: str, held: DataFrame, held_key: str, held_text: str, n: int = 8, least: float = 0.5) -> DataFrame:
    """(key, held_key, share): overlap of at least least of the smaller n-gram set, boilerplate taken off."""
    own = grams_of(docs, text, n, key)
    boiler = document_frequency(docs, key, text, n).select("gram")
    own = own.join(boiler, "gram", "left_anti")
    other = grams_of(held, held_text, n, held_key).join(boiler, "gram", "left_anti")
    a, b = own.groupBy(key).agg(F.count(F.lit(1)).alias("na")), other.groupBy(held_key).agg(F.count(F.lit(1)).alias("nb"))
    both = own.join(other, "gram").groupBy(key, held_key).agg(F.count(F.lit(1)).alias("n")).join(a, key).join(b, held_key)
    return both.withColumn("share", F.col("n") / F.least("na", "nb")).where(F.col("share") >= least).select(key, held_key, "share")


def holding(docs: DataFrame, key: str, text: str, values: DataFrame, value_key: str, value: str) -> DataFrame:
    """(key, value_key): texts that hold a value letter for letter, blanks collapsed on both sides; empty values are in none.

    An equi-join on something both must have, then the test itself. A value of three or more words has a word with
    blanks on both sides, which the text must have as a word too: the longest of them. Shorter values are looked up
    among the text's stretches of their length; only lengths that occur are cut (they are those of one or two words).
    """
    v = values.select(value_key, collapse(value).alias("_v")).where("_v <> ''").withColumn("_words", F.split("_v", " "))
    t = docs.select(key, collapse(text).alias("_t")).where("_t <> ''")
    inner = F.slice("_words", F.lit(2), F.size("_words") - 2)
    long = v.where(F.size("_words") > 2).withColumn("_anchor", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    met = t.withColumn("_anchor", F.explode(F.array_distinct(F.split("_t", " ")))).join(long.select(value_key, "_v", "_anchor"), "_anchor").where(F.col("_t").contains(F.col("_v"))).select(key, value_key)
    short = v.where(F.size("_words") <= 2).select(value_key, "_v", F.length("_v").alias("_n"))
    # the lengths ride along as one list; a value of two words is seldom longer than a line
    of = short.agg(F.sort_array(F.collect_set("_n")).alias("_all")).first()["_all"]
    stretches = t.select(key, "_t", F.explode(F.array(*[F.lit(n) for n in of]) if of else F.array().cast("array<int>")).alias("_n"))
    stretches = stretches.where(F.length("_t") >= F.col("_n")).select(key, "_n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1), lambda i: F.substring(F.col("_t"), i, F.col("_n"))))).alias("_v"))
    return met.unionByName(stretches.join(short, ["_n", "_v"]).select(key, value_key)).distinct()


def diversity(docs: DataFrame, by: str, text: str, n: int = 3) -> DataFrame:
    """(by, grams, distinct_grams, ratio): how many of a group's n-grams (each once per document) are different."""
    g = grams_of(docs, text, n, by).groupBy(by, "gram").agg(F.count(F.lit(1)).alias("n"))
    x = g.groupBy(by).agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("distinct_grams"))
    return x.withColumn("ratio", F.col("distinct_grams") / F.col("grams"))


def per_seed(docs: DataFrame, seed: str) -> DataFrame:
    """(least, most): the fewest and most rows of a seed, null being one; 0 without rows."""
    n = docs.groupBy(seed).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def single_link(texts: DataFrame, key: str, text: str, n: int = 5, least: float = 0.25) -> DataFrame:
    """(key, label): clusters of single-link similarity; the label is the smallest key."""
    reps = cut(representatives(texts, key, text), "reps")
    distinct = texts.join(reps.where(F.col(key) == F.col("rep")).select(key), key, "left_semi")
    c = components(similar_pairs(sets(distinct, key, text, n), least)).select(F.col("node").alias("rep"), "component")
    return reps.join(c, "rep", "left").select(key, F.coalesce("component", "rep").alias("label"))


def word_search(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(query_key, key, score, rank): documents by the number of different words shared; ties by key.

    queries are a stated, bounded set: it is checked and sent to every task in blocks.
    """
    q = [(r[0], r[1]) for r in queries.select(query_key, words(query_text)).toLocalIterator()]
    out = None
    for at in range(0, max(1, len(q)), 2000):
        block = docs.sparkSession.createDataFrame(q[at : at + 2000], f"{query_key} {queries.schema[query_key].dataType.simpleString()}, _q array<string>")
        x = docs.where(F.col(text).isNotNull()).select(key, F.array_distinct(words(text)).alias("_w")).crossJoin(F.broadcast(block))
        x = x.select(query_key, key, F.size(F.array_intersect("_w", "_q")).alias("score")).where("score > 0")
        x = x.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
        out = x if out is None else out.unionByName(x)
    return out


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, key, score, rank): exact cosine top k of a stated query set against all rows; ties by key.

    The queries are sent in blocks of block; each Arrow batch is one matrix product and keeps its best k per
    query, so what is shuffled is k rows per query and batch. Vectors of length 0 or another width score 0.
    """
    q = [(r[0], r[1]) for r in queries.select(key, vector).toLocalIterator()]
    out = None
    for at in range(0, max(1, len(q)), block):
        part = q[at : at + block]
        ids = np.array([i for i, _ in part], np.int64)
        width = len(part[0][1]) if part else 0
        mat = np.array([v for _, v in part], np.float64).reshape(len(part), width)
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            ids, mat = shared.value
            for b in batches:
                fits = pc.equal(pc.fill_null(pc.list_value_length(b.column(1)), -1), width)
                keys = np.asarray(b.column(0).filter(fits)).astype(np.int64)
                if not len(keys) or not len(ids):
                    continue
                flat = pc.fill_null(b.column(1).filter(fits).flatten().cast(pa.float64()), 0.0)
                x = np.asarray(flat).reshape(len(keys), width)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                s = np.round(mat @ x.T, 9)
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k] if s.shape[1] > k else np.argsort(-s, axis=1, kind="stable")
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query_id", key, "score"])

        x = vectors.select(key, vector).mapInArrow(run, f"query_id bigint, {key} bigint, score double")
        x = x.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
        out = x if out is None else out.unionByName(x)
    return out
