"""Defective prompt and response pairs by noisy labelling functions and an EM label model.

For each defect several labelling functions vote 1 (defective), -1 (sound) or 0 (abstain). All of
them are built-in expressions. How often each combination of votes occurs is counted over every pair
(a map-side combine; the result is bounded by the number of combinations). On those counts the driver
fits, per defect, a two-class model in which the functions are independent given the class, by
expectation maximization from a stated start with stated pseudo-counts. The fitted log-odds go back
into one expression that gives each pair its posterior; every defect above its cutoff is kept. The
cutoffs are validated on made-up labelled pairs (pair_samples, at most SIZE of them), which are voted on
in the same pass as the data but neither fitted on nor counted: for each defect the cut with the highest
F1 on them, and of cuts that are equally good the one nearest to an even chance.

A pair is a row whose attributes parse and carry a task that is not null. A null or missing answer is
an empty one. Rows with null or unreadable attributes are no pairs. Empty tables give no rows.
Repeated rows each get their own label.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import pair_samples
from spanloom.llm.words import LANGUAGE_NAMES, LANGUAGES, hits, likeliest, plain

DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")  # of several, the first is the one reported

# Ways of saying nothing, of declining, and around it.
NOTHING = r"^(?:null|none|nil|nan|n\s*a|undefined|no (?:output|answer|response|content|text|reply)|empty|keine antwort|sans réponse|sin respuesta)?$"
DECLINES = (
    r"\bno answer (?:will|can) be given\b|\boff[ -]limits\b|\bi (?:stay|keep|remain) out of\b|\b(?:have to|should|please|better) ask (?:a|another|some)(?: (?:person|human|colleague)|one)\b|\banother (?:question|topic)\b|\b(?:i|we) (?:can ?not|can ?'?t|could ?n'?t|will not|won'?t|must|have to|would rather not|'d rather not|am not able|am unable|are not able|decline|refuse|have no way|am not allowed|do not wish)\b"
    r"|\bi'?d rather not\b|\bsomething i must decline\b|\boutside what i'?m allowed\b|\bdo(?:es)? not permit\b|\btalk about something else\b|\bas an ai\b"
    r"|\bkann ich (?:dabei|dazu|hier|ihnen|dir)? ?(?:leider )?nicht\b|\bmuss ich (?:das|dies|es|diese)\b.*\bablehnen\b|\bdarf ich\b.*\bnicht\b|\bich (?:kann|darf|möchte|muss)\b.*\b(?:nicht|ablehnen)\b"
    r"|\bje ne (?:peux|puis|suis)\b|\bje (?:dois|préfère) (?:décliner|refuser|ne pas)\b|\bil m'est (?:interdit|impossible)\b"
    r"|\bno (?:puedo|podemos|debo|voy a)\b|\b(?:debo|tengo que) (?:rechazar|declinar)\b|\bno me (?:está|es) (?:permitido|posible)\b"
    r"|\bnão (?:posso|podemos|devo|vou)\b|\b(?:devo|tenho de|preciso) recusar\b|\bnão me é (?:permitido|possível)\b"
    r"|\bik (?:kan|mag|moet)\b.*\b(?:niet|weigeren|afwijzen)\b|\bя (?:не могу|вынужден|должен)\b"
)
SORRY = r"^\W*(?:i'?m sorry|sorry|i apologi[sz]e|my apologies|unfortunately|regrettably|thanks for asking|leider|entschuldigung|es tut mir leid|bedaure|désolé|je suis (?:navré|désolé)|navré|malheureusement|lo siento|disculpe|perdón|lamentablemente|desafortunadamente|desculpe|lamento|infelizmente|sinto muito|helaas|sorry|het spijt|извините|к сожалению|простите)"
POLICY = r"\b(?:guidelines?|polic(?:y|ies)|instructions do not|not (?:allowed|permitted)|allowed to do|forbids?|richtlinien?|vorgaben|mes règles|mes consignes|mis normas|mis reglas|permitido|interdit|minhas regras|mijn regels|richtlijnen|human operator|something else|conflicts with|safety)\b"
LABELS = r"^(?:q|question|task|prompt|user|you asked|you said|frage|aufgabe|tâche|demande|pregunta|tarea|pergunta|vraag|вопрос)$"
FIRST_PERSON = r"^[^.!?\n]*\b(?:i|i'm|i'd|me|my|ich|mir|mich|je|j'ai|moi|mes|yo|mí|mis|eu|mim|minhas|ik|mij|mijn|я|мне|мои\w*)\b"
ENDS = r"[.!?…。][\"'”’»)\]*_]*$"
OPEN_ENDS = r"[,;:(\[{\-–—/\"“«„]$"


def pairs(traces: DataFrame) -> DataFrame:
    """(delivery_id, task, answer, finish): one row per pair."""
    v = F.try_parse_json("attributes")
    x = traces.where(F.col("attributes").contains('"task"')).select("delivery_id", v.alias("_v"))
    get = lambda path: F.try_variant_get("_v", path, "string")
    return x.select("delivery_id", get("$.task").alias("task"), get("$['gen_ai.completion']").alias("answer"), get("$['gen_ai.response.finish_reasons'][0]").alias("finish")).where("task is not null")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return F.coalesce((out if no is None else out.when(no, -1)).otherwise(0), F.lit(0)).cast("tinyint")


def with_features(p: DataFrame) -> DataFrame:
    """What several labelling functions share, each computed once per pair."""
    bare = F.regexp_replace(F.coalesce("answer", F.lit("")), r"<[^<>]{0,40}>|[​‌‍⁠﻿ ]", " ")
    x = p.withColumn("bare", F.trim(F.regexp_replace(bare, r"\s+", " ")))
    x = x.withColumns({"at": plain(F.col("task")), "aa": plain(F.col("bare"))})
    # what is left of the answer without the task
    wide = lambda c: F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))  # noqa: E731 - so that repeats side by side are found
    rest = F.trim(F.when(F.length("at") > 0, F.regexp_replace(F.replace(wide(F.col("aa")), wide(F.col("at")), F.lit(" ")), " +", " ")).otherwise(F.col("aa")))
    x = x.withColumns({"rest": rest, "low": F.lower("bare")})
    asked = F.coalesce(*[F.when(F.lower("task").rlike(rf"(?i)\b(?:translate|übersetze|traduis|traduisez|traduce|traduzca|traduz|traduza|vertaal|переведи\w*|answer|reply|respond|write|antworte|réponds|responde|antwoord)\b[^.:?!]{{0,40}}\b(?:into|in|to|auf|ins|en|al|em|para|naar|на)\s+(?:the\s+|l'|la\s+|het\s+)?(?:{names})\b"), x_) for x_, names in LANGUAGE_NAMES.items()])
    # each regex and each split once: the votes look at columns
    x = x.withColumns({"wt": F.split("at", " "), "waa": F.split("aa", " "), "wa": F.split("rest", " "), "asked": asked})
    x = x.withColumns({"asked": F.coalesce("asked", likeliest(F.col("wt"), 2)), "hint": likeliest(F.col("wt"), 1), "told": likeliest(F.col("wa"), 2), **{f"n_{k}": hits(F.col("wa"), k) for k in LANGUAGES}})
    x = x.withColumns({"n_rest": F.when(F.col("rest") == "", 0).otherwise(F.size("wa")), "letters": F.length(F.regexp_replace("bare", r"[^\p{L}]", "")), "shared": F.size(F.array_intersect("waa", "wt")), "either": F.size(F.array_union("waa", "wt"))})
    x = x.withColumns({"declines": F.col("low").rlike(DECLINES), "sorry": F.col("low").rlike(SORRY), "policy": F.col("low").rlike(POLICY)})
    own = reduce(lambda a, k: a.when(F.col("asked") == k, F.col(f"n_{k}")), LANGUAGES[1:], F.when(F.col("asked") == LANGUAGES[0], F.col(f"n_{LANGUAGES[0]}")))
    best = F.greatest(*[F.col(f"n_{k}") for k in LANGUAGES])
    lines = F.split(F.trim(F.coalesce("answer", F.lit(""))), "\n")
    return x.withColumns({"own": own, "best": best, "last": F.trim(F.element_at(lines, -1)), "items": F.size(F.filter(lines, lambda s: s.rlike(r"^\s*(?:\d+[.)]|[-*•])\s"))), "fences": F.size(F.split("bare", "```", -1)) - 1}).drop(*[f"n_{k}" for k in LANGUAGES])


def end_words(x: DataFrame) -> DataFrame:
    """(word, ends, all): how often each word closes a sentence or list item, over every answer."""
    text = F.regexp_replace(F.lower("answer"), r"[.!?…](?=\s|$)|\s*\([^()\n]*\)\s*(?=[.!?…\n]|$)|\n", " \u0001 ")
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\u0001'@.-]+", " "), " "), lambda w: w != "")
    return (
        x.select(words.alias("w"))
        .select(F.posexplode("w").alias("i", "word"), "w")
        .where("word <> '\u0001'")
        .select("word", F.coalesce(F.get("w", F.col("i") + 1) == "\u0001", F.lit(False)).cast("int").alias("end"))
        .groupBy("word")
        .agg(F.sum("end").alias("ends"), F.count(F.lit(1)).alias("all"))
    )


def votes(x: DataFrame) -> dict[str, list]:
    """The labelling functions. Of truncated, two are left to voted(), which knows the counts of last words."""
    c = F.col
    words, letters = c("n_rest"), c("letters")
    ends = c("bare").rlike(ENDS) | c("bare").rlike(r"[)\]}`>\"”»*]$") | c("last").rlike(r"\S@ ?\S+\.\w{2,}\W*$|\S \(?(?:at|@)\)? \S+\.\w+$")
    number_rest = F.col("bare").startswith("{") | F.col("bare").startswith("[")
    unclosed = number_rest & ~c("bare").rlike(r"[}\]]$")
    return {
        "empty": [
            _vote(c("bare") == "", letters > 3),
            _vote(c("aa").rlike(NOTHING), F.length("aa") > 12),
            _vote(letters == 0, letters > 12),
            _vote((F.length("bare") <= 12) & c("aa").rlike(NOTHING), F.length("bare") > 12),
        ],
        "refusal": [
            _vote(c("declines"), ~c("declines") & ~(c("sorry") & (words <= 22)) & ~c("policy")),
            _vote(c("sorry") | c("rest").rlike(SORRY)),
            _vote(c("policy")),
            _vote((words > 0) & (words <= 18) & (c("sorry") | c("policy")), words > 40),
            _vote(c("low").rlike(FIRST_PERSON) & (words <= 22)),
            _vote(F.lit(False), c("bare").rlike(r"```|^\s*[{\[]|(?:^|\s)2[.)] |#\d{3}|\(\w+[ -]?\d")),
        ],
        "copied": [
            _vote((c("rest") == "") & (c("aa") != ""), words > 4),
            _vote((c("aa") != "") & c("aa").contains(c("at")) & (F.length("at") > 0) & (words <= 3) & (c("rest").rlike(LABELS) | (c("rest") == "")), ~c("aa").contains(c("at"))),
            _vote((c("shared") >= 0.9 * c("either")) & (c("aa") != ""), c("shared") < 0.7 * c("either")),
            _vote((F.length("aa") <= 1.15 * F.length("at")) & (F.levenshtein("aa", "at", 20) >= 0) & (c("aa") != ""), F.length("aa") > 1.6 * F.length("at")),
        ],
        "wrong_language": [
            _vote(c("asked").isNotNull() & c("told").isNotNull() & (c("asked") != c("told")), c("asked") == c("told")),
            _vote((c("own") == 0) & (c("best") >= 2), c("own") >= 2),
            _vote((c("best") >= 3) & (c("own") * 2 < c("best")), c("own") >= c("best")),
            # a short task may have one telling word only
            _vote(c("asked").isNull() & (c("hint") != c("told")) & (c("best") >= 3), c("asked").isNull() & (c("hint") == c("told"))),
            _vote((c("asked") != "ru") & (F.length(F.regexp_replace("rest", r"[^\p{IsCyrillic}]", "")) > 0.4 * F.length("rest")) & (F.length("rest") > 8), (c("asked") == "ru") & (c("told") == "ru")),
        ],
        "truncated": [
            _vote(c("finish").isin("length", "max_tokens", "max_output_tokens"), c("finish") == "stop"),
            _vote(~ends & (c("items") < 2) & (words > 1), ends & ~unclosed & (c("fences") % 2 == 0)),
            _vote((c("bare").rlike(OPEN_ENDS) & (words > 1)) | unclosed | (c("fences") % 2 == 1)),
            (~ends & (words > 1), ends & ~unclosed & (c("fences") % 2 == 0)),  # for the votes on the last word
        ],
    }


# The start of EM: chance that a function that votes says 1, in defective and in sound pairs, and the weight of
# that start in pairs (as a share of all pairs), which keeps a class what its name says.
START = {1: 0.9, 0: 0.03}
ANCHOR, PRIOR, ROUNDS = 0.02, 0.03, 60


def fit(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, float]]]:
    """EM over counted combinations of votes: log prior odds, and per function the log-odds of each vote.

    A function that abstains says nothing about the class, so its log-odds are 0.
    """
    total = sum(counts.values()) or 1
    width = len(next(iter(counts), ()))
    says = {y: [START[y]] * width for y in (1, 0)}
    share, weight = PRIOR, ANCHOR * total
    for _ in range(ROUNDS):
        post = {}
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(_odds(says[1][j], says[0][j], v) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-60, min(60, odds))))
        share = min(0.5, max(1e-6, (sum(n * post[p] for p, n in counts.items()) + PRIOR * weight) / (total + weight)))
        for y in (1, 0):
            of = {p: n * (post[p] if y else 1 - post[p]) for p, n in counts.items()}
            w = weight * (PRIOR if y else 1 - PRIOR)
            says[y] = [(sum(n for p, n in of.items() if p[j] == 1) + w * START[y]) / (sum(n for p, n in of.items() if p[j] != 0) + w) for j in range(width)]
    return math.log(share / (1 - share)), [{v: _odds(says[1][j], says[0][j], v) for v in (1, -1, 0)} for j in range(width)]


def _odds(a: float, b: float, vote: int) -> float:
    a, b = (min(1 - 1e-4, max(1e-4, x)) for x in (a, b))
    return math.log(a / b) if vote == 1 else math.log((1 - a) / (1 - b)) if vote == -1 else 0.0


def with_samples(p: DataFrame) -> DataFrame:
    """Pairs with sample: null, and below them the made-up ones under their numbers."""
    rows = [(None, *x[1:4], x[0]) for x in pair_samples.samples()]
    made = p.sparkSession.createDataFrame(rows, p.select("delivery_id", "task", "answer", "finish", F.lit(0).alias("sample")).schema)
    return p.withColumn("sample", F.lit(None).cast("int")).unionByName(made)


def voted(p: DataFrame) -> DataFrame:
    """(delivery_id, sample, one array of votes per defect), of pairs with samples.

    Only votes and the last word of unended answers are shuffled to meet the counts of words. Rows without
    such a word get keys of their own, so that they spread.
    """
    x = with_features(p)
    stats = end_words(x.select("answer").where("answer is not null and sample is null"))
    unended = F.when(~F.col("bare").rlike(ENDS), F.regexp_extract(F.lower("bare"), r"([\p{L}\p{N}'@.-]+)\W*$", 1))
    v = votes(x)
    *known, (ends, held) = *v["truncated"][:3], v["truncated"][3]
    narrow = x.select("delivery_id", "sample", unended.alias("last_word"), *[F.array(*c).alias(k) for k, c in v.items() if k != "truncated"], F.array(*known).alias("known"), ends.alias("open_end"), held.alias("whole"))
    narrow = narrow.withColumn("word", F.coalesce("last_word", F.concat(F.lit("\u0001"), F.coalesce("delivery_id", "sample").cast("string"))))
    share = stats.where("`all` >= 5 or ends > 0").select("word", (F.col("ends") / F.col("all")).alias("_share"))
    y = narrow.join(share, "word", "left").withColumn("end_share", F.when(F.col("last_word").isNotNull(), F.coalesce("_share", F.lit(0.0))))
    # how plausible the last word is as an end; the second only speaks where it hardly ever is one
    likely, sure = F.col("end_share") >= 0.08, F.col("end_share") < 0.005
    truncated = F.concat("known", F.array(_vote(F.col("open_end") & ~likely, likely), _vote(F.col("open_end") & sure, F.col("whole"))))
    return y.select("delivery_id", "sample", *[d for d in DEFECTS if d != "truncated"], truncated.alias("truncated"))


def label_model(v: DataFrame) -> dict[str, tuple[float, list[dict[int, float]]]]:
    """Fitted from the counts of vote combinations over all pairs (bounded by 3 to the number of functions)."""
    each = v.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])).alias("x")).select("x.*")
    rows = each.groupBy("defect", "votes").count().collect()
    return {d: fit({tuple(r["votes"]): r["count"] for r in rows if r["defect"] == d}) for d in DEFECTS}


def posteriors(v: DataFrame, model: dict) -> DataFrame:
    cols = []
    for d in DEFECTS:
        prior, tables = model[d]
        odds = F.lit(float(prior))
        for j, t in enumerate(tables):
            vote = F.get(d, F.lit(j))
            odds = odds + F.when(vote == 1, float(t[1])).when(vote == -1, float(t[-1])).otherwise(float(t[0]))
        cols.append((F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias(d))
    return v.select("delivery_id", "sample", *cols)


LEAST, MOST = 0.1, 0.9


def best_cutoff(scored: list[tuple[float, bool]]) -> float:
    """Of the cuts with the highest F1 the one nearest to 0.5. Without a defective pair that's 0.5.

    Cuts are looked for between LEAST and MOST: defects are far more frequent in the sample than in data, so that a
    cut at either end would be fitted to the sample's shares.
    """
    wrong = sum(y for _, y in scored)
    levels = [LEAST, *sorted({p for p, _ in scored if LEAST < p < MOST}), MOST]
    best, cut = -1.0, 0.5
    for low, high in zip(levels, levels[1:]):
        above = [y for p, y in scored if p > low]
        f1 = 2 * sum(above) / (len(above) + wrong) if wrong else 0.0
        at = min(max(0.5, low), high - (high - low) / 1000)  # of the cuts between two posteriors the nearest
        if f1 > best + 1e-9 or (f1 > best - 1e-9 and abs(at - 0.5) < abs(cut - 0.5)):
            best, cut = max(f1, best), at
    return cut


def validated(p: DataFrame) -> dict[str, float]:
    """A cutoff per defect, from the posteriors of the made-up pairs."""
    truth = {x[0]: x[4] for x in pair_samples.samples()}
    rows = p.where("sample is not null").collect()  # at most SIZE
    return {d: best_cutoff([(r[d], d in truth[r["sample"]]) for r in rows]) for d in DEFECTS}


def labelled(traces: DataFrame) -> DataFrame:
    """(delivery_id, labels): all defects whose posterior exceeds its validated cutoff, in the order of DEFECTS."""
    from spanloom.session import cut

    v = cut(voted(with_samples(pairs(traces))), "votes")  # narrow; the fit, the cutoffs and the labels read it
    p = posteriors(v, label_model(v.where("sample is null")))
    cutoff = validated(p)
    each = F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior")) for d in DEFECTS])
    kept = F.filter(each, lambda e: e["posterior"] > F.coalesce(*[F.when(e["defect"] == d, F.lit(c)) for d, c in cutoff.items()]))
    return p.where("sample is null").select("delivery_id", kept.alias("labels")).where(F.size("labels") > 0)


def found(traces: DataFrame) -> DataFrame:
    """(delivery_id, defect): the leading defect of each defective pair."""
    return labelled(traces).select("delivery_id", F.get("labels", F.lit(0))["defect"].alias("defect"))
