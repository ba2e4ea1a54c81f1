import json
import random

from spanloom.llm import pairs as P

SCHEMA = "delivery_id bigint, attributes string, word string, votes int"
SUBJECTS = "The loader|The old report|A quick check|The night job|One reviewer|The billing tool".split("|")
VERBS = "reads the last record|closes both tickets|counts every line|skips the empty page|opens the archive|stores an error note".split("|")
TAILS = "before the next run|after a short pause|in the staging area|without asking again|while the queue is full|for the third time".split("|")


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(TAILS)}"


def corpus(n=1500, seed=3):
    """(rows, truth): pairs with a few of each defect in an otherwise sound corpus."""
    r, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        task = f"Explain why {sentence(r).lower()}."
        good = ". ".join(sentence(r) for _ in range(r.randint(1, 3))) + "."
        if r.random() < 0.1:
            good = "\n".join(f"{k}. {sentence(r)}" for k in (1, 2, 3))
        if r.random() < 0.05:
            good += " Sorry for the delay; the report is in place."
        a = {"gen_ai.completion": good, "task": task, "gen_ai.response.finish_reasons": ["stop"]}
        kind = {0: "empty", 1: "refusal", 2: "copied", 3: "wrong_language", 4: "truncated"}.get(i % 40)
        if kind == "empty":
            a["gen_ai.completion"] = r.choice(["", "  ", None, "N/A", "​", "...", "<p></p>", "null"])
        elif kind == "refusal":
            a["gen_ai.completion"] = r.choice(["I'm sorry, but I can't help with that.", "I must decline, as my policy forbids it.", "Unfortunately, I am not able to do this. Please ask a human operator.", f"{task}\n\nI won't be able to assist here."])
        elif kind == "copied":
            a["gen_ai.completion"] = r.choice([task, task.upper(), f"Q: {task}", f"“{task}”", f"{task} {task}"])
        elif kind == "wrong_language":
            a["gen_ai.completion"] = r.choice(["Der Planer liest den alten Bericht, bis jemand die Zuordnung bestätigt.", "Le journal compte les lignes en retard avant le prochain tour.", "El informe cuenta cada traza nueva antes del siguiente turno, para que todo quede completo."])
        elif kind == "truncated":
            a["gen_ai.completion"] = f"{sentence(r)}. " + " ".join(sentence(r).split()[: r.randint(2, 4)]) + r.choice(["", " th", ","])
            a["gen_ai.response.finish_reasons"] = [r.choice(["length", "stop"])]
        if kind:
            truth[i] = kind
        rows.append((i, json.dumps(a), "w", 1))
    return rows, truth


def test_defects_of_a_made_up_corpus(spark):
    rows, truth = corpus()
    got = {r.delivery_id: r.defect for r in P.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum(got.get(i) == k for i, k in truth.items())
    assert right >= 0.97 * len(truth)
    assert sum(i not in truth for i in got) <= 0.01 * len(rows)


def test_several_labels_are_kept(spark):
    rows, _ = corpus(400)
    task = "Übersetze ins Deutsche: The loader reads the last record after a short pause."
    rows.append((9999, json.dumps({"task": task, "gen_ai.completion": "Le journal compte les lignes en retard avant le prochain tour et", "gen_ai.response.finish_reasons": ["length"]}), "", 0))
    x = {r.delivery_id: [y.defect for y in r.labels] for r in P.labelled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert x[9999] == ["wrong_language", "truncated"]


def test_what_is_no_pair(spark):
    rows, _ = corpus(200)
    odd = [(901, None, "", 0), (902, '{"task": "a", "gen_ai.comp', "", 0), (903, json.dumps({"task": None, "gen_ai.completion": ""}), "", 0), (904, json.dumps({"gen_ai.completion": ""}), "", 0), (905, "[]", "", 0), (906, json.dumps({"task": "Say why."}), "", 0), (906, json.dumps({"task": "Say why."}), "", 0)]
    got = [(r.delivery_id, r.defect) for r in P.found(spark.createDataFrame(rows + odd, SCHEMA)).collect() if r.delivery_id > 900]
    assert got == [(906, "empty"), (906, "empty")]


def test_long_text_and_empty_table(spark):
    long = json.dumps({"task": "Explain it.", "gen_ai.completion": "The loader reads the last record. " * 20000})
    assert P.found(spark.createDataFrame([(1, long, "", 0)], SCHEMA)).count() == 0
    assert P.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cutoffs_are_validated_on_made_up_pairs(spark):
    """Half of the sample sets the cutoffs, the other half tells how they do; its wording is in no labelling function."""
    from spanloom.llm import pair_samples as S
    from spanloom.llm import pairs as P

    t = spark.read.parquet("/root/testdata/sf0.01/traces.parquet")
    v = P.voted(P.with_samples(P.pairs(t))).cache()
    p = P.posteriors(v, P.label_model(v.where("sample is null")))
    truth = {x[0]: x[4] for x in S.samples()}
    rows = p.where("sample is not null").collect()
    assert len(rows) == len(truth) == S.SIZE
    for d in P.DEFECTS:
        cut = P.best_cutoff([(r[d], d in truth[r["sample"]]) for r in rows if r["sample"] % 2])
        held = [(r[d] > cut, d in truth[r["sample"]]) for r in rows if r["sample"] % 2 == 0]
        hit, found, true = (sum(x) for x in ([a and b for a, b in held], [a for a, _ in held], [b for _, b in held]))
        assert P.LEAST <= cut <= P.MOST and hit >= 0.9 * true and hit >= 0.85 * found, (d, cut, hit, found, true)
    v.unpersist()


def test_best_cutoff():
    from spanloom.llm.pairs import best_cutoff

    assert best_cutoff([]) == 0.5 and best_cutoff([(0.2, False)]) == 0.5
    assert 0.2 <= best_cutoff([(0.4, True), (0.2, False), (0.1, False)]) < 0.4
    assert 0.6 <= best_cutoff([(0.6, False), (0.8, True)]) < 0.8
