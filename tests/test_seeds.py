"""Nearest texts and containment against seeds, compared pair by pair."""

import random

from spanloom.operators import similarity as M


def grams(t):
    w = t.split()
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_nearest_and_containment(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abc") for _ in range(r.randint(1, 12)))
    docs, seeds = [(i, text()) for i in range(25)] + [(90, ""), (91, "x y z")], [(i, text()) for i in range(6)]
    a, b = {i: grams(t) for i, t in docs}, {i: grams(t) for i, t in seeds}
    df, sf = spark.createDataFrame(docs, "id_ int, text string"), spark.createDataFrame(seeds, "id_ int, text string")
    got = {x.id_: x for x in M.nearest_texts(df, sf, "id_", "text").collect()}
    assert len(got) == len(docs)
    for i, g in a.items():
        all_ = [(len(g & o) / len(g | o), seed, j) for seed, pool in ((False, a), (True, b)) for j, o in pool.items() if (seed or j != i) and g & o]
        s, seed, j = min(all_, key=lambda x: (-x[0], x[1], x[2]), default=(0.0, None, None))
        assert (got[i].nearest, got[i].of_seed) == (j, seed) and abs(got[i].similarity - s) < 1e-12
    got = {x.id_: x for x in M.seed_containment(df, sf, "id_", "text").collect()}
    share = lambda g, o: len(g & o) / len(g) if g else 0.0
    for i, g in a.items():
        assert abs(got[i].largest - max(share(g, o) for o in b.values())) < 1e-12
        assert abs(got[i].others - sum(share(g, o) for j, o in a.items() if j != i) / (len(a) - 1)) < 1e-12
    one = M.seed_containment(df.where("id_ = 0"), sf.limit(0), "id_", "text").first()
    assert (one.largest, one.others) == (0.0, None)


def test_rows_per_seed(spark):
    df = spark.createDataFrame([(s,) for s in "aaab"] + [(None,), (None,)], "seed string")
    assert tuple(M.per_seed(df, "seed").first()) == (1, 3) and tuple(M.per_seed(df.limit(0), "seed").first()) == (0, 0)
