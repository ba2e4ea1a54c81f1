import random

from spanloom.llm import leakage as L

ITEMS = "item_id bigint, suite string, lang string, prompt string, answer string"
DOCS = "doc_id bigint, text string, item_id int"
TEMPLATE = "At {} an operator exports {} parcels, {} of which carry no label, while {} rejects every crate above {} grams and {} retries {} times before {} closes the yard."
TAIL = " Use only the tools you are given and reply with the final value and nothing else."


def words(r):
    return "".join(r.choice(["zor", "wes", "tur", "bel", "kan", "mip", "dol"]) for _ in range(3)).capitalize()


def filled(r):
    return TEMPLATE.format(words(r), r.randint(100, 9999), r.randint(100, 9999), words(r), r.randint(100, 9999), words(r), r.randint(100, 9999), words(r))


def items(n=60, seed=1):
    r = random.Random(seed)
    return [(i, "s", "en", filled(r) + (TAIL if i % 2 else ""), f"About {r.randint(100, 9999)} parcels stay with {words(r)}, because {words(r)} merged {r.randint(100, 9999)} and {words(r)} signed off {r.randint(100, 9999)} of them before dawn.") for i in range(n)]


def slip(r, w):
    if len(w) < 4 or w.isdigit():
        return w
    k = r.randrange(1, len(w) - 2)
    return w[:k] + w[k + 1] + w[k] + w[k + 2 :]


def found(spark, docs, its):
    return {(r.doc_id, r.item_id) for r in L.found(spark.createDataFrame(docs, DOCS), spark.createDataFrame(its, ITEMS)).collect()}


def test_planted_passages_and_decoys(spark):
    r, its = random.Random(2), items()
    docs, want = [], set()
    fill = "The night job reads the last record after a short pause. The old report closes both tickets. "
    for i, (item, *_, prompt, answer) in enumerate(its):
        part = r.choice([prompt.removesuffix(TAIL), answer])
        w = part.split()
        how = i % 6
        if how == 1:
            part = part.lower().replace(",", "")
        elif how == 2:
            n = r.randint(12, len(w) - 1)
            k = r.randint(0, len(w) - n)
            part = " ".join(w[k : k + n])
        elif how == 3:
            part = " ".join(slip(r, x) if j % 7 == 3 else x for j, x in enumerate(w))
        elif how == 4:
            part = "\n> ".join(" ".join(f"**{x}**" if r.random() < 0.2 else x for x in w[j : j + 8]) for j in range(0, len(w), 8))
        elif how == 5:
            part = filled(r) + TAIL  # the same wording, filled otherwise
        docs.append((i, fill * r.randint(0, 3) + part + " " + fill, 0))
        if how != 5:
            want.add((i, item))
    docs += [(900, None, 0), (901, "", 0), (902, fill * 3000, 0), (903, TAIL, 0), (0, docs[0][1], 0)]
    assert found(spark, docs, its) == want


def test_eleven_words_are_no_leak_and_short_items_stand_whole(spark):
    its = [(1, "s", "en", "one red tram 4411 left Kanzor at noon", None), (2, "s", "en", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "")]
    docs = [(1, "yes, ONE red tram 4411 left Kanzor at noon.", 0), (2, "one red tram 4411 left Kanzor at", 0), (3, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu", 0), (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", 0)]
    assert found(spark, docs, its) == {(1, 1), (4, 2)}


def test_against_brute_force_on_the_test_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, its = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in L.found(docs, its).collect()}
    own, units = {}, []
    for r in its.collect():
        for t in (r.prompt, r.answer):
            w = L.normal(t).split()
            units.append((r.item_id, w))
            for x in w:
                own.setdefault(x, set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        ws = L.normal(r.text).split()
        here = set(ws)
        for item, u in units:
            if not any(len(own[x]) <= 4 and x in here for x in u):
                continue
            for shift in {j - i for i, x in enumerate(u) for j, y in enumerate(ws) if x == y}:
                run = mine = 0
                for i, x in enumerate(u):
                    j = i + shift
                    if 0 <= j < len(ws) and L.same(x, ws[j]):
                        run, mine = run + 1, mine + (len(own[x]) <= 4)
                        if run >= min(12, len(u)) and mine >= 1:
                            want.add((r.doc_id, item))
                    else:
                        run = mine = 0
    assert got == want


def test_empty_tables(spark):
    assert found(spark, [], items(3)) == set()
    its = spark.createDataFrame([], ITEMS)
    assert L.found(spark.createDataFrame([(1, "x", 0)], DOCS), its).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    """Counts of common wording are over all items, however many blocks they are in."""
    r = random.Random(3)
    its = [(i, "s", "en", f"Read the attached ledger with care and then reply in one line only to {words(r)} {words(r)}.", filled(r)) for i in range(200)]
    docs = [(i, it[3] if i % 3 else it[4], 0) for i, it in enumerate(its)] + [(900, "Read the attached ledger with care and then reply in one line only to them.", 0)]
    want = found(spark, docs, its)
    monkeypatch.setattr(L, "INDEX_CHARS", 3_000)
    assert len(list(L.blocks(spark.createDataFrame(its, ITEMS)))) > 5
    assert found(spark, docs, its) == want and {(i, i) for i in range(200) if i % 3 == 0} <= want and not any(d == 900 for d, _ in want)


def test_every_script_leaks(spark):
    zh = "東の倉庫では四十二個の箱が夜明け前に運び出され係員が番号を控えた"
    el = "το πρωί έφυγαν σαράντα δύο κιβώτια από την αποθήκη και ο φύλακας έγραψε τους αριθμούς τους"
    ar = "في الصباح غادرت اثنتان وأربعون حاوية المستودع وكتب الحارس أرقامها في الدفتر الأزرق الكبير"
    its = [(1, "s", "ja", zh, None), (2, "s", "el", None, el), (3, "s", "ar", ar, "")]
    docs = [(1, "前文。" + zh[3:28] + "。", 0), (2, "Αρχή. " + el.upper() + " Τέλος.", 0), (3, "x " + ar + " y", 0), (4, zh[:9], 0)]
    assert found(spark, docs, its) == {(1, 1), (2, 2), (3, 3)}


def test_long_items_and_far_diagonals(spark):
    r = random.Random(4)
    long = " ".join(words(r) for _ in range(60_000))
    tail = " ".join(long.split()[-30:])
    assert found(spark, [(1, tail, 0), (2, "nothing of it", 0)], [(1, "s", "en", long, None), (2, "s", "en", filled(r), None)]) == {(1, 1)}
