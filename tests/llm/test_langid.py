import random

import pytest

from spanloom.llm import langid as L

SCHEMA = "doc_id bigint, text string, lang string, segment string, confidence int"
TEXTS = {
    "en": "The loader reads the last record after a short pause. Every new report is closed before the next run. Nobody asked for it while the queue was full.",
    "de": "Der Planer liest den alten Bericht nach einer kurzen Pause. Jede neue Zeile wird vor dem nächsten Lauf gezählt. Niemand hat danach gefragt, solange die Regeln gelten.",
    "fr": "Le journal lit le dernier enregistrement après une courte pause. Chaque nouvelle ligne est comptée avant le prochain tour. Personne ne l'a demandé pendant la mise à jour.",
    "es": "El informe lee el último registro después de una breve pausa. Cada línea nueva se cuenta antes del siguiente turno. Nadie lo ha pedido mientras siguen las reglas viejas.",
    "pt": "O relatório lê o último registo depois de uma pausa curta. Cada linha nova é contada antes da próxima volta. Ninguém o pediu enquanto as regras antigas valem.",
    "nl": "Het verslag leest het laatste bericht na een korte pauze. Elke nieuwe regel wordt geteld voor de volgende beurt. Niemand heeft erom gevraagd zolang de regels gelden.",
    "ru": "Отчёт читает последнюю запись после короткой паузы. Каждая новая строка считается перед следующим шагом. Никто об этом не просил, пока действуют старые правила.",
}


@pytest.fixture(scope="module")
def filters(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))  # none of the texts here are in it


def test_every_language_and_held_out_sentences(filters):
    held = {"en": "This old archive was opened by one of the graders.", "de": "Das Archiv wurde von der zweiten Prüferin geöffnet.", "fr": "Les archives ont été ouvertes par une des relectrices.", "es": "El archivo fue abierto por una de las revisoras.", "pt": "O arquivo foi aberto por uma das revisoras.", "nl": "Het archief werd door een van de beoordelaars geopend.", "ru": "Архив был открыт одним из проверяющих."}
    for want, t in [*TEXTS.items(), *held.items()]:
        k, _ = L._decide(filters.scores([s for *_, s in L.sentences(t)]))
        assert {L.LANGUAGES[i] for i in k} == {want}, t


def test_bit_slices_equal_single_filters(filters):
    h = L.hashes(" " + TEXTS["de"].lower())
    each = [all((filters.bytes[s] >> 1) & 1 for s in L.slots(h)[:, j]) for j in range(len(h))]
    assert [bool((m >> 1) & 1) for m in filters.masks(h)] == each


def test_cases(spark, filters):
    two = lambda a, b: " ".join(TEXTS[a].split(". ")[:2]) + ". " + TEXTS[b]
    docs = [
        (1, TEXTS["de"], "de"), (2, TEXTS["de"], "de-AT"), (3, TEXTS["de"], "German"), (4, TEXTS["de"], None), (5, TEXTS["de"], "und"), (6, TEXTS["de"], "nl"), (7, TEXTS["de"], "it"),
        (8, TEXTS["en"] + " " + TEXTS["fr"], "en"), (9, None, None), (10, "", "en"), (11, '{"span": "x", "ok": true}\n2026-01-01T00:00:00Z tool=read_file status=200 ms=5\n`read_file(id="1")`', None),
        (12, f"<|user|>{TEXTS['nl']}\n[assistant] {TEXTS['nl']}\n- {TEXTS['nl']}", ""), (13, TEXTS["pt"] * 3000, "ES"), (4, TEXTS["de"], None),
    ]
    assert two("en", "de")
    df = spark.createDataFrame([(*d, "", 0) for d in docs], SCHEMA)
    got = {(r.doc_id, r.lang) for r in L.found(df, filters).collect()}
    assert got == {(4, "de"), (5, "de"), (6, "de"), (7, "de"), (8, "en"), (8, "fr"), (12, "nl"), (13, "pt")}
    seg = [(r.segment, r.lang, r.sentences) for r in L.segments(df, filters).collect() if r.doc_id == 8]
    assert seg == [(0, "en", 3), (1, "fr", 3)]


def test_segments_cover_the_sentences(spark, filters):
    text = f"{TEXTS['ru']}\n```\ncode(here)\n```\n{TEXTS['es']}"
    rows = L.segments(spark.createDataFrame([(1, text, None, "", 0)], SCHEMA), filters).collect()
    assert [text[r.start : r.end].split()[0] for r in rows] == ["Отчёт", "El"] and all(0 < r.confidence <= 1 for r in rows)


def test_labels():
    assert [L.label(x) for x in ("EN", "en-US", "English", "eng", " ", None, "und", "unknown", "pt-BR", "nld", "it", "klingon")] == ["en"] * 4 + [None] * 4 + ["pt", "nl", "other", "other"]


def test_labels_in_sql_equal_labels(spark):
    names = ["EN", "en-US", "English", " eng ", " ", None, "und", "unknown", "pt-BR", "nld", "it", "klingon", "Français (fr)"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", L._named("n").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [L.label(n) for n in names]


def test_empty_table(spark, filters):
    assert L.found(spark.createDataFrame([], SCHEMA), filters).count() == 0
    assert L.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_mixes(spark, filters):
    r = random.Random(3)
    docs, want = [], set()
    for i in range(60):
        a, b = r.sample(list(TEXTS), 2)
        docs.append((i, TEXTS[a] + "\n\n" + TEXTS[b], a, "", 0))
        want |= {(i, a), (i, b)}
    assert {(x.doc_id, x.lang) for x in L.found(spark.createDataFrame(docs, SCHEMA), filters).collect()} == want
