"""Personal details in free text: e-mail addresses, phone and identity numbers, addresses, names.

High-recall generators propose overlapping candidate spans by format. Gradient-boosted trees score
every candidate from its format and its surroundings, thresholds calibrated per type on held-out
samples select, and of overlapping candidates the likelier, then longer, one is kept. The kept spans are replaced by
placeholders like <PERSON>; the rest of the text stays as it is.

The trees are fitted once per driver process on a bounded number of made-up samples (SAMPLES) and
broadcast. The data is read in one pass, Arrow batch by Arrow batch, without a shuffle. Values that
are JSON, also JSON inside a string, are opened token by token (so no depth is too deep), their texts,
whole numbers and object keys looked at each for itself, and what was found is written back in its
place: a text without a detail stays byte for byte. Of a session message's blocks the ids, types and
model, and the source of an image, are no text; everything else is, tool input too. found() and
redact() look at the same texts, so a row has a type exactly if its redacted text has that placeholder.

null and empty texts have nothing in them; unreadable attributes or messages have no text. Repeated
rows each get their own result. Empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.boosting import Trees, best_threshold
from spanloom.llm.pii_samples import Maker
from spanloom.llm.words import FUNCTION_WORDS

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON")
SAMPLES = 12_000  # made-up texts: two thirds to fit on, one third to calibrate the thresholds
RECALL = 2.0  # a detail left standing is worse than a word too many replaced
MAX_JSON = 8  # levels of JSON inside JSON strings that are opened

_U, _L = "[A-ZÀ-ÖØ-ÞĄĆČĎĘĚŁŃŇŘŚŠŤŮŹŻŽŐŰİŞĞА-ЯЁ]", r"[^\W\d_]"
_CAP = rf"{_U}(?:[^\W\d_]|['’-](?={_L}))*"
# Titles, street words, and words that stand around details of each type.
TITLES = "mr mrs ms miss dr prof sir herr frau herrn mme mlle monsieur madame sr sra srta señor señora don doña dhr mevr sig".split()
STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Dr|Way|Court|Ct|Terrace|Crescent|Square|Sq|Row|Boulevard|Blvd|Place|Pl|Hill|Mews|Grove|Gardens|Parade|Highway|Walk|Yard|Quay|Park)"
STREET_DE = r"(?:stra(?:ß|ss)e|str\.|gasse|weg|allee|platz|ring|ufer|damm|hof|steig|pfad|chaussee|markt|berg|anger|graben|wall)"
STREET_FR = r"(?:rue|avenue|allée|allee|chemin|boulevard|place|impasse|quai|cours|route|passage|square|sentier|ruelle)"
STREET_ES = r"(?:Calle|Avenida|Plaza|Camino|Paseo|Ronda|Travesía|Carrera|Callejón|Glorieta|Rúa|Rua|Praça|Via|C/)"
AROUND = {
    "phone": "call called phone tel telephone number ring callback mobile fax unter anrufen rappeler llame reach ext telefon al au voicemail cell whatsapp handy teléfono móvil",
    "id": "ssn tax id passport dni nie national identity papers document identification social security steuer-id ausweis ausgewiesen identificó document personal against licence license card nummer nif curp bsn cpf",
    "code": "order invoice checksum build version trace host step ticket range took total batch serial commit parcel port section code rule record page ms run release file line row rows step zone week quarter item job hash span req tracking sku model chapter policy",
    "name": "by with for from contact owner reach spoke signed message assigned approved customer mr von bei chez à a rappeler llame entregar refund goes account holder bitte avise de prévenir por opened abrió par gemeldet said was is informieren beantwortet file talked lo livrer name to call ask tell notify ping meet met thank thanks told asked gave inform invite visit rufen ruf frage fragen danke contactez demandez appelez llamen pregunte gracias merci bel vraag",
    "does": "moved lives called who asked asks gave showed shows will has had said signed against today hat a se firmó goes identificó présenté sich us opened left went and wohnhaft am au al unter en wrote is was confirmed bat zeigte présente envoya mostró pidió",
    "place": "address anschrift adresse dirección wohnhaft lives moved ship parcel livrer entregar keys at delivered returned from came back en chez unit residence domicilio domicile wohnt to",
}
AROUND = {k: frozenset(v.split()) for k, v in AROUND.items()}
# Words that end names of things.
THINGS = frozenset(
    "desk board team hub lab labs center centre service services system systems suite cloud portal platform project program group department office queue tool tools app bank store shop market institute university society press agency committee council bureau index source works studio pass job agent model layer worker router viewer report script reviewer operator collector assistant monitor loader engineer exporter replay session transcript checklist adapter anschrift adresse address dirección viejo seco street lane road avenue".split()
)
KEYS = {
    "PERSON": re.compile("name|contact|customer|owner|requester|author|person|assignee|user|recipient", re.I), "EMAIL": re.compile("mail|contact", re.I), "PHONE": re.compile("phone|tel|mobile|call|fax|contact", re.I),
    "ID_NUMBER": re.compile("document|tax|ssn|passport|ident|national|dni", re.I), "ADDRESS": re.compile("addr|street|ship|deliver|location|home", re.I),
}
STOP = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)

EMAIL = re.compile(r"[\w.+-]*\w ?(?:@|\(at\)|\[at\]) ?\w[\w-]*(?:\.\w[\w-]*)+")
NUMBER = re.compile(r"(?:(?:tel:)?\+|\((?=\d{1,5}\))|(?<![\w.,:/#-]))(?=\d)\d(?:[\d]|[ .()/-]{1,2}(?=[\d(]))*\d(?: ?-?[A-Z](?!\w))?(?:,? (?:ext|x|Durchwahl|poste)\.? ?\d{1,5})?(?!\w)")
LETTERED = re.compile(r"(?<!\w)[A-Z]{1,2} ?\d{6,9}[A-Z]?(?!\w)")
LED = re.compile(r"(?:(?i:SSN|social security number|tax id|steuer-?id|passport(?: no\.?| number)?|national id|dni|nie|identity card|ausweis|id card|nif|bsn|cpf))[ :]*$")
PLACE = rf"(?:,? ?(?:\d{{4,5}} )?{_CAP}(?:(?:[ -](?:de|del|la|las|los|le|sur|sous|am|an der|upon|von))*[ -]{_CAP}){{0,2}}(?:,? \d{{5}}(?!\d))?)?"
STREETS = [
    re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?(?<![\w.-])\d{{1,4}}[a-zA-Z]? (?:{_CAP} ){{1,3}}{STREET_EN}\b\.?,?(?: {_CAP}){{0,2}}(?:,? \d{{5}}(?!\d))?"),
    re.compile(rf"(?:\b{_L}*{STREET_DE}|\b(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter)(?: (?:der|dem|den))?(?: {_CAP}){{1,3}}|\b(?:{_CAP} )+(?:Stra(?:ß|ss)e|Weg|Allee|Platz)) \d{{1,4}} ?[a-z]?\b{PLACE}"),
    re.compile(rf"(?<![\w.-])\d{{1,4}}(?: bis| ter)?,? {STREET_FR}\b(?: (?:de la|de l'|du|des|de|d'|la|le|les))? ?{_L}+(?:[ -]{_L}+){{0,3}}?(?:,{PLACE}|(?=[.;\n]|$))"),
    re.compile(rf"\b{STREET_ES} (?:(?:del?|las?|los|el|da|do|das|dos) ?)*{_CAP}(?: (?:de |del |la |las |los )*{_CAP}){{0,2}},? \d{{1,4}}(?:,? ?\d{{1,2}}\.?[ºª](?: ?[A-Z]\b)?)?,?{PLACE}"),
]
# Words inside names, and words right before a given name that stands alone.
PARTICLES = frozenset("bin da de del della di dos du la le ten ter van von der".split())
GREETINGS = frozenset("dear hi hello hey hallo liebe lieber moin bonjour cher chère salut hola querido querida estimado estimada olá oi caro cara beste привет здравствуйте is heiße heisse appelle llamo chamo heet зовут".split())
NOBODY = frozenset("all alle all's world everyone everybody there zusammen team tous toutes todos todas allemaal sir madam madame monsieur customer kunde client cliente".split())
CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember"
    " lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril juin juillet août septembre octobre novembre décembre lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio septiembre octubre noviembre diciembre".split()
)
NAME_WORDS = 6  # no longer run of words is taken for one name; longer ones are proposed in parts that overlap
_INSIDE = "|".join(sorted(PARTICLES - {"der"})) + "|(?<=v[ao]n )der"  # der alone is an article
CAPS = re.compile(rf"{_U}[\w'’.-]*(?:,? (?:(?:{_INSIDE}) ){{0,2}}{_U}[\w'’.-]*)*")
ALONE = re.compile(rf"(?<![\w])({'|'.join(sorted(GREETINGS))})[ ,:]{{1,2}}({_CAP})(?!\w)")
_TOKEN = re.compile(r"[\w'’-]+")


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """Up to four words before and two after, in lower case."""
    before = _TOKEN.findall(text[max(0, a - 48) : a].lower())[-4:]
    after = _TOKEN.findall(text[b : b + 30].lower())[:2]
    return before, after


def candidates(text: str, key: str = "") -> list[tuple[str, int, int]]:
    """Overlapping spans that may be details, as (type, start, end)."""
    out: list[tuple[str, int, int]] = []
    if "@" in text or "at)" in text or "at]" in text:
        for m in EMAIL.finditer(text):
            a = m.start()
            # the part before may have taken in a blank-separated word; propose both
            out.append(("EMAIL", a, m.end()))
    digits = False
    for m in NUMBER.finditer(text):
        digits = True
        n = sum(c.isdigit() for c in m.group())
        if n < 7:
            continue
        out.append(("PHONE", m.start(), m.end()))
        led = LED.search(text, max(0, m.start() - 28), m.start())
        out.append(("ID_NUMBER", led.start() if led else m.start(), m.end()))
    if digits or any(c.isdigit() for c in text):
        for m in LETTERED.finditer(text):
            led = LED.search(text, max(0, m.start() - 28), m.start())
            out.append(("ID_NUMBER", led.start() if led else m.start(), m.end()))
        for p in STREETS:
            for m in p.finditer(text):
                out.append(("ADDRESS", m.start(), m.end()))
    for m in CAPS.finditer(text):
        if " " not in m.group():
            # a single word may be a name as the whole value of a key that says so
            if len(m.group()) == len(text.strip()) > 2 and KEYS["PERSON"].search(key) and m.group().isalpha():
                out.append(("PERSON", m.start(), m.end()))
            continue
        words = [(w.group(), m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m.group())]
        for i in range(len(words)):
            if words[i][0] in PARTICLES or words[i][0].lower() in GREETINGS:
                continue
            for k in range(2, NAME_WORDS + 1):
                if i + k > len(words):
                    break
                part = words[i : i + k]
                if part[-1][0] in PARTICLES:
                    continue
                inner = [w.rstrip(",") for w, _, _ in part]
                # sentence ends inside a name only after initials and titles; commas only in "Last, First"
                if any(w.endswith(".") and len(w) > 2 and w[:-1].lower() not in TITLES for w in inner[:-1]) or any(w.endswith(",") for w, _, _ in part[1:-1]) or (part[0][0].endswith(",") and k > 3):
                    break
                if any(c.isdigit() or c == "_" for w in inner for c in w):
                    break
                if any(w.lower() in CALENDAR or w.startswith(("I'", "I’")) for w in inner):
                    break
                last = part[-1][0].rstrip(".,")
                if len(last) < 2 or (inner[0].rstrip(".").lower() in STOP and not (len(inner[0]) == 2 and inner[0][1] == ".")):
                    continue
                out.append(("PERSON", part[0][1], part[-1][1] + len(last)))
    if not text.islower():
        low = text.lower()
        if any(g in low for g in GREETINGS):
            for m in ALONE.finditer(text if text.isupper() else text[:1].lower() + re.sub(r"(?<=[.!?\n] )\w", lambda x: x.group().lower(), text[1:])):
                if m.group(2).lower() not in NOBODY | STOP | THINGS:
                    out.append(("PERSON", m.start(2), m.end(2)))
    return out


def features(text: str, key: str, kind: str, a: int, b: int) -> list[float]:
    """Format and surroundings of one candidate."""
    s = text[a:b]
    before, after = _around(text, a, b)
    groups = re.findall(r"\d+", s)
    digits = sum(map(len, groups))
    lens = [len(g) for g in groups]
    words = [w.strip(".,").lower() for w in s.split()]
    near = set(before)
    tail = text[b : b + 1]
    head = text[a - 1 : a] if a else ""
    led = bool(LED.match(s[: len(s) - len(s.lstrip("SsTtPpNnDdIiAaBbCcOoEe"))] or " ")) if kind == "ID_NUMBER" else False
    shape = "-".join(map(str, lens[:5]))
    name = kind == "PERSON"
    tokens = s.split() if name else []
    return [
        *(float(kind == t) for t in TYPES), float(b - a), float(digits), float(sum(c.isalpha() for c in s)), float(len(groups)), float(min(lens, default=0)), float(max(lens, default=0)),
        float("-" in s), float("." in s), float(" " in s), float("/" in s), float("(" in s), float(s[:1] == "+" or s[:4] == "tel:" or s[:2] == "00"), float(s[:1] == "0"), float("ext" in s.lower()),
        float(bool(near & AROUND["phone"])), float(bool(near & AROUND["id"]) or bool(re.match(r"(?i)ssn|social|tax|steuer|passport|national|dni|nie|ident|ausweis|nif|bsn|cpf|id ", s)) or led), float(bool(near & AROUND["code"])), float(bool(before) and before[-1] in AROUND["code"]),
        float(bool(before) and before[-1] in AROUND["name"]), float(bool(near & AROUND["name"])), float(bool(after) and after[0] in AROUND["does"]), float(len(after) > 1 and after[1] in AROUND["does"]), float(bool(near & AROUND["place"])),
        float(len(tokens)), float(name and words[0] in TITLES), float(name and any(len(w) == 2 and w[1] == "." for w in tokens)), float("," in s), float(s.isupper()), float(bool(words) and words[0] in STOP),
        float(any(w in STOP or (i and w in TITLES) for i, w in enumerate(words)) if name else 0), float(a == 0 or text[:a].rstrip()[-1:] in ("", ".", "!", "?", "\n", ":")), float(len(s) >= len(text.strip()) - 1), float(bool(KEYS[kind].search(key))), float(bool(re.search(r"(?<!\d)\d{5}(?!\d)", s))),
        float(shape in ("3-2-4", "8", "7", "11", "2-3-3-3")), float(shape in ("3-3-4", "1-3-3-4", "10", "5-3-3", "2-4-6", "4-6", "3-8", "2-2-5-3", "4-2-5-3", "2-2-2-2-2", "2-1-2-2-2-2", "11", "7-4")), float(bool(re.match(r"(?:19|20)\d\d[-/.]?\d\d[-/.]?\d\d", s))),
        float(tail.isalnum() or head.isalnum()), float(bool(re.search(r"\.[A-Za-z]{2,}$", s))) if kind == "EMAIL" else 0.0, float(any(w in AROUND["code"] or w in AROUND["phone"] or w in AROUND["id"] for w in words) if name else 0), float(name and any(w in THINGS for w in words)), float(name and sum(c.isupper() for c in text) > 0.5 * sum(c.isalpha() for c in text) and len(text) > 3 * len(s)), float(tail in (")", ">", "]", '"')), float(bool(after) and after[0] in AROUND["code"]),
        float(name and len(tokens) == 1 and bool(before) and before[-1] in GREETINGS), float(sum(w in PARTICLES for w in tokens) if name else 0),
        float(name and sum(c.isdigit() for c in text[b : b + 26]) > 5), float(name and "@" in text[b : b + 44]), float(name and sum(c.isdigit() for c in text[max(0, a - 20) : a]) > 5),
    ]


def select(cands: list[tuple[str, int, int]], p: np.ndarray, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates above their type's threshold, the likelier first, then the longer, none overlapping."""
    kept: list[tuple[str, int, int]] = []
    order = sorted((i for i, c in enumerate(cands) if p[i] >= thresholds[c[0]]), key=lambda i: (cands[i][0] == "PERSON", -round(float(p[i]), 1), cands[i][1] - cands[i][2], cands[i][1]))
    for i in order:
        _, a, b = cands[i]
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append(cands[i])
    return sorted(kept, key=lambda c: c[1])


class Detector:
    def __init__(self, trees: Trees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, texts: list[str], keys: list[str]) -> list[list[tuple[str, int, int]]]:
        """The details of each text. Features of all candidates are scored together."""
        per = [candidates(t, k) if t else [] for t, k in zip(texts, keys)]
        rows = [features(t, k, *c) for t, k, cs in zip(texts, keys, per) for c in cs]
        p = self.trees.predict(np.array(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for cs in per:
            out.append(select(cs, p[at : at + len(cs)], self.thresholds) if cs else [])
            at += len(cs)
        return out


@lru_cache(maxsize=2)
def trained(samples: int = SAMPLES, seed: int = 7) -> Detector:
    """Fitted on made-up samples; a candidate is right if a true span of its type overlaps it by 0.8 (addresses: 0.5) or more."""
    maker, x, y, held = Maker(seed), [], [], []
    for n in range(samples):
        text, key, truth = maker.sample()
        for kind, a, b in candidates(text, key):
            right = any(k == kind and max(0, min(b, e) - max(a, s)) >= (0.5 if k == "ADDRESS" else 0.8) * max(b - a, e - s) for k, s, e in truth)
            x.append(features(text, key, kind, a, b))
            y.append(right)
            held.append(n % 3 == 2)
    x, y, held = np.array(x), np.array(y, float), np.array(held)
    trees = Trees(rounds=100).fit(x[~held], y[~held])
    p, thresholds = trees.predict(x[held]), {}
    for i, t in enumerate(TYPES):
        of = x[held][:, i] == 1
        thresholds[t] = best_threshold(p[of], y[held][of], RECALL) if of.any() else 0.5
    return Detector(trees, thresholds)


_TOKEN_OF_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]|-?\d[^\s,\]}]*')
_COLON = re.compile(r"\s*:")
#: Keys of a session message's blocks that are no text.
SKIP = frozenset(("type", "id", "tool_use_id", "source", "role", "model"))


def _is_json(text: str) -> bool:
    """Whether a text is a JSON object or list."""
    if text.lstrip()[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except RecursionError:  # too deep for the parser; its tokens can be told all the same
        return text.rstrip()[-1:] in ("}", "]")
    except ValueError:
        return False
    return True


def opened(text: str, key: str, leaves: list[tuple[str, str]], blocks: bool = False, level: int = 0):
    """The texts of a value go to leaves, as (text, key it stands under).

    Returns the leaf's number if the text is one, else (start, end, quoted, what) of every literal in it that
    is looked at, where what is what this function returns for its content. blocks: a list of message blocks.
    """
    if level >= MAX_JSON or not _is_json(text):
        leaves.append((text, key))
        return len(leaves) - 1
    out, keys, last = [], [], ""
    for m in _TOKEN_OF_JSON.finditer(text):
        c = text[m.start()]
        if c in "{[":
            keys.append(last)
        elif c in "}]":
            last = keys.pop() if keys else ""
        elif c == ",":
            last = keys[-1] if keys and not (blocks and len(keys) == 2) else ""
        elif c == '"':
            body = m.group()
            value = json.loads(body) if "\\" in body else body[1:-1]
            if _COLON.match(text, m.end()):
                last = value
                # keys of objects deeper than the blocks themselves are data
                if not (blocks and len(keys) <= 2) and not _plain_key(value):
                    leaves.append((value, ""))
                    out.append((m.start(), m.end(), True, len(leaves) - 1))
            elif value and not _skipped(blocks, keys, last):
                out.append((m.start(), m.end(), True, opened(value, last, leaves, False, level + 1)))
        elif m.group().lstrip("-").isdigit() and not _skipped(blocks, keys, last):
            leaves.append((m.group(), last))
            out.append((m.start(), m.end(), False, len(leaves) - 1))
    return out


def _plain_key(name: str) -> bool:
    """Keys that can't be a detail: short words of letters and signs."""
    return len(name) < 5 or (name.isascii() and name.replace("_", "").replace(".", "").replace("-", "").isalpha())


def _skipped(blocks: bool, keys: list[str], last: str) -> bool:
    """Inside a part of a block that is no text: keys has the key each open object or list stands under."""
    return blocks and ((len(keys) == 2 and last in SKIP) or (len(keys) > 2 and keys[2] in SKIP))


def spliced(text: str, what, new: list[str]) -> str:
    """The text with new texts in the places of its leaves."""
    if isinstance(what, int):
        return new[what]
    out, at, used = [], 0, set()
    for a, b, quoted, inner in what:
        literal = text[a:b]
        old = (json.loads(literal) if "\\" in literal else literal[1:-1]) if quoted else literal
        put = spliced(old, inner, new)
        if put != old:
            if _COLON.match(text, b):  # two keys must not become one
                n = sum(u.rstrip("0123456789 ") == put for u in used)
                put = f"{put} {n + 1}" if n else put
                used.add(put)
            out += (text[at:a], json.dumps(put, ensure_ascii=False))
            at = b
    return "".join([*out, text[at:]])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def texts(traces: DataFrame, log: DataFrame) -> DataFrame:
    """(src, row_id, text, blocks): completions and tool results of traces, and the contents of session messages.

    A string comes as it is, any other JSON value as Spark writes it. blocks: the text is a message's list of blocks.
    """
    v = F.try_parse_json("attributes")
    get = lambda path: F.try_variant_get("_v", path, "string")
    a = traces.select("delivery_id", v.alias("_v")).select("delivery_id", F.explode(F.array(F.struct(F.lit("traces.completion").alias("src"), get("$['gen_ai.completion']").alias("text")), F.struct(F.lit("traces.result").alias("src"), get("$['gen_ai.tool.call.result']").alias("text")))).alias("x"))
    a = a.select("x.src", F.col("delivery_id").alias("row_id"), "x.text", F.lit(False).alias("blocks"))
    listed = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("_v", "$.content", "variant")), F.lit("ARRAY")), F.lit(False))
    b = log.select("record_id", F.try_parse_json("message").alias("_v")).select(F.lit("session_log.text").alias("src"), F.col("record_id").alias("row_id"), get("$.content").alias("text"), listed.alias("blocks"))
    return a.unionByName(b).where("text is not null and text <> ''")


def _mapped(kind: str, detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = detector.value
        for b in batches:
            src, ids, values, blocks = (b.column(i).to_pylist() for i in range(4))
            leaves: list[tuple[str, str]] = []
            ends, trees = [], []
            for t, listed in zip(values, blocks):
                trees.append(opened(t, "text" if listed else "", leaves, listed))
                ends.append(len(leaves))
            spans = found.spans([t for t, _ in leaves], [k for _, k in leaves])
            if kind == "types":
                rows, at = [], 0
                for i, end in enumerate(ends):
                    rows += [(i, k) for k in sorted({c[0] for cs in spans[at:end] for c in cs})]
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([src[i] for i, _ in rows], pa.string()), pa.array([ids[i] for i, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())], ["src", "row_id", "pii_type"])
            else:
                new = [redacted(t, c) if c else t for (t, _), c in zip(leaves, spans)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([spliced(t, x, new) for t, x in zip(values, trees)], pa.string())], ["src", "row_id", "text"])

    return run


def found(traces: DataFrame, log: DataFrame) -> DataFrame:
    """(src, row_id, pii_type): one row per text and type in it."""
    detector = traces.sparkSession.sparkContext.broadcast(trained())
    return texts(traces, log).mapInArrow(_mapped("types", detector), "src string, row_id bigint, pii_type string")


def redact(traces: DataFrame, log: DataFrame) -> DataFrame:
    """(src, row_id, text): every text with its details replaced by typed placeholders."""
    detector = traces.sparkSession.sparkContext.broadcast(trained())
    return texts(traces, log).mapInArrow(_mapped("texts", detector), "src string, row_id bigint, text string")
