"""Language of each text, and of each stretch of a mixed text, by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a byte whose bit l belongs
to language l's filter, so K lookups joined by AND return the set of all languages that contain an
n-gram. Per sentence the n-grams of each language are counted (popcounts of the bit columns), corrected
for the filter's false positives, and the highest decides; its lead is the confidence.

The filter is fitted on a sample of at most SAMPLE_DOCS documents (by hash of doc_id; all of a smaller
table), on sentences whose function words point to one language: labels as delivered are not trusted.
Its size is fixed (SLOTS bytes), so it is broadcast; every document is then read whole, in one pass
without a shuffle.

Log lines, JSON, code, role tags, bullets and markup are blanked before sentences are cut, keeping all
offsets. null or empty texts and texts without a sentence get no language and no row. Repeated
documents each get their rows. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import FUNCTION_WORDS, LANGUAGES

N, SLOTS, K = 4, 1 << 21, 3
SAMPLE_DOCS = 20_000
SHARE = 0.08  # an n-gram is a language's if it's at least this frequent there, relative to where it's most frequent
LEAST_LETTERS, LEAST_WORDS = 10, 3

# How languages are labelled.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands flemish", "ru": "ru rus russian русский",
}
UNKNOWN = "und unknown none null n/a na ? - unk mul mis zxx xx other".split()
_LABEL = {w: k for k, ws in LABELS.items() for w in ws.split()}

_BLANK = re.compile(
    r"```.*?(?:```|\Z)"  # code
    r"|`[^`\n]*`"
    r"|^[ \t>*-]*\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*$"  # log lines
    r"|\{[^{}\n]*\}|\[[\"{][^\n]*\]"  # JSON
    r"|<\|?/?[A-Za-z][^<>\n]{0,60}>"  # tags
    r"|^[ \t]*(?:>[ \t]*)*(?:[-*+•][ \t]+|\d+[.)][ \t]+|#+[ \t]*\d*[^\n]{0,12}$)?(?:\[?\b(?:user|assistant|tool|system|human|ai)\b\]?:?(?=[ \t:]|$)[: \t]*)?"  # quotes, bullets, headings, roles
    r"|https?://\S+|\S+@\S+|\b\w+\([^()\n]*\)|\b\w*\d\w*\b|[*_#>|]+",
    re.M | re.S,
)
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+|\n|\Z)")
_WORDS = re.compile(r"[^\W\d_]+")
_FUNCTION = {w: [k for k in LANGUAGES if w in FUNCTION_WORDS[k]] for k_ in LANGUAGES for w in FUNCTION_WORDS[k_]}


def label(text: str | None) -> str | None:
    """The language a label names: one of LANGUAGES, 'other', or None if it's missing or unknown."""
    t = (text or "").strip().lower()
    if not t or t in UNKNOWN:
        return None
    return _LABEL.get(t) or _LABEL.get(re.split(r"[-_ (]", t)[0], "other")


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, its words in lower case, blanks between and around)."""
    if not text:
        return []
    bare = _BLANK.sub(lambda m: " " * len(m.group()) if "\n" not in m.group() else "".join(c if c == "\n" else " " for c in m.group()), text)
    out = []
    for m in _SENTENCE.finditer(bare):
        w = _WORDS.findall(m.group().lower())
        s = " ".join(w)
        if len(w) >= LEAST_WORDS and len(s) - len(w) + 1 >= LEAST_LETTERS:
            out.append((m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), f" {s} "))
    return out


def weak_language(sentence: str) -> str | None:
    """The language most of whose function words occur, if it leads by two."""
    n = dict.fromkeys(LANGUAGES, 0)
    for w in set(sentence.split()):
        for k in _FUNCTION.get(w, ()):
            n[k] += 1
    first, second = sorted(n.values(), reverse=True)[:2]
    return max(n, key=n.get) if first >= second + 2 else None


def hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < N:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - N + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(N):
            h = (h ^ c[k : len(c) - N + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def slots(h: np.ndarray) -> np.ndarray:
    """The K slots of each hash."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((a + np.uint64(k) * b) % np.uint64(SLOTS)).astype(np.int64) for k in range(K)])


class Filters:
    """The bit-sliced filter: one byte per slot, bit l for language l."""

    def __init__(self, counts: list[tuple[int, str, int]]):
        """counts: (n-gram hash, language, how often)."""
        bit = {k: i for i, k in enumerate(LANGUAGES)}
        seeds = [(h, k, 3) for k in LANGUAGES for w in FUNCTION_WORDS[k] for h in hashes(f" {w} ").tolist()]
        both = [*counts, *seeds]
        h = np.array([np.uint64(x[0] & 0xFFFFFFFFFFFFFFFF) for x in both], np.uint64)
        of, place = np.unique(h, return_inverse=True)
        table = np.zeros((len(of), len(LANGUAGES)))
        np.add.at(table, (place, [bit[x[1]] for x in both]), [x[2] for x in both])
        rate = table / np.maximum(1, table.sum(axis=0))
        member = (table >= 2) & (rate >= SHARE * rate.max(axis=1, keepdims=True))
        self.bytes = np.zeros(SLOTS, np.uint8)
        for i in range(len(LANGUAGES)):
            for s in slots(of[member[:, i]]):
                self.bytes[s] |= np.uint8(1 << i)
        fill = np.array([((self.bytes >> i) & 1).mean() for i in range(len(LANGUAGES))])
        self.false = fill**K

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each hash the set of languages that contain it."""
        return np.bitwise_and.reduce(self.bytes[slots(h)], axis=0) if len(h) else np.zeros(0, np.uint8)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text and language the share of n-grams the language contains, false positives taken off."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        # one string for all; n-grams across a seam belong to no text
        joined = "\x00".join(texts)
        m = self.masks(hashes(joined))
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + 1) - size - 1
        n = np.maximum(0, size - N + 1)
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(texts)), n)
        hits = np.stack([np.bincount(of, (m[at] >> i) & 1, len(texts)) for i in range(len(LANGUAGES))], axis=1)
        share = hits / np.maximum(1, n)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)


def _decide(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and confidence per row: the lead of the first over the second, as a share of the first."""
    order = np.argsort(-scores, axis=1, kind="stable")
    rows = np.arange(len(scores))
    first, second = scores[rows, order[:, 0]], scores[rows, order[:, 1]]
    return order[:, 0], np.where(first > 0, (first - second) / np.maximum(first, 1e-9) * np.minimum(1, first / 0.5), 0.0)


SURE = 0.12


def fit(documents: DataFrame, most: int = SAMPLE_DOCS) -> Filters:
    n = documents.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per: dict[str, list[np.ndarray]] = {}
            for t in b.column(0).to_pylist():
                for _, _, s in sentences(t):
                    if k := weak_language(s):
                        per.setdefault(k, []).append(hashes(s))
            for k, hs in per.items():
                h, c = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([k] * len(h)), pa.array(c.astype(np.int64))], ["h", "lang", "n"])

    sample = documents.where("text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))) < most).select("text")
    counts = sample.mapInArrow(run, "h bigint, lang string, n bigint").groupBy("h", "lang").agg(F.sum("n").alias("n")).where("n > 1")
    return Filters([(r["h"], r["lang"], r["n"]) for r in counts.collect()])  # bounded by SAMPLE_DOCS documents


SEGMENTS = "doc_id bigint, label string, segment int, start int, end int, sentences int, lang string, confidence double"
LANGUAGES_OF = "doc_id bigint, label string, languages array<struct<n: int, confidence: double, lang: string>>, in_text array<string>"


def _told(batch: pa.RecordBatch, f: Filters) -> Iterator[tuple]:
    """(doc_id, label, sentences, language numbers, confidences) of each text with sentences in a batch."""
    per = [sentences(t) for t in batch.column(2).to_pylist()]
    all_of = [s for p in per for _, _, s in p]
    lang, sure = _decide(f.scores(all_of)) if all_of else (np.zeros(0, int), np.zeros(0))
    at = 0
    for d, lb, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), per):
        k = len(p)
        ls, cs = lang[at : at + k].tolist(), sure[at : at + k].tolist()
        at += k
        if not k:
            continue
        best = max(range(k), key=lambda i: cs[i])
        before = next((ls[i] for i in range(k) if cs[i] >= SURE), ls[best])
        for i in range(k):
            if cs[i] < SURE:
                ls[i] = before  # told unsurely: it goes with the sentence before
            before = ls[i]
        yield d, lb, p, ls, cs


def segments(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """One row per stretch of sentences in one language; a sentence told unsurely goes with the one before."""
    shared = documents.sparkSession.sparkContext.broadcast(filters or fit(documents))  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, lb, p, ls, cs in _told(b, shared.value):
                runs: list[list] = []
                for i, x in enumerate(ls):
                    if runs and runs[-1][0] == x:
                        runs[-1][1].append(i)
                    else:
                        runs.append([x, [i]])
                for n, (x, rows) in enumerate(runs):
                    w = sum(len(p[i][2]) for i in rows)
                    out.append((d, lb, n, p[rows[0]][0], p[rows[-1]][1], len(rows), LANGUAGES[x], round(sum(cs[i] * len(p[i][2]) for i in rows) / w, 6)))
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

    return documents.select("doc_id", F.col("lang").alias("label"), "text").mapInArrow(run, SEGMENTS)


def languages(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, label, languages, in_text): per document its languages with sentences and confidence.

    languages are those of two or more sentences, or else the first; in_text is every language of a sentence.
    Each row is told from its own text alone, so nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters or fit(documents))
    item = pa.struct([("n", pa.int32()), ("confidence", pa.float64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, langs, seen = [], [], [], []
            for d, lb, _, ls, cs in _told(b, shared.value):
                n = {x: ls.count(x) for x in dict.fromkeys(ls)}
                rows = sorted(({"n": k, "confidence": round(sum(c for c, y in zip(cs, ls) if y == x) / k, 6), "lang": LANGUAGES[x]} for x, k in n.items()), key=lambda r: (-r["n"], -r["confidence"], r["lang"]))
                ids.append(d)
                labels.append(lb)
                langs.append([r for r in rows if r["n"] >= 2] or rows[:1])
                seen.append([r["lang"] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(langs, pa.list_(item)), pa.array(seen, pa.list_(pa.string()))], ["doc_id", "label", "languages", "in_text"])

    return documents.select("doc_id", F.col("lang").alias("label"), "text").mapInArrow(run, LANGUAGES_OF)


def _named(col):
    """The language a label names, as label() does, in SQL."""
    t = F.lower(F.trim(col))
    head = F.regexp_extract(t, r"^([^-_ (]*)", 1)
    table = F.create_map(*[F.lit(x) for w, k in _LABEL.items() for x in (w, k)])
    return F.when(~F.coalesce(t, F.lit("")).isin("", *UNKNOWN), F.coalesce(F.try_element_at(table, t), F.try_element_at(table, head), F.lit("other")))


def found(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, lang): the languages of documents whose label is missing, unknown or wrong, or that are mixed."""
    x = languages(documents, filters).withColumn("named", _named(F.col("label")))
    case = F.col("named").isNull() | ~F.array_contains("in_text", F.col("named")) | (F.size("languages") > 1)
    return x.where(case).select("doc_id", F.explode(F.transform("languages", lambda x: x["lang"])).alias("lang"))
