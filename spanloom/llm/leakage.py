"""Evaluation texts inside a corpus, found by q-gram lemma filtering and verified by banded alignment.

The items are few and don't grow with the corpus, so their q-gram index is broadcast, in blocks of at
most INDEX_CHARS characters of items (an item is never split over blocks; with several blocks the corpus
is read once for each). Nothing of the corpus is shuffled. Of each document every q-gram is looked up;
hits are counted in overlapping diagonal bands per item text. A region of WORDS consecutive item words
with at most EDITS edits keeps at least its q-grams minus EDITS times Q (the q-gram lemma); bands that
reach the smallest such bound of the item text are retained, and where the lemma promises nothing every
band with a hit is. Each is verified by a banded local alignment of words in which slips of spelling match.

Wording that many items share is no leak: q-grams of more than SHARED of the items are left out of
index and bound alike, and an alignment must contain words that are the item's own. Both are counted
over all items, so blocks change nothing.

Texts are compared in lower case, without accents, markup, punctuation and spacing, letters and digits
of every script; in scripts without blanks a character is a word. An item text of fewer than WORDS
words must stand whole. null or empty texts and items leak nothing; repeated documents each report
their own leaks; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, WORDS, EDITS, BAND = 6, 12, 3, 64
SHARED = 0.08  # a q-gram in more than this share of the items is common wording
OWN = 0.02  # a word in at most this share of the items (or two) is an item's own
INDEX_CHARS = 5_000_000  # an index takes some 30 bytes a character in each Python worker

_TAGS = re.compile(r"<\|?/?[A-Za-z][^<>\n]{0,60}>")
_OTHER = re.compile(r"[\W_]+")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")  # scripts written without blanks
_BASE = np.uint64(1_000_003)


def normal(text: str | None) -> str:
    """Words of letters and digits, lower case, without accents, one blank between."""
    if not text:
        return ""
    text = _TAGS.sub(" ", text).lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        text = _UNSPACED.sub(r" \1 ", text)
    return _OTHER.sub(" ", text).strip()


def grams(text: str) -> np.ndarray:
    """A hash of each q-gram."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - Q + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            h = h * _BASE + c[k : len(c) - Q + 1 + k]
        h ^= h >> np.uint64(29)
    return h


def distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two words, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def same(a: str, b: str) -> bool:
    """Equal but for slips of spelling. Numbers have to be equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    most = 1 if max(len(a), len(b)) < 9 else 2
    return distance(a, b, most) <= most


@dataclass
class Shared:
    """What is counted over all items: how many there are, and the q-grams and words too common to tell one from another."""

    items: int
    grams: frozenset[int]
    words: frozenset[str]

    @staticmethod
    def least(items: int) -> tuple[float, float]:
        """In more items than this a q-gram is common wording, a word is not an item's own."""
        return max(2, SHARED * items), max(2, OWN * items)


def shared_of(units: list[tuple[int, str]]) -> Shared:
    """Counted in memory, for items that are all at hand."""
    gram_items, word_items = defaultdict(set), defaultdict(set)
    for i, text in units:
        n = normal(text)
        for g in grams(n).tolist():
            gram_items[g].add(i)
        for w in n.split():
            word_items[w].add(i)
    items = len({i for i, t in units if normal(t)})
    g, w = Shared.least(items)
    return Shared(items, frozenset(k for k, s in gram_items.items() if len(s) > g), frozenset(k for k, s in word_items.items() if len(s) > w))


def counted(items: DataFrame) -> Shared:
    """Counted by one grouped aggregate over all items.

    What is brought to the driver is bounded: a q-gram in more than SHARED of the items can only be one of (average
    q-grams of an item) / SHARED, and likewise for words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, *texts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                each = [n for t in texts if (n := normal(t))] if i is not None else []
                found = sorted({g for n in each for g in grams(n).tolist()})
                words = sorted({w for n in each for w in n.split(" ")})
                if each:
                    kind = ["i", *["g"] * len(found), *["w"] * len(words)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(kind), pa.int64()), pa.array(kind), pa.array(["", *map(str, found), *words])], ["item_id", "kind", "what"])

    each = items.select("item_id", "prompt", "answer").mapInArrow(run, "item_id bigint, kind string, what string").distinct()
    by = each.groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))
    total = next((r["n"] for r in by.where("kind = 'i'").collect()), 0)
    g, w = Shared.least(total)
    common = by.where(f"(kind = 'g' and n > {g}) or (kind = 'w' and n > {w})").collect()
    return Shared(total, frozenset(int(r["what"]) for r in common if r["kind"] == "g"), frozenset(r["what"] for r in common if r["kind"] == "w"))


class Index:
    """The q-grams of item texts, the bound of each, and their words."""

    def __init__(self, items: list[tuple[int, str]], shared: Shared | None = None):
        """items: (item_id, text). shared: of all items, where these are one block of them."""
        units = [(i, n) for i, t in items if (n := normal(t))]
        shared = shared or shared_of(items)
        self.item = np.array([i for i, _ in units], np.int64)
        self.text = [n for _, n in units]
        self.words = [n.split(" ") for _, n in units]
        self.own = [np.array([w not in shared.words for w in ws]) for ws in self.words]
        self.own_words = [frozenset(w for w, o in zip(ws, own) if o) for ws, own in zip(self.words, self.own)]
        rows, self.bound = [], np.zeros(len(units), np.int64)
        for u, n in enumerate(self.text):
            h = grams(n)
            kept = np.array([g not in shared.grams for g in h.tolist()], bool)
            at = np.flatnonzero(kept)
            rows.append(np.stack([h[at], np.full(len(at), u, np.uint64), at.astype(np.uint64)]))
            self.bound[u] = self._bound(self.words[u], self.own[u], kept)
        all_rows = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.uint64)
        order = np.argsort(all_rows[0], kind="stable")
        self.gram, first = np.unique(all_rows[0][order], return_index=True)
        self.first = np.append(first, all_rows.shape[1]).astype(np.int64)
        self.unit, self.place = (all_rows[k][order].astype(np.int64) for k in (1, 2))
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.longest = int(self.length.max(initial=0))

    @staticmethod
    def _bound(words: list[str], own: np.ndarray, kept: np.ndarray) -> int:
        """Fewest kept q-grams of any WORDS words with own words in them, less what EDITS edits can break; at least one hit."""
        starts = np.cumsum([0, *[len(w) + 1 for w in words]])
        sums = np.concatenate([[0], np.cumsum(kept)])
        n = min(WORDS, len(words))
        best = []
        for i in range(len(words) - n + 1):
            if own[i : i + n].sum() >= min(2, own.sum()):
                a, b = starts[i], max(starts[i], min(starts[i + n] - 1 - Q + 1, len(kept)))
                best.append(int(sums[b] - sums[a]))
        return max(1, min(best, default=0) - EDITS * Q)

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(unit, first, last): stretches of text whose diagonal bands reach the unit's bound."""
        h = grams(text)
        if not len(h) or not len(self.gram):
            return []
        at = np.searchsorted(self.gram, h)
        at[at == len(self.gram)] = 0
        hit = np.flatnonzero(self.gram[at] == h)
        if not len(hit):
            return []
        g = at[hit]
        n = self.first[g + 1] - self.first[g]
        post = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc, unit, place = np.repeat(hit, n), self.unit[post], self.place[post]
        half = BAND // 2
        band = (doc - place + self.longest + BAND) // half  # never negative, and below 2^40
        # each hit counts in the two bands that overlap at its diagonal
        key = np.concatenate([unit * (1 << 40) + band, unit * (1 << 40) + band - 1])
        where = np.concatenate([doc, doc])
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(cut, len(key)))
        units = key[cut] >> 40
        kept = np.flatnonzero(size >= self.bound[units])
        first, last = np.minimum.reduceat(where, cut)[kept], np.maximum.reduceat(where, cut)[kept]
        return list(dict.fromkeys(zip(units[kept].tolist(), first.tolist(), last.tolist())))

    def verify(self, unit: int, words: list[str]) -> bool:
        """Banded local alignment of the unit's words with a stretch of the document's."""
        a, own = self.words[unit], self.own[unit]
        need = min(WORDS, len(a))
        # EDITS edits leave all but EDITS of WORDS words as they are, and one that is the item's own among them
        there = set(words)
        if self.own_words[unit].isdisjoint(there):
            return False
        same_words = np.cumsum([0, *[w in there for w in a]])
        if (same_words[need:] - same_words[:-need]).max() < need - EDITS:
            return False
        by_word = defaultdict(list)
        for j, w in enumerate(words):
            by_word[w].append(j)
        shifts = Counter(j - i for i, w in enumerate(a) for j in by_word.get(w, ()) if own[i])
        tried = set()
        for middle, _ in shifts.most_common():
            if any(abs(middle - t) <= 2 for t in tried):
                continue
            tried.add(middle)
            if self._align(a, own, words, middle, need):
                return True
        return False

    @staticmethod
    def _align(a, own, words, middle, need, width=6) -> bool:
        # per cell: score, item words from the start of the path, matched, own words matched
        zero = (0.0, 0, 0, 0)
        last: dict[int, tuple] = {}
        for i, x in enumerate(a):
            row: dict[int, tuple] = {}
            for j in range(max(0, i + middle - width), min(len(words), i + middle + width + 1)):
                s, n, m, o = last.get(j - 1, zero)
                if same(x, words[j]):
                    best = (s + 1, n + 1, m + 1, o + bool(own[i]))
                    if best[1] >= need and best[2] >= best[1] - best[1] // need and best[3] >= min(2, int(own.sum())) and best[3] >= 1:
                        return True
                else:
                    best = (s - 3, n + 1, m, o) if s > 3 else zero
                over = row.get(j - 1, zero)  # a word of the document only
                if over[0] - 1 > best[0]:
                    best = (over[0] - 1, *over[1:])
                skip = last.get(j, zero)  # a word of the item only
                if skip[0] - 3 > best[0]:
                    best = (skip[0] - 3, skip[1] + 1, *skip[2:])
                row[j] = best
            last = row
        return False

    def leaks(self, text: str | None) -> list[int]:
        """Items whose text leaks into this one."""
        t = normal(text)
        out, done, split = set(), set(), {}
        for u, first, end in self.regions(t):
            i = int(self.item[u])
            if i in out:
                continue
            reach = int(self.length[u]) + BAND
            a, b = max(0, first - reach), min(len(t), end + reach)
            if (u, a, b) in done:
                continue
            done.add((u, a, b))
            if (a, b) not in split:
                split[a, b] = t[a:b].split(" ")
            if self.verify(u, split[a, b]):
                out.add(i)
        return sorted(out)


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The item texts, (item_id, text), in blocks of at most INDEX_CHARS characters, both texts of an item in one."""
    out: list[tuple[int, str]] = []
    size = 0
    for r in items.where("item_id is not null").select("item_id", "prompt", "answer").toLocalIterator():
        both = [(r["item_id"], t) for t in (r["prompt"], r["answer"]) if t]
        length = sum(len(t) for _, t in both)
        if out and size + length > INDEX_CHARS:
            yield out
            out, size = [], 0
        out += both
        size += length
    yield out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one row per document and item that leaks into it."""
    spark, out, shared = documents.sparkSession, None, counted(items)
    for block in blocks(items):
        index = spark.sparkContext.broadcast(Index(block, shared))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, hits = [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i in index.value.leaks(t):
                        docs.append(d)
                        hits.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        x = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")
        out = x if out is None else out.unionByName(x)
    return out
