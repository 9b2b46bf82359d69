"""Held-out passages that leak into training texts (problem 9).

Winnowing: both sides are reduced to letters and digits without case, accents,
spaces or punctuation, and hashed by k letters; of every window of neighbouring
hashes the least is kept. A shared span of ``k + window - 1`` letters is sure to
share a fingerprint. Fingerprint hits pick the places in the text for an item; at
each the words are aligned in order, allowing for damaged letters, split or joined
words and insertions, and counted per sentence of the passage. The place with most
words, formulas aside, decides.

A place of an item whose hits all lie in formulas that are known from the items
alone is left aside: nothing there counts.

A sentence of a passage that whole recurs in speeches which carry nothing else of
the passage, or in several items, is a procedural formula; its words don't count.
Copies and reissues of a speech recur as one. A text that carries words enough for
a leak is evidence of a formula only if the sentence stands in several items.

The held-out side is small by nature. Up to ``broadcast_fingerprints`` it travels
with the tasks; beyond that bound texts and items meet by fingerprint in shuffles.
Either way a text's winnowed hashes meet every k-gram of an item.

Defined cases: null, empty and blank texts or passages match nothing; texts are
read whole; a repeated document id is judged as one document; empty input gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.streams import record_batches, slices
from fleetloom.session import checkpointed, spread


@dataclass(frozen=True)
class Rules:
    k: int = 9
    window: int = 4
    min_hits: int = 4
    band: int = 64  # letters by which a carried span may drift off its diagonal
    run_words: int = 4  # fewer words together are chance
    min_words: int = 15
    formula_docs: int = 5
    formula_share: float = 0.001
    formula_items: int = 3
    broadcast_fingerprints: int = 2_000_000


_WORD = re.compile(r"[^\W_]+")
# the mark comes first, then what stands before it: a search for one of few characters is quick
_APOSTROPHE = re.compile(r"['’ʼ`´](?<=\w.)(?=\w)")
_HYPHEN_BREAK = re.compile(r"[-­‐](?<=[^\W\d_].)\s*\n\s*(?=[^\W\d_])")
_COMBINING = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))) + "]+")
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_OTHER = re.compile("[^\x00-\u0482\u2000-\u206f]")  # scripts whose combining characters are not accents
_FOREIGN = re.compile("[\u0370-\u052f]")
# fixed values: Greek and Cyrillic letters that look like Latin ones
_LOOKALIKES = str.maketrans("аеорсухкмтвніјѕԁοαερτυνικ", "aeopcyxkmtbhijsdoaeptuvik")


def words(text: str) -> list[str]:
    """Words without case, accents, hidden characters and look-alike letters."""
    # steps that find nothing are skipped: most texts need none of them
    plain = text.isascii()
    if not plain:
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
        if _OTHER.search(text):
            text = _COMBINING.sub("", text)
    text = _APOSTROPHE.sub("", _HYPHEN_BREAK.sub("", text)).casefold()
    if not plain and _FOREIGN.search(text):
        text = text.translate(_LOOKALIKES)
    return _WORD.findall(text)


def sentences(passage: str) -> list[list[str]]:
    return [w for s in re.split(r"(?<=[.!?;])\s+", passage) if (w := words(s))]


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbouring codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (last) least hash of every window."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    at = np.arange(window - 1, n)  # of each window the last position first
    least = hashes[window - 1 :].copy()
    for back in range(1, window):
        other = hashes[window - 1 - back : n - back]
        less = other < least
        least[less] = other[less]
        at[less] = (np.flatnonzero(less) + window - 1 - back)
    return at[np.r_[True, at[1:] != at[:-1]]] if (at[1:] >= at[:-1]).all() else np.unique(at)


def _codes(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def close(a: str, b: str) -> bool:
    """Words equal up to damaged letters: one edit, two from eight letters on."""
    if a == b:
        return True
    n, m = len(a), len(b)
    most = 0 if min(n, m) < 3 else 1 if min(n, m) < 8 else 2
    if abs(n - m) > most or (a[0] != b[0] and a[-1] != b[-1]):
        return False
    i, most_i = 0, min(n, m)
    while i < most_i and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    if max(len(a), len(b)) <= most or (most and a == b[::-1] and len(a) == 2):
        return True
    if most < 2:
        return False
    n, m = len(a), len(b)
    # two edits, far apart: rows of the edit table, swapped neighbours two rows back
    before: list[int] = []
    last = list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return False
        before, last = last, row
    return last[m] <= most


@lru_cache(maxsize=100_000)
def _letters(word: str) -> int:
    """The letters that occur, as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _reached(bits: int, skip: int) -> int:
    """The next ``skip`` places after each bit."""
    out = 0
    for step in range(1, skip + 1):
        out |= bits << step
    return out


class Item:
    """A passage prepared for alignment. ``formulas``: its sentences that stand in many items."""

    def __init__(self, item_id: int, passage: str, formulas: Iterable[str] = ()) -> None:
        self.id, self.sentences = item_id, sentences(passage)
        self.words = [w for s in self.sentences for w in s]
        self.of = [i for i, s in enumerate(self.sentences) for _ in s]
        self.letters = "".join(self.words)
        ends = np.cumsum([0, *map(len, self.sentences)]).tolist()
        self.spans = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
        # letters of sentences that count
        known = set(formulas)
        self.counts = np.repeat([_sentence_key(s) not in known for s in self.sentences], [sum(map(len, s)) for s in self.sentences]).astype(bool)
        self.at: dict[str, int] = defaultdict(int)
        for i, w in enumerate(self.words):
            self.at[w] |= 1 << i
        # a damaged word keeps its first or its last letter
        self.first: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.last: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w in dict.fromkeys(self.words):
            if len(w) > 2:
                self.first[w[0]].append((w, _letters(w)))
                if w[0] != w[-1]:
                    self.last[w[-1]].append((w, _letters(w)))
        self.masks: dict[str, int] = {}

    def mask(self, word: str) -> int:
        """Bits of the passage's words that the word may stand for."""
        known = self.masks.get(word)
        if known is None:
            known = self.at.get(word, 0)
            n = len(word)
            if not known and n > 2:
                letters = _letters(word)
                for near in (self.first.get(word[0], ()), self.last.get(word[-1], ())):
                    for w, own in near:
                        # an edit changes two of the letters that occur at most
                        if (letters ^ own).bit_count() <= 4 and -3 < len(w) - n < 3 and close(w, word):
                            known |= self.at[w]
            if len(self.masks) < 50_000:
                self.masks[word] = known
        return known

    def carried(self, region: list[str], run_words: int = 4, skip: int = 3, least: int = 15) -> list[int]:
        """Positions of passage words carried together: aligned words in runs that
        skip fewer than ``skip`` words on either side, short runs left out."""
        masks = self.stand_for(region)
        if not self.may_count(masks, run_words, skip, least):
            return []
        out: list[int] = []
        run: list[tuple[int, int]] = []
        for pair in [*self.align(region, masks), (1 << 30, 1 << 30)]:
            if run and (pair[0] - run[-1][0] > skip or pair[1] - run[-1][1] > skip):
                if len(run) >= run_words:
                    out += [p for p, _ in run]
                run = []
            run.append(pair)
        return out

    def stand_for(self, region: list[str]) -> list[int]:
        """The passage words that each word of the region may stand for, alone or joined with the next."""
        known, joined, out = self.masks, self.at, []
        for w, following in zip(region, [*region[1:], ""]):
            m = known.get(w)
            out.append((self.mask(w) if m is None else m) | joined.get(w + following, 0))
        return out

    def may_count(self, masks: list[int], run_words: int, skip: int, least: int) -> bool:
        """Whether words enough, or a whole sentence, may be matched at all, and some of them in a run."""
        union = 0
        for m in masks:
            union |= m
        if union.bit_count() < least and not any(s & union == s for s in self.spans):
            return False
        # ends[k]: passage words at which a run of k + 1 may end, for each of the last ``skip`` words of the region
        ends = [[0] * skip for _ in range(run_words - 1)]
        for i, now in enumerate(masks):
            m, slot = now, i % skip
            for last in ends:
                before = 0
                for x in last:
                    before |= x
                last[slot] = now
                if now:
                    now = m & _reached(before, skip) if before else 0
            if now:
                return True
        return False

    def align(self, region: list[str], masks: list[int] | None = None) -> list[tuple[int, int]]:
        """(passage word, region word) matched in order: a longest common subsequence."""
        n = len(self.words)
        full = (1 << n) - 1
        rows, v = [], full
        for m in self.stand_for(region) if masks is None else masks:
            if u := v & m:
                v = ((v + u) | (v - u)) & full
            rows.append(v)
        out, j = [], n - 1
        for i in range(len(region) - 1, -1, -1):
            if j < 0:
                break
            if rows[i] is (rows[i - 1] if i else full):  # nothing was matched here
                continue
            # bits of a row that are 0 up to j: the length for the first j + 1 words
            low = (1 << (j + 1)) - 1
            here = j + 1 - (rows[i] & low).bit_count()
            above = 0 if i == 0 else j + 1 - (rows[i - 1] & low).bit_count()
            if here == above:
                continue
            while j >= 0 and j - (rows[i] & (low >> 1)).bit_count() == here:
                j, low = j - 1, low >> 1
            out.append((j, i))
            j -= 1
        return out[::-1]


class Index:
    """All fingerprints of the held-out items: (item id, passage) and perhaps its formulas."""

    def __init__(self, items: list[tuple], rules: Rules) -> None:
        self.rules = rules
        self.items = [x for i in items if (x := Item(*i)).words]
        hashes, owners, places, counts = [], [], [], []
        for n, item in enumerate(self.items):
            h = kgram_hashes(_codes(item.letters), rules.k)  # every one: a superset of the winnowed
            hashes.append(h)
            owners.append(np.full(len(h), n))
            places.append(np.arange(len(h)))
            # a k-gram counts if it lies beside the formulas
            sums = np.r_[0, np.cumsum(item.counts)]
            counts.append(sums[rules.k :] - sums[: -rules.k] == rules.k if len(h) else np.zeros(0, bool))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.zeros(0, np.int64)
        self.counts = np.concatenate(counts)[order] if hashes else np.zeros(0, bool)
        # low bits of the hashes there are: most of a text's are ruled out by one look
        self.bits = np.uint64((1 << max(16, (32 * len(flat)).bit_length())) - 1)
        self.there = np.zeros(int(self.bits) + 1, bool)
        self.there[self.hashes & self.bits] = True

    def carried(self, text: str | None) -> Iterator[tuple[int, list[int], Item, int, int]]:
        """(item id, matched passage words, item, sketch of the text beside it, first word) of each place
        where an item has hits enough."""
        tokens = words(text) if text else []
        if not tokens or not len(self.hashes):
            return
        joined = "".join(tokens)
        hashes = kgram_hashes(_codes(joined), self.rules.k)
        picked = winnow(hashes, self.rules.window)
        some = picked[self.there[hashes[picked] & self.bits]]
        if not len(some):
            return
        h = hashes[some]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        times = hi - lo
        if times.sum() < self.rules.min_hits:  # whatever other items the index holds
            return
        at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        q, owner, place, counts = np.repeat(some, times), self.owners[at], self.places[at], self.counts[at]
        # an item with few hits, or with none beside its formulas, is nothing here
        kept = np.bincount(owner, minlength=len(self.items)) >= self.rules.min_hits
        kept &= np.bincount(owner[counts], minlength=len(self.items)) > 0
        kept = kept[owner]
        if not kept.any():
            return
        q, owner, place, counts = q[kept], owner[kept], place[kept], counts[kept]
        # a carried span lies on one diagonal, insertions and damage aside
        bands: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for phase in (0, self.rules.band // 2):
            key = owner * (1 << 40) + (q - place + phase) // self.rules.band + (1 << 39)
            order = key.argsort(kind="stable")  # hits come in the order of the text
            k = key[order]
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a >= self.rules.min_hits:
                    part = order[a:b]
                    found = (len(set(place[part].tolist())), int(q[part[0]]), int(q[part[-1]]))
                    if found[0] >= self.rules.min_hits:
                        bands[int(owner[part[0]])].append(found)
        if not bands:
            return
        starts = np.cumsum([0, *map(len, tokens)])
        for n, found in bands.items():
            item = self.items[n]
            mine = owner == n
            beside = np.ones(len(hashes), bool)
            beside[q[mine]] = False
            beside = hashes[picked[beside[picked]]]
            own = q[mine & counts]
            sketch = int(beside.min().view(np.int64)) if len(beside) else 0  # copies share it, light corrections mostly
            covered: list[tuple[int, int]] = []
            for _, first, last in sorted(found, reverse=True):
                i = max(0, int(np.searchsorted(starts, first)) - len(item.words))
                j = min(len(tokens), int(np.searchsorted(starts, last)) + len(item.words))
                if not any(a <= i and j <= b for a, b in covered):
                    i, j = max(0, i - 20), min(len(tokens), j + 20)
                    covered.append((i, j))
                    if not ((own >= starts[i]) & (own < starts[j])).any():  # formulas alone
                        continue
                    yield item.id, item.carried(tokens[i:j], self.rules.run_words, least=self.rules.min_words), item, sketch, i


def _sentence_key(ws: list[str]) -> str:
    return " ".join(ws)


CARRIED = "doc_id bigint, item_id bigint, sentence string, matched int, whole boolean, elsewhere int, speech bigint, sketch bigint, place bigint"
_CARRIED = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("sentence", pa.string()), ("matched", pa.int32()), ("whole", pa.bool_()), ("elsewhere", pa.int32()), ("speech", pa.int64()), ("sketch", pa.int64()), ("place", pa.int64())])


def _judge(doc: int, speech: int, item_id: int, matched: list[int], item: Item, sketch: int, place: int, rules: Rules) -> Iterator[tuple]:
    per = defaultdict(int)
    for p in matched:
        per[item.of[p]] += 1
    total = len(matched)
    if total >= rules.min_words or any(n == len(item.sentences[s]) for s, n in per.items()):
        for s, n in per.items():
            yield doc, item_id, _sentence_key(item.sentences[s]), n, n == len(item.sentences[s]), total - n, speech, sketch, place


def item_sentences(items: DataFrame) -> DataFrame:
    """(sentence, item_id), once each."""

    def split(batches):
        schema = pa.schema([("sentence", pa.string()), ("item_id", pa.int64())])

        def rows():
            for b in batches:
                for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for s in sentences(p):
                        yield _sentence_key(s), i

        yield from record_batches(rows(), schema)

    return items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").mapInArrow(split, "sentence string, item_id bigint").distinct()


def in_items(items: DataFrame) -> DataFrame:
    """(sentence, n): in how many items a sentence stands."""
    return item_sentences(items).groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


def with_formulas(items: DataFrame, rules: Rules) -> DataFrame:
    """(item_id, passage, formulas): each item with its sentences that stand in many items."""
    known = in_items(items).where(F.col("n") >= rules.formula_items).select("sentence")
    own = item_sentences(items).join(known, "sentence").groupBy("item_id").agg(F.collect_list("sentence").alias("formulas"))
    out = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").join(own, "item_id", "left")
    return out.select("item_id", "passage", F.coalesce("formulas", F.array().cast("array<string>")).alias("formulas"))


def carried_sentences(documents: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document, item, place and sentence of its passage: the words matched in order."""
    spark = documents.sparkSession
    speech = F.coalesce(F.col("reissue_of").cast("bigint"), "doc_id") if "reissue_of" in documents.columns else F.col("doc_id")
    docs = spread(documents.select("doc_id", "text", speech.alias("speech")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), "doc_id")
    items = checkpointed(with_formulas(items, rules))  # read three times
    letters = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    if letters <= rules.broadcast_fingerprints:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])

        def run(batches):
            index = Index(shared.value, rules)

            def rows():
                for b in slices(batches):
                    for doc, text, speech in zip(*(c.to_pylist() for c in b.columns)):
                        for item_id, matched, item, sketch, place in index.carried(text):
                            yield from _judge(doc, speech, item_id, matched, item, sketch, place, rules)

            yield from record_batches(rows(), _CARRIED)

        return docs.mapInArrow(run, CARRIED)

    # too many items for a task: pairs that share fingerprints meet first
    def prints(winnowed):
        schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("p", pa.int64())])

        def run(batches):
            def rows():
                for b in slices(batches):
                    for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        h = kgram_hashes(_codes("".join(words(text))), rules.k)
                        for p in winnow(h, rules.window).tolist() if winnowed else range(len(h)):
                            yield i, int(h[p : p + 1].view(np.int64)[0]), p

            yield from record_batches(rows(), schema)

        return run

    of_docs = docs.select("doc_id", "text").mapInArrow(prints(True), "id bigint, h bigint, p bigint").select(F.col("id").alias("doc_id"), "h").distinct()
    of_items = items.mapInArrow(prints(False), "id bigint, h bigint, p bigint").select(F.col("id").alias("item_id"), "h", "p").distinct()
    pairs = of_docs.join(of_items, "h").groupBy("doc_id", "item_id").agg(F.countDistinct("p").alias("n")).where(F.col("n") >= rules.min_hits)
    pairs = pairs.join(docs, "doc_id").join(items, "item_id").select("doc_id", "text", "speech", "item_id", "passage", "formulas")

    def align(batches):
        def rows():
            for b in slices(batches):
                for doc, text, speech, item_id, passage, formulas in zip(*(c.to_pylist() for c in b.columns)):
                    for _, matched, item, sketch, place in Index([(item_id, passage, formulas)], rules).carried(text):
                        yield from _judge(doc, speech, item_id, matched, item, sketch, place, rules)

        yield from record_batches(rows(), _CARRIED)

    return pairs.mapInArrow(align, CARRIED)


def leaks(documents: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, item_id, word_count) of documents that carry enough of a passage, formulas aside."""
    spark = documents.sparkSession
    carried = checkpointed(carried_sentences(documents, items, rules))  # few rows, read twice

    known = in_items(items)
    least = F.greatest(F.lit(float(rules.formula_docs)), F.lit(rules.formula_share * documents.count()))
    alone = carried.where("whole AND elsewhere < 5").join(known, "sentence")
    alone = alone.where((F.col("n") > 1) | (F.col("matched") + F.col("elsewhere") < rules.min_words))
    alone = alone.groupBy("sentence", "speech").agg(F.min("sketch").alias("sketch"))  # reissues are one, copies share the sketch
    alone = alone.groupBy("sentence").agg(F.countDistinct("sketch").alias("speeches")).where(F.col("speeches") >= least)
    formulas = alone.select("sentence").unionByName(known.where(F.col("n") >= rules.formula_items).select("sentence")).distinct()
    own = carried.join(formulas, "sentence", "left_anti").dropDuplicates(["doc_id", "item_id", "sketch", "place", "sentence", "matched"])
    out = own.groupBy("doc_id", "item_id", "sketch", "place").agg(F.sum("matched").alias("word_count"))
    out = out.groupBy("doc_id", "item_id").agg(F.max("word_count").alias("word_count"))
    return out.where(F.col("word_count") >= rules.min_words)
