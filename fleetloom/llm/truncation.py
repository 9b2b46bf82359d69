"""Texts cut off by field limits or in transfer (problem 10).

A stack automaton reads the structural marks of the whole text: brackets, quotes
and the tags of markup open and close on one stack, however far apart; escapes and
characters may be broken at the end. Together with the last visible character the
end state tells how a text stops. What is missing counts against
the baseline of its source: where most texts end without a terminator, a missing
one is no evidence, unless the text has exactly the source's limit length or stops
inside a word: its last word stands nowhere else in the corpus but begins one that
does.

Defined cases: null, empty and blank texts are not cut; a null source is a source
of its own; repeated document ids are judged row by row; empty input gives an
empty result.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.streams import slices
from fleetloom.session import checkpointed, spread

# fixed values: closing marks of each opening mark
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】"}
CLOSERS = frozenset(PAIRS.values())
# fixed values: sentence ends and dashes of common scripts
ENDS = frozenset(".!?。！？．؟۔।॥‽⁇⁈⁉")
DASHES = frozenset("—–―‒")
# fixed values: elements of markup that hold text; others may stand alone
ELEMENTS = frozenset("html body div p span b i u em strong a ul ol li table tr td th h1 h2 h3 h4 h5 h6 blockquote section article q cite sup sub pre code".split())
_STRUCTURE = re.compile(r'(?P<face>[:;=]-?[()\[\]](?=\s|$))|<(?P<slash>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)\b[^<>]*?(?P<alone>/?)>|\\[\\"]|(?P<mark>["()\[\]{}“”«»「」『』（）【】])')
_DOTS = re.compile(r"(?:…|\.\s?\.\s?\.|\.\.)$")
# an entity, an escape, a percent code or a tag that only begins
_HALF = re.compile(r"(?:&#?\w*|\\u?[0-9a-fA-F]{0,3}|%[0-9a-fA-F]?)$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TAG_HEAD = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+(?:=(?:"[^"]*"?|'[^']*'?|[^\s"'=]*))?)*\s*/?""")


def open_marks(text: str) -> list[int]:
    """Offsets of marks still open at the end. A straight quote opens where none
    is open; a closing mark or tag pops through what it leaves unclosed inside.
    Faces such as ``:(`` and escaped quotes are no marks."""
    stack: list[tuple[str, int]] = []
    for m in _STRUCTURE.finditer(text):
        c, tag = m["mark"], m["tag"]
        if tag:
            tag = tag.lower()
            if m["slash"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == f"<{tag}":
                        del stack[i:]
                        break
            elif tag in ELEMENTS and not m["alone"]:
                stack.append((f"<{tag}", m.start()))
        elif c == '"':
            inside = [i for i, (x, _) in enumerate(stack) if x == '"']
            if inside:
                del stack[inside[-1] :]
            else:
                stack.append((c, m.start()))
        elif c in PAIRS:
            # the same character closes low quotes in some languages
            stack.append((c, m.start()))
        elif c in CLOSERS:
            for i in range(len(stack) - 1, -1, -1):
                if PAIRS.get(stack[i][0]) == c:
                    del stack[i:]
                    break
    return [at for _, at in stack]


def tag_begun(text: str) -> bool:
    """Whether the text stops inside a tag."""
    at = text.rfind("<")
    return at >= 0 and ">" not in text[at:] and _TAG_HEAD.fullmatch(text, at) is not None


def visible(text: str) -> str:
    """The text without trailing blanks, controls and zero-width characters."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cf", "Cc", "Mn")):
        end -= 1
    return text[:end]


def ending(text: str | None) -> tuple[str, bool]:
    """How a text stops (empty, broken, open, dots, terminated, dash, bare), and
    whether that is evidence by itself that it was cut."""
    shown = visible(text) if text else ""
    if not shown:
        return "empty", False
    last = shown[-1]
    tail = shown[max(shown.rfind(c) for c in " \n\t") + 1 :]  # the last word with what hangs on it
    if last == "�" or 0xD800 <= ord(last) <= 0xDFFF or _HALF.search(tail) or tag_begun(shown):
        return "broken", True
    if _DOTS.search(shown[-5:]):  # five characters are the longest that it matches
        return "dots", True
    if last not in CLOSERS and last != '"' and open_marks(shown):
        return "open", True
    while last == ">" and (at := shown.rfind("<")) >= 0 and _TAG.fullmatch(shown, at):  # whole tags behind the words
        shown = visible(shown[:at])
        if not shown:
            return "empty", False
        last = shown[-1]
    if last in DASHES or (last == "-" and (len(shown) < 2 or not shown[-2].isalnum() or shown[-2:] == "--")):
        return "dash", False
    if last in ENDS:
        return "terminated", False
    if last in CLOSERS or last in "\"'’”»“":
        inner = visible(shown.rstrip("\"'’”»“)]}）」』】"))
        return ("terminated", False) if inner else ("bare", False)
    return "bare", False


_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def last_word(text: str | None) -> str | None:
    """The word that the text stops with, for the comparison with the corpus."""
    shown = visible(text) if text else ""
    start = len(shown)
    while start and _LETTER.match(shown[start - 1]):
        start -= 1
    return shown[start:].lower() or None


ENDINGS = "doc_id bigint, source string, length int, ending string, cut boolean, last string"


def endings(documents: DataFrame) -> DataFrame:
    """Each document's source, length and ending."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            found = [ending(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) if t is not None else None for t in texts], pa.int32()), pa.array([e for e, _ in found]), pa.array([c for _, c in found]),
                 pa.array([last_word(t) if e == "bare" else None for t, (e, _) in zip(texts, found)], pa.string())],
                names=["doc_id", "source", "length", "ending", "cut", "last"],
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "source", "text"), "doc_id").mapInArrow(run, ENDINGS)


def baselines(found: DataFrame) -> DataFrame:
    """Per source: whether a bare end is unusual, and the length at which it caps texts."""
    shown = found.where("ending <> 'empty'")
    by_length = shown.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ending") == "bare").alias("bare"))
    return by_length.groupBy("source").agg(
        (F.sum("bare") < 0.5 * F.sum("n")).alias("bare_is_odd"), F.max("length").alias("longest")
    )


def broken_words(documents: DataFrame, last: DataFrame) -> DataFrame:
    """The words of ``last`` that stand whole in no text, but with which such a word begins.
    The last word of a text without terminator isn't sure to be whole."""

    def run(batches):
        for b in slices(batches):
            found: set[str] = set()
            for t in b.column(0).to_pylist():
                whole = _WORD.findall(t)
                found.update(w.lower() for w in (whole if ending(t)[0] == "terminated" else whole[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    known = spread(documents.select("text", "doc_id").where("text IS NOT NULL"), "doc_id").select("text").mapInArrow(run, "word string").distinct()
    known = checkpointed(known)  # the words of the corpus, read twice
    begun = known.select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("n"), "word").where("n < length(word)")
    begun = begun.select(F.substring("word", F.lit(1), F.col("n")).alias("last")).distinct()
    return last.distinct().join(known.withColumnRenamed("word", "last"), "last", "left_anti").join(begun, "last", "left_semi")


def judged(documents: DataFrame) -> DataFrame:
    """Every document with its ending and the verdict ``cut``."""
    found = checkpointed(endings(documents))  # a few bytes per text, read twice
    base = checkpointed(baselines(found).withColumnRenamed("source", "__source"))  # a row per source
    at_limit = F.col("length") == F.col("longest")
    odd = F.coalesce(F.col("bare_is_odd"), F.lit(True))
    out = found.join(base, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("odd", odd)
    broken = F.lit(False)
    if not base.where("NOT bare_is_odd").isEmpty():  # the corpus is read for its words only where bare ends prevail
        words = broken_words(documents, out.where("NOT odd AND ending = 'bare' AND last IS NOT NULL").select("last"))
        out = out.join(words.withColumn("broken", F.lit(True)), "last", "left")
        broken = F.coalesce(F.col("broken"), F.lit(False))
    cut = F.col("cut") | ((F.col("ending") == "bare") & (F.col("odd") | at_limit | broken))
    return out.withColumn("cut", cut).select("doc_id", "source", "length", "ending", "cut")


def cut_texts(documents: DataFrame) -> DataFrame:
    return judged(documents).where("cut").select("doc_id")


def cut_rates(documents: DataFrame) -> DataFrame:
    """(source, text_count, cut_count, cut_share) over all texts of a source that show anything."""
    return (
        judged(documents).groupBy("source")
        .agg(F.count_if(F.col("ending") != "empty").alias("text_count"), F.count_if("cut").alias("cut_count"))
        .withColumn("cut_share", F.round(F.col("cut_count") / F.nullif(F.col("text_count"), F.lit(0)), 6))
    )
