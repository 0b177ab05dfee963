"""Pages whose text is mostly repeated keywords, link lists or product tags instead of sentences.

A text is read as a sequence of terms: words, links and tags. Which words are function words is learned from the corpus:
those that are spread over the documents of a language. Lines that hold far fewer of them than the language's sentences
do are keywords if their terms recur unnaturally regularly (recurrence gaps of neighbouring terms against the text's own
shuffled order, autocorrelation over windows of lags), or if the language is known and they are lists without function
words. A text is spam if the lines found to be keywords, links or tags hold most of its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.session import discarded, written

#: A word is common (a function word, or as widespread) if this share of a language's documents has it, and known if
#: this one has; a language counts if so many documents, and this share of all labelled ones, are labelled with it.
COMMON, KNOWN, LEAST_DOCS, LEAST_SHARE = 0.15, 0.003, 30, 0.01
#: Bound of the model: words of a language that are kept, the most widespread.
WORDS = 5000
#: Shares that decide: of a language's usual share of common words, below which a line has few, and lists have none; of
#: recurring terms, in a known language and in a strange one; of known words, from which a text's language is known; of a text, from which it is spam.
FEW, BARE, REGULAR, REGULAR_STRANGE, FAMILIAR, MOST = 0.5, 0.2, 0.35, 0.6, 0.5, 0.5
#: Chance below which it is none that different words hold no common one.
CHANCE = 0.001
#: Terms apart at which a recurrence is close; terms of a line that is no verse.
CLOSE, SHORT = 40, 3
#: Length from which a line of one or two characters over and over is padding.
PADDING = 40

_CUE = re.compile(r"\s*(?:[\dOoIl]{1,7}|WEBVTT.*|NOTE\b.*|[\dOoIl:.,\s]*-\s?-\s?>.*)\s*")
_STYLE = re.compile(r"</?(?:i|b|u|font|span|c)\b[^>]*>|\{\\[^}]*\}", re.I)
_DOT = r"(?:\s?\[\.\]\s?|\s?\(\.\)\s?|\s\.\s|\.|\s+dot\s+)"
#: A written link: with a scheme, www or path, or a name and a label of letters joined by a dot (or what stands for one)
#: without a blank on one side only, as the end of a sentence has.
_LINK = re.compile(rf"<a\s[^>]*>|https?://\S+(?:{_DOT}[\w-]+)*(?:/\S*)?|\bwww{_DOT}[\w-]+(?:{_DOT}[\w-]+)*(?:/[\w/.-]*)?|\b[^\W_][\w-]+(?:{_DOT}[\w-]+)*?{_DOT}[a-z]{{2,}}\b(?:/[\w/.-]*)?", re.I)
_TAG = re.compile(r"#\w[\w-]*|\b[^\W_]+(?:[-_][^\W_]+)+\b")
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_WORD = re.compile(r"[^\W\d_]\w*(?:['’]\w+)*")
_MIXED_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+|[^\W\d_\u3040-\u30ff\u3400-\u9fff][^\W\u3040-\u30ff\u3400-\u9fff]*(?:['’][^\W\u3040-\u30ff\u3400-\u9fff]+)*")
#: Most cue numbers and times, in any text.
_CUES = re.compile(r"(?m)^[\d:., ]*-->[\d:., ]*$|^\d+$")
#: Sounds and songs; of a note sign lost on the way a question mark is left.
_ASIDE = re.compile(r"^[-–—\s]*(?:\[.*\]|\(.*\)|\*.*\*|♪.*|#\s.*|.*♪|\?\s.*\s\?)$")
#: A credit: a role and names.
_CREDIT = re.compile(r"^[-–—\s]*[^\W\d][^:|]{1,40}:(?:\s+(?:[A-Z][\w.]*|[&,+]|and|e|et|y|und|и))+\s*$")
_MIXED, _LETTERS, _LATIN = re.compile("[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]"), re.compile(r"[^\W\d_]+"), re.compile("[A-Za-z]")
#: Cheap tests before the full patterns.
_LINKLIKE, _TAGLIKE = re.compile(r"\.\w|\.[\])]|\s\.\s|\bdot\b|http|www|<a\s", re.I).search, re.compile(r"#\w|\w[-_]\w").search
_BLANKS = (" ", "\t", "\xa0", "\u3000")
_ENDS = ".?!…,\"'”»)] "
_INVISIBLE = {c: None for c in (*range(0x200B, 0x2010), *range(0x2028, 0x202F), *range(0x2060, 0x2070), 0xAD, 0xFEFF)}
_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]").search
#: Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіАВЕКМНОРСТХ", "aeopcyxiABEKMHOPCTX")


def _bytes_of(encoding: str) -> dict[int, bytes]:
    """Characters that an 8-bit encoding makes of bytes; bytes it leaves undefined stand for themselves."""
    return {ord(bytes([b]).decode(encoding, "ignore") or chr(b)): bytes([b]) for b in range(128, 256)}


_WRONG = [_bytes_of(e) for e in ("cp1252", "mac_roman")]
#: The first two characters of a multi-byte sign of UTF-8 taken for another encoding.
_MISREAD = re.compile("[Â-ô√ƒ¬≈∆«‚„‰Ä-Öœ–—“”‘’÷◊ÿŸ⁄€‹›][^\x00-\x7f]")


def mended(text: str) -> str:
    """The text read anew as long as it is UTF-8 that was taken for another encoding, up to three times; else as it is.
    Bytes may have been lost on the way: a tenth, or more where the text becomes much shorter."""
    for _ in range(3):
        if not _MISREAD.search(text):
            return text
        for back in _WRONG:
            again = b"".join(back.get(ord(c)) or (c.encode() if c < "\x80" else b"\xff") for c in text).decode("utf-8", "replace")
            lost = again.count("\ufffd") / max(1, len(again))
            if len(again) < len(text) and lost <= 0.1 or len(again) < 0.75 * len(text) and lost <= 0.5:
                text = again
                break
        else:
            return text
    return text


def _plain(line: str) -> str:
    """A line without invisible characters, compatibility forms, markup, and Latin look-alikes within Latin words."""
    if "<" in line or "{" in line:
        line = _STYLE.sub("", line)
    if line.isascii():
        return line.strip()
    line = mended(line)
    line = unicodedata.normalize("NFKC", line.translate(_INVISIBLE) if _HIDDEN(line) else line)
    if _MIXED.search(line):
        line = _LETTERS.sub(lambda m: m[0].translate(_ALIKE) if _LATIN.search(m[0]) else m[0], line)
    return line.strip()


def words_of(text: str) -> list[str]:
    """Lower-case words, numbers left out; writing without blanks between words gives its pairs of neighbouring signs."""
    if text.isascii() or not _UNSPACED.search(text):
        return _WORD.findall(text.lower())
    found = _MIXED_WORD.findall(text.lower())
    out = []
    for w in found:
        out += ([w[i : i + 2] for i in range(len(w) - 1)] or [w]) if _UNSPACED.match(w) else [w]
    return out


@dataclass(frozen=True)
class Model:
    """What is learned of each language: common words, their usual share of a text's words, and known words."""

    common: dict[str, frozenset] = field(default_factory=dict)
    usual: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()

    def language(self, there: set[str]) -> str | None:
        """The language of which most of a text's different words are common; one word alone names none."""
        hits = {k: len(there & c) for k, c in self.common.items()}
        best = max(hits, key=lambda k: (hits[k], k), default=None)
        return best if best and hits[best] > 1 else None


def count_words(texts: Iterable[str | None], labels: Iterable[str | None]) -> Counter:
    """(label, word) -> (documents, occurrences); the word '' has the label's documents and all occurrences."""
    documents, occurrences = defaultdict(Counter), defaultdict(Counter)
    for text, label in zip(texts, labels, strict=True):
        if text and label:
            words = words_of(text)
            occurrences[label].update(words)
            documents[label].update({"", *words})
    for n in occurrences.values():
        n[""] = n.total()
    return Counter({(label, w): (n, occurrences[label][w]) for label, c in documents.items() for w, n in c.items()})


def model_of(rows: Iterable[tuple[str, str, int, int]]) -> Model:
    """The model of counted words (label, word, documents, occurrences) of the labels that count."""
    rows = list(rows)
    whole = {r[0]: r for r in rows if r[1] == ""}
    common, tf, known = {}, Counter(), set()
    for label, word, docs, times in rows:
        if word and docs >= KNOWN * whole[label][2]:
            known.add(word)
        if word and docs >= COMMON * whole[label][2]:
            common.setdefault(label, set()).add(word)
            tf[label] += times
    return Model({k: frozenset(v) for k, v in common.items()}, {k: tf[k] / max(1, whole[k][3]) for k in common}, frozenset(known))


def recurrences(terms: list) -> np.ndarray:
    """For each term, the gap to its nearest other occurrence, or a number beyond the text."""
    n = len(terms)
    gap = np.full(n, n + 1)
    last: dict = {}
    for i, w in enumerate(terms):
        j = last.get(w)
        if j is not None:
            gap[i] = i - j
            if i - j < gap[j]:
                gap[j] = i - j
        last[w] = i
    return gap


def autocorrelation(words: list[str]) -> float:
    """The largest share, over windows of lags, of words that equal one in the window before them.

    The windows double in width and so cover every lag up to half the text. What the same words in any order would have
    (a word of frequency f is met in a window of w lags with 1 - (1 - f)^w) is no regularity: of a window counts the
    excess over it, unless one word is met at nearly every lag anyway.
    """
    n = len(words)
    if n < 4:
        return 0.0
    codes = np.unique(np.array(words, object).astype(str), return_inverse=True)[1]
    f = np.bincount(codes)[codes] / n
    if float(f.mean()) >= REGULAR:  # a text of hardly more than one word
        return float(f.mean())
    best, start, width = 0.0, 1, 8
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    while start <= n // 2:
        end = min(start + width, n)
        # the nearest occurrence at least `start` before: of the places of one word, the last that isn't later than i - start
        at = np.searchsorted(sorted_codes * n + order, codes * n + np.arange(n) - start, side="right") - 1
        ok = (at >= 0) & (sorted_codes[at] == codes)
        hit = ok & (np.arange(n) - order[at] < end)
        share, chance = float(hit[start:].mean()), float((1 - (1 - f[start:]) ** (end - start)).mean())
        best = max(best, (share - chance) / max(1e-9, 1 - chance) if chance < 1 else 0.0)
        start, width = end, width * 2
    return best


def regularity(lines: list[list[str]]) -> float:
    """How regularly the terms of different lines recur, from 0 (as in sentences) to 1.

    The largest of three: the share of terms that recur within CLOSE terms, beyond the half that sentences have at most;
    the share of neighbouring terms that recur as neighbours, beyond what the text's own terms have in shuffled order;
    and the autocorrelation. Repeated lines count once, unless they are short: a refrain is no list.
    """
    distinct, met = [], set()
    for t in map(tuple, lines):
        if len(t) <= SHORT or t not in met:
            met.add(t)
            distinct.append(t)
    terms = [w for t in distinct for w in t]
    n = len(terms)
    if n < 4:
        return 0.0
    close = max(0.0, 2 * float((recurrences(terms) <= min(CLOSE, n)).mean()) - 1)
    pairs = [p for t in distinct for p in zip(t, t[1:], strict=False)]
    seen = 0.0
    if pairs:
        again = recurrences(pairs) <= len(pairs)
        count = Counter(terms)
        chance = float(np.mean([1 - exp(-count[a] * count[b] / n) for a, b in pairs]))
        seen = max(0.0, float(again.mean()) - chance) / max(1e-9, 1 - chance) * len(pairs) / n
    return max(close, seen, autocorrelation(terms))


class Verdict(NamedTuple):
    share: float
    links: float
    tags: float
    keywords: float
    regularity: float
    function_words: float


class _Line(NamedTuple):
    size: int
    links: list[str]
    tags: list[str]
    words: list[str]
    loose: list[str]
    aside: bool
    unread: bool


#: Lines repeat over the documents of a corpus: the last ones read are kept.
@lru_cache(maxsize=50_000)
def _read(raw: str) -> _Line | None:
    """What a line holds; None for cues, blank lines, and one character over and over, which is no text."""
    line = "" if _is_cue(raw) else _plain(raw)
    if not line or len(line) >= PADDING and len(set(line)) <= 2:
        return None
    low = line.lower()
    linklike = ("." in low.rstrip(_ENDS) or "dot" in low or "http" in low or "www" in low or "<a" in low) and _LINKLIKE(line)
    links = [m[0].lower() for m in _LINK.finditer(line)] if linklike else []
    rest = _LINK.sub(" ", line) if links else line
    tags = [t for t in _TAG.findall(rest) if any(c.isalpha() for c in t)] if ("#" in rest or "-" in rest or "_" in rest) and _TAGLIKE(rest) else []
    words = words_of(rest)
    loose = words_of(_TAG.sub(" ", rest)) if tags else words  # "in-der-nähe" is one tag
    aside = not links and bool((line[0] in "[(*♪#?-–— " or line[-1] == "♪") and _ASIDE.match(line) or ":" in line and _CREDIT.match(line))
    unread = not line.isascii() and line.count("\ufffd") + len(_MISREAD.findall(line)) > 2  # words lost in a wrong encoding are no keywords
    return _Line(len(line) - sum(map(line.count, _BLANKS)), links, tags, words, loose, aside, unread)


def _is_cue(raw: str) -> bool:
    return not raw or ("-->" in raw or raw[-1:].isdigit() or raw[0] in " WN" or len(raw) < 40 and raw[-1:] in "OoIl:.,") and _CUE.fullmatch(raw) is not None


def judge(text: str | None, model: Model | None = None) -> Verdict:
    """Shares of a text's characters, cue numbers and times apart, that are spam, and of which kind.

    Without a model no language is known, and only regular repetition, links and tags count.
    """
    model = model or Model()
    rows = [r for raw in _CUES.sub("", text or "").splitlines() if raw and (r := _read(raw))]
    total = sum(r.size for r in rows)
    if not total:
        return Verdict(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    language = model.language(set().union(*[r.loose for r in rows]))
    common, least = model.common.get(language, frozenset()), FEW * model.usual.get(language, 0.0)
    is_common = common.__contains__
    many_links = len({k for r in rows for k in r.links}) > 1
    found, lists, n_common = Counter(), [], 0
    for r in rows:
        k = sum(map(is_common, r.loose))
        n_common += k
        few = k <= least * len(r.loose)
        if r.links:
            if many_links and (few or len(r.links) > 1):  # a single advert, however often repeated, is no list
                found["links"] += r.size
        elif few and r.words and not r.aside and not r.unread:
            if r.tags and 2 * sum(map(len, r.tags)) >= r.size:
                found["tags"] += r.size
            else:
                lists.append(r)
    regular = 0.0
    if lists and 2 * (sum(found.values()) + sum(r.size for r in lists)) >= total:  # else no verdict hangs on them
        regular = regularity([r.words for r in lists])
        words = [w for r in lists for w in r.words]
        familiar = sum(map(model.known.__contains__, words)) >= FAMILIAR * len(words)
        usual = model.usual.get(language) or sum(model.usual.values()) / max(1, len(model.usual))
        bare = sum(map(is_common, words)) <= BARE * usual * len(words)
        chance = (1 - usual) ** len(set(words))  # that so many different words of sentences aren't common
        if familiar and bare and chance < CHANCE or regular >= (REGULAR if familiar else REGULAR_STRANGE):
            found["keywords"] += sum(r.size for r in lists)
    parts = [found[k] / total for k in ("links", "tags", "keywords")]
    return Verdict(sum(parts), *parts, regular, n_common / max(1, sum(len(r.loose) for r in rows)))


SCORES = "spam_share double, link_share double, tag_share double, keyword_share double, regularity double, function_word_share double"


def _label(lang: Column) -> Column:
    """The first two letters of a language label in any spelling ('en', 'EN-us'), null where it has none."""
    two = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(two.rlike("^[a-z]{2}$"), two)


def learned(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> Model:
    """The model of a corpus: one pass over all documents, words counted per task before the shuffle.

    Sent to the driver: at most 1 / LEAST_SHARE languages of WORDS words each. Without a column of labels the common
    words are those of all documents and no word is known, as the corpus may be in several languages. A null text or label counts nothing; no language with enough documents gives an empty model.
    """
    label = _label(F.col(lang)) if lang else F.lit("all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = count_words(b[0].to_pylist(), b[1].to_pylist())
            keys, values = list(got), list(got.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([v[i] for v in values], pa.int64()) for i in (0, 1)]], ["label", "word", "docs", "times"])

    counts = docs.select(F.col(text), label.alias("label")).mapInArrow(run, "label string, word string, docs bigint, times bigint")
    counts = written(counts.groupBy("label", "word").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")), "words")
    whole = counts.where("word = ''")
    labelled = whole.agg(F.sum("docs")).first()[0] or 0
    size = whole.where(F.col("docs") >= max(LEAST_DOCS, LEAST_SHARE * labelled)).select("label", F.col("docs").alias("all_docs"))  # at most 1 / LEAST_SHARE rows
    wide = counts.join(F.broadcast(size), "label").where(F.col("docs") >= KNOWN * F.col("all_docs"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("docs"), "word"))  # words that a share of documents has: few
    rows = wide.withColumn("rank", rank).where(F.col("rank") <= WORDS + 1).select("label", "word", "docs", "times").collect()
    discarded(counts)
    model = model_of(map(tuple, rows))
    return model if lang else replace(model, known=frozenset())


def spam_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = "lang", model: Model | None = None) -> DataFrame:
    """(key, spam_share and its kinds, regularity, function_word_share) of each document, whole texts.

    The model is learned from docs unless given; without the label column only regular repetition makes keywords. A null, empty or
    blank text, or one of cue numbers and times only, has shares of 0.
    """
    model = model or learned(docs, text, lang if lang in docs.columns else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t, model) for t in b[1].to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b[0], *cols], [key, *[s.split()[0] for s in SCORES.split(", ")]])

    slim = docs.select(key, text)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, {SCORES}")


def spam(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return spam_scores(docs, text, key).where(F.col("spam_share") > MOST)
