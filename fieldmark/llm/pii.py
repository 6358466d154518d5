"""Personal data: e-mail and IP addresses, payment cards and phone numbers, also disguised ones.

A text goes through a chain of transducers. Each rewrites the text and carries, for every character,
the span of source characters that it stands for: look-alike letters, widths and digits become ASCII
and invisible characters go; spelled digits become digits; disguised ``at`` and ``dot`` become signs.
The detectors then run over the rewritten text, and their spans are mapped back to the source.

The same detectors run over the source itself. Those spans are the base ones and always stay; a span
from the rewritten text is added unless it lies in a base span of its kind. A text that no transducer
changes is not searched again.

Defined cases: a null or empty text has no spans; repeated rows are searched one by one; spans count
code points, with an exclusive end; extra columns are not returned; every scan is linear in the text
but for the groups of digits that one dot joins to the next.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, spread

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that are drawn like an ASCII letter, and that letter.
CYRILLIC = "аАвВсСԁеЕгһНіІјЈкКӏмМоОрРԛѕЅтТуУԝхХ"
CYRILLIC_AS = "aABBcCdeErhHiIjJkKlmMoOpPqsStTyYwxX"
GREEK = "αΑΒεΕιΙκΚΜνΝοΟρΡτΤυΥΧΖΗ"
GREEK_AS = "aABeEiIkKMvNoOpPtTuYXZH"
LATIN = "ɑɡıȷ"
LATIN_AS = "agij"
# Signs that are drawn like an ASCII sign, and characters that are not drawn.
SIGNS = {
    "-": "\u00ad\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\ufe58\ufe63",
    ".": "\u00b7\u2024\u2219\u22c5\u3002\u30fb\ufe52\uff61",
    "+": "\ufe62\u2795",
    " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
}
UNSEEN = "\u200b\u200c\u200d\u200e\u200f\u180e\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"
# Spelled digits in English, German, French and Spanish.
DIGITS = {
    "0": ("zero", "oh", "null", "zéro", "cero"),
    "1": ("one", "eins", "un", "uno"),
    "2": ("two", "zwei", "zwo", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"),
    "4": ("four", "vier", "quatre", "cuatro"),
    "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sieben", "sept", "siete"),
    "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"),
}
TIMES = {"double": 2, "triple": 3}
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = ("at", "arroba", "arobase")


@cache
def lookalikes() -> np.ndarray:
    """ASCII code of every look-alike by code point, 0 for unseen characters, else the code itself.
    Widths, styled letters and digits of all scripts come from the Unicode tables."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x20000)]):
        kind = unicodedata.category(c)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-_%()"):
            out[ord(c)] = ord(plain)
        elif kind == "Nd":
            out[ord(c)] = 0x30 + unicodedata.digit(c)
    for scripts, plain in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (LATIN, LATIN_AS)):
        for c, a in zip(scripts, plain, strict=True):
            out[ord(c)] = ord(a)
    for a, signs in SIGNS.items():
        for c in signs:
            out[ord(c)] = ord(a)
    for c in UNSEEN:
        out[ord(c)] = 0
    return out


@dataclass(frozen=True)
class Traced:
    """A rewritten text; character k stands for the source characters starts[k] .. ends[k] - 1."""

    text: str
    starts: np.ndarray
    ends: np.ndarray

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace each (start, end, new) span, given in order; all characters of ``new`` stand for
        the whole span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            starts += [self.starts[at:lo], np.full(len(new), self.starts[lo])]
            ends += [self.ends[at:lo], np.full(len(new), self.ends[hi - 1])]
            at = hi
        text.append(self.text[at:])
        return Traced("".join(text), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        return int(self.starts[lo]), int(self.ends[hi - 1])


def unmask(text: str) -> Traced:
    """Look-alikes become ASCII, unseen characters go. Letters inside words of another script stay."""
    if text.isascii():
        at = np.arange(len(text))
        return Traced(text, at, at + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    new = lookalikes()[code]
    changed = new != code
    if not changed.any():
        at = np.arange(len(text))
        return Traced(text, at, at + 1)
    new = np.where(_foreign(text, code, changed), code, new)
    keep = (new != 0) | (code == 0)
    at = np.flatnonzero(keep)
    return Traced(new[keep].tobytes().decode("utf-32-le", "surrogatepass"), at, at + 1)


def _foreign(text: str, code: np.ndarray, changed: np.ndarray) -> np.ndarray:
    """Look-alike letters of words that hold other letters outside ASCII but no ASCII letter or digit:
    real words of their script."""
    out = np.zeros(len(code), dtype=bool)
    for m in WORD.finditer(text):
        if not m[0].isascii() and changed[m.start() : m.end()].any():
            own = code[m.start() : m.end()]
            if not (own < 0x80).any() and not changed[m.start() : m.end()].all():
                out[m.start() : m.end()] = True
    return out


WORD = re.compile(r"[^\W_]+")
#: Lower case for ASCII letters, a space for every other ASCII character but digits.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


_BY_WORD = {w: d for d, words in DIGITS.items() for w in words}
_ALL_DIGITS = "|".join(sorted(_BY_WORD, key=len, reverse=True))
_DOTS = "|".join(DOT_WORDS)
_TERM = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{_ALL_DIGITS}|[0-9])"
#: Spelled and plain digits in a row, apart by at most three of space, comma, hyphen and
#: parentheses, or by a spelled dot.
_RUN = re.compile(
    rf"(?<![^\W_])(?:plus[ -])?{_TERM}(?:(?:(?<=[0-9])|[ ,()-]{{1,3}}|[ ]?[\[({{]?(?<![^\W_])(?:{_DOTS})(?![^\W_])[\])}}]?[ ]?|\.){_TERM})+(?![^\W_])",
    re.IGNORECASE,
)
_PART = re.compile(rf"(plus)|({'|'.join(TIMES)})|({_ALL_DIGITS})|([0-9])|({_DOTS}|\.)", re.IGNORECASE)
_ANY_DIGIT = re.compile(rf"(?<![^\W_])(?:{_ALL_DIGITS})(?![^\W_])", re.IGNORECASE)
_DIGIT_WORDS = frozenset(w.encode() for w in _BY_WORD) | frozenset(w.upper().encode() for w in _BY_WORD if not w.isascii())
_NEXT_TO = _DIGIT_WORDS | {w.encode() for w in (*TIMES, *DOT_WORDS)}
#: Digits that a spelled run must come to.
SPELLED = 4
#: Letters written for a digit between digits.
_MIXED = re.compile(r"[0-9OolI]{3,}")
_AS_DIGIT = str.maketrans("OolI", "0011")


def _may_spell(words: list[bytes]) -> bool:
    """Whether a digit word stands beside another term of a run."""
    last = len(words) - 1
    for k, w in enumerate(words):
        if w in _DIGIT_WORDS:
            for x in (words[k - 1] if k else b"", words[k + 1] if k < last else b""):
                if x in _NEXT_TO or x.isdigit():
                    return True
    return False


def spelled_digits(t: Traced, words: list[bytes]) -> Traced:
    """Runs of at least SPELLED digits with spelled ones among them become digits without gaps; letters
    that stand for digits in mostly numeric words become digits. ``words``: the text's own."""
    edits = []
    if _may_spell(words):
        for m in _RUN.finditer(t.text):
            if not _ANY_DIGIT.search(m[0]):
                continue
            out, times = "", 1
            for plus, more, word, digit, dot in _PART.findall(m[0]):
                if plus:
                    out = "+"
                elif more:
                    times = TIMES[more.lower()]
                elif dot:
                    out += "."
                else:
                    out += (digit or _BY_WORD[word.lower()]) * times
                    times = 1
            if sum(c.isdigit() for c in out) >= SPELLED:
                edits.append((m.start(), m.end(), out))
    t = t.rewrite(edits)
    edits = []
    for m in _MIXED.finditer(t.text):
        digits = sum(c.isdigit() for c in m[0])
        if digits == len(m[0]) or 2 * digits < len(m[0]) or t.text[m.start() - 1 : m.start()].isalpha() or t.text[m.end() : m.end() + 1].isalpha():
            continue
        edits += [(m.start() + k, m.start() + k + 1, c.translate(_AS_DIGIT)) for k, c in enumerate(m[0]) if not c.isdigit()]
    return t.rewrite(edits)


_OPEN, _CLOSE = r"[ ]{0,2}[\[({<]{1,2}[ ]{0,2}", r"[ ]{0,2}[\])}>]{1,2}[ ]{0,2}"
_AT_BRACKET = rf"{_OPEN}(?:{'|'.join(AT_WORDS)}|@){_CLOSE}"
_DOT_BRACKET = rf"{_OPEN}(?:{_DOTS}|\.){_CLOSE}"
_AT_WORD = rf"(?:[ ]{{1,2}}|[_-])(?:{'|'.join(AT_WORDS)})(?:[ ]{{1,2}}|[_-])"
_DOT_WORD = rf"(?:[ ]{{1,2}}|[_-])(?:{_DOTS})(?:[ ]{{1,2}}|[_-])"
_AT_LOOSE = r"[ ]{0,2}@[ ]{0,2}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}?[A-Za-z0-9])?"
_END = r"(?![A-Za-z0-9])"
#: at, then labels apart by dots of any kind, the last of letters; at least one of them disguised.
_HOST = re.compile(
    rf"(?P<at>{_AT_BRACKET}|(?P<bare>{_AT_WORD})|{_AT_LOOSE})"
    rf"(?P<host>{_LABEL}(?:(?:{_DOT_BRACKET}|{_DOT_WORD}|\.){_LABEL})*?(?P<last>{_DOT_BRACKET}|{_DOT_WORD}|\.)[A-Za-z]{{2,24}}{_END}"
    rf"(?:(?:{_DOT_BRACKET}|{_DOT_WORD}|\.)[A-Za-z]{{2,24}}{_END})*)",
    re.IGNORECASE,
)
_ANY_DOT = re.compile(rf"{_DOT_BRACKET}|{_DOT_WORD}", re.IGNORECASE)
_IN_BRACKETS = re.compile(rf"[\[({{<][ ]{{0,2}}(?:{'|'.join(AT_WORDS)}|@|{_DOTS}|\.)[ ]{{0,2}}[\])}}>]", re.IGNORECASE)
# Words that open no host name after a bare at.
NO_HOST = frozenset("the a an this that these those my your his her its our their one le la les un une der die das ein eine el los las una".split())
_LOCAL = re.compile(rf"[A-Za-z0-9%+](?:{_DOT_BRACKET}|{_DOT_WORD})\Z", re.IGNORECASE)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT_BRACKET}|{_DOT_WORD})(?=[0-9])", re.IGNORECASE)
_LOCAL_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def signs(t: Traced, words: set[bytes]) -> Traced:
    """Disguised at and dot of addresses become signs. A bare ``at`` counts only before a host with a
    disguised dot, a bracketed one before any host. ``words``: the text's own."""
    text, edits, done = t.text, [], 0
    bracket, dot_word = _IN_BRACKETS.search(text), any(w.encode() in words for w in DOT_WORDS)
    if bracket or dot_word or " @" in text or "@ " in text:
        for m in _HOST.finditer(text):
            if m.start() < done or not m.start() or text[m.start() - 1] not in _LOCAL_END:
                continue
            dots = list(_ANY_DOT.finditer(text, m.start("host"), m.end("host")))
            if m["at"] == "@" and not dots or m["bare"] and (not dots or re.match("[a-z]*", m["host"].lower())[0] in NO_HOST):
                continue
            lo, before = m.start(), []
            while True:  # dots of the local part, right to left
                word = lo
                while word > done and text[word - 1] in _LOCAL_END:
                    word -= 1
                dot = _LOCAL.search(text, max(done, word - 24), word)
                if word == lo or not dot:
                    break
                before.append((dot.start() + 1, word, "."))
                lo = dot.start() + 1
            edits += before[::-1]
            if m["at"] != "@":
                edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(d.start(), d.end(), ".") for d in dots]
            done = m.end()
    t = t.rewrite(edits)
    return t.rewrite([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(t.text)] if bracket or dot_word else [])


_HOST_OF = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with the run before it and the longest host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL_END:
            lo -= 1
        host = _HOST_OF.match(text, at + 1) if lo < at else None
        if host:
            yield lo, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    twice = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _fours(chain: re.Match) -> Iterator[tuple[int, int]]:
    """Every four parts of a chain of dotted numbers, from its left, that may be an address."""
    at, parts = chain.start(), chain[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        own = parts[k : k + 4]
        size = len(".".join(own))
        if all(map(_at_most_255, own)):
            yield at, at + size
        at += size + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, by kind and start."""
    out = [("email", lo, hi) for lo, hi in emails(text)]
    if "." in text:
        out += [("ip", lo, hi) for m in _CHAIN.finditer(text) if m[0].count(".") >= 3 for lo, hi in _fours(m)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def unmasked(text: str) -> Traced:
    """All transducers in turn."""
    t = unmask(text)
    words = _words(t.text)
    return signs(spelled_digits(t, words), set(words))


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all identifiers of a text, by kind and start."""
    base = detect(text)
    traced = unmasked(text)
    out = [(*s, True) for s in base]
    if traced.text != text:
        own: dict[str, list[tuple[int, int]]] = {k: [(lo, hi) for x, lo, hi in base if x == k] for k in KINDS}
        added = set()
        for kind, lo, hi in detect(traced.text):
            lo, hi = traced.source(lo, hi)
            at = np.searchsorted([s for s, _ in own[kind]], lo, side="right") - 1
            if at < 0 or own[kind][at][1] < hi:
                added.add((kind, lo, hi, False))
        out = sorted([*out, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2], not s[3]))
    return out


SPANS = "array<struct<kind string, start long, `end` long, base boolean>>"


def identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all identifiers of every text, by kind and start; ``base`` marks those that the
    source shows undisguised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find_spans(t or "")] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    rows = spread(docs.select("doc_id", F.col(text_col).alias("text")))
    return ids_as_long(ids_as_text(rows, "doc_id").mapInPandas(run, f"doc_id string, spans {SPANS}"), "doc_id")


def redact(docs: DataFrame, text_col: str = "text", marks: str = "[{}]") -> DataFrame:
    """``docs`` with every identifier of the text replaced by its kind in brackets; of spans that
    overlap, the first and longest is replaced and what others add goes with it. Other columns, whatever
    their names, stay."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else _redacted(t, marks))

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(f"`{text_col}`")))


def _redacted(text: str, marks: str) -> str:
    out, at = [], 0
    for kind, lo, hi, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], marks.format(kind)]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans as text, from rows of ``identifiers``."""
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )
