"""Licence scan: Aho-Corasick over the word sequence, shunting-yard over licence expressions.

A text is lower-cased (A-Z), cut into words of digits, ASCII letters and non-ASCII characters, and
joined by single spaces; one automaton of all phrases runs over that. Tags that announce a licence
expression make the raw text after them be parsed by a shunting-yard parser for AND, OR, WITH and
parentheses, and evaluated for permissiveness.

Defined cases: a null or empty text has no words and no labels, null first and last words and score
0; an expression ends before the term that cannot continue it, at the next tag or with the line; an
identifier outside the families is its own label, and not permissive unless it is listed; an expression
that is not complete at its end is broken and yields the labels of all its identifiers but no normal
form; repeated rows are scanned one by one; extra columns are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text

# Phrases and labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG_PHRASES = ("spdx license identifier",)
TAG = re.compile(r"(?<![0-9A-Za-z\x80-\U0010FFFF])SPDX-License-Identifier(?![0-9A-Za-z\x80-\U0010FFFF])\s*:?[ \t]*", re.IGNORECASE)
LINE = re.compile(r"[^\r\n]*")
BELOW = re.compile(r"(?:\r\n|\r|\n)[ \t#*;/!%-]*")
#: Characters that may open an expression without being part of it.
QUOTES = frozenset("\"'`[{<:=")
TERM = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.+:\-]*[A-Za-z0-9+])?|[()]|\S")
# Families of identifiers, as patterns of the whole identifier in lower case, and labels.
FAMILIES = (
    (r"(agpl|lgpl|gpl)(-[0-9.]+)?(-only|-or-later)?\+?", None),
    (r"(apache|mpl|epl|eupl|cddl|afl|osl|artistic)(-[0-9.]+[a-z]*)?\+?(-perl|-cl8)?", None),
    (r"(bsd)(-[0-9]-clause(-[a-z0-9.-]+)?|-source-code)?", None),
    (r"bsl(-1\.0)?", "bsl"),
    (r"(cc-by(-nc)?(-sa|-nd)?)(-[0-9.]+(-[a-z]{2,3})?)?", None),
    (r"cc0(-[0-9.]+)?", "cc0"),
    (r"mit(-0|-advertising|-cmu|-enna|-feh|-festival|-modern-variant|-open-group|-testregex|-wu)?", "mit"),
    (r"isc(-veillard)?", "isc"),
    (r"unlicense", "unlicense"),
)
#: Families as they stand alone in an identifier without a version.
_FAMILY = [(re.compile(pattern), label) for pattern, label in FAMILIES]
# Identifiers of one word without a version.
BARE_IDENTIFIERS = frozenset(
    "0bsd beerware borceux caldera clartistic condor crossword cube curl diffmark doc dotseqn dsdp egenix entessa eudatagrid eurosym fair "
    "fsfap fsful fsfulr ftl giftware gl2ps glide glulxe gnuplot hpnd icu ijg imagemagick imatix intel isc jam json jpnic latex2e leptonica "
    "libpng libtiff linux-openib makeindex miros mit mitnfa motosoto mpich2 mtll multics mup naumen ncsa newsletr ngpl nlpl nokia noweb nrl "
    "ntp openssl plexus postgresql psfrag psutils qhull rdisc rscpl ruby saxpath scea sendmail sgi-b-2.0 sissl sleepycat smlnj snia ssh-short "
    "swl tcl tmate torque tosl unlicense vim vostrom w3c wsuipa wtfpl x11 xerox xinetd xnet xpp xskat zed zend-2.0 zlib".split()
)
# Identifiers, apart from those of the families below, that are permissive.
PERMISSIVE = frozenset(
    "0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 artistic-2.0 beerware blueoak-1.0.0 curl ecl-2.0 fsfap ftl hpnd icu ijg libpng libtiff "
    "ms-pl mulanpsl-2.0 naist-2003 ncsa ntp openssl php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016 "
    "unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.0 zpl-2.1".split()
)
_PERMISSIVE = re.compile(
    r"apache-(1\.0|1\.1|2\.0)|bsd-[1234]-clause(-(clear|attribution|patent|views|modification|uc|lbnl|open-mpi|shortened))?|bsl-1\.0|"
    r"cc-by-(1\.0|2\.0|2\.5|3\.0|4\.0)(-[a-z]{2,3})?|cc0-1\.0|isc|mit(-0|-advertising|-cmu|-enna|-feh|-festival|-modern-variant|-open-group|-testregex|-wu)?"
)
#: Probability that a match of this kind really states a licence.
WEIGHTS = {"base": 0.9, "tag": 0.95, "notice": 0.7}

_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SCHEMA = (
    "doc_id string, n_words long, matches array<struct<kind string, label string, word long>>, "
    "expressions array<string>, permissive boolean"
)


def well_formed(term: str) -> bool:
    """Whether a term can name a licence by its form: a version or a part after a hyphen, or a known
    word."""
    low = term.lower().rstrip("+")
    return low in BARE_IDENTIFIERS or low.strip(".:-") == low and ("-" in low or any(c.isdigit() for c in low)) or any(p.fullmatch(low) for p, _ in _FAMILY)


def family(identifier: str) -> str:
    """Label of a licence identifier: its family, else the identifier in lower case."""
    low = identifier.lower()
    for pattern, label in _FAMILY:
        if m := pattern.fullmatch(low):
            return label or m[1]
    return low.rstrip("+")


def permissive(identifier: str) -> bool:
    """Whether exactly this identifier is a permissive licence."""
    low = identifier.lower().rstrip("+")
    return low in PERMISSIVE or bool(_PERMISSIVE.fullmatch(low))


PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: postfix terms of a licence expression, or None where it is not well formed."""
    out: list[str] = []
    ops: list[str] = []
    operand_next = True
    for term in TERM.findall(expression):
        word = term.upper()
        if word in PRECEDENCE:
            if operand_next:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[word]:
                out.append(ops.pop())
            ops.append(word)
            operand_next = True
        elif term == "(":
            if not operand_next:
                return None
            ops.append(term)
        elif term == ")":
            if operand_next:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif term[0].isalnum():
            if not operand_next:
                return None
            out.append(term)
            operand_next = False
        else:
            return None
    if operand_next:
        return None
    while ops:
        if ops[-1] == "(":
            return None
        out.append(ops.pop())
    return out


def expression(rest: str) -> tuple[list[str], bool]:
    """(terms up to the first that cannot continue the expression, whether it opens well). A slash
    between two identifiers without spaces stands for OR. A word that has no identifier's form is one
    if nothing but an operator, a parenthesis or no word follows."""
    terms: list[str] = []
    opened, depth, operand_next = True, 0, True
    found = list(TERM.finditer(rest))
    for k, m in enumerate(found):
        term = m[0]
        then = found[k + 1] if k + 1 < len(found) else None
        if term == "/" and not operand_next and then and then[0][0].isalnum() and m.end() == then.start() and found[k - 1].end() == m.start():
            term, operand_next = "OR", True
        elif term.upper() in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif term == "(":
            if not operand_next:
                break
            depth += 1
        elif term == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif term[0].isascii() and term[0].isalnum():
            excepted = bool(terms) and terms[-1].upper() == "WITH"
            alone = (not terms or terms[-1].isupper()) and (then is None or then[0].upper() in PRECEDENCE or not then[0][0].isalnum())
            if not operand_next or not (excepted or well_formed(term) or alone):
                break
            operand_next = False
        elif terms:
            break
        else:
            opened &= term in QUOTES
            continue
        terms.append(term)
    if terms and terms[-1] in ("and", "or", "with"):
        terms.pop()  # prose goes on
    return terms, opened


def tagged(text: str) -> Iterator[tuple[int, str]]:
    """(word index of a tag, text after it up to the next tag or the end of the line; of the next line,
    less its comment marks, where the tag ends its own)."""
    found = list(TAG.finditer(text))
    at = place = 0
    for k, m in enumerate(found):
        place += len(text[at : m.start()].encode("utf-8", "surrogatepass").translate(_WORDS).split())
        at = m.start()
        end = found[k + 1].start() if k + 1 < len(found) else len(text)
        line = LINE.match(text, m.end(), end)
        if not line[0].strip() and (below := BELOW.match(text, line.end(), end)):
            line = LINE.match(text, below.end(), end)
        yield place, line[0]


def evaluate(postfix: list[str]) -> tuple[str, bool, list[str]]:
    """(normal form, permissive, identifiers). OR is permissive if a side is, AND if both are; WITH
    adds an exception and keeps the licence's value."""
    stack: list[tuple[str, bool, int]] = []
    names: list[str] = []
    for term in postfix:
        if term not in PRECEDENCE:
            names.append(term)
            stack.append((term, permissive(term), 9))
            continue
        right, left = stack.pop(), stack.pop()
        if term == "WITH":
            names.remove(right[0])
            stack.append((f"{left[0]} WITH {right[0]}", left[1], 3))
            continue
        rank = PRECEDENCE[term]
        sides = [f"({s})" if r < rank else s for s, _, r in (left, right)]
        value = left[1] or right[1] if term == "OR" else left[1] and right[1]
        stack.append((f" {term} ".join(sides), value, rank))
    return stack[0][0], stack[0][1], names


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    for phrase in TAG_PHRASES:
        found.add_word(f" {phrase} ", ("tag", "", len(phrase) + 2))
    found.make_automaton()
    return found


def scan_text(text: str, automaton) -> tuple[int, list[tuple[str, str, int]], list[str], bool | None]:
    """(words, matches as (kind, label, first word), normal expressions, permissive or None)."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    hits, expressions, permissive = [], [], None
    tags = set()
    at, counted = 0, -1  # words are counted forward from the last hit
    for end, (kind, label, size) in sorted(automaton.iter(line), key=lambda x: x[0] - x[1][2]):
        start = end - size + 1
        counted += line.count(" ", at, start + 1)
        at = start + 1
        if kind == "tag":
            tags.add(counted)
        else:
            hits.append((kind, label, counted))
    if tags:
        for place, rest in tagged(text):
            if place not in tags:
                continue
            terms, opened = expression(rest)
            postfix = to_postfix(" ".join(terms)) if opened else None
            if postfix is None:
                names = [x for x in terms if x[0].isalnum() and x.upper() not in PRECEDENCE]
            else:
                normal, value, names = evaluate(postfix)
                expressions.append(normal)
                permissive = value if permissive is None else permissive and value
            hits += [("tag", family(x), place) for x in names]
    return len(words), hits, expressions, permissive


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = _automaton()
    for batch in batches:
        rows = [scan_text(t or "", automaton) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "n_words": [r[0] for r in rows],
                "matches": [[{"kind": k, "label": x, "word": w} for k, x, w in r[1]] for r in rows],
                "expressions": [r[2] for r in rows],
                "permissive": pd.Series([r[3] for r in rows], dtype=object),
            }
        )


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per document: words, all matches with kind, label and first word, normal forms of
    licence expressions, and whether they are permissive (null without one)."""
    rows = ids_as_text(docs.select("doc_id", F.col(text_col).alias("text")), "doc_id")
    return ids_as_long(rows.mapInPandas(_scan, SCHEMA), "doc_id")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, label lists and score of ``license_scan`` rows."""
    base = F.filter("matches", lambda m: m["kind"] == "base")

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    missed = F.aggregate("matches", F.lit(1.0), lambda a, m: a * (1 - weight[m["kind"]]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        (1 - missed).alias("score"),
        "expressions",
        "permissive",
    )
