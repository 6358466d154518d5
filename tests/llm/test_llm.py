"""Operators of the training-data package against plain versions, with awkward rows in every table."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, block string, place int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "ing", "é", "Qu", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = prose(rng, 80)
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    out = {i: "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 8))) for i in range(40)}
    out |= {50: None, 51: "", 52: " \n\t", 53: "one", 54: "one", 55: base, 56: base, 57: base + " tail", 58: base.replace("th", "TH", 1)}
    out |= {60: prose(rng, 30) + "\n" + passage, 61: passage + "\n" + prose(rng, 12), 62: prose(rng, 5) + "\n\n" + passage}
    out |= {70: prose(rng, 30_000), 71: "x" * 50_000, 72: "*** ## " * 40, 73: "STOP NOW!! " * 30, 74: "a b c d e " * 30}
    out |= {75: "日本語 のテキスト 😀 \x00 é İΣ", 76: "Licensed under the MIT  License; Apache-License, CC-BY", 77: "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause"}
    out |= {78: "hello <|endoftext|> world <|startoftext|>x<|ENDOFTEXT|>", 79: "le " * 900 + "<|endoftext|>" * 1200 + " la" * 900}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), i, "x", "y", 1) for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    path = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    from fieldmark.functions.ship import ship

    ship(spark)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def test_quality_counts(docs, texts, spark):
    from fieldmark.llm.quality_rules import quality_filter, quality_rules

    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels)
    assert got.count() == docs.count()
    for i, r in by_id(got).items():
        t = texts[i] or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        repeat = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
    assert quality_filter(docs, labels).columns == docs.columns
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_binomial_tail_and_certified_cutoff(spark):
    from fieldmark.llm import quality_rules as Q

    for n, k, p in ((50, 3, 0.1), (400, 0, 0.01), (30, 30, 0.2), (2000, 15, 0.01)):
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(Q.binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first()["x"]
        assert got == pytest.approx(exact, rel=1e-9)
    zero = {r: 0.0 for r in Q.RULES}
    rows = [(i, "en", {**zero, "symbol_ratio": 0.45 if i % 5 == 0 else 0.0}) for i in range(8000)]
    f = spark.createDataFrame([(i, s, *v.values()) for i, s, v in rows], "doc_id long, stratum string, " + ", ".join(f"{c} double" for c in Q.RULES))
    labels = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 != 0).cast("int").alias("quality"))
    cut = Q.certified_cutoffs(f, labels).collect()
    assert [(r["rule"], r["cutoff"], r["k_good"], r["k_bad"]) for r in cut] == [("symbol_ratio", 0.4, 0, 1600)]


def test_line_dedup(docs, texts):
    from fieldmark.llm.line_dedup import line_dedup

    got = line_dedup(docs, report=True)
    assert got.count() == docs.count() and line_dedup(docs).columns == docs.columns
    r = by_id(got)
    passage = texts[61].split("\n")[:4]
    assert r[60].text == texts[60]
    assert r[61].text == texts[61].split("\n")[4] and not any(x in r[62].text for x in passage)
    assert r[56].emptied and not r[55].emptied and r[50].text is None
    assert r[54].text == "one"  # too short a run
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark, tmp_path):
    """Every deleted line repeats an earlier run of 40 words; no run of 50 words that stands earlier is left."""
    from fieldmark.llm.line_dedup import line_dedup

    rng = random.Random(21)
    common = [prose(rng, rng.choice([1, 3, 8, 12, 25, 60])) for _ in range(12)]
    passages = [[prose(rng, rng.randint(3, 20)) for _ in range(rng.randint(3, 9))] for _ in range(6)]
    texts = {}
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.35:
                p = rng.choice(passages)
                lo = rng.randrange(len(p))
                out += p[lo : rng.randint(lo + 1, len(p))]
            elif kind < 0.6:
                out += [rng.choice(common)] * rng.choice([1, 1, 1, 2, 9])
            else:
                out += [prose(rng, rng.randint(1, 15)) + ("  " if rng.random() < 0.3 else ""), ""]
        texts[i] = "\n".join(out)
    rows = [(i, t) for i, t in texts.items()] + [(7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[10] + "\nend")]
    rows += [(i, "\n".join(passages[0])) for i in range(100, 112)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "l"))
    df = spark.read.parquet(str(tmp_path / "l"))
    after = collections.Counter((r.doc_id, r.text) for r in line_dedup(df).collect())
    # places in the operator's order: rows without an id last, texts of one id by their hash
    th = {(r.doc_id, r.text): r.th for r in df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, th[r]))
    whole = [[(p, x.strip(), len(x.split())) for p, x in enumerate(t.split("\n")) if x.strip()] for _, t in order]
    places = [(d, k) for d, own in enumerate(whole) for k in range(len(own))]

    starts = collections.defaultdict(list)
    for d, k in places:
        starts[whole[d][k][1]].append((d, k))

    def repeats(d, k, least):
        """Lines from (d, k) on that make the longest run of ``least`` words or more found earlier, or none."""
        best = []
        for a, b in starts[whole[d][k][1]]:
            if (a, b) < (d, k):
                n = 0
                while k + n < len(whole[d]) and b + n < len(whole[a]) and whole[d][k + n][1] == whole[a][b + n][1]:
                    n += 1
                if n > len(best) and sum(x[2] for x in whole[d][k : k + n]) >= least:
                    best = range(k, k + n)
        return best

    def shortest(d, k, least):
        run, n = [], 0
        for j in repeats(d, k, least):
            if n < least:
                run.append(j)
                n += whole[d][j][2]
        return run

    for d, row in enumerate(order):
        may = {j for k in range(len(whole[d])) for j in repeats(d, k, 40)}
        got = [t for (i, t), n in after.items() if i == row[0] and n]
        left = [
            t.split("\n") if t else [] for t in got if not t or _subsequence(t.split("\n"), row[1].split("\n"))
        ]
        assert left, row
        if sum(i == row[0] for i, _ in order) > 1:
            continue  # ids that several texts share are looked at by their counts below
        stays = _kept_places(left[0], row[1].split("\n"), {whole[d][j][0] for j in may})
        assert stays is not None  # all that went may go
        for k in range(len(whole[d])):
            run = shortest(d, k, 50)
            assert not run or not all(whole[d][j][0] in stays for j in run)
    assert sum(after.values()) == len(rows)
    assert line_dedup(df.withColumns({"cuts": F.lit(1), "th": F.lit(2), "id": F.lit(3), "row": F.lit("x")}), report=True).count() == len(rows)


def _subsequence(short, long):
    it = iter(long)
    return all(x in it for x in short)


def _kept_places(short, long, may_go):
    """Places of ``long`` that make ``short`` where only places in ``may_go`` (and blank lines) are left out."""
    import functools as ft

    @ft.lru_cache(None)
    def fit(i, j):
        if j == len(long):
            return () if i == len(short) else None
        if i < len(short) and short[i] == long[j]:
            rest = fit(i + 1, j + 1)
            if rest is not None:
                return (j, *rest)
        return fit(i, j + 1) if j in may_go or not long[j].strip() else None

    out = fit(0, 0)
    return None if out is None else set(out)


def test_license_scan(docs, texts):
    from fieldmark.llm.license_scan import evaluate, license_digest, license_scan, to_postfix

    r = by_id(license_digest(license_scan(docs)))
    w = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, row in r.items():
        ws = w.findall((texts[i] or "").translate(LOW))
        hits = [(k, x) for p, x in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base, row.base_labels) == (len(ws), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (row.first_word, row.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert 0 <= row.score <= 1
    assert r[77].labels == "bsd,gpl,mit" and r[77].permissive is True
    assert evaluate(to_postfix("MIT OR GPL-2.0 AND ISC"))[0] == "MIT OR GPL-2.0 AND ISC"
    assert [to_postfix(x) for x in ("MIT OR", "(MIT", "MIT GPL", "")] == [None] * 4


def test_license_labels_against_brute_force(spark):
    from fieldmark.llm.license_scan import BASE_PHRASES, NOTICE_PHRASES, WEIGHTS, license_digest, license_scan

    rng = random.Random(31)
    phrases = BASE_PHRASES | NOTICE_PHRASES
    parts = [*phrases, *(p.upper() for p in phrases), "gnu", "general", "license", "mit", "creative commons", "foo-bar", "é", "x1", "\n", "SPDX-License-Identifier: ISC\n", "\nSPDX-License-Identifier: MPL-2.0 OR curl\n"]
    texts = {i: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for i in range(300)}
    rows = license_digest(license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, r in by_id(rows).items():
        ws = word.findall(texts[i].translate(LOW))
        hits = [(k, p) for p in phrases for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        tags = [x for m in re.finditer(r"(?<![^\W_])SPDX-License-Identifier: (ISC|MPL-2.0 OR curl)", texts[i]) for x in {"ISC": ["isc"]}.get(m[1], ["mpl", "curl"])]
        assert set(r.labels.split(",")) - {""} == {phrases[p] for _, p in hits} | set(tags), texts[i]
        missed = math.prod(1 - WEIGHTS["base" if p in BASE_PHRASES else "notice"] for _, p in hits) * (1 - WEIGHTS["tag"]) ** len(tags)
        assert r.score == pytest.approx(1 - missed)


@pytest.mark.parametrize(
    ("text", "labels", "normal"),
    [
        ("/* SPDX-License-Identifier: GPL-2.0 OR MIT */ int x;", [("gpl", 0), ("mit", 0)], ["GPL-2.0 OR MIT"]),
        ("a <!-- SPDX-License-Identifier: GPL-2.0 OR MIT -->", [("gpl", 1), ("mit", 1)], ["GPL-2.0 OR MIT"]),
        ("(see SPDX-License-Identifier: MIT) for more", [("mit", 1)], ["MIT"]),
        ('"SPDX-License-Identifier": "MIT",', [("mit", 0)], ["MIT"]),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0 */", [("mit", 0), ("gpl", 0)], []),
        ("SPDX-License-Identifier: MIT AND", [("mit", 0)], []),
        ("The SPDX License Identifier says\nSPDX-License-Identifier: ISC", [("isc", 5)], ["ISC"]),
        ("xSPDX-License-Identifier: Apache-2.0\nSPDX-License-Identifier: MIT", [("mit", 6)], ["MIT"]),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0", [("mit", 0), ("gpl", 4)], ["MIT", "GPL-2.0"]),
        ("é SPDX-License-IdentifierX: MIT", [], []),
        ("SPDX-License-Identifier: see the LICENSE file", [], []),
        ("SPDX-License-Identifier: GPL-2.0 AND (MIT", [("gpl", 0), ("mit", 0)], []),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", [("gpl", 0)], ["GPL-2.0 WITH Linux-syscall-note"]),
    ],
)
def test_license_expression_ends(text, labels, normal):
    from fieldmark.llm.license_scan import _automaton, scan_text

    _, hits, expressions, _ = scan_text(text, _automaton())
    assert (hits, expressions) == ([("tag", label, place) for label, place in labels], normal)


def test_license_identifiers_of_any_form():
    """Every well-formed identifier gives a label; only listed ones are permissive."""
    from fieldmark.llm.license_scan import _automaton, scan_text

    automaton = _automaton()
    rng = random.Random(12)
    known = {"MIT": "mit", "Apache-2.0": "apache", "BSD-3-Clause": "bsd", "GPL-2.0-or-later": "gpl", "LGPL-3.0+": "lgpl", "0BSD": "0bsd", "CC-BY-4.0": "cc-by", "CC0-1.0": "cc0"}
    for _ in range(500):
        own = "".join(rng.choice("ABCDEFGHxyz") for _ in range(rng.randint(1, 6)))
        named = {f"Q{own}-{rng.randint(0, 9)}.{rng.randint(0, 9)}": None, f"W{own}-B": None, f"V{rng.randint(0, 9)}{own}": None, **known}
        names = rng.sample(sorted(named), rng.randint(1, 4))
        ops = [rng.choice([" OR ", " AND ", "/"]) for _ in names[1:]]
        text = names[0] + "".join(o + n for o, n in zip(ops, names[1:], strict=True))
        _, hits, normal, good = scan_text(f"# SPDX-License-Identifier: {text} */", automaton)
        assert [x for kind, x, _ in hits if kind == "tag"] == [named[n] or n.lower() for n in names], text
        assert len(normal) == 1
        if all(o == " AND " for o in ops):
            assert good == all(n in {"MIT", "Apache-2.0", "BSD-3-Clause", "0BSD", "CC-BY-4.0", "CC0-1.0"} for n in names)
    for text, label in (("MIT-fabricated-word", "mit-fabricated-word"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd"), ("CECILL-B", "cecill-b"), ("foobar", "foobar")):
        _, hits, _, good = scan_text(f"SPDX-License-Identifier:\n * {text}\n", automaton)
        assert ("tag", label, 0) in hits and good is False
    for text in ("see the file", "tags are great", "a", ""):
        assert scan_text(f"SPDX-License-Identifier: {text} of ours", automaton)[2] == []



def test_pieces(docs, texts):
    import sentencepiece

    from fieldmark.llm.piece_codec import decode_pieces, encode_pieces, encoder, piece_digest

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, r in by_id(piece_digest(docs, path)).items():
        ids = sp.encode(texts[i] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert by_id(decode_pieces(encode_pieces(docs.where("doc_id = 55"), path), path))[55].decoded == texts[55]
    rng = random.Random(4)
    enc = encoder(path)
    parts = [" ", "  ", "\n", "a", "th", "the", "é", "▁", "日", "😀", "\t", "!!", "12", "er", "ing", "<s>"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == sp.encode(t, add_eos=True)


@pytest.mark.parametrize(("name", "mode"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_tokens_equal_library(texts, name, mode, monkeypatch):
    from tokenizers import Tokenizer

    from fieldmark.llm import token_cache as C

    monkeypatch.setattr(C, "CACHE_CHUNKS", 1000)
    monkeypatch.setattr(C, "GROUP_CHARS", 4000)
    k = C.TextTokenizer(P.path(name), 1)
    assert k.mode == mode
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "a", "The", "É", "ñ", "日", "😀", "\t", "...", "12", "'s", "'LL", "İ", "Σ", "́", "\r", "\xa0", "²", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\0", "한", "_"]
    ts = [t or "" for t in texts.values()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    sure = [c for c in map(chr, range(1, 0xD7A4)) if not C.UNSURE.match(c)]
    ts += ["".join(f"a {c}b1{c}{c}" for c in sure[i : i + 100]) for i in range(0, len(sure), 100)]
    want = Tokenizer.from_file(P.path(name)).encode_batch(ts, add_special_tokens=False)
    for t, got, w in zip(ts, k.encode(ts), want, strict=True):
        assert np.frombuffer(got, k.dtype).tolist() == [*w.ids, 1], repr(t)


def test_katz(docs, texts, spark, tmp_path):
    from fieldmark.llm import katz_lm as K

    once = docs.dropDuplicates(["doc_id"]).coalesce(1)
    once.write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    got = by_id(K.katz_scores(once))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter(w for i, t in texts.items() if not held[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        ws = [*words(t), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("hot_tokens", [20, 500_000])
def test_katz_keeps_every_word_apart(spark, tmp_path, hot_tokens):
    from fieldmark.llm import katz_lm as K

    rng = random.Random(11)
    rows = [(0, "ax by", True), (1, "ax cz", True), (2, "new ax", True), (3, None, True), (None, "ax by ax", True)]
    rows.append((10, " ".join(f"w{i} w{i}" for i in range(65_000)), False))  # more words than classes
    rows += [(11 + i, "ax by", False) for i in range(2)] + [(13, "cz dz", False)]
    rows += [(20 + i, " ".join(f"v{int(rng.paretovariate(0.7)) % 50}" for _ in range(300)), i % 4 == 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3).write.parquet(str(tmp_path / "k"))
    got = by_id(K.katz_scores(spark.read.parquet(str(tmp_path / "k")), F.col("held"), hot_tokens=hot_tokens))
    assert len(got) == len(rows)
    uni, pairs, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, t, held in rows:
        ws = [None, *words(t), None]
        if not held:
            uni.update(ws[1:])
            pairs.update(zip(ws, ws[1:], strict=False))
    for h, w in pairs:
        after[h].add(w)
    d = [0.0, *K.discounts(np.array([sum(n == r for n in pairs.values()) for r in range(1, 7)], dtype=float))]
    base = sum(uni.values()) + 0.5 * (len(uni) + 1)

    @functools.cache
    def history(h):
        n = sum(pairs[h, w] for w in after[h])
        left = 1 - sum(pairs[h, w] * (d[pairs[h, w]] if pairs[h, w] <= 5 else 1) for w in after[h]) / n
        seen = sum((uni[w] + 0.5) / base for w in after[h])
        low = 1 / (n + 1)
        return n, (1 - low) / (1 - left) if left < low else 1, max(left, low) / (1 - seen)

    def log_p(h, w):
        n = pairs[h, w]
        if not n:
            return math.log10((history(h)[2] if after[h] else 1) * (uni[w] + 0.5) / base)
        return math.log10(n * (d[n] if n <= 5 else 1) * history(h)[1] / history(h)[0])

    for i, t, _ in rows:
        ws = [None, *words(t), None]
        assert got[i].score == pytest.approx(sum(map(log_p, ws, ws[1:])), rel=1e-9), i
    for h in ("v0", "ax", None, "w7", "never seen"):  # P(. | h) sums to one over all words and the unseen type
        assert sum(10 ** log_p(h, w) for w in [*uni, "never seen"]) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("hot_tokens", [20, 500_000])
def test_katz_backs_off_from_triples_to_pairs_to_words(spark, tmp_path, hot_tokens, monkeypatch):
    from fieldmark.llm import katz_lm as K

    monkeypatch.setattr(K, "BUCKET_PAIRS", 700)
    rng = random.Random(12)
    rows = [(0, "ax by cz", True), (1, "by cz dz new by cz", True), (2, "new", True), (3, None, True), (4, "", False), (5, " ", False), (None, "ax by cz dz", True)]
    rows += [(10 + i, "Ax by cz", False) for i in range(3)] + [(15, "by cz dz", False), (16, "ax", False), (17, "ax by ax by ax by", False)]
    rows += [(20 + i, " ".join(f"v{int(rng.paretovariate(0.9)) % 30}" for _ in range(200)), i % 4 == 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3).write.parquet(str(tmp_path / "k"))
    got = by_id(K.katz_scores(spark.read.parquet(str(tmp_path / "k")), F.col("held"), hot_tokens=hot_tokens, order=3))
    assert len(got) == len(rows)
    uni, grams, after = collections.Counter(), {2: collections.Counter(), 3: collections.Counter()}, collections.defaultdict(set)
    for _, t, held in rows:
        ws = [None, *words(t), None]
        if not held:
            uni.update(ws[1:])
            for k in grams:
                grams[k].update(zip(*[ws[i:] for i in range(k)], strict=False))
    for k in grams:
        for g in grams[k]:
            after[g[:-1]].add(g[-1])
    d = {k: [0.0, *K.discounts(np.array([sum(n == r for n in grams[k].values()) for r in range(1, 7)], dtype=float))] for k in grams}
    base = sum(uni.values()) + 0.5 * (len(uni) + 1)
    assert hot_tokens > 20 or sum(sum(grams[3][*h, w] for w in after[h]) > 20 for h in after if len(h) == 2) > 5

    @functools.cache
    def history(h):
        c = [grams[len(h) + 1][*h, w] for w in after[h]]
        left = 1 - sum(n * (d[len(h) + 1][n] if n <= 5 else 1) for n in c) / sum(c)
        low = 1 / (sum(c) + 1)
        return sum(c), (1 - low) / (1 - left) if left < low else 1, max(left, low) / (1 - sum(p(h[1:], w) for w in after[h]))

    def p(h, w):
        if not h:
            return (uni[w] + 0.5) / base
        n = grams[len(h) + 1][*h, w]
        if n:
            return n * (d[len(h) + 1][n] if n <= 5 else 1) * history(h)[1] / history(h)[0]
        return (history(h)[2] if after[h] else 1) * p(h[1:], w)

    for i, t, _ in rows:
        ws = [None, *words(t), None]
        want = sum(math.log10(p(tuple(ws[max(0, k - 2) : k]), ws[k])) for k in range(1, len(ws)))
        assert got[i].score == pytest.approx(want, rel=1e-9), i
    for h in (("v1", "v1"), (None, "ax"), ("by", "cz"), ("v2", "v3"), ("ax", "never seen")):
        assert sum(p(h, w) for w in [*uni, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_op5_scores_by_triples(spark, tmp_path):
    from fieldmark.llm.queries import QUERIES

    rows = [(2 * i + k, t) for k, t in enumerate(("a b c", "d b e")) for i in range(40)]
    spark.createDataFrame([*rows, (1000, "a b c"), (1001, "a b e")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(QUERIES["op5_katz_lm"](spark, str(tmp_path)))
    assert got[1000].score > got[1001].score + 1  # "b" is followed by "c" and "e" alike; only "a b" tells


def test_embeddings(spark):
    from fieldmark.llm.embedding_dedup import similar_vectors

    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 64))
    near = np.concatenate([x[:20] + 0.2 * rng.standard_normal((20, 64)) for _ in range(3)])
    rows = [(i, v.tolist(), 7, "n") for i, v in enumerate(np.concatenate([x, near, x[:3]]))]
    rows += [(500, None, 1, "n"), (501, [0.0] * 64, 1, "n"), (502, [float("nan")] * 64, 1, "n"), (503, [None] * 64, 1, "n"), (504, [1.0], 1, "n"), (505, [], 1, "n")]
    df = spark.createDataFrame(rows, T.StructType.fromDDL("vec_id long, embedding array<double>, label int, n string"))
    got = {r["vec_id"]: r for r in similar_vectors(df).collect()}
    y = np.array([r[1] for r in rows[:183]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(183))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(183))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 506))
    exact = {i: i for i in range(183)}  # components over all links, for those whose links were all found
    for _ in range(183):
        exact = {i: min(exact[j] for j in [i, *np.flatnonzero(link[i])]) for i in exact}
    groups = collections.defaultdict(list)
    for i, c in exact.items():
        groups[c].append(i)
    whole = [g for g in groups.values() if all(got[i].n_links == link[i].sum() for i in g)]
    assert sum(map(len, whole)) >= 150
    for g in whole:
        assert all((got[i].component_id, got[i].kept) == (min(g), i == min(g)) for i in g)
    assert similar_vectors(df.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    from fieldmark.llm.embedding_dedup import similar_vectors

    rows = [(1, [1e-200, 2e-200]), (2, [3.0, 6.0]), (3, [1e200, 2e200]), (4, [0.0, 0.0]), (5, [1.0, -2.0]), (6, [5e-324, 0.0]), (7, [0.0, 7.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_embedding_tables_grow_with_the_vectors():
    from fieldmark.llm.embedding_dedup import codes, fit_quantiser, table_plan

    plans = [table_plan(n, 0.9) for n in (1, 10**4, 10**6, 10**8)]
    assert [p[0] for p in plans] == [12, 14, 20, 27] and [p[1] for p in plans] == sorted(p[1] for p in plans)
    rng = np.random.default_rng(26)
    x = rng.standard_normal((3000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (y * u).sum(axis=1, keepdims=True) * u
    y = 0.9 * u + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    q = fit_quantiser(x, 10**6, 0.9)  # recall of pairs at the threshold in tables made for a million vectors
    (a, p), (b, r) = codes(x, q), codes(y, q)
    near = np.bitwise_count(a ^ b).sum(axis=1) <= q.radius
    assert ((p == r).any(axis=1) & near).mean() >= 0.93


@pytest.mark.parametrize(("mean", "cluster"), [(0.5, 0), (0.7, 0), (0.0, 200)])
def test_embeddings_with_a_common_direction(spark, mean, cluster):
    from fieldmark.llm.embedding_dedup import similar_vectors

    rng = np.random.default_rng(16)

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    # pairs at cosine 0.905 that share a mean of this squared norm, and a cluster of a third of the rows
    g = rng.standard_normal((200, 64))
    g[:, 0] = 0
    g = unit(g)
    other = rng.standard_normal((200, 64))
    other[:, 0] = 0
    other = unit(other - (other * g).sum(axis=1, keepdims=True) * g)
    c = 1 - 0.095 / (1 - mean)
    y = np.concatenate([g, c * g + np.sqrt(1 - c * c) * other]) * np.sqrt(1 - mean)
    y[:, 0] = np.sqrt(mean)
    if cluster:
        centre = unit(rng.standard_normal((1, 64)))
        y = np.concatenate([y, unit(centre + 0.32 * unit(rng.standard_normal((cluster, 64))))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r.n_links for r in similar_vectors(df).collect()}
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    for rows in (range(400), range(400, len(y))):
        assert 0.9 * link[rows].sum() <= sum(got[i] for i in rows) <= link[rows].sum()


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(docs, texts, spark, tmp_path):
    from fieldmark.llm.minhash_dedup import near_duplicates

    rng = random.Random(8)
    more = dict(texts)
    base = prose(rng, 120).split(" ")
    for i in range(200, 260):  # a group of near copies, some linked through others only
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"new{rng.random()}"
        more[i] = " ".join(copy)
    df = spark.createDataFrame([(i, t) for i, t in more.items()], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "near"))
    got = by_id(near_duplicates(spark.read.parquet(str(tmp_path / "near")), shingle=4))
    sets = {i: shingles(t, 4) for i, t in more.items()}
    want = components(sets, 80)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in more}
    assert near_duplicates(docs).count() == docs.count()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_share_ids(spark, tmp_path):
    from fieldmark.llm.minhash_dedup import drop_near_duplicates, near_duplicates

    rng = random.Random(18)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (3, c), (3, c), (None, c), (None, c + " y z " * 30), (None, None), (4, None), (4, "")]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, th string").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    want = [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (None, None, True), (4, 4, True), (4, 4, True)]
    assert got == collections.Counter(want)
    kept = collections.Counter((r.doc_id, r.text, r.th) for r in drop_near_duplicates(df).collect())
    assert kept == collections.Counter((*r, "k") for r in [(1, a), (2, b), (3, c), rows[7], (None, None), (4, None), (4, "")])


def test_long_chain_of_links(spark):
    from fieldmark.llm.components import connected_components

    df = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r["id"], r["component"]) for r in connected_components(df).collect()} == {(i, 0) for i in range(41)}


def test_toxicity(docs, spark):
    from fieldmark.llm.toxicity import score_toxicity, toxicity_filter, train_toxicity

    rng = random.Random(9)
    rows = [(i, prose(rng, 40) + (" you utter scoundrel " if i % 4 == 0 else " ") + prose(rng, 20)) for i in range(600)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = train_toxicity(train, labels, F.col("doc_id") < 400)
    got = by_id(score_toxicity(train, model))
    assert sum(got[i].predicted != (i % 4 == 0) for i in range(400, 600)) <= 4
    assert score_toxicity(docs, model).count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(docs, model).collect())
    assert toxicity_filter(docs, model).columns == docs.columns
    none = train_toxicity(train, labels.limit(0))
    assert {r["predicted"] for r in score_toxicity(docs, none).collect()} == {0}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    from fieldmark.llm.packing import pack_documents

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    once = docs.dropDuplicates(["doc_id"])
    rows = pack_documents(once, path).collect()
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for own in sequences.values() for _, n in own)
    assert len(sequences) <= math.ceil(total / 2048 * 1.02) + 1  # little padding
    assert pack_documents(docs, path).count() == len(rows) + 1
    odd = pack_documents(once, path, seq_len=2046).collect()
    assert max(r.offset + r.length for r in odd) <= 2046 and sum(r.length for r in odd) == total
    assert pack_documents(docs.limit(0), path).count() == 0


def test_column_generation_reaches_the_bound():
    from fieldmark.llm.packing import column_generation, plan_patterns

    sizes = np.arange(1, 65)
    demand = np.random.default_rng(2).integers(1, 200, 64)
    plan = plan_patterns(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in plan)
    patterns, counts = column_generation(sizes, demand, 64)
    assert np.allclose(counts @ patterns, demand)
    assert counts.sum() >= (sizes * demand).sum() / 64
    assert sum(n for _, n in plan) <= 1.005 * counts.sum() + 2


def test_huffman(docs, texts, spark, tmp_path):
    from tokenizers import Tokenizer

    from fieldmark.llm import huffman_files as H
    from fieldmark.llm.huffman_files import canonical_codes, code_lengths, decode_ids, decode_table, encode_ids, huffman_round_trip

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    once = docs.dropDuplicates(["doc_id"])
    at = 0
    for r in sorted(huffman_round_trip(once, path).collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert huffman_round_trip(docs, path).count() == docs.count()
    assert huffman_round_trip(docs.limit(0), path).count() == 0
    # from the written files alone, rows without an id among them
    some = spark.createDataFrame([(None, "a b"), (None, "c"), (7, texts[70]), (3, "<|endoftext|>")], "doc_id long, text string")
    tokens = H.tokenize(some, path)
    H.write_files(tokens, str(tmp_path / "h"), 49408, 2, 2)
    for r in H.read_files(spark, str(tmp_path / "h"), keep_ids=True).collect():
        want = {7: texts[70], 3: "<|endoftext|>"}.get(r.doc_id)
        if want is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*t.encode(want, add_special_tokens=False).ids, 2]
        else:
            assert r.doc_id is None and r.n_tokens in (2, 3) and r.start < 5
    counts = np.array([0, *(2**k for k in range(24)), 5, 5])
    lengths = code_lengths(counts, 12)
    assert lengths.max() <= 12 and lengths[0] == 0 and sum(2.0 ** -float(x) for x in lengths if x) <= 1
    codes = canonical_codes(lengths)
    ids = np.random.default_rng(3).integers(1, 27, 1000)
    payload, marks = encode_ids(ids, codes, lengths)
    assert (decode_ids(payload, marks, 1000, decode_table(lengths)) == ids).all()
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


@pytest.mark.parametrize("inline", [256, 0])
def test_filters_judge_rows(spark, monkeypatch, inline):
    """Rows that share an id are judged by their own texts, whatever their columns are called."""
    from fieldmark.llm import quality_rules as Q
    from fieldmark.llm.toxicity import ToxicityModel, toxicity_filter

    monkeypatch.setattr(Q, "MAX_INLINE_STRATA", inline)
    rng = random.Random(41)
    good, bad = prose(rng, 40), "short"
    names = ["stratum", "q", "kept", "row", "cuts", "__toxicity", "emptied"]
    rows = [(1, good), (1, bad), (None, good), (None, bad), (2, None), (2, ""), (2, good), (2, good)]
    df = spark.createDataFrame([(*r, "en", *names) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    out = Q.quality_filter(df, labels)
    assert out.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(1, good), (None, good), (2, good), (2, good)])
    constant = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    assert toxicity_filter(df, constant).columns == df.columns and toxicity_filter(df, constant).count() == len(rows)


def test_pipeline_run_against_plain_stages(spark, tmp_path):
    """run() equals the stages done plainly: quality verdicts and scores row by row, lines, links, ids."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    from fieldmark.llm.line_dedup import line_dedup
    from fieldmark.llm.quality_rules import quality_rules
    from fieldmark.llm.toxicity import score_toxicity, train_toxicity, training_fold

    base = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        src = spark.read.parquet(f"{base}/{t}.parquet")
        if t == "documents":
            rng = random.Random(51)
            more = [(9001, prose(rng, 200), "en", "s", 1), (9002, None, None, None, None), (9003, "", "en", "s", 0), (None, prose(rng, 60), "en", "s", 2)]
            src = src.unionByName(spark.createDataFrame(more, src.schema))
        src.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    d = str(tmp_path)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = collections.Counter(r.doc_id for r in quality_rules(docs, labels).where("kept").collect())
    one = docs.where(F.col("doc_id").isin([i for i in kept if i is not None]) | (F.col("doc_id").isNull() if None in kept else F.lit(False)))
    model = train_toxicity(one, labels, training_fold(F.col("doc_id")))
    clean = {r.doc_id for r in score_toxicity(one, model).where("predicted = 0").collect()}
    two = [r for r in one.collect() if r.doc_id in clean]
    third = line_dedup(spark.createDataFrame(two, docs.schema), report=True).collect()
    before = {r.doc_id: r.text for r in two}
    four = {}
    for r in third:
        gone = set((before[r.doc_id] or "").split("\n")) - set((r.text or "").split("\n"))
        assert r.n_removed_lines == 0 or gone or r.n_lines > r.n_removed_lines
        if not (r.n_removed_lines and not words(r.text)):
            four[r.doc_id] = r.text
    least = components({i: shingles(t, 5) for i, t in four.items() if i is not None}, 80)
    five = {i for i in four if i is None or least[i] == i}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = C.run(spark, d).collect()
    assert {r.doc_id for r in rows} == five
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.start] = r
    for i in five:
        ids = np.array([*t.encode(four[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(r.length for r in pieces[i].values()) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[s : s + r.length].tobytes()) for s, r in pieces[i].items())


def test_pipeline(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from fieldmark.llm.common import stage

    before = {r.doc_id: r.text for r in docs.collect()}
    n = len(before)
    for name, f in C.STAGES[:-1]:
        docs = stage(f(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before) and len(now) <= n
        if name != "line_dedup":
            assert all(now[i] == before[i] for i in now)
        before, n = now, len(now)
    want = components({i: shingles(t, 5) for i, t in before.items()}, 80)
    assert all(want[i] == i for i in before)
    last = C.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(before)
