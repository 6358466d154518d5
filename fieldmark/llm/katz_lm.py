"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Model. Every training word is a word of its own, and one more type stands for all unseen words: with
training count c, P(w) = (c + 0.5) / (n + 0.5 (v + 1)) for n tokens of v types. P(w | h) is the
discounted relative frequency of the n-gram where it was seen, else alpha(h) P(w | h without its first
word); alpha(h) is what the discounts leave over, divided by the shorter history's mass of the words
not seen after h, so that every P(. | h) sums to one; after a history never seen, P is that of the
shorter one. Orders 2 and 3 have discounts of their own. A text starts after an end: its first token
has that end as its history, its second the end and the first.

Jobs. The input is read once, into one compressed row of word codes per part, in files dealt by part, so
that what is told of a part comes to it without moving it. Words get numbers and
counts in buckets of their hash, which go back to the parts. Then, order by order, every part sends its
distinct n-grams to buckets of their history, with their training count in the part and the count of
the n-gram without its first word, as sorted, compressed blocks, one per part and bucket. Buckets send
back whole-number sums: the count of every n-gram, and for every history what its discounts and its
backoff weight are made of. Numbers of n-grams seen 1 .. GOOD_TURING + 1 times give the order's
discounts; a part then finishes its probabilities by itself. The n-grams of a hot history (over
``HOT_TOKENS`` tokens) are spread over all buckets and its sums, a few per bucket, go through the
driver.

Defined cases: a null or empty text is one end token; without training documents every word is
unseen and the score is the base score; repeated rows are scored one by one; extra columns are not
returned; rows with a null doc_id are held out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, ids_as_text, spread, stage, stage_by
from .words import mix, word_hashes

#: Counts up to this one are discounted.
GOOD_TURING = 5
#: Characters of texts handled together, and tokens of one bucket aimed at.
PART_CHARS = 12_000_000
BUCKET_PAIRS = 2_000_000
#: Training tokens above which a history's n-grams are spread over the buckets.
HOT_TOKENS = BUCKET_PAIRS // 4
END_HASH = np.uint64(0x5EEDE4D05EEDE4D1)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), dtype)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, list[np.ndarray]]]:
    """(part number, rows, word hashes of each text with the end token) in bounded parts."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).to_numpy()
        cut = np.concatenate(([0], np.cumsum(sizes) // PART_CHARS)).astype(int)
        at = 0
        while at < len(batch):
            end = at + 1
            while end < len(batch) and cut[end] == cut[at] and end - at < 60_000:
                end += 1
            rows = batch.iloc[at:end]
            yield number, rows, [np.append(word_hashes(t or ""), END_HASH) for t in rows["text"]]
            number += 1
            at = end


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    if not len(bucket):
        return
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(bucket)])), strict=True):
        yield int(bucket[lo]), slice(int(lo), int(hi))


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 1 .. GOOD_TURING from the numbers of pairs seen 1 ..
    GOOD_TURING + 1 times; a half token each where the numbers are too sparse for them."""
    k = GOOD_TURING
    r = np.arange(1, k + 1)
    flat = (r - 0.5) / r
    if (n <= 0).any():
        return flat
    tail = (k + 1) * n[k] / n[0]
    d = ((r + 1) * n[1:] / (r * n[:k]) - tail) / (1 - tail) if tail < 1 else np.full(k, -1.0)
    return np.where((d > 0) & (d < 1), d, flat)


def _pack_planes(x: np.ndarray) -> bytes:
    """Compressed with the bytes of equal weight side by side."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack_planes(x: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack_planes(np.diff(x, prepend=x.dtype.type(0)))


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(x, "<u8"), dtype=np.uint64)


BLOCK = "part long, doc_ids binary, no_id binary, held binary, sizes binary, codes binary"


def text_blocks(docs: DataFrame) -> DataFrame:
    """One row per part of the input: its documents' tokens as codes by falling frequency in the part,
    and the hash of each code's word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rows, words in _parts(batches):
            sizes = np.array([len(w) for w in words], dtype="<u4")
            h, at, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            code = np.empty(len(h), dtype="<u4")
            code[order] = np.arange(len(h), dtype="<u4")
            no_id = rows["doc_id"].isna().to_numpy()
            ids = np.array([0 if i is None else int(i) for i in rows["doc_id"]], dtype="<i8")
            held = rows["held_out"].to_numpy(dtype=bool)
            yield pd.DataFrame(
                [(part, _pack(ids), _pack(no_id), _pack(held), _pack(sizes), _pack_planes(code[at]), _pack_keys(h), _pack_planes(code), int(sizes.sum()))],
                columns=["part", "doc_ids", "no_id", "held", "sizes", "codes", "hashes", "places", "tokens"],
            )

    return ids_as_text(docs, "doc_id").mapInPandas(run, BLOCK + ", hashes binary, places binary, tokens long")


def _word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that words in the order of their hashes are in the order of their buckets."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def number_words(blocks: DataFrame, buckets: int, hot_tokens: int) -> DataFrame:
    """(bucket, part, ids, counts, ...): number and training count of every word of a part. Frequent words
    have small numbers, so that their bytes compress. The first row of a bucket has the bucket's sums and
    the numbers of its hot words."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                h, code = _unpack_keys(r.hashes), _unpack_planes(r.places, "<u4")
                train = np.repeat(~_unpack(r.held, "?"), _unpack(r.sizes, "<u4"))
                n = np.bincount(_unpack_planes(r.codes, "<u4")[train], minlength=len(h))[code].astype("<u8")
                yield pd.DataFrame(
                    [(b, r.part, _pack_keys(h[s]), _pack_planes(n[s])) for b, s in _by_bucket(_word_bucket(h, buckets))],
                    columns=["bucket", "part", "hashes", "counts"],
                )

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        h = [_unpack_keys(x) for x in rows["hashes"]]
        every, at = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_unpack_planes(x, "<u8") for x in rows["counts"]])).astype("<u8")
        ids = np.empty(len(every), "<u8")
        ids[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(every), dtype="<u8") * np.uint64(buckets) + np.uint64(rows["bucket"].iloc[0])
        own = np.split(at, np.cumsum([len(x) for x in h])[:-1])
        return pd.DataFrame(
            {
                "bucket": rows["bucket"],
                "part": rows["part"],
                "ids": [_pack_planes(ids[x]) for x in own],
                "counts": [_pack_planes(n[x]) for x in own],
                "words": np.where(np.arange(len(rows)) == 0, len(every), 0),
                "types": np.where(np.arange(len(rows)) == 0, np.count_nonzero(n), 0),
                "tokens": np.where(np.arange(len(rows)) == 0, int(n.sum()), 0),
                "hot": [ids[n > hot_tokens].tolist() if k == 0 else [] for k in range(len(rows))],
            }
        )

    sent = blocks.select("part", "held", "sizes", "codes", "hashes", "places").mapInPandas(send, "bucket long, part long, hashes binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(
        number, "bucket long, part long, ids binary, counts binary, words long, types long, tokens long, hot array<long>"
    )


def _history(count: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of (scale of seen n-grams over the history's count, backoff weight) of histories with
    ``count`` tokens, ``kept`` of them after discounts, whose seen words have the mass ``seen`` after the
    shorter history; zeros for histories without tokens."""
    known, count = count > 0, np.maximum(count, 1)
    left = 1 - kept / count
    floor = 1 / (count + 1)  # a history of frequent n-grams only keeps a token's share
    scale = np.where(left < floor, (1 - floor) / np.maximum(1 - left, 1e-300), 1.0)
    return np.where(known, np.log10(scale) - np.log10(count), 0.0), np.where(known, np.log10(np.maximum(left, floor) / (1 - seen)), 0.0)


#: Rows of a history's sums: tokens, n-grams seen 1 .. GOOD_TURING times, n-grams (of pairs only), and of
#: their words the counts after the shorter history, summed, and how many of these are 1 .. GOOD_TURING (of
#: triples only).
SUMS = 3 + 2 * GOOD_TURING


BELOW = GOOD_TURING + 2
_REST = [k for k in range(SUMS) if k not in (0, BELOW)]


def _pack_sums(s: np.ndarray) -> bytes:
    """Sums of histories; of those with one token, two rows tell the others."""
    return _pack_planes(np.concatenate((np.array([s.shape[1]], "<u8"), s[0], s[BELOW], s[_REST][:, s[0] > 1].ravel())))


def _unpack_sums(x: bytes, pairs: bool) -> np.ndarray:
    a = _unpack_planes(x, "<u8")
    k = int(a[0])
    s = np.zeros((SUMS, k))
    s[0], s[BELOW] = a[1 : k + 1], a[k + 1 : 2 * k + 1]
    s[np.ix_(_REST, s[0] > 1)] = a[2 * k + 1 :].reshape(len(_REST), -1)
    one = np.flatnonzero(s[0] == 1)
    s[1, one] = 1
    if pairs:
        s[GOOD_TURING + 1, one] = 1
    else:
        below = s[BELOW, one].astype(np.int64)
        few = below <= GOOD_TURING
        s[BELOW + below[few], one[few]] = 1
    return s


def _kept(total: np.ndarray, few: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Tokens that discounts ``d`` leave of ``total``, of which ``few`` n-grams were seen 1, 2 .. times."""
    return total - (np.arange(1, GOOD_TURING + 1) * (1 - d)) @ few


@dataclass(frozen=True)
class Corpus:
    tokens: int
    types: int
    buckets: int

    @property
    def base(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


@dataclass(frozen=True)
class Level:
    """What all tasks know of an order: its hot histories, sorted, later their sums and the discounts."""

    hot: np.ndarray
    sums: np.ndarray | None = None
    d: np.ndarray | None = None

    def bucket(self, h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
        """A history's n-grams share a bucket, those of a hot one are spread."""
        return (mix(np.where(np.isin(h, self.hot), mix(h) ^ w, h)) % np.uint64(buckets)).astype("<i4")


@dataclass
class Grams:
    """The distinct n-grams of a part in the order of (bucket, history, last word)."""

    h: np.ndarray  # history: the number of a word, or of two words in 64 bits
    w: np.ndarray
    bucket: np.ndarray
    token: np.ndarray  # a token where the n-gram ends
    of: np.ndarray  # n-gram of every token that has one
    order: np.ndarray  # place in the order of (history, last word)

    @classmethod
    def find(cls, keys: np.ndarray, histories: np.ndarray | None, level: Level, buckets: int) -> Grams:
        """``keys``: history, or its place among the sorted ``histories``, and last word of every token."""
        keys, of = np.unique(keys, return_inverse=True)
        of = of.astype("<i4")
        h, w = keys >> np.uint64(32), keys.astype("<u4")
        if histories is not None:
            h = histories[h.astype("<i4")]
        del keys
        bucket = level.bucket(h, w, buckets)
        order = np.argsort(bucket.astype("<u2") if buckets < 1 << 16 else bucket, kind="stable").astype("<i4")
        place, token = np.empty(len(order), "<i4"), np.empty(len(order), "<i4")
        place[order] = np.arange(len(order), dtype="<i4")
        of = place[of]
        token[of] = np.arange(len(of), dtype="<i4")
        return cls(h[order], w[order], bucket[order], token, of, order)

    def pairs(self) -> np.ndarray:
        """Pairs in 64 bits, sorted."""
        out = np.empty(len(self.h), "<u8")
        out[self.order] = (self.h << np.uint64(32)) | self.w
        return out


class Part:
    """The tokens of a part, with what the buckets told of its words and of the orders so far."""

    def __init__(self, block: pd.DataFrame, told: pd.DataFrame, corpus: Corpus, levels: list[Level]) -> None:
        r = next(block.itertuples(index=False))
        self.corpus, self.levels, self.told = corpus, levels, told.sort_values(["level", "bucket"])
        found = self.told[self.told["level"] == 1]
        at = _unpack_planes(r.places, "<u4")
        ids, self.counts = np.empty(len(at), "<u4"), np.empty(len(at), "<u8")
        ids[at] = np.concatenate([_unpack_planes(x, "<u8") for x in found["a"]])
        self.counts[at] = np.concatenate([_unpack_planes(x, "<u8") for x in found["b"]])
        self.sizes, self.codes = _unpack(r.sizes, "<u4").astype(np.int64), _unpack_planes(r.codes, "<u4")
        self.held = _unpack(r.held, "?")
        self.doc = np.repeat(np.arange(len(self.sizes), dtype="<u2"), self.sizes)
        self.word = ids[self.codes]
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        before = np.empty(len(self.word), "<u8")
        before[1:] = self.word[:-1]
        before[self.first] = self.word[ends[0] - 1]
        self.pairs = Grams.find((before << np.uint64(32)) | self.word, None, levels[0], corpus.buckets)

    def triples(self) -> tuple[Grams, np.ndarray]:
        """The triples, and the tokens that have one: all but the first of a text."""
        has = np.ones(len(self.word), dtype=bool)
        has[self.first] = False
        at = np.flatnonzero(has).astype("<i4")
        keys = (self.pairs.order[self.pairs.of[at - 1]].astype("<u8") << np.uint64(32)) | self.word[at]
        return Grams.find(keys, self.pairs.pairs(), self.levels[1], self.corpus.buckets), at

    def seen(self, level: int) -> np.ndarray:
        """Training count of every n-gram."""
        found = [_unpack_planes(x, "<u8") for x in self.told["a"][self.told["level"] == level]]
        return np.concatenate(found) if found else np.zeros(0, "<u8")

    def histories(self, level: int, g: Grams, mass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of scale over tokens, log10 of backoff weight, first n-gram) of the runs of n-grams of one
        history; ``mass`` takes sums and runs to the mass of the seen words after the shorter history."""
        start = np.flatnonzero(_starts(g.h, g.bucket))
        scale, alpha, at = np.empty(len(start)), np.empty(len(start)), 0
        known = self.levels[level - 2]
        for x in self.told["b"][self.told["level"] == level]:
            sums = _unpack_sums(x, level == 2)
            runs = slice(at, at + sums.shape[1])
            h = g.h[start[runs]]
            hot = np.isin(h, known.hot)
            if hot.any():
                sums[:, hot] = known.sums[:, np.searchsorted(known.hot, h[hot])]
            scale[runs], alpha[runs] = _history(sums[0], _kept(sums[0], sums[1 : GOOD_TURING + 1], known.d), mass(sums, start[runs]))
            at = runs.stop
        return scale, alpha, start

    def scores(self) -> np.ndarray:
        """log10 P of every token."""
        g, d = self.pairs, self.levels[0].d
        scale, alpha, start = self.histories(2, g, lambda s, _: (s[BELOW] + 0.5 * s[GOOD_TURING + 1]) / self.corpus.base)
        scale, alpha = _spread(scale, start, g), _spread(alpha, start, g)
        pair = _log_p(self.seen(2), d, scale, alpha + np.log10((self.counts[self.codes[g.token]] + 0.5) / self.corpus.base))
        out = pair[g.of]
        if len(self.levels) > 1:
            g, at = self.triples()
            last = self.pairs.of[at[g.token]]  # the pair that ends the triple
            shorter = 10 ** scale[last]
            scale, alpha, start = self.histories(3, g, lambda s, k: _kept(s[BELOW], s[BELOW + 1 :], d) * shorter[k])
            out[at] = _log_p(self.seen(3), self.levels[1].d, _spread(scale, start, g), _spread(alpha, start, g) + pair[last])[g.of]
        return out


def _spread(x: np.ndarray, start: np.ndarray, g: Grams) -> np.ndarray:
    """Values of runs for each of their n-grams."""
    return np.repeat(x, np.diff(start, append=len(g.h)))


def _starts(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where a history's n-grams begin within a bucket."""
    out = np.ones(len(h), dtype=bool)
    out[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
    return out


def _log_p(n: np.ndarray, d: np.ndarray, scale: np.ndarray, back: np.ndarray) -> np.ndarray:
    """log10 P of n-grams seen ``n`` times: the discounted share, or where unseen ``back``."""
    n = n.astype(np.int64)
    share = np.concatenate(([0.0], np.log10(d)))[np.where(n <= GOOD_TURING, n, 0)]
    return np.where(n > 0, np.log10(np.maximum(n, 1)) + share + scale, back)


def _text_grams(part: Part) -> tuple[Grams, np.ndarray, np.ndarray]:
    """(n-grams of the next order, their training counts in the part, counts of those trained here without
    their first word); that order is 2 until the buckets have told of the pairs."""
    if len(part.levels) == 1:
        g, at, lower = part.pairs, None, part.counts[part.codes[part.pairs.token]]
    else:
        g, at = part.triples()
        lower = part.seen(2)[part.pairs.of[at[g.token]]]
    doc = part.doc if at is None else part.doc[at]
    n = np.bincount(g.of[~part.held[doc]], minlength=len(g.h)).astype("<u8")
    return g, n, np.where(n > 0, lower, 0).astype("<u8")


def counted_grams(blocks: DataFrame, told: DataFrame, corpus: Corpus, levels: list[Level], hot_tokens: int) -> DataFrame:
    """One row per part and bucket: counts of its n-grams of the last of ``levels`` and sums of their
    histories. The first row of a bucket has the numbers of n-grams seen 1 .. GOOD_TURING + 1 times, the
    bucket's share of the sums of hot histories, and its pairs that are hot histories of the next order."""
    ranks = range(1, GOOD_TURING + 2)

    def send(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        g, n, lower = _text_grams(Part(block, found, corpus, levels))
        part, start = block["part"].iloc[0], _starts(g.h, g.bucket)
        step = np.where(start, g.w, np.diff(g.w, prepend=g.w[:1]))
        return pd.DataFrame(
            [(b, part, _pack_keys(g.h[s]), _pack_planes(step[s]), _pack_planes(n[s]), _pack_planes(lower[s])) for b, s in _by_bucket(g.bucket)],
            columns=["bucket", "part", "histories", "steps", "counts", "lower"],
        )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        h = [_unpack_keys(x) for x in rows["histories"]]
        starts = [_starts(x, np.zeros(len(x))) for x in h]
        cut = np.cumsum([len(x) for x in h])[:-1]
        h, at = np.unique(np.concatenate(h), return_inverse=True)
        at = at.astype("<i4")
        start = np.concatenate(starts)
        w = np.cumsum(np.concatenate([_unpack_planes(x, "<u4") for x in rows["steps"]]), dtype="<u8")
        w -= np.concatenate((w[:1] * 0, w[:-1]))[start][np.cumsum(start) - 1]
        w |= at.astype("<u8") << np.uint64(32)
        keys, of = np.unique(w, return_inverse=True)
        of = of.astype("<i4")
        del w
        counts = np.concatenate([_unpack_planes(x, "<u8") for x in rows["counts"]])
        n, lower = np.bincount(of, weights=counts), np.zeros(len(keys))
        lower[of[counts > 0]] = np.concatenate([_unpack_planes(x, "<u8") for x in rows["lower"]])[counts > 0]
        trained = n > 0
        own, seen, below = (keys[trained] >> np.uint64(32)).astype(np.int64), n[trained], lower[trained]
        few, pairs_only = range(1, GOOD_TURING + 1), len(levels) == 1
        of_history = [seen, *[seen == r for r in few], np.full(len(seen), pairs_only), below, *[(below == r) & (not pairs_only) for r in few]]
        sums = np.empty((SUMS, len(h)), "<u8")
        for k, x in enumerate(of_history):
            sums[k] = np.bincount(own, weights=x, minlength=len(h))
        hot = np.flatnonzero(np.isin(h, levels[-1].hot))
        large = np.flatnonzero(n > hot_tokens) if pairs_only else np.zeros(0, np.int64)
        pairs = (h[(keys[large] >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (keys[large] & np.uint64(0xFFFFFFFF))
        one = {"hot": [[int(h[k]).to_bytes(8, "little"), sums[:, k].astype(float).tolist()] for k in hot], "pairs": pairs.astype("<i8").tolist()}
        one |= {f"n{r}": int(np.count_nonzero(n == r)) for r in ranks}
        n = n.astype("<u8")
        out = [
            (b, p, _pack_planes(n[o]), _pack_sums(sums[:, a[s]]))
            for b, p, o, a, s in zip(rows["bucket"], rows["part"], np.split(of, cut), np.split(at, cut), starts, strict=True)
        ]
        none = {c: [] if isinstance(x, list) else 0 for c, x in one.items()}
        return pd.DataFrame([dict(zip(("bucket", "part", "a", "b"), x, strict=True)) | (none if k else one) for k, x in enumerate(out)])

    own = blocks.select("part", "sizes", "codes", "held", "places")
    sent = own.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(
        send, "bucket long, part long, histories binary, steps binary, counts binary, lower binary"
    )
    return sent.groupBy("bucket").applyInPandas(
        merge, "bucket long, part long, a binary, b binary, hot array<struct<h: binary, sums: array<double>>>, pairs array<long>, " + ", ".join(f"n{r} long" for r in ranks)
    )


def counted_level(counted: DataFrame, level: Level) -> tuple[Level, np.ndarray]:
    """(the order with its discounts and the sums of its hot histories, hot histories of the next order)"""
    seen = counted.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, GOOD_TURING + 2)]).first()
    sums = np.zeros((SUMS, len(level.hot)))
    if len(level.hot):
        rows = counted.select(F.explode("hot").alias("r")).groupBy("r.h").agg(*[F.sum(F.col("r.sums")[k]) for k in range(SUMS)]).collect()
        for r in rows:
            sums[:, np.searchsorted(level.hot, np.uint64(int.from_bytes(r[0], "little")))] = r[1:]
    pairs = counted.select(F.explode("pairs").alias("p")).collect()
    return Level(level.hot, sums, discounts(np.array(seen, dtype=float))), np.sort(np.array([r["p"] for r in pairs], dtype="<i8").view("<u8"))


def score_texts(blocks: DataFrame, told: DataFrame, corpus: Corpus, levels: list[Level]) -> DataFrame:
    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        part = Part(block, found, corpus, levels)
        r, c = next(block.itertuples(index=False)), part.counts[part.codes]
        return pd.DataFrame(
            {
                "doc_id": pd.Series(_unpack(r.doc_ids, "<i8"), dtype="Int64").mask(_unpack(r.no_id, "?")),
                "held_out": part.held,
                "n_tokens": part.sizes,
                "n_known": np.bincount(part.doc, weights=c > 0).astype(np.int64),
                "train_tokens": corpus.tokens,
                "base_score": np.bincount(part.doc, weights=np.log10((c + 0.5) / corpus.base)),
                "score": np.bincount(part.doc, weights=part.scores()),
            }
        )

    return (
        blocks.drop("tokens", "hashes").groupBy("part").cogroup(told.groupBy("part"))
        .applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def katz_scores(docs: DataFrame, held_out: Column | None = None, text_col: str = "text", hot_tokens: int = HOT_TOKENS, order: int = 2) -> DataFrame:
    """Train n-grams up to ``order`` (2 or 3) on the documents that are not held out (default: crc32 of
    the id modulo 5 is 1) and score all."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1 if held_out is None else held_out, F.lit(True))
    blocks = stage_by(text_blocks(spread(docs.select("doc_id", F.col(text_col).alias("text"), held.alias("held_out")))), "blocks", "part")
    buckets = max(8, int((blocks.agg(F.sum("tokens")).first()[0] or 0) // BUCKET_PAIRS))
    numbers = stage(number_words(blocks, buckets, hot_tokens), "words")
    found = numbers.where("words > 0").select("words", "types", "tokens", "hot").collect()
    if max((r["words"] for r in found), default=0) * buckets >= 1 << 32:
        raise ValueError("n-grams hold 32-bit word numbers")
    corpus = Corpus(sum(r["tokens"] for r in found), sum(r["types"] for r in found), buckets)
    hot = np.sort(np.array([k for r in found for k in r["hot"]], dtype="<u8"))
    told = numbers.select("part", F.lit(1).alias("level"), "bucket", F.col("ids").alias("a"), F.col("counts").alias("b"))
    levels: list[Level] = []
    for n in range(2, order + 1):
        levels.append(Level(hot))
        counted = stage(counted_grams(blocks, told, corpus, levels, hot_tokens), f"grams{n}")
        levels[-1], hot = counted_level(counted, levels[-1])
        told = told.unionByName(counted.select("part", F.lit(n).alias("level"), "bucket", "a", "b"))
    return score_texts(blocks, told, corpus, levels)
