"""Vector codes: product quantisation whose rounds skip entries by norm-of-sum bounds.

A vector of whole numbers is cut into consecutive parts, each coded by the nearest entry of a codebook
of its own. A round assigns every part, then moves every entry to the mean of its parts.

Every codebook of the past is retained. A row carries, for each part and each group of entries, a lower
bound on the distance to the group's entries other than its own, stamped with the round in which it was
measured. In a later round the bound is that distance less the largest net displacement in the group:
the norm of the sum of an entry's moves since the stamp, which is never more and mostly less than the
sum of their norms. A group whose bound exceeds the exact distance to the row's entry is passed over;
the others are scanned exactly and stamped anew. When a part leaves its entry, that entry joins the
others of its group with its distance at the group's stamp, which the retained codebook gives.

Rows and bounds are written after every round, so a lost executor repeats tasks of one round. Sums come
from partial sums per task (at most one row per entry), so copies and hot entries cost nothing extra.
What travels through the driver is a codebook, whose size is fixed by ``entries`` and the dimension.

Defined cases: rows whose vector is null or holds null or non-finite components go; so do vectors of
another length than the most frequent one that can be cut (the shorter on a tie); the first codebooks
take the rows with the smallest ids (null ids last, equal ids by their components), fewer if there are
fewer; every row is coded, also repeated ones; null labels are one label; an empty table gives an empty
result; components beyond exact 64-bit sums raise an error; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, small_side, spread, stage
from .whole_vectors import exact, largest, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of entries that share a bound.
GROUPS = 16
#: Labels that are broadcast with their sums; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000


@dataclass(frozen=True)
class Codebooks:
    """history[t, part, entry] is an entry after t rounds; groups[part] lists the entries of each group."""

    history: np.ndarray
    groups: list[list[np.ndarray]]

    def moved(self, part: int) -> np.ndarray:
        """[stamp, group]: largest net displacement of the group's entries from that round to now."""
        steps = (self.history[-1, part] - self.history[:, part]).astype(np.float64)
        norms = np.sqrt((steps * steps).sum(axis=2))
        return np.stack([norms[:, g].max(axis=1) for g in self.groups[part]], axis=1)

    def now(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.now().ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int) -> list[np.ndarray]:
    """Entries that lie together: a few rounds of means over their starting places."""
    centres = entries[:: max(1, len(entries) // groups)][:groups].astype(np.float64)
    own = np.zeros(len(entries), np.int64)
    for _ in range(8):
        own = ((entries[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([entries[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
    return [np.flatnonzero(own == k) for k in np.unique(own)]


@dataclass
class Bounds:
    """Per row and part: own entry, and per group a distance and the round it was measured in."""

    own: np.ndarray
    low: np.ndarray
    stamp: np.ndarray


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def _below(distance2: np.ndarray) -> np.ndarray:
    """Distances as single floats, rounded down."""
    return np.nextafter(np.sqrt(distance2).astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, books: Codebooks, before: Bounds | None) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """(bounds with nearest entries, ties to the lower index; squared distances; entries compared) of
    every row and part. ``before``: the bounds of an earlier round, none in the first."""
    n, parts, width = len(x), books.history.shape[1], books.history.shape[3]
    now = len(books.history) - 1
    reach = 2 * largest(x, books.history)
    x, history = exact(width * reach * reach, x, books.history)
    out = Bounds(np.zeros((n, parts), np.int64), np.zeros((n, parts, GROUPS), np.float32), np.zeros((n, parts, GROUPS), np.uint8))
    if before is not None:
        out = Bounds(before.own.astype(np.int64), before.low.copy(), before.stamp.copy())
    error, compared = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
    for p, groups in enumerate(books.groups):
        y, c = x[:, p * width : (p + 1) * width], history[now, p]
        own, low, stamp = out.own[:, p], out.low[:, p], out.stamp[:, p]
        left = own.copy()
        best = ((y - c[own]) ** 2).sum(axis=1)
        if before is None:
            scan = np.ones((n, len(groups)), dtype=bool)
        else:
            bound = low[:, : len(groups)] - books.moved(p)[stamp[:, : len(groups)], np.arange(len(groups))[None, :]]
            scan = bound <= (np.sqrt(best.astype(np.float64)) * (1 + 1e-6) + 1e-3)[:, None]
        seen = []
        for k, members in enumerate(groups):
            rows = np.flatnonzero(scan[:, k])
            if not len(rows):
                continue
            d = _squared(y[rows], c[members])
            at, line = d.argmin(axis=1), np.arange(len(rows))
            least, entry = d[line, at].copy(), members[at]
            d = d.astype(np.float64)
            d[line, at] = np.inf
            seen.append((k, rows, least, entry, d.min(axis=1)))
            nearer = (least < best[rows]) | ((least == best[rows]) & (entry < own[rows]))
            best[rows[nearer]], own[rows[nearer]] = least[nearer], entry[nearer]
            compared[rows] += len(members)
        for k, rows, least, entry, second in seen:
            low[rows, k] = _below(np.where(entry == own[rows], second, least))
            stamp[rows, k] = now
        group_of = np.zeros(len(c), np.int64)
        for k, members in enumerate(groups):
            group_of[members] = k
        moved = np.flatnonzero((own != left) & ~scan[np.arange(n), group_of[left]])
        k = group_of[left[moved]]
        there = ((y[moved] - history[stamp[moved, k], p, left[moved]]) ** 2).sum(axis=1)
        low[moved, k] = np.minimum(low[moved, k], _below(there))
        error[:, p] = best
    return out, error, compared


STATE = "vec_id string, label string, x array<long>, own binary, low binary, stamp binary, compared long"


def _assigned(rows: DataFrame, books: Codebooks, schema: str) -> DataFrame:
    """One round over all rows; ``schema`` picks the columns that are written."""
    names = [c.split()[0] for c in schema.split(", ")]
    parts = books.history.shape[1]
    first = "own" not in rows.columns

    def unpack(column: pd.Series, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), parts, -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            before = None if first else Bounds(unpack(batch["own"], "<u2")[:, :, 0], unpack(batch["low"], "<f4"), unpack(batch["stamp"], "u1"))
            now, error, compared = assign(matrix(batch["x"]), books, before)
            own, low, stamp = now.own.astype("<u2"), now.low.astype("<f4"), now.stamp.astype("u1")
            more = {
                "own": [a.tobytes() for a in own],
                "low": [a.tobytes() for a in low],
                "stamp": [a.tobytes() for a in stamp],
                "code": ["".join(f"{k:02x}" for k in a) for a in own],
                "error": error.sum(axis=1),
                "compared": compared,
            }
            yield batch.assign(**more)[names]

    return rows.mapInPandas(run, schema)


def _means(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, int]:
    """(entries moved to the floor of the mean of their parts, entries compared in the round)."""
    _, parts, entries, width = books.history.shape
    columns = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count, compared = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), 0
        for batch in batches:
            if not len(batch):
                continue
            own = np.frombuffer(b"".join(batch["own"]), "<u2").reshape(len(batch), parts).astype(np.int64)
            cell = (own + np.arange(parts) * entries).ravel()
            np.add.at(total, cell, matrix(batch["x"]).reshape(-1, width))
            count += np.bincount(cell, minlength=len(count))
            compared += int(batch["compared"].sum())
        used = np.flatnonzero(count)
        out = pd.DataFrame(total[used], columns=columns)
        yield out.assign(cell=used, n=count[used], compared=np.where(np.arange(len(used)) == 0, compared, 0))

    schema = ", ".join([*(f"{c} long" for c in columns), "cell long", "n long", "compared long"])
    partial = state.select("x", "own", "compared").mapInPandas(run, schema)
    found = partial.groupBy("cell").agg(*[F.sum(c).alias(c) for c in (*columns, "n", "compared")]).collect()
    out = books.now().reshape(-1, width).copy()
    for r in found:
        out[r["cell"]] = [r[c] // r["n"] for c in columns]
    return out.reshape(parts, entries, width), sum(r["compared"] for r in found)


@dataclass(frozen=True)
class Compressed:
    """codes: (vec_id, label, code, error) per row; compared: entries compared with parts per round, of
    rows x parts x entries."""

    codes: DataFrame
    codebooks: Codebooks | None
    compared: list[int]


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> Compressed:
    """Fit the codebooks on all rows and code all rows."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    every = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole(F.col(vec_col), scale).alias("x")).where("x is not null")
    kind = dict(every.dtypes)["label"]
    kept = stage(spread(every), "vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where((F.col("d") > 0) & (F.col("d") % parts == 0))
    dim = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    if not dim:
        return Compressed(kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None, [])
    kept = kept.where(F.size("x") == dim[0]["d"])
    seeds = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r["x"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start[None], [grouped(e, GROUPS) for e in start])
    rows, compared = ids_as_text(kept, "vec_id").withColumn("label", F.col("label").cast("string")), []
    for _ in range(rounds):
        rows = stage(_assigned(rows, books, STATE), "bounds")
        after, n = _means(rows, books)
        compared.append(n)
        books = Codebooks(np.concatenate([books.history, after[None]]), books.groups)
    codes = ids_as_long(_assigned(rows, books, "vec_id string, label string, code string, error long"), "vec_id")
    return Compressed(stage(codes.withColumn("label", F.col("label").cast(kind)), "codes"), books, compared)


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that each code stands for: the middles of its entries' components."""
    now = (books.now() + 0.5) / scale

    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else np.concatenate([now[p, k] for p, k in enumerate(bytes.fromhex(c))]))

    return codes.withColumn("decoded", F.pandas_udf(run, "array<double>")("code"))


def code_digest(compressed: Compressed) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every coded row."""
    codes = compressed.codes
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = compressed.codebooks.sha256() if compressed.codebooks else hashlib.sha256(b"").hexdigest()
    joined = codes.join(small_side(stage(sums, "labels"), BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
