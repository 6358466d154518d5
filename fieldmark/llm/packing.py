"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest; all else stays whole. Piece
lengths fall into classes of up to four ids' width. The driver sees only the class histogram (at most
``seq_len`` numbers at any data size): a linear program over packing patterns, whose
columns a knapsack dynamic program prices, gives pattern counts; they are rounded down and a greedy
fill packs what is left. Pieces are then ranked in their class, salted so that no class is ranked in
one task, and a piece's rank tells its pattern, copy and so its sequence. Offsets are running sums
within a sequence.

Defined cases: a null text is the empty text, one end id long; an empty table gives no pieces;
repeated rows are packed one by one; ties in rank are broken by doc_id, start and the ids' checksum;
extra columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ids_as_long, ids_as_text, small_side, spread, stage
from .token_cache import tokenizer

#: Widths of length classes, the widest that divides the sequence length.
CLASS_WIDTHS = (4, 3, 2, 1)
#: The linear program ends when it is proven to be within this share of its optimum.
GAP = 2e-4
#: Pieces of a class that are ranked together.
RANK_GROUP = 1024


def tokenized_pieces(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 1, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path, end_id)
        for batch in batches:
            out = []
            for doc_id, narrow in zip(batch["doc_id"], enc.encode(t or "" for t in batch["text"]), strict=True):
                ids = np.frombuffer(narrow, enc.dtype).astype("<u4").tobytes()
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    piece = ids[4 * start : 4 * (start + seq_len)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n) + ((piece,) if keep_ids else ()))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    rows = ids_as_text(spread(docs.select("doc_id", F.col(text_col).alias("text"))), "doc_id")
    return ids_as_long(rows.mapInPandas(run, schema), "doc_id")


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes that fits."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for cap in range(1, room + 1):
        best[cap] = best[cap - 1]
        if k := upto[cap]:
            gains = best[cap - sizes[:k]] + values[:k]
            i = int(gains.argmax())
            if gains[i] > best[cap]:
                best[cap], taken[cap] = gains[i], i
    pattern = np.zeros(len(sizes), dtype=np.int64)
    cap = room
    while cap > 0:
        if taken[cap] < 0:
            cap -= 1
        else:
            pattern[taken[cap]] += 1
            cap -= sizes[taken[cap]]
    return best[room], pattern


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Starting columns: largest-first patterns, each used (in fractions) until it exhausts a class.
    A class that an earlier column exhausted is in no later one, so the columns are independent."""
    left = demand.astype(float).copy()
    open_ = np.ones(len(sizes), dtype=bool)
    basis = np.zeros((len(sizes), len(sizes)))
    while open_.any():
        pattern, free = np.zeros(len(sizes)), room
        for i in np.flatnonzero(open_)[::-1]:
            pattern[i] = min(np.ceil(left[i] - 1e-12) if left[i] >= 1 else 1, free // sizes[i])
            free -= pattern[i] * sizes[i]
        fits = np.flatnonzero(pattern)
        times = left[fits] / pattern[fits]
        out = fits[times.argmin()]
        left[fits] -= pattern[fits] * times.min()
        np.clip(left, 0, None, out=left)
        basis[:, out] = pattern
        open_[out] = False
        left[out] = 0
    return basis


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, most: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, their fractional counts) of the cutting-stock linear program: a revised
    simplex whose entering column is the best knapsack under the current prices. Ends when the
    larger of Farley's bound and the material bound proves the gap, or after ``most`` columns."""
    scale = demand.sum()
    basis = greedy_basis(sizes, demand, room)
    inverse = np.linalg.inv(basis)
    x = np.clip(inverse @ (demand / scale), 0, None)
    bound = float((sizes * demand).sum()) / room / scale
    for step in range(most):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, prices, room)
        bound = max(bound, x.sum() / max(value, 1.0))
        if x.sum() <= bound * (1 + gap):
            break
        along = inverse @ pattern
        can = along > 1e-9
        ratio = np.where(can, x / np.where(can, along, 1), np.inf)
        leaves = int(ratio.argmin())
        x -= ratio[leaves] * along
        x[leaves] = ratio[leaves]
        basis[:, leaves] = pattern
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = inverse @ (demand / scale)
        else:
            row = inverse[leaves] / along[leaves]
            inverse -= np.outer(along, row)
            inverse[leaves] = row
        np.clip(x, 0, None, out=x)
    return basis.T.astype(np.int64), x * scale


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """[(pattern, whole number of copies)] that together hold exactly the demand."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, copies: int) -> None:
        if copies > 0:
            plan.append((pattern.copy(), copies))
            left[:] -= pattern * copies

    patterns, counts = column_generation(sizes, demand, room)
    for i in np.argsort(-counts):
        fits = patterns[i] > 0
        use(patterns[i], min(int(counts[i] + 1e-6), int((left[fits] // patterns[i][fits]).min()) if fits.any() else 0))
    while left.any():
        pattern, free = np.zeros_like(left), room
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], free // sizes[i])
            free -= pattern[i] * sizes[i]
        fits = pattern > 0
        use(pattern, int((left[fits] // pattern[fits]).min()))
    return plan


def slot_table(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """class position -> (first rank, pieces per sequence, first sequence) of its runs of slots."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, copies in plan:
        for c in np.flatnonzero(pattern):
            a = int(pattern[c])
            runs.setdefault(int(c), []).append((used.get(int(c), 0), a, sequence))
            used[int(c)] = used.get(int(c), 0) + a * copies
        sequence += copies
    return {c: tuple(np.array(v, dtype=np.int64).T) for c, v in runs.items()}


def pack_pieces(pieces: DataFrame, seq_len: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is read several times: pass a table."""
    width = next(w for w in CLASS_WIDTHS if seq_len % w == 0)
    classed = pieces.withColumn("__class", F.ceil(F.col("length") / F.lit(width)).cast("int"))
    histogram = {r["__class"]: r["n"] for r in classed.groupBy("__class").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[c] for c in sizes], dtype=np.int64)
    slots = slot_table(plan_patterns(sizes, demand, seq_len // width))
    runs = {int(sizes[i]): v for i, v in slots.items()}
    groups = F.create_map(*[F.lit(x) for c, n in histogram.items() for x in (c, -(-n // RANK_GROUP))])

    salted = classed.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), groups[F.col("__class")]).cast("int"))
    sums = salted.groupBy("__class", "__salt").agg(F.count("*").alias("n"))
    before = sums.select(
        "__class",
        "__salt",
        (F.sum("n").over(Window.partitionBy("__class").orderBy("__salt")) - F.col("n")).alias("__before"),
    )
    inside = Window.partitionBy("__class", "__salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("__rank", F.row_number().over(inside) - 1).join(small_side(before, 20_000), ["__class", "__salt"])
    ranked = ranked.select(*pieces.columns, "__class", (F.col("__rank") + F.col("__before")).alias("__rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = np.zeros(len(batch), dtype=np.int64)
            cls, rank = batch["__class"].to_numpy(), batch["__rank"].to_numpy()
            for c in np.unique(cls):
                own = cls == c
                first, per, base = runs[int(c)]
                at = np.searchsorted(first, rank[own], side="right") - 1
                ids[own] = base[at] + (rank[own] - first[at]) // per[at]
            yield batch.drop(columns=["__class", "__rank"]).assign(sequence_id=ids)

    ranked = ids_as_text(ranked, "doc_id")
    fields = ", ".join(f"`{c}` {kind}" for c, kind in ranked.dtypes if c in pieces.columns)
    placed = ids_as_long(ranked.mapInPandas(place, f"{fields}, sequence_id long"), "doc_id")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    return placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def pack_documents(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 1, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``keep_ids`` carries the ids along."""
    return pack_pieces(stage(tokenized_pieces(docs, path, seq_len, end_id, text_col, keep_ids), "pieces"), seq_len)
