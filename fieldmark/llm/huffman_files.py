"""Token ids in Huffman-coded files: canonical length-limited codes, independent blocks, checkpoints.

Ids are counted over all documents while they are encoded; the driver builds code lengths of at most
``MAX_BITS`` by package-merge from the counts of the vocabulary's ids, a table whose size the
vocabulary bounds. The lengths are written beside the blocks, so the files are read from their path
alone.
Documents go in ascending doc_id order, range-partitioned, into files of blocks; a block holds whole
documents, its bit stream, and the bit offset of every ``STEP``-th id, so that a reader decodes a
block alone and all its stretches in step, by table look-up.

Table columns: format, n_ids (size of the vocabulary), end_id, lengths (one byte per id, zlib).
Block columns: part, block (order in the part), part_start (ids before it in the part), n_ids,
doc_ids and doc_sizes (little-endian 64-bit), no_id (one byte per document, 1 where the id is null),
checkpoints (little-endian unsigned 64-bit bit offsets), payload (the bit stream, most significant
bit first).

Defined cases: a null text is the empty text, one end id; an empty table gives no rows; repeated
rows are stored one by one, in an order set by their ids; rows with a null doc_id come first; extra
columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, new_path, spread, stage
from .token_cache import tokenizer

MAX_BITS = 18
STEP = 128
BLOCK_IDS = 1 << 20
#: Bytes of ids counted at a time.
COUNTED_BYTES = 1 << 22
FORMAT = 1
HEADER_SCHEMA = "format int, n_ids int, end_id int, lengths binary"
BLOCK_SCHEMA = (
    "part int, block int, part_start long, n_ids long, doc_ids binary, no_id binary, doc_sizes binary, checkpoints binary, payload binary"
)


def tokenize(docs: DataFrame, path: str, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): ids as little-endian unsigned integers of the width the vocabulary needs.
    The last row of each task has no ids; it holds the task's count of every id, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path, end_id)
        total = np.zeros(enc.size, dtype="<i8")
        for batch in batches:
            ids = list(enc.encode(t or "" for t in batch["text"]))
            for lo, hi in _runs([len(x) for x in ids], COUNTED_BYTES):
                total += np.bincount(np.frombuffer(b"".join(ids[lo:hi]), enc.dtype), minlength=enc.size)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "counts": None})
        yield pd.DataFrame({"doc_id": [None], "ids": [None], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = ids_as_text(spread(docs.select("doc_id", F.col(text_col).alias("text"))), "doc_id")
    return ids_as_long(rows.mapInPandas(run, "doc_id string, ids binary, counts binary"), "doc_id")


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive stretches of ``most`` in sum, or of a single larger one."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Global count of every id from the tasks' counts: at most ``size`` rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype="<i8")
        for batch in batches:
            for x in batch["counts"]:
                total += np.frombuffer(zlib.decompress(x), "<i8")
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counts = np.zeros(size, dtype=np.int64)
    told = tokens.select("counts").where("counts is not null").mapInPandas(run, "id long, n long")
    for r in told.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_of: list[np.ndarray] = []
    row = weights
    for _ in range(max_bits - 1):
        packages = row[0 : len(row) - len(row) % 2 : 2] + row[1::2]
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        leaf_of.append(place < n)
        row = both[place]
    take = 2 * n - 2
    found = np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(leaf_of):
        leaves = int(is_leaf[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in ascending (length, id) order, each the successor of the one before."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        top = int(sizes.max())
        left = (np.int64(1) << (top - sizes)).cumsum()  # of a full-width number line
        codes[order] = ((left - (np.int64(1) << (top - sizes))) >> (top - sizes)).astype(np.uint64)
    return codes


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every STEP-th id)."""
    size = lengths[ids].astype(np.int64)
    ends = size.cumsum()
    offset = ends - size
    # a code of at most 32 bits lies in one or two 32-bit words; the bits of all codes are disjoint
    bits = codes[ids] << (64 - size - (offset & 31)).astype(np.uint64)
    word = offset >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    stream = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 1, dtype=np.uint64)
    if len(ids):
        stream[word[first]] = np.add.reduceat(bits >> np.uint64(32), first)
        stream[word[first] + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    return stream.astype(">u4").tobytes(), offset[::STEP].astype("<u8")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(id * 32 + code length for every bit string of the longest code's length, that length)."""
    bits = int(lengths.max()) if len(lengths) and lengths.max() else 1
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    rows = np.repeat(order * 32 + size, np.int64(1) << (bits - size))
    table = np.ones(1 << bits, dtype=np.int64)
    table[: len(rows)] = rows
    return table, bits


def decode_ids(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, int]) -> np.ndarray:
    """All stretches between checkpoints are decoded in step, one id of each at a time."""
    known, bits = table
    raw = np.frombuffer(payload, np.uint8).astype(np.int64)
    quad = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos = checkpoints.astype(np.int64)
    out = np.empty((STEP, len(pos)), dtype=np.uint32)
    last = len(quad) * 8 - 1
    mask = (1 << bits) - 1
    for k in range(STEP):
        hit = known[(quad[pos >> 3] >> (32 - bits - (pos & 7))) & mask]
        out[k] = hit >> 5
        pos += hit & 31
        np.minimum(pos, last, out=pos)
    return out.T.reshape(-1)[:n]


def coded_blocks(tokens: DataFrame, lengths: np.ndarray, width: int) -> DataFrame:
    """Blocks of all documents in ascending doc_id order (see the module for their columns)."""
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, done = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            payload, marks = encode_ids(np.concatenate(held).astype(np.int64), codes, lengths)
            return pd.DataFrame(
                {
                    "part": [part],
                    "block": [block],
                    "part_start": [done],
                    "n_ids": [size],
                    "doc_ids": [np.array([d or 0 for d in docs], "<i8").tobytes()],
                    "no_id": [np.array([d is None for d in docs]).tobytes()],
                    "doc_sizes": [np.array([len(h) for h in held], "<i8").tobytes()],
                    "checkpoints": [marks.tobytes()],
                    "payload": [payload],
                }
            )

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                docs.append(None if doc_id is None else int(doc_id))
                held.append(np.frombuffer(ids, f"<u{width}"))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    block, done, size = block + 1, done + size, 0
                    docs.clear()
                    held.clear()
        if docs:
            yield flush()

    rows = tokens.where("ids is not null").select("doc_id", "ids")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    return ids_as_text(ordered, "doc_id").mapInPandas(run, BLOCK_SCHEMA)


def write_files(tokens: DataFrame, path: str, size: int, width: int, end_id: int) -> None:
    """Writes ``tokens`` as a code table (``path``/table) and blocks (``path``/blocks)."""
    lengths = code_lengths(id_counts(tokens, size))
    header = [(FORMAT, size, end_id, bytearray(zlib.compress(lengths.tobytes())))]
    tokens.sparkSession.createDataFrame(header, HEADER_SCHEMA).coalesce(1).write.parquet(f"{path}/table")
    coded_blocks(tokens, lengths, width).write.parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files at
    ``path`` alone. The driver gathers one total per part."""
    header = spark.read.schema(HEADER_SCHEMA).parquet(f"{path}/table").first()
    if header is None or header["format"] != FORMAT:
        raise ValueError(f"{path} holds no files of format {FORMAT}")
    lengths = np.frombuffer(zlib.decompress(header["lengths"]), np.uint8)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before: dict[int, int] = {}
    seen = 0
    for part in sorted(totals):
        before[part] = seen
        seen += totals[part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(lengths)
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = decode_ids(b.payload, np.frombuffer(b.checkpoints, "<u8"), b.n_ids, table).astype("<u4")
                sizes = np.frombuffer(b.doc_sizes, "<i8")
                starts = sizes.cumsum() - sizes
                own = [ids[s : s + n].tobytes() for s, n in zip(starts, sizes, strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(np.frombuffer(b.doc_ids, "<i8"), dtype="Int64").mask(np.frombuffer(b.no_id, "?")),
                        "start": starts + b.part_start + before[b.part],
                        "n_tokens": sizes,
                        "ids_crc32": [zlib.crc32(x) for x in own],
                    }
                    | ({"ids": own} if keep_ids else {})
                )

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def huffman_round_trip(docs: DataFrame, path: str, end_id: int = 2, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode with the vocabulary at ``path``, write the files into the shared folder, read them back."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    tokens = stage(tokenize(docs, path, end_id, text_col), "tokens")
    files = new_path(docs.sparkSession, "huffman")
    write_files(tokens, files, size, 2 if size <= 1 << 16 else 4, end_id)
    return read_files(docs.sparkSession, files, keep_ids)
