"""Exact merge-type subword encoding by backtracking, and decoding.

All vocabulary matches of a chunk come from one Aho-Corasick pass; encoding walks forward with the
longest match at each place, accepts a token only if re-merging it with its left neighbour leaves
the two apart, falls back to shorter matches, and marks places from which no token fits in a
bitfield, so that each place is given up at most once. Texts are cut where a word ends and a space
mark begins (no piece spans that) and at characters without a piece; chunks seen before come from a
bounded cache.

Defined cases: a null text is the empty text, whose ids are the end id alone; characters without a
piece become byte ids; repeated rows are encoded one by one; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_as_long, ids_as_text, spread

SPACE = "▁"
# Texts that show a model's normaliser, and their marked form: a space mark before the text, no folding
# of white space, letters or widths.
PROBES = {t: f"{SPACE}{t}".replace(" ", SPACE) for t in ("a", " a", "a  b", "a ", "Ab", "ﬁ", "Å")}
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Chunks kept per Python worker in each of two generations; a chunk found in the older one moves to
#: the younger, so frequent chunks stay.
CACHE_CHUNKS = 400_000
#: Neighbour pairs whose re-merging is remembered per Python worker.
CACHE_PAIRS = 1_000_000


class PieceEncoder(dict):
    """Maps a chunk (spaces already marked) to its ids as little-endian unsigned 32-bit bytes."""

    older: dict[str, bytes]

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for text, marked in PROBES.items():
            if "".join(sp.encode(text, out_type=str)) != marked:
                raise ValueError(f"{model_path} normalises texts in a way that this encoder does not follow")
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.matches = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i)):
                if sp.is_unused(i) or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} is of a kind that this encoder does not read")
                self.score[piece], self.id_of[piece] = sp.get_score(i), i
                self.matches.add_word(piece, (len(piece), piece))
        self.matches.make_automaton()
        self.end = np.uint32(sp.eos_id()).tobytes()
        self.apart: dict[tuple[str, str], bool] = {}
        self.older = {}
        self.names = list(map(str, range(sp.get_piece_size())))

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, leftmost on ties."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self.merged(list(left + right)) == [left, right]
        return known

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of one chunk; characters without a piece stand alone.

        The longest matches from left to right are the answer if they cover the chunk and all
        neighbours fit, for only one sequence of pieces has that property."""
        longest = [piece for _, (_, piece) in self.matches.iter_long(chunk)]
        if sum(map(len, longest)) == len(chunk):
            apart = self.apart
            left = longest[0]
            for right in longest[1:]:
                known = apart.get((left, right))
                if not (self.fits(left, right) if known is None else known):
                    break
                left = right
            else:
                return longest
        return self.backtracked(chunk)

    def backtracked(self, chunk: str) -> list[str]:
        n = len(chunk)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, (size, piece) in self.matches.iter(chunk):
            at[end - size + 1].append(piece)  # ends rise, so each list runs from short to long
        failed = bytearray(n + 1)
        out: list[str] = []
        tried: list[int] = []
        pos, k = 0, -1
        fresh = True
        while pos < n:
            here = at[pos]
            if not here:
                out.append(chunk[pos])
                tried.append(0)
                pos += 1
                fresh = True
                continue
            if fresh:
                k = len(here) - 1
            while k >= 0:
                piece = here[k]
                if not failed[pos + len(piece)] and (not out or out[-1] not in self.score or self.fits(out[-1], piece)):
                    break
                k -= 1
            if k >= 0:
                out.append(here[k])
                tried.append(k)
                pos += len(here[k])
                fresh = True
            else:
                failed[pos] = 1
                last = out.pop()
                pos -= len(last)
                k = tried.pop() - 1
                fresh = False
        return out

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is not None:
            self[chunk] = out
            return out
        ids: list[int] = []
        for piece in self.pieces(chunk):
            i = self.id_of.get(piece)
            if i is None:
                ids += [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        out = self[chunk] = array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text with the end id."""
        if not text:
            return self.end
        if len(self) > CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        parts: list[bytes] = []
        lines = f" {text}".replace(" ", SPACE).split("\n")
        line_end = b"" if len(lines) == 1 or "\n" in self.score else self["\n"]
        if line_end:
            for i, line in enumerate(lines):
                if i:
                    parts.append(line_end)
                parts.extend(map(self.__getitem__, CHUNK.findall(line)))
        else:
            parts.extend(map(self.__getitem__, CHUNK.findall("\n".join(lines))))
        parts.append(self.end)
        return b"".join(parts)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """The worker's encoder of a model file."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = PieceEncoder(model_path)
    return _ENCODERS[model_path]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, the end id last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [enc.encode(t or "") for t in batch["text"]]})

    rows = ids_as_text(docs.select("doc_id", F.col(text_col).alias("text")), "doc_id")
    return ids_as_long(rows.mapInPandas(run, "doc_id string, ids binary"), "doc_id")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_text, decoded): ids in decimal joined by one space and the text that
    the vocabulary's library decodes from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_path)
        for batch in batches:
            rows = [np.frombuffer(x, "<u4").tolist() for x in batch["ids"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(r) for r in rows],
                    "ids_text": [" ".join(map(enc.names.__getitem__, r)) for r in rows],
                    "decoded": [enc.library.decode(r) for r in rows],
                }
            )

    rows = ids_as_text(encoded, "doc_id")
    return ids_as_long(rows.mapInPandas(run, "doc_id string, n_tokens long, ids_text string, decoded string"), "doc_id")


def piece_digest(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding, in one pass: ids and
    texts never leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_path)
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = np.frombuffer(enc.encode(text or ""), "<u4").tolist()
                said = hashlib.sha256(" ".join(map(enc.names.__getitem__, ids)).encode()).hexdigest()
                back = hashlib.sha256(enc.library.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(ids), said, back))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=batch["doc_id"].to_numpy())[
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            ]

    rows = ids_as_text(spread(docs.select("doc_id", F.col(text_col).alias("text"))), "doc_id")
    return ids_as_long(rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"), "doc_id")
