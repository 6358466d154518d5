"""Ids of whole texts as the tokenizers library gives them, faster where that is provably the same.

The library itself encodes every text that holds a special token's string (which it turns into that
token's id) or a character outside the sets below. All others are encoded by a rank table made from
the same file, where the file's ids are in merge order:

- byte-level vocabularies without a normaliser: the whole text at once;
- vocabularies with word ends and a lower-casing normaliser: the text is cut at spaces and line ends,
  which no piece crosses; ids of chunks seen before come from a bounded cache.

Files of other kinds go to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Chunks kept per Python worker; the cache starts anew beyond.
CACHE_CHUNKS = 800_000
#: Characters of texts whose chunks are looked up together.
GROUP_CHARS = 2_000_000
#: Long-assigned letters, marks of punctuation and ASCII white space, which all versions of Unicode
#: class alike: Latin, Greek, Cyrillic, kana, Han, Hangul.
UNSURE = re.compile("[^\t-\r -~¡-ɏΑ-ΡΣ-ωА-яё‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")
#: Visible ASCII and Latin letters: no combining marks, no white space, stable under NFC.
COMMON_WORD = re.compile("[!-~¡-ɏ]+")
COMMON_WORDS = re.compile("[\n!-~¡-ɏ]+")
WORD_END = "</w>"
#: Fixed value: the normaliser that chunks in lower case stand for.
LOWER_CASING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _common_classes(pattern: str) -> str:
    """The pattern with its letter and number classes written out for COMMON_WORD in lower case."""
    common = sorted({x for c in range(0x21, 0x250) for x in chr(c).lower()})
    for kind in "LN":
        chars = "".join(c for c in common if unicodedata.category(c)[0] == kind)
        pattern = pattern.replace(f"\\p{{{kind}}}", chars)
    return pattern


class TextTokenizer:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes, the end id last."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = np.array([end_id], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {"": b""}
        self.mode = self._ranks(spec)

    def _ranks(self, spec: dict) -> str:
        """Makes the rank table; returns the way of encoding: "bytes", "words" or "library"."""
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        suffix = model.get("end_of_word_suffix") or ""
        steps = pre.get("pretokenizers", [])
        whole = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]
        cased = [s["type"] for s in steps] == ["Split", "ByteLevel"] and (spec["normalizer"] or {}).get("normalizers") == LOWER_CASING
        if model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            return "library"
        if not (whole and not suffix and spec["normalizer"] is None) and not (cased and suffix == WORD_END):
            return "library"
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(model["vocab"]) - len(merges) - sum(t in model["vocab"] for t in self.special)
        if any(model["vocab"].get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return "library"
        letters = byte_letters()

        def raw(token: str) -> bytes:
            # a word's end is written as a line end, which no word holds
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + b"\n" * ends

        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        if suffix:
            self.words_in = re.compile("\n|" + _common_classes(steps[0]["pattern"]["Regex"])).findall
            self.is_end = np.zeros(self.size, dtype=bool)
            self.is_end[[i for t, i in ranks.items() if t.endswith(b"\n") and len(t) > 1]] = True
            pattern = r"[^\n]*\n"
        else:
            from public_tokenizers import PATTERN as pattern
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return "words" if suffix else "bytes"

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self.mode != "library" and not any(s in t for s in self.special) for t in texts]
        if self.mode == "bytes":
            plain = [p and not UNSURE.search(t) for p, t in zip(plain, texts, strict=True)]
            for t, p in zip(texts, plain, strict=True):
                yield (np.array(self.ranked(t), self.dtype).tobytes() if p else self._by_library([t])[0]) + self.end
            return
        chunks = [t.replace("\n", " ").split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        ids = self._chunk_ids(list(chain.from_iterable(chunks)))
        at = 0
        for t, p, own in zip(texts, plain, chunks, strict=True):
            yield (b"".join(ids[at : at + len(own)]) if p else self._by_library([t])[0]) + self.end
            at += len(own)

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_CHUNKS:
            self.known = {"": b""}
        found = list(map(self.known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self._learn({chunks[i] for i in missing})
            known = self.known
            for i in missing:
                found[i] = known[chunks[i]]
        return found

    def _learn(self, chunks: set[str]) -> None:
        known, common = self.known, list(chunks)
        if not COMMON_WORDS.fullmatch("\n".join(common)):
            rest = [c for c in common if not COMMON_WORD.fullmatch(c)]
            common = [c for c in common if COMMON_WORD.fullmatch(c)]
            known.update(zip(rest, self._by_library(rest), strict=True))
        if not common:
            return
        # words of all chunks in one go, a line end after each chunk
        words = self.words_in(("\n".join(common) + "\n").lower())
        chunk_ends = np.flatnonzero(np.fromiter(map("\n".__eq__, words), dtype=bool, count=len(words)))
        n_words = chunk_ends - np.arange(len(chunk_ends))  # up to the end of each chunk
        ids = np.array(self.ranked("\n".join([w for w in words if w != "\n"]) + "\n"), self.dtype)
        word_ends = np.flatnonzero(self.is_end[ids]) + 1
        flat, at = ids.tobytes(), 0
        for c, end in zip(common, (self.width * word_ends[n_words - 1]).tolist(), strict=True):
            known[c] = flat[at:end]
            at = end


_LOADED: dict[tuple, TextTokenizer] = {}


def tokenizer(path: str, end_id: int) -> TextTokenizer:
    """The worker's tokenizer of a vocabulary file."""
    key = (path, end_id)
    if key not in _LOADED:
        _LOADED[key] = TextTokenizer(*key)
    return _LOADED[key]
