"""BPE encoding and decoding from a tokenizer file.

A priority queue of merge ranks runs over a doubly linked list of symbols;
entries whose symbols have changed since they were queued are skipped when
they come up.  Decoding concatenates vocabulary strings in the way the file's
decoder says (with none, a space between them).

The file's steps are done here too: special tokens first, then NFC, white
space and lower case, the split pattern, bytes to characters, word ends.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import PieceCache, ids_of

# Code points that are white space to the tokenizer's patterns (fixed values).
_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                           0x205F, 0x3000]))
CACHE_PIECES = 300_000

# The tokenizer's patterns know the letters and numbers of Unicode 16, its lower case that of Unicode 17.  Fixed values: what
# these have beside Unicode 15.1, as ranges of code points, and as first and last capital with the first small letter.
_MORE_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
                 (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
                 (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
                 (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_MORE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                 (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_MORE_LOWER = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
               (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
               (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
_LOWER = {a + k: b + k for a, z, b in _MORE_LOWER for k in range(z - a + 1)}
#: Up to here all versions of Unicode agree on letters and numbers.
_SETTLED = 0x370


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """The tokenizer's letters and numbers as character ranges of a set."""
    def ranges(kind, more):
        held = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
        held = np.array(sorted({*held, *(c for a, b in more for c in range(a, b + 1))}))
        cuts = np.flatnonzero(np.diff(held) > 1)
        return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(held[np.r_[0, cuts + 1]], held[np.r_[cuts, len(held) - 1]]))

    return ranges("L", _MORE_LETTERS), ranges("N", _MORE_NUMBERS)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself,
    the others counted up from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"tokenizer file not supported: {what}")


class WordBpe:
    """Encoder and decoder for a BPE file with word ends and byte letters."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _require(model["type"] == "BPE" and not model["continuing_subword_prefix"] and spec["decoder"] is None, "model")
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        _require(normal == ["NFC", "Replace", "Lowercase"], "normalizer")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        _require(split["behavior"] == "Removed" and split["invert"], "pre-tokenizer")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a.removesuffix(self.end) + b])
                       for rank, (a, b) in enumerate(pairs)}
        self.split = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.pattern = regex.compile(self.split)
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.letters = byte_characters()
        self.words = PieceCache(self._word_ids, cache_pieces)
        self.pieces = PieceCache(self._piece_ids, cache_pieces)

    @cached_property
    def exact_pattern(self):
        """The split with the tokenizer's own letters and numbers; built when
        a text first needs it."""
        letters, numbers = _classes()
        return regex.compile(self.split.replace(r"\p{L}", letters).replace(r"\p{N}", numbers))

    def _word_ids(self, word: str) -> bytes:
        return array("I", self.merge(word)).tobytes()

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        chars = [self.letters[b] for b in word.encode()]
        chars[-1] += self.end
        symbol = [self.vocab[c] for c in chars if c in self.vocab]
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            if found := merges.get((symbol[i], symbol[i + 1])):
                queue.append((found[0], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = right[i] if symbol[i] >= 0 else n
            found = merges.get((symbol[i], symbol[j])) if j < n else None
            if found is None or found[0] != rank:
                continue                                     # stale: a neighbour was merged meanwhile
            symbol[i], symbol[j] = found[1], -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if found := merges.get((symbol[i], symbol[k])):
                    heapq.heappush(queue, (found[0], i))
            if (h := left[i]) >= 0 and (found := merges.get((symbol[h], symbol[i]))):
                heapq.heappush(queue, (found[0], h))
        return [s for s in symbol if s >= 0]

    def _plain_ids(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = self.spaces.sub(" ", text)
        # Character by character: lower case here has no rule for final sigma.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        pattern = self.pattern
        if not text.isascii() and ord(max(text)) >= _SETTLED:
            text, pattern = text.translate(_LOWER), self.exact_pattern
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))

    def _piece_ids(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if "<|" not in text:
            return self._plain_ids(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain_ids(text[at:m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join(out) + self._plain_ids(text[at:])

    def encode_bytes(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text, little-endian unsigned 32-bit."""
        return ids_of(text, self.pieces)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text.encode())).cast("I").tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary)``: ids of each whole text as little-endian
    unsigned 32-bit integers."""

    def run(batches):
        bpe = loaded(tokenizer_path)
        for batch in batches:
            ids = [bpe.encode_bytes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``:
    every whole text encoded, and the ids decoded again.

    Defined results: null and empty texts have no tokens (both digests are
    that of no bytes); a null id stays null; repeated rows stay repeated; an
    empty table gives no rows; other columns are not read.  Nothing is
    shuffled; a worker holds one Arrow batch and two bounded caches.
    """

    def run(batches):
        bpe = loaded(tokenizer_path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in batch.column(1):
                ids = bpe.encode_bytes(t.as_py())
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(memoryview(ids).cast("I")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
