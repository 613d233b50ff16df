"""Word-wise token cache for Python workers.

Tokenizers whose pre-tokenizer drops white space treat every piece between
ASCII white space on its own, so a text's ids are the ids of its pieces in
order.  A worker keeps the pieces it has met in two generations of bounded
size: when the young one is full it replaces the old one, so frequent words
stay and memory is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable


class PieceCache(dict):
    """``cache[piece]`` -> bytes of the piece's ids, computed on first use."""

    def __init__(self, compute: Callable[[bytes], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def ids_of(text: bytes, cache: PieceCache) -> bytes:
    """Ids of a whole UTF-8 text as little-endian unsigned 32-bit integers.
    bytes.split cuts at x20 and x09-x0D, all of them white space to the
    tokenizer too; any other white space stays inside a piece."""
    return b"".join(map(cache.__getitem__, text.split()))
