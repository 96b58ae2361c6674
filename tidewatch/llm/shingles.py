"""Hashes of the word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
CHUNK = 1 << 15


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """The hashes of a whole text's word shingles, repeats included, in chunks; none where there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([digest(joined, SEED)], dtype="<u8")
        return
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(first), CHUNK):
        pairs = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def distinct_hashes(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    chunks = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(chunks)) if chunks else np.empty(0, dtype="<u8")
