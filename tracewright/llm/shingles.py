"""Sets of hashed word shingles of whole texts, for a batch of texts at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U8, U4, U2 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<u2")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: One random 64-bit number per byte value; A-Z have those of a-z.
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES[65:91] = CODES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are hashed together, so that working arrays stay small.
BLOCK = 2_000_000

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        made = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, U8)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 4 * BLOCK:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """Sorted distinct shingle hashes of some texts: those of text i are tokens[ends[i] - n[i] : ends[i]]."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray):
        self.tokens, self.n = tokens, n
        self.ends = np.cumsum(n)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.rank = np.arange(len(tokens)) - np.repeat(self.ends - n, n)

    def signatures(self) -> np.ndarray:
        """One number per text for its set; equal sets have equal numbers."""
        sums = np.concatenate([np.zeros(1, U8), np.cumsum(mix(self.tokens + np.uint64(0x51ED2701)), dtype=U8)])
        return mix(sums[self.ends] - sums[self.ends - self.n] + self.n.astype(U8) * BASE).astype(np.int64)


def block(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of the texts data[offsets[i] : offsets[i + 1]], end to end, and their number for each."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U8), np.zeros(docs, np.int64)
    solid = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    ends_here = solid.copy()
    ends_here[:-1] &= ~(solid[1:] & before[1:])
    ends = np.flatnonzero(ends_here) + 1
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, U8), np.cumsum(CODES[data] * up[: len(data)], dtype=U8)])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(docs), counts)
    if len(words) >= width:
        hashed, base = np.zeros(len(words) - width + 1, U8), np.uint64(1)
        for k in range(width):
            hashed += words[k : len(words) - width + 1 + k] * base
            base = np.uint64((int(base) * int(BASE)) % (1 << 64))
        whole = doc[: len(hashed)] == doc[width - 1 :]
        hashed, owner = mix(hashed[whole]), doc[: len(whole)][whole]
    else:
        hashed, owner = np.zeros(0, U8), np.zeros(0, np.int64)
    n = np.bincount(owner, minlength=docs)
    # texts of fewer words: all of them together are the one shingle
    short = np.flatnonzero((counts > 0) & (counts < width))
    parts, at = [], 0
    begin = np.cumsum(counts) - counts
    short_hash = {}
    for d in short.tolist():
        x = int(counts[d])
        for w in words[begin[d] : begin[d] + counts[d]].tolist():
            x = (x * 0x9E3779B97F4A7C15 + w) % (1 << 64)
        short_hash[d] = mix(np.array([x], U8))
    for d in range(docs):
        if n[d]:
            own = hashed[at : at + n[d]]
            at += n[d]
            own = np.sort(own)
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            parts.append(own if keep.all() else own[keep])
            n[d] = len(parts[-1])
        elif d in short_hash:
            parts.append(short_hash[d])
            n[d] = 1
    return (np.concatenate(parts) if parts else np.zeros(0, U8)), n


def shingle_sets(texts: pa.Array, width: int = 5) -> Sets:
    """Shingles of each text: width words in sequence, A-Z lower-cased; all words if there are fewer. Null has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    tokens, n, i = [], [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, len(texts))
        t, k = block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        tokens.append(t)
        n.append(k)
        i = j
    return Sets(np.concatenate(tokens or [np.zeros(0, U8)]), np.concatenate(n or [np.zeros(0, np.int64)]))


def give_back() -> None:
    """Returns free memory to the system: workers live on, and what one stage took would else be missing in the next. Powers are made anew where they are needed."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    # where the C library has it
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """work on a large group, after which free memory is given back."""

    def tidy(df: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(df)
        finally:
            give_back()

    return tidy


def batches_of(batches: Iterator[pa.RecordBatch], column: int = 1, bytes_most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds much more text than bytes_most, unless one row does; gives free memory back before and after."""
    give_back()
    for b in batches:
        n = max(1, -(-b.column(column).nbytes // bytes_most))
        step = max(1, -(-b.num_rows // n))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
    give_back()
