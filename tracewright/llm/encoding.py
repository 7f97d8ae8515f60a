"""Encoding of texts inside tasks, with a bounded memory of chunks that were encoded before."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters before an ASCII mark or digit: no pre-token of the two vocabularies spans the place between.
LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-@\[-`{-~])"
#: Put where a text is cut: there, and before blanks and line feeds.
CUT = "\x02"
#: Space other than blank and line feed, and characters that engines' space classes treat differently: a text with such is
#: encoded in one piece.
ODD = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
#: Two blanks or line feeds in a row, which are not cut apart.
RUN = r"[ \n][ \n]"


@functools.cache
def encoder(path: str, dtype: str = "<u4") -> ChunkEncoder:
    """This process's encoder, which keeps its memory from task to task."""
    return ChunkEncoder(path, dtype)


@functools.cache
def largest_id(path: str) -> int:
    """The largest id of a tokenizers JSON file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


class ChunkEncoder:
    """Encodes texts as the tokenizer does, but looks known chunks of them up.

    ``path`` is a tokenizers JSON file. Results are little-endian ids of ``dtype``. The memory holds
    at most ``limit`` chunks of at most ``longest`` characters, so it doesn't grow with the corpus.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 500_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Found in texts before anything else; a text with one is encoded in one piece.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype, self.limit, self.longest = np.dtype(dtype), limit, longest
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.seen: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, all of them distinct."""
        got = list(map(self.seen.get, chunks))
        if None in got:
            new = [c for c, g in zip(chunks, got) if g is None]
            made = self.direct(new)
            rest = iter(made)
            got = [next(rest) if g is None else g for g in got]
            if len(self.seen) + len(new) > self.limit:
                self.seen.clear()
            self.seen.update([(c, m) for c, m in zip(new, made) if len(c) <= self.longest][: self.limit])
        return got

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes; null counts as an empty text. The more texts at once, the better."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        out: list[bytes] = [b""] * len(texts)
        at = pc.indices_nonzero(odd).to_pylist()
        for i, ids in zip(at, self.direct(texts.filter(odd).to_pylist()) if at else ()):
            out[i] = ids
        plain = pc.invert(odd)
        cut = pc.replace_substring_regex(texts.filter(plain), LETTER_MARK, rf"\1{CUT}\2")
        if pc.any(pc.match_substring_regex(cut, RUN)).as_py():
            cut = pc.replace_substring_regex(cut, r"([^ \n])([ \n])", rf"\1{CUT}\2")
        else:
            for gap in " \n":
                cut = pc.replace_substring(cut, gap, CUT + gap)
        lists = pc.split_pattern(cut, CUT)
        chunks = pc.dictionary_encode(lists.flatten())
        ids = self.lookup(chunks.dictionary.to_pylist())
        joined = pa.array(ids, pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[np.asarray(lists.offsets)] if len(joined) else np.zeros(1, np.int64)
        data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
        for i, a, b in zip(pc.indices_nonzero(plain).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[i] = bytes(data[a:b])
        return out
