"""Exact, cached use of a word-level BPE of the ``tokenizers`` library.

The tokenizer's pre-tokenizer never joins two sides of a space or newline, so a text's ids are the
concatenated ids of its space-separated chunks.  Chunks repeat, so each worker keeps a bounded cache from
chunk to the little-endian ids and joins bytes.  A chunk of plain Latin-1 letters, alone or with one
trailing mark, is split further so that ``Word``, ``word,`` and ``word.`` share one model call.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from opinara.llm import store

#: Entries of the cache of one Python worker; at the bound it is emptied.
CACHE_ENTRIES = 750_000
_MARKS = ",.;:!?"
_PROBES = ("Berlin", "straße", "élan", "Über", "don", "s", "ÀÿÖ", "unzerschlagbar")


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class ChunkIds(dict):
    """chunk -> ids as little-endian bytes; ``width`` is 2 or 4 bytes an id."""

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.direct = False
        #: Whether the text at hand is in lower-case Latin-1.
        self.plain = False
        self.marks = {m: self._full(m) for m in _MARKS}
        self.words = self._word_path_is_exact()
        self.direct = self.words and self._model_path_is_exact()
        self.folds = self.words and all(self._full(c) == self._full(c.lower()) for c in map(chr, range(256)))

    def _full(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _word_path_is_exact(self) -> bool:
        """Whether letters, marks and case behave as the shortcuts assume for this tokenizer."""
        probes = _PROBES
        ok = all(self._full(w) == self._full(w.lower()) for w in probes)
        ok = ok and all(self._full(w + m) == self._full(w) + self._full(m) for w in probes for m in _MARKS)
        return ok and all(self._full(a + " " + b) == self._full(a) + self._full(b) for a in probes for b in probes)

    def _model(self, word: str) -> bytes:
        """The BPE model alone, on one lower-case word in byte-level letters: skips what does not apply."""
        letters = word if word.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _model_path_is_exact(self) -> bool:
        try:
            return all(self._model(w.lower()) == self._full(w.lower()) for w in (*_PROBES, *_MARKS))
        except Exception:  # a model without a tokenize call, or other letters: the full path serves
            return False

    def __missing__(self, chunk: str) -> bytes:
        if self.plain and self.direct and chunk.isalpha():
            if len(self) >= self.limit:
                self.clear()
            got = self[chunk] = self._model(chunk)
            return got
        if not self.words or not chunk:
            return self._keep(chunk, self._full(chunk))
        word, tail = (chunk, b"") if chunk.isalpha() else (chunk[:-1], self.marks.get(chunk[-1]))
        if tail is None or not word.isalpha() or not (word.isascii() or max(word) <= "ÿ"):
            return self._keep(chunk, self._full(chunk))
        low = word.lower()
        got = None if low == chunk else self.get(low)
        if got is None:  # most words that are seen once are never seen again: only their plain form is kept
            return self._keep(low, self._model(low) if self.direct else self._full(low)) + tail
        return self._keep(chunk, got + tail)

    def _keep(self, chunk: str, got: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none."""
        return np.frombuffer(self.coded(text), dtype=self.dtype)

    def coded(self, text: str | None) -> bytes:
        """The little-endian bytes of ``ids``."""
        if not text:
            return b""
        if not self.words:
            return self._full(text)
        self.plain = False
        if self.folds:
            try:
                text.encode("latin-1")
                text, self.plain = text.lower(), True  # fewer different chunks
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkIds:
    """One per Python worker and tokenizer file."""
    return ChunkIds(path)


def forget() -> None:
    """Give a worker's caches back: its next stage does not tokenize."""
    encoder.cache_clear()
    store.trim()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
