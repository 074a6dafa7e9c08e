"""Token ids of whole texts, each distinct word tokenised once per worker.

The word BPE drops white space and never joins across it, so a text's ids are
those of its white-space separated chunks in order. Arrow splits and
dictionary-encodes the chunks of a batch; only distinct chunks meet Python, and
only words unseen by the worker meet the tokenizer. Caches are two-generation
and bounded.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Plain chunks: printable ASCII and Latin-1 letters, stable under NFC.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split, on a lower-cased plain chunk.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Cache:
    """Bounded map: entries not used for ``limit`` insertions fall out."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordIds:
    """Ids of texts under a word-level byte BPE of the tokenizers library."""

    def __init__(self, path: str, words: int = 120_000, chunks: int = 30_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.words, self.chunks = _Cache(words), _Cache(chunks)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            # printable ASCII stands for itself
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(spelt)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 40:
                self.words.put(word, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            # what the split leaves whole, and that with a mark at its end, needs no place in the cache of chunks
            if chunk.isalpha():
                return self._word(chunk.lower())
            if chunk[-1:] in ".,;:!?" and chunk[:-1].isalpha():
                return self._word(chunk[:-1].lower()) + self._word(chunk[-1])
        found = self.chunks.get(chunk)
        if found is None:
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                found = b"".join(map(self._word, _SPLIT.findall(chunk.lower())))
            else:
                found = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(chunk) <= 64:
                self.chunks.put(chunk, found)
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by ``end_id``; and the offsets of the texts in them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        each = [self._chunk(c) for c in coded.dictionary.to_pylist()] if len(coded) else []
        each.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        places = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(each), "<u4")
        index = np.insert(np.asarray(coded.indices, np.int64), offsets[1:], len(each) - 1)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        ids = table[np.repeat(places[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        last = offsets[1:] + np.arange(1, len(offsets)) - 1
        return ids, np.concatenate([[0], ends[last]]).astype(np.int64)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own instance for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
