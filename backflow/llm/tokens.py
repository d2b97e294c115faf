"""Token counts and token ids by a public vocabulary, with a shortcut for whole tokens."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from backflow.llm.common import texts_of
from backflow.llm.words import WHITE, hashed

WORD_BPE = "word_bpe_49k.json"
CACHE_ENTRIES = 400_000
CHUNK_CHARS = 2_000_000

#: The split pattern that the vocabulary file states.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters below U+0250 are already in composed form, lower-case one by one (but for U+0130), and of their white space
# only that of ASCII parts words here.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]*")
# The vocabulary's white space: Python's without U+001C to U+001F.
_WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")
# A comma or stop that ends a run of marks belongs to the run.
_RUN = re.compile(r"[,.](?<=[\W_].)\s")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text by the library of the vocabulary, put together from its white-space parts.

    The vocabulary splits at white space and drops it, so a text's ids are those of its parts in turn. Known parts come
    from a cache, by a 64-bit hash and their bytes; a new part is split into pre-tokens, where one that a proof has found to be a single token costs a
    lookup, and only the rest is merged. Parts outside the plain character range go to the library whole. The cache
    is emptied when full, which changes the speed and nothing else.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(SPLIT)
        self.letters = _byte_letters()
        self.dtype = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.width = np.dtype(self.dtype).itemsize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = [s.lower() for s in self.special]
        self.entries = entries
        self.whole = self.prove_whole()
        self.words: dict[str, bytes] = {}
        self.parts: dict[int, tuple[bytes, bytes]] = {}

    def merged(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]

    def prove_whole(self) -> dict[str, bytes]:
        """Vocabulary strings that the whole library, called on the string alone, encodes as one token, with that id."""
        back = {v: k for k, v in self.letters.items()}
        texts = []
        for entry in self.library.get_vocab(with_added_tokens=False):
            if entry.endswith("</w>"):
                try:
                    texts.append(bytes(back[c] for c in entry[:-4]).decode("utf-8"))
                except (KeyError, UnicodeDecodeError):
                    continue
        plain = [t for t in texts if t and _PLAIN.fullmatch(t) and self.split.findall(t) == [t]]
        proven = {}
        for text, found in zip(plain, self.library.encode_batch(plain, add_special_tokens=False)):
            if len(found.ids) == 1:
                proven[text] = self.pack(found.ids)
        return proven

    def _word(self, word: str) -> bytes:
        ids = self.whole.get(word) or self.words.get(word)
        if ids is None:
            if len(self.words) >= self.entries:
                self.words.clear()
            ids = self.words[word] = self.pack(self.merged(word))
        return ids

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _new_part(self, part: str) -> bytes:
        if not _PLAIN.fullmatch(part) or any(s in part for s in self.special):
            return self.pack(self.library.encode(part, add_special_tokens=False).ids)
        part = part.lower()
        if part.isalpha():
            return self._word(part)
        if part[-1:] in ",." and part[:-1].isalpha():
            return self._word(part[:-1]) + self._word(part[-1])
        return b"".join([self._word(w) for w in self.split.findall(part)])

    def _slow(self, text: str) -> bytes:
        return b"".join([self._new_part(p) for p in _WHITE.split(text) if p])

    def encode(self, texts: list[str], chunk: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds of each text's ids) for runs of texts in turn; together they cover all texts, each whole.

        Different parts of a run are looked up once, then gathered for all their occurrences. In plain text, a single comma
        or stop between a word and white space becomes a part of its own, and upper case goes, so that fewer
        different parts occur; the ids stay the same.
        """
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) < chunk):
                size += len(texts[end])
                end += 1
            yield self._encode(texts[begin:end])
            begin = end

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        prepared, odd = [], {}
        for k, text in enumerate(texts):
            low = text.lower()
            # A special string in other letters is plain text, and must not become special in lower case.
            if not _PLAIN.fullmatch(text) or any(s in low for s in self.marks):
                odd[k] = np.frombuffer(self._slow(text), dtype=self.dtype)
                text = ""
            elif not _RUN.search(text):
                text = low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
            prepared.append(text.encode("utf-8"))
        data = b"\n".join(prepared)
        hashes, starts, ends = hashed(data, WHITE)
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p in prepared])]))
        place, keys = pd.factorize(hashes)
        first = np.empty(len(keys), dtype=np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        if len(self.parts) > self.entries:
            self.parts.clear()
        found = []
        for key, begin, end in zip(keys.tolist(), starts[first].tolist(), ends[first].tolist()):
            part, held = data[begin:end], self.parts.get(key)
            # A part that shares the hash of a known one is not taken for it.
            if held is None or held[0] != part:
                held = self.parts[key] = (part, self._new_part(part.decode("utf-8")))
            found.append(held[1])
        pool = np.frombuffer(b"".join(found), dtype=self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        each = sizes[place]
        before = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[place] - before[:-1], each) + np.arange(before[-1])]
        bounds = before[bounds]
        if odd:
            pieces = [odd.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
            ids, bounds = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, bounds


@lru_cache(maxsize=2)
def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer for each worker process. ``None``: the public word vocabulary of the machine the task runs on."""
    return WordTokenizer(path or public_path(WORD_BPE))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """Bytes and tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    One row per input row, in no order; repeated rows stay repeated. A null text counts as empty, with 0 bytes and
    tokens; a null id stays null. Other columns are not read. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(bounds) for _, bounds in tokenizer.encode(texts))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit, pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
