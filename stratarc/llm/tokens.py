"""Token ids of whole texts with the tokenizers library, at the price of encoding each distinct word once.

The vocabulary used here drops white space and ends every token at a word's end, so the ids of a text are the ids
of its words in a row. A batch's words are made distinct in Arrow, looked up there among the words that the worker has seen, and only new
ones come to Python. New words of letters, before and after normalising, are encoded many at a time as one text and cut behind the tokens that end a word,
ASCII ones in lower case by a tokenizer that shares the model and needs no normaliser;
those with ASCII punctuation behind the letters as two pieces, since the vocabulary splits there too; all others one by one. A worker keeps what
it has encoded, as arrays, up to CACHE words or as many as its operator asks for; then those go that were not met again since.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratarc.llm.common import KEPT, frugal, split_words

CACHE = 250_000
#: Words that are encoded as one text.
JOINED = 200
_PUNCTUATION = string.punctuation.encode()
#: Texts that tell whether a tokenizer takes lower-case letters as they are, word by word.
_PROBES = [string.ascii_lowercase, " ".join(string.ascii_lowercase), "the quick brown fox jumps over the lazy dog", "it s don t we ll they re i ve i m he d", "straightforwardness qzxjkv aaaaaaaaaaaaaaaaaaaaaaaa startoftext endoftext"]
_STEM = rf"^(?P<stem>[A-Za-z]+)(?P<tail>[{re.escape(string.punctuation)}]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stays_letters(stem: str) -> bool:
    """Whether the tokenizer's normaliser (NFC, lower case) leaves letters alone: U+0130 and composition exclusions become letter and mark."""
    return stem.isalpha() and unicodedata.normalize("NFC", stem).lower().isalpha()


class WordEncoder:
    """Ids by distinct word for a tokenizer whose ids do not depend on what stands beyond white space."""

    _by_path: dict[str, WordEncoder] = {}
    keep = CACHE

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._without_preparation()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    @classmethod
    def at(cls, path: str, keep: int = CACHE) -> WordEncoder:
        if path not in cls._by_path:
            frugal("words")  # what tasks of other operators left goes before the tokenizer comes
            cls._by_path[path] = cls(path)
            frugal("words")
        cls._by_path[path].keep = keep
        return cls._by_path[path]

    def _without_preparation(self):
        """A tokenizer of the same model, which it shares, for lower-case ASCII letters, on which normaliser and pre-tokenizer have nothing to do but to split at spaces."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        same = all(plain.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(x, add_special_tokens=False).ids for x in _PROBES)
        return plain if same else self.tokenizer

    def _forget(self) -> None:
        self.words = pa.array([], pa.binary())
        self.starts, self.sizes, self.pool = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint16)
        self.again = np.empty(0, bool)

    def _thin_out(self) -> None:
        """Keep the words that were met again."""
        stay = np.flatnonzero(self.again)
        starts, sizes, pool = self.starts[stay], self.sizes[stay], self.pool
        words = self.words.take(pa.array(stay))
        self._forget()
        self.words, self.sizes, self.again = words, sizes, np.zeros(len(stay), bool)
        self.starts, self.pool = np.cumsum(sizes, dtype=np.int64) - sizes, pool[_spans(starts, sizes)]

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each word's number of ids."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint16, int(sizes.sum())), sizes

    def _of_letters(self, stems: list[bytes], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters."""
        tokenizer = tokenizer or self.tokenizer
        parts = [stems[i : i + JOINED] for i in range(0, len(stems), JOINED)]
        texts = [b" ".join(p).decode("utf-8", "replace") for p in parts]
        out = [(np.empty(0, np.uint16), np.empty(0, np.int32))]
        for part, found in zip(parts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint16)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                out.append((ids, np.diff(ends, prepend=0).astype(np.int32)))
            else:  # not one last token for each word: not what was expected of letters
                out.append(self._one_by_one(part))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and each word's number of ids."""
        cut = pc.extract_regex(words.cast(pa.string()), _STEM)
        ascii_ = np.array(cut.is_valid())
        cut = cut.drop_null()
        stems, tails = pc.ascii_lower(pc.struct_field(cut, 0)).dictionary_encode(), pc.struct_field(cut, 1).dictionary_encode()
        kinds = [(self._of_letters(stems.dictionary.cast(pa.binary()).to_pylist(), self.plain), stems.indices.to_numpy(), np.flatnonzero(ascii_))]
        kinds.append((self._one_by_one(tails.dictionary.cast(pa.binary()).to_pylist()), tails.indices.to_numpy(), None))
        rest = np.flatnonzero(~ascii_)
        letters, other, ends = [], [], []
        for i, w in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            stem = w.rstrip(_PUNCTUATION)
            if stem and not stem.isascii() and _stays_letters(stem.decode("utf-8", "replace")):
                letters.append((i, stem))
                ends.append(w[len(stem) :])
            else:
                other.append((i, w))
        each = lambda pairs: (np.arange(len(pairs)), np.array([i for i, _ in pairs], np.int64))
        kinds.append((self._of_letters([w for _, w in letters]), *each(letters)))
        marks = pa.array(ends, pa.binary()).dictionary_encode()
        kinds.append((self._one_by_one(marks.dictionary.to_pylist()), marks.indices.to_numpy(), None))
        kinds.append((self._one_by_one([w for _, w in other]), *each(other)))
        # every word is a stem and, if it has one, the tail behind it: two spans of what was encoded
        starts, sizes, base, at = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int32), 0, np.empty(0, np.int64)
        for (ids, n), codes, where in kinds:
            column = int(where is None)
            at = at if where is None else where
            starts[at, column] = base + (np.cumsum(n, dtype=np.int64) - n)[codes]
            sizes[at, column] = n[codes]
            base += len(ids)
        pool = np.concatenate([ids for (ids, _), _, _ in kinds])
        return pool[_spans(starts.reshape(-1), sizes.reshape(-1))], sizes.sum(1)

    def _places(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each word's ids start, and how many they are."""
        if len(self.words) > self.keep:
            self._thin_out()
        unique = unique.cast(pa.binary())
        at = pc.index_in(unique, value_set=self.words)
        if at.null_count:
            new = unique.filter(at.is_null())
            ids, sizes = self._encode(new)
            starts = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
            known = len(self.words)
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.words = pa.concat_arrays([self.words, new])
            self.starts, self.sizes, self.pool = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
            where = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            self.again[where[where >= 0]] = True
            where[where < 0] = np.arange(known, len(self.words))
        else:
            where = at.to_numpy(zero_copy_only=False)
            self.again[where] = True
        return self.starts[where], self.sizes[where]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row as uint16, and each text's end among them."""
        unique, codes, ends = split_words(texts)
        starts, sizes = self._places(unique)
        # the batch's words next to each other first: what is read at random is then small
        pool = self.pool[_spans(starts, sizes)]
        n = sizes[codes]
        ids = pool[_spans((np.cumsum(sizes, dtype=np.int64) - sizes)[codes], n)]
        return ids, np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[ends]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of sizes[i] each, one span after the other."""
    stops = np.cumsum(sizes, dtype=np.int64)
    places = np.arange(stops[-1] if len(stops) else 0, dtype=np.int64)
    places += np.repeat(starts - (stops - sizes), sizes)
    return places


KEPT["words"] = WordEncoder._by_path.clear


def text_slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000, needs: str = ""):
    """The batch in slices of at most about so many text bytes, at least one row each."""
    frugal(needs)
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
