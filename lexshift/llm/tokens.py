"""Token ids of whole texts, by the tokenizers library, at the rate of its distinct words.

A byte-level BPE and a BPE with word ends both cut a text into pieces before they
merge anything, and no piece crosses the place between a non-space and a space. So
a text's ids are the ids of its space-separated units one after another. A batch is
split into units, each distinct unit is encoded once by the library and kept in a
bounded cache, and the ids are gathered with numpy. A text with white space other
than single spaces and single line ends is encoded by the library as a whole where
units would not do (see ByteUnits), and so is one that holds the string of a special
token, which the library encodes as that token.

A tokenizer is named by its path, or by its file's name among the public tokenizers; a
name is resolved where it is used, in the tasks.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept by a cache; beyond that it starts anew. About 200 bytes each.
CACHE = 450_000
#: Bytes of text that slices() hands out at once.
CHUNK = 3_000_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE, for the code points below U+0250 as UTF-8."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand, n = {}, 0
    for b in range(256):
        stand[b] = chr(b) if b in plain else chr(256 + n)
        n += b not in plain
    return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(0x250)}


STAND_IN = _byte_chars()


class _Units:
    """Encodes texts by way of their distinct units."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        #: The narrowest unsigned integers that hold every id.
        self.width = "<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4"
        self._clear()

    def _clear(self):
        self.codes: dict[str | tuple[str], int] = {}
        self.marks: dict[str, list[int]] = {}
        self.starts = np.zeros(1, np.int64)
        self.lens = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, word: str) -> list[int]:
        """Ids of one piece: letters below U+0250, at most with one space before them."""
        return [t.id for t in self.model.tokenize(word.translate(STAND_IN))]

    def _kept(self, unit: str, text: str) -> list[int]:
        """Ids of a unit without its mark at the end; taken from the cache if it is there."""
        code = self.codes.get(unit, -1)
        if code < 0:
            return self._merged(text)
        return self.pool[self.starts[code] : self.starts[code] + self.lens[code]].tolist()

    def _mark(self, text: str) -> list[int]:
        ids = self.marks.get(text)
        if ids is None:
            ids = self.marks[text] = self.whole(text)
        return ids

    def _lookup(self, units: list[str | tuple[str]]) -> np.ndarray:
        """Codes of units (in a tuple: a text's first one), -1 for those that make their text go the slow way."""
        get = self.codes.get
        found = np.fromiter((get(u, -2) for u in units), np.int64, len(units))
        missing = np.flatnonzero(found == -2)
        if len(missing) and len(self.codes) + len(missing) > self.cache:
            self._clear()
            found, missing = np.full(len(units), -2), np.arange(len(units))
        if len(missing):
            ids, lens, slow, new_units = [], [], [], [units[i] for i in missing.tolist()]
            n = len(self.starts)
            for k, unit in enumerate(new_units):
                got = self.ids_of(unit)
                if got is None:
                    slow.append(k)
                    got = ()
                ids += got
                lens.append(len(got))
            new = np.arange(n, n + len(missing))
            new[slow] = -1
            found[missing] = new
            lens = np.array(lens, np.int64)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.pool = np.concatenate([self.pool, np.array(ids, np.uint32)])
            self.codes.update(zip(new_units, new.tolist()))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) as one array, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        return self._encode(texts) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units = pc.split_pattern(self.prepared(texts), " ")
        at = units.offsets.to_numpy().astype(np.int64)
        at, values = at - at[0], units.flatten()
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        first = self.first_units(values.take(pa.array(at[:-1])))
        found = self._lookup(distinct + first)
        codes = found[coded.indices.to_numpy(zero_copy_only=False)]
        if first:
            codes[at[:-1]] = found[len(distinct) :]
        starts, lens, pool = self.starts, self.lens, self.pool
        if self.special:
            special = pc.match_substring_regex(texts, self.special, ignore_case=True).to_numpy(zero_copy_only=False)
            codes[np.repeat(special, np.diff(at))] = -1
        slow = np.flatnonzero(np.minimum.reduceat(codes, at[:-1]) < 0) if len(codes) else np.zeros(0, np.int64)
        n = lens[codes]
        n[codes < 0] = 0
        total = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(starts[codes] - total[:-1], n) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        counts = total[at[1:]] - total[at[:-1]]
        if not len(slow):
            return ids, counts
        pieces, last = [], 0
        ends = np.cumsum(counts)
        for i in slow.tolist():
            got = np.array(self.whole(texts[i].as_py()), np.uint32)
            pieces += [ids[last : ends[i] - counts[i]], got]
            last, counts[i] = ends[i], len(got)
        return np.concatenate([*pieces, ids[last:]]), counts


def _latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < "ɐ")


class ByteUnits(_Units):
    """Byte-level BPE. A unit is a word with the space before it, or a line end and the
    first word after it. A text with other white space, or more than one space or line end
    together, or one at an end, goes the slow way."""

    def prepared(self, texts):
        return pc.replace_substring(texts, "\n", " \n")

    def first_units(self, firsts):
        return [(u,) for u in firsts.to_pylist()]

    def ids_of(self, unit: str | tuple[str]):
        if isinstance(unit, tuple):
            text = word = unit[0]
            if text[:1] == "\n":
                return None
        elif unit[:1] == "\n":
            text, word = unit, unit[1:]
        else:
            text, word = " " + unit, unit
        base = word[:-1] if word[-1:] in (".", ",") else word
        if _latin(base):
            if base is word:
                return [*self._mark("\n"), *self._merged(word)] if text[0] == "\n" else self._merged(text)
            if text[0] == "\n":
                return [*self._mark("\n"), *self._merged(base), *self._mark(word[-1])]
            return [*(self._merged(text[:-1]) if text is word else self._kept(base, text[:-1])), *self._mark(word[-1])]
        if not word or any(map(str.isspace, word)):
            return None
        return self.whole(text)


class WordUnits(_Units):
    """BPE with word ends, lower case, white space dropped. A unit is what stands between
    spaces and line ends; the library sees to any other white space in it."""

    def prepared(self, texts):
        return pc.replace_substring(texts, "\n", " ")

    def first_units(self, firsts):
        return []

    def ids_of(self, unit: str):
        word = unit.lower()
        base = word[:-1] if word[-1:] in (".", ",") else word
        if _latin(base):
            return self._merged(word) if base is word else [*self._kept(unit[:-1], base), *self._mark(word[-1])]
        return self.whole(unit) if unit else ()


def slices(batches, column: str = "text", chunk: int = CHUNK):
    """The batches in slices of about `chunk` bytes of text (one row at least), so that what is made of them stays small."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


_LOADED: dict[tuple[str, str, int], _Units] = {}


def encoder(tokenizer: str, kind: str, cache: int = CACHE) -> _Units:
    """The process's encoder for a tokenizer (a path, or the name of a public one); kind: "byte" or "word"."""
    key = tokenizer, kind, cache
    if key not in _LOADED:
        _LOADED.clear()
        path = tokenizer if os.sep in tokenizer else public(tokenizer)
        _LOADED[key] = (ByteUnits if kind == "byte" else WordUnits)(path, cache)
    return _LOADED[key]


def public(name: str) -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
