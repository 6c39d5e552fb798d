"""Whole texts to token ids: the tokenizers library on distinct units of text, joined by numpy."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from textloom.llm._text import text_buffers, word_hashes, words

#: Texts with other white space than ASCII's, or with control characters that one side takes for it: they go whole to the
#: library.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes that each such character has one of: a control character, or the first of several bytes.
ODD_BYTE = np.zeros(256, dtype=bool)
ODD_BYTE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: By byte: 1 a mark at which a word that ends in a Latin letter is cut, 2 an ASCII letter, 3 the second byte of a letter of
#: U+00C0 to U+00FF (after LEAD).
KIND = np.zeros(256, dtype=np.uint8)
KIND[[ord(c) for c in ".,;:!?|*#%&$"]] = 1
KIND[65:91] = KIND[97:123] = 2
KIND[128:192] = 3
KIND[[0x97, 0xB7]] = 0
LEAD = 0xC3
#: Units that a worker keeps.
KEPT = 600_000


class _Grown:
    """An array that takes more at its end in amortised linear time."""

    def __init__(self, dtype: type):
        self.data, self.size = np.zeros(1 << 12, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        upto = self.size + len(more)
        if upto > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(upto, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size : upto] = more
        self.size = upto


def _slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each slice, one slice after the other."""
    total = np.cumsum(size)
    out = np.repeat(first - (total - size), size)
    out += np.arange(len(out))
    return out


class UnitEncoder:
    """Encodes texts unit by unit; equal to encoding them whole, as no pre-token crosses a unit's border.

    kind: "byte" for a byte-level vocabulary whose words carry the space before them, "word" for one that drops white
    space and case. A unit is a run without white space, cut before the marks at its end where these follow a Latin
    letter, or a run of white space as the byte-level vocabulary cuts it. Up to KEPT units seen are kept with their bytes
    and ids, found by a hash and compared byte by byte; new ones go to the library, many in one call.
    """

    _own: dict[tuple[str, str], UnitEncoder] = {}

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lower = kind == "word"
        #: ids that end a word, or else those that begin with a space or a line feed
        self.border = np.zeros(1 << 16, dtype=bool)
        self.border[[i for t, i in self.library.get_vocab().items() if (t.endswith("</w>") if self.lower else t[:1] in "\u0120\u010a")]] = True
        self.forget()

    @classmethod
    def of(cls, path: str, kind: str) -> UnitEncoder:
        """One encoder for each worker process."""
        if (path, kind) not in cls._own:
            cls._own[path, kind] = cls(path, kind)
        return cls._own[path, kind]

    def forget(self) -> None:
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self.bytes, self.byte_at, self.byte_size = _Grown(np.uint8), _Grown(np.int64), _Grown(np.int64)
        self.ids, self.at, self.size = _Grown(np.uint16), _Grown(np.int64), _Grown(np.int64)
        self.blocks = _Grown(np.int32)  # in which a unit was met

    def _forget_rare(self) -> None:
        """Drops the units that were met in one block only."""
        keep = np.flatnonzero(self.blocks.data[: self.blocks.size] > 1)
        hashes, codes = self.hashes, self.codes
        ids, at, size, data, byte_at, byte_size = self.ids.data, self.at.data[keep], self.size.data[keep], self.bytes.data, self.byte_at.data[keep], self.byte_size.data[keep]
        self.forget()
        if len(keep) > KEPT // 2:
            return
        new = np.full(len(hashes), -1, dtype=np.int32)
        new[keep] = np.arange(len(keep))
        own = new[codes] >= 0
        self.hashes, self.codes = hashes[own], new[codes[own]]
        self.ids.extend(ids[_slices(at, size)])
        self.at.extend(np.cumsum(size) - size)
        self.size.extend(size)
        self.bytes.extend(data[_slices(byte_at, byte_size)])
        self.byte_at.extend(np.cumsum(byte_size) - byte_size)
        self.byte_size.extend(byte_size)
        self.blocks.extend(np.ones(len(keep), np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, offsets) of the texts."""
        return self.encode_block(*text_buffers(pa.array(texts, pa.large_string())))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, offsets) of the texts of a block, bytes between offsets."""
        if len(self.hashes) > KEPT:
            self._forget_rare()
        n = len(offsets) - 1
        odd = []
        if (maybe := np.flatnonzero(ODD_BYTE[data])).size:
            raw = data.tobytes()
            odd = [i for i in np.unique(np.searchsorted(offsets, maybe, side="right") - 1).tolist() if ODD.search(raw[offsets[i] : offsets[i + 1]].decode())]
        found = self._block_codes(data, offsets)
        if found is None:  # two units of one hash
            odd, found = range(n), (np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
        codes, first = found
        size = self.size.data[codes]
        to = np.concatenate([[0], np.cumsum(size)])[first]
        ids = self.ids.data[_slices(self.at.data[codes], size)]
        if not len(odd):
            return ids, to
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd]
        whole = {i: e.ids for i, e in zip(odd, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        parts = [np.array(whole[i], dtype=np.uint16) if i in whole else ids[to[i] : to[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _learn(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Enters new units, slices of data with the given distinct hashes in ascending order."""
        kind = KIND[data]
        lead = np.concatenate([data[:-1] == LEAD, [False]]) & (np.concatenate([kind[1:], [0]]) == 3)
        letter = (kind == 2) | lead | np.concatenate([[False], lead[:-1]])
        others = np.concatenate([[0], np.cumsum(~letter)])
        raw = data.tobytes()
        at, size, known = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), dtype=bool)
        # plain ones are one pre-token each; where they begin shows by their space, or a line feed instead, or the end before
        spaced = data[begin] == 32
        these = np.flatnonzero(others[end] == others[begin + spaced])
        glue = [" " if self.lower else "" if x else "\n" for x in spaced[these].tolist()]
        text = "".join([g + raw[a:b].decode() for g, a, b in zip(glue, begin[these].tolist(), end[these].tolist(), strict=True)])
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)
        first = np.flatnonzero(np.concatenate([[True], self.border[ids[:-1]]]) if self.lower else self.border[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(first) == len(these):
            line = np.zeros(len(these), np.int64) if self.lower else 1 - spaced[these]
            at[these], size[these], known[these] = self.ids.size + first + line, np.diff(first, append=len(ids)) - line, True
            self.ids.extend(ids)
        rest = np.flatnonzero(~known)
        found = [e.ids for e in self.library.encode_batch_fast([raw[begin[k] : end[k]].decode() for k in rest.tolist()], add_special_tokens=False)]
        size[rest] = [len(x) for x in found]
        at[rest] = self.ids.size + np.cumsum(size[rest]) - size[rest]
        self.ids.extend(np.array([i for x in found for i in x], dtype=np.uint16))
        code = np.arange(len(begin), dtype=np.int32) + np.int32(self.at.size)
        self.at.extend(at)
        self.size.extend(size)
        self.blocks.extend(np.zeros(len(at), np.int32))
        self.byte_at.extend(np.cumsum(end - begin) - (end - begin) + self.bytes.size)
        self.byte_size.extend(end - begin)
        self.bytes.extend(data[_slices(begin, end - begin)])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.codes = np.insert(self.hashes, place, hashes), np.insert(self.codes, place, code)

    def _block_codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(unit numbers, first unit of each text and the total); None if two units that differ have the same hash."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts, ends, first = words(data, offsets)
        # marks at a word's end, after a Latin letter, are a unit of their own
        kind = KIND[data]
        mark_run = np.maximum.accumulate(np.where(kind == 1, 0, np.arange(1, len(data) + 1, dtype=np.int32 if len(data) < 1 << 30 else np.int64)))  # end of the last non-mark
        core = np.maximum(mark_run[ends - 1], starts)
        before = core - 1
        latin = (core > starts) & (core < ends) & ((kind[before] == 2) | (core - 2 >= starts) & (data[before - 1] == 0xC3) & (kind[before] == 3))
        core = np.where(latin, core, ends)
        spaced = starts.copy()
        spaces = [np.zeros(0, np.int64)] * 2
        if not self.lower:
            inside = np.ones(len(data) + 1, dtype=bool)
            inside[offsets] = False
            lead = (starts > 0) & inside[starts] & (data[starts - 1] == 32)
            spaced = starts - lead
            spaces = self._space_units(data, offsets, starts, ends, spaced)
        tail = np.flatnonzero(latin)
        begin = np.concatenate([spaced, core[tail], spaces[0]])
        end = np.concatenate([core, ends[tail], spaces[1]])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        h = word_hashes(data, begin, end, 4)
        order = np.argsort(h)
        ranked = h[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        distinct, where = ranked[new], order[new]
        inverse = np.empty(len(h), dtype=np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool) if not len(self.hashes) else self.hashes[np.minimum(place, len(self.hashes) - 1)] != distinct
        if new.any():
            self._learn(distinct[new], data, begin[where[new]], end[where[new]])
            place = np.searchsorted(self.hashes, distinct)
        codes = self.codes[place]
        self.blocks.data[codes] += 1
        codes = codes[inverse]
        size = end - begin
        if (self.byte_size.data[codes] != size).any() or (self.bytes.data[_slices(self.byte_at.data[codes], size)] != data[_slices(begin, size)]).any():
            return None
        return codes, np.searchsorted(begin, offsets)

    @staticmethod
    def _space_units(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> list[np.ndarray]:
        """[starts, ends] of the white space that no word takes along: what lies between the words of a text, less the
        space before a word. If a word follows at once, the last character is a unit of its own."""
        taken = np.zeros(len(data) + 1, dtype=np.int8)
        taken[spaced] += 1
        taken[ends] -= 1
        free = np.cumsum(taken[:-1], dtype=np.int8) == 0
        begin, end = free.copy(), free.copy()
        begin[1:] &= ~free[:-1]
        end[:-1] &= ~free[1:]
        some = offsets[:-1] < offsets[1:]
        at, last = offsets[:-1][some], offsets[1:][some] - 1
        begin[at], end[last] = free[at], free[last]
        low, high = np.flatnonzero(begin), np.flatnonzero(end) + 1
        follows = np.zeros(len(data) + 1, dtype=bool)
        follows[starts] = True
        follows[offsets] = False
        one = follows[high] & (high - low > 1)
        return [np.concatenate([low, high[one] - 1]), np.concatenate([np.where(one, high - 1, high), high[one]])]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with the id ``end`` after them."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
