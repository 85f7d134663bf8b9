"""Byte-level BPE ids of whole texts, a column at a time.

`BytePairs` gives the ids that the `tokenizers` library gives for a byte-level
BPE file with add_special_tokens=False and encode_special_tokens=True (the
strings of special tokens in a text are ordinary text). It cuts texts before
single blanks between two visible characters, where that pre-tokenizer always
cuts, encodes each different piece of a batch once, and joins the ids again.
A null text is empty.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from skald.llm.common import AT_REST, BYTE, GOLDEN, ODD, buffers, mix, slices


def default_path() -> str:
    """Where the public 50k byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BytePairs:
    #: Split pattern of the byte-level pre-tokenizer (a fixed value of the file format).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    _loaded: dict = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"]["".join(m)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: ids are not in the order of merges")
        merged = 256 + len(merges)
        ranks = {token: i for token, i in ranks.items() if i < merged}
        self.core = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(merged, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self._forget()

    @classmethod
    def load(cls, path: str) -> BytePairs:
        """One for each worker and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    def rest(cls) -> None:
        """Give back what has been learnt: a worker that lives on needs it no more."""
        for one in cls._loaded.values():
            one._forget()

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each row's begin (n + 1 offsets)."""
        raw, at = buffers(col)
        try:
            bytes(raw).decode()
        except UnicodeDecodeError:
            col = pa.array([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])])
            raw, at = buffers(col)
        found, first = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for lo, hi in slices(at):
            ids, begin = self._slice(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            found.append(ids)
            first.append(first[-1][-1] + begin[1:])
        return np.concatenate(found), np.concatenate(first)

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        border, row = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        row[at] = True
        border[at] = True
        border[self._cuts(raw)] = True
        cut = np.flatnonzero(border)
        size = np.diff(cut)
        power = np.cumprod(np.full(int(size.max()), ODD, np.uint64))
        begin = np.repeat(cut[:-1], size)
        name = mix(np.add.reduceat(BYTE[raw] * power[np.arange(n) - begin], cut[:-1]) + size.astype(np.uint64) * GOLDEN) | np.uint64(1)
        if self.known > self.MOST:
            self._forget()
        slot = self._find(name)
        if (missing := np.flatnonzero(slot < 0)).size:
            head = row[cut[:-1]][missing]
            pieces = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
            alone = missing[head]
            own = [self.core.encode_ordinary(x) for x in pieces.take(pa.array(alone)).to_pylist()]
            self._learn(name[alone], np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64))
            # the others begin with a blank before a visible character, so that their ids are the same when they stand in one text
            rest = missing[~head]
            coded = pieces.take(pa.array(rest)).dictionary_encode()
            data, ends = buffers(coded.dictionary)
            if len(data):
                ids = self.core.encode_to_numpy(bytes(data).decode(), disallowed_special=())
                reach = np.append(0, np.cumsum(self.size[ids]))
                split = np.searchsorted(reach, ends)
                if not np.array_equal(reach[split], ends):
                    raise ValueError("a token crosses the border of a piece")
                code = coded.indices.to_numpy(zero_copy_only=False)
                names = np.zeros(len(coded.dictionary), np.uint64)
                names[code] = name[rest]
                self._learn(names, ids, np.diff(split))
            slot[missing] = self._find(name[missing])
        many = self.many[slot]
        done = np.append(0, np.cumsum(many))
        place = np.repeat(self.first[slot] - done[:-1], many) + np.arange(done[-1])
        return self.stock[place], done[np.searchsorted(cut, at)]

    # What pieces have been encoded so far, as an open-addressing table by 64-bit hash of at most MOST + one slice's pieces.
    MOST = 1 << 19

    def _forget(self) -> None:
        self.name = np.zeros(1 << 16, np.uint64)
        self.first, self.many = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.stock, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, name: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        last = np.uint64(len(self.name) - 1)
        slot = (name & last).astype(np.int64)
        there = self.name[slot]
        out = np.where(there == name, slot, -1)
        left = np.flatnonzero((there != name) & (there != 0))
        while left.size:
            slot[left] = (slot[left] + 1) & int(last)
            there = self.name[slot[left]]
            hit = there == name[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (there != 0)]
        return out

    def _learn(self, name: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        first = self.used + np.append(0, np.cumsum(many))
        while len(self.stock) < first[-1]:
            self.stock = np.concatenate([self.stock, np.zeros_like(self.stock)])
        self.stock[self.used : first[-1]] = ids
        self.used = int(first[-1])
        if len(self.name) < 3 * (self.known + len(name)):
            old, kept = self.name, np.flatnonzero(self.name)
            a, b = self.first[kept], self.many[kept]
            bits = int(4 * (self.known + len(name))).bit_length()
            self.name, self.first, self.many = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
            self.known = 0
            self._put(old[kept], a, b)
        self._put(name, first[:-1], many)

    def _put(self, name: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        _, one = np.unique(name, return_index=True)
        left, last = one[self._find(name[one]) < 0], len(self.name) - 1
        slot = (name & np.uint64(last)).astype(np.int64)
        while left.size:
            _, mine = np.unique(slot[left], return_index=True)
            mine = left[mine]
            mine = mine[self.name[slot[mine]] == 0]
            self.name[slot[mine]], self.first[slot[mine]], self.many[slot[mine]] = name[mine], first[mine], many[mine]
            self.known += len(mine)
            left = left[self.name[slot[left]] != name[left]]
            slot[left] = (slot[left] + 1) & last

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        """Blanks between two characters of which neither can be white space."""
        p = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        p = p[(p > 0) & (p < len(raw) - 1)]
        before, after = _SEEN[raw[p - 1]], _OPENS[raw[p + 1]]
        sure, odd = p[before & after], p[~before & after & (raw[p - 1] >= 0x80)]
        if not odd.size:
            return sure
        second, third, fourth = raw[odd - 2], raw[np.maximum(odd - 3, 0)], raw[np.maximum(odd - 4, 0)]
        two, more = (second >= 0xC3) & (second <= 0xDF), _OPENS & (np.arange(256) >= 0xE0)
        tail = (second >= 0x80) & (second < 0xC0)
        return np.concatenate([sure, odd[two | (tail & (more[third] | ((third >= 0x80) & (third < 0xC0) & more[fourth])))]])


#: Bytes that are a visible ASCII character; bytes that open a character that is surely no white space.
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True
_OPENS = _SEEN.copy()
_OPENS[0xC3:0xE1] = True
_OPENS[0xE4:0xF5] = True
AT_REST.append(BytePairs.rest)
