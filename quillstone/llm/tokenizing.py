"""Encoding whole texts with a public tokenizer file, remembering the ids of chunks that recur.

The kinds of file that are recognised cut a text into pre-tokens before merging. A chunk here is a run of bytes that no pre-token leaves: it begins
at white space (a last single space belongs to what follows), after other white space, or at ASCII punctuation after an ASCII letter. So a text's
ids are those of its chunks, put together. The library encodes each chunk that is new; a table of fixed size, addressed by the chunk's hash, remembers
it, and all lookups of a batch are array operations. Texts with white space outside ASCII, texts that hold the name of an added token, such as an
end mark, and all texts under other kinds of file, are given to the library whole. The results equal those of the library as it is loaded from the
file (tests/llm hold that).
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .common import kept
from .textbytes import SPACE, span_hashes, utf8

#: Slots of the table in each Python worker, of 22 bytes; with FILL of them taken it starts anew.
SLOTS, FILL = 1 << 21, 0.6
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(128) if not (chr(b).isalnum() or SPACE[b])]] = True


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_starts(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where chunks begin; every text that isn't empty begins one."""
    n = len(data)
    space = SPACE[data]
    end = np.zeros(n + 1, bool)
    end[at[1:]] = True  # a text ends before this byte
    before = np.concatenate([[False], space[:-1]]) & ~end[:-1]
    after = np.concatenate([space[1:], [True]]) | end[1:]
    cut = space & (~before | ~after)
    cut |= before & ~space & np.concatenate([[False], data[:-1] != 0x20])
    cut |= _MARK[data] & np.concatenate([[False], _LETTER[data[:-1]]])
    cut[at[:-1][at[1:] > at[:-1]]] = True
    return np.flatnonzero(cut)


def _wide_space(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows with white space outside ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000) or the separators 1C to 1F."""
    odd = np.zeros(256, bool)
    odd[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True
    i = np.flatnonzero(odd[data])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[i], padded[i + 1], padded[i + 2]
    hit = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    rows = np.zeros(len(at) - 1, bool)
    rows[np.searchsorted(at, i[hit], "right") - 1] = True
    return rows


def _naming(at: np.ndarray, data: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Rows that hold one of the names."""
    rows, raw = np.zeros(len(at) - 1, bool), data.tobytes()
    for name in names:
        found = raw.find(name)
        while found >= 0:
            row = int(np.searchsorted(at, found, "right")) - 1
            rows[row] = True  # a name that lies across two texts marks the first one for nothing
            found = raw.find(name, int(at[row + 1]))
    return rows


def _byte_alphabet() -> dict[str, int]:
    """The letters in which byte-level vocabularies write the 256 bytes: printable ones as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        bytes_only = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and norm is None
        spaces_dropped = before.get("type") == "Sequence" and [p["type"] for p in before["pretokenizers"]] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["behavior"] == "Removed"
        added = [t for t in spec.get("added_tokens", []) if t["content"]]
        self.names = [t["content"].encode() for t in added]
        self.known = (bytes_only or spaces_dropped) and not any(t.get("normalized") for t in added)
        # bytes that each id stands for, where every id stands for its own bytes
        self.widths = None
        if self.known and bytes_only:
            alphabet, vocab = _byte_alphabet(), self.tokenizer.get_vocab()
            if all(c in alphabet for p in vocab for c in p):
                self.widths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
                self.widths[list(vocab.values())] = [len(p) for p in vocab]
        self._clear()

    def _clear(self) -> None:
        self.key, self.head = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.first, self.count = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint16)
        self.pool, self.used, self.taken = np.zeros(1 << 20, self.dtype), 0, 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 if it is not there."""
        out = np.full(len(key), -1, np.int64)
        slot, rest = (key & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(key))
        while len(rest):
            there = self.key[slot]
            hit = (there == key[rest]) & (self.head[slot] == head[rest])
            out[rest[hit]] = slot[hit]
            go = ~hit & (there != 0)
            rest, slot = rest[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _each(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one after another, and how many each has."""
        ids, cuts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), 4096):
            part = [c.decode() for c in chunks[i : i + 4096]]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, self.dtype))
            cuts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(cuts)

    def _joined(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, for chunks that are a space and then bytes without white space: put together they are a text with the same pre-tokens.

        The library need not make offsets of it, since ids tell their own length.
        """
        ids, cuts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            (found,) = self._whole([b"".join(part).decode()])
            ends = np.concatenate([[0], np.cumsum(self.widths[found])])
            at = np.searchsorted(ends, np.cumsum([len(c) for c in part]))
            if ends[-1] != sum(map(len, part)) or at[-1] != len(found) or (ends[at] != np.cumsum([len(c) for c in part])).any():
                raise AssertionError("ids of joined chunks don't part where the chunks do")
            ids.append(found)
            cuts.append(np.diff(np.concatenate([[0], at])))
        return np.concatenate(ids), np.concatenate(cuts)

    def _learn(self, key: np.ndarray, head: np.ndarray, chunks: list[bytes]) -> None:
        """Puts chunks that are not there, each once, into the table."""
        if self.widths is not None:
            second = (head >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
            plain = ((head & np.uint64(0xFF)) == 0x20) & (second != 0) & ~SPACE[second]
            order = np.argsort(~plain, kind="stable")
            key, head, chunks, n = key[order], head[order], [chunks[i] for i in order.tolist()], int(plain.sum())
            (ids, cuts), (more_ids, more_cuts) = self._joined(chunks[:n]), self._each(chunks[n:])
            ids, cuts = np.concatenate([ids, more_ids]), np.concatenate([cuts, more_cuts])
        else:
            ids, cuts = self._each(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.concatenate([[0], np.cumsum(cuts)[:-1]])
        self.used, self.taken = self.used + len(ids), self.taken + len(chunks)
        slot, rest = (key & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(key))
        while len(rest):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[rest[free]]
            mine = free & (self.key[slot] == key[rest])
            at, who = slot[mine], rest[mine]
            self.head[at], self.first[at], self.count[at] = head[who], first[who], cuts[who]
            rest, slot = rest[~mine], (slot[~mine] + 1) & (SLOTS - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after another, and each text's first (rows + 1 values). Null counts as empty."""
        at, data = utf8(column)
        rows = len(at) - 1
        alone = _wide_space(at, data) | _naming(at, data, self.names) if self.known else at[1:] > at[:-1]
        starts = chunk_starts(at, data)
        row = np.searchsorted(at, starts, "right") - 1
        if alone.any():
            keep = ~alone[row] | np.isin(starts, at[:-1])
            starts, row = starts[keep], row[keep]
        ends = np.append(starts[1:], len(data))
        whole = alone[row] | (ends - starts > 4096)
        key = span_hashes(data, starts, ends) | np.uint64(1)
        head, padded = np.zeros(len(starts), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(8):
            head |= np.where(ends - starts > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        slot = self._find(key, head)
        missing = np.flatnonzero((slot < 0) & ~whole)
        if len(missing):
            new = missing[np.unique(key[missing], return_index=True)[1]]
            if self.taken + len(new) > FILL * SLOTS:
                self._clear()
                new = np.flatnonzero(~whole)
                new = new[np.unique(key[new], return_index=True)[1]]
            raw = data.tobytes()
            if len(new) > FILL * SLOTS:  # one enormous text: what the table can't hold is encoded for this batch only
                whole |= np.isin(key, key[new[int(FILL * SLOTS) :]])
                new = new[: int(FILL * SLOTS)]
            self._learn(key[new], head[new], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            slot = self._find(key, head)
        whole |= slot < 0
        first, count, pool = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64), self.pool
        if whole.any():
            which = np.flatnonzero(whole)
            found = self._whole([data[a:b].tobytes().decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            count[which] = [len(f) for f in found]
            first[which] = self.used + np.concatenate([[0], np.cumsum(count[which])[:-1]])
            pool = np.concatenate([pool[: self.used], *found])
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.repeat(first - begin[:-1], count) + np.arange(begin[-1])]
        return ids, begin[np.searchsorted(row, np.arange(rows + 1))]


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids as 32-bit integers with end_id after each text's."""
    rows = len(begin) - 1
    out = np.full(len(ids) + rows, end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(begin))] = ids
    return out, begin + np.arange(rows + 1)


def encoder(path: str) -> Encoder:
    """One encoder for a file in a Python worker, for as long as no stage needs another."""
    return kept(("encoder", path), lambda: Encoder(path))
