"""Whole-text token ids with the tokenizers library, by way of a bounded memo of pieces.

Both public vocabularies cut a text into pieces by a pattern and merge within a
piece only. Texts of ASCII and Latin-1 letters are cut here, many at a time and
by array operations, where that pattern cuts; each distinct piece goes through
the library's model once. Any other text is cut at spaces before a non-space, a
border that no piece spans, and each distinct chunk goes through the library's
whole encoder. Both give the ids of encoding the text whole (tested against that).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyrail.llm.common import mix

#: Bound of a memo: entries kept before it starts anew.
PIECES = 1_000_000
#: Characters of the texts that are cut at once, and of a piece that the table of pieces takes.
BLOCK, LONG = 1 << 20, 64
_BORDER = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")
#: Kinds of characters: other, letter, digit, white space, end of a text, and those not cut here.
_OTHER, _LETTER, _DIGIT, _SPACE, _END, _FOREIGN = range(6)


def _kinds() -> np.ndarray:
    """Kind of every Latin-1 character; byte 0 ends a text."""
    out = np.full(256, _FOREIGN, np.uint8)
    out[33:127] = _OTHER
    out[[9, 10, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
    out[0] = _END
    return out


KINDS = _kinds()
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
#: Contractions that are pieces of their own after an apostrophe, in the order of both patterns.
SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: An odd number, its powers and their inverses modulo 2^64: hashes of all pieces come from one running sum.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], size = 1, 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        out[size : 2 * size] = (out[:size] * step)[: n - size]
        size *= 2
    return out


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 as it is, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cut(buf: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts in Latin-1, each ended by byte 0.

    A piece is a run of one kind of characters; a digit is one by itself under the
    word pattern, which drops white space. Under the byte pattern a space before
    another kind belongs to that piece, and the last of several white-space
    characters before one stands apart. An apostrophe that starts a piece takes a
    contraction after it along.
    """
    kind = KINDS[buf]
    new = np.empty(len(buf) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
    new[1:-1] |= kind[1:] == _END
    if words:
        new[1:-1] |= kind[1:] == _DIGIT
    quotes = np.flatnonzero(buf == 39)
    quotes = quotes[new[quotes]]
    if not words:
        blank = np.flatnonzero(kind[:-1] == _SPACE)
        blank = blank[(kind[blank + 1] != _SPACE) & (kind[blank + 1] != _END)]
        joins = buf[blank] == 32
        new[blank] = True
        new[blank[joins] + 1] = False
        quotes = quotes[new[quotes]]
    for part in SHORT:
        at = quotes[quotes + len(part) < len(buf)]
        for i, ch in enumerate(part, 1):
            at = at[buf[at + i] == ch]
        new[at + 1] = False
        new[at + 1 + len(part)] = True
    edges = np.flatnonzero(new)
    start, end = edges[:-1], edges[1:]
    drop = kind[start] == _END
    if words:
        drop |= kind[start] == _SPACE
    return start[~drop], end[~drop]


class _Table:
    """Ids of pieces by hash, first bytes and length, in open addressing; pieces are numbered in order of first use."""

    def __init__(self, cap: int):
        self.bits = max(10, int(2 * cap).bit_length())
        self.hash = np.zeros(1 << self.bits, np.uint64)
        self.mark = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)
        self.flat, self.start = array("i"), array("q", [0])

    def __len__(self) -> int:
        return len(self.start) - 1

    def find(self, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        todo, at = None, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while True:
            number = self.number[at]
            here = (self.hash[at] == (h if todo is None else h[todo])) & (self.mark[at] == (mark if todo is None else mark[todo])) & (number >= 0)
            if todo is None:
                out[here] = number[here]
                todo = np.flatnonzero(~here & (number >= 0))
                at = at[todo]
            else:
                out[todo[here]] = number[here]
                more = ~here & (number >= 0)
                todo, at = todo[more], at[more]
            if not len(todo):
                return out
            at = (at + 1) & ((1 << self.bits) - 1)

    def add(self, h: np.ndarray, mark: np.ndarray, ids: list[list[int]]) -> None:
        """Take in new, distinct pieces."""
        number = len(self) + np.arange(len(ids), dtype=np.int32)
        for x in ids:
            self.flat.extend(x)
            self.start.append(len(self.flat))
        todo, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.number[at] < 0
            self.number[at[free]] = number[todo[free]]  # of several at one place the last stays
            won = self.number[at] == number[todo]
            self.hash[at[won]], self.mark[at[won]] = h[todo[won]], mark[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has."""
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.int32)
        begin = start[number]
        length = start[number + 1] - begin
        ahead = np.cumsum(length)
        at = np.repeat(begin - ahead + length, length)
        at += np.arange(len(at))
        return flat[at], length


class _Memo(dict):
    """Number of each key in order of first use; the keys' ids lie end to end in ``flat``."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.flat, self.start = ids_of, array("i"), array("q", [0])

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.start) - 1
        self.flat.extend(self.ids_of(key))
        self.start.append(len(self.flat))
        return n

    def gather(self, keys: list[str]) -> np.ndarray:
        idx = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.int32)
        begin = start[idx]
        length = start[idx + 1] - begin
        ahead = np.cumsum(length)
        total = int(ahead[-1]) if len(idx) else 0
        return flat[np.repeat(begin - ahead + length, length) + np.arange(total)]


class ChunkTokenizer:
    """Ids of texts under one vocabulary file, named as in ``public_tokenizers`` or by path."""

    def __init__(self, name: str, pieces: int = PIECES, block: int = BLOCK):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.full = Tokenizer.from_file(path)
        self.words = "word" in os.path.basename(path)
        letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        tokenize, encode = self.full.model.tokenize, self.full.encode
        self._of_piece = lambda piece: [t.id for t in tokenize(piece if piece.isalnum() and piece.isascii() else piece.encode().decode("latin-1").translate(letters))]
        self._of_chunk = lambda chunk: encode(chunk, add_special_tokens=False).ids
        self.cap, self.block = pieces, block
        self.table, self.chunks = _Table(pieces), _Memo(self._of_chunk)
        self.power = _powers(_BASE, block + 1)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), block + 1)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, int32; none for a null or empty text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            raw = None
            if text and len(text) < self.block and "<|" not in text and "\0" not in text:
                try:
                    raw = text.encode("latin-1")
                except UnicodeEncodeError:
                    raw = None
            if raw is None:
                out[i] = self._by_chunks(text)
                continue
            if size + len(raw) + 1 > self.block:
                self._block(held, texts, out)
                held, size = [], 0
            held.append((i, raw))
            size += len(raw) + 1
        if held:
            self._block(held, texts, out)
        return out

    def _block(self, held: list[tuple[int, bytes]], texts: list[str | None], out: list) -> None:
        """Cut and look up texts of Latin-1 together; those with characters of no known kind go by chunks."""
        data = b"\0".join([raw for _, raw in held]) + b"\0"
        if self.words:
            data = data.translate(_LOWER)
        buf = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(raw) + 1 for _, raw in held])
        start, end = cut(buf, self.words)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.power[: len(buf)] * (buf + np.uint64(1)), out=total[1:])
        size = end - start
        h = mix((total[end] - total[start]) * self.inverse[start])
        # The first eight bytes and the length go along, so that short pieces cannot be mistaken at all.
        padded = np.frombuffer(data + bytes(8), np.uint8)
        first = np.lib.stride_tricks.as_strided(padded, (len(buf), 8), (1, 1))[start].view("<u8").ravel()
        first = first & self._first[np.minimum(size, 8)]
        mark = first ^ (size.astype(np.uint64) << np.uint64(56))
        number = self.table.find(h, mark)
        missed = np.flatnonzero((number < 0) & (size <= LONG))
        if len(missed):
            _, once = np.unique(h[missed], return_index=True)
            new = missed[once]
            if len(self.table) + len(new) > self.cap:
                self.table = _Table(max(self.cap, len(new)))
                number[:] = self.table.find(h, mark)
                missed = np.flatnonzero(size <= LONG)
                _, once = np.unique(h[missed], return_index=True)
                new = missed[once]
            of = self._of_piece
            self.table.add(h[new], mark[new], [of(data[a:b].decode("latin-1")) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            number[missed] = self.table.find(h[missed], mark[missed])
        long = np.flatnonzero(number < 0)
        ids, length = self.table.gather(np.maximum(number, 0)) if len(self.table) else (np.empty(0, np.int32), np.zeros(len(number), np.int64))
        if len(long):  # pieces beyond the table's length one by one
            parts = np.split(ids, np.cumsum(length)[:-1])
            for k in long.tolist():
                parts[k] = np.array(self._of_piece(data[start[k] : end[k]].decode("latin-1")), np.int32)
                length[k] = len(parts[k])
            ids = np.concatenate(parts)
        upto = np.concatenate(([0], np.cumsum(length)))
        bounds = upto[np.searchsorted(start, np.concatenate(([0], ends)))]
        foreign = np.add.reduceat(KINDS[buf] == _FOREIGN, np.concatenate(([0], ends[:-1])))
        for (i, _), a, b, odd in zip(held, bounds[:-1].tolist(), bounds[1:].tolist(), foreign.tolist(), strict=True):
            out[i] = self._by_chunks(texts[i]) if odd else ids[a:b]

    def _by_chunks(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = _BORDER.split(text) if _ODD.search(text) else text.split(" ")
        keys = ([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]]
        out = [np.empty(0, np.int32)]
        for at in range(0, len(keys), self.cap):  # a text with more keys than a memo holds goes in blocks
            if len(self.chunks) >= self.cap:
                self.chunks = _Memo(self._of_chunk)
            out.append(self.chunks.gather(keys[at : at + self.cap]))
        return np.concatenate(out)

    _first = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


_OPEN: dict[str, ChunkTokenizer] = {}


def tokenizer(name: str) -> ChunkTokenizer:
    """The worker's tokenizer of that name, opened once in a process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = ChunkTokenizer(name)
    return _OPEN[name]
