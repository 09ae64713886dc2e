"""Token ids of whole texts, with pieces that repeat encoded once.

Both tokenizers split a text before merging, and never across the end of a run
of white space. A chunk that such a split is certain to isolate has the same
ids wherever it stands, so its ids are kept. Texts in which the split could
depend on more than the chunk (other white space, letters outside Latin,
special tokens) go to the tokenizer whole. Where each space stands alone a
text is split at spaces, which is several times faster than by a pattern. Many
texts at once are split as one array of bytes, and their different pieces are
merged side by side.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import regex

from nearsieve.llm.merges import WIDEST, Merges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_BESIDE = re.compile(r" \s|\s ")
_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
_WHITE = np.isin(np.arange(256), [9, 10, 13, 32])
_KEPT, _LONGEST = 600_000, 64

# Fixed values of the two public tokenizers: how they split a text, and the
# letter that stands for each byte (printable bytes for themselves, the others
# from U+0100 on in order).
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


# Kinds of characters by code point: space, line feed, letter, number and others.
_SPACE, _FEED, _LETTER, _NUMBER, _OTHER = range(5)
_KINDS = np.array([_SPACE if c == " " else _FEED if c == "\n" else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER for c in map(chr, range(0x250))], np.uint8)
_BYTE_KINDS = np.append(_KINDS[:128], np.full(128, _OTHER, np.uint8))


def _pieces(data: np.ndarray, texts: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces begin in texts given as UTF-8 with the places where texts begin.

    ``spaced``: the pieces of _BYTE_SPLIT in texts that pass ``_alone``; else
    those of _WORD_SPLIT in plain texts of small letters without white space.
    A piece is a run of one kind, with the space before it, or a line feed, or in
    _WORD_SPLIT one number. An apostrophe that begins a piece takes an ending
    such as ``s`` or ``ll`` with it.
    """
    kinds = _BYTE_KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kinds[lead] = kinds[lead + 1] = _KINDS[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
    new, first = np.zeros(len(data) + 4, bool), np.zeros(len(data) + 4, bool)
    new[1 : len(data)] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE)
    new[: len(data)] |= kinds <= _FEED if spaced else (kinds == _NUMBER) & (data & 0xC0 != 0x80)
    first[texts] = first[len(data) :] = True
    new |= first
    at = np.flatnonzero(data == 39)
    at = at[new[at]]
    if len(at):
        near = np.append(data, np.zeros(4, np.uint8))
        one, two = np.where(first[at + 1], 0, near[at + 1]), np.where(first[at + 1] | first[at + 2], 0, near[at + 2])
        short = np.isin(one, list(b"stmd"))
        long = (two != 0) & ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108))
        new[at[short | long] + 1] = False
        new[at[short] + 2] = new[at[long] + 3] = True
    return np.flatnonzero(new[: len(data)])


def _unspaced(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The data without white space, where its words begin, and where its texts end."""
    white = _WHITE[data]
    after, kept = np.append(True, white[:-1]), ~white
    after[ends[:-1]] = True
    return data[kept], np.flatnonzero(after[kept]), ends - np.searchsorted(np.flatnonzero(white), ends)


class _Known(dict):
    """Ids as bytes by key, computed where missing; emptied when it is full."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        found = self.ids(key)
        if len(key) <= _LONGEST:
            self[key] = found
        return found


def _plain(text: str) -> bool:
    """Whether the text has plain characters only and no special token."""
    try:
        plain = not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        plain = _PLAIN.fullmatch(text) is not None
    return plain and "<|" not in text


def _alone(text: str) -> bool:
    """Whether the text is plain, its white space is spaces and line feeds, and each of them stands alone."""
    if not _plain(text) or "  " in text or "\t" in text or "\r" in text:
        return False
    return "\n" not in text or not ("\n\n" in text or " \n" in text or "\n " in text)


class Encoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A null text counts as empty. ``spaced``: white space belongs to chunks (byte-level BPE); else the tokenizer drops it.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        tokenize, split = self.tokenizer.model.tokenize, regex.compile(_BYTE_SPLIT if spaced else _WORD_SPLIT).findall
        merged = _Known(lambda piece: array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]).tobytes())
        self.known = _Known(lambda chunk: b"".join(map(merged.__getitem__, split(chunk if spaced else chunk.lower()))))
        self.after_space = _Known(lambda word: b"".join(map(merged.__getitem__, split(" " + word))))
        self.merges = Merges(path, _SHOWN)

    def ids(self, text: str | None) -> array:
        out = array("I")
        if not text:
            return out
        if "<|" in text or not _PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not self.spaced:
            out.frombytes(b"".join(map(self.known.__getitem__, text.split())))
        elif _BESIDE.search(text):
            out.frombytes(b"".join(map(self.known.__getitem__, _SPACED.findall(text))))
        else:  # each space stands alone, and so begins a piece
            first, *rest = text.split(" ")
            out.frombytes(self.known[first] + b"".join(map(self.after_space.__getitem__, rest)))
        return out

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """``ids`` of each text."""
        out, which, fit = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            if (found := self._fit(text)) is None:
                out.append(np.array(self.ids(text), np.uint32))
            else:
                which.append(i)
                fit.append(found)
                out.append(None)
        if not which:
            return out
        plain = pa.array(fit, pa.string())
        ends = np.frombuffer(plain.buffers()[1], np.int32)[1 : len(which) + 1]
        data, firsts = np.frombuffer(plain.buffers()[2], np.uint8)[: ends[-1]], np.append(0, ends[:-1])
        if not self.spaced:
            data, firsts, ends = _unspaced(data, ends)
        begins = _pieces(data, firsts, self.spaced)
        bounds = np.append(begins, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        flat, sizes = self._merged(pieces)
        taken = sizes[codes]
        above = np.append(0, np.cumsum(taken))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - above[:-1], taken) + np.arange(above[-1])]
        for i, part in zip(which, np.split(ids, above[np.searchsorted(begins, ends[:-1])]), strict=True):
            out[i] = part
        return out

    def _fit(self, text: str | None) -> str | None:
        """The text as ``_pieces`` splits it, or None if it has to be encoded by itself."""
        if not text or not self.merges.exact:
            return None
        if self.spaced:
            return text if _alone(text) else None
        if text.isspace() or not _plain(text):
            return None
        small = text.lower()  # of some plain letters, the small one isn't
        return small if _plain(small) else None

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has; long pieces go to the tokenizer."""
        bounds, data = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1], np.frombuffer(pieces.buffers()[2], np.uint8)
        sizes = np.diff(bounds)
        if not (long := np.flatnonzero(sizes > WIDEST)).size:
            return self.merges.ids(data, bounds[:-1], sizes)
        short = np.flatnonzero(sizes <= WIDEST)
        flat, some = self.merges.ids(data, bounds[short], sizes[short])
        slow = [np.frombuffer(self.known[pieces[i].as_py().decode()], np.uint32) for i in long.tolist()]
        counts = np.empty(len(pieces), np.int64)
        counts[short], counts[long] = some, [len(x) for x in slow]
        return np.concatenate([flat, *slow])[_regroup(np.append(short, long), counts)], counts


def _regroup(order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the items of groups 0, 1, ... lie in an array that holds the groups in ``order``."""
    held = counts[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(held) - held
    return np.repeat(place - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder a process; tokenizer files are small and stay where they are."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
