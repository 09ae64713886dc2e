"""Byte-level pair merging of many short pieces at once."""

from __future__ import annotations

import json

import numpy as np

WIDEST = 48  # bytes of a piece


class Merges:
    """``ids`` merges each piece by the ranks of a tokenizer file's model.

    As in the tokenizer, the pair of least rank is merged, the leftmost of
    equals, until no pair has a rank. The last byte of a piece bears the
    model's suffix for the end of words, if there is one. Pieces of one length
    lie side by side in a matrix and lose one token in each round, so a round
    is a few array operations. Ranks of pairs are found in a hash table with
    chains.
    """

    def __init__(self, path: str, shown: dict[int, int]):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.exact = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        suffix = model.get("end_of_word_suffix") or ""
        self.first, self.last = (np.array([vocab[chr(shown.get(b, b)) + x] for b in range(256)], np.int32) for x in ("", suffix))
        self.none, self.made = len(pairs), np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = np.uint64(max(vocab.values()) + 1)
        self.keys = np.append(np.array([vocab[a] for a, _ in pairs], np.uint64) * self.base + np.array([vocab[b] for _, b in pairs], np.uint64), ~np.uint64(0))
        self.slots, self.after = np.full(1 << 20, self.none, np.int32), np.full(self.none + 1, self.none, np.int32)
        for i, slot in enumerate(self._slot(self.keys[:-1]).tolist()):
            self.after[i], self.slots[slot] = self.slots[slot], i

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where it isn't merged."""
        keys = left.astype(np.uint64) * self.base + right.astype(np.uint64)
        at = self.slots[self._slot(keys)]
        todo = np.flatnonzero((at != self.none) & (self.keys[at] != keys))
        while len(todo):
            at.flat[todo] = self.after[at.flat[todo]]
            now = at.flat[todo]
            todo = todo[(now != self.none) & (self.keys[now] != keys.flat[todo])]
        return at

    def ids(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of 1 to WIDEST bytes at ``begins`` of ``data``, one after the other, and how many each has."""
        order = np.argsort(sizes, kind="stable")
        counts, ended = np.zeros(len(sizes), np.int64), []
        for which in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(which):
                spelled = data[begins[which] + np.arange(sizes[which[0]])[:, None]]
                ended += self._merge(np.concatenate([self.first[spelled[:-1]], self.last[spelled[-1:]]]), which)
        for which, tokens in ended:
            counts[which] = len(tokens)
        flat, place = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for which, tokens in ended:
            flat[place[which] + np.arange(len(tokens))[:, None]] = tokens
        return flat, counts

    def _merge(self, tokens: np.ndarray, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces of one length, a column each, as (numbers of pieces, their ids) by number of ids."""
        ended, ranks = [], self.ranks(tokens[:-1], tokens[1:])
        row = np.arange(len(tokens), dtype=np.int32)[:, None]
        while len(tokens) > 1:
            best = (ranks << 6 | row[: len(ranks)]).min(axis=0)
            go = best >> 6 != self.none
            if not go.all():
                ended.append((which[~go], tokens[:, ~go]))
                which, tokens, ranks, best = which[go], tokens[:, go], ranks[:, go], best[go]
            if not len(which):
                return ended
            at, made = best & 63, self.made[best >> 6]
            moved = row[: len(ranks)] > at
            tokens = np.where(moved, tokens[1:], tokens[:-1])
            tokens[at, np.arange(len(at))] = made
            ranks = np.where(moved[:-1], ranks[1:], ranks[:-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < len(tokens) - 1)
            ranks[at[left] - 1, left] = self.ranks(tokens[at[left] - 1, left], made[left])
            ranks[at[right], right] = self.ranks(made[right], tokens[at[right] + 1, right])
        return [*ended, (which, tokens)]
