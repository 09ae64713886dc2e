"""Parameters of the index, its queries and its sketches."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cached_property

MASK = 4294967295


@dataclass(frozen=True)
class KnnConfig:
    """``hashes`` signature bins make an address in each of ``tables`` tables of 2^``address_bits``
    buckets, which hold ``reservoir`` ids each. All random constants follow from ``seed``."""

    hashes: int = 2
    tables: int = 8
    address_bits: int = 12
    reservoir: int = 64
    top_k: int = 10
    sketch_rows: int = 4
    sketch_bits: int = 8
    attempts: int = 101
    seed: int = 20

    def __post_init__(self):
        if not 2 <= self.bins <= 2**self.address_bits or not 1 <= self.address_bits <= 31:
            raise ValueError("hashes * tables must be at least 2 and at most 2^address_bits")
        if min(self.reservoir, self.top_k, self.sketch_rows, self.attempts) < 1:
            raise ValueError("reservoir, top_k, sketch_rows and attempts must be positive")

    @property
    def bins(self) -> int:
        return self.hashes * self.tables

    @property
    def width(self) -> int:
        return 2**self.address_bits // self.bins

    @cached_property
    def constants(self) -> dict:
        r = random.Random(self.seed)
        odd = lambda: r.getrandbits(32) | 1
        return {"feature": odd(), "probe": odd(), "id": odd(), "bins": [odd() for _ in range(self.bins)], "rows": [odd() for _ in range(self.sketch_rows)]}

    @cached_property
    def donors(self) -> list[list[int]]:
        """For each bin the bins that it asks, in order, when it is empty."""
        out = []
        for i in range(self.bins):
            h = [(self.constants["probe"] * (((i + 1) << 10) + c) & MASK) for c in range(1, self.attempts + 1)]
            out.append([(((x << 3) & MASK) * self.bins) >> 32 for x in h])
        return out


ORDERS = KnnConfig()
TEXTS = KnnConfig(hashes=2, tables=16, address_bits=16, reservoir=256, seed=21)
