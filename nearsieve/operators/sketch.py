"""Heavy-hitter sketches of candidate streams, and their merges.

A sketch has rows of cells; a cell holds one id and a count. In stream order,
an id that a cell holds adds to its count and any other takes from it; at
zero the newcomer takes the cell with count one, at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from nearsieve.config import MASK, KnnConfig
from nearsieve.functions.u32 import mask, mul, top_bits
from nearsieve.operators.query import ranked


def cell_of(id_: Column, row: int, cfg: KnnConfig) -> Column:
    return top_bits(mul(mask(id_ + 1), cfg.constants["rows"][row]), 0, cfg.sketch_bits)


def merge(mine: Column, theirs: Column) -> Column:
    """Same id: counts add; mine larger: theirs is taken off; else theirs less mine."""
    hh = F.when(mine["cnt"] > theirs["cnt"], mine["hh"]).when(mine["hh"] == theirs["hh"], mine["hh"]).otherwise(theirs["hh"])
    cnt = F.when(mine["hh"] == theirs["hh"], mine["cnt"] + theirs["cnt"]).otherwise(F.abs(mine["cnt"] - theirs["cnt"]))
    return F.struct(hh.alias("hh"), cnt.cast("long").alias("cnt"))


def _hashed(items: np.ndarray, factor: int, bits: int) -> np.ndarray:
    """``cell_of`` in numpy."""
    low = (items + 1).astype(np.uint64) & np.uint64(MASK)
    return ((low * np.uint64(factor) & np.uint64(MASK)) >> np.uint64(32 - bits)).astype(np.int64)


def _folded(group: np.ndarray, items: np.ndarray, hh: np.ndarray, cnt: np.ndarray) -> None:
    """Fold the items, in order, into the cells ``hh`` and ``cnt`` that ``group`` names: the n-th items of
    all cells at once, so there are as many steps as the busiest cell has items."""
    if not len(group):
        return
    bits = len(group).bit_length()
    packed = np.sort(group << bits | np.arange(len(group)))  # stable, and faster than a sort of places
    order, group = packed & (1 << bits) - 1, packed >> bits
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    own, size = group[begin], np.diff(np.append(begin, len(group)))
    most = np.argsort(-size, kind="stable")
    own, begin, size = own[most], begin[most], size[most]
    items = items[order]
    ends = np.searchsorted(-size, -np.arange(size[0]), "left")  # cells with more than n items
    for n, end in enumerate(ends.tolist()):
        at, x = own[:end], items[begin[:end] + n]
        left = np.where(cnt[at] > 0, cnt[at] + np.where(hh[at] == x, 1, -1), 0)
        hh[at], cnt[at] = np.where(left == 0, x, hh[at]), np.where(left == 0, 1, left)


def sketch(stream: DataFrame, cfg: KnnConfig, keys: list[str], order: list[str], item: str = "id", rows: int | None = None, without: str | None = None) -> DataFrame:
    """``keys, row, cell, hh, cnt`` of ``stream``, folded by ``order`` in each cell; the first ``rows`` rows alone, if given.

    ``item`` is an id or a list of ids, read in its order. ``without`` names a key whose own value is no
    item of its stream. One shuffle by the keys: each task reads its streams in order and holds the cells
    of one key and a batch, however long a stream is. A stream that is long for one task is cut into
    parts by a further key, whose cells ``linear_merge`` or ``tree_merge`` put together. Keys and items
    are whole numbers without nulls.
    """
    count, size = cfg.sketch_rows if rows is None else rows, 1 << cfg.sketch_bits
    factors, bits = cfg.constants["rows"][:count], cfg.sketch_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hh, cnt = None, np.zeros(0, np.int64), np.zeros(0, np.int64)  # the key that may go on, and its cells

        def cells(named: np.ndarray, hh: np.ndarray, cnt: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(cnt)  # a cell that has seen an item never holds 0
            place = at % (count * size)
            own = [pa.array(named[at // (count * size), j]) for j in range(len(keys))]
            return pa.record_batch([*own, pa.array((place // size).astype(np.int32)), pa.array(place % size), pa.array(hh[at]), pa.array(cnt[at])], [*keys, "row", "cell", "hh", "cnt"])

        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                named = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
                items = batch.column("item")
                starts = items.offsets.to_numpy()
                row = np.repeat(np.arange(len(named)), np.diff(starts))
                items = items.flatten().to_numpy()
                if without is not None:
                    other = items != named[row, keys.index(without)]
                    row, items = row[other], items[other]
                new = np.ones(len(named), bool)
                new[1:] = (named[1:] != named[:-1]).any(axis=1)
                of = np.cumsum(new) - 1
                named = named[new]
                old = last is not None and bool((named[0] == last).all())
                if last is not None and not old and cnt.any():
                    yield cells(last[None], hh, cnt)
                state = np.zeros(len(named) * count * size, np.int64), np.zeros(len(named) * count * size, np.int64)
                if old:
                    state[0][: len(hh)], state[1][: len(cnt)] = hh, cnt
                for r, factor in enumerate(factors):
                    _folded((of[row] * count + r) * size + _hashed(items, factor, bits), items, *state)
                edge = (len(named) - 1) * count * size
                if edge and state[1][:edge].any():
                    yield cells(named, state[0][:edge], state[1][:edge])
                last, hh, cnt = named[-1], state[0][edge:], state[1][edge:]
        if last is not None and cnt.any():
            yield cells(last[None], hh, cnt)

    one = F.col(item).cast("array<long>") if isinstance(stream.schema[item].dataType, ArrayType) else F.array(F.col(item).cast("long"))
    rows_ = stream.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.col(c).alias(f"_{c}") for c in order], one.alias("item"))
    near = rows_.repartition(*keys).sortWithinPartitions(*keys, *[f"_{c}" for c in order])
    return near.select(*keys, "item").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", row int, cell long, hh long, cnt long")


def linear_merge(cells: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """Parts folded one after the other, in ascending order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(part, "hh", "cnt"))), lambda c: F.struct(c["hh"].alias("hh"), c["cnt"].alias("cnt")))
    folded = F.aggregate(F.slice(items, 2, 1 << 30), F.get(items, F.lit(0)), merge)
    return cells.groupBy(*keys, "row", "cell").agg(folded.alias("c")).select(*keys, "row", "cell", "c.hh", "c.cnt")


def tree_merge(cells: DataFrame, keys: list[str], parts: int, part: str = "part") -> DataFrame:
    """Pairs of parts merged in ceil(log2 parts) rounds, the lower part first."""
    for _ in range(max(0, (parts - 1).bit_length())):
        halved = cells.withColumn("up", F.shiftright(part, 1))
        cells = linear_merge(halved.withColumnRenamed(part, "low"), [*keys, "up"], "low").withColumnRenamed("up", part)
    return cells.select(*keys, "row", "cell", "hh", "cnt")


def sketch_top_k(cells: DataFrame, cfg: KnnConfig, k: int, threshold: int = 0) -> DataFrame:
    """``qid, rank, id, n``: the k ids of row 0 with the highest counts.

    A cell of row 0 with a count of at least ``threshold`` stands for its id; a lesser one's id takes
    the count of the first other row whose own cell for that id counts more than ``threshold``,
    and is left out if there is none. Counts of 0 are no candidates.
    """
    first = cells.filter("row = 0").select("qid", F.col("hh").alias("id"), F.col("cnt").alias("n"))
    if threshold > 0:
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), cell_of(F.col("id"), r, cfg).alias("cell")) for r in range(1, cfg.sketch_rows)]))
        low = first.filter(F.col("n") < threshold).select("qid", "id", each.alias("x")).select("qid", "id", "x.row", "x.cell")
        other = cells.filter((F.col("row") > 0) & (F.col("cnt") > threshold)).select("qid", "row", "cell", "cnt")
        found = low.join(other, ["qid", "row", "cell"]).groupBy("qid", "id").agg(F.min_by("cnt", "row").alias("n"))
        first = first.filter(F.col("n") >= threshold).union(found)
    return ranked(first.filter("n > 0"), k)
