"""Passages that repeat across documents, exactly or with small changes.

Seeds are runs of SEED words chosen by their own words alone, such that any
WINDOW + SEED - 1 equal words share one. Each seed is linked to its first occurrence (least
document, then position), a star instead of all pairs. The links of a document
with an anchor document become blocks on diagonals, blocks are chained in
order with gap costs by a Fenwick tree of prefix maxima, the gaps of a chain are
aligned word by word, a chain that isn't alike enough is split at its worst gaps,
and ends are drawn out past changed words.

A star's centre may share less with two documents than they do with each other. Where the seeds of a passage
lead to different anchors, or end before it does, the passage's runs of PASSAGE words are seeds of a second star, whose
centre has the whole run; its links are chained and aligned like the others. A run that is left out there is
covered by the seeds of an anchor that has all of it, so no exact run of PASSAGE words is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.llm.env import cut, read_table, slices
from nearsieve.llm.words import Words, mix

SEED, WINDOW = 5, 3
PASSAGE = 50  # least words of a passage, on both sides of its alignment
IDENTITY = 0.8
GAP_COST, GAP = 0.1, 40  # per word that a gap spans on either side; longer gaps end a chain
REACH = 48  # words beyond a chain's ends that are looked at
DROP = 8  # an end is drawn out until its equal words less its changes fall by more than this
LEAST = 2 * SEED  # words of the blocks of a pair, or of a chain, that is looked at
GRID = 32  # slices begin and end at multiples of this, so that chains share them
PARTS = 12  # bits of a seed by which seeds are packed and shuffled
SMALL = 16 << 20  # lists of documents of up to about this many bytes are broadcast


def minimizers(words: Words, k: int = SEED, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the runs of ``k`` words whose least run of ``k - w`` words is their
    first or last (closed syncmers): a choice by the run alone, so that words around it don't matter,
    and one of any ``w`` neighbouring runs is chosen."""
    h, at = words.shingles(k)
    if not len(h):
        return h, at
    short, where = words.shingles(k - w)
    first = np.searchsorted(where, at)  # a text's short runs are neighbours
    inner = short[first + 1]
    for j in range(2, w):
        inner = np.minimum(inner, short[first + j])
    picked = np.minimum(short[first], short[first + w]) <= inner
    # a word said many times in a row is told apart by its place in that row, so that such runs align
    n = np.arange(len(words.hash))
    same = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])])
    place = n - np.maximum.accumulate(np.where(same, 0, n))
    h = mix(h ^ mix(place.astype(np.uint64))[at + k - 1])
    return h[picked], at[picked]


PACKED = "part int, least long, wide int, far int, seeds binary, docs binary, places binary"


def _narrow(values: np.ndarray, least: int) -> np.ndarray:
    """Unsigned values in as few bytes as hold the greatest, ``least`` or more."""
    top = int(values.max())
    return values.astype(f"u{next(n for n in (2, 4, 8) if n >= least and top < 1 << 8 * n)}")


def packed_seeds(docs: DataFrame) -> DataFrame:
    """All seeds of a few megabytes of text, packed by the first bits of the seed: twelve bytes or so each, where a row
    of its own takes forty. ``docs`` are what doc_ids exceed ``least`` by, in ``wide`` bytes each, ``places`` positions in ``far`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            h, at = minimizers(words)
            if not len(h):
                continue
            part = (h >> np.uint64(64 - PARTS)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part, row = part[order], words.row[at]
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            least = ids.min()
            lists = h, _narrow(ids.view(np.uint64) - least.view(np.uint64), 2)[row], _narrow(at - words.first[row], 2)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            n, bounds = len(begin), np.append(begin, len(part))
            columns = [pa.array(part[begin].astype(np.int32)), pa.array(np.full(n, least)), *(pa.array(np.full(n, c.itemsize, np.int32)) for c in lists[1:])]
            columns += [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])]) for c in lists]
            yield pa.record_batch(columns, [c.split()[0] for c in PACKED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Seeds, documents and positions of rows of ``packed_seeds``, in any order."""
    wide, far, found = batch.column("wide").to_numpy(), batch.column("far").to_numpy(), []
    for w, f in sorted(set(zip(wide.tolist(), far.tolist(), strict=True))):
        own = batch.filter(pa.array((wide == w) & (far == f)))
        seed, doc, pos = (np.frombuffer(b"".join(own.column(c).to_pylist()), kind) for c, kind in (("seeds", "u8"), ("docs", f"u{w}"), ("places", f"u{f}")))
        size = pc.binary_length(own.column("docs")).to_numpy() // w
        found.append((seed, (doc + np.repeat(own.column("least").to_numpy(), size).view(np.uint64)).view(np.int64), pos.astype(np.int32)))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _firsts(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each seed once, in order: its least document, the first position there, and the greatest of ``last``."""
    order = np.argsort(seed)
    seed, doc, pos = seed[order], doc[order], pos[order]
    begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    least = np.minimum.reduceat(doc, begin)
    there = doc == np.repeat(least, np.diff(np.append(begin, len(seed))))
    return seed[begin], least, np.minimum.reduceat(np.where(there, pos, np.iinfo(np.int32).max), begin), np.maximum.reduceat(last[order], begin)


def seed_links(docs: DataFrame) -> DataFrame:
    """``doc, anchor, pos, apos``: every occurrence of each seed that several documents have, with the first one; that
    one too, as a link with itself. Of different texts under one id, the first may be in either.

    Seeds are shuffled once. A task reads a part at a time and holds a part's seeds until it ends.
    """

    def links(chunks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        firsts = [_firsts(seed, doc, pos, doc) for seed, doc, pos in chunks]
        seeds, anchor, apos, last = firsts[0] if len(firsts) == 1 else _firsts(*map(np.concatenate, zip(*firsts, strict=True)))
        several = anchor != last
        seeds, anchor, apos = seeds[several], anchor[several], apos[several]
        for seed, doc, pos in chunks if len(seeds) else []:
            at = np.minimum(np.searchsorted(seeds, seed), len(seeds) - 1)
            hit = seeds[at] == seed
            at = at[hit]
            yield pa.record_batch([pa.array(c) for c in (doc[hit], anchor[at], pos[hit], apos[at])], ["doc", "anchor", "pos", "apos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_part = [], -1  # chunks of one part that may go on
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for low, high in zip(edges, [*edges[1:], len(part)], strict=True):
                if part[low] != open_part and held:
                    yield from links(held)
                    held = []
                open_part = part[low]
                held.append(_unpacked(batch.slice(low, high - low)))
        if held:
            yield from links(held)

    return packed_seeds(docs).repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc long, anchor long, pos int, apos int")


def chain(s1: np.ndarray, s2: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Collinear chains of blocks (starts in both texts, and lengths), best first, no block twice.

    A chain's score is the words of its blocks less GAP_COST for each word between them on either
    side. The best predecessor of a block ends before it in both texts: blocks are
    entered into a Fenwick tree by their end in the second text once they end in the first.
    """
    m = len(s1)
    e1, e2 = s1 + n, s2 + n
    rank = {int(v): i + 1 for i, v in enumerate(np.unique(e2))}
    ends = np.array(sorted(rank))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, back = n.astype(float), np.full(m, -1)
    enter, waiting = np.argsort(e1, kind="stable"), 0
    ended = e1[enter]
    for j in np.lexsort((s2, s1)):
        while waiting < m and e1[enter[waiting]] <= s1[j]:
            i = int(enter[waiting])
            value, at = (score[i] + GAP_COST * (e1[i] + e2[i]), i), rank[int(e2[i])]
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
            waiting += 1
        at, found = int(np.searchsorted(ends, s2[j], "right")), (-np.inf, -1)
        while at:
            found = max(found, tree[at])
            at -= at & -at
        gain = found[0] - GAP_COST * (s1[j] + s2[j])
        i = found[1]
        if i >= 0 and gain > 0 and max(s1[j] - e1[i], s2[j] - e2[i]) > GAP:
            # the best one is too far away: the best of those that ended lately
            near = enter[int(np.searchsorted(ended, s1[j] - GAP)) : waiting]
            near = near[(e2[near] <= s2[j]) & (e2[near] >= s2[j] - GAP)]
            i = int(near[np.argmax(score[near] + GAP_COST * (e1[near] + e2[near]))]) if len(near) else -1
            gain = score[i] + GAP_COST * (e1[i] + e2[i] - s1[j] - s2[j])
        if i >= 0 and gain > 0:
            score[j] += gain
            back[j] = i
    out, used = [], np.zeros(m, bool)
    for j in np.argsort(-score, kind="stable"):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(int(j))
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def common(x: list, y: list) -> int:
    """Length of a longest common subsequence, by the furthest-reaching diagonals of O(ND) comparison."""
    n, m = len(x), len(y)
    if not n or not m:
        return 0
    far = {1: 0}
    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            i = far.get(k + 1, -1) if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            far[k] = i
            if i >= n and j >= m:
                return (n + m - d) // 2
    return 0


def blocks_of(doc: np.ndarray, anchor: np.ndarray, pos: np.ndarray, apos: np.ndarray, n: int = SEED):
    """Seeds of ``n`` words of each pair that follow each other on one diagonal, joined: pair starts, and blocks."""
    diagonal = pos - apos
    order = np.lexsort((pos, diagonal, anchor, doc))
    doc, anchor, pos, apos, diagonal = (c[order] for c in (doc, anchor, pos, apos, diagonal))
    pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])
    new = pair.copy()
    new[1:] |= (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > n)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(pos)) - 1
    length = pos[end] - pos[at] + n
    return doc[at], anchor[at], pos[at], apos[at], length, np.flatnonzero(pair[at])


def mixed(doc: np.ndarray, anchor: np.ndarray, pos: np.ndarray, apos: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(doc, from, to)`` in words: where a run of ``least`` words could lie all of whose seeds repeat, but which is not
    covered by seeds of one anchor and diagonal. Neighbouring seeds are WINDOW words apart at most, so a run
    begins and ends less than that beyond its own seeds."""
    order = np.lexsort((pos, doc))
    doc, anchor, pos, diagonal = doc[order], anchor[order], pos[order], (pos - apos)[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > WINDOW)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1
    low, high = np.maximum(pos[at] - WINDOW + 1, 0), pos[last] + SEED + WINDOW - 1
    run = np.cumsum(new) - 1
    turn = np.flatnonzero(~new[1:] & ((anchor[1:] != anchor[:-1]) | (diagonal[1:] != diagonal[:-1])))
    # runs of words that neither end with the seeds before an edge nor begin with those after it
    f = np.concatenate([low, pos[turn] + SEED + 1 - least, pos[last] + SEED + 1 - least])
    t = np.concatenate([pos[at] - 1 + least, pos[turn + 1] - 1 + least, high])
    of = np.concatenate([np.arange(len(at)), run[turn], np.arange(len(at))])
    f, t = np.maximum(f, low[of]), np.minimum(t, high[of])
    order = np.lexsort((f, of))
    out: list[tuple[int, int, int]] = []
    for i in order[(t - f)[order] >= least].tolist():
        name = int(doc[at[of[i]]])
        if out and out[-1][0] == name and f[i] <= out[-1][2]:
            out[-1] = (name, out[-1][1], max(int(t[i]), out[-1][2]))
        else:
            out.append((name, int(f[i]), int(t[i])))
    return out


CHAINS = "doc long, anchor long, f1 int, t1 int, f2 int, t2 int, blocks array<int>"


def _chains(n: int, search: int):
    """Chains of links by seeds of ``n`` words, sorted by document. If ``search`` is not 0, links of a document
    with itself mark its own first occurrences, and rows with a null anchor say where ``mixed`` runs of that many words may lie."""

    def solve(columns: list[np.ndarray]):
        out = [(d, None, f, t, 0, 0, []) for d, f, t in mixed(*columns, search)] if search else []
        columns = [c[columns[0] != columns[1]] for c in columns]
        if not len(columns[0]):
            return out
        doc, anchor, s1, s2, size, starts = blocks_of(*columns, n)
        total = np.add.reduceat(size, starts)
        for p, (low, high) in enumerate(zip(starts, np.append(starts[1:], len(doc)), strict=True)):
            if total[p] < LEAST:
                continue
            a, b, m = s1[low:high], s2[low:high], size[low:high]
            for path in chain(a, b, m):
                first, last = path[0], path[-1]
                flat = [int(v) for i in path for v in (a[i], b[i], m[i])]
                f1, f2, t1, t2 = int(a[first]), int(b[first]), int(a[last] + m[last]), int(b[last] + m[last])
                if sum(flat[2::3]) >= LEAST:
                    low_, high_ = (lambda v: max(0, v - REACH) // GRID * GRID), (lambda v: -(-(v + REACH) // GRID) * GRID)
                    out.append((int(doc[low]), int(anchor[low]), low_(f1), high_(t1), low_(f2), high_(t2), flat))
        return out

    def batch_of(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in CHAINS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "anchor", "pos", "apos")]
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last document may go on
            held = [c[whole:] for c in columns]
            if whole and (rows := solve([c[:whole] for c in columns])):
                yield batch_of(rows)
        if held and len(held[0]) and (rows := solve(held)):
            yield batch_of(rows)

    return run


def _with_spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, text, spans`` of the documents in ``wanted(doc, f, t)``."""
    lists = cut(wanted.groupBy("doc").agg(F.collect_set(F.struct("f", "t")).alias("spans")), "wanted")
    size = lists.agg(F.sum(F.size("spans") * 32 + 64)).first()[0] or 0
    if size <= SMALL:
        lists = F.broadcast(lists)
    return docs.join(lists, docs["doc_id"] == lists["doc"]).select("doc", "text", "spans")


def _long_seeds(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``seed, doc, pos`` of all runs of ``n`` words from f to t of each document in ``wanted(doc, f, t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = Words(batch.column("text"))
            h, at = words.shingles(n)
            for i, (doc, spans) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                low = int(words.first[i])
                for x in spans:
                    a, b = np.searchsorted(at, [low + x["f"], min(low + x["t"], int(words.first[i + 1])) - n + 1])
                    if a < b:
                        yield pa.record_batch([pa.array(h[a:b].view(np.int64)), pa.array(np.full(b - a, doc)), pa.array((at[a:b] - low).astype(np.int32))], ["seed", "doc", "pos"])

    return _with_spans(docs, wanted).mapInArrow(run, "seed long, doc long, pos int")


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, f, t, words``: hashes of the words from f to t of each document in ``wanted(doc, f, t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = Words(batch.column("text"))
            rows = []
            for i, (doc, spans) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                own = words.hash[words.first[i] : words.first[i + 1]].view(np.int64)
                rows += [(doc, s["f"], s["t"], own[s["f"] : s["t"]]) for s in spans]
            if rows:
                d, f, t, w = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(d, pa.int64()), pa.array(f, pa.int32()), pa.array(t, pa.int32()), pa.array(w, pa.list_(pa.int64()))], ["doc", "f", "t", "words"])

    return _with_spans(docs, wanted).mapInArrow(run, "doc long, f int, t int, words array<long>")


def _first_runs(runs: DataFrame) -> DataFrame:
    """``seed, anchor, apos``: the first occurrence of each run that several documents have."""
    first = runs.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("a"), F.max("doc").alias("z")).filter("a.doc <> z")
    # written first: an aggregate that feeds the join directly would keep a frequent run's rows from being split
    return cut(first.select("seed", F.col("a.doc").alias("anchor"), F.col("a.pos").alias("apos")), "anchors")


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces (start, end) of a document that touch, as one each."""
    order = Window.partitionBy("doc").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner"))


PIECES = "doc long, start int, end int, partner long"


def beyond(x: list, y: list) -> list[tuple[int, int, int, int]]:
    """Ways to go on from the starts of two texts past changed words: (equal words less changes,
    words of x, words of y, equal words), best first, each ending in equal words.

    Furthest-reaching diagonals by the number of changes: a word replaced, left out or put in. No more
    words can be equal than either text has of the other's, and changes beyond that lead nowhere.
    """
    n, m = len(x), len(y)
    most = min(sum(map(set(y).__contains__, x)), sum(map(set(x).__contains__, y)))
    far, out, best, d = {0: (0, 0)}, [(0, 0, 0, 0)], 0, 0
    while far and d <= most:
        top = -DROP - 1
        for k, (i, same) in far.items():
            begin = same
            while i < n and i - k < m and x[i] == y[i - k]:
                i, same = i + 1, same + 1
            far[k] = i, same
            if same > begin:
                out.append((same - d, i, i - k, same))
            top = max(top, same - d)
        best, d = max(best, top), d + 1
        if top < best - DROP:
            break
        new: dict[int, tuple[int, int]] = {}
        for k, (i, same) in far.items():
            for to, at in ((k, i + 1), (k + 1, i + 1), (k - 1, i)):
                if at <= n and 0 <= at - to <= m:
                    new[to] = max(new.get(to, (-1, 0)), (at, same))
        far = new
    return sorted((o for o in out if o[0] >= 0), reverse=True)


def aligned(x: list, y: list, blocks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Bounds in both texts of the parts of a chain of blocks (starts in both, and lengths) that are alike to IDENTITY.

    A part that isn't is split at its gap of most unequal words and each side is judged alone, down
    to single blocks, so no run of equal words is lost with its surroundings.
    """
    a1, a2, n = (c.tolist() for c in blocks.T)
    equal = [common(x[a1[i] + n[i] : a1[i + 1]], y[a2[i] + n[i] : a2[i + 1]]) for i in range(len(n) - 1)]
    loss = np.array([max(a1[i + 1] - a1[i], a2[i + 1] - a2[i]) - n[i] - equal[i] for i in range(len(n) - 1)])
    before = np.cumsum([0, *(a + b for a, b in zip(n, [*equal, 0], strict=True))])
    parts = [(0, len(n) - 1)]
    while parts:
        low, high = parts.pop()
        same = int(before[high] - before[low]) + n[high]
        s1, s2, e1, e2 = a1[low], a2[low], a1[high] + n[high], a2[high] + n[high]
        while 0 < s1 <= len(x) and 0 < s2 <= len(y) and x[s1 - 1] == y[s2 - 1]:
            s1, s2, same = s1 - 1, s2 - 1, same + 1
        while e1 < len(x) and e2 < len(y) and x[e1] == y[e2]:
            e1, e2, same = e1 + 1, e2 + 1, same + 1
        if same >= IDENTITY * max(e1 - s1, e2 - s2):
            alike = lambda i, j, more: same + more >= IDENTITY * max(e1 - s1 + i, e2 - s2 + j)
            _, i, j, more = next(o for o in beyond(x[e1 : e1 + REACH], y[e2 : e2 + REACH]) if alike(*o[1:]))
            e1, e2, same = e1 + i, e2 + j, same + more
            left = x[max(0, s1 - REACH) : max(0, s1)][::-1], y[max(0, s2 - REACH) : max(0, s2)][::-1]
            _, i, j, more = next(o for o in beyond(*left) if alike(*o[1:]))
            yield s1 - i, s2 - j, e1, e2
        elif low < high:
            worst = low + int(loss[low:high].argmax())
            parts += [(low, worst), (worst + 1, high)]


def _align(least: int):
    """Both sides of every part of a chain that aligns over ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = {}
            for c in ("x", "y", "blocks"):  # slices of one array; a list of Arrow scalars is far slower
                own, offsets = batch.column(c), batch.column(c).offsets.to_numpy()
                lists[c] = own.flatten().to_numpy(zero_copy_only=False), (offsets - offsets[0]).tolist()
            take = lambda c, i, lists=lists: lists[c][0][lists[c][1][i] : lists[c][1][i + 1]]
            for i, r in enumerate(batch.select(["doc", "anchor", "f1", "f2"]).to_pylist()):
                f1, f2, x, y = r["f1"], r["f2"], take("x", i).tolist(), take("y", i).tolist()
                one, two = set(x), set(y)
                # a part lies within x and y: it has no more equal words than either has of the other's
                if min(sum(map(two.__contains__, x)), sum(map(one.__contains__, y))) < IDENTITY * least:
                    continue
                for s1, s2, e1, e2 in aligned(x, y, take("blocks", i).astype(np.int64).reshape(-1, 3) - [f1, f2, 0]):
                    if min(e1 - s1, e2 - s2) >= least:
                        out.append((r["doc"], s1 + f1, e1 + f1, r["anchor"]))
                        out.append((r["anchor"], s2 + f2, e2 + f2, r["doc"]))
            if out:
                cols = zip(*out, strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return run


def _word_count(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), hashes=False)
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(words.first).astype(np.int32))], ["doc_id", "digest", "n"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, n int")


def repeated_passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """``doc_id, start, end, partner``: passages, in words from start to end (exclusive), of at least
    ``least`` words that some other document has too; partner is the least such document found.
    Passages of a document that touch are one row, which is longer than what any one partner has.

    Words are letters and digits, case folded. Documents of one and the same
    text are one to the search: the least doc_id of them stands for all, and
    each of them has one passage, its whole text. A passage that repeats only
    within its own document is none. Null and empty texts and rows with a null
    doc_id have no passages. Rows that repeat a doc_id count as one if
    their texts are equal; different texts under one id are searched each, and
    the id's passages are those of all of them. A word said many times in a row
    is aligned from where that row starts, so the longer of two such rows is
    covered as far as the shorter goes. Empty tables give no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rows = rows.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    every = cut(_word_count(rows), "sizes")
    sizes = cut(every.distinct(), "texts")
    if every.count() != sizes.count():
        rows = rows.dropDuplicates(["doc_id", "digest"])
    firsts = sizes.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("doc_id").alias("last"), F.min("n").alias("n"))
    firsts = cut(firsts, "classes")
    # all texts but the first of each class are left out of the search
    others = cut(sizes.join(firsts.filter("copies > 1").select("digest", "first"), "digest").filter("doc_id <> first").select(F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_digest")), "others")
    if others.count() <= SMALL:
        others = F.broadcast(others)
    single = rows.join(others, (F.col("doc_id") == F.col("drop_id")) & (F.col("digest") == F.col("drop_digest")), "left_anti").select("doc_id", "text")
    first = cut(seed_links(single).repartition("doc").sortWithinPartitions("doc").mapInArrow(_chains(SEED, least), CHAINS), "chains")
    runs = cut(_long_seeds(single, first.filter("anchor IS NULL").select("doc", F.col("f1").alias("f"), F.col("t1").alias("t")), least), "runs")
    links = runs.join(_first_runs(runs), "seed").filter("doc <> anchor").select("doc", "anchor", "pos", "apos")
    second = links.repartition("doc").sortWithinPartitions("doc").mapInArrow(_chains(least, 0), CHAINS)
    chains = cut(first.filter("anchor IS NOT NULL").union(second).dropDuplicates(["doc", "anchor", "f1", "t1", "f2", "t2", "blocks"]), "chains")
    ends = chains.select(F.col("doc").alias("doc"), F.col("f1").alias("f"), F.col("t1").alias("t")).union(chains.select("anchor", "f2", "t2")).distinct()
    parts = cut(_slices(single, ends), "slices")
    own = parts.select(F.col("doc"), F.col("f").alias("f1"), F.col("t").alias("t1"), F.col("words").alias("x"))
    theirs = parts.select(F.col("doc").alias("anchor"), F.col("f").alias("f2"), F.col("t").alias("t2"), F.col("words").alias("y"))
    pieces = chains.join(own, ["doc", "f1", "t1"]).join(theirs, ["anchor", "f2", "t2"]).select("doc", "anchor", "f1", "f2", "blocks", "x", "y").mapInArrow(_align(least), PIECES)
    several = sizes.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    classes = firsts.filter((F.col("copies") > 1) & (F.col("n") >= least))
    copies = sizes.select("doc_id", "digest").join(classes, "digest")
    copies = copies.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("partner"))
    # an id's copy among other texts is a piece like those of the others; at most a row for each word of a document
    pieces = pieces.union(copies.join(several, "doc_id", "left_semi"))
    merged = _joined(cut(pieces.groupBy("doc", "start").agg(F.max("end").alias("end"), F.min("partner").alias("partner")), "pieces"))
    copies = copies.join(several, "doc_id", "left_anti")
    alone = merged.join(copies.select(F.col("doc_id").alias("doc")), "doc", "left_anti")
    return alone.select(F.col("doc").alias("doc_id"), "start", "end", "partner").union(copies)


def op6_substring(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
