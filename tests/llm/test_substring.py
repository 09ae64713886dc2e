import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from nearsieve.llm import substring
from nearsieve.llm.words import Words


def exact_windows(rows, n=50):
    """(doc, start) of every run of n words that another document has too."""
    where = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), set()).add((i, p))
    return [x for v in where.values() if len({i for i, _ in v}) > 1 for x in v]


def test_chain_equals_quadratic_search():
    r = random.Random(1)
    for turn in range(60):
        m = r.randint(1, 25)
        far = 90 if turn % 2 else 200
        s1, s2 = np.array([r.randint(0, far) for _ in range(m)]), np.array([r.randint(0, far) for _ in range(m)])
        n = np.array([r.randint(8, 14) for _ in range(m)])
        score = [float(x) for x in n]
        for j in np.lexsort((s2, s1)):
            gaps = [(s1[j] - s1[i] - n[i], s2[j] - s2[i] - n[i], i) for i in range(m)]
            score[j] += max([0, *(score[i] - substring.GAP_COST * (a + b) for a, b, i in gaps if 0 <= a <= substring.GAP and 0 <= b <= substring.GAP)])
        found = substring.chain(s1, s2, n)
        assert sorted(i for p in found for i in p) == list(range(m))
        top = found[0]
        total = sum(n[i] for i in top) - sum(substring.GAP_COST * (s1[b] + s2[b] - s1[a] - s2[a] - 2 * n[a]) for a, b in zip(top, top[1:], strict=False))
        assert abs(total - max(score)) < 1e-9
        for a, b in zip(top, top[1:], strict=False):
            assert s1[b] >= s1[a] + n[a] and s2[b] >= s2[a] + n[a]


def test_a_nearer_block_is_chained_if_the_best_is_too_far():
    s1, s2, n = np.array([0, 120, 150]), np.array([0, 400, 430]), np.array([90, 8, 8])
    assert [1, 2] in substring.chain(s1, s2, n)


def test_common_is_the_longest_subsequence():
    r = random.Random(2)
    for _ in range(200):
        x, y = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        want = max(k for k in range(min(len(x), len(y)) + 1) if {c for c in combinations(x, k)} & {c for c in combinations(y, k)})
        assert substring.common(x, y) == want


def test_minimizers_meet_in_equal_runs(prose):
    shared = prose(substring.SEED + substring.WINDOW - 1, 5)
    words = Words(pa.array([prose(40, i) + " " + shared + " " + prose(40, i + 50) for i in range(6)] + [shared, "a b", ""]))
    h, at = substring.minimizers(words)
    assert set.intersection(*({int(x) for x in h[words.row[at] == i]} for i in range(7)))


def found_in(texts, module=substring):
    """(document, start, end) of the passages of a few texts, by the operator's own steps."""
    words = Words(pa.array(texts))
    h, at = module.minimizers(words)
    first, links = {}, []
    for x, i in sorted(zip(h.tolist(), at.tolist(), strict=True), key=lambda v: v[1]):
        doc, pos = int(words.row[i]), int(i - words.first[words.row[i]])
        a, q = first.setdefault(x, (doc, pos))
        if a != doc:
            links.append((doc, a, pos, q))
    links.sort(key=lambda v: v[0])
    covered = [np.zeros(k + 1, bool) for k in np.diff(words.first)]
    if links:
        cols = [pa.array(c) for c in zip(*links, strict=True)]
        for batch in module._chains(module.SEED, 0)(iter([pa.record_batch(cols, ["doc", "anchor", "pos", "apos"])])):
            rows = batch.to_pylist()
            for r in rows:
                for side, doc, f, t in (("x", r["doc"], r["f1"], r["t1"]), ("y", r["anchor"], r["f2"], r["t2"])):
                    own = words.hash[words.first[doc] : words.first[doc + 1]]
                    r[side] = own[f:t].view(np.int64).tolist()
            for part in module._align(module.PASSAGE)(iter([pa.RecordBatch.from_pylist(rows)])):
                for r in part.to_pylist():
                    covered[r["doc"]][r["start"] : r["end"]] = True
    out = []
    for i, c in enumerate(covered):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], c]).astype(int)))
        out += [(i, int(s), int(e)) for s, e in edges.reshape(-1, 2) if e - s >= substring.PASSAGE]
    return out


def test_exact_runs_survive_a_chain_that_is_not_alike(prose):
    one, two, line = prose(55, 910), prose(55, 911), prose(20, 912)
    found = found_in([f"{prose(40, 913)} {one} {prose(30, 914)} {two} {prose(9, 915)}", f"{prose(12, 916)} {one} {two} {prose(40, 917)}"])
    assert [(i, s) for i, s, _ in found] == [(0, 40), (0, 125), (1, 12)] and [e for _, _, e in found] == [95, 180, 122]
    found = found_in([f"{prose(30, 918)} {line} {prose(25, 919)} {two} {two[:5]}x {prose(30, 920)}", f"{prose(50, 921)} {line} {two} {prose(30, 922)}"])
    assert any(i == 0 and s <= 75 and e >= 130 for i, s, e in found) and any(i == 1 and s <= 70 and e >= 125 for i, s, e in found)


def test_changes_every_few_words_leave_seeds(prose):
    for every in (7, 8, 10):
        passage = prose(100, 930).split()
        changed = [w if i % every != every - 1 else f"new{i}" for i, w in enumerate(passage)]
        found = found_in([f"{prose(40, 931)} {' '.join(passage)} {prose(30, 932)}", f"{prose(25, 933)} {' '.join(changed)} {prose(30, 934)}"])
        assert [i for i, _, _ in found] == [0, 1] and all(e - s >= 85 for _, s, e in found)


def test_ends_go_on_past_changed_words(prose):
    for at in ((3, 52), (4, 5, 51), (2, 48), (5, 28, 50)):
        passage = prose(56, 940).split()
        changed = [f"new{i}" if i in at else w for i, w in enumerate(passage)]
        found = found_in([f"{prose(40, 941)} {' '.join(passage)} {prose(30, 942)}", f"{prose(25, 943)} {' '.join(changed)} {prose(30, 944)}"])
        assert found == [(0, 40, 96), (1, 25, 81)]
    passage = prose(60, 945).split()
    shifted = [*passage[:4], *passage[5:54], "put", "in", *passage[54:]]
    assert found_in([f"{prose(40, 946)} {' '.join(passage)} {prose(30, 947)}", f"{prose(25, 948)} {' '.join(shifted)} {prose(30, 949)}"]) == [(0, 40, 100), (1, 25, 86)]


def test_seeds_are_shuffled_once_and_packed(spark, documents, prose):
    shared = prose(40, 900)
    rows = [(i, prose(120, i) + (" " + shared if i % 7 == 0 else "")) for i in range(300)]
    rows += [(-(1 << 62), shared), ((1 << 62) + 5, "x " * 70_000 + shared), (3, shared + " " + shared), (301, ""), (302, None)]
    docs = documents(rows).select("doc_id", "text").repartition(3)
    every = {}
    for i, t in rows:
        h, at = substring.minimizers(Words(pa.array([t], pa.string())))
        for x, p in zip(h.tolist(), at.tolist(), strict=True):
            every.setdefault(x, []).append((i, p))
    expected = sorted((d, *min(v)[:1], p, min(v)[1]) for v in every.values() if len({d for d, _ in v}) > 1 for d, p in v)
    found = substring.seed_links(docs)
    assert sorted(map(tuple, found.collect())) == expected
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Repartition") == 2  # that of the seeds, and this test's own
    near = documents(rows[:300]).select("doc_id", "text").coalesce(1)
    size = substring.packed_seeds(near).selectExpr("sum(length(seeds))", "sum(length(seeds) + length(docs) + length(places))").first()
    assert size[1] == size[0] / 8 * 12
    assert substring.seed_links(docs.limit(0)).count() == 0


def test_passages(spark, documents, prose):
    passage, other = prose(70, 900), prose(60, 901)
    fuzzy = passage.split()
    fuzzy[20], fuzzy[45] = "changed", "words"
    rows = [(i, prose(200, i)) for i in range(1, 12)]
    rows += [(20 + i, prose(40 + i, 100 + i) + " " + passage + " " + prose(30, 200 + i)) for i in range(6)]
    rows += [(30, prose(90, 300) + " " + " ".join(fuzzy) + " " + prose(20, 301)), (31, other + " " + prose(50, 302)), (32, prose(50, 303) + " " + other.upper().replace(" ", ", "))]
    rows += [(40, prose(80, 400)), (41, prose(80, 400)), (42, prose(80, 400)), (43, prose(20, 401)), (44, prose(20, 401))]
    rows += [(50, prose(20, 500) + " " + prose(60, 501) + " x " + prose(60, 501)), (60, None), (61, ""), (None, passage), (21, rows[12][1])]
    found = {}
    for r in substring.repeated_passages(documents(rows)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.partner))
    assert sorted(found) == [20, 21, 22, 23, 24, 25, 30, 31, 32, 40, 41, 42]
    for i in range(6):
        (s, e, _), = found[20 + i]
        assert abs(s - 40 - i) <= 2 and abs(e - 110 - i) <= 2
    assert abs(found[30][0][0] - 90) <= 2 and abs(found[30][0][1] - 160) <= 2
    assert found[31][0] == (0, 60, 32) and found[32][0] == (50, 110, 31)
    assert found[40] == [(0, 80, 42)] and found[41] == [(0, 80, 40)]
    texts = {i: t for i, t in rows if i is not None and i != 50}
    for i, p in exact_windows(texts.items()):
        assert any(s <= p and p + 50 <= e for s, e, _ in found[i])
    assert substring.repeated_passages(documents([])).count() == 0


def test_a_passage_whose_bits_others_have(spark, documents, prose):
    """Every seed of the shared passage leads to a document that has only a few words of it."""
    shared = prose(64, 980).split()
    bits = [(i, f"{prose(30, 1000 + i)} {' '.join(shared[6 * i : 6 * i + 11])} {prose(30, 1100 + i)}") for i in range(10)]
    between = [(501 + i, f"{prose(30, 1200 + i)} {' '.join(shared[6 * i : 6 * i + 30])} {prose(30, 1300 + i)}") for i in range(6)]
    for more in ([], between):
        rows = [*bits, *more, (500, f"{prose(50, 981)} {' '.join(shared)} {prose(20, 982)}"), (600, f"{prose(70, 983)} {' '.join(shared)}"), (600, f"{prose(70, 983)} {' '.join(shared)}")]
        found = sorted(map(tuple, substring.repeated_passages(documents(rows)).collect()))
        assert [r[0] for r in found] == [500, 600] and [r[3] for r in found] == [600, 500]
        assert abs(found[0][1] - 50) <= 2 and abs(found[0][2] - 114) <= 2 and abs(found[1][1] - 70) <= 2 and abs(found[1][2] - 134) <= 2


def test_pieces_of_different_partners_make_no_passage(spark, documents, prose):
    one, two = prose(30, 990), prose(30, 991)
    rows = [(1, f"{prose(40, 992)} {one} {prose(40, 993)}"), (2, f"{prose(40, 994)} {two} {prose(40, 995)}"), (3, f"{prose(40, 996)} {one} {two} {prose(40, 997)}")]
    assert substring.repeated_passages(documents(rows)).count() == 0


def test_every_exact_run_is_covered_and_every_passage_is_shared(spark, documents, prose):
    r, pool = random.Random(4), [prose(90, 1400 + i).split() for i in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randint(1, 4)):
            text += prose(r.randint(10, 40), 1500 + 10 * i + len(text)).split()
            p = r.choice(pool)
            low = r.randint(0, 60)
            text += p[low : low + r.randint(5, 90)]
        rows.append((i, " ".join(text)))
    found = [tuple(x) for x in substring.repeated_passages(documents(rows)).collect()]
    own = {}
    for i, s, e, _ in found:
        own.setdefault(i, []).append((s, e))
    for i, p in exact_windows(rows):
        assert any(s <= p and p + 50 <= e for s, e in own.get(i, []))
    words = {i: t.split() for i, t in rows}
    runs = {}  # which documents have a run of five words
    for i, w in words.items():
        for p in range(len(w) - 4):
            runs.setdefault(tuple(w[p : p + 5]), set()).add(i)
    for i, s, e, partner in found:  # the partner has most of some 50 words of the passage
        near = [partner in runs[tuple(words[i][p : p + 5])] for p in range(s, e - 4)]
        assert e - s >= 50 and max(sum(near[p : p + 46]) for p in range(max(1, len(near) - 45))) >= 30


def test_an_id_of_several_texts_is_searched_by_each(spark, documents, prose):
    copy, shared = prose(80, 1008), prose(60, 951)  # the copy has the least digest
    rows = [(3, copy), (7, copy), (9, copy), (20, f"{prose(100, 952)} {shared}")]
    rows += [(i, f"{prose(120 + i, 960 + i)} {shared} {prose(10, 970 + i)}") for i in (3, 7)]
    found = sorted(map(tuple, substring.repeated_passages(documents(rows)).collect()))
    assert [r[:3] for r in found] == [(3, 0, 80), (3, 123, 183), (7, 0, 80), (7, 127, 187), (9, 0, 80), (20, 100, 160)]
