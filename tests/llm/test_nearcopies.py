import random

import pytest

from nearsieve.llm import nearcopies, simhash


def test_near_copies_beyond_three_bits_are_dropped(spark, documents, prose):
    def changed(text, *at):
        return " ".join(f"new{i}" if i in at else w for i, w in enumerate(text.split()))

    base, other = prose(200, 1), prose(300, 2)
    rows = [(i, prose(100 + i, 10 + i)) for i in range(20)]
    near = [(30, base), (31, changed(base, 40, 90, 150)), (32, changed(base, 1, 60)), (33, other), (34, changed(other, 30, 150, 280)), (35, base.upper())]
    far = [(40, changed(base, *range(5, 200, 20))), (41, "a b"), (None, base), (42, None)]
    sets = {i: {tuple(t.lower().split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in near + far if t}
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert min(jaccard(30, 31), jaccard(30, 32), jaccard(33, 34)) >= 0.8 > max(jaccard(i, 40) for i in (30, 31, 32))
    assert any((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3 for a, b in ((base, near[1][1]), (base, near[2][1]), (other, near[4][1])))
    kept = [r.doc_id for r in nearcopies.drop_near_copies(documents(rows + near + far)).collect()]
    assert sorted(kept, key=lambda i: (i is None, i)) == [*range(20), 30, 33, 40, 41, 42]


def test_rows_are_judged_by_their_texts(spark, documents, prose):
    a, b, c = prose(80, 50), prose(90, 51), prose(70, 52)
    rows = [(1, a), (1, a), (5, a), (5, b), (None, a), (7, c), (7, c), (7, c), (None, prose(60, 53)), (None, prose(60, 53)), (9, ""), (8, None), (None, " ")]
    kept = sorted(((r.doc_id, r.text) for r in nearcopies.drop_near_copies(documents(rows)).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (7, c), (None, prose(60, 53)), (8, None)], key=str)
    assert nearcopies.drop_near_copies(documents([])).count() == 0


def classes(texts):
    """The least id of each class, by all pairs."""
    sets = {i: {tuple(t.lower().split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in [j for j in texts if j < i]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root |= {k: low for k in root if root[k] == high}
    return sorted(set(root.values()))


@pytest.mark.parametrize(("changes", "first", "least"), [(4, 4, 20), (2, 6, 0)])
def test_groups_that_no_star_joins_make_few_pairs(spark, documents, prose, monkeypatch, changes, first, least):
    """Copies of a text that are not near each other, and such as are near each other but not the one of least id."""
    s, base, made = random.Random(changes), prose(200, 70).split(), []

    def changed(i, n):
        at = {s.randrange(k * 200 // n, (k + 1) * 200 // n - 4) for k in range(n)}
        return " ".join(f"new{i}x{p}" if p in at else w for p, w in enumerate(base))

    def counted(df, label, cut=nearcopies.cut):
        out = cut(df, label)
        made.extend([out.count()] if label == "more" else [])
        return out

    texts = {i: changed(i, changes if i else first) for i in range(60)}
    texts |= {100 + i: " ".join("other" + str(i) if p == 3 + i else w for p, w in enumerate(texts[5 + i].split())) for i in range(5)}  # links of their own
    monkeypatch.setattr(nearcopies, "cut", counted)
    kept = sorted(r.doc_id for r in nearcopies.drop_near_copies(documents(list(texts.items()))).collect())
    assert kept == classes(texts) and len(kept) >= least
    assert sum(made) <= len(texts)


def test_parity_bounds_the_difference():
    import numpy as np

    r = np.random.default_rng(5)
    for n, new in ((1, 1), (150, 20), (3000, 400)):
        a = r.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[new:], r.integers(0, 1 << 63, new, np.uint64)])
        x, y = nearcopies._parity(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2).reshape(2, -1)
        assert 0 < int(np.bitwise_count(x ^ y).sum()) <= 2 * new or new == n
