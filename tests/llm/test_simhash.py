import random
from itertools import combinations

from xxhash import xxh64_intdigest

from nearsieve.llm import nearcopies, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair_within_the_radius():
    masks, r = simhash.covering_masks(3, 9), random.Random(2)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)


def test_classes_equal_brute_force(spark, documents, prose):
    base = prose(300, 1).split()
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "two words"), (7, prose(9000, 5))]
    for i in range(40):
        copy = list(base)
        for k in range(i % 4):
            copy[(37 * i + 11 * k) % 300] = "changed"
        rows.append((100 - i, " ".join(copy)))
    rows += [(200 + i, prose(60, i)) for i in range(40)] + [(200, prose(60, 0)), (None, prose(60, 1))]
    found = simhash.near_classes(documents(rows)).collect()
    assert len(found) == len(rows)
    texts = [t for _, t in rows]
    roots = plain_classes([plain_fingerprint(t) for t in texts], 3)
    least = {}
    for (i, _), c in zip(rows, roots, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, plain_fingerprint(t), least[c]) for (i, t), c in zip(rows, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == want


def test_large_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(80)} | {r.getrandbits(64) for _ in range(20)})
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    root = {x: x for x, in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in [(e.a, e.b) for e in edges]:
        root[find(a)] = find(b)
    plain = plain_classes(fps, 3)
    for (i, (x,)), (j, (y,)) in combinations(enumerate(signed), 2):
        assert (find(x) == find(y)) == (plain[i] == plain[j])


def test_empty_table_and_kept_documents(spark, documents, prose):
    assert simhash.near_classes(documents([])).count() == 0
    docs = documents([(3, prose(50, 1)), (2, prose(50, 1)), (9, prose(50, 2)), (None, prose(50, 1))])
    kept = nearcopies.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9]
