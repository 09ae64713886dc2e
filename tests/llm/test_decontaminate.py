import math

from nearsieve.llm import decontaminate


def plain(docs, items):
    def runs(t):
        w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    return sorted(((i, k, len(runs(t) & runs(q)), len(runs(q))) for i, t in docs for k, q in items if runs(q) and len(runs(t) & runs(q)) >= math.ceil(0.8 * len(runs(q)) - 1e-9)), key=str)


def test_finds_what_brute_force_finds(spark, documents, prose, monkeypatch):
    items = [(1, prose(30, 1)), (2, prose(60, 2)), (3, prose(7, 3)), (4, "too short here"), (5, None), (6, ""), (7, prose(30, 1)), (None, prose(12, 9)), (8, "one two three four five")]
    near = prose(60, 2).split()
    near[30] = "other"
    far = prose(60, 2).split()
    far[10::9] = ["other"] * len(far[10::9])
    rows = [(10, prose(5000, 4) + " " + prose(30, 1).upper().replace(" ", "!! ") + " " + prose(5000, 5)), (11, " ".join(near)), (12, " ".join(far)), (13, None), (14, ""), (15, prose(12, 9)), (16, "One, two; three four FIVE."), (None, prose(7, 3)), (11, " ".join(near)), (17, prose(400, 6))]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = plain(rows, items)
    assert len(want) > 6
    for size in (decontaminate.BLOCK_BYTES, 200):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = decontaminate.contained_items(documents(rows), table).collect()
        assert sorted((tuple(r) for r in found), key=str) == want
    monkeypatch.undo()
    rows += [(11, prose(50, 7)), (None, prose(50, 8)), (12, "so 12 is here again")]  # clean rows of ids that have others
    kept = decontaminate.drop_contaminated(documents(rows), table)
    assert sorted(((r.doc_id, r.n_chars) for r in kept.collect()), key=str) == sorted(((i, None if t is None else len(t)) for i, t in rows if not plain([(i, t)], items)), key=str)
    assert decontaminate.contained_items(documents([]), table).count() == 0
    assert decontaminate.contained_items(documents(rows), table.limit(0)).count() == 0
