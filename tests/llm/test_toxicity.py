import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearsieve.llm import toxicity
from nearsieve.llm.gru import Network, distinct
from nearsieve.llm.words import Words

BAD = ["idiotic", "wretched", "scummy"]


@pytest.fixture(scope="module")
def corpus(prose):
    rows = []
    for i in range(500):
        words = prose(30 + 13 * i % 150, i).split()
        toxic = i % 4 == 0
        for k in range(3 if toxic else 0):
            words[(7 * i + 31 * k) % len(words)] = BAD[(i // 4 + k) % 3]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(corpus):
    seen = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return toxicity.fit([t for _, t, _ in seen], np.array([y for *_, y in seen]))


def test_gradients_equal_differences():
    words = Words(pa.array(["you are a b c d e", "nice day my friend of all"]))
    text, net = distinct(words, np.sort(np.unique(words.hash))[:6]), Network(6, 4, 3, 2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"] = np.random.default_rng(0).standard_normal(net.p["word"].shape)
    where, row = toxicity.cut_windows(words.first, 5, 3)
    y, none = (row == 0).astype(float), np.zeros(len(text.known), bool)
    _, g = net.gradients(text, where, y, none)
    for k in ("Uf", "Ub", "Wf", "cb", "A", "a", "v", "w", "o"):
        at, e = tuple(0 for _ in net.p[k].shape), 1e-3
        net.p[k][at] += e
        up = net.gradients(text, where, y, none)[0]
        net.p[k][at] -= 2 * e
        down = net.gradients(text, where, y, none)[0]
        net.p[k][at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5, k


def test_every_word_is_in_a_window():
    first = np.array([0, 0, 1, 33, 33 + 32, 65 + 100])
    where, row = toxicity.cut_windows(first, 32, 24)
    for i in range(5):
        seen = set(where[row == i].ravel().tolist()) - {-1}
        assert seen == set(range(first[i], first[i + 1]))
    assert (np.bincount(row, minlength=5) == [0, 1, 1, 1, 4]).all()


def test_held_out_accuracy(spark, documents, corpus, model):
    docs = documents([(i, t) for i, t, _ in corpus] + [(1000, None), (1001, ""), (1002, "  ,"), (None, "x"), (1003, "plain " * 30_000 + BAD[0] + " " + BAD[1])])
    found = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert len(found) == 505 and all(0 <= s <= 1 for s in found.values())
    held = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [(found[i] >= toxicity.REJECT) == bool(y) for i, _, y in held]
    assert np.mean(right) > 0.9
    assert found[1000] == found[1001] == found[1002] < toxicity.REJECT
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s < toxicity.REJECT}
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_folds_and_labels(spark, documents, corpus):
    ids = spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in ids)
    docs = documents([(i, t) for i, t, _ in corpus[:20]])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = toxicity.learn(docs, nothing)
    assert len(set(blank.document_scores(pa.array(["a", "", None])))) == 1
    only = [i for i, *_ in corpus[:20] if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 0, 1) for i in only] + [(None, 0, 1), (3, None, None), (9999, 0, 1)], nothing.schema)
    assert toxicity.learn(docs, labels).document_scores(pa.array(["a"]))[0] < 0.01


def test_a_task_fits_and_not_the_driver(spark, documents, corpus, monkeypatch):
    seen = sorted((r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: ((r[0] * 2654435761) & 0xFFFFFFFF, r[0]))
    expected = toxicity.fit([t for _, t, _ in seen], np.array([y for *_, y in seen]))

    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(*given):
        assert os.getpid() != driver
        return fit(*given)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    docs = documents([(i, t) for i, t, _ in corpus] + [(seen[0][0], ""), (seen[1][0], None), (None, "x")])
    found = toxicity.learn(docs, spark.createDataFrame([(i, 0, y) for i, _, y in corpus], "doc_id long, quality int, toxic int"))
    assert (found.vocabulary == expected.vocabulary).all() and found.calibration == expected.calibration
    assert all((found.net.p[k] == v).all() for k, v in expected.net.p.items())


def test_pipeline_equals_its_operators(spark, corpus, prose, tmp_path):
    from nearsieve.llm import decontaminate, simhash
    from nearsieve.llm.env import cut

    passage = prose(40, 5000)
    rows = [(i, t) for i, t, _ in corpus] + [(600, corpus[1][1]), (601, prose(100, 5001) + " " + passage), (602, "mail me a@b.co " + prose(80, 5002)), (603, None), (604, "")]
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(cut(stage(spark, stages[-1], str(tmp_path)), name))
        if name != "packing":
            assert stages[-1].columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    clean = {i for i, _, y in corpus if not y}
    assert len(clean & ids[1]) > 0.95 * len(clean) and len(ids[1] - clean - {600, 601, 602, 603, 604}) < 0.1 * len(corpus)
    least = {r.component_id for r in simhash.near_classes(stages[1]).collect()}
    assert ids[2] == least and 600 not in ids[2] and 604 not in ids[2]
    assert ids[3] == ids[2] - {601} and decontaminate.contained_items(stages[2], items).count() == 1
    assert ids[4] == ids[3] == ids[5]
    assert "[EMAIL]" in stages[4].filter("doc_id = 602").first().text
    assert sorted(map(tuple, stages[5].select("doc_id", "start", "length").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()))
