from nearsieve.config import KnnConfig
from nearsieve.operators.doph import addressed
from nearsieve.operators.index import reservoirs
from nearsieve.operators.query import probe, top_by_count
from nearsieve.streaming.knn_stream import answer_stream, insert_stream

CFG = KnnConfig(hashes=2, tables=4, address_bits=6, reservoir=8, top_k=3)


def test_streams_equal_one_batch(spark, tmp_path):
    sets = {i: [1 + i % 5, 2 + i % 5, 40 + i % 3] for i in range(60)}
    rows = lambda ids: spark.createDataFrame([(i, x) for i in ids for x in sets[i]], "id long, idx long").coalesce(1)
    for ids in (range(0, 20), range(20, 40), range(40, 60)):
        rows(ids).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("id long, idx long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    insert_stream(source(), CFG, f"{tmp_path}/index", f"{tmp_path}/c1").awaitTermination()
    whole = reservoirs(addressed(rows(range(60)), CFG), CFG)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/2").collect()} == {tuple(r) for r in whole.collect()}
    index = spark.read.parquet(f"{tmp_path}/index/2")
    answer_stream(source(), index, CFG, f"{tmp_path}/out", f"{tmp_path}/c2", own=False).awaitTermination()
    once = top_by_count(probe(addressed(rows(range(60)), CFG), index), CFG.top_k)
    found = spark.read.parquet(f"{tmp_path}/out").select("qid", "rank", "id", "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, once.collect()))
