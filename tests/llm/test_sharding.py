import zlib

from pyspark.sql import functions as F

from colscope.llm.queries import QUERIES
from colscope.llm.sharding import contiguous_shards


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op9_contiguous_shards"](spark, folder).collect()}
    total, start, slots = sum(len(t.encode()) + 1 for _, t in texts), 0, [0] * 8
    for i, text in sorted(texts):
        r, size = found.pop(i), len(text.encode()) + 1
        shard = start * 8 // total
        assert (r["size"], r["text_crc32"]) == (size, zlib.crc32(text.encode()))
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (shard, slots[shard], "bytes", None)
        start, slots[shard] = start + size, slots[shard] + 1
    assert not found


def test_odd_rows(spark, make_docs):
    docs = make_docs((5, None), (5, None), (None, "ä"), (1, "x" * 100), (2, "")).withColumn("size", F.lit("clash"))
    rows = contiguous_shards(docs, 3).collect()
    assert len(rows) == 5
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {
        (5, 1, 0), (None, 3, zlib.crc32("ä".encode())), (1, 101, zlib.crc32(b"x" * 100)), (2, 1, 0),
    }
    same = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    assert {r["count"] for r in contiguous_shards(same, 8).groupBy("shard").count().collect()} == {125}
    assert contiguous_shards(make_docs(), 8).count() == 0
