import random

from pyspark.sql import functions as F

from strataweave.llm import sharding as sh

from .odd import odd_documents


def laws(rows, n_shards, slack):
    """rows: (key, size, shard, slot)."""
    total, sizes = sum(r[1] for r in rows), [0] * n_shards
    for r in rows:
        sizes[r[2]] += r[1]
    assert all(abs(x - total / n_shards) <= slack for x in sizes), sizes
    for s in range(n_shards):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: r[3])
        assert [r[3] for r in own] == list(range(len(own)))
        assert [r[0] for r in own] == sorted(r[0] for r in own)
    assert [r[2] for r in sorted(rows, key=lambda r: (r[2], r[3]))] == sorted(r[2] for r in rows)


def test_query(spark, sf_dir):
    rows = sh.op8_histogram_sort(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    laws([(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows], 8, max(r["size"] for r in rows))


def test_uneven_keys_and_hot_key(spark):
    rng = random.Random(1)
    keys = [rng.choice([0, 5, -(2**63), 2**63 - 1, rng.randrange(2**62), 77, 77, 77]) for _ in range(3000)]
    docs = spark.createDataFrame([(k, f"{i} " + "x" * rng.randrange(200)) for i, k in enumerate(keys)], "doc_id long, text string").repartition(7)
    rows = sh.histogram_sort(docs).collect()
    assert len(rows) == 3000
    laws([(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows], 8, 420)


def test_odd_rows(spark):
    got = sh.histogram_sort(odd_documents(spark), n_shards=3)
    assert got.count() == odd_documents(spark).count()
    assert got.filter("text is null").first()["size"] == 1
    assert got.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0
    assert sh.histogram_sort(odd_documents(spark).limit(0)).count() == 0
    null_key = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    assert sh.histogram_sort(null_key, n_shards=2).count() == 2


def test_equal_rows_are_cut(spark):
    docs = spark.range(800).selectExpr("5L as doc_id", "'same text' as text", "id as __key", "'x' as shard").repartition(3)
    rows = sh.histogram_sort(docs).collect()
    assert sorted(r["__key"] for r in rows) == list(range(800))
    laws([(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows], 8, 10)


def test_a_third_of_rows_equal(spark):
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 1000L, id) as doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) as text").repartition(6)
    rows = sh.histogram_sort(docs).collect()
    laws([(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows], 8, 60)


def test_splitters_match_a_sorted_list(spark):
    rng = random.Random(5)
    rows = [(rng.choice([3, 3, rng.randrange(-(2**63), 2**63)]), rng.choice([1, rng.randrange(-(2**63), 2**63)]), i, rng.randrange(1, 50)) for i in range(2000)]
    found, total, n = sh.find_splitters(spark.createDataFrame(rows, "key long, tie long, place long, size long"), 4, 0.0, 5)
    assert (total, n) == (sum(r[3] for r in rows), 2000)
    for i, s in enumerate(found, 1):
        below = sum(r[3] for r in rows if r[:3] < s.bound)
        assert abs(below - total * i // 20) <= (50 if i % 5 == 0 else total // 40 + 50)


def test_an_exchange_by_the_splitters_found(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('y', 50) as text")
    rows = sh.histogram_sort(docs, path=str(tmp_path / "s"), n_shards=4, task_bytes=8 << 10)
    per_file = [r[0] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("__part").count().select("count").collect()]
    assert len(per_file) >= 24 and max(per_file) < 2 * min(per_file) + 50
    assert rows.count() == 4000
