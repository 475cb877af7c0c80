import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataweave.llm import token_files as tf

from .odd import odd_documents, odd_rows


def expected(rows):
    t = Tokenizer.from_file(tf.default_tokenizer())
    out, at = [], 0
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def in_order(spark, rows):
    """(doc_id, text) as the files order them: null ids first, then by id, hash of the text and text."""
    df = spark.createDataFrame([(r[0], r[1] or "") for r in rows], "doc_id long, text string")
    return [(r[0], r[1]) for r in df.coalesce(1).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").collect()]


def test_matches_library(spark, sf_dir):
    got = [tuple(r) for r in tf.op4_token_files(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == expected(sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))


def crcs(df):
    return [tuple(r) for r in df.mapInArrow(tf._crc, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()]


def test_odd_rows_and_lookup(spark):
    rows = odd_rows() + [(None, "no id", *odd_rows()[0][2:])]
    path = tf.write_token_files(spark.createDataFrame(rows, odd_documents(spark).schema))
    want = expected(in_order(spark, rows))
    assert crcs(tf.read_token_files(spark, path)) == want
    for i in (None, 0, 3, 6, 99):
        assert crcs(tf.lookup(spark, path, i)) == [w for w in want if w[0] == i]
    assert [r["n_tokens"] for r in tf.read_token_files(spark, path, "doc_id = 0").collect()] == [1]
    plan = tf.read_token_files(spark, path, "doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_lookup_opens_only_the_files_of_the_id(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word', id) as text")
    path = tf.write_token_files(docs, task_bytes=4 << 10)
    assert tf.manifest(spark, path).count() > 3
    found = tf.lookup(spark, path, 2345)
    assert [r["doc_id"] for r in found.collect()] == [2345]
    assert len(found.inputFiles()) == 2  # its file and the manifest


def test_hot_id_and_equal_rows_spread_over_files(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "if(id % 3 = 0, 'same', concat('word', id)) as text").repartition(5)
    path = tf.write_token_files(docs)
    held = tf.read_token_files(spark, path)
    assert held.count() == 3000
    assert tf.manifest(spark, path).agg(F.max("n") - F.min("n")).first()[0] < 9000
    assert max(r["count"] for r in spark.read.schema(tf.SCHEMA).orc(f"{path}/ids").groupBy("part").count().collect()) < 1500
    ends = [(r["start"], r["n_tokens"]) for r in held.orderBy("start").collect()]
    assert [s for s, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1].tolist()]


def test_stripes_indexes_and_bloom_filters(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', id * x))) as text").coalesce(1)
    path = tf.write_token_files(docs, row_index_stride=1000, stripe_bytes=1 << 20)
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = jvm.org.apache.hadoop.fs.FileSystem.get(conf).listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/ids"))
    files = [f.getPath() for f in held if f.getPath().getName().endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    streams = str(reader.rows().readStripeFooter(reader.getStripes().get(0)))
    assert "BLOOM_FILTER_UTF8" in streams and "ROW_INDEX" in streams
    assert "DIRECT_V2" in streams  # integer run lengths, second version
    with_small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert spark.read.orc(f"{path}/ids").rdd.getNumPartitions() > len(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_small)


def test_empty_table(spark):
    path = tf.write_token_files(odd_documents(spark).limit(0))
    assert tf.read_token_files(spark, path).count() == 0
    assert tf.lookup(spark, path, 1).count() == 0
