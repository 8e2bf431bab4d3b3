"""What is written to disk besides results: shuffle files and tables between steps."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import line_dedup, storage


def shuffled(spark):
    """Bytes of the shuffle files that Spark holds."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.stat(f"{at}/{f}").st_size for d in dirs for at, _, files in os.walk(d) for f in files if f.startswith("shuffle_"))


def written(spark, since=-1):
    """(number of the last stage, bytes that stages behind `since` wrote to shuffle files)."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    stages = [(stages.apply(k).stageId(), stages.apply(k).shuffleWriteBytes()) for k in range(stages.size())]
    return max([since, *(k for k, _ in stages)]), sum(n for k, n in stages if k > since)


@pytest.fixture
def all_large(spark, monkeypatch):
    """Every table counts as too large to be sent to executors, and keys are dealt to so many tasks that copies of a text rarely meet in one block of a file."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(storage.small, "__defaults__", (-1,))
    for limit in ("BROADCAST_LINES", "VERIFY_TEXTS"):
        monkeypatch.setattr(line_dedup, limit, -1)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_texts_of_lines_are_not_shuffled_by_segment(spark, all_large):
    """a line has twelve keys; texts went to each of them once tables of keys were too large to be sent."""
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2000)) for _ in range(4)) for _ in range(300)]
    texts.append(texts[0].split("\n")[1] + "\n" + texts[1].split("\n")[2][:-1])  # a copy, and a near copy
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    last, _ = written(spark)
    found = line_dedup.dedup_lines(spark, docs)
    assert [(r.row.doc_id, r.n_lines, r.n_exact, r.n_near) for r in found.where("n_exact + n_near > 0").collect()] == [(300, 2, 1, 1)]
    assert written(spark, last)[1] < 9 * sum(map(len, texts))


def test_shuffle_files_go_with_their_query(spark):
    """else they stay until the driver collects its garbage."""
    before = shuffled(spark)
    work = storage.Workspace(spark, "test")
    made = work.table(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert shuffled(spark) <= before
    assert made.count() == 1000
    path = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    work.drop(made)
    assert not os.path.exists(path)


def test_a_stage_read_by_the_next_is_removed(spark, data, monkeypatch):
    """the tables of all stages stayed beside each other."""
    paths = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: paths.extend(docs.inputFiles()[:1]) or docs.select("doc_id")) for name in ("a", "b", "c")])
    assert corpus_pipeline.run(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [True, False, False]
