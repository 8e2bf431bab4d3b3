"""Importance resampling and the filter audit against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import filter_audit, importance, words
from quern.llm.storage import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    w = RUN.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def resampled(docs, target, percent, longest, least, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, longest)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        n, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = [(*r[:4], k) for k, r in enumerate(fit[: percent * len(fit) // 100], 1)]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter([*drawn, *((*r, None) for r in left.elements())])


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (3, 50, 1), (2, 100, 0)])
def test_resampling_equals_brute_force(spark, odd_docs, longest, percent, least):
    target = spark.createDataFrame([("one two words Ünï",), (None,), ("",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = importance.resample(spark, odd_docs, target, percent, longest, least)
    assert Counter(tuple(r) for r in found.collect()) == resampled(docs, [r["text"] for r in target.collect()], percent, longest, least)


def test_resampling_of_nothing_and_towards_nothing(spark, no_docs, odd_docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(spark, no_docs, empty).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(tuple(r) for r in importance.resample(spark, odd_docs, empty).collect()) == resampled(docs, [], 10, 1, 20)


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANKED_ROWS", 10)
    rows = spark.range(300).select((F.col("id") % 7).alias("score"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("doc_id"))
    found = importance.ranks(spark, rows, 300, ["score", "doc_id"], Workspace(spark, "ranks")).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 301))
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)
    assert [key(r) for r in found] == sorted(key(r) for r in found)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("longest", [1, 3])
def test_long_texts_in_parts(size, longest, monkeypatch):
    monkeypatch.setattr(importance, "blocks", lambda column, is_word: words.blocks(column, is_word, size))
    texts = ["", "a b  c", "Über-große Wörter, 1234 " * 9, "x" * 300, "...", "tail"]
    got = Counter()
    counted = np.zeros(len(texts), dtype=int)
    for block, rows, found, n in importance._by_block(pa.array([t.encode() for t in texts], pa.binary()), longest, 1 << 32):
        got.update(zip((rows + block.row).tolist(), found.tolist(), strict=True))
        counted[block.row : block.row + block.rows] += n
    assert got == Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in features(t, longest)[1])
    assert counted.tolist() == [features(t, 1)[0] for t in texts]


def test_megabytes_of_text(spark):
    long = "word another Third " * 400_000
    docs = spark.createDataFrame([(1, long), (2, "z" * 3_000_000), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in importance.resample(spark, docs, docs.select("text"), percent=100).collect()}
    assert [found[k]["n_features"] for k in (1, 2, 3)] == [1_200_000, 1, 0]
    assert [found[k]["rank"] for k in (1, 2, 3)] == [1, None, None]
    flags = {r["doc_id"]: r["f"]["mask"] for r in docs.select("doc_id", filter_audit.failures(F.col("text")).alias("f")).collect()}
    assert flags == {1: 0b110, 2: 1, 3: 1}


def audited(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    rows = []
    for r in docs:
        t = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r["doc_id"] is not None and r["doc_id"] > first[t]}
        rows.append((r["source"] or "", {f for f, v in failed.items() if v}, r["doc_id"] in good, r["doc_id"] in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, sums = [r for r in rows if r[0] == part], Counter()
        for order in ("".join(p) for p in permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                sums[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_applying_every_order(spark, odd_docs):
    labels = spark.createDataFrame([(6, 1, 0, "x"), (6, None, 1, "x"), (7, 0, 1, "x"), (10, 1, None, "x"), (14, 1, 0, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit(spark, odd_docs, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == audited(odd_docs.collect(), labels.collect())


def test_audit_of_copies_beyond_the_hot_bound(spark, monkeypatch):
    """Texts that many documents share, some of them hot, and parts beyond what a task holds."""
    monkeypatch.setattr(filter_audit, "HOT", 20)
    rows = [(k, "same text" if k % 3 == 0 else f"pair {k // 4}", f"s{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, k % 2, k % 5 == 0) for k in range(0, 400, 3)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    found = filter_audit.audit(spark, docs, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == audited(docs.collect(), labels.collect())


def test_audit_of_nothing(spark, no_docs):
    assert filter_audit.audit(spark, no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filter_audit._removals.__name__ and filter_audit.removal_table().shape == (32, 120)


def test_more_parts_than_a_task_holds(monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k % 9}" for k in range(3000)]), pa.array([k % 32 for k in range(3000)], pa.int32()), pa.array([k % 4 for k in range(3000)], pa.int32())], names=["part", "mask", "label"])
    out = list(filter_audit._removals(iter([batch, batch])))
    assert len(out) > 1
    assert sum(sum(r) for b in out for r in b.column("counts").to_pylist()) == 6000 * 120
