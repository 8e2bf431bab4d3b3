import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id, mixing


def test_mix(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weights = mixing.quality_weights(spark.read.parquet(f"{data}/labels.parquet"))
    rows = mixing.mix(spark, docs, weights).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(spark, docs, weights).collect()))
    total = sum(r.size for r in rows)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
        assert r.copies <= 2
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    for s, n in sizes.items():
        assert goal[s] <= 2 * n + 1e-6 and abs(taken[s] - goal[s]) <= max(r.size for r in rows if r.source == s)


def test_good_documents_are_taken_first(spark):
    docs = spark.createDataFrame([(k, "a b c", "only") for k in range(2000)] + [(9000 + k, "x", f"other{k}") for k in range(3)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(k, 20.0) for k in range(0, 2000, 2)], "doc_id long, weight double")
    rows = [r for r in mixing.mix(spark, docs, weights, share=0.3).collect() if r.source == "only" and r.copies]
    assert sum(r.doc_id % 2 == 0 for r in rows) > 0.8 * len(rows) > 0


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    weights = spark.createDataFrame([(6, 2.0)], "doc_id long, weight double")
    mixed = mixing.mix(spark, odd_docs, weights)
    assert mixed.count() == odd_docs.count()
    applied = mixing.apply_mix(odd_docs, mixed)
    assert applied.columns == odd_docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in applied.collect()) == +want
    assert mixing.mix(spark, no_docs, weights).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, labelled):
    model = language_id.fit(labelled.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(labelled, model, ["doc_id", "lang"]).where(language_id.held_out(F.col("doc_id")))
    right, n, rejected = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right >= 0.97 * n and rejected <= 0.01 * n
    strange = spark.createDataFrame([(1, "漢字かな交じり文の例です。これは日本語です。" * 20), (2, "123 456"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(strange, model, ["doc_id"]).collect()}
    assert rows[1].rejected and rows[1].lang_pred in model.languages
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].rejected for k in (2, 3, 4))


def test_strangers_in_latin_script_are_rejected(spark, labelled):
    rng = random.Random(1)
    fi = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto".split()
    pl = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem".split()
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=n)) for words in (fi, pl, letters) for n in (60, 300) for _ in range(30)]
    model = language_id.fit(labelled.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"])
    assert found.where(~F.col("rejected")).count() == 0
    clean = labelled.where(language_id.held_out(F.col("doc_id")) & language_id.has_letter(F.col("text"))).crossJoin(spark.createDataFrame([(60,), (120,), (600,)], "cut int")).where(F.length("text") >= F.col("cut"))
    clean = clean.select("doc_id", "cut", F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("text"))
    rejected, n = language_id.predict(clean, model, ["doc_id", "cut"]).agg(F.count_if("rejected"), F.count("*")).first()
    assert n > 500 and rejected <= 0.01 * n


def test_equal_texts_get_equal_predictions(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    rows = language_id.predict(odd_docs, model, odd_docs.columns).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r.text].add((r.lang_pred, round(r.score, 5)))
        assert 0 <= r.score <= 1
    assert all(len(v) == 1 for v in by.values())
    none = language_id.fit(no_docs)
    assert none.languages == [] and all(r.lang_pred == "und" and r.rejected for r in language_id.predict(odd_docs, none, ["doc_id"]).collect())
    assert language_id.predict(no_docs, model, ["doc_id"]).count() == 0


def plain_vector(text, idf):
    """TF-IDF over hashed byte n-grams, one n-gram at a time."""
    raw = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 91 else b for b in text.encode())
    b = b" " + raw + b" "
    counts = Counter()
    for k in range(len(raw)):
        counts[b[k + 1]] += 1
    for k in range(len(b) - 1):
        counts[(b[k] * 257 + b[k + 1] + (1 << 18)) % 2**32] += 1
    for k in range(len(b) - 2):
        counts[((b[k] * 257 + b[k + 1]) * 257 + b[k + 2] + (1 << 26)) % 2**32] += 1
    held = Counter()
    for gram, n in counts.items():
        held[(gram * 2654435761 % 2**32) >> 20] += n
    v = np.zeros(language_id.BUCKETS)
    for bucket, n in held.items():
        v[bucket] = np.log1p(n) * idf[bucket]
    return held, v / max(np.linalg.norm(v), 1e-12)


def test_predictions_equal_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    learned = docs.where(~language_id.held_out(F.col("doc_id")))
    model = language_id.fit(learned)
    teaching = [r.text for r in learned.collect() if r.lang is not None and r.text is not None and any(c.isalpha() for c in r.text)]
    seen = Counter(b for t in teaching for b in plain_vector(t, np.ones(language_id.BUCKETS))[0])
    assert np.allclose(model.idf, [np.log((1 + len(teaching)) / (1 + seen[b])) + 0.2 for b in range(language_id.BUCKETS)], atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    for r in language_id.predict(docs, model, ["doc_id", "text"]).collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        held, v = plain_vector(r.text, model.idf)
        near = model.centroids @ v
        assert abs(r.score - min(1, max(0, near.max()))) < 1e-4
        assert near.max() - max(n for n, lang in zip(near, model.languages, strict=True) if lang == r.lang_pred) < 1e-5
        least = np.interp(np.log(max(sum(held.values()) / 3, 1)), np.log(language_id.CUTS), model.reject_below)
        assert r.rejected == (r.score < least) or abs(r.score - least) < 1e-4


def test_only_buckets_that_a_text_has_leave_a_task():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [b"a few words", b""]})
    (found,) = language_id._counted(iter([batch]))
    counts = language_id.counts_of(batch.column("text"))
    for row, want in zip(found.to_pylist(), counts, strict=True):
        got = np.zeros(language_id.BUCKETS, np.float32)
        got[np.frombuffer(row["buckets"], "<u2")] = np.frombuffer(row["counts"], np.float32)
        assert (got == want).all()
    assert found.nbytes < language_id.BUCKETS  # 16 KB a text before
