"""Operator 10: language identification by nearest centroid.

Features are byte n-grams (one to three bytes, ASCII letters in lower case, everything that isn't a letter read as a
space) hashed to a fixed number of buckets, weighted by TF-IDF and normalised. Each language has several centroids, clustered by
cosine. A document belongs to the language of its nearest centroid and is rejected if even that one is too far for a text of its length.

Document frequencies cover all documents that may be learned from. Centroids are fitted on a bounded sample of labelled
rows: `SAMPLE` for each language, chosen by a hash of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import workers

BUCKETS = 4096
#: Labelled rows of each language that centroids are fitted on, about; the rest of the labelled rows only counts towards document frequencies.
SAMPLE = 1000
CENTROIDS = 3
#: A document is rejected below this share of the similarity that 1 in 200 of the fitted rows doesn't reach,
REJECT_SHARE = 0.35
#: and below this share of what 1 in 200 of the fitted rows, cut to its length, doesn't reach.
CUT_SHARE = 0.7
#: Lengths, in bytes, that fitted rows are cut to; between them the least similarity is interpolated.
CUTS = (4, 16, 64, 256, 1024)

_LOWER = np.full(256, 32, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def _buckets(raw: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a text (bytes, already mapped by _LOWER), with a space on either side."""
    b = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    grams = np.concatenate([b[1:-1], two + np.uint32(1 << 18), three + np.uint32(1 << 26)])
    return (grams * np.uint32(2654435761)) >> np.uint32(20)


def counts_of(column: pa.Array) -> np.ndarray:
    """A row of bucket counts for each text (binary)."""
    workers.works_for("language_id")
    column = column.cast(pa.large_binary())
    out = np.zeros((len(column), BUCKETS), dtype=np.float32)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    for k, (a, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, e, 1 << 20):  # very long texts in parts, for memory
            out[k] += np.bincount(_buckets(_LOWER[data[at : min(e, at + (1 << 20))]]), minlength=BUCKETS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF; an empty row stays 0."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # for texts of each length in CUTS


def least_scores(counts: np.ndarray, model: Model) -> np.ndarray:
    """The similarity below which texts of these counts are rejected: short texts lie farther from every centroid than long ones."""
    return np.interp(np.log(np.maximum(counts.sum(axis=1, dtype=np.float64) / 3, 1)), np.log(CUTS), model.reject_below)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by cosine; starts from rows far from each other, so it needs no random numbers."""
    chosen = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[np.argmin(np.max(x @ np.array(chosen).T, axis=1))])
    centres = np.array(chosen)
    for _ in range(8):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        of = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _frequencies(batches):
    seen, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            seen += (counts_of(batch.column("text").slice(at, 512)) > 0).sum(axis=0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen], pa.list_(pa.int64()))], names=["n", "seen"])


def _counted(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            counts = counts_of(batch.column("text").slice(at, 256))
            used = [np.flatnonzero(c) for c in counts]
            buckets = pa.array([u.astype("<u2").tobytes() for u in used], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, 256), buckets, pa.array([c[u].tobytes() for c, u in zip(counts, used, strict=True)], pa.binary())], names=["lang", "buckets", "counts"])


def _cut_scores(model: Model):
    def run(batches):
        for batch in batches:
            for cut in CUTS:
                texts = [t[:cut] for t in batch.column("text").to_pylist() if len(t) >= cut]
                for at in range(0, len(texts), 256):
                    near = np.max(vectors(counts_of(pa.array(texts[at : at + 256], pa.binary())), model.idf) @ model.centroids.T, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([cut] * len(near), pa.int32()), pa.array(near, pa.float32())], names=["cut", "score"])

    return run


def fit(labelled: DataFrame) -> Model:
    """Learn from `labelled` (doc_id, text, lang): only text and lang are features and label; doc_id only helps to choose the sample.

    Rows without text, letter or lang teach nothing. With no rows left, the model knows no language and rejects everything.
    """
    rows = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    per_task = rows.select("text").mapInArrow(_frequencies, "n long, seen array<long>")
    summed = per_task.select("n", F.posexplode("seen").alias("bucket", "seen")).groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n")).collect()  # BUCKETS rows
    n = max((r["n"] for r in summed), default=0)
    seen = np.zeros(BUCKETS)
    for r in summed:
        seen[r["bucket"]] = r["seen"]
    idf = (np.log((1 + n) / (1 + seen)) + 0.2).astype(np.float32)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), idf, np.full(len(CUTS), 2.0))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1, SAMPLE / c)))) for lang, c in sizes.items()))
    chosen = rows.where(spread < share).select("lang", "text")
    sample = chosen.mapInArrow(_counted, "lang string, buckets binary, counts binary").toArrow()  # buckets that a text has: most have few
    lang = np.array(sample["lang"].to_pylist())
    x = np.zeros((len(lang), BUCKETS), np.float32)
    for row, buckets, counts in zip(x, sample["buckets"], sample["counts"], strict=True):
        row[np.frombuffer(buckets.as_buffer(), dtype="<u2")] = np.frombuffer(counts.as_buffer(), dtype=np.float32)
    del sample
    np.log1p(x, out=x)  # as vectors() does, in place: the driver has little memory
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    names, centres = [], []
    for name in sorted(set(lang)):
        found = _clusters(x[lang == name], CENTROIDS)
        names += [name] * len(found)
        centres.append(found)
    centroids = np.concatenate(centres).astype(np.float32)
    nearest = np.max(x @ centroids.T, axis=1)
    model = Model(names, centroids, idf, np.full(len(CUTS), float(np.quantile(nearest, 0.005)) * REJECT_SHARE))
    scored = chosen.select("text").mapInArrow(_cut_scores(model), "cut int, score float").toArrow()  # at most a row for each cut of the sample
    cut, score = scored["cut"].to_numpy(), scored["score"].to_numpy()
    for k, c in enumerate(CUTS):
        held = score[cut == c]
        at_cut = np.quantile(held, 0.005) * CUT_SHARE if len(held) else model.reject_below[k - 1] if k else 0
        model.reject_below[k] = max(model.reject_below[k], at_cut)
    return model


PREDICTED = "lang_pred string, score double, rejected boolean"
#: Texts that are counted at a time.
ROWS = 256


def _predict(model: Model):
    names = np.array(model.languages, dtype=object)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for at in range(0, len(column), ROWS):
                part = column.slice(at, ROWS)
                counts, known = counts_of(part.fill_null(b"")), part.is_valid().to_numpy(zero_copy_only=False)
                lang, score, rejected = np.full(len(part), "und", dtype=object), np.zeros(len(part)), np.ones(len(part), dtype=bool)
                if len(names):
                    near = np.clip(vectors(counts, model.idf) @ model.centroids.T, 0, 1)
                    lang = np.where(known, names[near.argmax(axis=1)], "und")
                    score = np.where(known, near.max(axis=1), 0.0)
                    rejected = ~known | (score < least_scores(counts, model))
                parts.append((lang, score, rejected))
            lang, score, rejected = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else ([], np.zeros(0), np.zeros(0, bool))
            yield pa.StructArray.from_arrays([pa.array(list(lang), pa.string()), pa.array(score.astype(np.float64)), pa.array(rejected)], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, PREDICTED).asNondeterministic()  # so that a filter on its result doesn't run it again


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, under any names but those three, with lang_pred, score (cosine to the nearest centroid) and rejected.

    Text that is null or has no letter is `und` with score 0 and rejected. Only text decides, and only text goes to Python. Equal texts get equal
    predictions; languages at equal distance go to the first by name. Very long texts are counted in parts. An empty table gives none.
    """
    text = F.when(has_letter(F.col("text")), F.col("text").cast("binary"))
    found = docs.select(F.struct(*keep).alias("kept"), _predict(model)(text).alias("found"))
    return found.select(*(F.col("kept")[c].alias(c) for c in keep), "found.lang_pred", "found.score", "found.rejected")


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
