"""Operator 3: near-duplicate embeddings with an inverted multi-index.

Codebooks of the two halves of the vectors are fitted apart on a bounded sample; their product is a grid of cells. Every
vector is indexed in its nearest cell. A vector's search visits cells by the multi-sequence order of a lower bound: how far, at least, a vector
of that cell must lie away, from the half-planes between codewords. It ends when the target recall is sure or, for targets below
1, met on the sample. What the visited cells hold is verified by cosine in double precision.

Cells are dealt out in blocks of bounded size, so a cell that holds a third of all vectors is spread over many tasks; its links are
counted, not written out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.ngram_join import spanning
from quern.llm.storage import Workspace, small

#: A target of 1 visits every cell that can hold a link. Targets below count links of all groups together, so small groups beside a large one can lose theirs.
SIMILARITY, TARGET_RECALL = 0.98, 1.0
#: Vectors, at most about, that codebooks and the search's radius are fitted on; all vectors are indexed.
SAMPLE = 20_000
#: Queries, at most, whose true links in the sample set the radius.
QUERIES = 4_000
#: Vectors of the largest label that a cell is made for, about, and the most codewords of a half.
CELL, MOST_WORDS = 48, 512
BASE_BLOCK, PROBE_BLOCK = 1024, 4096


@dataclass
class MultiIndex:
    half: int
    words: tuple[np.ndarray, np.ndarray]
    radius2: float  # squared bound up to which cells are visited


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spread rows; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(10):
        of = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def half_bounds(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared least distance from each row to the part of space that is nearest to each codeword."""
    d2 = np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * x @ words.T, 0)
    near = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum((words**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * words @ words.T, 0))
    gap = 2 * apart[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(gap > 0, (d2 - d2[np.arange(len(x)), near][:, None]) / gap, 0)
    return np.maximum(away, 0) ** 2


def own_cells(x: np.ndarray, index: MultiIndex) -> np.ndarray:
    a, b = (np.argmin((w**2).sum(1)[None, :] - 2 * h @ w.T, axis=1) for h, w in zip((x[:, : index.half], x[:, index.half :]), index.words, strict=True))
    return a * len(index.words[1]) + b


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[int]:
    """Cells of the grid in ascending order of the sum of two bounds, up to `limit`: the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out, heap, seen = [], [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heappop(heap)
        if bound > limit:
            break
        out.append(int(a[i]) * len(second) + int(b[j]))
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in seen:
                seen.add((k, m))
                heappush(heap, (first[a[k]] + second[b[m]], k, m))
    return out


def fit(sample: np.ndarray, labels: np.ndarray, n_largest: int, similarity: float, target_recall: float) -> MultiIndex:
    x = unit(sample)
    half = max(1, x.shape[1] // 2)
    k = int(np.clip(round(math.sqrt(n_largest / CELL)), 2, MOST_WORDS))
    words = (codebook(x[:, :half], k), codebook(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0)))
    sure = 2 - 2 * similarity + 1e-9  # no linked vector is in a cell beyond
    index = MultiIndex(half, words, sure)
    if target_recall >= 1:
        return index
    step = max(1, len(x) // QUERIES)
    needed = []
    cells = own_cells(x, index)
    for at in range(0, len(x), 512 * step):
        q = np.arange(at, min(len(x), at + 512 * step), step)
        i, j = np.nonzero((x[q] @ x.T >= similarity) & (labels[q][:, None] == labels[None, :]) & (q[:, None] != np.arange(len(x))[None, :]))
        if len(i):
            bound = half_bounds(x[q, :half], words[0])[i, cells[j] // len(words[1])] + half_bounds(x[q, half:], words[1])[i, cells[j] % len(words[1])]
            needed.append(bound)
    met = np.concatenate(needed) if needed else np.zeros(0)
    if len(met) * (1 - target_recall) >= 1:  # enough links to tell; the margin is for what the sample hasn't seen
        index.radius2 = min(sure, 1.5 * float(np.quantile(met, target_recall)) + 0.02 * sure)
    return index


def valid(embedding: Column) -> Column:
    """No null or non-finite component and not all 0."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, kept: np.ndarray) -> np.ndarray:
    rows = column.filter(pa.array(kept))
    return np.array(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), -1)


def _search(index: MultiIndex, dim: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(np.array(part.column("embedding").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim))
                own = own_cells(x, index)
                first, second = half_bounds(x[:, : index.half], index.words[0]), half_bounds(x[:, index.half :], index.words[1])
                # a link is found from the vector of the lower cell, so no pair is met twice; its own cell is always among them
                cells = [[c for c in traverse(f, s, index.radius2) if c > o] + [o] for f, s, o in zip(first, second, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("copies"), part.column("embedding"), pa.array(own, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["node", "label", "copies", "embedding", "own", "cells"])

    return run


def _verify(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, probe = pdf[pdf["is_base"]], pdf[~pdf["is_base"]]
        empty = pd.DataFrame({"src": pd.array([], "Int64"), "dst": pd.array([], "Int64"), "n": pd.array([], "Int64")})
        if not len(base) or not len(probe):
            return empty
        xb, xp = unit(np.stack(base["embedding"]).astype(np.float64)), unit(np.stack(probe["embedding"]).astype(np.float64))
        nb, np_ = base["node"].to_numpy(), probe["node"].to_numpy()
        mask = xp @ xb.T >= similarity
        inner = (probe["own"] == probe["cell"]).to_numpy()
        mask[inner] &= np_[inner][:, None] < nb[None, :]
        counted = [(np_, mask @ base["copies"].to_numpy()), (nb, mask.T @ probe["copies"].to_numpy())]
        found = [(a, None, n) for ids, sums in counted for a, n in zip(ids.tolist(), sums.tolist(), strict=True) if n]
        if not found:
            return empty
        found += [(a, b, None) for a, b in spanning(mask, np_, nb) if a != b]
        return pd.DataFrame({"src": pd.array([f[0] for f in found], dtype="Int64"), "dst": pd.array([f[1] for f in found], dtype="Int64"), "n": pd.array([f[2] for f in found], dtype="Int64")})

    return run


def link_embeddings(spark: SparkSession, vectors: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """A row for each row of `vectors` (vec_id, label, embedding): vec_id, n_links (other vectors of the label with cosine `similarity` or more), component_id
    (smallest vec_id that links reach, itself included), kept (vec_id = component_id).

    Vectors that are null, zero, or hold a null or non-finite component, and those without a label, link with nothing. Vectors of unequal length
    don't link. Equal vectors of a label all link with each other. A component whose vectors all lack ids has none, and is kept.
    Other columns are ignored. An empty table gives none.
    """
    work = Workspace(spark, "embeddings")
    rows = vectors.select("vec_id", F.col("label"), F.col("embedding"))
    fit_for = F.col("label").isNotNull() & valid(F.col("embedding"))
    rows = rows.select("vec_id", "label", "embedding", fit_for.alias("fit"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding", "label").alias("h2"))
    grouped = rows.where("fit").groupBy("label", "h1", "h2").agg(F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("rep"))
    classes = work.table(grouped.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = []
    for dim, n in classes.groupBy("dim").count().collect():  # lengths of vectors
        mine = classes.where(F.col("dim") == dim)
        largest = mine.groupBy("label").count().agg(F.max("count")).first()[0]
        share = F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) < int(min(1, SAMPLE / n) * (1 << 30))
        sample = mine.where(share).select(F.xxhash64("label").alias("label"), "embedding").toArrow()
        if not len(sample):
            sample = mine.select(F.xxhash64("label").alias("label"), "embedding").limit(1).toArrow()
        x = np.array(sample["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
        index = fit(x, sample["label"].to_numpy(), largest, similarity, target_recall)
        label_type = mine.schema["label"].dataType.simpleString()
        element = mine.schema["embedding"].dataType.simpleString()
        searched = mine.select("node", "label", "copies", "embedding").mapInArrow(_search(index, dim), f"node long, label {label_type}, copies long, embedding {element}, own int, cells array<int>")
        found.append(_links(work.table(searched, "searched"), similarity, work))
    links = found[0] if found else spark.createDataFrame([], "src long, dst long, n long")
    for more in found[1:]:
        links = links.union(more)
    reached = components(links.where("dst IS NOT NULL"), work)
    counts = links.where("n IS NOT NULL").groupBy(F.col("src").alias("count_node")).agg(F.sum("n").alias("links"))
    slim = classes.select("node", F.col("h1").alias("c1"), F.col("h2").alias("c2"), "copies", "rep")
    slim = slim.join(reached.withColumnRenamed("node", "reached_node"), F.col("node") == F.col("reached_node"), "left").withColumn("root", F.coalesce("component", "node"))
    slim = work.table(slim.join(counts, F.col("node") == F.col("count_node"), "left").select("root", "c1", "c2", "copies", "rep", F.coalesce("links", F.lit(0)).alias("links")), "linked")
    least = slim.groupBy(F.col("root").alias("least_root")).agg(F.min("rep").alias("component_id"))
    whole = slim.join(least, F.col("root") == F.col("least_root")).select("c1", "c2", "copies", "links", "component_id", F.lit(True).alias("known"))
    out = rows.drop("label", "embedding").join(whole, F.col("fit") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(searched: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Verifies what each cell holds against the searches that visit it, block by block."""
    visits = searched.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("probes"))
    held = searched.groupBy("label", F.col("own").alias("cell")).agg(F.count("*").alias("bases"))
    sized = held.join(visits, ["label", "cell"]).select(F.col("label").alias("l"), F.col("cell").alias("c"), F.ceil(F.col("bases") / BASE_BLOCK).cast("int").alias("base_blocks"), F.ceil(F.col("probes") / PROBE_BLOCK).cast("int").alias("probe_blocks"))
    sized = work.table(sized, "cells")
    sized = small(sized, sized.count())
    mine = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["label", "cell", "node", "copies", "embedding", "own"]
    base = searched.withColumn("cell", F.col("own")).join(sized, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")))
    base = base.select(*columns, F.pmod(mine, "base_blocks").cast("int").alias("base_block"), every("probe_blocks").alias("probe_block"), F.lit(True).alias("is_base"))
    probe = searched.select("label", "node", "copies", "embedding", "own", F.explode("cells").alias("cell")).join(sized, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")))
    probe = probe.select(*columns, every("base_blocks").alias("base_block"), F.pmod(mine, "probe_blocks").cast("int").alias("probe_block"), F.lit(False).alias("is_base"))
    dealt = base.unionByName(probe)
    return work.table(dealt.groupBy("label", "cell", "base_block", "probe_block").applyInPandas(_verify(similarity), "src long, dst long, n long"), "links")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: By brute force: every pair of a label.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT * FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v) WHERE norm > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
  coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id) AS component_id,
  e.vec_id = coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""
