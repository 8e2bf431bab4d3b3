"""Operator 7: n-gram Jaccard join by a MinHash LSH forest and exact verification.

Documents with equal shingle sets fall into one class first, so copies cost nothing later. Each tree of the forest labels a class
with a sequence of minimum hashes; classes with a common prefix of labels are under one node of the tree's trie. Matched prefixes are
shortened from whole labels, one hash at a time, until all trees together reach the target recall; no tree ever matches longer ones. Where few classes
share a still shorter prefix of `SHORT` hashes, that one is matched, so that nearly everything similar meets there; crowded parts of a trie keep the prefix of the target.
Crowding is no matter of chance for a pair (two groups of copies crowd a node exactly where they meet), so it may only add matches. Classes under a node are mates. Mates are placed in blocks of
bounded size by the connected groups of nodes, and blocks that hold mates are verified exactly, by products of sparse membership matrices or pair by pair
where mates are few; so a group of copies of any size is spread over tasks and its pairs are counted, not written out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.graph import components
from quern.llm.storage import Workspace, small

SHINGLE, SIMILARITY = 5, 0.8
#: Trees, hashes of a whole label, and recall at the threshold that prefixes are shortened for.
TREES, FULL, TARGET_RECALL = 32, 12, 0.999
#: The shortest prefix, and the number of classes up to which a node of it is taken as it is.
SHORT, FEW_MATES = 5, 8
#: Classes in a block of a verified group; a group of more is verified as pairs of blocks.
BLOCK = 256
#: Bytes of text that are shingled at a time.
SLICE_BYTES = 1 << 20

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base % 2**64), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _forget() -> None:
    _POWERS[:] = [np.zeros(0, np.uint64)] * 2


workers.keeps("ngram_join", _forget)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; `offsets` cut `data` (UTF-8 bytes) into texts.

    Words are runs of bytes other than ASCII white space, with ASCII letters in lower case. A text of 1 to SHINGLE - 1 words has one
    shingle, all its words; a text without words has none.
    """
    n_docs = len(offsets) - 1
    empty = np.zeros(0, dtype=np.uint64)
    base = offsets[0]
    data, offsets = _FOLD[data[base : offsets[-1]]], offsets - base
    if not len(data):
        return [empty] * n_docs
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    if len(_POWERS[0]) < len(data) + 1:
        _POWERS[0] = _powers(_P, len(data) + 1)
        _POWERS[1] = _powers(pow(_P, -1, 2**64), len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * _POWERS[0][: len(data)])])
        words = _mix((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))
        turns = _powers(0xD6E8FEB86659FD93, SHINGLE)
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            rolled += words[k : k + len(rolled)] * turns[k]
        rolled = _mix(rolled)
        at = np.searchsorted(starts, offsets)
        out = []
        for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - a >= SHINGLE:
                out.append(np.unique(rolled[a : e - SHINGLE + 1]))
            elif e > a:
                out.append(_mix(np.sum(words[a:e] * turns[: e - a], keepdims=True) + _U(e - a)))
            else:
                out.append(empty)
    return out


def sets_of(column: pa.Array):
    """(index of the first text, shingle sets) for slices of a text column."""
    workers.works_for("ngram_join")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = at + max(1, int(np.searchsorted(offsets[at + 1 :], offsets[at] + SLICE_BYTES)))
        yield at, shingle_sets(data, offsets[at : end + 1])
        at = end


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set; they are what identifies it."""
    with np.errstate(over="ignore"):
        a = np.sum(_mix(shingles + _U(0x632BE59BD9B4E019)), dtype=np.uint64) + _U(len(shingles))
        b = np.sum(_mix(shingles ^ _U(0xA0761D6478BD642F)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def prefix_length(similarity: float, trees: int, full: int, target: float) -> int:
    """The longest prefix at which a pair of that similarity shares a node in some tree with probability `target`: starting from whole
    labels, prefixes are shortened by one hash until the forest's recall reaches the target."""
    length = full
    while length > 1 and 1 - (1 - similarity**length) ** trees < target:
        length -= 1
    return length


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def forest_nodes(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray, trees: int, lengths: tuple[int, ...]) -> np.ndarray:
    """Of each tree, the trie nodes at some prefix lengths: hashes of the tree and of the label's prefix."""
    low = np.full((len(mul), 1), 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> _U(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            hashes = np.multiply.outer(mul, x[at : at + 512])
            hashes += add[:, None]
            low = np.minimum(low, hashes.min(axis=1, keepdims=True))
        labels = low.reshape(trees, -1).astype(np.uint64)
        nodes, out = np.arange(trees, dtype=np.uint64), []
        for k in range(labels.shape[1]):
            nodes = _mix(nodes * _U(_P) + labels[:, k] + _U(1))
            if k + 1 in lengths:
                out.append(nodes)
    return np.stack(out).astype(np.int64)


SIGNED = "row_key long, doc_id long, text_hash long, n int, h1 long, h2 long, short array<long>, middle array<long>"


def _sign(trees: int, lengths: tuple[int, int]):
    def run(batches):
        mul, add = _multipliers(trees * lengths[1])
        for batch in batches:
            for at, sets in sets_of(batch.column("text")):
                ids = [class_of(s) for s in sets]
                nodes = [forest_nodes(s, mul, add, trees, lengths) for s in sets if len(s)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([trees * (len(s) > 0) for s in sets])]).astype(np.int32))
                flat = np.concatenate(nodes, axis=1) if nodes else np.zeros((2, 0), np.int64)
                kept = [batch.column(c).slice(at, len(sets)) for c in ("row_key", "doc_id", "text_hash")]
                found = [pa.array([len(s) for s in sets], pa.int32()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64())]
                listed = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(row))) for row in flat]
                yield pa.RecordBatch.from_arrays([*kept, *found, *listed], names=["row_key", "doc_id", "text_hash", "n", "h1", "h2", "short", "middle"])

    return run


def mates_of(classes: DataFrame, work: Workspace) -> DataFrame:
    """node, trie: the trie nodes that classes are matched at: the short prefix where its node holds two to FEW_MATES classes, else the middle one."""
    under = classes.select("node", F.explode(F.arrays_zip("short", "middle")).alias("at")).select("node", "at.*")
    shared = work.table(under.groupBy("short").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("short", "shared"), "shared")
    held = under.join(small(shared, shared.count()), F.col("short") == F.col("shared"))
    return work.table(held.select("node", F.when(F.col("n") <= FEW_MATES, F.col("short")).otherwise(F.col("middle")).alias("trie")), "mates")


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or for rows without one a hash of the text that comes after all ids."""
    high = 1 << 62
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(high - 1).bitwiseOR(F.lit(high)))


def _keyed(docs: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    return docs.select(row_key(doc, text).alias("row_key"), doc.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))


def _fetched(batches):
    """Shingle sets of the rows that are what their class was found from."""
    for batch in batches:
        for at, sets in sets_of(batch.column("text")):
            part = batch.slice(at, len(sets))
            h1, h2 = part.column("h1").to_pylist(), part.column("h2").to_pylist()
            keep = [class_of(s) == (a, b) for s, a, b in zip(sets, h1, h2, strict=True)]
            arrays = [part.column(c).filter(pa.array(keep)) for c in ("node", "grp", "blk", "blks", "copies", "tries")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary())], names=["node", "grp", "blk", "blks", "copies", "tries", "shingles"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of `left` with those of `right` (None: `left`)."""
    every = left if right is None else left + right
    values, index = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    often = np.bincount(index, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[index]
    row, index = row[keep], column[index[keep]]
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    n, m = len(left), len(every)
    out = np.zeros((n, m if right is None else m - n), dtype=np.float32)
    width = int(often.sum())
    for at in range(0, width, 8192):
        a, e = np.searchsorted(index, (at, at + 8192))
        member = np.zeros((m, min(8192, width - at)), dtype=np.float32)
        member[row[a:e], index[a:e] - at] = 1
        out += member[:n] @ (member if right is None else member[n:]).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, mates: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs are similar: of `mates` one by one if they are few, else of all pairs at once."""
    a = np.array([len(s) for s in left], dtype=np.float64)[:, None]
    b = np.array([len(s) for s in (left if right is None else right)], dtype=np.float64)[None, :]
    if mates.sum() * 16 < mates.size:
        shared = np.zeros(mates.shape)
        for i, j in zip(*np.nonzero(mates), strict=True):
            shared[i, j] = len(np.intersect1d(left[i], (left if right is None else right)[j], assume_unique=True))
    else:
        shared = shared_counts(left, right).astype(np.float64)
    mask = shared >= similarity * (a + b - shared) - 1e-9
    if right is None:
        np.fill_diagonal(mask, False)
    return mask


def spanning(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what `mask` connects: each linked node to the smallest one that it reaches in the block."""
    big = np.iinfo(np.int64).max
    rows, columns = mask.any(axis=1), mask.any(axis=0)
    a, b, m = left[rows].copy(), right[columns].copy(), mask[np.ix_(rows, columns)]
    while len(a):
        na = np.minimum(a, np.where(m, b[None, :], big).min(axis=1))
        nb = np.minimum(b, np.where(m, na[:, None], big).min(axis=0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    return [*zip(left[rows].tolist(), a.tolist(), strict=True), *zip(right[columns].tolist(), b.tolist(), strict=True)]


def _verify(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "grp", "blk"])
        found = []
        for _, group in pdf.groupby("grp", sort=False):
            first = group["blk"] == group["left_block"]
            sides = []
            for side in (group[first], group[~first]):
                sides.append((side["node"].to_numpy(), side["copies"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in side["shingles"]], [np.asarray(t) for t in side["tries"]]))
            (nodes, copies, sets, tries), (nodes2, copies2, sets2, tries2) = sides
            if not sets or (len(sets) < 2 and not sets2):
                continue
            one = not sets2 and bool((group["left_block"] == group["right_block"]).all())
            if not one and not sets2:
                continue
            mates = shared_counts(tries, None if one else tries2) > 0
            if one:
                np.fill_diagonal(mates, False)
            mask = linked(sets, None if one else sets2, mates, similarity)
            found += [(a, None, n) for a, n in zip(nodes.tolist(), (mask @ (copies if one else copies2)).tolist(), strict=True) if n]
            if not one:
                found += [(a, None, n) for a, n in zip(nodes2.tolist(), (mask.T @ copies).tolist(), strict=True) if n]
            found += [(a, b, None) for a, b in spanning(mask, nodes, nodes if one else nodes2) if a != b]
        return pd.DataFrame({"src": pd.array([f[0] for f in found], dtype="Int64"), "dst": pd.array([f[1] for f in found], dtype="Int64"), "n": pd.array([f[2] for f in found], dtype="Int64")})

    return run


def blocked(members: DataFrame, sizes: DataFrame, block: int, work: Workspace) -> DataFrame:
    """`members` (node, grp) with blk (a member's block) and blks (blocks of its group), blocks by a hash of the node."""
    n = sizes.count()
    joined = members.join(small(sizes.withColumnRenamed("grp", "size_grp"), n), F.col("grp") == F.col("size_grp")).drop("size_grp")
    blocks = F.ceil(F.col("size") / block).cast("int")
    return joined.withColumn("blks", blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blks")).cast("int")).drop("size")


def facing_blocks(members: DataFrame, under: DataFrame, work: Workspace) -> DataFrame:
    """face_grp, face_blk, faces: the pairs of blocks of large groups that hold mates, under each of their two blocks."""
    held = members.select(F.col("node").alias("member"), "grp", "blk").join(under, F.col("member") == F.col("node"))
    together = held.groupBy("grp", "trie").agg(F.array_sort(F.collect_set("blk")).alias("blks")).select("grp", "blks").distinct()
    pairs = together.select("grp", "blks", F.explode("blks").alias("left_block")).select("grp", "left_block", F.explode("blks").alias("right_block")).where("left_block <= right_block").distinct()
    pair = F.struct("left_block", "right_block")
    either = pairs.select("grp", F.explode(F.array_distinct(F.array("left_block", "right_block"))).alias("blk"), pair.alias("pair"))
    return work.table(either.groupBy(F.col("grp").alias("face_grp"), F.col("blk").alias("face_blk")).agg(F.collect_list("pair").alias("faces")), "faces")


def jaccard_classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, target_recall: float = TARGET_RECALL) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, row_key, text_hash, class_id (smallest doc_id of the documents that links reach), n_links (other documents
    of Jaccard similarity `similarity` or more over 5-word shingles), n_copies (documents with the same shingles, itself included), kept (one document of
    each class).

    Null or empty texts, and texts without words, link with nothing. Rows without a doc_id take part; their class_id is null if no row of the class has one.
    Rows that repeat a document are copies. Other columns are ignored. An empty table gives none.
    """
    work = Workspace(spark, "ngram")
    middle = prefix_length(similarity, trees, FULL, target_recall)
    lengths = (min(SHORT, middle - 1), middle) if middle > 1 else (1, 2)
    signed = work.table(_keyed(docs).mapInArrow(_sign(trees, lengths), SIGNED), "signed")
    grouped = signed.where("n > 0").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("row_key").alias("rep"), *(F.any_value(c).alias(c) for c in ("short", "middle")))
    classes = work.table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    under = mates_of(classes, work)
    shared = under.groupBy("trie").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("trie").alias("shared_trie"), "least")
    stars = under.join(shared, F.col("trie") == F.col("shared_trie")).where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    near = components(stars, work)
    roots = near.select(F.col("component").alias("node"), "component").distinct()
    members = near.union(roots).withColumnRenamed("component", "grp")
    members = work.table(blocked(members, members.groupBy("grp").agg(F.count("*").alias("size")), BLOCK, work), "members")
    n_members = members.count()
    if n_members:
        tries = under.groupBy(F.col("node").alias("trie_node")).agg(F.array_sort(F.collect_set("trie")).alias("tries"))  # one for each tree
        known = members.join(classes.select(F.col("node").alias("class_node"), "h1", "h2", "rep", "copies"), F.col("node") == F.col("class_node")).drop("class_node")
        known = known.join(tries, F.col("node") == F.col("trie_node")).drop("trie_node")
        found = _keyed(docs).select("row_key", "text").join(small(known, n_members), F.col("row_key") == F.col("rep"))
        sets = found.select("text", "h1", "h2", "node", "grp", "blk", "blks", "copies", "tries").mapInArrow(_fetched, "node long, grp long, blk int, blks int, copies long, tries array<long>, shingles binary")
        faced = facing_blocks(members.where("blks > 1"), under, work)
        sides = F.explode(F.coalesce("faces", F.array(F.struct(F.lit(0).alias("left_block"), F.lit(0).alias("right_block"))))).alias("face")
        dealt = sets.join(small(faced, faced.count()), (F.col("grp") == F.col("face_grp")) & (F.col("blk") == F.col("face_blk")), "left").where("blks = 1 OR faces IS NOT NULL")
        dealt = dealt.select("node", "grp", "blk", "blks", "copies", "tries", "shingles", sides).select("*", "face.*").drop("face")
        lots = max(1, n_members // 512)
        lot = F.when(F.col("blks") == 1, F.pmod(F.xxhash64("grp"), F.lit(lots))).otherwise(-1 - F.col("grp"))
        verified = dealt.withColumn("lot", lot).groupBy("lot", "left_block", "right_block").applyInPandas(_verify(similarity), "src long, dst long, n long")
        links = work.table(verified, "links")
    else:
        links = spark.createDataFrame([], "src long, dst long, n long")
    reached = components(links.where("dst IS NOT NULL"), work)
    counts = links.where("n IS NOT NULL").groupBy(F.col("src").alias("count_node")).agg(F.sum("n").alias("links"))
    joined = classes.select("node", "h1", "h2", "copies", "rep").join(reached.withColumnRenamed("node", "reached_node"), F.col("node") == F.col("reached_node"), "left").withColumn("root", F.coalesce("component", "node"))
    joined = joined.join(counts, F.col("node") == F.col("count_node"), "left")
    joined = work.table(joined.select("root", F.col("h1").alias("c1"), F.col("h2").alias("c2"), "copies", "rep", F.coalesce("links", F.lit(0)).alias("links")), "joined")
    keepers = joined.groupBy(F.col("root").alias("keeper_root")).agg(F.min("rep").alias("keeper"))
    whole = joined.join(keepers, F.col("root") == F.col("keeper_root"))
    rows = signed.drop("short", "middle").join(whole, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") > 0), "left")
    keeper = F.coalesce("keeper", "row_key")
    return rows.select("doc_id", "row_key", "text_hash", F.when(keeper < (1 << 62), keeper).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), (F.col("row_key") == keeper).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` that `classes` keeps: one of each class. Of rows equal in id and text, one stays."""
    kept = Workspace(spark, "kept").table(classes.where("kept").groupBy(F.col("row_key").alias("keep_key"), F.col("text_hash").alias("keep_hash")).agg(F.count("*").alias("keep_n")), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("a"), F.xxhash64("text").alias("b"))
    found = rows.join(small(kept, kept.count(), 2_000_000), (F.col("a") == F.col("keep_key")) & (F.col("b") == F.col("keep_hash")))
    if kept.where("keep_n > 1").isEmpty():
        return found.select("row.*")
    once = found.where("keep_n > 1").groupBy("a", "b").agg(F.any_value("row").alias("row"))
    return found.where("keep_n = 1").select("row.*").union(once.select("row.*"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "text_hash")
