import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import ngram_join, packing, token_counts, token_files, tokens, workers
from quern.llm.tokens import PieceEncoder, public_path

NAMES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ENCODERS = {n: PieceEncoder(public_path(n), s) for n, s in NAMES.items()}


def library(name, text):
    return ENCODERS[name].tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c 　.,'’sé1<|>́​᠎\x85abCDÉ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_ids_are_those_of_the_library(name, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODERS[name].encode(texts)] == [library(name, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(counts):
    plan = packing.best_two_fit(counts, 60)
    placed = Counter()
    for bin_, times in plan:
        assert sum(bin_) <= 60 and times > 0
        for n in bin_:
            placed[n] += times
    assert placed == Counter(counts)
    bins, total = sum(t for _, t in plan), sum(n * c for n, c in counts.items())
    # no piece left over fits what a bin leaves free, nor does one that was replaced; so any two bins hold more than one's capacity
    assert 60 * bins < 2 * total + 60 if counts else bins == 0


def test_two_fit_beats_the_greedy_fill():
    # greedy leaves 60 + 25 with 15 to spare; 20 + 20 fits the widened gap of 40 exactly
    assert (sorted([60, 20, 20]), 1) in [(sorted(b), t) for b, t in packing.best_two_fit({60: 1, 25: 1, 20: 2}, 100)]


def test_pack_refuses_ids_of_more_than_16_bits(spark):
    with pytest.raises(Exception, match="more than 16 bits"):
        packing.pack(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), end_id=70_000).count()


def test_pack(spark, odd_docs):
    rows = packing.pack(spark, odd_docs, capacity=64).collect()
    assert len({(r.doc_id, r.piece, r.ids_crc32, r.sequence_id, r.offset) for r in rows}) == len(rows)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    for held in placed.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    docs = odd_docs.collect()
    want = Counter()
    for d in docs:
        ids = library("byte_bpe_50k.json", d.text) + [2]
        first = (len(ids) - 1) % 64 + 1
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            e = first if k == 0 else a + 64
            want[d.doc_id, k, a, e - a, zlib.crc32(np.array(ids[a:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = packing.sequences(packing.pack(spark, odd_docs, capacity=64)).collect()
    assert all(len(h.ids) == 2 * h.n_tokens == 2 * sum(p.length for p in h.pieces) for h in held)


def test_pack_nothing(spark, no_docs):
    assert packing.pack(spark, no_docs).count() == 0


def test_token_files(spark, odd_docs, tmp_path):
    path = f"{tmp_path}/ids"
    token_files.write_token_files(spark, odd_docs, path, files=3)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in odd_docs.collect()), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
    want = Counter((d.doc_id, tuple([*library("word_bpe_49k.json", d.text), 1])) for d in odd_docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    few = token_files.read_token_files(spark, path, 3, 5)
    assert sorted(r.doc_id for r in few.collect()) == [3, 4, 5]
    scans = [line for line in few._jdf.queryExecution().toString().splitlines() if "PushedFilters" in line and "GreaterThanOrEqual(doc_id,3)" in line and "LessThanOrEqual(doc_id,5)" in line]
    assert scans
    meta = pq.ParquetFile(next(p for p in sorted((tmp_path / "ids").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)).metadata
    ids = next(meta.row_group(0).column(k) for k in range(meta.num_columns) if meta.row_group(0).column(k).path_in_schema.startswith("ids"))
    assert ids.has_column_index and ids.has_offset_index and "RLE_DICTIONARY" in ids.encodings


def test_delta_pages_and_many_rows_of_one_id(spark, tmp_path):
    docs = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_files.write_token_files(spark, docs, f"{tmp_path}/ids", files=6)
    files = [pq.ParquetFile(p).metadata for p in sorted((tmp_path / "ids").glob("*.parquet"))]
    columns = [m.row_group(g).column(k) for m in files for g in range(m.num_row_groups) for k in range(m.num_columns)]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "doc_id")
    assert max(m.num_rows for m in files) < 20_000  # though 20,001 rows have the id 7
    rows = token_files.read_token_files(spark, f"{tmp_path}/ids").select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == 60_000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_numbers_of_files():
    assert [token_files.file_count(n, 8) for n in (0, 1, 5 << 20, 1 << 30, 100 << 40)] == [1, 1, 2, 32, 409_600]


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    token_files.write_token_files(spark, no_docs, f"{tmp_path}/ids")
    assert token_files.read_token_files(spark, f"{tmp_path}/ids").count() == 0


def test_token_counts(spark, odd_docs):
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(odd_docs)).persist()
    lengths = sorted(len(library("byte_bpe_50k.json", d.text)) for d in odd_docs.collect())
    rows = {r.length: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.tokens_cut_at == sum(min(x, n) for x in lengths) and (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    for q in (0.01, 0.5, 0.9, 1):
        assert token_counts.quantile(sums, q).first()[0] == lengths[max(0, int(np.ceil(q * len(lengths))) - 1)]


def test_token_counts_of_nothing(spark, no_docs):
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(no_docs))
    assert sums.count() == 0 and token_counts.truncated_total(sums, 5).first()[0] == 0


def test_a_worker_keeps_one_operator_at_a_time():
    encoder = tokens.encoder(tokens.public_path("word_bpe_49k.json"), False)
    workers.works_for("tokens")
    assert tokens.encoder(tokens.public_path("word_bpe_49k.json"), False) is encoder
    workers.works_for("language_id")
    assert not tokens._ENCODERS
    ngram_join.shingle_sets(np.frombuffer(b"a b c d e f", dtype=np.uint8), np.array([0, 11]))
    assert len(ngram_join._POWERS[0])
    workers.works_for("tokens")
    assert not len(ngram_join._POWERS[0])
    assert len(ngram_join.shingle_sets(np.frombuffer(b"a b c d e f", dtype=np.uint8), np.array([0, 11]))[0]) == 2


def test_words_are_remembered_once_where_spaces_are_dropped():
    enc = tokens.PieceEncoder(tokens.public_path("word_bpe_49k.json"), False)
    text = "Lorem lorem ipsum, ipsum. Käse käse,\nlorem. c3po c3po, -- --, ǅ ǆ. İx ix,"
    assert enc.encode([text, text])[1] == np.array(enc._one(text), dtype="<u4").tobytes()
    assert not enc.words and {"lorem", "ipsum", "käse"} <= set(enc.memo)


def test_new_words_are_learned_once_whatever_their_capitals():
    enc = tokens.PieceEncoder(tokens.public_path("word_bpe_49k.json"), spaced=False)
    texts = ["Straßenzug straßenzug STRASSENZUG, Zug. zUG", "Σίγμας ΣΊΓΜΑΣ İz Kelvin K 'S it'S $$$, Ꭰ ª.", None]
    want = [np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert "straßenzug" in enc.memo and "Straßenzug" not in enc.memo
    enc.entries = 4
    assert enc.encode(texts[:1]) == want[:1]  # starts again
    enc.entries = 2 * len(enc.memo)
    assert enc.encode(texts) == want
    enc.entries = len(enc.memo) - 1
    learned = dict(enc.memo)
    enc.encode([""])
    assert enc.memo["zug"] == learned["zug"] and "straßenzug" not in enc.memo  # short pieces stay


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["the", "Käse", "ſt", "s", "1", "$$$", ",%%%", "'", "'s", ".###", "!!", " ", "\n", "\t", "<|endoftext|>", "\ue000", "_", "…", "x" * 70]), max_size=20).map("".join)), max_size=5), entries=st.sampled_from([0, 5, 1000]))
def test_ids_of_words_before_signs_are_those_of_the_library(texts, entries):
    name = "byte_bpe_50k.json"
    enc = tokens.encoder(public_path(name), True)
    enc.entries = entries
    want = [library(name, t) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pa.array(["cut off", *texts], pa.large_string()).slice(1))] == want


def test_distinct_pieces_are_looked_up_once_where_spaces_are_kept():
    enc = PieceEncoder(public_path("byte_bpe_50k.json"), spaced=True)
    asked, waited, wait = Counter(), [], enc._learn_waiting

    class Asked(tokens._Memo):
        def __getitem__(self, piece):
            asked[piece] += 1
            return super().__getitem__(piece)

    enc.memo = Asked(enc._learn)
    enc._learn_waiting = lambda: waited.extend(enc.waiting) or wait()
    text = "\nLorem ipsum ipsum, lorem###\nIpsum,%%% Käse!! käse" * 50
    assert enc.encode([text, text]) == [np.array(enc._one(text), dtype="<u4").tobytes()] * 2
    assert asked and max(asked[p] for p in asked if p not in waited) == 1
    assert set(waited) <= {("",)}  # words before signs need not wait
    assert set(enc.words) == {"Lorem", "Ipsum"} and "ipsum" in enc.memo  # a word after a space is remembered once
