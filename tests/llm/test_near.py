import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import embedding_dedup, line_dedup, ngram_join
from quern.llm.graph import components
from quern.llm.storage import Workspace


def shingles(text):
    # ASCII letters fold, and only ASCII white space separates words
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    w = [x for x in folded.split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """{index: (links, class)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    links = {k: [j for j in range(len(rows)) if j != k and sets[k] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in range(len(rows))}
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[k] = (len(links[k]), min(ids) if ids else None)
    return out


def held_against_brute(spark, docs):
    found = ngram_join.jaccard_classes(spark, docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(rows[k][0]), n, str(c)) for k, (n, c) in brute(rows).items())
    assert sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in found) == want


def test_ngram_join_of_odd_rows(spark, odd_docs, no_docs):
    held_against_brute(spark, odd_docs)
    assert ngram_join.jaccard_classes(spark, no_docs).count() == 0


def test_ngram_join_of_a_table(spark, data):
    held_against_brute(spark, spark.read.parquet(f"{data}/documents.parquet"))


def test_ngram_join_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices(words, k=80)) for _ in range(20)]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    held_against_brute(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_keep_one(spark, odd_docs):
    kept = ngram_join.keep_one(spark, odd_docs, ngram_join.jaccard_classes(spark, odd_docs))
    assert kept.columns == odd_docs.columns
    sets = [shingles(r.text) for r in kept.collect()]
    full = [s for s in sets if s]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(full) for b in full[:k])
    assert {frozenset(s) for s in sets} >= {frozenset(shingles(t)) for t in ("one", "two words", "1234 5678")}


def test_prefixes_shorten_to_the_target():
    d = ngram_join.prefix_length(0.8, 32, 12, 0.999)
    assert 1 - (1 - 0.8**d) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 32


def test_crowded_nodes_keep_the_prefix_of_the_target(spark):
    # classes 0 to 19 crowd the first tree; 20 to 29 share its node by fives and crowd the second
    rows = [(k, [1 if k < 20 else 5 + k // 25, 3 if k >= 20 else 100 + k], [10 + k % 2 if k < 20 else 30 + k, 50 + k // 25 if k >= 20 else 200 + k]) for k in range(30)]
    classes = spark.createDataFrame(rows, "node long, short array<long>, middle array<long>")
    found = {(r.node, r.trie) for r in ngram_join.mates_of(classes, Workspace(spark, "test")).collect()}
    assert found == {(k, 10 + k % 2) for k in range(20)} | {(k, 5 + k // 25) for k in range(20, 30)} | {(k, 50 + k // 25) for k in range(20, 30)}


def test_lines_whose_hashes_collide(spark, monkeypatch):
    """With hashes that most lines share, each line is still a line of its own."""
    rng = random.Random(8)
    lines = ["".join(rng.choices("abcdefghij klmno", k=rng.choice((40, 41, 42)))) for _ in range(80)]
    lines += [w[:7] + "#" + w[8:] for w in lines[:30]]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(lines)], "doc_id long, text string")
    want = sorted((r.row.doc_id, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark, docs).collect())
    assert sum(n for _, _, n in want) == 30
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.length(line).cast("long"))
    assert sorted((r.row.doc_id, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark, docs).collect()) == want


def planted_groups(rng, left, right, n_words=193):
    """Texts of two groups of near copies; every text of one group is at a similarity of 0.80 to 0.81 to every text of the other."""
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3 * n_words)]
    base = words[:n_words]  # 190 shingles with the last word
    other = list(base)
    for at in (10, 40, 70, 110):  # each takes five shingles away: 169 of 211 are shared
        other[at] = words[n_words + at]
    groups = []
    for side, n in ((base, left), (other, right)):
        groups.append([" ".join([*side, words[2 * n_words + 20 * len(groups) + k]]) for k in range(n)])
    return groups


@pytest.mark.parametrize(("left", "right"), [(5, 5), (1, 8), (8, 8)])
def test_recall_between_groups_of_near_copies(spark, left, right):
    """Groups whose members crowd nodes exactly where they meet: nearly all of their links are found, and nearly no pair of groups is split."""
    rng = random.Random(left * 10 + right)
    pairs = [planted_groups(rng, left, right) for _ in range(60)]
    similarity = {round(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)), 3) for p in pairs[:3] for a in p[0] for b in p[1]}
    assert 0.8 <= min(similarity) <= max(similarity) < 0.815
    texts = [t for p in pairs for group in p for t in group]
    found = ngram_join.jaccard_classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    each = left + right
    links = sum(r["n_links"] for r in found) - len(pairs) * (left * (left - 1) + right * (right - 1))
    assert links >= 0.99 * len(pairs) * 2 * left * right
    assert len({r["class_id"] for r in found}) <= len(pairs) + 1
    assert sum(r["kept"] for r in found) <= len(pairs) + 1 and len(found) == each * len(pairs)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    found = components(spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long"), Workspace(spark, "test")).collect()
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.component for r in found} == {n: c for n, c in parent.items() if n != c}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance(spark, t):
    rng = random.Random(t)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choices("abé", k=rng.randint(t, 12)))
        b = list(a)
        for _ in range(rng.randint(0, t + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
        if len(b) >= t and abs(len(a) - len(b)) <= t:
            pairs.append((a, "".join(b)))
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), t).alias("d")).collect()
    for r in found:
        d = lev(r.a, r.b)
        assert r.d == d if d <= t else r.d > t, (r, d)


def brute_lines(rows):
    lines = sorted(((i is None, i or 0, t, k, line) for i, t in {(r.doc_id, r.text) for r in rows} for k, line in enumerate((t or "").split("\n") if t is not None else []) if line.strip(" ")), key=lambda x: (x[0], x[1]))
    return lines


@pytest.mark.parametrize("few", [500, 1])
def test_line_dedup(spark, no_docs, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", few)  # pairs for each line of a key; small: keys are divided again and again
    rng = random.Random(5)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n)).strip()
    pool = [line(rng.randint(24, 60)) for _ in range(60)]

    def varied(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choices("abcdefgh", k=rng.randint(0, 1))
        return "".join(s)

    docs = [(k, "\n".join([varied(rng.choice(pool)) for _ in range(8)] + ["", "short"])) for k in range(40)] + [(50, None), (51, ""), (52, "short\n\nshort")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen, kept_lines, want = set(), [], {}
    for doc_id, text in docs:
        n, left = [0, 0], []
        for s in text.split("\n") if text is not None else []:
            if s.strip(" ") and s in seen:
                n[0] += 1
                continue
            if s.strip(" "):
                seen.add(s)
                if len(s) >= 24:
                    close = any(abs(len(s) - len(o)) <= 2 and lev(s, o) <= 2 for o in kept_lines)
                    kept_lines.append(s)
                    if close:
                        n[1] += 1
                        continue
            left.append(s)
        want[doc_id] = (*n, None if text is None else "\n".join(left))
    found = line_dedup.dedup_lines(spark, frame).collect()
    assert {r.row.doc_id: (r.n_exact, r.n_near, r.cleaned) for r in found} == want
    assert sum(w[1] for w in want.values()) > 20
    assert line_dedup.dedup_lines(spark, no_docs).count() == 0


def test_near_lines_that_differ_in_a_character_of_any_class(spark):
    rng = random.Random(6)
    odd = [chr(c) for c in range(32, 127)] + list("ß\u00ffàÿ漢\U0001f600")
    pairs = []
    for c in odd:
        s = "".join(rng.choices("abcdefgh", k=40))
        pairs += [(s, s[:20] + c + s[20:]), (s[::-1], s[::-1][:20] + c + s[::-1][21:])]
    for c, d in ("?.", "ßs", "_b"):
        s = "".join(rng.choices("abcdefgh", k=40))
        pairs.append((s[:30] + c + s[30:], s[:30] + d + s[30:]))
    lines = [line for pair in pairs for line in pair]
    assert len(set(lines)) == len(lines)
    want = {k: sum(abs(len(s) - len(o)) <= 2 and lev(s, o) <= 2 for o in lines[:k]) > 0 for k, s in enumerate(lines)}
    found = line_dedup.dedup_lines(spark, spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.n_near == 1 for r in found} == want
    assert sum(want.values()) == len(pairs)


def test_a_segment_that_thousands_of_lines_share(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    lines = [f"{word(40)} the same ending of very many lines" for _ in range(3000)]
    near = [s[:10] + "#" + s[11:] for s in lines[:20]] + [s[:12] + s[14:] for s in lines[20:40]]
    copies = ["no line has " + "".join(c if k not in at else "#" for k, c in enumerate("the same beginning of near copies")) for at in ({a, b} for a in range(33) for b in range(a))]
    docs = spark.createDataFrame(list(enumerate(lines + near + copies)), "doc_id long, text string")
    found = {r.row.doc_id: r.n_near for r in line_dedup.dedup_lines(spark, docs).collect()}
    assert [k for k in range(3040) if found[k]] == list(range(3000, 3040))
    want = [any(lev(s, o) <= 2 for o in copies[:k]) for k, s in enumerate(copies)]
    assert [found[3040 + k] == 1 for k in range(len(copies))] == want


def test_line_dedup_of_a_text_of_very_many_lines(spark):
    many = "\n".join(f"line {k % 50_000} of a text" for k in range(100_000))
    rows = line_dedup.dedup_lines(spark, spark.createDataFrame([(1, many), (2, "line 7 of a text\nnew")], "doc_id long, text string"), least_chars=1000).orderBy("row.doc_id").collect()
    assert [(r.n_lines, r.n_exact, r.n_near) for r in rows] == [(100_000, 50_000, 0), (2, 1, 0)]
    assert rows[0].cleaned == "\n".join(many.split("\n")[:50_000]) and rows[1].cleaned == "new"


def test_line_dedup_of_odd_rows(spark, odd_docs):
    found = line_dedup.dedup_lines(spark, odd_docs)
    assert found.count() == odd_docs.count()
    once = [s for r in {(r.row.doc_id, r.row.text): r.cleaned for r in found.collect()}.values() if r for s in r.split("\n") if s.strip(" ")]
    assert len(once) == len(set(once))
    left = line_dedup.apply_line_dedup(odd_docs, found)
    assert left.columns == odd_docs.columns and left.schema["doc_id"].dataType == odd_docs.schema["doc_id"].dataType


def brute_vectors(rows):
    good = [k for k, (_, label, e) in enumerate(rows) if label is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = {k: [] for k in range(len(rows))}
    for k in good:
        for j in good:
            if j != k and rows[k][1] == rows[j][1] and len(rows[k][2]) == len(rows[j][2]):
                a, b = np.array(rows[k][2], float), np.array(rows[j][2], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[k].append(j)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((str(rows[k][0]), len(links[k]), str(c), rows[k][0] == c))
    return sorted(out)


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(k, int(rng.integers(0, 3)), (centres[rng.integers(0, 12)] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.5])).tolist()) for k in range(500)]
    rows += [(600 + k, 0, centres[0].tolist()) for k in range(5)] + [(600, 0, centres[0].tolist())]
    rows += [(700, None, centres[0].tolist()), (701, 0, None), (702, 0, [0.0] * 16), (703, 0, [float("nan")] * 16), (704, 0, [None] + [1.0] * 15), (705, 1, [1.0, 2.0]), (706, 1, [1.0, 2.0]), (707, 2, []), (None, 0, centres[0].tolist()), (None, 1, [9.0]), (708, 0, [float("inf")] + [1.0] * 15)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, node string")
    rows = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    monkeypatch.setattr(embedding_dedup, "BASE_BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "PROBE_BLOCK", 16)
    found = embedding_dedup.link_embeddings(spark, frame, target_recall=1).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found) == brute_vectors(rows)
    assert embedding_dedup.link_embeddings(spark, frame.limit(0)).count() == 0


def test_embedding_recall_of_a_tight_group_beside_loose_pairs(spark):
    rng = np.random.default_rng(9)
    vectors = [rng.normal(size=24) for _ in range(900)]
    centre = rng.normal(size=24)
    vectors += [centre + rng.normal(size=24) * 0.005 for _ in range(600)]  # one tight group
    vectors += [v + rng.normal(size=24) * 0.19 for v in vectors[:500]]  # pairs near the threshold
    rows = [(k, int(rng.integers(0, 2)) if k < 900 else 0, v.tolist()) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.link_embeddings(spark, frame).collect()}
    x = np.array([r.embedding for r in frame.orderBy("vec_id").collect()], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows])
    links = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    loose = [k for k in range(len(rows)) if not 900 <= k < 1500]
    assert sum(want[k] for k in loose) > 100
    assert [found[k] for k in range(len(rows))] == want.tolist()


@given(st.text(alphabet="abcdeé?_ 😀", min_size=2, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abz?é😀"), st.sampled_from("isd")), max_size=2))
@settings(max_examples=60, deadline=None)
def test_pair_parities_allow_for_edits(spark, line, edits):
    near = line
    for at, c, kind in edits:
        at = min(at, len(near))
        near = near[:at] + ("" if kind == "d" else c) + near[at + (kind != "i") :]
    sign = lambda c: F.struct(F.length(c).alias("size"), line_dedup.parities(F.col(c)).alias("parity"), line_dedup.pair_parities(F.col(c)).alias("beside"))
    signs = spark.createDataFrame([(line, near)], "a string, b string").select(sign("a").alias("a"), sign("b").alias("b"))
    flat = signs.select(*(F.col(f"{c}.{s}").alias(f"{c}_{s}") for c in "ab" for s in line_dedup.SIGNS))
    assert flat.select(line_dedup.may_be_near("a", "b", max(len(edits), 1))).first()[0]


def test_line_dedup_verifies_few_pairs_of_a_group(spark, monkeypatch):
    rng = random.Random(17)
    start = "".join(rng.choices("abcdefgh ijklmnop", k=60))
    lines = [start + "".join(rng.choices("abcdefgh ijklmnop", k=80)) for _ in range(60)]
    lines.append(lines[7][:100] + "Q" + lines[7][101:])
    asked, within = [], line_dedup.within

    def counted(pairs, texts, n_pairs, *rest):
        asked.append(pairs.count())
        return within(pairs, texts, n_pairs, *rest)

    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 1000)  # so that all lines that share a segment meet
    monkeypatch.setattr(line_dedup, "within", counted)
    found = line_dedup.dedup_lines(spark, spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.row.doc_id for r in found if r.n_near} == {60}
    assert sum(asked) <= 60  # not the 1,830 pairs that share the start
