"""The five stages of the pipeline, each on its own input, and run() against plain Python versions of them."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import language_id, tokens
from test_near import brute, lev, shingles

STRANGE = {9001: None, 9002: "", 9003: "123 456 789", 9004: "漢字かな交じり文の例です。これは日本語です。" * 20}
NEAR_LINES = range(9100, 9106)
COPIES = range(9200, 9204)


def plain_counts(text):
    """Bucket counts of the one to three byte grams of a text."""
    raw = text.encode()
    letters = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    padded = b" " + letters + b" "
    held = Counter()
    for n, base in ((1, 0), (2, 1 << 18), (3, 1 << 26)):
        for k in range(len(padded) - n + 1) if n > 1 else range(1, len(padded) - 1):
            gram = 0
            for b in padded[k : k + n]:
                gram = (gram * 257 + b) % 2**32
            held[((gram + base) * 2654435761 % 2**32) >> 20] += 1
    return held


def plain_vector(text, idf):
    v = {b: math.log1p(n) * float(idf[b]) for b, n in plain_counts(text).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / size for b, x in v.items()}


def plain_language(docs, model):
    """Documents that are not rejected: with a letter, and near enough to a centroid for their length."""
    kept = []
    for r in docs:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            continue
        v = plain_vector(r["text"], model.idf)
        best = max(sum(x * float(c[b]) for b, x in v.items()) for c in model.centroids)
        size = sum(plain_counts(r["text"]).values()) / 3
        least = np.interp(math.log(max(size, 1)), np.log(language_id.CUTS), model.reject_below)
        assert abs(best - least) > 1e-5
        if best > least:
            kept.append(r)
    return kept


def plain_lines(docs):
    """Of equal lines the first stays; of those, lines of 24 characters within two edits of an earlier one go too."""
    seen, earlier, out = set(), [], []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        if r["text"] is None:
            out.append(r)
            continue
        left, gone = [], 0
        for line in r["text"].split("\n"):
            if line.strip(" "):
                if line in seen:
                    gone += 1
                    continue
                seen.add(line)
                if len(line) >= 24:
                    held = np.bincount([ord(c) % 97 for c in line], minlength=97)
                    near = any(abs(len(line) - len(o)) <= 2 and np.abs(held - h).sum() <= 4 and lev(line, o) <= 2 for o, h in earlier if abs(len(line) - len(o)) <= 2)
                    earlier.append((line, held))
                    if near:
                        gone += 1
                        continue
            left.append(line)
        if not gone or any(s.strip(" ") for s in left):
            text = "\n".join(left)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_groups(docs):
    """The document of the smallest id of each group of near copies."""
    rows = [(r["doc_id"], r["text"]) for r in docs]
    classes = brute(rows)
    return [r for k, r in enumerate(docs) if not shingles(r["text"]) or classes[k][1] == r["doc_id"]]


def plain_mix(docs, labels):
    """Documents as often as a mix of 1.5 times all words takes them: epochs of their source, and the nearest prefix by key."""
    size = lambda r: sum(1 for w in r["text"].translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w) if r["text"] else 0
    of = defaultdict(list)
    for r in docs:
        of[r["source"]].append(r)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(map(size, of[s])) for s in order}
    share = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, open_, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(goal.values())) / sum(share[s] for s in open_) if open_ else 0
        full = {s for s in open_ if share[s] * level > 2 * sizes[s]}
        if not full:
            break
        goal |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    goal |= {s: share[s] * level for s in open_}
    good = defaultdict(list)
    for r in labels:
        if r["quality"] is not None:
            good[r["doc_id"]].append(r["quality"])

    def key(r):
        uniform = (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) + 1) / 2**52
        marks = good.get(r["doc_id"])
        return -math.log(uniform) / (1 if marks is None else 2 if sum(marks) >= 0.5 * len(marks) else 0.5)

    out = []
    for s in order:
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, upto = goal[s] - epochs * sizes[s], 0
        for r in sorted(of[s], key=key):
            upto += size(r)
            once = rest > 0 and upto - rest <= rest - (upto - size(r))
            out += [r] * min(2, epochs + once)
    return out


def plain_pieces(docs):
    from tokenizers import Tokenizer

    model, out, known = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json")), Counter(), {}
    for r in docs:
        text = r["text"] or ""
        if text not in known:
            known[text] = [*model.encode(text, add_special_tokens=False).ids, 2]
        ids = known[text]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    return out


def plain_bins(lengths):
    """How many bins best-two-fit fills, piece by piece; of pairs that fit equally well, that with the smallest piece."""
    left, bins = sorted(lengths), 0
    while left:
        held, bins = [], bins + 1
        while fitting := [n for n in left if n <= 1024 - sum(held)]:
            held.append(fitting[-1])
            left.remove(fitting[-1])
        room = 1024 - sum(held[:-1])
        if sum(held) < 1024 and len(held) > 1:
            pairs = [(a + b, -a) for k, a in enumerate(left) for b in left[k + 1 :] if held[-1] < a + b <= room]
            if pairs:
                both, a = max(pairs)
                left.remove(-a)
                left.remove(both + a)
                left = sorted([*left, held[-1]])
    return bins


def held_pieces(packed):
    rows = packed.collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) == plain_bins(r.length for r in rows)
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


@pytest.fixture(scope="module")
def planted(spark, data, tmp_path_factory):
    """A folder with documents, among them rejects, near lines and near copies, and labels."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text for r in docs.where(F.length("text") > 600).orderBy("doc_id").limit(12).collect()]
    rows = list(STRANGE.items())
    long_lines = [s for t in texts for s in t.split("\n") if len(s) >= 60]
    for k, doc_id in enumerate(NEAR_LINES):
        line = long_lines[k]
        at = rng.randrange(5, len(line) - 5)
        near = [line[:at] + "?" + line[at + 1 :], line[:at] + line[at + 2 :], line[:at] + "ß_" + line[at:], "q" + line[1:-1], line[:-1] + "??", line[:at] + "?!?" + line[at + 3 :]][k]
        rows.append((doc_id, near + "\n" + " ".join(rng.sample(texts[k].split(), 20))))
    for k, doc_id in enumerate(COPIES):
        words = " ".join(texts[k].split())
        rows.append((doc_id, words if k % 2 else words.replace(words.split(" ")[3], "other", 1)))  # line breaks gone, so lines differ and shingles hardly
    more = spark.createDataFrame([(i, t, None, rng.choice(["src0", None]), len(t or "")) for i, t in rows], docs.schema)
    path = str(tmp_path_factory.mktemp("planted"))
    docs.union(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def plain_rows(frame):
    return [r.asDict() for r in frame.collect()]


def same(found, want):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, plain_rows(found))) == sorted(map(key, want))


def test_run_equals_plain_stages(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    labels = plain_rows(spark.read.parquet(f"{planted}/labels.parquet"))
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    plain = [lambda rows: plain_language(rows, model), plain_lines, plain_groups, lambda rows: plain_mix(rows, labels)]
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain, strict=False):
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out, before = spark.read.parquet(f"{tmp_path}/{name}"), plain_rows(docs)
        same(out, version(before))
        ids = {r.doc_id for r in out.collect()}
        if name == "language_id":
            assert ids == {r["doc_id"] for r in before} - set(STRANGE) - {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")}
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in out.collect()}
            assert ["\n" in texts[i] for i in NEAR_LINES] == [False] * 5 + [True]  # the last is three edits away
        if name == "ngram_join":
            assert not ids & set(COPIES)
        docs = out
    want = plain_pieces(plain_rows(docs))
    assert held_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, planted)) == want
    assert held_pieces(corpus_pipeline.run(spark, planted)) == want
