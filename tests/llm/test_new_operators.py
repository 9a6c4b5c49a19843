"""Whitening, personal data and ranked search against plain Python and numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import pii, queries, search, whitening
from tallymark.llm.common import table, word_batch

FOLDER = "/root/testdata/sf0.001"

# ---- whitening -----------------------------------------------------------------------


def covariance(vectors):
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    off = np.array([[float(a * n - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    return n, sums, off, off.T @ off / n


def compare_whitening(rows, vectors, components=16):
    """rows: results; vectors: id to a finite vector."""
    n, sums, _, v = covariance(vectors.values())
    values = np.linalg.eigvalsh(v)[::-1]
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r.vec_id][r.component] = r
    k = min(components, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    assert set(by_id) == (set(vectors) if k else set())
    whitened = {}
    for i, vector in vectors.items():
        got = by_id[i]
        assert sorted(got) == list(range(1, k + 1))
        x = [math.floor(64 * c) + 1_000_000 for c in vector]
        assert {r.n for r in got.values()} == {n}
        assert {r.deviation for r in got.values()} == {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))}
        for c, r in got.items():
            assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-4)
            assert r.identity_error <= 1e-4
        whitened[tuple(x)] = [got[c].whitened for c in sorted(got)]
    w = np.array(list(whitened.values()))
    w = w - w.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8


def test_whitening_of_the_table(spark):
    vectors = {r.vec_id: r.embedding for r in table(spark, FOLDER, "embeddings").collect()}
    compare_whitening(queries.QUERIES["op11_embedding_whitening"](spark, FOLDER).collect(), vectors)


@pytest.mark.parametrize("dimension, rank, n", [(5, 5, 40), (40, 7, 60), (3, 1, 9), (60, 60, 200)])
def test_whitening_of_other_shapes(spark, dimension, rank, n):
    """Few dimensions, low rank, copies, and one direction a million times the others."""
    rng = np.random.default_rng(dimension)
    base = rng.integers(-9, 9, (n, rank)) @ rng.integers(-3, 4, (rank, dimension))
    base[:, 0] *= 1_000 if rank > 1 else 1
    vectors = {i: [float(c) / 64 for c in row] for i, row in enumerate(base.tolist())}
    vectors |= {n + i: vectors[0] for i in range(7)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    compare_whitening(whitening.embedding_whitening(frame).collect(), vectors)


def test_certified_pairs(spark):
    rows = table(spark, FOLDER, "embeddings").select(whitening.integer_vector(F.col("embedding")).alias("x"))
    basis, error = whitening.fit(rows, 3)
    x = np.unique(np.array([r.x for r in rows.collect()]), axis=0)
    off = x - x.mean(axis=0)
    v = off.T @ off / len(x)
    assert np.abs(v @ basis.vectors - basis.vectors * basis.values).max() < 1e-11 * basis.values[0]
    assert (basis.residuals <= 1e-11 * basis.values[0]).all() and error < 1e-12 and basis.passes > 3
    np.testing.assert_allclose(basis.vectors.T @ basis.vectors, np.eye(3), atol=1e-12)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]),
        (8, [3.0, 5.0]), (8, [3.0, 5.0]), (None, [0.0, 1e6]), (9, [-0.5, 2.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("own")).withColumn("n", F.lit(0))
    got = whitening.whiten(frame).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, 8: 4, None: 2, 9: 2}
    assert all(math.isfinite(r.whitened) and r.n == 4 for r in got)
    assert all(r.identity_error < 1e-4 for r in got)
    # Beside an entry of 2^50 nothing else can be told in doubles; its deviation exceeds 64 bits.
    huge = frame.withColumn("embedding", F.when(F.col("vec_id").isNull(), F.array(F.lit(0.0), F.lit(1e30))).otherwise(F.col("embedding")))
    got = whitening.embedding_whitening(huge).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (8, 1), (9, 1), (None, 1)}
    assert {r.deviation for r in got if r.vec_id is None} == {None}
    for few in ("vec_id = 99", "vec_id = 8"):
        assert whitening.embedding_whitening(frame.filter(few)).count() == 0


def test_deviations_are_exact():
    centre = whitening.Centre(3, [10, 2**60, -7])
    x = np.array([[5, 2**58, -2], [0, 0, 0]])
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, centre.sums, strict=True)) for row in x.tolist()]
    assert centre.deviations(x) == want and centre.deviations(x[:0]) == []


# ---- ranked search -------------------------------------------------------------------

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=10):
    counts = [(d, c, sum(c.values())) for d, text in docs if (c := Counter(terms(text)))]
    n, length = len(counts), sum(size for _, _, size in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, size in counts:
            m = 25 + 75 * size * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            scores.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k]):
            out.append((item, rank + 1, d, -score))
    return sorted(out, key=repr)


def ranked(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("index_terms", [1 << 20, 40])
def test_search_against_brute_force(spark, index_terms, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_SCORES", 50)
    rng = random.Random(4)
    words = ["ähre", "Été", "x1", "THE", "the", "of", "日本", "a_b", "z y", *[f"w{i}" for i in range(40)]]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i % 90, text(rng.choice([0, 1, 3, 30]))) for i in range(150)]
    docs += [(None, "THE of w1"), (500, None), (501, "!?"), (502, "w1 " * 4000), (503, "w1\x00w2\x7fw3")]
    items = [(i, text(rng.choice([1, 2, 9]))) for i in range(25)]
    items += [(1, items[1][1]), (1, "w3 w3 of"), (None, "the of"), (70, ""), (71, None), (72, "never seen")]
    got = search.search(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(7),
        spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("own")),
        index_terms=index_terms,
    )
    assert ranked(got) == ranking(docs, [x for x in items if x[1] is not None])


def test_search_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    got = ranked(queries.QUERIES["op13_ranked_search"](spark, FOLDER))
    assert got == ranking(docs, items) and max(r for _, r, _, _ in got) == 10


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.filter("doc_id > 1"), items).count() == 0
    assert search.search(docs, items.filter("item_id > 1")).count() == 0


# ---- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_of(text):
    return sorted(
        (m.start(), k, m.end())
        for k, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    )


def test_base_patterns_against_plain_expressions():
    rng = random.Random(9)
    pieces = ["a", "@", ".", "-", "+", "1", "2", "9", "25", "255", "300", " ", "(", ")", "4111 1111 1111 1111", "@b.c", "+1 (377) 555-0271", "1.2.3.4", "é"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == base_of(text), text
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 200_000, "." * 300_000):
        pii.base_spans(text)


def test_personal_data_of_the_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    got = queries.QUERIES["op12_personal_data"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_of(texts[r.doc_id])
        kinds = Counter(pii.KINDS[k] for _, k, _ in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in pii.KINDS]
        assert r.base_sha256 == pii.digest(base)
        said = r.spans.split(",") if r.spans else []
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(said)
        assert [int(s.split(":")[1]) for s in said] == sorted(int(s.split(":")[1]) for s in said)
    # The invented prose of the table holds nothing but plain forms and what stands beside them.
    assert sum(len(r.spans.split(",")) for r in got if r.spans) <= 1.02 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) + 1


@pytest.fixture(scope="module")
def field():
    return pii.train_field(pii.examples())


def labels_of(field, text):
    batch = word_batch(pa.array([text]), lower=False)
    return pii.Decoder(field).decode(batch.codes, batch.offsets, batch.words)


def test_held_out_sentences(field):
    """Sentences from another seed: other names, numbers and combinations."""
    good = found = there = 0
    for text, marked in pii.examples(seed=77, rows=400):
        base = pii.base_spans(text)
        got = {(pii.KINDS[k], a, b) for a, k, b in base + pii.added_spans(text, labels_of(field, text), base)}
        good, found, there = good + len(got & set(marked)), found + len(got), there + len(marked)
    assert good >= 0.95 * there and good >= 0.97 * found


@pytest.mark.parametrize("text, said", [
    ("please write to jane (at) example dot com today", "jane (at) example dot com"),
    ("E-Mail: karl [at] firma [dot] de bitte", "karl [at] firma [dot] de"),
    ("ring me on (377) 555-0271 before noon", "(377) 555-0271"),
    ("login from 2001:db8::7f, they said", "2001:db8::7f"),
    ("we met at home and talked about the dot on the map at 12:30", None),
    ("order 2390409500648961 of 2024-05-01 and version 1.2.3", None),
])
def test_other_spellings(field, text, said):
    base = pii.base_spans(text)
    assert [text[a:b] for a, _, b in pii.added_spans(text, labels_of(field, text), base)] == ([said] if said else [])


def test_stretches_have_their_best_paths(field):
    """Batches against Viterbi over each stretch by itself, and that against all paths."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 4):
        emit, between = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))

        def value(path, emit=emit, between=between):
            return sum(emit[t, y] for t, y in enumerate(path)) + sum(between[a, b] for a, b in zip([0, *path], [*path, 0], strict=True))

        assert max(np.ndindex(*[3] * n), key=value) == tuple(pii.best_path(emit, between))
    decoder = pii.Decoder(field)
    sizes = rng.integers(1, 40, 30)
    start = np.cumsum(sizes) - sizes
    emit = rng.normal(size=(sizes.sum(), field.labels)) * 3
    got = decoder._paths(emit, start, sizes)
    for a, n in zip(start, sizes, strict=True):
        assert got[a : a + n].tolist() == pii.best_path(emit[a : a + n], field.between).tolist()


def test_batches_do_not_matter(field):
    texts = [t for t, _ in pii.examples(seed=5, rows=60)] + ["", None, "at", "x" * 5000 + " 1"]
    batch = word_batch(pa.array(texts, pa.string()), lower=False)
    whole = pii.Decoder(field).decode(batch.codes, batch.offsets, batch.words)
    assert whole.tolist() == [y for t in texts for y in labels_of(field, t).tolist()]


def test_personal_data_edges(spark):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (None, "x@y.zz"), (4, "é " * 50_000 + "+49 30 1234567"), (5, "1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("base", "personal", "spans", "kind", "_f"):
        docs = docs.withColumn(name, F.lit("own"))
    got = sorted((r.doc_id or 0, len(r.personal), len(r.base)) for r in pii.find(docs).collect())
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (4, 1, 1), (5, 0, 0)]
    clean = pii.redact(docs)
    assert clean.dtypes == docs.dtypes
    by = {r.doc_id: r for r in clean.collect()}
    assert by[3].text == "[email]" and by[4].text == "é " * 50_000 + "[phone]" and by[1].text is None and by[3].base == "own"
    assert pii.find(docs.filter("doc_id = 99")).count() == 0
    none = pii.labelled_table(spark).filter("text is null")
    assert [len(r.personal) for r in pii.find(docs.filter("doc_id = 3"), none).collect()] == [1, 1]
