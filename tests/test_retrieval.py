"""Prototypes, dense and sparse retrieval against brute force on small inputs."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profilekit.operators import blocks, tfidf, vectors
from profilekit.session import scratch_path

VEC = "id bigint, embedding array<float>"


def unit(rng, n, d):
    m = rng.normal(size=(n, d)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(3)
    docs, asked = unit(rng, 120, 8), unit(rng, 30, 8)
    docs[7] = docs[5]  # exact copies tie and go by id
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "d bigint, v array<float>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q bigint, v array<float>").repartition(3)
    return docs, asked, d, q


def brute(docs, asked, min_sim, n):
    out = set()
    for i, a in enumerate(asked):
        sims = np.round(docs.astype(float) @ a.astype(float), 9)
        best = sorted(range(len(docs)), key=lambda j: (-sims[j], j))[:n]
        out |= {(i, j, sims[j]) for j in best if sims[j] >= min_sim}
    return out


@pytest.mark.parametrize("limit", [blocks.BROADCAST_BYTES, 8 * 12 * 40, 0])
def test_best_pairs_all_ways(dense, limit, monkeypatch):
    docs, asked, d, q = dense
    if limit == 8 * 12 * 40:  # only the smaller side fits: send that one
        d = d.where("d < 10")
        docs = docs[:10]
        q = q.unionAll(q.select(F.col("q") + 1000, "v"))
        asked = np.vstack([asked, asked])
    monkeypatch.setattr(blocks, "DOCS_PER_BLOCK", 17)
    monkeypatch.setattr(blocks, "QUERIES_PER_BLOCK", 7)
    got = {tuple(r) for r in blocks.best_pairs(q, d, 0.3, 5, broadcast_bytes=limit).collect()}
    want = brute(docs, asked, 0.3, 5)
    if limit == 8 * 12 * 40:
        want = {(i if i < 30 else i - 30 + 1000, j, s) for i, j, s in want}
    assert got == want


def test_documents_in_pieces(dense):
    """Neither side fits: documents go to the tasks in three pieces, and neither side is repeated for the other one's blocks."""
    docs, asked, d, q = dense
    q = q.unionAll(q.select(F.col("q") + 1000, "v"))
    found = blocks.best_pairs(q, d, 0.3, 5, broadcast_bytes=8 * 12 * 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Generate" not in plan
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((i + more, j, s) for i, j, s in brute(docs, asked, 0.3, 5) for more in (0, 1000))
    table_q, table_d = q.toArrow(), d.toArrow()
    pieces = [lambda a=a: (table_d.slice(a, 13), None) for a in range(0, 130, 13)]
    assert sorted(tuple(r.values()) for slab in blocks._slabs(iter(table_q.to_batches())) for b in blocks._best_of(slab, pieces, 0.3, 5) for r in b.to_pylist()) == got


def test_text_ids_and_null_vectors(spark):
    d = spark.createDataFrame([("é", [1.0, 0.0]), ("b", [1.0, 0.0]), ("n", None)], "d string, v array<float>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "q string, v array<float>")
    got = [tuple(r) for r in blocks.best_pairs(q, d, 0.5, 5).orderBy("d").collect()]
    assert got == [("x", "b", 1.0), ("x", "é", 1.0)]


def test_no_queries(spark, dense):
    _, _, d, q = dense
    assert blocks.best_pairs(q.where("q < 0"), d, 0.3, 5).count() == 0


def test_a_table_leaves_the_best_of_each_query_only(dense, monkeypatch):
    docs, asked, d, q = dense
    table_q, table_d = q.toArrow(), d.toArrow()
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 50)
    monkeypatch.setattr(blocks, "FIRST_DOCS", 2)
    found = [tuple(r.values()) for b in blocks._best_in(table_q, table_d, -2.0, 3) for r in b.to_pylist()]
    assert len(found) == 3 * len(asked) and set(found) == brute(docs, asked, -2.0, 3)


def test_vectors_of_any_size(spark):
    """Single precision only chooses what double precision compares."""
    near = [[1.0, 1e-9 * i] for i in range(5)] + [[1e200, 0.0], [float("inf"), 0.0], [float("nan"), 1.0]]
    d = spark.createDataFrame(list(enumerate(near)), "d long, v array<double>")
    q = spark.createDataFrame([(0, [0.0, 1e8]), (1, [1.0, 0.0])], "q long, v array<double>")
    got = {tuple(r) for r in blocks.best_pairs(q, d.where("d < 5"), 0.0, 2).collect()}
    assert got == {(0, 4, 0.4), (0, 3, 0.3), (1, 0, 1.0), (1, 1, 1.0)}
    got = {tuple(r) for r in blocks.best_pairs(q.where("q = 1"), d, 0.0, 2).collect()}
    assert got == {(1, 5, 1e200), (1, 6, float("inf"))}


def test_small_blocks_change_nothing(dense, monkeypatch):
    _, _, d, q = dense
    want = sorted(map(tuple, blocks.best_pairs(q, d, 0.2, 4).collect()))
    table_q, table_d = q.toArrow(), d.toArrow()
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 50)
    monkeypatch.setattr(blocks, "QUERY_CHUNK", 3)
    found = [r for b in blocks._best_in(table_q, table_d, 0.2, 4) for r in b.to_pylist()]
    best = {}
    for r in sorted(found, key=lambda r: (r["q"], -r["sim"], r["d"])):
        best.setdefault(r["q"], []).append((r["q"], r["d"], r["sim"]))
    assert sorted(x for rows in best.values() for x in rows[:4]) == want


def sparse_table(key, rows):
    return pa.table({key: [*range(len(rows))], "t": pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int32())), "w": pa.array([[w for _, w in r] for r in rows], pa.list_(pa.float64()))})


@pytest.mark.parametrize("min_sim", [0.3, 0.0])
@pytest.mark.parametrize("cells", [60, 4000, 4_000_000])
def test_sparse_pairs_equal_all_products(monkeypatch, min_sim, cells):
    rng = np.random.default_rng(cells)
    some = lambda n, least: [[(int(t), float(rng.random())) for t in np.sort(rng.choice(300, rng.integers(least, 6), replace=False))] for _ in range(n)]
    docs, asked = some(90, 0), some(40, 1)
    sims = np.array([[round(sum(w * dict(d).get(t, 0.0) for t, w in q), 9) for d in docs] for q in asked])
    monkeypatch.setattr(blocks, "BLOCK_CELLS", cells)
    monkeypatch.setattr(blocks, "QUERY_CHUNK", 30)
    got = {(r["q"], r["d"], r["sim"]) for b in blocks._best_in(sparse_table("q", asked), sparse_table("d", docs), min_sim, 4) for r in b.to_pylist()}
    if min_sim:
        want = {(i, j, sims[i, j]) for i in range(40) for j in sorted(range(90), key=lambda j: (-sims[i, j], j))[:4] if sims[i, j] >= min_sim}
        assert got == want and len(want) > 20
    else:  # documents with a term of the chunk count too, as many as are asked for
        assert len(got) == 4 * 40 and all(sims[i, j] == s for i, j, s in got)


def test_sparse_pairs_touch_the_entries_of_a_querys_terms_only(monkeypatch):
    """Queries of one rare term each: as many products as entries, not entries times queries."""
    n, made = 2000, []
    docs = sparse_table("d", [[(k, 0.5), (n + k % 7, 0.1)] for k in range(n)])
    asked = sparse_table("q", [[(k, 1.0)] for k in range(n)])
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *more: made.append(len(x)) or bincount(x, *more))
    got = [r for b in blocks._best_in(asked, docs, 0.3, 3) for r in b.to_pylist()]
    assert sum(made) == n and {(r["q"], r["d"], r["sim"]) for r in got} == {(k, k, 0.5) for k in range(n)}


def test_answers_are_deduplicated_after_the_candidate_cut(spark):
    docs = [(i, [1.0, float(i) / 100], "same answer" if i < 9 else f"other {i}") for i in range(12)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, embedding array<float>, output string")
    query = spark.createDataFrame([(1, [1.0, 0.0])], VEC)
    corpus = corpus.withColumn("embedding", vectors.l2_normalize(F.col("embedding")).cast("array<float>"))
    got = vectors.dense_topk(query, corpus, "id", "doc_id", min_sim=0.5).collect()
    assert [(r.rn, r.doc_id) for r in got] == [(1, 0)]  # nine candidates, one answer
    more = vectors.dense_topk(query, corpus, "id", "doc_id", min_sim=0.5, factor=4).orderBy("rn").collect()
    assert [r.doc_id for r in more] == [0, 9, 10]


def test_prototype_model_round_trip_and_scores(spark):
    rng = np.random.default_rng(1)
    m = unit(rng, 60, 6)
    m[:30, 0] += 2
    m[30:, 1] += 2
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, v.tolist(), "noise" if i < 30 else "on_topic") for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, VEC + ", clase string")
    model = vectors.PrototypeModel.fit(df)
    proto = {}
    for name, part in (("noise", m[:30]), ("on_topic", m[30:])):
        mean = part.astype(float).mean(axis=0)
        proto[name] = mean / (np.linalg.norm(mean) + 1e-9)
        assert np.allclose(model.vectors[name], proto[name], atol=1e-7)
    sn, so = m @ proto["noise"], m @ proto["on_topic"]
    got = {r.id: r for r in model.classify(df).collect()}
    for i in range(60):
        assert got[i].score == pytest.approx(sn[i] / (sn[i] + so[i] + 1e-9), abs=1e-6)
        assert got[i].es_noise == (got[i].score >= model.threshold)
    path = scratch_path(spark, "proto")
    model.save(spark, path)
    again = vectors.PrototypeModel.load(spark, path)
    assert again.threshold == model.threshold and again.counts == model.counts
    assert all(np.array_equal(again.vectors[k], model.vectors[k]) for k in model.vectors)


def test_dot_products_keep_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.5, 0.0])], VEC)
    fixed = np.array([[1.0, 1.0], [0.0, 2.0], [3.0, 0.0]])
    got = {r.id: r.x for r in df.select("id", vectors.dot_with(F.col("embedding"), fixed).alias("x")).collect()}
    assert got == {1: [3.0, 4.0, 3.0], 2: None, 3: [0.5, 0.0, 1.5]}
    nothing = df.where("id = 2").select(vectors.dot_with(F.col("embedding"), fixed).alias("x"))
    assert nothing.first().x is None


def test_relative_score_with_zero_and_negative_sums(spark):
    df = spark.createDataFrame([(0.5, -0.5 - 1e-9), (-0.2, 0.5), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(vectors.relative_score(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None or abs(got[0]) > 1e6  # no error under ANSI
    assert got[1] < 0 and got[2] == 0


def test_sweep_takes_the_first_best_threshold(spark):
    df = spark.createDataFrame([(0.6, 1), (0.3, 0), (0.2, 0)], "s double, t int")
    sweep = vectors.threshold_sweep(df, "s", "t")
    assert sweep.count() == 41
    assert vectors.best_threshold(sweep) == 0.35
    nothing = spark.createDataFrame([(0.1, 0)], "s double, t int")
    assert vectors.best_threshold(vectors.threshold_sweep(nothing, "s", "t")) == 0.5


DOCS = [
    (1, "El crédito y la tarjeta"), (2, "tarjeta tarjeta de crédito"), (3, "la inversión a plazo, a la vista"),
    (4, "!!"), (5, "plazo"), (6, ""), (7, "El crédito y la tarjeta"),
]


def by_hand(texts, max_terms):
    grams = {}
    for i, t in texts:
        words = re.findall(r"\w\w+", t.lower())
        grams[i] = Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
    total, df = Counter(), Counter()
    for c in grams.values():
        total.update(c)
        df.update(c.keys())
    kept = sorted(total, key=lambda t: (-total[t], t))[:max_terms]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    return grams, idf


def weights(counter, idf):
    w = {t: (1 + math.log(c)) * idf[t] for t, c in counter.items() if t in idf}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()}


@pytest.mark.parametrize("max_terms", [15000, 6])
def test_tfidf_by_hand(spark, max_terms):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    model = tfidf.TfidfModel.fit(docs, "doc_id", "text", max_terms)
    grams, idf = by_hand(DOCS, max_terms)
    assert {r.term: pytest.approx(r.idf) for r in model.vocabulary.collect()} == idf
    want = {(i, t): w for i, c in grams.items() for t, w in weights(c, idf).items()}
    got = {(r.d, r.term): r.weight for r in model.postings(docs, "doc_id", "text").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_tfidf_topk_by_hand_and_unknown_words(spark):
    docs = spark.createDataFrame([(i, t, f"respuesta {i}") for i, t in DOCS], "doc_id bigint, input string, output string")
    model = tfidf.TfidfModel.fit(docs, "doc_id", "input")
    asked = [(10, "la tarjeta de crédito"), (11, "zzz yyy"), (12, "plazo")]
    queries = spark.createDataFrame(asked, "q_id bigint, pregunta string")
    hits = tfidf.tfidf_topk(model, queries, docs, "q_id", "pregunta", "doc_id")
    grams, idf = by_hand(DOCS, 15000)
    doc_w = {i: weights(c, idf) for i, c in grams.items() if c}
    want = {}
    for q, t in asked:
        words = re.findall(r"\w\w+", t.lower())
        c = Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        if not any(x in idf for x in c):
            continue
        qw = weights(c, idf)
        sims = {i: sum(qw.get(t, 0) * x for t, x in w.items()) for i, w in doc_w.items()}
        best = sorted((i for i in sims if sims[i] >= 0.15), key=lambda i: (-round(sims[i], 9), i))[:3]
        want[q] = [(i, round(sims[i], 3)) for i in best]
    got = {}
    for r in hits.orderBy("q_id", "rn").collect():
        got.setdefault(r.q_id, []).append((r.doc_id, r.similitud))
    assert got == want and 11 not in got


def test_rows_and_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    model = tfidf.TfidfModel.fit(docs, "doc_id", "text")
    plan = model.rows(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    totals = tfidf.term_totals(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert totals.count("Exchange hashpartitioning(term") == 1 and "text" not in totals[totals.index("MapInArrow") :].split("\n")[0]


@pytest.mark.parametrize("slice_tokens", [1 << 20, 3])
def test_slices_and_odd_texts(spark, monkeypatch, slice_tokens):
    """Null, empty and wordless texts have no row; a long text and repeated words are counted whole, whatever the slices."""
    monkeypatch.setattr(tfidf, "SLICE_TOKENS", slice_tokens)
    texts = [(1, None), (2, ""), (3, "a . b"), (4, "uno dos " * 500), (5, "dos uno uno"), (5, "uno")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    totals = {r.term: (r.total, r.df) for r in tfidf.term_totals(docs, "text").collect()}
    assert totals == {"uno": (503, 3), "dos": (501, 2), "uno dos": (500, 1), "dos uno": (500, 2), "uno uno": (1, 1)}
    model = tfidf.TfidfModel.fit(docs, "doc_id", "text")
    rows = model.rows(docs, "doc_id", "text").collect()
    assert sorted(r.d for r in rows) == [4, 5, 5]
    assert all(sum(x * x for x in r.w) == pytest.approx(1) and list(r.t) == sorted(r.t) for r in rows)
    none = tfidf.TfidfModel.fit(docs.limit(0), "doc_id", "text")
    assert none.n_docs == 0 and none.rows(docs, "doc_id", "text").count() == 0


def test_model_is_used_in_another_session(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    model, path = tfidf.TfidfModel.fit(docs, "doc_id", "text", 6), scratch_path(spark, "tfidf")
    model.save(path)
    again = tfidf.TfidfModel.load(spark.newSession(), path)
    assert (again.n_docs, again.max_terms) == (len(DOCS), 6)
    rows = lambda m: sorted((r.d, tuple(r.t), tuple(r.w)) for r in m.rows(docs, "doc_id", "text").collect())
    assert rows(again) == rows(model)


def test_context_text(spark):
    hits = spark.createDataFrame(
        [(1, 2, "q2", "a2", 0.5), (1, 1, "q1", "a1", 0.876)], "m int, rn int, input string, output string, similitud double"
    )
    got = vectors.retrieval_context(hits, "m", heading="H\n", with_similarity=True).first().contexto
    assert got == "H\nEjemplo 1 (88%):\nPregunta: q1\nRespuesta: a1\n\nEjemplo 2 (50%):\nPregunta: q2\nRespuesta: a2\n"
