import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, chunk, vectors


def slow_windows(text, size, overlap):
    """Straightforward search backwards for the break, character by character."""
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for at in range(end - 2, start + size // 2, -1):
                if text[at : at + 2] in (". ", "; "):
                    end = at + 1
                    break
        out.append(text[start:end].strip())
        if end == len(text):
            return out
        start = max(end - overlap, start + 1)
    return out


def slow_packs(text, size, overlap):
    todo, out, open_ = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], [], []
    for sentence in todo:
        if open_ and len(" ".join([*open_, sentence])) > size:
            out.append(" ".join(open_))
            tails = [open_[i:] for i in range(len(open_) + 1)]
            open_ = next(t for t in tails if len(" ".join(t)) <= overlap)
        open_ = [*open_, sentence]
    return out + ([" ".join(open_)] if open_ else [])


def random_text(rng, words):
    return " ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) + rng.choice(["", "", "", ".", ";", "!"]) for _ in range(words))


def test_chunkers_against_slow_forms():
    rng = random.Random(5)
    for _ in range(200):
        text, size = random_text(rng, rng.randint(0, 120)), rng.randint(12, 90)
        overlap = rng.randint(0, size - 1)
        assert chunk.windows(text, size, overlap) == slow_windows(text, size, overlap)
        assert chunk.packs(text, size, overlap) == slow_packs(text, size, overlap)


def test_chunk_frames(spark):
    assert chunk.packs("Aa bb. Cc dd! Ee ff? Gg hh.", 14, 7) == ["Aa bb. Cc dd!", "Cc dd! Ee ff?", "Ee ff? Gg hh."]
    page = spark.createDataFrame([("d", "manual", "d.pdf", 2, "Aa bb. Cc dd! Ee ff? Gg hh."), ("e", "other", "e.pdf", 1, "")],
                                 "document_id string, document_type string, source_file string, page_number int, text string")
    rows = chunk.sentences(page, 14, 7, "now").orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["d:p2:c1", "d:p2:c2", "d:p2:c3"] and rows[0].indexed_at == "now"
    assert chunk.sliding(page).count() == 1
    with pytest.raises(ValueError):
        chunk.sliding(page, 10, 10)


DOCS = [(i, t) for i, t in enumerate([
    "fuse trip on inverter inverter", "thermal fuse", "cooling pump service", "inverter fault err_inv_404", "", "pump pump pump"])]
ASKED = [(1, "inverter fuse fuse"), (2, "pump"), (3, "unknown words")]


def brute(k):
    token = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"
    bags = {i: Counter(re.findall(token, t)) for i, t in DOCS}
    avg = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = set()
    for q, text in ASKED:
        scores = {}
        for term, qf in Counter(re.findall(token, text)).items():
            df = sum(term in b for b in bags.values())
            for i, b in bags.items():
                if term in b:
                    norm = b[term] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)
                    scores[i] = scores.get(i, 0) + qf * math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b[term] * 2.5 / norm
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out |= {(q, i, round(s, 6), n) for n, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("limit", [1000, 0])
def test_bm25_with_and_without_broadcast(spark, tmp_path, limit):
    docs = spark.createDataFrame(DOCS, "chunk_id long, text string")
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    built = bm25.build(docs)
    bm25.write(built, str(tmp_path / "ix"), buckets=4, spread=2)
    for index in (built, bm25.read(spark, str(tmp_path / "ix"))):
        got = bm25.search(index, asked, 2, digits=6, max_broadcast=limit).collect()
        assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got} == brute(2)


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    v = unit(centres[rng.integers(0, 5, 300)] + 0.4 * rng.normal(size=(300, 12)))
    q = unit(centres + 0.2 * rng.normal(size=(5, 12)))
    frame = lambda m, name: spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, embedding array<float>")
    exact = {(i, int(j)) for i, row in enumerate(q @ v.T) for j in np.argsort(-row)[:6]}
    return frame(q, "query_id"), frame(v, "chunk_id"), exact


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


def test_exact_top_k(space):
    q, v, exact = space
    assert pairs(vectors.topk_exact(q, v, 6)) == exact
    assert pairs(vectors.topk_blocks(q, v, 6, block_rows=70)) == exact


def test_top_k_without_broadcast(space, monkeypatch):
    q, v, exact = space
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 2)
    assert pairs(vectors.topk_exact(q, v, 6)) == exact
    assert pairs(vectors.topk_lsh(q, v, vectors.fit_lsh(v, tables=30, bucket=1e6), 6)) == exact


def test_approximate_search_compares_what_shares_a_bucket(space):
    q, v, _ = space
    model = vectors.fit_lsh(v, tables=3, bucket=0.3)
    rows = lambda df, id: [(r[id], np.array(r["embedding"], dtype=float)) for r in df.collect()]
    # brute force with the model's own projections, read back from its buckets
    buckets = lambda df, id: {(r["table"], r["bucket"], r[id]) for r in vectors.bucketed(df, model).collect()}
    mine, theirs = buckets(q, "query_id"), buckets(v, "chunk_id")
    vs, expected = dict(rows(v, "chunk_id")), set()
    for i, x in rows(q, "query_id"):
        near = {c for t, b, c in theirs if (t, b, i) in mine}
        best = sorted(near, key=lambda c: (-round(float(unit(vs[c][None])[0] @ unit(x[None])[0]), 6), c))[:4]
        expected |= {(i, c) for c in best}
    assert pairs(vectors.topk_lsh(q, v, model, 4, block_rows=40)) == expected


def test_a_crowded_key_is_cut_into_blocks(spark, space):
    q, v, _ = space
    keyed = v.withColumn("code", F.when(F.col("chunk_id") % 10 == 0, "rare").otherwise("hot"))
    asked = q.crossJoin(spark.createDataFrame([("hot",), ("rare",), ("none",)], "code string"))
    whole, cut = (vectors.topk_keyed(asked, keyed, ["code"], 3, ["query_id", "code"], block_rows=n) for n in (20_000, 25))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(whole) == as_set(cut) and len(as_set(cut)) == 5 * 2 * 3
    hot = {(r.query_id, r.chunk_id) for r in cut.where("code = 'hot'").collect()}
    assert hot == pairs(vectors.topk_exact(q, v.where("chunk_id % 10 <> 0"), 3))


def test_embedder_without_python(spark):
    texts = [(0, "Pump P-101 leaks; pump p-101 again."), (1, ""), (2, None), (3, "a b c " * 3000), (4, "ÄÖ über_x 7-8_9")]
    frame = spark.createDataFrame(texts, "id int, text string")
    native = vectors.embed(frame, vectors.HashedTerms(8))
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()

    class Plugged:
        name, dim = "plugged", 8

        def encode(self, texts):
            return vectors.HashedTerms(8).encode(texts)

    plugged = {r.id: r.embedding for r in vectors.embed(frame, Plugged()).collect()}
    assert {r.id: r.embedding for r in native.collect()} == plugged and plugged[1] == [0.0] * 8
    vectors.require_vectors(native, 5, 8)
    with pytest.raises(ValueError, match="6 texts gave 5"):
        vectors.require_vectors(native, 6, 8)
    with pytest.raises(ValueError, match="5 missing"):
        vectors.require_vectors(native, 5, 9)


def test_approximate_recall(space):
    q, v, exact = space
    approx = vectors.topk_lsh(q, v, vectors.fit_lsh(v, tables=8, bucket=0.5), 6)
    assert vectors.recall(vectors.topk_exact(q, v, 6), approx, 6).first().recall_at_k >= 0.9
    searches = {"exact": lambda some: vectors.topk_exact(some, v, 6), "none": lambda some: vectors.topk_exact(some, v.limit(0), 6)}
    few = q.filter("query_id < 3")
    report = {r.search: r for r in vectors.evaluate(few, searches, "exact", 6).collect()}
    assert (report["exact"].recall_at_k, report["none"].recall_at_k, report["none"].queries) == (1.0, 0.0, 3)
    assert all(0 < r.p50 <= r.p95 <= r.p99 for r in report.values())


@pytest.mark.parametrize("limit", [8192, 0])
def test_codes_in_chunks(spark, space, monkeypatch, limit):
    q, v, _ = space
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", limit)
    chunks = v.withColumn("text", F.when(F.col("chunk_id") % 7 == 0, "see ERR_A_001").otherwise("none"))
    asked = q.filter("query_id < 2").withColumn("code", F.lit("ERR_A_001"))
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(r"ERR_[A-Z]+_\d{3}"), 0))
    hits = vectors.search_containing(asked, chunks, codes, 2)
    want = vectors.topk_exact(q.filter("query_id < 2"), chunks.filter("chunk_id % 7 = 0"), 2)
    assert pairs(hits) == pairs(want)


def test_collection(spark, space):
    q, v, _ = space
    chunks = v.select("chunk_id", F.lit("t").alias("text"))
    assert vectors.build_collection(chunks, v).count() == 300
    with pytest.raises(ValueError, match="100 chunks have no matching embedding"):
        vectors.build_collection(chunks, v.filter("chunk_id < 200"))
    once = vectors.embed(chunks, vectors.HashedTerms(8))
    assert vectors.upsert_collection(once, once.filter("chunk_id < 10")).count() == 300
    assert vectors.upsert_collection(once, once.filter("chunk_id < 10"), rebuild=True).count() == 10


def test_nearest_rows_are_found_without_ranking_all(monkeypatch):
    """Ties, strips and pairs that do not count as in brute force; only the first strip of the rows is ranked whole."""
    rng, ranked = np.random.default_rng(5), []
    best = vectors._best
    monkeypatch.setattr(vectors, "_best", lambda scores, *rest: ranked.append(len(scores)) or best(scores, *rest))
    for n, some in ((0, 1.0), (3, 1.0), (257, 0.02), (6000, 1.0), (6000, 0.5)):
        v = unit(rng.normal(size=(max(1, n // 20), 8)))[rng.integers(0, max(1, n // 20), n)]  # each vector many times
        q, ids, allowed = unit(rng.normal(size=(7, 8))), rng.permutation(n), rng.random((n, 7)) < some
        scores = np.where(allowed, np.round(v @ q.T, 2), -np.inf)
        want = {(i, j, scores[i, j]) for j in range(7) for i in sorted(np.flatnonzero(allowed[:, j]), key=lambda i: (-scores[i, j], ids[i]))[:4]}
        rows, cols, found = vectors._nearest(v, ids, q, 4, 2, allowed)
        assert set(zip(rows.tolist(), cols.tolist(), found.tolist())) == want and len(rows) == len(want)
    assert max(ranked) <= vectors.FIRST_ROWS


def test_percentiles_without_a_task_per_group(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.operators import metrics

    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=997), "b": rng.integers(0, 5, 400).astype(float), "one": np.array([3.0]), None: rng.random(50)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r.k: (r.p50, r.p95, r.p99) for r in metrics.percentiles(frame, "v", ["k"]).collect()}
    assert found.pop("none") == (None, None, None) and set(found) == set(values)
    for k, vs in values.items():
        assert np.allclose(found[k], np.quantile(vs, [0.5, 0.95, 0.99]), rtol=1e-12)
    whole = metrics.percentiles(frame, "v").first()
    assert np.allclose(tuple(whole), np.quantile(np.concatenate(list(values.values())), [0.5, 0.95, 0.99]))
    plan = metrics.percentiles(frame, "v", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_bm25_tasks_grow_with_pairs(spark, monkeypatch):
    """Tasks that sum scores are as many as the pairs of queries and chunks need."""
    docs = spark.range(40).selectExpr("concat('c', id) AS chunk_id", "concat('pump w', id % 7) AS text")
    asked = spark.createDataFrame([(i, f"pump w{i}") for i in range(5)], "query_id long, text string")
    few = bm25.search(bm25.build(docs), asked, 3, digits=6)
    monkeypatch.setattr(bm25, "PAIRS", 10)
    many = bm25.search(bm25.build(docs), asked, 3, digits=6)
    assert "RepartitionByExpression [chunk_id" in (plan := many._jdf.queryExecution().optimizedPlan().toString())
    assert any("[chunk_id" in line and line.rstrip().endswith(", 20") for line in plan.splitlines())
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
