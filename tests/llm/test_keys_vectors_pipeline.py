"""URL filters, vector search and the pipeline."""

import heapq
import os
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, queries, simhash, urlfilter

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
SF_DIR = "/root/testdata/sf0.001"


def test_url_parts_and_rules(spark):
    urls = [
        (0, "http://WWW.Example.org/es/x?y#z"), (1, "https://example.org/en/12"), (2, "x://a.com/fr/"), (3, "http://a.com/de/#/fr/"),
        (4, None), (5, ""), (6, "no scheme/here"), (7, "http://org"), (8, "http://spam-farm.net/p"), (9, "http://spam-farm.net/p?q"),
        (10, "http://notexample.org/es/"), (11, "a://b://c/d"), (12, "http://ÄB.org/\nq"), (None, "http://x.net/"), (8, "http://spam-farm.net/p"),
    ]
    frame = spark.createDataFrame(urls, "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit(1).alias("listed"), F.lit(2).alias("key"))
    rows = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(frame, queries.URL_RULES, queries.listed_page).collect()}
    assert rows[0] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert rows[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert rows[2] == ("a.com", "/fr/", "com/fr/", "allow") and rows[3] == ("a.com", "/de/", "com/de/", "block")
    assert rows[4] == rows[5] == rows[6] == ("", "", None, "allow") and rows[7] == ("org", "", None, "allow")
    assert rows[8][3] == rows[9][3] == "block" and rows[10] == ("notexample.org", "/es/", "org/", "allow")
    assert rows[11] == ("b:", "//c/d", None, "allow") and rows[12] == ("Äb.org", "/\nq", "org/", "allow") and rows[None][3] == "allow"
    assert urlfilter.judge(frame, queries.URL_RULES, queries.listed_page).count() == len(urls)
    assert urlfilter.judge(frame.where("false"), queries.URL_RULES, queries.listed_page).count() == 0


@pytest.mark.parametrize("shard_keys", [10**6, 400])
def test_cascade_is_exact(spark, shard_keys):
    keys = spark.range(6000).selectExpr("concat('k', id) as key", "id % 5 = 0 as listed")
    cascade = urlfilter.build(keys.unionByName(keys).unionByName(spark.sql("select null as key, null as listed")), shard_keys)
    assert len(cascade.shards) == (1 if shard_keys > 6000 else 3)
    assert max(map(len, cascade.shards)) > 1  # the first level makes mistakes, the next ones undo them
    marked = cascade.mark(keys, F.col("key"), "found")
    assert marked.where("found <> listed").count() == 0 and marked.count() == 6000


@pytest.mark.parametrize("shard_keys", [10**6, 300])
def test_judge_takes_a_table_of_listed_keys(spark, shard_keys):
    pages = spark.range(5000).selectExpr("id as page_id", "concat('http://H', id % 900, '.net/p', id % 7, '?q=', id) as url")
    listed = spark.range(3000).selectExpr("if(id % 50 = 0, null, concat('h', id % 900, '.net/p', id % 3)) as key", "1 as host")
    wanted = {r["key"] for r in listed.collect() if r["key"]}
    rows = urlfilter.judge(pages, [urlfilter.Rule("allow", "h5.net", "/")], listed, shard_keys=shard_keys).collect()
    assert len(rows) == 5000 and {r["verdict"] for r in rows} == {"allow", "block"}
    for r in rows:
        expected = "allow" if r["host"] == "h5.net" else "block" if r["host"] + r["path"] in wanted else "allow"
        assert r["verdict"] == expected
    assert urlfilter.judge(pages, [], listed.where("false")).where("verdict = 'block'").count() == 0


def test_cascade_of_nothing(spark):
    keys = spark.range(10).selectExpr("cast(id as string) as key", "false as listed")
    assert urlfilter.build(keys).mark(keys, F.col("key"), "found").where("found").count() == 0


def brute_nearest(rows, k):
    good = [(i, v) for i, v in rows if not (i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v))]
    out = []
    for at, (q, v) in enumerate(good):
        if q % 20 == 0:
            near = [(-float(np.cumsum(np.array(v) * np.array(c))[-1]), i) for n, (i, c) in enumerate(good) if n != at and len(c) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(heapq.nsmallest(k, near))]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 25])
def test_search_is_exact(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(180)]
    rows += [(i, [0.5] * 8) for i in range(200, 260)]  # ties
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None, *[1.0] * 7]), (380, [float("inf"), *[1.0] * 7])]
    rows += [(None, [1.0] * 8), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [1e-30, 0.0]), (420, [])]
    rows += [(rows[20][0], rows[20][1]), (20, [5.0] * 8), (20, [-5.0] * 8), (7, [9.0] * 8), (7, [8.0] * 8)]  # rows that share an id
    rows += [(500, [1e150, *[0.0] * 7]), (501, [1e140, *[1.0] * 7]), (502, [5e-324] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("id"), F.lit(2).alias("rank"), F.lit(3).alias("score"), F.lit(4).alias("row"))
    found = ann.search(frame, F.col("vec_id") % 20 == 0, k=20, block=block, query_block=block)
    assert sorted(map(tuple, found.collect())) == brute_nearest(rows, 20)
    assert ann.search(frame.where("false"), F.lit(True)).count() == 0


def test_search_equals_its_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in [0, 20, 20, 40, 40, 40, *range(100), *range(0, 100, 10)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = sorted((q, r, v, round(s, 9)) for q, r, v, s in con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.SQL['op6_block_join']})").fetchall())
    mine = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in queries.op6_block_join(spark, str(tmp_path)).collect())
    assert mine == theirs


def test_error_bound_holds():
    import pandas as pd

    rng = np.random.default_rng(4)
    make = lambda side: ann.Block(pd.DataFrame({f"{side}_id": range(200), f"{side}_row": range(200), f"{side}_vector": list(rng.standard_t(2, size=(200, 16)))}), side)
    q, c = make("q"), make("c")
    rough = q.products(c) * q.scale * c.scale.T
    bound = np.outer(q.error, c.norm) + np.outer(q.small_norm, c.error)
    assert (np.abs(q.exact @ c.exact.T - rough) <= bound + 1e-9).all()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    from compare import compare, connect

    ok, note = compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline
    from lodestone.llm.tables import read

    docs = read(spark, SF_DIR, "documents")
    before, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, SF_DIR), "test")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        counts.append(after.count())
        if name == "SimHash near-dedup":
            groups = simhash.near_duplicates(before).where("doc_id = component_id")
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in groups.select("doc_id").collect())
        if name == "secret scans":
            texts = [r["text"] for r in after.collect()]
            assert not any("AKIA" in t or 'token = "' in t for t in texts) and after.where("n_chars <> length(text)").count() == 0
        if name == "mixing sources":
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
        before = after
    assert docs.count() >= counts[0] >= counts[1] == counts[2] <= counts[3]
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").distinct().collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
