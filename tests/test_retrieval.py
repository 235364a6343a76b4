import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.functions.text import query_tokens
from quillon.operators import hybrid, knn, text_search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [("a", "rust database rust", [1.0, 0.0, 0.0, 0.0], "en"), ("b", "a database of many many words about nothing", [0.0, 1.0, 0.0, 0.0], "en"), ("c", "Ünïcode, rust!", [0.0, 0.0, 0.0, 0.0], "de"), ("d", None, None, "en"), ("e", "", [2.0, 0.0], "de")],
        "_id string, body string, v array<float>, lang string",
    )


def found(df):
    return [(r["_id"], r["score"]) for r in df.collect()]


def test_tokens():
    assert query_tokens("The a_bc ÉTÉ été 42 é !") == ["the", "bc", "été", "42", "é"]


def test_bm25_against_the_formula(docs):
    texts = {"a": ["rust", "database", "rust"], "b": "database of many many words about nothing".split(), "c": ["ünïcode", "rust"], "e": []}
    avg, n = sum(map(len, texts.values())) / 4, 4

    def score(doc, query):
        total = 0.0
        for t in query:
            df, tf = sum(t in w for w in texts.values()), texts[doc].count(t)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[doc]) / avg))
        return total

    got = dict(found(text_search.search_text(docs, "body", "Rust rust DATABASE")))
    assert set(got) == {"a", "b", "c"}
    for d, s in got.items():
        assert s == pytest.approx(score(d, ["rust", "database"]))
    only = found(text_search.search_text(docs, "body", "rust", filter={"lang": "de"}))
    assert only == [("c", pytest.approx(score("c", ["rust"])))]
    assert found(text_search.search_text(docs, "body", "rust", 0)) == [] == found(text_search.search_text(docs, "body", "!"))


def test_nearest(docs):
    assert found(knn.find_nearest(docs, "v", [1, 0, 0, 0], 3)) == [("a", 1.0), ("b", 0.0), ("c", 0.0)]
    assert found(knn.find_nearest(docs, "v", [1, 0, 0, 0], 1, "euclidean")) == [("a", 1.0)]
    assert found(knn.find_nearest(docs, "v", [3, 1, 0, 0], 2, "dot")) == [("a", 3.0), ("b", 1.0)]
    assert found(knn.find_nearest(docs, "v", [1, 0, 0, 0], 3, filter={"lang": "de"})) == [("c", 0.0)]
    assert found(knn.find_nearest(docs, "v", [1, 0, 0, 0], 0)) == []
    with pytest.raises(EngineError):
        knn.find_nearest(docs, "v", [1, 0], 3, dimensions=4)


def test_long_vectors_and_batches_agree(spark):
    x = np.random.default_rng(1).normal(size=(60, 200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id int, v array<double>")
    for metric in ("cosine", "dot", "euclidean"):
        batch = knn.batch_nearest(df, "v", df.filter("_id < 3"), "v", 5, metric)
        for q in range(3):
            one = [r["_id"] for r in knn.find_nearest(df, "v", x[q].tolist(), 5, metric).collect()]
            assert [r["_id"] for r in batch.filter(f"query_id = {q}").orderBy("rank").collect()] == one


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_batches_rank_equal_vectors_by_id_and_odd_ones_as_one_query_does(spark, metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(3, 64)), 700, 0), rng.normal(size=(900, 64))])
    x = x[rng.permutation(len(x))].round(3)
    x[11] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (5002, [None] + [1.0] * 63), (5003, [float("nan")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "_id int, v array<double>").repartition(3)
    batch = knn.batch_nearest(df, "v", df.filter("_id < 20 or _id = 5001"), "v", 9, metric)
    got = {}
    for r in batch.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["_id"], r["score"]))
    for q in range(20):
        one = found(knn.find_nearest(df, "v", x[q].tolist(), 9, metric))
        assert [i for i, _ in got[q]] == [i for i, _ in one]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in one], abs=1e-12, nan_ok=True)
    assert [i for i, _ in got[5001]] == [5001]
    everything = knn.batch_nearest(df, "v", df.filter("_id < 2"), "v", 5000, metric).groupBy("query_id").count().collect()
    assert sorted(map(tuple, everything)) == [(0, 3002), (1, 3002)]


def test_batches_hold_little_at_once():
    import tracemalloc

    rng = np.random.default_rng(4)
    asked, x = rng.normal(size=(2000, 16)), rng.normal(size=(10_000, 16)).astype(np.float32)
    best = knn._Best(asked, 5, "cosine")
    tracemalloc.start()
    best.add(pa.array(np.arange(len(x))), x, np.zeros(len(x), bool))
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all scores at once are 160 MB
    tracemalloc.stop()
    some = asked[:50] / np.linalg.norm(asked[:50], axis=1)[:, None] @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert [best.found.take(pa.array(r)).to_pylist() for r in best.rows[:50]] == np.argsort(-some, 1)[:, :5].tolist()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_long_vectors_rank_alike_in_numpy_and_in_expressions(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 130)).round(2)
    x[7] = 0
    rows = [(i, v.tolist(), "a" if i % 3 else "b") for i, v in enumerate(x)] + [(400, None, "a"), (401, [1.0], "a"), (402, [None] + [1.0] * 129, "a"), (403, [float("nan")] + [1.0] * 129, "b"), (404, x[5].tolist(), "a")]
    df = spark.createDataFrame(rows, "_id int, v array<double>, g string").repartition(5)
    for how in ({"top_k": 12}, {"top_k": 400}, {"top_k": 9, "filter": {"g": "b"}}):
        fast = knn.find_nearest(df, "v", x[5].tolist(), metric=metric, **how)
        assert "MapInArrow" in fast._jdf.queryExecution().optimizedPlan().toString()
        monkeypatch.setattr(knn, "LONG", 1000)
        plain = knn.find_nearest(df, "v", x[5].tolist(), metric=metric, **how)
        monkeypatch.undo()
        got, want = fast.collect(), plain.collect()
        assert [r["_id"] for r in got] == [r["_id"] for r in want] and fast.columns == plain.columns
        assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=1e-12, nan_ok=True)


def test_approximate_index_ranks_like_exact(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 8)), 20, 0) + rng.normal(scale=0.05, size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id int, v array<double>")
    index = knn.ApproximateIndex(df, "v")
    exact = {r["_id"] for r in knn.find_nearest(df, "v", x[5].tolist(), 10).collect()}
    assert len(exact & {r["_id"] for r in index.find_nearest(x[5].tolist(), 10).collect()}) >= 9
    with pytest.raises(EngineError):
        knn.ApproximateIndex(df, "v", "dot")


def test_the_approximate_index_ranks_many_queries_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 8)), 20, 0) + rng.normal(scale=0.05, size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id int, v array<double>").repartition(3)
    asked = df.filter("_id % 40 = 5")
    exact, near = ({(r["query_id"], r["_id"]) for r in f.collect()} for f in (knn.batch_nearest(df, "v", asked, "v", 10), knn.ApproximateIndex(df, "v").batch_nearest(asked, "v", 10)))
    assert len(exact) == len(near) == 100 and len(exact & near) >= 90
    narrow = knn.ApproximateIndex(df, "v", bucket_length=0.05, tables=1)  # few vectors share a bucket: they come first, others fill up
    h = narrow._hashes()(x)[:, 0]
    for q in (5, 45):
        shared = [i for i in np.flatnonzero(h == h[q])]
        want = {r["_id"] for r in knn.find_nearest(df.filter(F.col("_id").isin([int(i) for i in shared])), "v", x[q].tolist(), 100).collect()}
        got = [r["_id"] for r in narrow.batch_nearest(df.filter(f"_id = {q}"), "v", 100).orderBy("rank").collect()]
        assert len(got) == 100 and want <= set(got) and len(want) < 100


def test_hybrid(docs):
    got = hybrid.hybrid_search(docs, "body", "rust", "v", [1, 0, 0, 0], 5).collect()
    ranks = {r["_id"]: (r["text_rank"], r["vector_rank"]) for r in got}
    assert got[0]["_id"] == "a" and ranks["b"] == (None, 1) and got[0]["score"] == pytest.approx(1 / 61 + 1 / 61) or ranks["a"][0] == 1
    zero = hybrid.hybrid_search(docs, "body", "rust", "v", [1, 0, 0, 0], 5, text_weight=0).collect()
    assert {r["_id"] for r in zero} == set(ranks)


def test_every_token_of_every_document_is_posted(spark):
    from quillon.operators import text_search

    df = spark.createDataFrame([(1, "common rare common"), (2, "Common other"), (3, None), (4, "")], "_id int, text string")
    found = sorted(map(tuple, text_search.postings(df, "text").collect()))
    assert found == [(1, "common", 2), (1, "rare", 1), (2, "common", 1), (2, "other", 1)]


def test_registered_postings_keep_rare_tokens(spark, tmp_path):
    from quillon import queries

    rows = [(1, "common rare common"), (2, "Common other"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, queries.QUERIES["fts_postings_full"](spark, str(tmp_path)).collect()))
    assert found == [(1, "common", 2), (1, "rare", 1), (2, "common", 1), (2, "other", 1)]
