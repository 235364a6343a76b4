"""One registered query for each operator, over the driver's tables, and the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions import crypto, dynamic, ids
from .functions.text import idf, tokens
from .operators import find as reads
from .operators import hybrid, knn, shape, sync, text_search, updates
from .plans.pipeline import aggregate
from .sources import io
from .sources.collection import Collection, Database
from .sources.store import shared_folder
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]

#: Natural keys of the tables.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a collection: its natural key is ``_id``."""
    return reads.with_id(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *KEYS[name])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _found(name: str, of: str, filter: dict, fields: Sequence[str], where: str) -> None:  # noqa: A002
    """A find, and the same as a SQL selection."""
    QUERIES[name] = lambda spark, sf: reads.find(table(spark, sf, of), filter, fields=fields)
    QUERIES[name].__name__ = name
    ORACLE[name] = f"SELECT {KEYS[of][0]} AS _id, {', '.join(fields)} FROM {of} WHERE {where}"


def _piped(name: str, of: str, pipeline: list, sql: str, rounded: Sequence[str] = (), listed: Sequence[str] = ()) -> None:
    """A pipeline; ``rounded`` columns to two places, ``listed`` arrays as text on both sides."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = aggregate(table(spark, sf, of), pipeline)
        out = out.withColumns({c: F.round(c, 2) for c in rounded})
        return out.withColumns({c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",") for c in listed})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = sql


# --- filters -----------------------------------------------------------------------------------

_O = ("o_custkey", "o_totalprice")
_found("filter_all", "orders", {}, _O, "true")
_found("filter_eq", "orders", {"o_orderstatus": "F"}, _O, "o_orderstatus = 'F'")
_found("filter_eq_type_strict", "orders", {"o_custkey": "42"}, _O, "false")
_found("filter_eq_number", "orders", {"o_custkey": 42.0}, _O, "o_custkey = 42")
_found("filter_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, _O, "o_orderstatus IS DISTINCT FROM 'F'")
_found("filter_gt", "orders", {"o_totalprice": {"$gt": 100000}}, _O, "o_totalprice > 100000")
_found("filter_gte", "customer", {"c_acctbal": {"$gte": 9000}}, ("c_acctbal",), "c_acctbal >= 9000")
_found("filter_lt", "customer", {"c_acctbal": {"$lt": 0}}, ("c_acctbal",), "c_acctbal < 0")
_found("filter_lte_fraction", "part", {"p_size": {"$lte": 7.5}}, ("p_size",), "p_size <= 7.5")
_found("filter_range", "orders", {"o_orderdate": {"$gte": "1995-01-01", "$lt": "1996-01-01"}}, _O, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_found("filter_in", "events", {"event_type": {"$in": ["click", "purchase"]}}, ("user_id",), "event_type IN ('click', 'purchase')")
_found("filter_nin", "events", {"event_type": {"$nin": ["click", "purchase"]}}, ("user_id",), "event_type NOT IN ('click', 'purchase') OR event_type IS NULL")
_found("filter_exists", "customer", {"c_acctbal": {"$exists": True}}, ("c_name",), "true")
_found("filter_exists_missing", "customer", {"nickname": {"$exists": True}}, ("c_name",), "false")
_found("filter_missing_ne", "customer", {"nickname": {"$ne": "x"}}, ("c_name",), "true")
_found("filter_and", "orders", {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 200000}}]}, _O, "o_orderstatus = 'O' AND o_totalprice > 200000")
_found("filter_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 5000}}]}, _O, "o_orderstatus = 'P' OR o_totalprice < 5000")
_found("filter_not", "orders", {"$not": {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 5000}}]}}, _O, "NOT (o_orderstatus = 'P' OR o_totalprice < 5000)")
_found("filter_regex", "part", {"p_name": {"$regex": "^[a-m].*(ring|bolt)$"}}, ("p_name",), "regexp_matches(p_name, '^[a-m].*(ring|bolt)$')")
_found("filter_id_in", "orders", {"_id": {"$in": [1, 2, 3, 500, 999999999]}}, _O, "o_orderkey IN (1, 2, 3, 500, 999999999)")
_found("filter_array_gte", "embeddings", {"embedding": {"$gte": 0.45}}, ("label",), "len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) >= 0.45)) > 0")
_found("filter_contains", "documents", {"text": {"$contains": "the and of"}}, ("lang",), "list_has_all(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), ['the', 'and', 'of'])")
_found("filter_contains_no_token", "documents", {"text": {"$contains": "a !"}}, ("lang",), "true")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("props", F.from_json("props", "struct<k:bigint>"))


@query("SELECT event_id AS _id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def filter_nested(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(_events(spark, sf), {"props.k": {"$gt": 50}}).select("_id", F.col("props.k").alias("k"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("words", F.split(F.concat_ws(" ", "p_name", "p_type"), " "))


@query("SELECT p_partkey AS _id, p_type FROM part WHERE list_contains(string_split(p_name || ' ' || p_type, ' '), 'ring')")
def filter_array_eq(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(_words(spark, sf), {"words": "ring"}, fields=["p_type"])


@query("SELECT p_partkey AS _id, p_type FROM part WHERE list_has_any(string_split(p_name || ' ' || p_type, ' '), ['ring', 'PROMO'])")
def filter_array_in(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(_words(spark, sf), {"words": {"$in": ["ring", "PROMO"]}}, fields=["p_type"])


@query("SELECT p_partkey AS _id, p_type FROM part WHERE NOT list_contains(string_split(p_name || ' ' || p_type, ' '), 'ring')")
def filter_array_ne(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(_words(spark, sf), {"words": {"$ne": "ring"}}, fields=["p_type"])


# --- options of find ---------------------------------------------------------------------------


@query("SELECT o_orderkey AS _id, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def find_sort_skip_limit_project(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(table(spark, sf, "orders"), {"o_orderstatus": "F"}, sort={"o_totalprice": -1}, skip=10, limit=20, fields=_O)


@query("SELECT c_custkey AS _id, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey LIMIT 100")
def find_multi_sort(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find(table(spark, sf, "customer"), sort={"c_mktsegment": 1, "c_nationkey": -1}, limit=100, fields=["c_mktsegment", "c_nationkey"])


@query("SELECT s_suppkey AS _id, s_name FROM supplier WHERE s_acctbal > 1000 ORDER BY s_suppkey LIMIT 1")
def find_one(spark: SparkSession, sf: str) -> DataFrame:
    return reads.find_one(table(spark, sf, "supplier"), {"s_acctbal": {"$gt": 1000}}).select("_id", "s_name")


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.count(table(spark, sf, "lineitem"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return reads.count(table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_quantity": {"$lt": 10}})


@query("SELECT n_nationkey AS _id, n_name FROM nation WHERE n_nationkey IN (3, 7, 21)")
def get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reads.by_ids(table(spark, sf, "nation"), [3, 7, 21, 400]).select("_id", "n_name")


@query("SELECT p_partkey AS _id, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def page_studio(spark: SparkSession, sf: str) -> DataFrame:
    return reads.page(table(spark, sf, "part"), 3, 50)[0].select("_id", "p_name")


# --- pipelines ---------------------------------------------------------------------------------

_piped(
    "pipeline_flagship", "orders",
    [{"$match": {"o_orderstatus": "F", "o_totalprice": {"$gte": 1000}}}, {"$group": {"_id": "$o_orderpriority", "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}}}, {"$sort": {"total": -1}}, {"$limit": 3}],
    "SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3",
    ["total"],
)
_piped("group_sum", "lineitem", [{"$group": {"_id": "$l_returnflag", "price": {"$sum": "$l_extendedprice"}, "lines": {"$sum": "$l_linenumber"}}}], "SELECT l_returnflag AS _id, round(sum(l_extendedprice), 2) AS price, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1", ["price"])
_piped("group_avg", "lineitem", [{"$group": {"_id": "$l_linestatus", "qty": {"$avg": "$l_quantity"}, "none": {"$avg": "$l_returnflag"}}}], "SELECT l_linestatus AS _id, round(avg(l_quantity), 2) AS qty, CAST(NULL AS DOUBLE) AS \"none\" FROM lineitem GROUP BY 1", ["qty"])
_piped("group_min_max", "customer", [{"$group": {"_id": "$c_nationkey", "low": {"$min": "$c_acctbal"}, "high": {"$max": "$c_acctbal"}, "name": {"$min": "$c_name"}}}], "SELECT c_nationkey AS _id, min(c_acctbal) AS low, max(c_acctbal) AS high, min(c_name) AS name FROM customer GROUP BY 1")
_piped("group_count", "events", [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1")
_piped("group_push", "nation", [{"$sort": {"n_name": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], "SELECT n_regionkey AS _id, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1", listed=["names"])
_piped("group_push_by_turn", "conversations", [{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}}}], "SELECT conv_id AS _id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1", listed=["roles"])
_piped("group_add_to_set", "customer", [{"$group": {"_id": "$c_nationkey", "segments": {"$addToSet": "$c_mktsegment"}}}], "SELECT c_nationkey AS _id, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments FROM customer GROUP BY 1", listed=["segments"])
_piped("group_first_last", "events", [{"$sort": {"ts": 1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_type"}, "last": {"$last": "$event_type"}}}], "SELECT user_id AS _id, arg_min(event_type, (ts, event_id)) AS \"first\", arg_max(event_type, (ts, event_id)) AS \"last\" FROM events GROUP BY 1")
_piped("group_first_desc", "orders", [{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_custkey", "best": {"$first": "$o_orderkey"}, "worst": {"$last": "$o_orderkey"}}}], "SELECT o_custkey AS _id, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS best, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[-1] AS worst FROM orders GROUP BY 1")
_piped("group_null_key", "orders", [{"$match": {"o_orderstatus": "P"}}, {"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0", ["total"])
_piped("group_null_key_empty", "orders", [{"$match": {"o_orderstatus": "none"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n FROM orders WHERE false HAVING count(*) > 0")
_piped("group_missing_key", "orders", [{"$group": {"_id": "$nickname", "n": {"$sum": 1}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n FROM orders")
_piped("match_group_match", "orders", [{"$match": {"o_totalprice": {"$gt": 50000}}}, {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 12}}}], "SELECT o_custkey AS _id, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) >= 12")
_piped("match_after_group_by_id", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$match": {"_id": {"$in": ["F", "P"]}}}], "SELECT o_orderstatus AS _id, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
_piped("sort_skip_limit", "part", [{"$sort": {"p_retailprice": -1}}, {"$skip": 5}, {"$limit": 24}, {"$project": {"p_name": 1, "p_retailprice": 1}}], "SELECT p_partkey AS _id, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 24 OFFSET 5")
_piped("project_include", "nation", [{"$project": {"n_name": 1, "absent": True}}], "SELECT n_nationkey AS _id, n_name FROM nation")
_piped("project_exclude", "region", [{"$project": {"r_name": 0}}], "SELECT r_regionkey, r_regionkey AS _id FROM region")
_piped("project_without_id", "region", [{"$project": {"r_name": 1, "_id": 0}}], "SELECT r_name FROM region")
_piped("project_only_id", "region", [{"$project": {"_id": 1}}], "SELECT r_regionkey AS _id FROM region")
_piped(
    "full_pipeline", "lineitem",
    [{"$match": {"l_shipdate": {"$lt": "1998-01-01"}}}, {"$group": {"_id": "$l_suppkey", "revenue": {"$sum": "$l_extendedprice"}, "top": {"$max": "$l_quantity"}}}, {"$sort": {"top": -1, "_id": 1}}, {"$limit": 10}, {"$project": {"revenue": 1}}],
    "SELECT l_suppkey AS _id, round(sum(l_extendedprice), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY max(l_quantity) DESC, 1 LIMIT 10",
    ["revenue"],
)

# --- text --------------------------------------------------------------------------------------

_TOKENS = "list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2), lambda x: lower(x))"
_BM25 = f"""
WITH toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL),
lens AS (SELECT doc_id, t, len(t) AS len FROM toks),
stats AS (SELECT count(*) AS n, avg(len) AS av FROM lens),
q(tok) AS (VALUES %tokens%),
tfs AS (SELECT doc_id, len, tok, len(list_filter(t, lambda x: x = tok)) AS tf FROM lens CROSS JOIN q),
dfs AS (SELECT tok, count(*) FILTER (tf > 0) AS df FROM tfs GROUP BY tok),
scored AS (
  SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (%k1% + 1) / (tf + %k1% * (1 - %b% + %b% * len / av)) ELSE 0 END) AS s
  FROM tfs JOIN dfs USING (tok) CROSS JOIN stats GROUP BY doc_id HAVING max(tf) > 0
)"""


def _bm25(tokens_: Sequence[str], k1: float = 1.2, b: float = 0.75) -> str:
    rows = ", ".join(f"('{t}')" for t in tokens_)
    return _BM25.replace("%tokens%", rows).replace("%k1%", str(k1)).replace("%b%", str(b))


@query(f"SELECT doc_id AS _id, CAST(len({_TOKENS}) AS BIGINT) AS n, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(F.col("text"))
    return table(spark, sf, "documents").select("_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT count(*) AS n, CAST(sum(len({_TOKENS})) AS BIGINT) AS total_len FROM documents")
def fts_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_search.corpus_stats(table(spark, sf, "documents"), "text")


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(DISTINCT doc_id) >= 5")
def fts_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = text_search.postings(table(spark, sf, "documents"), "text")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter("df >= 5")


@query(f"SELECT doc_id AS _id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY doc_id, token")
def fts_postings_full(spark: SparkSession, sf: str) -> DataFrame:
    return text_search.postings(table(spark, sf, "documents"), "text")


@query(f"WITH d AS (SELECT list_distinct({_TOKENS}) AS t FROM documents) SELECT tok AS token, round(ln(1 + (count(*) - count(*) FILTER (list_contains(t, tok)) + 0.5) / (count(*) FILTER (list_contains(t, tok)) + 0.5)), 6) AS idf FROM d CROSS JOIN (VALUES ('the'), ('and'), ('zebra')) v(tok) GROUP BY tok")
def idf_of_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(tokens(F.col("text")).alias("t"))
    counted = docs.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.array_contains("t", w)).alias(w) for w in ("the", "and", "zebra")))
    return counted.select("n", F.inline(F.array(*(F.struct(F.lit(w).alias("token"), F.col(w).alias("df")) for w in ("the", "and", "zebra"))))).select("token", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("_id", F.round("score", 6).alias("score"))


@query(_bm25(["anred", "hestwh", "the"]) + " SELECT doc_id AS _id, round(s, 6) AS score FROM scored ORDER BY s DESC, doc_id LIMIT 10")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(text_search.search_text(table(spark, sf, "documents"), "text", "Anred hestwh THE the", 10))


@query(_bm25(["the", "and"]) + " SELECT doc_id AS _id, round(s, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY s DESC, doc_id LIMIT 10")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(text_search.search_text(table(spark, sf, "documents"), "text", "the and", 10, filter={"lang": "de"}))


@query(_bm25(["thing", "ereaing"], 2.0, 0.3) + " SELECT doc_id AS _id, round(s, 6) AS score FROM scored ORDER BY s DESC, doc_id LIMIT 5")
def bm25_tuned(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(text_search.search_text(table(spark, sf, "documents"), "text", "thing ereaing", 5, k1=2.0, b=0.3))


# --- vectors -----------------------------------------------------------------------------------

#: A fixed query vector of 64 numbers.
VECTOR = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_QUERY = "[" + ", ".join(f"{v}::DOUBLE" for v in VECTOR) + "]"
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _nearest(name: str, metric: str, expression: str, filter: dict | None = None, where: str = "true") -> None:  # noqa: A002
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _hits(knn.find_nearest(table(spark, sf, "embeddings"), "embedding", VECTOR, 10, metric, filter))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT vec_id AS _id, round({expression}, 6) AS score FROM embeddings WHERE {where} ORDER BY {expression} DESC, vec_id LIMIT 10"


_nearest("knn_cosine", "cosine", f"list_cosine_similarity({_V}, {_QUERY})")
_nearest("knn_dot", "dot", f"list_inner_product({_V}, {_QUERY})")
_nearest("knn_euclidean", "euclidean", f"1 / (1 + list_distance({_V}, {_QUERY}))")
_nearest("knn_filtered", "cosine", f"list_cosine_similarity({_V}, {_QUERY})", {"label": {"$lt": 3}}, "label < 3")


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, _id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS _id, list_cosine_similarity({_V.replace('embedding', 'e.embedding')}, {_V.replace('embedding', 'q.embedding')}) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity({_V.replace('embedding', 'e.embedding')}, {_V.replace('embedding', 'q.embedding')}) DESC, e.vec_id) AS rank FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector asks for its five nearest among all."""
    vectors = table(spark, sf, "embeddings")
    found = knn.batch_nearest(vectors, "embedding", vectors.filter("vec_id % 50 = 0"), "embedding", 5)
    return found.withColumn("score", F.round("score", 6))


@query()
def ann_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.ApproximateIndex(table(spark, sf, "embeddings"), "embedding").find_nearest(VECTOR, 10))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("_id", "embedding", "label")
    return table(spark, sf, "documents").join(vectors, "_id")


def _hybrid_sql(pool: int, top: int, wt: float, wv: float, where: str = "true") -> str:
    # text statistics cover the documents that have a vector, as the query's corpus does
    corpus = _bm25(["the", "thing"]).replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
    return corpus + f""",
allowed AS (SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE {where}),
t AS (SELECT doc_id AS _id, CAST(row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS INTEGER) AS text_rank FROM scored WHERE doc_id IN (SELECT doc_id FROM allowed)),
v AS (SELECT vec_id AS _id, CAST(row_number() OVER (ORDER BY list_cosine_similarity({_V}, {_QUERY}) DESC, vec_id) - 1 AS INTEGER) AS vector_rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM allowed)),
f AS (SELECT coalesce(t._id, v._id) AS _id, coalesce({wt} / (60 + text_rank + 1), 0) + coalesce({wv} / (60 + vector_rank + 1), 0) AS s, text_rank, vector_rank
      FROM (SELECT * FROM t WHERE text_rank < {pool}) t FULL JOIN (SELECT * FROM v WHERE vector_rank < {pool}) v ON t._id = v._id)
SELECT _id, round(s, 8) AS score, text_rank, vector_rank FROM f ORDER BY s DESC, _id LIMIT {top}"""


def _fused(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 8))


@query(_hybrid_sql(40, 10, 1.0, 1.0))
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(hybrid.hybrid_search(_both(spark, sf), "text", "the thing", "embedding", VECTOR, 10))


@query(_hybrid_sql(30, 8, 2.0, 0.5))
def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(hybrid.hybrid_search(_both(spark, sf), "text", "the thing", "embedding", VECTOR, 8, candidates=30, text_weight=2.0, vector_weight=0.5))


@query(_hybrid_sql(40, 10, 1.0, 1.0, "label < 4"))
def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(hybrid.hybrid_search(_both(spark, sf), "text", "the thing", "embedding", VECTOR, 10, filter={"label": {"$lt": 4}}))


# --- writes as functions of frames -------------------------------------------------------------


@query("SELECT s_suppkey AS _id, CASE WHEN s_acctbal < 0 THEN 'owes' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN 1 END AS flag FROM supplier")
def update_set(spark: SparkSession, sf: str) -> DataFrame:
    out = updates.update_many(table(spark, sf, "supplier"), {"s_acctbal": {"$lt": 0}}, {"$set": {"s_name": "owes", "flag": 1}})
    return out.select("_id", "s_name", F.col("flag").cast("int").alias("flag"))


@query("SELECT s_suppkey AS _id, CASE WHEN s_nationkey <> 3 THEN s_name END AS s_name FROM supplier")
def update_unset(spark: SparkSession, sf: str) -> DataFrame:
    return updates.update_many(table(spark, sf, "supplier"), {"s_nationkey": 3}, {"$unset": {"s_name": True}}).select("_id", "s_name")


@query("SELECT p_partkey AS _id, CASE WHEN p_size > 40 THEN p_size - 40 ELSE p_size END AS p_size, round(CASE WHEN p_size > 40 THEN p_retailprice + 0.5 ELSE p_retailprice END, 2) AS p_retailprice FROM part")
def update_inc(spark: SparkSession, sf: str) -> DataFrame:
    out = updates.update_many(table(spark, sf, "part"), {"p_size": {"$gt": 40}}, {"$inc": {"p_size": -40, "p_retailprice": 0.5}})
    return out.select("_id", F.col("p_size").cast("int").alias("p_size"), F.round("p_retailprice", 2).alias("p_retailprice"))


@query("SELECT p_partkey AS _id, CASE WHEN p_size = 1 THEN replace(p_name || ' ' || p_type, ' ', ',') || ',TINY' ELSE replace(p_name || ' ' || p_type, ' ', ',') END AS words FROM part")
def update_push(spark: SparkSession, sf: str) -> DataFrame:
    return updates.update_many(_words(spark, sf), {"p_size": 1}, {"$push": {"words": "TINY"}}).select("_id", F.array_join("words", ",").alias("words"))


@query("SELECT p_partkey AS _id, array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> 'ring'), ',') AS words FROM part")
def update_pull(spark: SparkSession, sf: str) -> DataFrame:
    return updates.update_many(_words(spark, sf), {}, {"$pull": {"words": "ring"}}).select("_id", F.array_join("words", ",").alias("words"))


@query("SELECT c_custkey AS _id, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal < 0) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_one(spark: SparkSession, sf: str) -> DataFrame:
    return updates.update_one(table(spark, sf, "customer"), {"c_acctbal": {"$lt": 0}}, {"$set": {"c_acctbal": 0}}).select("_id", "c_acctbal")


@query("SELECT event_id AS _id, event_type FROM events WHERE event_type <> 'click' OR event_type IS NULL")
def delete_many(spark: SparkSession, sf: str) -> DataFrame:
    return updates.delete_many(table(spark, sf, "events"), {"event_type": "click"}).select("_id", "event_type")


@query("SELECT n_nationkey AS _id, n_name FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
def delete_one(spark: SparkSession, sf: str) -> DataFrame:
    return updates.delete_one(table(spark, sf, "nation"), {"n_regionkey": 2}).select("_id", "n_name")


@query("SELECT s_suppkey AS _id, CASE WHEN s_suppkey % 10 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'added' FROM supplier WHERE s_suppkey % 25 = 0")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "supplier").select("_id", "s_name")
    changed = held.filter("_id % 10 = 0").select("_id", F.lit("new").alias("s_name"))
    added = held.filter("_id % 25 = 0").select((F.col("_id") + 1000000).alias("_id"), F.lit("added").alias("s_name"))
    return updates.upsert(held, changed.unionAll(added))


@query("SELECT r_regionkey AS _id, r_name FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name) FROM region")
def insert_many(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "region").select("_id", "r_name")
    return updates.insert_many(held, held.select((F.col("_id") + 100).cast("int").alias("_id"), F.upper("r_name").alias("r_name")))


# --- the client's query layer ------------------------------------------------------------------


@query("SELECT o_orderkey AS _id, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_totalprice <= 150000")
def params_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = sync.parameter
    bind = sync.define_params({"status": p("eq", "o_orderstatus"), "min": p("gte", "o_totalprice"), "max": p("lte", "o_totalprice"), "page": p("shape"), "in": p("one_of", "o_custkey")})
    return reads.find(table(spark, sf, "orders"), bind({"status": "O", "min": 100000, "max": 150000, "page": 2, "in": [], "other": "x"}), fields=_O)


@query("SELECT q AS query_id, CAST(pos AS INTEGER) AS pos, n_nationkey AS _id, n_name FROM (VALUES (1, 0, 7), (1, 1, 3), (1, 2, 20), (2, 1, 5)) v(q, pos, id) JOIN nation ON n_nationkey = id")
def ordered_membership(spark: SparkSession, sf: str) -> DataFrame:
    lists = spark.range(1).select(F.inline(F.expr("array(struct(1 AS query_id, array(7, 3, 20) AS ids), struct(2 AS query_id, array(400, 5) AS ids), struct(3 AS query_id, CAST(NULL AS array<int>) AS ids))")))
    return sync.members(table(spark, sf, "nation"), lists).select("query_id", "pos", "_id", "n_name")


@query("SELECT user_id AS _id, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def hydrate_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    payload = table(spark, sf, "events").select(F.col("user_id").alias("_id"), "event_type", "event_id")
    return sync.deduplicate(payload, "event_id")


@query("WITH p AS (SELECT c_custkey, c_nationkey FROM customer) SELECT count(*) FILTER (s IS NULL) AS inserted, count(*) FILTER (s = 'synced') AS updated, count(*) FILTER (s <> 'synced') AS skipped FROM (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'pending' ELSE 'synced' END AS s FROM supplier) d RIGHT JOIN p ON s_suppkey = c_custkey")
def hydrate_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "supplier").select("_id", F.when(F.col("s_nationkey") % 3 == 0, "pending").when(F.col("s_nationkey") % 3 == 1, "synced").alias("_sync"), F.lit(0).cast("long").alias("_changed_at"))
    payload = table(spark, sf, "customer").select("_id", F.col("c_custkey").alias("at"))
    return sync.hydrate(docs, payload, "at", 1)[1]


@query("SELECT o_orderkey AS _id, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey <= 800 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def outbox_drain(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "orders").withColumns({"_sync": F.when(F.col("o_orderstatus") == "P", "pending").otherwise("synced"), "_retry_at": F.col("o_custkey"), "_changed_at": F.col("o_orderdate")})
    return sync.outbox(docs, 800).select("_id", "o_custkey")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op FROM events),
s AS (SELECT user_id, k, op AS a FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, CASE WHEN a = '' THEN op WHEN a = 'insert' THEN CASE WHEN op = 'delete' THEN '' ELSE 'insert' END WHEN a = 'update' THEN CASE WHEN op = 'delete' THEN 'delete' ELSE 'update' END ELSE 'delete' END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id AS _id, arg_max(a, k) AS op FROM s GROUP BY 1 HAVING arg_max(a, k) <> ''""")
def op_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ops = e.select(F.col("user_id").alias("_id"), "event_id", F.when(e.event_id % 5 == 0, "delete").when(e.event_id % 5 == 1, "insert").otherwise("update").alias("op"))
    return sync.coalesced(ops, "event_id")


@query("SELECT CAST(n AS INTEGER) AS attempt, CAST(least(1000 * pow(2, greatest(n - 1, 0)), 300000) AS BIGINT) AS wait FROM range(0, 12) t(n)")
def backoff(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(12).select(F.col("id").cast("int").alias("attempt"), sync.backoff_ms(F.col("id"), F.lit(0.5)).alias("wait"))


@query("SELECT p_partkey AS _id, CASE WHEN p_partkey % 3 < 1 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 < 2 THEN p_size * 10 ELSE p_size END AS p_size, 2 AS _v FROM part")
def shape_migrate(spark: SparkSession, sf: str) -> DataFrame:
    """Parts at three versions, read at the latest."""
    held = table(spark, sf, "part").select("_id", "p_name", "p_size", F.when(F.col("_id") % 3 > 0, (F.col("_id") % 3).cast("int")).alias("_v"))
    return shape.migrate(held, [{"p_name": F.upper("p_name")}, {"p_size": F.col("p_size") * 10}])


# --- sources and sinks -------------------------------------------------------------------------


@query("SELECT n_nationkey AS _id, n_nationkey || ',' || n_name || ',' || n_regionkey || ',' || n_nationkey AS line FROM nation")
def export_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return io.csv_rows(table(spark, sf, "nation"))


@query("SELECT event_id AS _id, event_type FROM events WHERE event_type = 'click' AND event_id > 100")
def changes_since(spark: SparkSession, sf: str) -> DataFrame:
    return live.changes(table(spark, sf, "events"), {"event_type": "click"}, 100).select("_id", "event_type")


@query("SELECT c_custkey AS _id, c_name FROM customer")
def field_encryption(spark: SparkSession, sf: str) -> DataFrame:
    """Names sealed and opened again."""
    key = bytes(range(32))
    sealed = crypto.encrypt_fields(table(spark, sf, "customer").select("_id", "c_name"), ["c_name"], key)
    return crypto.decrypt_fields(sealed, {"c_name": "string"}, key)


@query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_valid FROM part")
def derive_doc_id(spark: SparkSession, sf: str) -> DataFrame:
    """An id for every part: none twice, each of the right form."""
    made = table(spark, sf, "part").select(ids.derived_id_column("part", F.col("p_partkey")).alias("id"))
    return made.agg(F.count("id").alias("n"), F.count_distinct("id").alias("n_distinct"), F.count_if(F.col("id").rlike(f"^[0-7][{ids.ALPHABET}]{{25}}$")).alias("n_valid"))


# Ids that every client must derive alike.
@query("SELECT * FROM (VALUES ('sku-123', '56GC678DQYWW1Z98HPYJ90WVKH'), ('sku-\u00f1-\U0001f4a1', '5NZ0PGNM2CF0BTHN0AAX8CWPAA')) v(key, _id)")
def derive_known_ids(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([("sku-123",), ("sku-\u00f1-\U0001f4a1",)], "key string")
    return keys.select("key", ids.derived_id_column("products", F.col("key")).alias("_id"))


# --- collections: each query makes its own, in the folder that the session shares --------------


def _database(spark: SparkSession) -> Database:
    return Database(spark, f"{shared_folder(spark)}/quillon-db-{uuid.uuid4().hex}")


def _filled(spark: SparkSession, sf: str, name: str, fields: Sequence[str], caller: str | None = None) -> Collection:
    made = _database(spark).collection(name, caller)
    made.insert_many(table(spark, sf, name).select("_id", *fields))
    return made


@query("SELECT c_custkey AS _id, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey + 10000000, 'copy', 1.0 FROM customer WHERE c_custkey % 10 = 0")
def collection_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, update, delete and insert again; read what is left."""
    c = _filled(spark, sf, "customer", ["c_mktsegment", "c_acctbal", "c_nationkey"])
    c.delete_many({"c_nationkey": 3})
    c.update_many({"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "owes", "c_acctbal": 0.0}})
    more = table(spark, sf, "customer").filter("c_custkey % 10 = 0")
    c.insert_many(more.select((F.col("_id") + 10000000).cast("int").alias("_id"), F.lit("copy").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"), F.lit(0).alias("c_nationkey")))
    return c.find(fields=["c_mktsegment", "c_acctbal"])


@query("SELECT s_suppkey AS _id, s_name, s_acctbal FROM supplier WHERE s_nationkey <> 4")
def compact_keeps_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Segments merged and old files deleted: the same documents."""
    c = _filled(spark, sf, "supplier", ["s_name", "s_acctbal", "s_nationkey"])
    c.delete_many({"s_nationkey": 4})
    c.compact(vacuum=True)
    return c.find(fields=["s_name", "s_acctbal"])


@query("SELECT s_suppkey AS _id, CASE WHEN s_suppkey % 4 = 0 THEN 'third' ELSE s_name END AS s_name FROM supplier")
def upsert_repeated_id(spark: SparkSession, sf: str) -> DataFrame:
    """Of a batch's documents with one id the last counts."""
    held = table(spark, sf, "supplier").select("_id", "s_name", F.lit(0).alias("at"))
    some = held.filter("_id % 4 = 0")
    batch = some.withColumns({"s_name": F.lit("first"), "at": F.lit(1)}).unionAll(some.withColumns({"s_name": F.lit("third"), "at": F.lit(3)})).unionAll(some.withColumns({"s_name": F.lit("second"), "at": F.lit(2)}))
    return updates.upsert(held, batch, "at").select("_id", "s_name")


_EDITED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN text || ' zebra zebra' ELSE text END AS text, lang FROM documents WHERE lang <> 'fr')"


@query(_bm25(["zebra", "the", "thing"]).replace("FROM documents", f"FROM {_EDITED}") + " SELECT doc_id AS _id, round(s, 6) AS score FROM scored ORDER BY s DESC, doc_id LIMIT 25")
def fts_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The stored text index after a delete and an upsert."""
    c = _filled(spark, sf, "documents", ["text", "lang"])
    c.create_text_index("text")
    c.delete_many({"lang": "fr"})
    edited = c.find().filter("_id % 10 = 7").withColumn("text", F.concat("text", F.lit(" zebra zebra")))
    c.replace_many(edited.drop("_changed_at"))
    return _hits(c.search_text("text", "Zebra THE thing", 25))


@query(_bm25(["the", "thing"]).replace("FROM documents", f"FROM {_EDITED}") + " SELECT doc_id AS _id, round(s, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY s DESC, doc_id LIMIT 10")
def fts_index_filtered(spark: SparkSession, sf: str) -> DataFrame:
    c = _filled(spark, sf, "documents", ["text", "lang"])
    c.create_text_index("text")
    edited = c.find().filter("_id % 10 = 7").withColumn("text", F.concat("text", F.lit(" zebra zebra")))
    c.replace_many(edited.drop("_changed_at"))
    c.delete_many({"lang": "fr"})
    c.compact()
    return _hits(c.search_text("text", "the thing", 10, filter={"lang": "de"}))


@query("SELECT op, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 'insert' AS op, p_partkey AS id FROM part UNION ALL SELECT 'update', p_partkey FROM part WHERE p_size > 40 UNION ALL SELECT 'delete', p_partkey FROM part WHERE p_size = 1) GROUP BY op")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The row-level feed of a collection's commits."""
    c = _filled(spark, sf, "part", ["p_size"])
    c.update_many({"p_size": {"$gt": 40}}, {"$inc": {"p_size": 1}})
    c.delete_many({"p_size": 1})
    return c.db.changes().groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"))


@query("SELECT 'part' AS collection, op, 'job' AS caller, count(DISTINCT id) AS n FROM (SELECT 'update' AS op, p_partkey AS id FROM part WHERE p_size > 40 UNION ALL SELECT 'delete', p_partkey FROM part WHERE p_size = 1) GROUP BY op")
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries after the inserts': one for each document and write."""
    c = _filled(spark, sf, "part", ["p_size"], caller="job")
    last = c.db.audit_log("part", "insert").agg(F.max("_id")).first()[0]
    c.update_many({"p_size": {"$gt": 40}}, {"$inc": {"p_size": 1}})
    c.delete_many({"p_size": 1})
    return c.db.audit_log(since=last).groupBy("collection", "op", "caller").agg(F.count_distinct("_id").alias("n"))


@query("SELECT n_nationkey AS _id, n_name FROM nation WHERE n_regionkey <> 2")
def snapshot_restore(spark: SparkSession, sf: str) -> DataFrame:
    c = _filled(spark, sf, "nation", ["n_name", "n_regionkey"])
    c.delete_many({"n_regionkey": 2})
    path = f"{c.db.store.base}-copy"
    c.db.export_snapshot(path)
    return Database.restore_snapshot(spark, path, f"{path}-back").collection("nation").find(fields=["n_name"])


@query("SELECT * FROM (VALUES ('nation', 'field:n_name,n_regionkey'), ('nation', 'text:n_name'), ('region', 'field:r_name'), ('region', 'vector:v')) v(collection, index)")
def list_collections_and_indexes(spark: SparkSession, sf: str) -> DataFrame:
    c = _filled(spark, sf, "nation", ["n_name", "n_regionkey"])
    c.create_index("n_name", "n_regionkey"), c.create_text_index("n_name"), c.create_index("gone"), c.drop_index("gone")
    r = c.db.collection("region")
    r.insert_many(table(spark, sf, "region"))
    r.create_index("r_name"), r.create_vector_index("v", 3)
    return spark.createDataFrame([(n, i) for n in c.db.collections() for i in c.db.collection(n).indexes()], "collection string, index string")


@query("SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 7 = 0 THEN 'late' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS VARCHAR) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_several_operators(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("seven", F.col("_id") % 7)
    out = updates.update_many(df, {"seven": 0}, {"$set": {"o_orderstatus": "late"}, "$inc": {"o_custkey": 5}, "$unset": {"o_orderpriority": True}})
    return out.select("_id", "o_orderstatus", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderpriority")


@query("SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 11 THEN 'ELEVEN' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 12")
def update_and_delete_by_id(spark: SparkSession, sf: str) -> DataFrame:
    c = _filled(spark, sf, "nation", ["n_name"])
    c.update_one({"_id": 11}, {"$set": {"n_name": "ELEVEN"}})
    c.delete_one({"_id": 12})
    return c.find(fields=["n_name"])


@query("SELECT * FROM (VALUES (1, 25), (2, 24), (3, 24)) v(look, n)")
def watch_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """What a watch sees after each of several writes; looks without a write see nothing."""
    c = _filled(spark, sf, "nation", ["n_name", "n_regionkey"])
    seen, w = [c.count()], live.watch(c, {})
    for write in (lambda: c.delete_one({"n_regionkey": 1}), lambda: None, lambda: c.update_many({"n_regionkey": 2}, {"$set": {"n_name": "x"}})):
        write()
        found = w.try_next()
        if found is not None:
            seen.append(found.count())
    return spark.createDataFrame(list(enumerate(seen, 1)), "look int, n int")


@query("SELECT s_name, s_acctbal, s_nationkey FROM supplier")
def import_exported_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines out and in again."""
    path = f"{shared_folder(spark)}/quillon-json-{uuid.uuid4().hex}"
    io.export_json(table(spark, sf, "supplier").select("_id", "s_name", "s_acctbal", "s_nationkey"), path)
    back = io.import_json(spark, path, "supplier", "s_name string, s_acctbal double, s_nationkey int")
    return back.select("s_name", "s_acctbal", "s_nationkey")


@query("SELECT r_regionkey AS _id, r_name FROM region")
def import_exported_array(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/quillon-json-{uuid.uuid4().hex}"
    io.export_json(table(spark, sf, "region").select("_id", "r_name", F.col("r_regionkey").alias("key")), path, lines=False)
    return io.import_json(spark, path, "region", "key int, r_name string").select(F.col("key").alias("_id"), "r_name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name, '[' || n_regionkey || ',2]' AS pair FROM nation")
def export_csv_header(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with a header, read by it: an empty first value leaves its field out."""
    path = f"{shared_folder(spark)}/quillon-csv-{uuid.uuid4().hex}"
    io.export_csv(table(spark, sf, "nation").select("_id", "n_name", F.array("n_regionkey", F.lit(2)).alias("pair"), F.lit(None).cast("string").alias("none")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


_REFUSED = [("$where", {"$where": 1}), ("two operators' names", {"a": {"$near": 1}}), ("a list", [1]), ("or of nothing", {"$or": 5}), ("regex", {"a": {"$regex": "("}}), ("in", {"a": {"$in": 3}})]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', 'InvalidFilter')" for n, _ in _REFUSED) + ") v(name, code)")
def filter_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    held, found = table(spark, sf, "nation"), []
    for name, spec in _REFUSED:
        try:
            reads.find(held, spec)
        except EngineError as e:
            found.append((name, e.code))
    return spark.createDataFrame(found, "name string, code string")


@query("SELECT * FROM (VALUES ('insert', 'VectorDimensionMismatch'), ('upsert', 'VectorDimensionMismatch'), ('update', 'VectorDimensionMismatch'), ('query', 'VectorDimensionMismatch'), ('compound', 'CompoundIndexMultipleArrays')) v(name, code)")
def write_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions and compound arrays are checked on every path."""
    c = _database(spark).collection("v")
    one = c.insert({"v": [1.0, 2.0], "tags": ["x"]})
    c.create_vector_index("v", 2), c.create_index("v", "n")
    tries = {
        "insert": lambda: c.insert({"v": [1.0]}), "upsert": lambda: c.upsert([{"_id": one, "v": [1.0, 2.0, 3.0]}]), "update": lambda: c.update_many({}, {"$push": {"v": 1.0}}),
        "query": lambda: c.find_nearest("v", [1.0]), "compound": lambda: c.create_index("v", "tags"),
    }
    found = []
    for name, attempt in tries.items():
        try:
            attempt()
        except EngineError as e:
            found.append((name, e.code))
    return spark.createDataFrame(found, "name string, code string")


@query("SELECT true AS enough")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate search finds nine of ten of the exact nearest, over 20 queries."""
    vectors = table(spark, sf, "embeddings")
    index = knn.ApproximateIndex(vectors, "embedding")
    asked = vectors.filter("vec_id < 20")
    both = [{(r["query_id"], r["_id"]) for r in found.collect()} for found in (knn.batch_nearest(vectors, "embedding", asked, "embedding", 10), index.batch_nearest(asked, "embedding", 10))]
    return spark.createDataFrame([(len(both[0] & both[1]) >= 9 * len({q for q, _ in both[0]}),)], "enough boolean")


# --- documents without a schema ----------------------------------------------------------------


def _dynamic(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","props":'), F.coalesce("props", F.lit("null")), F.when(e.event_id % 3 == 0, F.lit(',"v":')).otherwise(F.lit(',"w":')), F.when(e.event_id % 2 == 0, F.col("event_id").cast("string")).otherwise(F.lit('"odd"')), F.lit("}"))
    return dynamic.parse_documents(e.select("_id", doc.alias("json")), "json")


@query("SELECT event_id AS _id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'click'")
def dynamic_filter(spark: SparkSession, sf: str) -> DataFrame:
    return dynamic.find(_dynamic(spark, sf), {"props.k": {"$gte": 50}, "type": {"$ne": "click"}}).select("_id")


@query("SELECT event_id AS _id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 AND event_id > 500.5")
def dynamic_mixed_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return dynamic.find(_dynamic(spark, sf), {"v": {"$gt": 500.5}}).select("_id")


@query("SELECT event_id AS _id FROM events ORDER BY event_id % 3 <> 0, CASE WHEN event_id % 3 = 0 THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) END, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN -event_id END, event_id LIMIT 30")
def dynamic_sort(spark: SparkSession, sf: str) -> DataFrame:
    return dynamic.find(_dynamic(spark, sf), sort={"v": -1}, limit=30).select("_id")


@query("SELECT CASE WHEN event_id % 3 <> 0 THEN 'none' WHEN event_id % 2 = 0 THEN 'number' ELSE 'odd' END AS _id, count(*) AS n FROM events GROUP BY 1")
def dynamic_group(spark: SparkSession, sf: str) -> DataFrame:
    found = dynamic.group_count(_dynamic(spark, sf), "v")
    name = F.when(F.col("_id.rank") <= 1, "none").when(F.col("_id.rank") == 3, "number").otherwise(F.col("_id.str"))
    return found.groupBy(name.alias("_id")).agg(F.sum("n").alias("n"))


# --- streams -----------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the event-time aggregation; streams run the same function."""
    found = live.windowed_counts(table(spark, sf, "events"))
    return found.select(F.col("window_start").cast(T.TimestampNTZType()).alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
