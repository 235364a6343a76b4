import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillon.errors import EngineError
from quillon.operators.find import find
from quillon.plans.filters import parse
from quillon.plans.pipeline import aggregate


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(
        [("a", ["x", "y"], [1, 20], 5.0, "The quick fox", {"city": "Oslo"}), ("b", ["z"], [30], 0.0, "slow fox", None), ("c", [], None, -0.0, None, {"city": None}), ("d", None, [], math.nan, "", {"city": "Rome"})],
        "_id string, tags array<string>, scores array<bigint>, f double, text string, addr struct<city: string>",
    )


CASES = [
    ({"tags": "x"}, "a"), ({"tags": {"$ne": "x"}}, "bcd"), ({"tags": ["x", "y"]}, "a"), ({"scores": {"$gt": 10}}, "ab"), ({"scores": {"$gt": 1, "$lt": 20}}, "a"),
    ({"tags": {"$in": ["z", 3]}}, "b"), ({"tags": {"$nin": ["z"]}}, "acd"), ({"tags": {"$in": []}}, ""), ({"tags": None}, "d"), ({"tags": {"$regex": "^[xz]$"}}, "ab"),
    ({"f": 0}, "bc"), ({"f": {"$gte": 0}}, "abc"), ({"f": {"$gt": -1e300}}, "abc"), ({"f": math.nan}, ""), ({"f": {"$ne": math.nan}}, "abcd"), ({"f": "5"}, ""), ({"f": True}, ""),
    ({"text": {"$contains": "FOX the"}}, "a"), ({"text": {"$contains": "!"}}, "abcd"), ({"none": {"$contains": "!"}}, "abcd"), ({"tags": {"$contains": "x1"}}, ""),
    ({"addr.city": "Oslo"}, "a"), ({"addr.city": {"$exists": True}}, "acd"), ({"addr.city": {"$exists": False}}, "b"), ({"addr.city": None}, "c"), ({"addr.city": {"$ne": "Oslo"}}, "bcd"), ({"addr.city.deep": {"$exists": True}}, ""),
    ({"none": None}, ""), ({"none": {"$exists": False}}, "abcd"), ({"$or": []}, ""), ({"$and": []}, "abcd"), ({}, "abcd"), (None, "abcd"), ({"$not": {"text": {"$regex": "fox"}}}, "cd"),
    ({"$not": {"$or": [{"tags": "x"}, {"f": {"$lt": 0.5}}]}}, "d"), ({"_id": {"$in": ["a", "zz"]}}, "a"), ({"text": {"$gt": "a"}}, "b"), ({"text": {"$gt": 1}}, ""), ({"text": {"$nin": [None, ""]}}, "ab"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_semantics(posts, case):
    spec, want = CASES[case]
    assert "".join(ids(find(posts, spec))) == want


@pytest.mark.parametrize("spec", [{"a": {"$near": 1}}, {"$nor": []}, {"$and": {}}, {"a": {"$in": 1}}, {"a": {"$exists": 1}}, {"a": {"$regex": 1}}, {"a": {"$contains": 1}}, {"a": {}}, {"a": {"plain": 1}}, {"a": {"$regex": "("}}, {"a": {"$regex": "(?=x)"}}, {"a": {"$regex": "(a)\\1"}}, 7])
def test_malformed_filters_raise(spark, spec):
    with pytest.raises(EngineError) as e:
        parse(spec)
    assert e.value.code == "InvalidFilter"


def test_whole_numbers_compare_exactly(spark):
    big = 2**53
    df = spark.createDataFrame([(1, big), (2, big + 1), (3, None), (4, -(2**63))], "_id int, n bigint")
    assert ids(find(df, {"n": {"$gt": float(big)}})) == [2]
    assert ids(find(df, {"n": {"$gte": big + 0.0}})) == [1, 2]
    assert ids(find(df, {"n": {"$lt": 1e30}})) == [1, 2, 4]
    assert ids(find(df, {"n": {"$gt": math.inf}})) == []
    assert ids(find(df, {"n": {"$lte": -0.5}})) == [4]
    assert ids(find(df, {"n": {"$ne": big}})) == [2, 3, 4]
    doubles = spark.createDataFrame([(1, float(big)), (2, float(big + 2))], "_id int, n double")
    assert ids(find(doubles, {"n": {"$gt": big + 1}})) == [2]
    assert ids(find(doubles, {"n": {"$gte": big + 1}})) == [2]
    assert ids(find(doubles, {"n": {"$lt": big + 1}})) == [1]


def _python(doc, spec):
    """The filter language over one document, plainly."""
    for key, want in spec.items():
        if key == "$and":
            ok = all(_python(doc, s) for s in want)
        elif key == "$or":
            ok = any(_python(doc, s) for s in want)
        elif key == "$not":
            ok = not _python(doc, want)
        else:
            v = doc[key]
            ok = all(_one(v, op, w) for op, w in (want.items() if isinstance(want, dict) else [("$eq", want)]))
        if not ok:
            return False
    return True


def _one(v, op, w):
    if op in ("$ne", "$nin"):
        return not _one(v, {"$ne": "$eq", "$nin": "$in"}[op], w)
    if op == "$in":
        return any(_one(v, "$eq", x) for x in w)
    if op == "$eq":
        return v is None if w is None else v is not None and type(v) is type(w) and v == w
    if v is None or isinstance(v, str) != isinstance(w, str):
        return False
    return {"$gt": v > w, "$gte": v >= w, "$lt": v < w, "$lte": v <= w}[op]


_value = {"n": st.one_of(st.none(), st.integers(-3, 3)), "s": st.one_of(st.none(), st.sampled_from(["", "a", "b", "é"]))}
_leaf = st.one_of(
    *(st.builds(lambda op, v, f=f: {f: {op: v}}, st.sampled_from(["$eq", "$ne"]), _value[f]) for f in _value),
    *(st.builds(lambda op, v, f=f: {f: {op: v}}, st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), _value[f].filter(lambda x: x is not None)) for f in _value),
    *(st.builds(lambda op, v, f=f: {f: {op: v}}, st.sampled_from(["$in", "$nin"]), st.lists(_value[f], max_size=3)) for f in _value),
)
_spec = st.recursive(_leaf, lambda s: st.one_of(st.builds(lambda x: {"$not": x}, s), st.builds(lambda k, xs: {k: xs}, st.sampled_from(["$and", "$or"]), st.lists(s, max_size=3))), max_leaves=6)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spec=_spec)
def test_against_plain_interpreter(spark, spec):
    docs = [{"_id": i, "n": n, "s": s} for i, (n, s) in enumerate((n, s) for n in (None, -3, 0, 2) for s in (None, "", "a", "é"))]
    df = spark.createDataFrame([(d["_id"], d["n"], d["s"]) for d in docs], "_id int, n bigint, s string")
    assert ids(find(df, spec)) == [d["_id"] for d in docs if _python(d, spec)]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS _id", "id % 3 AS a", "cast(id AS string) AS s", "id AS unread").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = find(df, {"a": {"$gte": 1, "$ne": 2}, "$or": [{"s": "4"}, {"s": {"$in": ["1", "7"]}}]}, fields=["a"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,1)" in plan and "In(s" in plan or "EqualTo(s,4)" in plan
    assert "unread" not in plan
    late = aggregate(df, [{"$sort": {"s": 1}}, {"$match": {"a": 1}}])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,1)" in late
