import pytest

from quillon.errors import EngineError
from quillon.plans.pipeline import aggregate


def out(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, "tea", 41), (2, "tea", 17), (3, "ink", 8), (4, "ink", 90), (5, "ink", 3), (6, None, None)], "_id int, dept string, amount bigint")


def test_sum_count_and_null_group(sales):
    found = out(aggregate(sales, [{"$group": {"_id": "$dept", "total": {"$sum": "$amount"}, "n": {"$sum": 1}, "m": {"$count": {}}}}, {"$sort": {"_id": 1}}]))
    assert found == [{"_id": None, "total": 0, "n": 1, "m": 1}, {"_id": "ink", "total": 101, "n": 3, "m": 3}, {"_id": "tea", "total": 58, "n": 2, "m": 2}]


def test_exact_integer_sum(spark):
    df = spark.createDataFrame([(1, 3 * 2**60), (2, -7), (3, 5)], "_id int, n bigint")
    assert out(aggregate(df, [{"$group": {"_id": None, "s": {"$sum": "$n"}}}])) == [{"_id": None, "s": 3 * 2**60 - 2}]


def test_null_key_of_nothing_has_no_rows(sales):
    assert out(aggregate(sales, [{"$match": {"dept": "none"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}])) == []


def test_ordered_accumulators(sales):
    group = {"_id": None, "all": {"$push": "$amount"}, "first": {"$first": "$amount"}, "last": {"$last": "$amount"}, "depts": {"$push": "$dept"}}
    up, = out(aggregate(sales, [{"$sort": {"amount": 1}}, {"$group": group}]))
    assert up["all"] == [None, 3, 8, 17, 41, 90] and up["first"] is None and up["last"] == 90
    down, = out(aggregate(sales, [{"$sort": {"amount": -1}}, {"$group": group}]))
    assert down["all"] == [90, 41, 17, 8, 3, None] and down["first"] == 90 and down["last"] is None
    text, = out(aggregate(sales, [{"$sort": {"dept": -1, "amount": 1}}, {"$group": group}]))
    assert text["depts"] == ["tea", "tea", "ink", "ink", "ink", None] and text["all"] == [17, 41, 3, 8, 90, None] and text["first"] == 17


def test_min_max_avg_and_sets(sales):
    got, = out(aggregate(sales, [{"$group": {"_id": None, "lo": {"$min": "$amount"}, "hi": {"$max": "$amount"}, "avg": {"$avg": "$amount"}, "set": {"$addToSet": "$dept"}, "none": {"$push": "$absent"}, "sum": {"$sum": "$absent"}, "nan": {"$avg": "$dept"}}}]))
    assert got == {"_id": None, "lo": None, "hi": 90, "avg": 31.8, "set": [None, "ink", "tea"], "none": [], "sum": 0, "nan": None}


def test_paging_never_repeats(spark):
    df = spark.range(100).selectExpr("cast(id AS int) AS _id", "id % 4 AS score")
    seen = [r["_id"] for k in range(0, 100, 10) for r in aggregate(df, [{"$sort": {"score": -1}}, {"$skip": k}, {"$limit": 10}]).collect()]
    assert sorted(seen) == list(range(100)) and seen == sorted(range(100), key=lambda i: (-(i % 4), i))


def test_order_outlives_projection(sales):
    got = aggregate(sales, [{"$sort": {"amount": -1}}, {"$project": {"dept": 1}}, {"$limit": 2}])
    assert got.columns == ["_id", "dept"] and [r["_id"] for r in got.collect()] == [4, 1]


def test_projection_rules(sales):
    assert aggregate(sales, [{"$project": {"dept": 0.5}}]).columns == ["_id", "dept"]
    assert aggregate(sales, [{"$project": {"_id": 0}}]).columns == ["dept", "amount"]
    assert aggregate(sales, [{"$project": {"a.b": 1}}]).columns == ["_id"]
    assert aggregate(sales, [{"$limit": 0}]).count() == 0
    assert aggregate(sales, [{"$limit": 2**60}]).count() == 6


@pytest.mark.parametrize("pipeline", [[{"$unwind": "a"}], [{"$match": {}, "$limit": 1}], [{"$group": {"n": {"$sum": 1}}}], [{"$group": {"_id": {}, "n": {"$sum": 1}}}], [{"$group": {"_id": None, "n": {"$sum": 2}}}], [{"$group": {"_id": None, "n": {"$median": "$a"}}}], [{"$project": {}}], [{"$project": {"a": 1, "b": 0}}], [{"$sort": {"a": 2}}], [{"$limit": -1}], {"$match": {}}])
def test_malformed_pipelines_raise(sales, pipeline):
    with pytest.raises(EngineError):
        aggregate(sales, pipeline)


def test_topk_is_one_operator(sales):
    plan = aggregate(sales, [{"$sort": {"amount": -1}}, {"$skip": 1}, {"$limit": 2}])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
