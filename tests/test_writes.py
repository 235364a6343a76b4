import pytest
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.functions import crypto, dynamic, ids
from quillon.operators import find, hybrid, knn, shape, sync, text_search, updates
from quillon.sources import io
from quillon.sources.collection import Database
from quillon.streaming import live


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, "file://" + str(tmp_path / "db"))


def docs(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda d: str(d["_id"]))


def test_updates(spark):
    df = spark.createDataFrame([(1, 5, 1.5, ["x"], "a"), (2, None, 2.5, None, "b")], "_id int, n bigint, f double, t array<string>, s string")
    got = docs(updates.update_many(df, {"_id": 1}, {"$inc": {"n": 2, "f": 1}, "$push": {"t": "y"}, "$set": {"s": "z", "new": 1}}))
    assert got[0] == {"_id": 1, "n": 7, "f": 2.5, "t": ["x", "y"], "s": "z", "new": 1} and got[1]["new"] is None and got[1]["s"] == "b"
    assert docs(updates.update_many(df, {}, {"$pull": {"t": "x"}, "$unset": {"s": 1, "gone": 1}}))[0] == {"_id": 1, "n": 5, "f": 1.5, "t": [], "s": None}
    assert docs(updates.update_many(df, {"_id": 2}, {"$push": {"t": "q"}}))[1]["t"] == ["q"]
    assert [d["s"] for d in docs(updates.update_one(df, {"f": {"$gt": 0}}, {"$set": {"s": "first"}}))] == ["first", "b"]
    with pytest.raises(Exception, match="TypeError"):
        updates.update_many(df, {}, {"$inc": {"n": 1}}).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        updates.update_many(df, {"_id": 1}, {"$inc": {"n": 2**63 - 1}}).collect()
    for bad in ({}, {"$rename": {}}, {"$set": {"a.b": 1}}, {"$inc": {"s": 1}}, {"$push": {"s": 1}}, {"$set": {"n": "text"}}, {"$set": {"_id": 3}}):
        with pytest.raises(EngineError):
            updates.update_many(df, {}, bad)


def test_deletes_and_inserts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "_id int, s string")
    assert [d["_id"] for d in docs(updates.delete_many(df, {"s": "a"}))] == [2]
    assert [d["_id"] for d in docs(updates.delete_one(df, {"s": "a"}))] == [2, 3]
    assert [d["_id"] for d in docs(updates.delete_one(df, {"s": "none"}))] == [1, 2, 3]
    bare = df.unionAll(spark.createDataFrame([(None, "b")], "_id int, s string"))
    assert updates.delete_one(bare, {"s": "none"}).count() == 4 and updates.upsert(df, df.limit(1).unionAll(df.limit(1))).count() == 3
    assert updates.delete_many(df).count() == 0
    new = spark.createDataFrame([(3, "z"), (4, "y")], "_id int, s string")
    assert [d["s"] for d in docs(updates.upsert(df, new))] == ["a", None, "z", "y"]
    for clash in (new, new.filter("_id = 4").unionAll(new.filter("_id = 4"))):
        with pytest.raises(EngineError) as e:
            updates.insert_many(df, clash)
        assert e.value.code == "DuplicateId"


def test_ids(spark):
    # fixed values: ids that every client derives alike
    assert ids.derived_id("products", "sku-123") == "56GC678DQYWW1Z98HPYJ90WVKH"
    assert ids.derived_id("", "") == "6J535PJ40THJQQH49BE174M53Z"
    assert ids.derived_id("products", "sku-ñ-💡") == "5NZ0PGNM2CF0BTHN0AAX8CWPAA"
    keys = ["", "sku-ñ-💡", "x" * 300, *map(str, range(200))]
    found = spark.createDataFrame([(k,) for k in [*keys, None]], "k string").select("k", ids.derived_id_column("products", F.col("k")).alias("id")).collect()
    assert all(r["id"] == (None if r["k"] is None else ids.derived_id("products", r["k"])) for r in found) and len(found) == len(keys) + 1
    made = [ids.new_id(1000) for _ in range(100)]
    assert made == sorted(made) and all(map(ids.is_id, made)) and not ids.is_id("x" * 26)


def test_collection_life(db):
    c = db.collection("books", caller="test")
    a, b = c.insert_many([{"title": "A", "n": 1, "v": [1.0, 0.0]}, {"title": "B b", "n": 2.5, "v": None}])
    assert c.count() == 2 and c.generation == 1 and c.find_by_id(a)["title"] == "A" and c.find_by_id("nope") is None
    with pytest.raises(EngineError) as e:
        c.insert({"_id": a, "title": "again"})
    assert e.value.code == "DuplicateId" and c.generation == 1
    with pytest.raises(EngineError):
        c.insert({"_id": "short"})
    assert c.update_many({"n": {"$gt": 2}}, {"$set": {"title": "C c"}}) == 1 and c.update_one({"n": 99}, {"$set": {"n": 0}}) is False
    with pytest.raises(EngineError) as e:
        c.search_text("title", "cc")
    assert e.value.code == "IndexNotFound"
    c.create_text_index("title"), c.create_vector_index("v", 2), c.create_index("n"), c.create_index("n", "title")
    assert c.find_nearest("v", [1, 0], 1).collect()[0]["_id"] == a
    with pytest.raises(EngineError) as e:
        c.insert({"title": "D", "v": [1.0, 2.0, 3.0]})
    assert e.value.code == "VectorDimensionMismatch"
    with pytest.raises(EngineError):
        c.drop_index("absent")
    assert c.delete_one({"_id": b}) and not c.delete_by_id(b) and c.count() == 1
    log = db.audit_log().collect()
    assert [r["op"] for r in log] == ["insert", "insert", "update", "delete"] and db.audit_log(op="insert", since=log[0]["_id"]).count() == 1
    assert db.collections() == ["books"] and c.drop() == 1 and "field:n" in c.indexes()
    for bad in ("", "_x", "a::b", "x" * 200):
        with pytest.raises(EngineError):
            db.collection(bad)


def _scores(df):
    return [(r["_id"], round(r["score"], 9)) for r in df.select("_id", "score").collect()]


def test_the_text_index_follows_every_write(spark, db):
    c = db.collection("t")
    made = c.insert_many([{"_id": ids.new_id(), "n": i, "body": " ".join(["tea"] * (i % 4) + ["ink"] * (i % 3) + ["filler"] * i)} for i in range(20)])
    c.create_text_index("body")

    def same():
        for ask, how in (("tea", {}), ("ink TEA zebra", {"filter": {"n": {"$gt": 5}}}), ("gone", {}), ("filler", {"top_k": 3, "k1": 2.0, "b": 0.1})):
            want = _scores(text_search.search_text(c.find(), "body", ask, **how))
            assert _scores(c.search_text("body", ask, **how)) == want
        return len(_scores(c.search_text("body", "tea ink", 100)))

    assert same() == 18
    c.delete_many({"n": {"$lt": 4}})
    assert same() == 15
    c.update_many({"n": 12}, {"$set": {"body": "Tea, \u0939\u093f\u0928\u094d\u0926\u0940 \u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22"}})
    assert same() == 16 and c.search_text("body", "\u0939\u093f\u0928\u094d\u0926\u0940").count() == 1 == c.search_text("body", "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22").count()
    c.upsert([{"_id": made[5], "n": 5, "body": "nothing"}, {"_id": made[5], "n": 6, "body": "ink"}, {"_id": ids.new_id(), "body": None}])
    assert c.find_by_id(made[5])["n"] == 6 and same() == 16
    c.compact(vacuum=True)
    assert same() == 16 and len(c.manifest()["segments"]) == 1 and len([n for n in db.store.names("t") if n.startswith("seg-")]) == 2
    v = c.find().select("_id", F.array(F.col("n").cast("double"), F.lit(1.0)).alias("v"), "body", "n")
    d = db.collection("both")
    d.insert_many(v)
    d.create_text_index("body"), d.create_vector_index("v", 2)
    want = hybrid.hybrid_search(v, "body", "tea ink", "v", [1.0, 2.0], 5, filter={"n": {"$gt": 4}}).collect()
    assert d.hybrid_search("body", "tea ink", "v", [1.0, 2.0], 5, filter={"n": {"$gt": 4}}).collect() == want and len(want) == 5
    plan = c.search_text("body", "tea")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # no text is tokenized again


def test_postings_are_packed_where_they_are_read_and_merging_shuffles_documents_once(spark, db, monkeypatch):
    monkeypatch.setattr(text_search, "ROW", 7), monkeypatch.setattr(text_search, "CHUNK", 20), monkeypatch.setattr(text_search, "SORTED", 100)
    rows = [(ids.new_id(), " ".join(["tea"] * (i % 4) + ["\u0939\u093f", f"w{i % 9}", f"W{i}", "x"])) for i in range(60)] + [(ids.new_id(), ""), (ids.new_id(), None)]
    df = spark.createDataFrame(rows, "_id string, body string").repartition(3)
    packed = text_search.index_postings(df, "body")
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and packed.agg(F.max(F.size("ids"))).first()[0] <= 7
    words = [r["token"] for r in packed.select("token").distinct().collect()]
    found = text_search.unpacked(packed, *words).cache()
    key = lambda df: sorted(map(tuple, df.select("_id", "token", "tf").collect()))
    assert key(found.filter("token <> ''")) == key(text_search.postings(df, "body"))
    want = sorted(map(tuple, text_search.lengths(df, "body").collect()))
    assert sorted(map(tuple, found.filter("token = ''").select("_id", F.col("len").cast("long")).collect())) == want and len(want) == 61
    c = db.collection("t")
    c.insert_many(df), c.create_text_index("body")
    c.update_many({"_id": {"$in": [r[0] for r in rows[:20]]}}, {"$set": {"body": "tea ink"}})
    c.delete_many({"_id": {"$in": [r[0] for r in rows[15:30]]}}), c.insert_many(df.filter(F.col("_id") == rows[15][0]))
    about = c.indexes()["text:body"]
    assert (about["n"], about["total"]) == tuple(text_search.corpus_stats(c.find(), "body").first())
    merged, now = c._merged(c.manifest()), sorted(map(tuple, c.find().select("_id", "body", "_changed_at").collect()), key=str)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, merged.select("_id", "body", "_changed_at").collect()), key=str) == now
    c.compact()
    assert sorted(map(tuple, c.find().select("_id", "body", "_changed_at").collect()), key=str) == now
    about = c.indexes()["text:body"]
    assert (about["n"], about["total"]) == tuple(text_search.corpus_stats(c.find(), "body").first())


def test_writes_cost_what_they_touch(spark, db):
    c = db.collection("s")
    rows = spark.range(1000).selectExpr("cast(id AS string) AS _id", "id AS n", "array(cast(id AS double)) AS v")
    c.insert_many(rows)
    before = {n for n in db.store.names("s") if n.startswith("seg-")}
    assert c.update_many({"n": {"$lt": 3}}, {"$inc": {"n": 5000}}) == 3
    new, = {n for n in db.store.names("s") if n.startswith("seg-")} - before
    assert c._table(new).count() == 3 and c.count() == 1000 and c.count({"n": {"$gte": 5000}}) == 3
    assert c.update_many({"n": -1}, {"$set": {"n": 0}}) == 0 and c.delete_many({"n": {"$gte": 5000}}) == 3 and c.generation == 3
    feed = c.changes(1).groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in feed} == {"update": 3, "delete": 3} and c.changes(3).count() == 0
    assert all(live.json.loads(r["doc"])["n"] >= 5000 for r in c.changes(1).filter("op = 'update'").collect())
    c.create_vector_index("v", 1), c.create_index("v", "w")
    for bad, code in ({"v": [1.0, 2.0]}, "VectorDimensionMismatch"), ({"v": None, "n": "text"}, "TypeError"), ({"v": [1.0], "w": [1]}, "CompoundIndexMultipleArrays"):
        with pytest.raises(EngineError) as e:
            c.upsert([{"_id": ids.new_id(), **bad}])
        assert e.value.code == code
    c.compact()
    assert c.count() == 997 and c.generation == 3 and c.changes(1).count() == 6
    c.compact(vacuum=True)
    with pytest.raises(EngineError):
        c.changes(1)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_the_stored_approximate_index_follows_every_write(spark, db, metric):
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    x = np.repeat(base, 50, 0) + rng.normal(scale=0.2, size=(2000, 12))
    frame = lambda ids, v: spark.createDataFrame([(int(i), a.tolist()) for i, a in zip(ids, v, strict=True)], "_id long, v array<double>")
    c = db.collection("ann")
    c.insert_many(frame(range(1000), x[:1000]))
    c.create_vector_index("v", 12, metric, approximate=True)
    c.insert_many(frame(range(1000, 2000), x[1000:]))
    c.delete_many({"_id": {"$lt": 100}})
    c.replace_many(frame(range(100, 200), x[1900:]))

    def recall():
        right = 0
        for q in rng.choice(2000, 8, replace=False):
            want = {r["_id"] for r in knn.find_nearest(c.find(), "v", x[q].tolist(), 10, metric).collect()}
            got = c.find_nearest("v", x[q].tolist(), 10).collect()
            assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and all(r["_id"] >= 100 for r in got)
            right += len(want & {r["_id"] for r in got})
        return right / 80

    assert recall() >= 0.9
    c.compact(vacuum=True)
    assert recall() >= 0.9 and c.find_nearest("v", x[0].tolist(), 2500).count() == 1900
    with pytest.raises(EngineError):
        db.collection("ann2").create_vector_index("v", 12, "dot", approximate=True) or knn.CellIndex.fit(c.find(), "v", "dot")


def test_of_two_writers_one_fails(db, monkeypatch):
    a, b = db.collection("two"), db.collection("two")
    a.insert({"n": 1})
    read = a.manifest()
    b.insert({"n": 2})
    monkeypatch.setattr(a, "manifest", lambda: read)
    with pytest.raises(EngineError) as e:
        a.insert({"n": 3})
    monkeypatch.undo()
    assert e.value.code == "Storage" and sorted(r["n"] for r in a.find().collect()) == [1, 2]
    a.insert({"n": 3})
    assert a.count() == 3


def test_many_small_writes_compact_by_themselves(db, monkeypatch):
    from quillon.sources import collection

    monkeypatch.setattr(collection, "SEGMENTS", 3)
    c = db.collection("many")
    for i in range(5):
        c.insert({"n": i})
    assert c.count() == 5 and len(c.manifest()["segments"]) <= 3 and c.generation == c.manifest()["changed"]


def test_changes_reach_the_webhook_and_failures_are_kept(spark, db, tmp_path):
    c = db.collection("hook")
    one = c.insert({"n": 1, "secret": "x"})
    c.update_many({}, {"$set": {"n": 2}})
    c.delete_by_id(one)
    c.insert({"n": 3, "secret": "y"})
    failed = "file://" + str(tmp_path / "failed")
    sink = live.webhook("http://nowhere", failed, ["hook"], exclude=["doc"], post=lambda url, event, headers: "doc" not in event and event["op"] != "update")
    now = live.deliver_changes(db, {}, sink)
    lost = spark.read.parquet(failed).collect()
    assert [(r["op"], r["doc_id"]) for r in lost] == [("update", one)] and now == {"hook": 4} and live.json.loads(lost[0]["doc"])["n"] == 2
    live.deliver_changes(db, now, sink)
    assert spark.read.parquet(failed).count() == 1


def test_snapshot_and_migrations(spark, db, tmp_path):
    db.collection("a").insert({"n": 1})
    db.user_version = 3
    db.export_snapshot("file://" + str(tmp_path / "snap"))
    back = Database.restore_snapshot(spark, "file://" + str(tmp_path / "snap"), "file://" + str(tmp_path / "other"))
    assert back.collection("a").count() == 1 and back.user_version == 3
    with pytest.raises(EngineError):
        Database.restore_snapshot(spark, "file://" + str(tmp_path / "none"), "file://" + str(tmp_path / "x"))
    ran = []
    assert back.migrate([(2, 3, lambda d: ran.append(3)), (3, 4, lambda d: ran.append(4)), (4, 6, lambda d: ran.append(6))]) == 6 and ran == [4, 6]
    for bad in ([(6, 7, ran.append), (8, 9, ran.append)], [(7, 8, ran.append)]):
        with pytest.raises(EngineError):
            back.migrate(bad)


def test_watch_and_subscribe(db):
    c = db.collection("w")
    c.insert({"n": 1})
    w = live.watch(c, {"n": {"$gt": 0}})
    assert w.try_next() is None
    c.insert({"n": 2})
    c.insert({"n": 0})
    assert w.try_next().count() == 2 and w.try_next() is None
    seen = []
    s = live.Subscription(live.watch_aggregate(c, [{"$group": {"_id": None, "n": {"$sum": "$n"}}}]), lambda rows: seen.append(rows[0]["n"]))
    c.insert({"n": 0})
    assert not s.poll() and seen == [3]
    c.insert({"n": 4})
    assert s.poll() and seen == [3, 7]
    w.close()
    with pytest.raises(EngineError):
        w.try_next()


def test_import_and_export(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"_id": "x", "a": 1}, {"a": 2.5, "b": "q,\\"r\\""}]')
    (tmp_path / "lines.ndjson").write_text('{"a": 1}\n{"a": 1}\n')
    rows = io.import_json(spark, str(tmp_path / "array.json"))
    assert rows.count() == 2 and all(ids.is_id(r["_id"]) for r in rows.collect())
    assert len({r["_id"] for r in io.import_json(spark, str(tmp_path / "lines.ndjson")).collect()}) == 2
    lines = [r["line"] for r in io.csv_rows(rows.select("_id", "a", "b")).collect()]
    assert any(x.endswith(',2.5,"q,""r"""') for x in lines) and any(x.endswith(",1.0,") for x in lines)
    io.export_json(rows, str(tmp_path / "out"))
    io.export_json(rows, str(tmp_path / "one"), lines=False)
    io.export_csv(rows, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 == spark.read.csv(str(tmp_path / "csv"), header=True).count()
    assert spark.read.option("multiLine", True).json(str(tmp_path / "one")).count() == 2


def test_field_encryption(spark):
    df = spark.createDataFrame([("a", "secret", [1, 2]), ("b", None, None)], "_id string, s string, xs array<int>")
    key, other = bytes(32), bytes(range(32))
    sealed = crypto.encrypt_fields(df, ["s", "xs"], key).cache()
    assert sealed.collect()[0]["s"].startswith(crypto.PREFIX) and sealed.collect()[1]["s"] is None
    kinds = {"s": "string", "xs": "array<int>"}
    assert docs(crypto.decrypt_fields(sealed, kinds, key)) == docs(df)
    assert docs(crypto.decrypt_fields(crypto.rekey(sealed, kinds, key, other), kinds, other)) == docs(df)
    for wrong in (crypto.decrypt_fields(sealed, kinds, other), crypto.decrypt_fields(sealed.withColumn("s", sealed["s"]).replace("a", "z", subset=["_id"]), kinds, key)):
        with pytest.raises(Exception, match="(?i)decrypt|tag|AES"):
            wrong.collect()
    with pytest.raises(EngineError):
        crypto.derive_key("p", b"salt", 1000)
    assert len(crypto.derive_key("p", b"salt")) == 32


def test_dynamic_documents(spark):
    rows = ['{"v":1}', '{"v":1.0}', '{"v":"1"}', '{"v":null}', '{}', '{"v":true}', '{"v":[1,"x"]}', '{"v":{"w":5}}', '{"v":9007199254740993}']
    df = dynamic.parse_documents(spark.createDataFrame(list(enumerate(rows)), "_id int, j string"), "j")
    ask = lambda f: [r["_id"] for r in dynamic.find(df, f).orderBy("_id").collect()]
    assert ask({"v": 1}) == [0, 6] and ask({"v": "1"}) == [2] and ask({"v": None}) == [3] and ask({"v": {"$exists": False}}) == [4]
    assert ask({"v": {"$gte": 1}}) == [0, 1, 6, 8] and ask({"v": {"$gt": float(2**53)}}) == [8] and ask({"v": True}) == [5]
    assert ask({"v": {"$ne": 1}}) == [1, 2, 3, 4, 5, 7, 8] and ask({"v.w": 5}) == [7] and ask({"v": {"$in": ["x", None]}}) == [3, 6]
    assert ask({"v": {"$regex": "^1$"}}) == [2] and ask({"$not": {"v": {"$exists": True}}}) == [4] and ask({"v": {"$eq": {"w": 5}}}) == [7]
    order = [r["_id"] for r in dynamic.find(df, sort={"v": 1}).collect()]
    assert order[:3] == [4, 3, 5] and order[3:6] == [0, 1, 8] and order[6] == 2
    assert dynamic.group_count(df, "v").filter("_id.rank = 1").first()["n"] == 2


def test_sync_layer(spark):
    bind = sync.define_params({"s": sync.parameter("eq", "status"), "min": sync.parameter("gte", "n")})
    assert bind({"s": None, "x": 1}) is None and bind({"s": "a"}) == {"status": "a"} and bind({"s": "a", "min": 2}) == {"$and": [{"status": "a"}, {"n": {"$gte": 2}}]}
    local = spark.createDataFrame([("a", 1, "pending", 0), ("b", 1, "synced", 0), ("c", 1, None, 0)], "_id string, n int, _sync string, _changed_at long")
    payload = spark.createDataFrame([("b", 5, 0), ("a", 6, 1), ("d", 7, 2), ("b", 8, 3)], "_id string, n int, at int")
    merged, counts = sync.hydrate(local, payload, "at", 9)
    assert counts.first().asDict() == {"inserted": 1, "updated": 1, "skipped": 1}
    assert [(d["_id"], d["n"]) for d in docs(merged)] == [("a", 1), ("b", 8), ("c", 1), ("d", 7)]
    ops = spark.createDataFrame([(1, 1, "insert"), (1, 2, "delete"), (1, 3, "update"), (2, 1, "update"), (2, 2, "delete"), (3, 1, "insert"), (3, 2, "delete")], "_id int, at int, op string")
    assert {r["_id"]: r["op"] for r in sync.coalesced(ops, "at").collect()} == {1: "update", 2: "delete"}
    assert sync.canonical({"_id": 1, "a": 1, "b": 2}, {"a": 3}) == {"$set": {"a": 3}, "$unset": {"b": True}}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts", "case when id % 3 = 0 then 'click' else 'view' end AS event_type", "cast(id AS double) AS value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.stream_of(spark, str(tmp_path / "in"), events.schema, 10)
    got = live.run_available(live.windowed_counts(stream), "counts_out", str(tmp_path / "cp"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.windowed_counts(events).collect()))
    feed = live.run_available(live.changes(stream, {"event_type": "click"}, 50), "feed_out", str(tmp_path / "cp2"))
    assert feed.count() == live.changes(events, {"event_type": "click"}, 50).count()


def test_webhook_retries():
    import io as bytes_io
    import urllib.error

    calls, waits = [], []

    def opener(request, timeout):
        calls.append(request.get_method())
        code = answers.pop(0)
        if code:
            raise urllib.error.HTTPError(request.full_url, code, "", {}, bytes_io.BytesIO())
        return bytes_io.BytesIO()

    answers = [500, 503, 0]
    assert live.send("http://x", {"op": "update"}, opener=opener, sleep=waits.append) and calls == ["PUT"] * 3 and waits == [0.2, 0.4]
    answers = [404]
    assert not live.send("http://x", {"op": "delete"}, opener=opener, sleep=waits.append)
    answers = [500] * 4
    assert not live.send("http://x", {"op": "insert"}, opener=opener, sleep=waits.append)


def test_shape_versions(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", 1), (3, "d", 7)], "_id int, name string, _v int")
    up = shape.migrate(df, [{"first": F.split("name", " ")[0]}, {"name": F.upper("name")}])
    assert [(d["name"], d["first"], d["_v"]) for d in docs(up)] == [("A B", "a", 2), ("C", None, 2), ("d", None, 7)]
    assert [d["name"] for d in docs(shape.downgrade(up, {2: {"name": F.lower("name")}}, 1))] == ["a b", "c", "d"]
    with pytest.raises(EngineError):
        shape.check_writable(df, 2)


def test_query_timeout(spark):
    assert len(find.collect_within(spark.range(3), 60)) == 3
    slow = spark.range(10**12).selectExpr("sum(hash(id) % 7) s")
    with pytest.raises(EngineError) as e:
        find.collect_within(slow, 1.5)
    assert e.value.code == "QueryTimeout"
