"""Databases and collections over immutable parquet segments.

A commit adds a segment of documents, a list of ids that it makes earlier segments lose, or both,
and a manifest that names all that counts. So a write costs what it touches: an insert writes the new
documents, an update the changed ones, a delete their ids. :meth:`Collection.compact` merges the
segments. Files never change; readers keep the manifest they began with. Manifests are numbered and
made exclusively: of two writers that began alike one fails and may try again. The number is the
write generation that live queries watch, and the commits between two generations are the change feed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import ids
from ..operators import find as reads
from ..operators import hybrid, knn, text_search, updates
from ..plans.filters import matching
from ..plans.pipeline import aggregate
from .store import Store

AUDIT_SCHEMA = "_id string, collection string, op string, doc_id string, ts long, caller string"
FEED_SCHEMA = "generation long, ts long, collection string, op string, doc_id string, doc string"
#: Segments after which a write compacts by itself.
SEGMENTS = 32


def check_name(name: str) -> str:
    if not name or len(name.encode()) > 128 or name.startswith("_") or "::" in name or "/" in name:
        raise EngineError("InvalidName", f"{name!r} cannot name a collection")
    return name


def now_ms() -> int:
    return int(time.time() * 1000)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Database:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.store = spark, Store(spark, base)

    def collection(self, name: str, caller: str | None = None) -> Collection:
        """A collection, made on first write. With ``caller`` its writes are audited."""
        return Collection(self, check_name(name), caller)

    def collections(self) -> list[str]:
        return [n for n in self.store.names() if not n.startswith("_") and self.store.names(f"{n}/manifests")]

    @property
    def user_version(self) -> int:
        return (self.store.read("_database.json") or {}).get("user_version", 0)

    @user_version.setter
    def user_version(self, value: int) -> None:
        self.store.write("_database.json", {**(self.store.read("_database.json") or {}), "user_version": int(value)})

    def export_snapshot(self, path: str) -> None:
        """Every collection as it is now, with its audit log, copied under ``path``."""
        to = Store(self.spark, path)
        if to.exists("_snapshot.json"):
            raise EngineError("InvalidSnapshot", f"{path} holds a snapshot")
        held = {}
        for name in self.collections():
            manifest = self.collection(name).manifest()
            centres = [f"centres.{i['slot']}" for i in manifest["indexes"].values() if i.get("kind") == "cells"]
            for part in [*_files(manifest), *centres, *(n for m in self.collection(name).manifests() for n in [m["audit"]] if n)]:
                self.store.copy(f"{name}/{part}", to, f"{name}/{part}")
            self.store.copy(f"{name}/manifests", to, f"{name}/manifests")
            held[name] = manifest["generation"]
        to.write("_snapshot.json", {"format": 2, "collections": held, "user_version": self.user_version})

    @classmethod
    def restore_snapshot(cls, spark: SparkSession, path: str, base: str) -> Database:
        source = Store(spark, path)
        about = source.read("_snapshot.json")
        if not about or about.get("format") != 2:
            raise EngineError("InvalidSnapshot", f"{path} holds no snapshot")
        out = cls(spark, base)
        for name in about["collections"]:
            source.copy(name, out.store, name)
        out.user_version = about["user_version"]
        return out

    def audit_log(self, collection: str | None = None, op: str | None = None, since: str | None = None) -> DataFrame:
        """Audit entries in order, those after the id ``since``: of every commit that took effect."""
        paths = [f"{self.store.base}/{n}/{m['audit']}" for n in self.collections() if collection in (None, n) for m in self.collection(n).manifests() if m["audit"]]
        log = self.spark.read.schema(AUDIT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], AUDIT_SCHEMA)
        log = log if op is None else log.filter(F.col("op") == op)
        return (log if since is None else log.filter(F.col("_id") > since)).orderBy("_id")

    def changes(self, since: dict[str, int] | None = None) -> DataFrame:
        """The change feed of all collections: each one's after its generation in ``since``."""
        feeds = [self.collection(n).changes((since or {}).get(n, 0)) for n in self.collections()]
        return _union(feeds) if feeds else self.spark.createDataFrame([], FEED_SCHEMA)

    def migrate(self, migrations: Sequence[tuple[int, int, object]]) -> int:
        """Run ``(from, to, function)`` steps from the current version; each is recorded when done."""
        for (_, done, _), (start, _, _) in zip(migrations, migrations[1:], strict=False):
            if done != start:
                raise EngineError("Migration", f"a gap between versions {done} and {start}")
        for start, end, step in migrations:
            if start < self.user_version:
                continue
            if start != self.user_version:
                raise EngineError("Migration", f"at version {self.user_version}, the step starts at {start}")
            step(self)
            self.user_version = end
        return self.user_version


def _stats(documents: DataFrame) -> tuple[int, int]:
    return tuple(documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first())


def _files(manifest: dict) -> list[str]:
    """The tables a manifest names."""
    found = [p["name"] for kind in ("segments", "gone") for p in manifest[kind]]
    return found + [f"{n}.{about['kind']}.{about['slot']}" for about in manifest["indexes"].values() if "slot" in about for n in about["segments"]]


class Collection:
    def __init__(self, db: Database, name: str, caller: str | None = None):
        self.db, self.name, self.caller = db, name, caller
        self._cache: tuple[int, DataFrame] | None = None

    # --- state --------------------------------------------------------------------------------

    def manifests(self, after: int = 0) -> list[dict]:
        """All manifests above a generation, oldest first."""
        names = [n for n in self.db.store.names(f"{self.name}/manifests") if int(n.split(".")[0]) > after]
        return [self.db.store.read(f"{self.name}/manifests/{n}") for n in names]

    def manifest(self) -> dict:
        names = self.db.store.names(f"{self.name}/manifests")
        if not names:
            return {"generation": 0, "changed": 0, "segments": [], "gone": [], "indexes": {}, "audit": None, "change": {}, "ts": 0}
        return self.db.store.read(f"{self.name}/manifests/{names[-1]}")

    @property
    def generation(self) -> int:
        """The number of the last commit that changed documents."""
        return self.manifest()["changed"]

    def _table(self, name: str) -> DataFrame:
        return self.db.spark.read.parquet(f"{self.db.store.base}/{self.name}/{name}")

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.db.store.base}/{self.name}/{name}", compression="zstd")
        return self._table(name)

    def _alive(self, parts: list[tuple[int, DataFrame]], manifest: dict) -> DataFrame:
        """Rows of tables of segments, without those whose ids a later commit took away."""
        gone = [self._table(g["name"]).select(F.col("_id").alias("__id"), F.lit(g["at"]).alias("__gone")) for g in manifest["gone"]]
        first = min((at for at, _ in parts), default=0)
        gone = [g for g, about in zip(gone, manifest["gone"], strict=True) if about["at"] > first]
        if not gone:
            return _union([df for _, df in parts])
        rows = _union([df.withColumn("__at", F.lit(at)) for at, df in parts])
        last = _union(gone).groupBy("__id").agg(F.max("__gone").alias("__gone"))
        return rows.join(last, (F.col("_id") == F.col("__id")) & (F.col("__gone") > F.col("__at")), "left_anti").drop("__at")

    def _read(self, manifest: dict) -> DataFrame | None:
        return self._alive([(s["at"], self._table(s["name"])) for s in manifest["segments"]], manifest) if manifest["segments"] else None

    def _merged(self, manifest: dict) -> DataFrame:
        """:meth:`_read` dealt and sorted by id. Ids that are gone are dealt out with the documents, which so are shuffled once."""
        parts = [self._table(s["name"]).withColumn("__at", F.lit(s["at"])) for s in manifest["segments"]]
        gone = [self._table(g["name"]).select("_id", F.lit(g["at"]).alias("__gone")) for g in manifest["gone"]]
        dealt = _union([*parts, *gone]).repartitionByRange("_id").sortWithinPartitions("_id")
        if not gone:
            return dealt.drop("__at")
        last = dealt.withColumn("__last", F.max("__gone").over(W.partitionBy("_id")))
        return last.filter("__at IS NOT NULL AND (__last IS NULL OR __last <= __at)").drop("__at", "__gone", "__last")

    def frame(self) -> DataFrame | None:
        """The documents as they are now, or None before the first write."""
        manifest = self.manifest()
        if self._cache is None or self._cache[0] != manifest["generation"]:
            self._cache = (manifest["generation"], self._read(manifest))
        return self._cache[1]

    def _frame(self) -> DataFrame:
        df = self.frame()
        return df if df is not None else self.db.spark.createDataFrame([], "_id string, _changed_at long")

    def _publish(self, before: dict, **changed: object) -> None:
        """The next manifest, unless another writer was faster."""
        after = {**before, "audit": None, "change": {}, **changed, "generation": before["generation"] + 1, "ts": now_ms()}
        self.db.store.create(f"{self.name}/manifests/{after['generation']:012d}.json", after)

    def _commit(self, before: dict, op: str, add: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Add documents and take ids away from earlier segments; the documents touched.

        ``gone``: the earlier documents themselves, with all their fields. Nothing happens where
        both are empty; a failure leaves files that no manifest names.
        """
        at, tag, out = before["generation"] + 1, uuid.uuid4().hex[:12], dict(before)
        name = lambda kind: f"{kind}-{at:012d}-{tag}"
        made: list[str] = []
        try:
            n = {}
            if gone is not None:
                made.append(name("gone"))
                n["gone"] = self._save(gone.select("_id"), made[-1]).count()
            if add is not None:
                made.append(name("seg"))
                # sorted by id, so that row-group bounds serve id lookups
                rows = self._save(add.repartitionByRange("_id").sortWithinPartitions("_id"), made[-1])
                n["seg"] = rows.count()
            touched = max(n.values(), default=0)
            if not touched:
                self._delete(made)
                return 0
            out["gone"] = before["gone"] + ([{"name": name("gone"), "at": at}] if n.get("gone") else [])
            out["segments"] = before["segments"] + ([{"name": name("seg"), "at": at}] if n.get("seg") else [])
            indexes = {}
            for key, about in before["indexes"].items():
                about = dict(about)
                if "n" in about and n.get("gone"):
                    lost = self._index_stats(before, about, self._table(name("gone"))) if about.get("packed") else self._text_stats(gone, about["field"])
                    about["n"], about["total"] = about["n"] - lost[0], about["total"] - lost[1]
                if "slot" in about and n.get("seg"):
                    made.append(self._index_segment(rows, about, name("seg")))
                indexes[key] = about
            audit = None
            if self.caller is not None:
                audit = name("audit")
                made.append(audit)
                self._audit(audit, op, at, rows if n.get("seg") else self._table(name("gone")), gone if n.get("gone") and op == "upsert" else None)
            change = {"op": op, "seg": name("seg") if n.get("seg") else None, "gone": name("gone") if n.get("gone") else None}
            self._publish(before, segments=out["segments"], gone=out["gone"], indexes=indexes, audit=audit, change=change, changed=at)
        except Exception:
            self._delete(made)
            raise
        if len(out["segments"]) + len(out["gone"]) > SEGMENTS:
            self.compact()
        return touched

    def _delete(self, names: Sequence[str]) -> None:
        for n in names:
            self.db.store.delete(f"{self.name}/{n}")

    def compact(self, vacuum: bool = False) -> None:
        """Merge all segments into one. ``vacuum`` deletes the files that this leaves unnamed: readers
        of older generations, and the change feed before now, end with it."""
        before = self.manifest()
        df = self._read(before)
        if df is not None and (len(before["segments"]) > 1 or before["gone"]):
            at, tag = before["generation"] + 1, uuid.uuid4().hex[:12]
            name = f"seg-{at:012d}-{tag}"
            rows = self._save(self._merged(before), name)
            indexes = {}
            for key, about in before["indexes"].items():
                if "slot" in about:
                    about = {**about, "segments": [], **({"n": 0, "total": 0, "packed": True} if "n" in about else {})}
                    self._index_segment(rows, about, name)
                indexes[key] = about
            self._publish(before, segments=[{"name": name, "at": at}], gone=[], indexes=indexes)
        if vacuum:
            kept = {"manifests", *_files(self.manifest()), *(m["audit"] for m in self.manifests()), *(f"centres.{i['slot']}" for i in self.indexes().values() if i.get("kind") == "cells")}
            self._delete([n for n in self.db.store.names(self.name) if n not in kept])

    def changes(self, since: int = 0) -> DataFrame:
        """Documents changed by commits after a generation: ``generation, ts, collection, op, doc_id,
        doc`` (JSON as it became; null for deletes). Bounded by the commits, not by the collection;
        commits that a vacuum has taken the files of are an error."""
        feeds = []
        for m in self.manifests(since):
            change = m["change"]
            if not change:
                continue
            if not all(self.db.store.exists(f"{self.name}/{n}") for n in (change["seg"], change["gone"]) if n):
                raise EngineError("NotFound", f"the changes of {self.name} at {m['generation']} are vacuumed")
            about = [F.lit(m["generation"]).cast("long").alias("generation"), F.lit(m["ts"]).cast("long").alias("ts"), F.lit(self.name).alias("collection")]
            gone = self._table(change["gone"]).select("_id") if change["gone"] else None
            if change["seg"]:
                rows = self._table(change["seg"])
                op = F.lit("insert")
                if gone is not None:
                    rows = rows.join(gone.withColumn("__old", F.lit(True)), "_id", "left")
                    op = F.when(F.col("__old"), "update").otherwise("insert")
                feeds.append(rows.select(*about, op.alias("op"), F.col("_id").cast("string").alias("doc_id"), F.to_json(F.struct(*(c for c in rows.columns if c != "__old"))).alias("doc")))
                gone = None if gone is None else gone.join(rows.select("_id"), "_id", "left_anti")
            if gone is not None:
                feeds.append(gone.select(*about, F.lit("delete").alias("op"), F.col("_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("doc")))
        return _union(feeds) if feeds else self.db.spark.createDataFrame([], FEED_SCHEMA)

    def _audit(self, name: str, op: str, at: int, rows: DataFrame, replaced: DataFrame | None) -> None:
        """One entry for each document; ids order by time, commit and document."""
        kind = F.lit("insert" if op == "upsert" else op)
        if replaced is not None:
            rows = rows.join(replaced.select("_id", F.lit(True).alias("__old")), "_id", "left")
            kind = F.when(F.col("__old"), "update").otherwise("insert")
        ts = now_ms()
        entry = F.concat(F.lit(f"{ts:013d}{at:09d}"), F.lower(F.lpad(F.hex(F.xxhash64("_id")), 16, "0")))
        rows.select(entry.alias("_id"), F.lit(self.name).alias("collection"), kind.alias("op"), F.col("_id").cast("string").alias("doc_id"), F.lit(ts).alias("ts"), F.lit(self.caller).alias("caller")).write.parquet(f"{self.db.store.base}/{self.name}/{name}")

    # --- reads --------------------------------------------------------------------------------

    def find(self, filter: object = None, **options: object) -> DataFrame:  # noqa: A002
        return reads.find(self._frame(), filter, **options)

    def find_one(self, filter: object = None) -> dict | None:  # noqa: A002
        rows = reads.find_one(self._frame(), filter).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def find_by_id(self, doc_id: str) -> dict | None:
        rows = reads.by_ids(self._frame(), [doc_id]).collect() if ids.is_id(doc_id) else []
        return rows[0].asDict(recursive=True) if rows else None

    def count(self, filter: object = None) -> int:  # noqa: A002
        return matching(self._frame(), filter).count()

    def aggregate(self, pipeline: object) -> DataFrame:
        return aggregate(self._frame(), pipeline)

    def search_text(self, field: str, query: str, top_k: int = 10, filter: object = None, **tuned: float) -> DataFrame:  # noqa: A002
        """The best documents by BM25, from the stored index: documents without a query token are not read."""
        about, manifest = self._need("text", field, "IndexNotFound"), self.manifest()
        df = self._frame()
        if not about["segments"]:
            return df.withColumn("score", F.lit(0.0)).filter(F.lit(False))
        found = self._stored(manifest, about, lambda df: text_search.unpacked(df, *text_search.query_tokens(query)))
        return text_search.search_postings(df, found, about["n"], about["total"], query, top_k, filter, **tuned)

    def find_nearest(self, field: str, query: Sequence[float], top_k: int = 10, filter: object = None, probes: int = 16) -> DataFrame:  # noqa: A002
        """The nearest documents: exact, or among those of the ``probes`` nearest cells of an
        approximate index. A filter makes it exact, and so do cells with too few vectors."""
        about, manifest = self._need("vector", field, "VectorIndexNotFound"), self.manifest()
        if about.get("segments") and not filter:
            knn.check_dimensions(query, about["dimensions"])
            cells = self._cells(about).probed(query, probes)
            found = self._stored(manifest, about, lambda df: df.filter(F.col("cell").isin(*cells)))
            best = knn.find_nearest(found.select("_id", "v"), "v", query, top_k, about["metric"]).select("_id", "score")
            if top_k <= text_search.FEW and best.count() == top_k:
                return self._frame().join(F.broadcast(best), "_id").select(*self._frame().columns, "score").orderBy(F.desc("score"), F.asc("_id"))
        return knn.find_nearest(self._frame(), field, query, top_k, about["metric"], filter, about["dimensions"])

    def hybrid_search(self, text_field: str, query: str, vector_field: str, vector: Sequence[float], top_k: int = 10, filter: object = None, candidates: int | None = None, k: float = 60.0, text_weight: float = 1.0, vector_weight: float = 1.0, **tuned: float) -> DataFrame:  # noqa: A002
        """Both searches, the text's from its stored index, fused by rank."""
        pool = candidates if candidates is not None else max(4 * top_k, 20)
        near = self.find_nearest(vector_field, vector, pool, filter)
        return hybrid.fuse(self.search_text(text_field, query, pool, filter, **tuned), near, top_k, k, text_weight, vector_weight)

    # --- writes -------------------------------------------------------------------------------

    def insert_many(self, documents: DataFrame | Sequence[dict]) -> list[str]:
        """Insert all documents or none; returns the ids where they came as a list.

        ``_id`` may be given as a valid id; ``_changed_at`` is stamped.
        """
        made: list[str] = []
        if not isinstance(documents, DataFrame):
            documents = [dict(d) for d in documents]
            if not documents:
                return []
            for d in documents:
                d["_id"] = ids.checked_id(d["_id"]) if d.get("_id") is not None else ids.new_id()
                made.append(d["_id"])
            documents = frame_of(self.db.spark, documents, self.frame())
        elif "_id" not in documents.columns:
            raise EngineError("InvalidDocumentId", "a frame of documents needs _id")
        documents = documents.withColumn("_changed_at", F.lit(now_ms()).cast("long"))
        before = self.manifest()
        held = self._read(before)
        self._check(before, held, documents)
        updates.insert_many(held if held is not None else documents.limit(0), documents)  # refuses ids that exist
        self._commit(before, "insert", documents)
        return made

    def insert(self, document: dict) -> str:
        return self.insert_many([document])[0]

    def upsert(self, documents: Sequence[dict]) -> None:
        """Replace whole documents by id, and insert those that are new; of an id given twice the last counts."""
        last = {ids.checked_id(d["_id"]): {**d, "_id": ids.checked_id(d["_id"])} for d in documents}
        if not last:
            return
        self.replace_many(frame_of(self.db.spark, list(last.values()), self.frame()))

    def replace_many(self, documents: DataFrame) -> None:
        """:meth:`upsert` of a frame, whose ids are distinct."""
        rows = documents.withColumn("_changed_at", F.lit(now_ms()).cast("long"))
        before = self.manifest()
        held = self._read(before)
        self._check(before, held, rows)
        twice = rows.groupBy("_id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise EngineError("DuplicateId", f"{twice[0][0]} is given twice")
        self._commit(before, "upsert", rows, None if held is None else held.join(rows.select("_id"), "_id", "left_semi"))

    def update_many(self, filter: object, spec: dict) -> int:  # noqa: A002
        return self._change(filter, spec)

    def update_one(self, filter: object, spec: dict) -> bool:  # noqa: A002
        return bool(self._change(filter, spec, one=True))

    def _change(self, filter: object, spec: dict, one: bool = False) -> int:  # noqa: A002
        updates.parse_update(spec)
        before = self.manifest()
        held = self._read(before)
        if held is None:
            return 0
        hit = matching(held, filter)
        hit = reads.find_one(hit) if one else hit
        changed = updates.update_many(hit, {}, spec, now_ms())
        self._check(before, held, changed)
        return self._commit(before, "update", changed, hit)

    def delete_many(self, filter: object = None) -> int:  # noqa: A002
        before = self.manifest()
        held = self._read(before)
        return 0 if held is None else self._commit(before, "delete", None, matching(held, filter))

    def delete_one(self, filter: object = None) -> bool:  # noqa: A002
        before = self.manifest()
        held = self._read(before)
        return held is not None and bool(self._commit(before, "delete", None, reads.find_one(held, filter)))

    def delete_by_id(self, doc_id: str) -> bool:
        return self.delete_one({"_id": doc_id}) if ids.is_id(doc_id) else False

    def drop(self) -> int:
        """Delete all documents; indexes stay."""
        return self.delete_many()

    # --- indexes ------------------------------------------------------------------------------

    def _need(self, kind: str, field: str, code: str) -> dict:
        found = self.manifest()["indexes"].get(f"{kind}:{field}")
        if found is None:
            raise EngineError(code, f"{self.name}.{field} has no {kind} index")
        return found

    def _index(self, key: str, about: dict | None) -> None:
        manifest = self.manifest()
        indexes = dict(manifest["indexes"])
        if about is None:
            if key not in indexes:
                raise EngineError("IndexNotFound", key)
            del indexes[key]
        elif key in indexes:
            return
        else:
            indexes[key] = about
        self._publish(manifest, indexes=indexes)

    def create_index(self, *fields: str) -> None:
        """Declare a field or compound index. It never changes a result; parquet statistics serve
        the scan. Making one that exists is no error."""
        if len(fields) > 1:
            if len(set(fields)) != len(fields) or any(not f or "::" in f for f in fields):
                raise EngineError("InvalidOperation", "a compound index names two or more different fields")
            self._check_arrays(list(fields), self._frame())
        self._index("field:" + ",".join(fields), {"fields": list(fields)})

    def drop_index(self, *fields: str) -> None:
        self._index("field:" + ",".join(fields), None)

    def _index_stats(self, manifest: dict, about: dict, some: DataFrame | None = None) -> tuple[int, int]:
        """Documents and tokens that a text index has of the documents held, or of those with ids in ``some``."""
        if not about["segments"]:
            return 0, 0
        held = self._stored(manifest, about, lambda df: text_search.unpacked(df, text_search.DOCUMENT))
        return _stats(held if some is None else held.join(some, "_id", "left_semi"))

    def _text_stats(self, df: DataFrame, field: str) -> tuple[int, int]:
        return tuple(text_search.corpus_stats(df, field).first()) if field in df.columns else (0, 0)

    def _index_segment(self, rows: DataFrame, about: dict, segment: str) -> str:
        """What a stored index holds of a segment: postings sorted by token, or vectors sorted by
        cell, so that a search reads few row groups."""
        name = f"{segment}.{about['kind']}.{about['slot']}"
        if about["field"] in rows.columns:
            if about["kind"] == "text":
                held = text_search.index_postings(rows, about["field"])
            else:
                held = self._cells(about).cells(rows, about["field"]).repartitionByRange("cell", "_id").sortWithinPartitions("cell", "_id")
            self._save(held, name)
            about["segments"] = [*about["segments"], segment]
            if about["kind"] == "text":
                found = _stats(text_search.unpacked(self._table(name), text_search.DOCUMENT))
                about["n"], about["total"] = about["n"] + found[0], about["total"] + found[1]
        return name

    def _stored(self, manifest: dict, about: dict, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of a stored index that ``rows`` selects, without documents that are gone."""
        at = {s["name"]: s["at"] for s in manifest["segments"]}
        return self._alive([(at[n], rows(self._table(f"{n}.{about['kind']}.{about['slot']}"))) for n in about["segments"]], manifest)

    def _cells(self, about: dict) -> knn.CellIndex:
        held = self._table(f"centres.{about['slot']}").orderBy("cell").collect()  # at most 4,096 rows
        return knn.CellIndex(np.array([r["centre"] for r in held], np.float64), about["metric"])

    def create_text_index(self, field: str) -> None:
        """Postings of every segment, kept up to date by every write."""
        manifest = self.manifest()
        if f"text:{field}" in manifest["indexes"]:
            return
        about = {"kind": "text", "field": field, "slot": uuid.uuid4().hex[:8], "segments": [], "n": 0, "total": 0, "packed": True}
        for s in manifest["segments"]:
            self._index_segment(self._table(s["name"]), about, s["name"])
        about["n"], about["total"] = self._index_stats(manifest, about)  # without documents that are gone
        self._index(f"text:{field}", about)

    def drop_text_index(self, field: str) -> None:
        self._index(f"text:{field}", None)

    def create_vector_index(self, field: str, dimensions: int, metric: str = "cosine", approximate: bool = False) -> None:
        """An index of exact search, or with ``approximate`` one whose cells are stored with every
        segment. Its centres are those of the vectors at the time; to renew them, drop and create it."""
        if metric not in knn.METRICS or dimensions < 1:
            raise EngineError("InvalidOperation", "a vector index has dimensions and a known metric")
        manifest, about = self.manifest(), {"field": field, "dimensions": dimensions, "metric": metric}
        if f"vector:{field}" in manifest["indexes"]:
            return
        if approximate:
            now = self._read(manifest)
            now = now.filter(F.size(field) == dimensions) if now is not None and field in now.columns else None
            about |= {"kind": "cells", "slot": uuid.uuid4().hex[:8], "segments": []}
            index = knn.CellIndex.fit(now, field, metric) if now is not None else knn.CellIndex(np.zeros((1, dimensions)), metric)
            rows = [(i, c.tolist()) for i, c in enumerate(index.centres)]
            self._save(self.db.spark.createDataFrame(rows, "cell int, centre array<double>"), f"centres.{about['slot']}")
            for s in manifest["segments"]:
                self._index_segment(self._table(s["name"]), about, s["name"])
        self._index(f"vector:{field}", about)

    def drop_vector_index(self, field: str) -> None:
        if f"vector:{field}" not in self.manifest()["indexes"]:
            raise EngineError("VectorIndexNotFound", field)
        self._index(f"vector:{field}", None)

    def indexes(self) -> dict:
        return self.manifest()["indexes"]

    def _check(self, manifest: dict, held: DataFrame | None, df: DataFrame) -> None:
        """What every written document must satisfy under the collection's indexes and fields: vectors
        are null or have their index's dimensions, a compound index has one array field at most, and
        kinds agree with those of the fields held."""
        for about in manifest["indexes"].values():
            if "dimensions" in about and about["field"] in df.columns:
                if df.filter(F.size(about["field"]) != about["dimensions"]).filter(F.col(about["field"]).isNotNull()).limit(1).count():
                    raise EngineError("VectorDimensionMismatch", f"{about['field']} has {about['dimensions']} dimensions")
            if len(about.get("fields", ())) > 1:
                self._check_arrays(about["fields"], df)
        for f in df.schema if held is not None else []:
            if f.name in held.columns and f.dataType != held.schema[f.name].dataType:
                kinds = {f.dataType, held.schema[f.name].dataType}
                if not all(isinstance(k, T.NumericType) for k in kinds) and not any(isinstance(k, (T.ArrayType, T.StructType)) for k in kinds):
                    raise EngineError("TypeError", f"{f.name} mixes kinds; use the dynamic mode")

    def _check_arrays(self, fields: list[str], df: DataFrame) -> None:
        arrays = [f for f in fields if f in df.columns and isinstance(df.schema[f].dataType, T.ArrayType)]
        if len(arrays) > 1:
            raise EngineError("CompoundIndexMultipleArrays", ", ".join(arrays))


def frame_of(spark: SparkSession, documents: Sequence[dict], held: DataFrame | None = None) -> DataFrame:
    """Documents as a frame: the union of their fields; whole and fractional numbers in one field
    make it fractional; fields of mixed kinds are refused. A field without any value has the kind
    that it has in ``held``."""
    names = list(dict.fromkeys(k for d in documents for k in d))
    kinds = {n: _kind_of([d.get(n) for d in documents], n) for n in names}
    for n in names:
        if held is not None and n in held.columns and all(d.get(n) is None for d in documents):
            kinds[n] = held.schema[n].dataType
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return spark.createDataFrame([tuple(_fit(d.get(n), kinds[n]) for n in names) for d in documents], schema)


def _kind_of(values: list, name: str) -> T.DataType:
    values = [v for v in values if v is not None]
    if not values:
        return T.StringType()
    if all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return T.LongType() if all(isinstance(v, int) for v in values) else T.DoubleType()
    if all(isinstance(v, str) for v in values):
        return T.StringType()
    if all(isinstance(v, (bytes, bytearray)) for v in values):
        return T.BinaryType()
    if all(isinstance(v, (list, tuple)) for v in values):
        return T.ArrayType(_kind_of([x for v in values for x in v], name))
    if all(isinstance(v, dict) for v in values):
        keys = list(dict.fromkeys(k for v in values for k in v))
        return T.StructType([T.StructField(k, _kind_of([v.get(k) for v in values], f"{name}.{k}")) for k in keys])
    raise EngineError("TypeError", f"{name} mixes kinds; use the dynamic mode")


def _fit(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind)
    return value
