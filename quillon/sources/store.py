"""Small files beside tables, through the Hadoop file system, so any path Spark reads will do."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: what the session names in ``spark.checkpoint.dir``.
    Where that is unset a temporary folder serves in local mode; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise EngineError("Config", "set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _OWN[app]


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark._jvm  # noqa: SLF001
        self._conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001

    def _at(self, name: str):  # noqa: ANN202
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> dict | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise EngineError("Serialization", f"{name} is damaged") from e
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Written beside and renamed over, so readers see the old or the new file."""
        self._put(name, value, self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def create(self, name: str, value: dict) -> None:
        """Like :meth:`write`, but only if there is no such file: of two writers one fails."""
        try:
            self._put(name, value, self._jvm.org.apache.hadoop.fs.Options.Rename.NONE)
        except Exception as e:
            raise EngineError("Storage", f"{name} could not be made; another writer may have been faster") from e

    def _put(self, name: str, value: dict, how: object) -> None:
        fs, path = self._at(name)
        beside = self._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        options[0] = how
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(path), options)
        except Exception:
            fs.delete(beside, False)
            raise

    def names(self, name: str = "") -> list[str]:
        fs, path = self._at(name)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith(".")) if fs.exists(path) else []

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def copy(self, name: str, other: Store, to: str) -> None:
        fs, path = self._at(name)
        fs_to, path_to = other._at(to)  # noqa: SLF001
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, fs_to, path_to, False, self._conf)
