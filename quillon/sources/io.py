"""JSON, NDJSON and CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.ids import derived_id_column


def import_json(spark: SparkSession, path: str, collection: str = "import", schema: T.StructType | str | None = None) -> DataFrame:
    """Documents of a JSON array or of JSON lines, told apart by the first character. Any ``_id`` is
    dropped and a new one made, from the document's content and place."""
    first = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
    many = bool(first) and first[0][0].lstrip().startswith("[")
    reader = spark.read.option("multiLine", many).option("mode", "FAILFAST")
    try:
        df = (reader.schema(schema) if schema is not None else reader).json(path).drop("_id")
    except Exception as e:
        raise EngineError("Serialization", f"{path} is not JSON") from e
    key = F.concat_ws(":", F.to_json(F.struct(*df.columns)) if df.columns else F.lit(""), F.monotonically_increasing_id())
    return df.withColumn("_id", derived_id_column(collection, key))


def export_json(df: DataFrame, path: str, lines: bool = True) -> None:
    """JSON lines, written in parallel; or one array, for results that fit one file."""
    if lines:
        df.write.mode("overwrite").json(path)
    else:
        body = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*df.columns))), ",\n "), F.lit("]"))
        df.agg(body.alias("value")).write.mode("overwrite").text(path)


def csv_field(value: Column, kind: T.DataType) -> Column:
    """A value as CSV text: null is empty, nested values are JSON, what needs quotes is quoted."""
    text = F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.concat(F.lit("<bytes:"), F.octet_length(value), F.lit(">")) if isinstance(kind, T.BinaryType) else value.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(df: DataFrame) -> DataFrame:
    """``_id, line``: each document as a CSV line."""
    return df.select("_id", F.concat_ws(",", *(csv_field(F.col(f"`{f.name}`"), f.dataType) for f in df.schema)).alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with the fields of the first document in ``_id`` order as header in every file."""
    first = df.orderBy("_id").limit(1).collect()
    names = [n for n in df.columns if first and first[0][n] is not None] or df.columns
    flat = df.select(*(F.to_json(F.col(f"`{n}`")).alias(n) if isinstance(df.schema[n].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{n}`").cast("string").alias(n) for n in names))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
