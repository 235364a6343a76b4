"""BM25 ranking of documents by a query's tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import B, K1, bm25_term, idf, query_tokens, raw_tokens, tokens
from ..plans.filters import compile_filter
from ..plans.pipeline import INT_MAX


def postings(df: DataFrame, field: str) -> DataFrame:
    """``_id, token, tf``: the inverted index of a text field."""
    return df.select("_id", F.explode(tokens(F.col(field))).alias("token")).groupBy("_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def lengths(df: DataFrame, field: str) -> DataFrame:
    """``_id, length`` of every document whose field is a string, also of none but short tokens."""
    return df.filter(F.col(field).isNotNull()).select("_id", F.size(tokens(F.col(field))).cast("long").alias("length"))


def corpus_stats(df: DataFrame, field: str) -> DataFrame:
    """One row: documents whose field is a string, and their tokens."""
    return lengths(df, field).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_len"))


#: Stands in an index for the document itself: no token is empty.
DOCUMENT = ""
#: Postings that a task sorts at once, that travel together and that one row of an index holds at most; bytes of
#: tokens read at once.
SORTED, CHUNK, ROW, BATCH_BYTES = 1 << 21, 1 << 14, 1024, 16 << 20


def index_postings(df: DataFrame, field: str) -> DataFrame:
    """``token, ids, tf, len``: packed postings of a text field, with each document's number of tokens. A row holds
    those of one token in some documents, in their order; with :data:`DOCUMENT` as token every document is there.

    A document's tokens are counted where it is read, and compressed chunks of sorted postings are all that is shuffled:
    dealt by their first tokens, so that a partition has few tokens."""
    held = df.filter(F.col(field).isNotNull()).select("_id", tokens(F.col(field)).alias("t"))
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > BATCH_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                made.append(_counted(b))
                if sum(m.num_rows for m in made) >= SORTED:
                    yield from _chunks(pa.concat_tables(made))
                    made = []
        if made:
            yield from _chunks(pa.concat_tables(made))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column("chunk"):
                with pa.ipc.open_stream(chunk.as_buffer()) as stream:
                    yield from stream

    dealt = held.mapInArrow(run, "token string, at long, chunk binary").repartitionByRange("token", "at")
    packed = dealt.mapInArrow(read, f"token string, ids array<{df.schema['_id'].dataType.simpleString()}>, tf array<int>, len array<int>")
    return packed.sortWithinPartitions("token", F.col("ids")[0])


def _counted(b: pa.RecordBatch) -> pa.Table:
    """``token, _id, tf, len`` of documents' tokens ``t``."""
    lists = b.column("t")
    length = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    of, flat = np.repeat(np.arange(b.num_rows), length), lists.flatten().dictionary_encode()
    width = max(len(flat.dictionary), 1)
    key, tf = np.unique(of * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    of, tf = np.concatenate((np.arange(b.num_rows), key // width)), np.concatenate((np.zeros(b.num_rows, np.int64), tf))
    words = pa.concat_arrays([pa.array([DOCUMENT], flat.dictionary.type), flat.dictionary])
    token = pa.DictionaryArray.from_arrays(np.concatenate((np.zeros(b.num_rows, np.int64), key % width + 1)).astype(np.int32), words)
    return pa.table([token, b.column("_id").take(pa.array(of)), pa.array(tf.astype(np.int32)), pa.array(length[of].astype(np.int32))], ["token", "_id", "tf", "len"])


def _chunks(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """``token, at, chunk``: about :data:`CHUNK` postings each, in order of their tokens, packed and compressed; ``at`` parts
    chunks of one token."""
    t = t.unify_dictionaries().combine_chunks()
    token = t.column("token").chunk(0)
    words = pc.sort_indices(token.dictionary).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[words] = np.arange(len(words))
    code = rank[token.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    at = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))  # in the token's postings
    start = np.flatnonzero(at % ROW == 0)
    rows = t.select(["_id", "tf", "len"]).take(pa.array(order)).combine_chunks()
    lists = [pa.ListArray.from_arrays(pa.array(np.append(start, len(code)).astype(np.int32)), c.chunk(0)) for c in rows.columns]
    packed = pa.RecordBatch.from_arrays([token.dictionary.take(pa.array(words[code[start]])).cast(pa.string()), *lists], ["token", "ids", "tf", "len"])
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(code), CHUNK)))
    for i, j in zip(cuts, np.append(cuts[1:], packed.num_rows), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(packed.slice(i, j - i))
        salt = zlib.crc32(sink.getvalue())
        yield pa.RecordBatch.from_arrays([packed.column(0).slice(i, 1), pa.array([salt], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["token", "at", "chunk"])


def unpacked(index: DataFrame, *wanted: str) -> DataFrame:
    """``token, _id, tf, len`` of the tokens ``wanted`` in a stored index, also in one that has a row for each."""
    some = index.filter(F.col("token").isin(*wanted))
    if "ids" not in index.columns:
        return some
    return some.select("token", F.inline(F.arrays_zip(F.col("ids").alias("_id"), "tf", "len")))


def _best(df: DataFrame, top_k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.asc("_id")).limit(min(top_k, INT_MAX))


def _none(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(0.0)).filter(F.lit(False))


#: Best documents up to this many are sent to the tasks that read them.
FEW = 10_000


def search_postings(df: DataFrame, found: DataFrame, n: int, total: int, query: str, top_k: int = 10, filter: object = None, k1: float = K1, b: float = B) -> DataFrame:  # noqa: A002
    """:func:`search_text` from stored postings: ``found`` holds those of the query's tokens, ``n`` and
    ``total`` are the corpus' documents and tokens. Only the best documents are read."""
    if top_k <= 0 or not n or not query_tokens(query):
        return _none(df)
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row for each query token
    term = bm25_term(F.col("tf"), F.col("len"), F.lit(total / n), idf(F.lit(n), F.col("df")), k1, b)
    scored = found.join(F.broadcast(counts), "token").groupBy("_id").agg(F.sum(term).alias("score"))
    return _best_of(df, scored, top_k, filter)


def _best_of(df: DataFrame, scored: DataFrame, top_k: int, filter: object) -> DataFrame:  # noqa: A002
    """The documents of the best scores among those that match the filter."""
    narrowed = compile_filter(filter, df.schema)
    if narrowed is not None:
        scored = scored.join(df.filter(narrowed).select("_id"), "_id", "left_semi")
    best = _best(scored, top_k)
    return _best(df.join(F.broadcast(best) if top_k <= FEW else best, "_id").select(*df.columns, "score"), top_k)


def search_text(df: DataFrame, field: str, query: str, top_k: int = 10, filter: object = None, k1: float = K1, b: float = B) -> DataFrame:  # noqa: A002
    """``df``'s best documents with ``score``: any query token counts, scores add up, best first,
    ties by ``_id``. ``filter`` narrows the candidates, not the corpus statistics.

    Without an index every text is read, once: its tokens are counted by ``_id``, and the counts serve
    both the one-row statistics and the scores. Only the best documents are read again.
    """
    asked = query_tokens(query)
    if top_k <= 0 or not asked:
        return _none(df)
    each = df.filter(F.col(field).isNotNull()).select("_id", F.explode(raw_tokens(F.col(field))).alias("t"))
    each = each.select("_id", F.when(F.octet_length("t") >= 2, F.lower("t")).alias("t"))
    tfs = [f"tf{i}" for i in range(len(asked))]
    held = each.groupBy("_id").agg(F.count("t").alias("len"), *(F.count_if(F.col("t") == t).alias(c) for t, c in zip(asked, tfs, strict=True)))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(c) > 0).alias(f"{c}_df") for c in tfs))
    some = held.filter(reduce(lambda x, y: x | y, (F.col(c) > 0 for c in tfs))).crossJoin(F.broadcast(stats))  # one row of statistics
    terms = [bm25_term(F.col(c), F.col("len"), F.col("avg"), idf(F.col("n"), F.col(f"{c}_df")), k1, b) for c in tfs]
    return _best_of(df, some.select("_id", reduce(lambda x, y: x + y, terms).alias("score")), top_k, filter)
