"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
U64 = np.uint64
#: Strata of a sample whose limits are broadcast; more are joined by a shuffle.
MOST_STRATA = 1000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the checkpoint folder set on the context.

    Without either, a local session (as in tests) gets a temporary folder, and a cluster an error: what its executors
    wrote to folders of their own would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="parlance-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables stored by the operators of the pipeline stage that this thread builds, and of the last stages of each pipeline.
_building = threading.local()
_built: dict[str, list[str]] = {}


def hold(path: str) -> None:
    """Note that a path of the shared folder goes when the pipeline stage that is being built is over."""
    if getattr(_building, "paths", None) is not None:
        _building.paths.append(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; this cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    hold(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what was made from them has to be stored by then."""
    for table in tables:
        delete(table.sparkSession, table.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _run_of(pipeline: str) -> str:
    """Runs in different threads have tables of their own, even over one input."""
    return f"{threading.get_ident()} {pipeline}"


def release(spark: SparkSession, pipeline: str) -> None:
    """Delete what operators stored for the last stage of a pipeline of this thread; its result has to be written by then."""
    for path in _built.pop(_run_of(pipeline), []):
        delete(spark, path)


@contextmanager
def stage_tables(spark: SparkSession, pipeline: str) -> Iterator[None]:
    """What operators store inside is deleted when the pipeline's next stage enters, as its input has been written by then.

    ``pipeline`` names the pipeline by its input; pipelines over different inputs, or of different threads, don't touch each
    other's tables. Around a single operator, whose result is written inside, it leaves nothing behind after ``release``.
    """
    release(spark, pipeline)
    _building.paths = []
    try:
        yield
    finally:
        _built.setdefault(_run_of(pipeline), []).extend(_building.paths)
        _building.paths = None


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, row_key``: equal rows share a key, which is never null even if the id is.

    Columns of ``carry`` come along as ``_0, _1, ...``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def with_decisions(rows: DataFrame, decisions: DataFrame, how: str = "left") -> DataFrame:
    """Join per-row decisions (``row_key, doc_id, ...``) to keyed rows."""
    right = decisions.withColumnRenamed("row_key", "_k").withColumnRenamed("doc_id", "_i")
    joined = rows.join(right, (rows["row_key"] == right["_k"]) & rows["doc_id"].eqNullSafe(right["_i"]), how)
    return joined.drop("_k", "_i")


#: Bits of a filter of keys that is sent to all executors: 8 for each key, within these bounds (64 MB at most).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 29


def split_by(rows: DataFrame, keys: DataFrame, key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may stand in ``keys``, and those for which it surely doesn't.

    A filter of one hash bit for each key is built as bitmaps in tasks. It is bounded by ``MOST_BITS``, so it can be sent
    to all executors whatever the number of keys; a row that it lets pass in vain costs bytes in the join that follows,
    never a result. So wide rows need an exchange only where they have something to be joined with.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key), F.lit("filter")), F.lit(bits))
    maps = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_at"))
    maps = maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    joined = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)}).join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)), F.lit(2)) == 1, F.lit(False))
    return joined.where(held).select(*rows.columns), joined.where(~held).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` isn't in ``keys``; only rows that may be in it are exchanged. Null keys stay."""
    maybe, surely_not = split_by(rows, keys, key)
    return surely_not.unionByName(maybe.join(keys.select(key), key, "left_anti"))


#: Rows of a stratum that a sample may hold, so that each task hands on no more than that of a stratum.
MOST_SAMPLED = 1000


def bounded_sample(df: DataFrame, bound: int, key: Column, strata: str | None = None) -> DataFrame:
    """``bound`` rows (of each stratum, if one is named; at most ``MOST_SAMPLED`` then), or all if there are fewer.

    The rows of the least 63-bit hashes of ``key`` are taken, so the draw is spread over the whole table, is the same on
    every run, and never empty for a stratum that has rows. Rows with equal keys are interchangeable: as many of them are
    taken as there is room for. The key should therefore tell apart all rows that differ in what is learnt from them.
    """
    if strata is not None and bound > MOST_SAMPLED:
        raise ValueError(f"{MOST_SAMPLED} rows of a stratum at most")
    # Hashes by their number of leading zeros: with one zero more there are half as many, whatever the table's size.
    place = F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit((1 << 63) - 1))
    zeros = F.when(F.col("_place") == 0, 63).otherwise(62 - F.floor(F.log2(F.col("_place").cast("double")))).cast("int")
    rows = df.withColumn("_place", place)
    stratum = F.lit(0) if strata is None else F.col(strata)
    levels = rows.groupBy(stratum.alias("_stratum"), zeros.alias("_zeros")).count()
    from_top = Window.partitionBy("_stratum").orderBy(F.desc("_zeros"))  # 64 rows of a stratum
    enough = levels.withColumn("_sum", F.sum("count").over(from_top)).where(F.col("_sum") >= bound)
    limits = levels.groupBy("_stratum").agg(F.min("_zeros").alias("_least")).join(enough.groupBy("_stratum").agg(F.max("_zeros").alias("_most")), "_stratum", "left")
    if strata is None:
        limit = limits.agg(F.max(F.coalesce("_most", "_least"))).first()[0]
        near = rows.where(zeros >= (limit or 0))  # about the bound to twice as many, but for rows with equal keys
        return near.orderBy("_place").limit(bound).drop("_place")
    limits = limits.select(F.col("_stratum"), F.coalesce("_most", "_least").alias("_limit"))
    few = limits.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    near = rows.join(F.broadcast(limits) if few else limits, F.col(strata).eqNullSafe(F.col("_stratum"))).where(zeros >= F.col("_limit"))
    first = F.row_number().over(Window.partitionBy("_stratum").orderBy("_place"))
    return near.withColumn("_first", first).where(F.col("_first") <= bound).drop("_stratum", "_limit", "_place", "_first")


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a batch holding about ``limit`` bytes of UTF-8 each (one text at least): first, last, bytes."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8") if isinstance(text, str) else b""
        if out and size + len(raw) > limit:
            yield first, i, out
            first, size, out = i, 0, []
        out.append(raw)
        size += len(raw)
    if out:
        yield first, len(texts), out


def texts_of(batch: pd.DataFrame, column: str = "text") -> list[str | None]:
    return [x if isinstance(x, str) else None for x in batch[column]]


_MULT = U64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a byte or hash array, one longer than the array."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * up[:-1] if codes.dtype == U64 else (codes.astype(U64) + U64(1)) * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [starts, ends), equal for equal contents wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * _MULT)


def words_of(raws: list[bytes], word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one go.

    ``word_class`` maps a byte to 0 (no part of a word, as the space) or to a number above. Returns the hashes and the
    number of words before each text (one entry more than texts).
    """
    joined = word_class[np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)]
    ends_of_text = np.cumsum(np.fromiter((len(r) + 1 for r in raws), dtype=np.int64, count=len(raws)))
    inside = joined != 0
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = span_hashes(prefix_hashes(joined), starts, ends)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends_of_text)])


#: How a worker forgets what it keeps from task to task, by the module that keeps it.
_forget: dict[str, Callable] = {}


def kept_by_workers(function: Callable) -> Callable:
    """A function whose last result a worker keeps for the tasks to come, until one of another module begins."""
    cached = functools.lru_cache(maxsize=1)(function)
    _forget[function.__module__] = cached
    return cached


def turn_to(module: str) -> None:
    """A task of ``module`` begins: what this worker kept for tasks of other modules goes."""
    others = [cached for name, cached in _forget.items() if name != module and cached.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def giving_back(function: Callable) -> Callable:
    """A function of batches whose task returns the memory it took: workers live on and run the tasks of later stages."""

    def run(batches: Iterator) -> Iterator:
        turn_to(function.__module__)
        yield from function(batches)
        give_back()

    return run


def map_docs(rows: DataFrame, function: Callable, columns: str) -> DataFrame:
    """``mapInPandas`` that carries ``doc_id`` as text, so that null ids don't turn into floating-point numbers.

    ``columns`` is the schema of what ``function`` returns beside ``doc_id``.
    """
    id_type = rows.schema["doc_id"].dataType
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(giving_back(function), f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
