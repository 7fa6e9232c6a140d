"""Archives of the files of a conversation: stored entries, offsets as running sums, all in Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import slugify

# Signatures of an archive's records, as they stand in the file, and the version that readers need.
LOCAL, CENTRAL, END = "504B0304", "504B0102", "504B0506"
VERSION, LOCAL_BYTES = 20, 30


def little_endian(number: Column, size: int) -> Column:
    """A number as ``size`` bytes, least first, in hexadecimal."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def _fixed(*numbers: tuple[int, int]) -> Column:
    return F.lit("".join(n.to_bytes(size, "little").hex().upper() for n, size in numbers))


def archives(files: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, filename, archive`` from ``conv_id, seq, name, data``; entries are stored in the order of ``seq``.

    The archive is named after the ``title`` of its conversation. Entries have no time. An archive has to fit into a row: files of
    less than 4 GB and 65,535 entries; more raise an error.
    """
    data, name = F.coalesce(F.col("data"), F.lit(b"")), F.encode("name", "UTF-8")
    size = F.octet_length(data)
    rows = files.select("conv_id", "seq", F.hex(name).alias("n"), F.octet_length(name).alias("n_size"), F.hex(data).alias("d"), size.alias("size"), F.crc32(data).alias("crc"))
    before = Window.partitionBy("conv_id").orderBy("seq")
    length = F.lit(LOCAL_BYTES) + F.col("n_size") + F.col("size")
    rows = rows.withColumn("offset", F.sum(length.cast("long")).over(before) - length)
    about = F.concat(little_endian(F.col("crc"), 4), little_endian(F.col("size"), 4), little_endian(F.col("size"), 4), little_endian(F.col("n_size"), 2))
    none = lambda *sizes: _fixed(*((0, s) for s in sizes))
    local = F.concat(F.lit(LOCAL), _fixed((VERSION, 2)), none(2, 2, 2, 2), about, none(2), F.col("n"), F.col("d"))
    central = F.concat(F.lit(CENTRAL), _fixed((VERSION, 2), (VERSION, 2)), none(2, 2, 2, 2), about, none(2, 2, 2, 2, 4), little_endian(F.col("offset"), 4), F.col("n"))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", local.alias("l"), central.alias("c")))).alias("x"), F.count("*").alias("k"), F.sum(length.cast("long")).alias("at"), F.sum(F.col("n_size") + 46).alias("central"),
    )
    joined = lambda field: F.array_join(F.transform("x", lambda e: e[field]), "")
    end = F.concat(F.lit(END), none(2, 2), little_endian(F.col("k"), 2), little_endian(F.col("k"), 2), little_endian(F.col("central"), 4), little_endian(F.col("at"), 4), none(2))
    fits = F.when((F.col("k") < 1 << 16) & (F.col("at") + F.col("central") < 1 << 31), F.unhex(F.concat(joined("l"), joined("c"), end)))
    archive = F.coalesce(fits, F.raise_error(F.lit("an archive has to have fewer than 65,536 entries and 2 GB")).cast("binary"))
    named = F.lit("conversation") if conversations is None else slugify(F.col("title"))
    if conversations is not None:
        whole = whole.join(conversations.select("conv_id", "title"), "conv_id", "left")
    return whole.select("conv_id", F.concat(named, F.lit("-evidence.zip")).alias("filename"), archive.alias("archive"))
