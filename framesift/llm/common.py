"""Shared helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import cut_lineage  # noqa: F401  the text operators take it from here

#: Rows and bytes of what a worker turns into Python objects at once.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many rows and, beyond one row, bytes; nothing is copied, no setting of the session needed."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches; the worker waits for its next task without what this one held."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


#: Bitmaps of 4 KB, each for 32,768 ids, that are broadcast at most.
BITMAPS = 4096


def with_ids(df: DataFrame, id_col: str, ids: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose id (a long) is among ``ids`` (a column id), or, not ``among``, the others, null ids too: by bitmaps that go to the rows where they are small, so the rows are not shuffled; by a join where ids lie too far apart for that."""
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("__k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__map"))
    maps = cut_lineage(maps)
    own = F.col(f"`{id_col}`").cast("long")
    if maps.count() > BITMAPS:
        return df.join(ids.distinct().withColumnRenamed("id", "__id"), own == F.col("__id"), "left_semi" if among else "left_anti")
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("__map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2
    joined = df.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("__k"), "inner" if among else "left")
    return joined.where(F.coalesce(bit, F.lit(0)) == int(among)).drop("__k", "__map")


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[str]], dict[str, Sequence]]],
    out: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """Columns ``keep`` (all but the replaced ones, if None) plus ``out``, computed from whole texts.

    ``make`` is called once a task and gives the function from a batch of
    texts (null: empty), of about ``size`` bytes, to the new columns. A kept column whose name is also
    the name of a new one is replaced by it.
    """
    new = {f.name for f in out}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *out])
    types = [to_arrow_type(f.dataType) for f in out]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))

    def run(batches):
        fn = make()
        for batch in cut_batches(batches, size=size):
            cols = fn(batch.column(len(keep)).to_pylist())
            made = [pa.array(cols[f.name], type=t) for f, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *(f.name for f in out)])

    return source.mapInArrow(lean(run), schema)


#: Bytes table: A-Z to a-z, ASCII letters and digits kept, other ASCII to space, bytes of other characters kept.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()
