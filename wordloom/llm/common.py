"""Shared helpers: input tables, samples, names of columns, and mapping over whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.storage import materialise, scratch_path

__all__ = ["col", "flagged", "free", "give_back", "worker_memory", "map_cells", "map_texts", "materialise", "numbered", "pieces", "sampled", "scratch_path", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores after it as long as one of ``names`` is the same but for case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c0, c1, ..., the new name of a column, and the way back to the old names.

    Operators that return the columns they were given work on these, so no name can clash with theirs, whatever it is.
    """
    names = df.columns
    new = [f"c{i}" for i in range(len(names))]
    return df.toDF(*new), lambda name: new[names.index(name)], lambda out: out.select(*new).toDF(*names)


def sampled(df: DataFrame, key: str, bound: int, total: int | None = None, salt: int = 0) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``key``; all of them when there are no more than that."""
    total = df.count() if total is None else total
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(col(key).cast("string"), F.lit(salt)), F.lit(1 << 30)) < cut)


#: Bytes of a batch in which rows go to Python and come back, and Spark's own setting, which this replaces.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "64MB"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches for Python are of BATCH_BYTES, unless it has a setting of its own: each task
    holds some of them outside the heap, on either side."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_HELD: dict[str, object] = {}


def worker_memory(key: str, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps between its tasks: made once, and of one key at a time, so that a worker that goes on
    to another operator lets go of what the last one kept, and gives free memory back."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def give_back() -> None:
    """Give memory that a worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back by themselves
        ctypes.CDLL(None).malloc_trim(0)


def flagged(text: Column, make: Callable[[], Callable[[list[str]], list[bool]]], holds: str = "") -> Column:
    """A truth value for each whole text, null texts as "". Only texts go to Python; the other columns of a row do not.
    ``holds``: as in ``map_texts``."""

    @F.arrow_udf("boolean")
    def flag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory(holds)
        work = None
        for batch in batches:
            work = work or make()
            yield pa.array(work(batch.to_pylist()), pa.bool_())

    return flag(F.coalesce(text, F.lit("")))


def pieces(batch: pa.RecordBatch, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` at most, one row at least."""
    if batch.nbytes <= most_bytes or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        if part.num_rows > 1 and part.nbytes > most_bytes:
            yield from pieces(part, most_bytes)
        else:
            yield part


def map_cells(
    df: DataFrame,
    cell: Column,
    make: Callable[[], Callable[[list], list[Iterable]]],
    fields: list[T.StructField],
    kept: list[str],
) -> DataFrame:
    """The columns ``kept`` of ``df``, and ``fields`` computed from a cell in Arrow batches.

    ``make()`` runs once in a task and gives a function from cells to one list per field. Empty input gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name for f in fields}
    kept = [c for c in kept if c not in new]
    source = small_batches(df).select(*map(col, kept), cell.alias(free(kept, "__cell")))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            for batch in pieces(whole):
                work = work or make()
                made = work(batch.column(batch.num_columns - 1).to_pylist())
                arrays = [pa.array(values, type=kind) for values, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    return source.mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[str]], list[Iterable]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    holds: str = "",
) -> DataFrame:
    """``map_cells`` over whole texts, null texts as "". Columns of ``df`` named like a new field are replaced by it.

    ``holds`` is the key of what a worker keeps for this work (see ``worker_memory``); what it keeps for other work goes.
    """

    def begin():
        worker_memory(holds)
        return make()

    return map_cells(df, F.coalesce(col(text_col), F.lit("")), begin, fields, df.columns if keep is None else keep)
