"""Arrow batches of texts, worked through in slices, so that what a Python worker holds depends on neither a batch nor the input."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker, so that long texts stay bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows and bytes of texts that a worker looks at together; one longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts may be very long: upper bounds, which leave smaller settings of the session alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, most)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order, in slices bounded by the bytes of their texts."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
            yield b.slice(at, upto - at)
            at = upto


#: Batches after which a worker gives freed memory back.
GIVE_BACK = 4
_kept: dict[str, dict] = {}


def kept(step: str) -> dict:
    """What this worker keeps of a step from one task to the next."""
    return _kept.setdefault(step, {})


def forget(but: str | None = None) -> None:
    """Drop what this worker keeps of all steps but one."""
    for step in _kept:
        if step != but:
            _kept[step].clear()


def give_back() -> None:
    """Hand freed memory back to the system, which a worker's allocators hold on to otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def _giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, b in enumerate(batches, 1):
        yield b
        if i % GIVE_BACK == 0:
            give_back()


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], step: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, so that a worker, which Spark uses again for other steps, takes nothing of theirs into it and leaves no more than what is kept of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(step)
        yield from f(_giving_back(batches))
        give_back()

    return run


def arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def mapped(df: DataFrame, text: str, keep: list[str], out: dict[str, str], make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """Columns to keep with those of out (name to type) that make() gives for the texts of a slice."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *make(b.column(text).to_pylist())], names=[*keep, *out])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`{c}` {kind}" for c, kind in out.items()]]))
