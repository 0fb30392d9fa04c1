"""Arrow pass over whole rows: other columns go through untouched, computed columns are appended."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

PIECE_ROWS = 512


def release() -> None:
    """Give freed memory back to the system at a task's end: workers are used again and share a limit with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], fields: list[tuple[str, pa.DataType, str]], column: str = "text", drop: bool = True) -> DataFrame:
    """Append ``fields`` (name, Arrow type, Spark type) computed from one column.

    ``make()`` runs once in each task and gives a function from a list of that
    column's values (null as None) to one list of values for each field. All rows
    and values pass; ``drop`` leaves the column itself out.
    """
    kept = [c for c in df.columns if not (drop and c == column)]
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(name, DataType.fromDDL(kind)) for name, _, kind in fields]])
    names = [*kept, *[f[0] for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                made = work(piece.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], *[pa.array(v, type=f[1]) for v, f in zip(made, fields, strict=True)]], names=names)
        del work
        release()

    return df.mapInArrow(run, schema)
