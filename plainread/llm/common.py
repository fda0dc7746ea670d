"""What several operators of this folder need."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn labels from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: What a worker process remembers between the tasks of one operator.
_memory: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object of this key, made when first asked for; what another key left is dropped."""
    if key not in _memory:
        _memory.clear()
        _memory[key] = make()
    return _memory[key]


def forget() -> None:
    """Workers are reused: a stage with memory needs of its own drops what an earlier one remembered."""
    _memory.clear()


def type_of(table: DataFrame, column: str) -> str:
    return table.schema[column].dataType.simpleString()


def each(column: pa.Array) -> Iterator[str]:
    """The texts of a column one by one, null as empty; only one is a Python object at a time."""
    for value in column:
        yield value.as_py() or ""


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    return each(batch.column(column))


def carried(table: DataFrame, column: str, made: str) -> T.StructType:
    """Schema of a mapInArrow result: one column as it is, and the made ones."""
    return T.StructType([table.schema[column], *T.StructType.fromDDL(made)])


def unpacked(table: DataFrame, row: str, columns: Sequence[str], made: Sequence[str]) -> DataFrame:
    """The columns packed in ``row`` beside the made ones; a made column replaces a carried one of
    its name."""
    return table.select(*[F.col(row)[c].alias(c) for c in columns if c not in made],
                        *[F.col(f"`{m}`") for m in made])


def keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """What tells rows apart: 64-bit hashes of the id and, with another seed, of the text, which also
    tells texts apart where many rows share one id or have none.  Rows that agree in both are
    copies under one id, whose results are the same."""
    return (F.xxhash64(F.col(doc_id)).alias("_row"),
            F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("_mark"))
