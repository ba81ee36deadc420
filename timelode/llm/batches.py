"""Work on batches of texts inside tasks, for the operators that aren't native."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from timelode.operators.memory import give_back, slices


def chunks(texts: Sequence[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of texts of about ``limit`` characters, which bounds the
    work arrays; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def with_found(rows: DataFrame, text: str, found: T.StructType, work: Callable[[list[str]], Mapping[str, Sequence]], keep_text: bool = False) -> DataFrame:
    """rows without the column ``text`` (or with it, where it is wanted on), with the columns
    ``found`` that ``work`` makes of a batch of texts (null: empty). The other columns stay in Arrow, so
    values of every type, nulls and large ids come out as they went in. A worker outlives its
    task, so memory that it has no more use for is given back at the end (``give_back``)."""
    keep = [f for f in rows.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text))):
            at = batch.schema.get_field_index(text)
            made = work([t or "" for t in batch.column(at).to_pylist()])
            arrays = [batch.column(i) for i in range(batch.num_columns) if keep_text or i != at]
            names = [batch.schema.field(i).name for i in range(batch.num_columns) if keep_text or i != at]
            for field in found.fields:
                arrays.append(pa.array(made[field.name], _arrow(field.dataType)))
                names.append(field.name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            del batch, made, arrays
        give_back()

    return rows.mapInArrow(run, T.StructType(keep + list(found.fields)))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]
