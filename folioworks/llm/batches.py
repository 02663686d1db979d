"""Whole texts to Arrow batches and back, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioworks.session import SENT, bound_batches  # noqa: F401  SENT is part of this module

#: A batch of results goes out at this many rows or input bytes.
ROWS, BYTES = 512, 1 << 22


def map_texts(docs: DataFrame, run: Callable[[Iterable[bytes]], Iterable[tuple]], fields: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without the column ``text``, unless ``keep_text``, and with ``fields`` (a DDL string).

    ``run`` makes, in a task, a tuple of the fields from each whole UTF-8 text (null: empty).
    Columns of ``docs`` that have a field's name are replaced. The session's Arrow batches are
    bounded from then on.
    """
    bound_batches(docs.sparkSession)
    added = T.StructType.fromDDL(fields)
    keep = [c for c in docs.columns if c != text and c not in added.names]
    source = docs.select(*(F.col(f"`{c}`") for c in [*keep, text]))  # the text goes to Python once
    same = [*keep, text] if keep_text else keep
    schema = T.StructType([*source.schema.fields[: len(same)], *added.fields])
    arrow = to_arrow_schema(added)

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            texts = batch.column(len(keep)).cast(pa.binary())
            start = size = 0
            for end in range(1, batch.num_rows + 1):
                size += len(texts[end - 1].as_buffer() or b"") if texts[end - 1].is_valid else 0
                if end == batch.num_rows or end - start >= ROWS or size >= BYTES:
                    rows = list(run(x.as_py() or b"" for x in texts.slice(start, end - start)))
                    made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(same)], *made], names=[*same, *arrow.names])
                    start, size = end, 0

    return source.mapInArrow(batches, schema)
