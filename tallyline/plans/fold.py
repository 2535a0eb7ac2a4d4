"""State machines over ordered rows, streamed through Arrow batches.

Rows are shuffled by key and sorted by Spark (spilling as needed); the Python
side sees one row after another and keeps only the state of the current key,
so a key is never held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.types as kinds
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _values(column: pa.Array) -> list:
    """The column as a list; plain numbers without nulls are not made one by one."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count == 0 and (kinds.is_integer(column.type) or kinds.is_floating(column.type)):
        return column.to_numpy().tolist()
    return column.to_pylist()


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: T.StructType,
    new_state: Callable[[], object],
    step: Callable[[object, tuple], tuple | list[tuple] | None],
    finish: Callable[[tuple, object], list[tuple]] | None = None,
) -> DataFrame:
    """Emit ``step(state, row)`` for each row of each key in order: a row, a list of rows, or ``None`` for nothing.

    ``row`` is a tuple in the order of ``df.columns``. ``step`` changes
    ``state`` in place; a new state is made when the key changes, after
    ``finish(key, state)`` has given the rows that the old one leaves.
    """
    columns = df.columns
    key_at = [columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(zip(*out, strict=True), arrow, strict=True)],
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = zip(*[_values(c) for c in batch.columns], strict=True)
            out = []
            for row in rows:
                key = tuple([row[i] for i in key_at])
                if key != current:
                    if finish is not None and current is not None:
                        out += finish(current, state)
                    current, state = key, new_state()
                result = step(state, row)
                if isinstance(result, list):
                    out += result
                elif result is not None:
                    out.append(result)
            if out:
                yield batch_of(out)
        if finish is not None and current is not None:
            last = finish(current, state)
            if last:
                yield batch_of(last)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
