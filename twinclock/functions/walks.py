"""One pass over sorted rows, for rules that need the rows before: what a key needs to remember is all that a task holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def walk(df: DataFrame, keys: list[str], order: list[str], step: Callable[[], Callable[[tuple], Iterator[tuple]]], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """keys and `columns` of the rows that a walk gives.

    Each key's rows come in order to one walker, a function of a row's `order` values; a last call with None ends the key. A key
    does not have to fit in memory.
    """
    names = [*keys, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walker = None, None
        kinds = None

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys] + list(columns.values())
            out: list[tuple] = []
            own = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for key, row in zip(own, zip(*[batch.column(c).to_pylist() for c in order], strict=True), strict=True):
                if walker is None or key != now:
                    if walker is not None:
                        out += [(*now, *x) for x in walker(None)]
                    now, walker = key, step()
                out += [(*key, *x) for x in walker(row)]
            yield emitted(out)
        if walker is not None:
            yield emitted([(*now, *x) for x in walker(None)])

    kept = df.select(*keys, *order)
    kind = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kind}, {schema}")
