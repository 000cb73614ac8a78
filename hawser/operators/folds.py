"""Sequential computations per key: a key's rows are one sorted stream, of which only the state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple[object, list[tuple]]], close: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """Rows (key, ...) that `step(state, row)` and, at a key's end, `close(state)` give; `schema` names all columns.

    Keys run in parallel; a key's memory is its state and one batch, however many rows it has.
    """
    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, state, begun, out = None, None, False, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if not begun or k != of:
                    if begun:
                        out += [(of, *r) for r in close(state)]
                    of, state, begun = k, start(), True
                state, found = step(state, row)
                out += [(k, *r) for r in found]
            yield pd.DataFrame(out, columns=names)
            out = []
        if begun:
            yield pd.DataFrame([(of, *r) for r in close(state)], columns=names)

    return ordered.mapInPandas(run, schema)
