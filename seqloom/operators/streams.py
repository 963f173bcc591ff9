"""Groups of rows that a task holds, met by any number of rows that pass by.

A join whose one side is held group by group: the rows of a group come first, in an order of their own, and
behind them, as a stream, the rows that ask for the group.  A task holds one group at a time, so what it needs is
bounded by the group, whatever the number of askers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lined_up(rows: DataFrame, asking: DataFrame, by: Sequence[str], order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Both sides by group (whole numbers), the rows in ``order`` before the askers; ``_asks`` tells them apart.

    With ``tasks``, groups are numbers below that, and each has a task of its own.
    """
    both = rows.withColumn("_asks", F.lit(0)).unionByName(asking.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(*by) if tasks is None else both.repartitionById(tasks, F.col(by[0]))
    return dealt.sortWithinPartitions(*by, "_asks", *order)


def in_turn(
    batches: Iterator[pa.RecordBatch], by: Sequence[str], hold: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], together: int,
) -> Iterator[pa.RecordBatch]:
    """``answer`` of what ``hold`` made of a group's rows and of its askers, at most ``together`` of them at a time.

    Askers of a group without rows get no answer.
    """
    group, rows, held = None, [], None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*by, "_asks")])
        ends = np.append(np.flatnonzero((np.diff(place) != 0).any(0)) + 1, batch.num_rows)
        start = 0
        for end in ends[ends > 0].tolist():
            part, (*own, asks) = batch.slice(start, end - start), place[:, start].tolist()
            start = end
            if own != group:
                group, rows, held = own, [], None
            if not asks:
                rows.append(part)
                continue
            if held is None and rows:
                held, rows = hold(pa.Table.from_batches(rows).combine_chunks()), []
            if held is not None:
                for at in range(0, part.num_rows, together):
                    yield from answer(held, part.slice(at, together))
