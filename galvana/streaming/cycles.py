"""Cycle detection over a stream of samples, with the state of each cell kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.config import Parsing

OUT = "cell_id string, row_id long, time double, phase int, cycle_index int, late boolean"
STATE = "phase int, cycle int, last_time double, last_row long"


def with_cycles(samples: DataFrame, cfg: Parsing = Parsing()) -> DataFrame:
    """phase and cycle_index of a stream of (cell_id, row_id, time, current).

    A cell's state is its last phase, its cycle and its last place in time. Samples of a batch are taken in time order; one
    that comes after a later one has been seen is marked late and has neither, so late rows can be counted or put aside. Of
    a batch, a cell's task holds three numbers for each sample.
    """
    rest = cfg.rest_current_threshold_a

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, cycle, last_time, last_row = state.get if state.exists else (0, 0, float("-inf"), -1)
        rows = pd.concat([f[["row_id", "time", "current"]] for f in frames]).sort_values(["time", "row_id"])
        late = (rows.time < last_time) | ((rows.time == last_time) & (rows.row_id <= last_row))
        if late.any():
            missed, none = rows[late], pd.array([pd.NA] * int(late.sum()), "Int32")
            yield pd.DataFrame({"cell_id": key[0], "row_id": missed.row_id, "time": missed.time, "phase": none, "cycle_index": none, "late": True})
        rows = rows[~late]
        if len(rows):
            sign = (rows.current > rest).astype(int) - (rows.current < -rest).astype(int)
            carried = sign.where(sign != 0).ffill().fillna(phase).astype(int)
            before = carried.shift(fill_value=phase)
            counted = cycle + ((before == -1) & (carried == 1)).cumsum()
            state.update((int(carried.iloc[-1]), int(counted.iloc[-1]), float(rows.time.iloc[-1]), int(rows.row_id.iloc[-1])))
            yield pd.DataFrame({"cell_id": key[0], "row_id": rows.row_id, "time": rows.time, "phase": carried, "cycle_index": counted, "late": False})

    return samples.select("cell_id", "row_id", "time", "current").groupBy("cell_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
