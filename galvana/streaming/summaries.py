"""Summaries of closed cycles from a stream of samples, whatever order they come in within the watermark.

A cell's state is a list of samples that wait for their place and the summary of its open cycle. Samples are taken in time
order once the watermark has passed them, since none before them can come any more; later ones than that are dropped by
Spark. Event-time timers take what waits when no further sample of the cell comes, and close the open cycle of a cell that
has been silent for `idle_s`; if it goes on after all, the rest of that cycle is another row with the next `part`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.config import Parsing

OUT = (
    "cell_id string, cycle_index int, part int, n_points long, duration_s double, voltage_min double, voltage_max double, voltage_range double, "
    "charge_capacity_ah double, discharge_capacity_ah double, c_rate_est double"
)
_WAITING = "row_id long, time double, current double, voltage double"
#: Of the open cycle; `last` is the latest sample placed, `n` is 0 while no cycle is open.
_OPEN = (
    "phase int, cycle int, part int, last_time double, last_amps double, n long, first_time double, low double, high double, "
    "charge double, discharge double, amps double, moving long"
)
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Summaries(StatefulProcessor):
    def __init__(self, nominal_ah: float | None, rest: float, idle_s: float):
        self.nominal_ah, self.rest, self.idle_s = nominal_ah, rest, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["row_id", "time", "current", "voltage"]] for r in rows])
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, None, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.waiting.get()), columns=["row_id", "time", "current", "voltage"])
        rows = held if new is None else pd.concat([held, new]) if len(held) else new
        ready = np.round(rows["time"].to_numpy(float) * 1e6) <= watermark_ms * 1000
        rest = rows[~ready]
        if ready.any() or new is not None:
            self.waiting.put(list(rest.itertuples(index=False, name=None))) if len(rest) else self.waiting.clear()
        state = dict(zip(_FIELDS, self.open.get(), strict=True)) if self.open.exists() else dict.fromkeys(_FIELDS, 0)
        closed = list(self._placed(rows[ready].sort_values(["time", "row_id"]), state)) if ready.any() else []
        silent_until = state["last_time"] + self.idle_s
        if state["n"] and not len(rest) and silent_until * 1000 <= watermark_ms:
            closed.append(self._summary(state))
            state |= {"n": 0, "part": state["part"] + 1}
        if closed or ready.any():
            self.open.update(tuple(kind(state[f]) for f, kind in zip(_FIELDS, _KINDS, strict=True)))
        if len(rest):
            self.handle.registerTimer(int(np.ceil(rest["time"].max() * 1000)))
        elif state["n"]:
            self.handle.registerTimer(int(np.ceil(silent_until * 1000)))
        if closed:
            yield pd.DataFrame([(str(key[0]), *row) for row in closed], columns=[c.split()[0] for c in OUT.split(", ")])

    def _placed(self, rows: pd.DataFrame, state: dict) -> Iterator[tuple]:
        """Adds rows in time order to the open cycle; gives the summaries of the cycles that they close."""
        time, current, voltage = (rows[c].to_numpy(float) for c in ("time", "current", "voltage"))
        amps = np.abs(current)
        sign = (current > self.rest).astype(int) - (current < -self.rest).astype(int)
        phase = pd.Series(sign).where(sign != 0).ffill().fillna(state["phase"]).to_numpy(int)
        before = np.r_[state["phase"], phase[:-1]]
        cycle = state["cycle"] + np.cumsum((before == -1) & (phase == 1))
        same = (phase == before) & (cycle == np.r_[state["cycle"], cycle[:-1]])
        same[0] &= state["n"] > 0  # a half-cycle's area begins at its first sample
        step = np.diff(time, prepend=state["last_time"])
        area = np.where(same, (amps + np.r_[state["last_amps"], amps[:-1]]) / 2 * step / 3600, 0.0)
        for c in np.unique(cycle):
            own = cycle == c
            if c != state["cycle"]:
                if state["n"]:
                    yield self._summary(state)
                state |= {"cycle": int(c), "part": 0, "n": 0}
            if not state["n"]:
                state |= {"first_time": time[own][0], "low": np.inf, "high": -np.inf, "charge": 0.0, "discharge": 0.0, "amps": 0.0, "moving": 0}
            state["n"] += int(own.sum())
            state["low"], state["high"] = min(state["low"], voltage[own].min()), max(state["high"], voltage[own].max())
            state["charge"] += area[own & (phase == 1)].sum()
            state["discharge"] += area[own & (phase == -1)].sum()
            state["amps"] += amps[own].sum()
            state["moving"] += int((amps[own] > 0).sum())
            state |= {"last_time": time[own][-1], "last_amps": amps[own][-1], "phase": int(phase[own][-1])}

    def _summary(self, s: dict) -> tuple:
        mean = s["amps"] / s["moving"] if s["moving"] else 0.0
        rate = mean / self.nominal_ah if self.nominal_ah and self.nominal_ah > 0 else None
        return (
            s["cycle"], s["part"], s["n"], s["last_time"] - s["first_time"], s["low"], s["high"], s["high"] - s["low"], s["charge"], s["discharge"], rate,
        )


_FIELDS = [c.split()[0] for c in _OPEN.split(", ")]
_KINDS = [float if c.endswith("double") else int for c in _OPEN.split(", ")]


def cycle_summaries(samples: DataFrame, nominal_capacity_ah: float | None, lateness: str = "10 minutes", idle_s: float = 86400.0, cfg: Parsing = Parsing()) -> DataFrame:
    """One row for each closed cycle of a stream of (cell_id, row_id, time: seconds, current, voltage), as `cycle_meta` gives
    them. Samples may come late by `lateness`. Keeps its state in RocksDB, which this sets for the session if nothing is set."""
    spark = samples.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = samples.select("cell_id", "row_id", "time", "current", "voltage", F.timestamp_micros(F.round(F.col("time") * 1e6).cast("long")).alias("at"))
    processor = _Summaries(nominal_capacity_ah, cfg.rest_current_threshold_a, idle_s)
    return rows.withWatermark("at", lateness).groupBy("cell_id").transformWithStateInPandas(processor, OUT, "append", "eventtime")


def rest_sessions(samples: DataFrame, rest_s: float, cfg: Parsing = Parsing(), lateness: str | None = None) -> DataFrame:
    """Half-cycles as stretches of one sign of current that rest for no longer than `rest_s`: cell_id, sign, begin and end (of
    the samples, seconds), n_points, voltage_min, voltage_max and ampere_seconds (sum of absolute currents). For tables and,
    with a lateness, for streams, where a stretch is given once the watermark has passed its rest."""
    moving = F.signum(F.when(F.abs("current") > cfg.rest_current_threshold_a, F.col("current")))
    rows = samples.select("cell_id", "time", "voltage", F.abs("current").alias("amps"), moving.cast("int").alias("sign"), F.timestamp_micros(F.round(F.col("time") * 1e6).cast("long")).alias("at"))
    rows = rows.where(F.col("sign").isNotNull())
    rows = rows.withWatermark("at", lateness) if lateness else rows
    return rows.groupBy("cell_id", "sign", F.session_window("at", f"{round(rest_s * 1000)} milliseconds")).agg(
        F.min("time").alias("begin"), F.max("time").alias("end"), F.count(F.lit(1)).alias("n_points"),
        F.min("voltage").alias("voltage_min"), F.max("voltage").alias("voltage_max"), F.sum("amps").alias("ampere_seconds"),
    ).drop("session_window")
