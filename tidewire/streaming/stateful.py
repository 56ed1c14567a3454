"""Keyed state in streams.

``FoldProcessor`` runs the same ``step(state, row)`` functions as the batch
fold, with the state kept as JSON in the state store (RocksDB on a cluster, so
it survives lost executors through the checkpoint).  An event-time timer
forgets a key once it has been idle for the retention time, which replaces
global caps on the number of keys.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidewire.operators import profiles
from tidewire.operators.detectors import BEACON_KEY
from tidewire.operators.ordered import cooldown_step
from tidewire.params import Params

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    def __init__(self, step, keys: list[str], order: str, out: list[str], retention: int):
        self.step, self.keys, self.order, self.out = step, keys, order, out
        self.retention_ms = retention * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        # rows of one micro-batch and key: at most one per time slot after pre-aggregation
        batch = pd.concat(list(rows)).sort_values(self.order)
        names = list(batch.columns)
        found: list[tuple] = []
        for values in zip(*[batch[n].tolist() for n in names], strict=True):
            row = dict(zip(names, values, strict=True))
            row.update(zip(self.keys, key, strict=True))
            state, rows_out = self.step(state, row)
            found.extend(rows_out)
        self.state.update((json.dumps(state, default=_plain),))
        if self.retention_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            newest = int(batch[self.order].max()) * 1000
            due = max(newest, timerValues.getCurrentWatermarkInMs()) + self.retention_ms
            self.handle.registerTimer(due)
        if found:
            yield pd.DataFrame(found, columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _plain(value: Any):
    return value.tolist() if hasattr(value, "tolist") else str(value)


def stream_fold(
    df: DataFrame, keys: list[str], order: str, step: Callable, schema: str, retention: int
) -> DataFrame:
    """Ordered fold over a stream; ``order`` is a column of whole seconds."""
    out = StructType.fromDDL(schema)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(step, keys, order, out.fieldNames(), retention),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime" if retention else "None",
    )


# --- steps that batch expresses with windows -----------------------------------------------


def beacon_step(params: Params = Params()) -> Callable:
    """Observation times of one series, kept as long as the retention; a late one falls into its place.

    The last ``beacon_observations`` times are judged by their extreme gaps.
    """
    need = params.beacon_observations

    def step(times: list | None, row: dict) -> tuple[list, list[tuple]]:
        at, times = row["at"], times or []
        place = bisect_left(times, at)
        if times[place:place + 1] == [at]:
            return times, []
        if place and at - times[place - 1] > params.beacon_retention:
            times, place = times[place:], 0
        times = [*times[:place], at, *times[place:]]
        # n observations cannot reach further back than n - 1 of the longest allowed gaps
        reach = max(params.beacon_retention, need * params.beacon_max_interval)
        times = times[bisect_left(times, times[-1] - reach):]
        if len(times) < need:
            return times, []
        gaps = np.diff(times[-need:])
        low, high, mean = int(gaps.min()), int(gaps.max()), float(gaps.mean())
        spread = max(high - mean, mean - low)
        steady = spread <= max(mean * params.beacon_jitter_ratio, params.beacon_jitter_floor)
        if not steady or low < params.beacon_min_interval or high > params.beacon_max_interval:
            return times, []
        return times, [(*(row[k] for k in BEACON_KEY), at, mean, spread / mean)]

    return step


BEACON_OUT = (
    "src_ip string, dst_ip string, dst_port int, protocol int, at bigint, interval_seconds double, jitter double"
)


def night_step(params: Params = Params()) -> Callable:
    """Counts of a device's day and night windows since its last long pause, as the batch windows count them."""

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        idle = state is not None and row["at"] - state["last"] > params.night_retention
        days, nights = (0, 0) if state is None or idle else (state["days"], state["nights"])
        known = days >= params.night_day_windows
        fresh = not row["is_day"] and nights < params.night_known_windows
        last = row["at"] if state is None else max(row["at"], state["last"])
        state = {"days": days + bool(row["is_day"]), "nights": nights + (not row["is_day"]), "last": last}
        return state, [(row["src_ip"], row["at"])] if known and fresh else []

    return step


NIGHT_OUT = "src_ip string, at bigint"


def profile_step(params: Params = Params()) -> Callable:
    """``profiles.profile_changes`` window by window: a round of votes, then runs that are long enough."""

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        at, now = row["at"], row["signature"]
        if state is None or at - state["at"] > params.profile_retention:
            state = {"usual": None, "votes": {}, "run": [None, 0]}
        elif at == state["at"]:
            return state, []
        state["at"] = at
        if state["usual"] is None:
            votes = state["votes"] = Counter(state["votes"]) + Counter([now])
            if votes.total() == params.profile_learning:
                top = min(votes, key=lambda x: (-votes[x], x))
                state |= {"usual": top if votes[top] >= params.profile_dominance else None, "votes": {}}
            return state, []
        name, length = state["run"]
        length = length + 1 if name == now else 1
        state["run"] = [now, length]
        if length != params.profile_confirm or now == state["usual"]:
            return state, []
        old, state["usual"] = state["usual"], now
        return state, [(row["src_ip"], at, old, now)]

    return step


PROFILE_OUT = "src_ip string, at bigint, old_profile string, new_profile string"


def peer_step(params: Params = Params()) -> Callable:
    """``profiles.new_peers`` for one window at a time: learn, or hand the unknown peers to the same confirmation."""
    confirm = profiles.confirm_step(params.peer_confirm)

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        at = row["at"]
        if state is None or at - state["at"] > params.peer_retention:
            state = {"number": -1, "learned": [], "open": None}
        elif at == state["at"]:
            return state, []
        state["at"], state["number"] = at, state["number"] + 1
        if state["number"] < params.peer_learning:
            state["learned"] = sorted({*state["learned"], *row["peers"]})
            return state, []
        found, pending = [], state["open"]
        if pending:
            pending = {**pending, "accepted": set(pending["accepted"]), "window": tuple(pending["window"])}
        for peer in sorted({*row["peers"]}.difference(state["learned"])):
            pending, out = confirm(pending, {"src_ip": row["src_ip"], "epoch": 0, "number": state["number"], "dst_ip": peer, "at": at})
            found += out
        state["open"] = pending and {**pending, "accepted": sorted(pending["accepted"])}
        return state, found

    return step


def stream_profile_change(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows`` as from ``profiles.profile_rows``."""
    return stream_fold(rows, ["src_ip"], "at", profile_step(params), PROFILE_OUT, params.profile_retention)


def stream_internal_peers(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows``: src_ip, ``at`` and the window's internal ``peers``."""
    return stream_fold(rows, ["src_ip"], "at", peer_step(params), profiles.PEER_OUT, params.peer_retention)


def stream_beacons(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows``: series key and ``at``."""
    key = ["src_ip", "dst_ip", "dst_port", "protocol"]
    return stream_fold(rows, key, "at", beacon_step(params), BEACON_OUT, params.beacon_retention)


def stream_nighttime(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows``: src_ip, ``at``, is_day."""
    return stream_fold(rows, ["src_ip"], "at", night_step(params), NIGHT_OUT, params.night_retention)


def stream_dedup(
    rows: DataFrame, cooldown: int, keys: list[str], carry: list[str], schema: str
) -> DataFrame:
    """``rows``: keys, ``at`` and carried columns; state is forgotten after the cooldown."""
    return stream_fold(rows, keys, "at", cooldown_step(cooldown, [*keys, "at", *carry]), schema, cooldown)


# --- packets ------------------------------------------------------------------------------------


class PacketFlows(StatefulProcessor):
    """Open flow per 5-tuple; closed by the next packet or by a timer."""

    OUT = (
        "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, first_us bigint, last_us bigint, "
        "bytes bigint, packets bigint, tcp_flags int"
    )

    def __init__(self, active: int = 30, idle: int = 15):
        self.active, self.idle = active * 1_000_000, idle * 1_000_000
        self.names = [field.split()[0] for field in self.OUT.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, last bigint, bytes bigint, packets bigint, flags int")

    def _expiry_ms(self, flow) -> int:
        due = min(flow[0] + self.active, flow[1] + self.idle)
        # checked on whole seconds, rounded up
        return -(-due // 1_000_000) * 1000

    def _frame(self, key, flows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f) for f in flows], columns=self.names)

    def handleInputRows(self, key, rows, timerValues):
        flow = tuple(self.open.get()) if self.open.exists() else None
        batch = pd.concat(list(rows)).sort_values("slot")
        done = []
        for r in batch.itertuples(index=False):
            tick = r.slot * 1_000_000
            if flow and (tick - flow[0] >= self.active or tick - flow[1] >= self.idle):
                done.append(flow)
                flow = None
            if flow is None:
                flow = (int(r.first_us), int(r.last_us), int(r.bytes), int(r.packets), int(r.tcp_flags))
            else:
                flow = (
                    min(flow[0], int(r.first_us)), max(flow[1], int(r.last_us)), flow[2] + int(r.bytes),
                    flow[3] + int(r.packets), flow[4] | int(r.tcp_flags),
                )
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update(flow)
        # a time already behind the watermark fires at the end of this micro-batch
        self.handle.registerTimer(self._expiry_ms(flow))
        if done:
            yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            flow = tuple(self.open.get())
            self.open.clear()
            yield self._frame(key, [flow])

    def close(self) -> None:
        pass


def stream_packet_flows(slots: DataFrame, active: int = 30, idle: int = 15) -> DataFrame:
    """``slots``: one row per 5-tuple and second, with a watermark on ``slot_ts``."""
    return slots.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").transformWithStateInPandas(
        statefulProcessor=PacketFlows(active, idle),
        outputStructType=StructType.fromDDL(PacketFlows.OUT),
        outputMode="Append",
        timeMode="EventTime",
    )
