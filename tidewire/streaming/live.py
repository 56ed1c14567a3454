"""The alert chain on a running flow stream.

Two queries share one job.  The first rolls flows up and, once the watermark closes a minute, reduces that whole minute
to feature rows with the batch operators: verdicts that need no history, and what each learned rule must see.  The
second feeds the features to one stateful operator, keyed by rule and by device or series, and takes what it finds
through cooldown, policies and notification rules.  Features are a few rows a device and minute, however many flows the
device has, and learned items (peers, destinations, ports) are entries of a state map, so a new one touches its own
entry only.  The state may start from the stored history.

Minutes are closed in order and never opened again: flows that come more than ``delay`` behind the newest are left to
the rollup table, which takes them however late, and raise no alert here.  A batch that is run again replaces its own
output, and features that were seen already are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidewire import schemas
from tidewire.functions import ip
from tidewire.functions.times import epoch
from tidewire.operators import detectors, profiles, rollup
from tidewire.operators.detectors import BEACON_KEY
from tidewire.params import Params
from tidewire.plans import chain
from tidewire.sources.store import files_for
from tidewire.streaming.jobs import TRIGGER, _query_of
from tidewire.streaming.stateful import beacon_step, night_step, profile_step

FEATURES = "kind string, key string, at bigint, body string"
FOUND = "kind string, at bigint, body string"
MEMORY = "kind string, key string, item string, at bigint, state string"
DAY = 86_400

# what the stateful operator finds, by kind
BODIES = {
    "done": "ip string, destination_ip string, type string, description string, severity string, status string",
    "night": "src_ip string, local_hour int, day_windows bigint, night_windows bigint, bytes bigint, packets bigint, "
    "dst_count bigint",
    "profile": "src_ip string, old_profile string, new_profile string",
    "peers": "src_ip string, dst_ip string",
    "novel": "src_ip string, item string, dst_ip string",
    "beacon": "src_ip string, dst_ip string, dst_port int, protocol int, interval_seconds double, jitter double",
}


# --- features of whole minutes ------------------------------------------------------------------


def _feature(rows: DataFrame, kind: str, key: Column, *body: Column | str) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), key.alias("key"), epoch("bucket_ts").alias("at"), F.to_json(F.struct(*body)).alias("body")
    )


def learning_features(minutes: DataFrame, metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """What learned rules see of whole minutes; ``metrics`` are their device metrics with profile columns."""
    source = F.col("src_ip")
    local = minutes.filter(ip.is_local("src_ip", params.local_cidrs))
    items = detectors.novelty_items(local, params, presence=True).groupBy("src_ip", "bucket_ts", "item")
    peers = profiles.peer_pairs(minutes, params).withColumn("bucket_ts", F.timestamp_seconds("at"))
    series = detectors.beacon_candidates(minutes, params)
    night = detectors.significant_windows(metrics, params)
    rows = [
        _feature(night, "night", source, "src_ip", "is_day", "local_hour", "bytes", "packets", "dst_count"),
        _feature(metrics, "profile", source, "src_ip", profiles.profile_signature(params).alias("signature")),
        _feature(peers, "peers", source, "src_ip", "dst_ip"),
        _feature(items.agg(F.min("dst_ip").alias("dst_ip")), "novel", source, "src_ip", "item", "dst_ip"),
        _feature(series, "beacon", F.to_json(F.struct(*BEACON_KEY)), *BEACON_KEY),
    ]
    return _union(rows)


def finished_features(
    minutes: DataFrame, metrics: DataFrame, baselines: DataFrame, params: Params = Params()
) -> DataFrame:
    """Feature rows of whole minutes, among them the alerts that need no history."""
    fanout = detectors.port_fanout(rollup.port_fanout_best(minutes, params), params)
    done = detectors.metric_alerts(metrics, baselines, params).unionByName(fanout.select(*schemas.ALERT_COLUMNS))
    columns = [c for c in schemas.ALERT_COLUMNS if c != "created_at"]
    ready = _feature(done.withColumnRenamed("created_at", "bucket_ts"), "done", F.col("ip"), *columns)
    return learning_features(minutes, metrics, params).unionByName(ready)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


# --- rules over the features of one key, minute by minute --------------------------------------------


class Items:
    """Items a key has met, with the last time of each; the state map in streams, a dict where history is read."""

    def __init__(self, entries: dict | None = None):
        self.entries = {} if entries is None else entries

    def last(self, item: str) -> int | None:
        return self.entries.get(item)

    def meet(self, item: str, at: int) -> None:
        self.entries[item] = at

    def all(self) -> list[tuple[str, int]]:
        return list(self.entries.items())

    def drop(self, item: str) -> None:
        del self.entries[item]

    def clear(self) -> None:
        self.entries.clear()


class StoredItems(Items):
    def __init__(self, entries):
        super().__init__(entries)

    def last(self, item):
        found = self.entries.getValue((item,))
        return None if found is None else found[0]

    def meet(self, item, at):
        self.entries.updateValue((item,), (at,))

    def all(self):
        return [(k[0], v[0]) for k, v in self.entries.iterator()]

    def drop(self, item):
        self.entries.removeKey((item,))


def _night(params: Params) -> Callable:
    judge = night_step(params)

    def step(state, items, at, rows):
        state, hits = judge(state, {**rows[0], "at": at})
        # the counts before this window, which is one of the night
        return state, [{**rows[0], "day_windows": state["days"], "night_windows": state["nights"] - 1} for _ in hits]

    return step


def _profile(params: Params) -> Callable:
    judge = profile_step(params)

    def step(state, items, at, rows):
        state, hits = judge(state, {**rows[0], "at": at})
        return state, [{"src_ip": h[0], "old_profile": h[2], "new_profile": h[3]} for h in hits]

    return step


def _beacon(params: Params) -> Callable:
    judge = beacon_step(params)

    def step(state, items, at, rows):
        state, hits = judge(state, {**rows[0], "at": at})
        return state, [{**rows[0], "interval_seconds": h[-2], "jitter": h[-1]} for h in hits]

    return step


def _peers(params: Params) -> Callable:
    """Peers of the learning windows are items; later the smallest unknown one of a window goes to the confirmation."""
    confirm = profiles.confirm_step(params.peer_confirm)

    def step(state, items, at, rows):
        if state is None or at - state["at"] > params.peer_retention:
            items.clear()
            state = {"number": -1, "open": None}
        state = {**state, "at": at, "number": state["number"] + 1}
        if state["number"] < params.peer_learning:
            for row in rows:
                items.meet(row["dst_ip"], at)
            return state, []
        found, pending = [], state["open"]
        if pending:
            pending = {**pending, "accepted": set(pending["accepted"]), "window": tuple(pending["window"])}
        for row in sorted(rows, key=lambda r: r["dst_ip"]):
            if items.last(row["dst_ip"]) is None:
                pending, hits = confirm(pending, {**row, "epoch": 0, "number": state["number"], "at": at})
                found += [{"src_ip": h[0], "dst_ip": h[2]} for h in hits]
        state["open"] = pending and {**pending, "accepted": sorted(pending["accepted"])}
        return state, found

    return step


def _novel(params: Params) -> Callable:
    """Items not met within the lookback, for sources whose n-th window before lies in it; old items go once a day."""
    need, back = params.novelty_min_history, params.novelty_lookback + 1

    def step(state, items, at, rows):
        state = state or {"windows": [], "swept": at}
        windows = state["windows"]
        mature = need <= 0 or (len(windows) >= need and windows[-need] >= at - back)
        found = []
        for row in rows:
            if row["item"] == "w":
                continue
            last = items.last(row["item"])
            if mature and (last is None or last < at - back):
                found.append(row)
            items.meet(row["item"], at)
        state["windows"] = [*windows, at][-need:] if need > 0 else []
        if at - state["swept"] >= DAY:
            for item, last in items.all():
                if last < at - back:
                    items.drop(item)
            state["swept"] = at
        return state, found

    return step


def _done(params: Params) -> Callable:
    return lambda state, items, at, rows: (state, rows)


RULES = {"night": _night, "profile": _profile, "peers": _peers, "novel": _novel, "beacon": _beacon, "done": _done}


def _retention(params: Params) -> dict[str, int]:
    """Idle seconds after which the whole state of a key goes; rules forget by then what a longer pause would.

    Alerts that need no history are kept in mind for a day, beyond the time in which a repeated batch may come.
    """
    return {
        "night": params.night_retention, "profile": params.profile_retention, "peers": params.peer_retention,
        "novel": params.novelty_lookback + 1,
        "beacon": max(params.beacon_retention, params.beacon_observations * params.beacon_max_interval), "done": DAY,
    }


def judge(rule: Callable, memory: dict | None, items: Items, rows: Iterable[tuple[int, str]]) -> tuple[dict, list]:
    """Run a rule over (at, body) rows of one key; ``memory`` holds its state and the last minute it has seen."""
    memory = memory or {"state": None, "last": None}
    seen, found = memory["last"], []
    for at, group in groupby(sorted(rows), key=lambda r: r[0]):
        if seen is not None and at <= seen:
            continue  # a batch that was run again
        bodies = [json.loads(body) for _, body in group]
        state, hits = rule(memory["state"], items, at, bodies)
        memory = {"state": state, "last": at}
        found += [(at, json.dumps(hit)) for hit in hits]
    return memory, found


class LiveRules(StatefulProcessor):
    """State of a key: what its rule keeps, as one small value, and the items it has met, as a map."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "body string")
        self.items = StoredItems(handle.getMapState("items", "item string", "at bigint"))
        self.rules = {kind: make(self.params) for kind, make in RULES.items()}
        self.retention = _retention(self.params)

    def _timer(self, kind: str, at: int, watermark_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at * 1000, watermark_ms) + (self.retention[kind] + 1) * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for item, at, state in initialState[["item", "at", "state"]].itertuples(index=False):
            if isinstance(state, str):
                self.memory.update((state,))
                self._timer(key[0], int(at), 0)
            else:
                self.items.meet(item, int(at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind = key[0]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        # a set: a feature that two batches of the first query wrote is one feature
        features = {(int(a), b) for part in rows for a, b in zip(part["at"], part["body"], strict=True)}
        memory, found = judge(self.rules[kind], memory, self.items, features)
        self.memory.update((json.dumps(memory),))
        self._timer(kind, memory["last"], timerValues.getCurrentWatermarkInMs())
        if found:
            yield pd.DataFrame([(kind, *f) for f in found], columns=["kind", "at", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        self.items.clear()
        return iter([])

    def close(self) -> None:
        pass


def learned_memory(features: DataFrame, params: Params = Params()) -> DataFrame:
    """State after the given features, as rows that ``live_rules`` can start from.

    Keys are streamed in order through the same rules; a task holds one minute of one key and that key's state.
    """

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {kind: make(params) for kind, make in RULES.items()}

        def rows():
            for part in parts:
                yield from part[["kind", "key", "at", "body"]].itertuples(index=False, name=None)

        for (kind, key), group in groupby(rows(), key=lambda r: r[:2]):
            memory, items = None, Items()
            for _, minute in groupby(group, key=lambda r: r[2]):
                memory, _ = judge(rules[kind], memory, items, [r[2:] for r in minute])
            out = [(kind, key, None, memory["last"], json.dumps(memory))]
            out += [(kind, key, item, at, None) for item, at in items.all()]
            yield pd.DataFrame(out, columns=["kind", "key", "item", "at", "state"])

    learning = features.filter("kind <> 'done'").select("kind", "key", "at", "body")
    return learning.repartition("kind", "key").sortWithinPartitions("kind", "key", "at").mapInPandas(run, MEMORY)


def live_rules(features: DataFrame, params: Params = Params(), memory: DataFrame | None = None) -> DataFrame:
    """Findings (``FOUND``) of a stream of features with a watermark."""
    return features.groupBy("kind", "key").transformWithStateInPandas(
        statefulProcessor=LiveRules(params),
        outputStructType=FOUND,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if memory is None else memory.groupBy("kind", "key"),
    )


def candidates_of(found: DataFrame, params: Params = Params()) -> DataFrame:
    """Alert columns of findings."""

    def rows(kind: str) -> DataFrame:
        body = F.from_json("body", BODIES[kind])
        named = found.filter(F.col("kind") == kind).select("at", F.timestamp_seconds("at").alias("bucket_ts"), body.alias("b"))
        return named.select("at", "bucket_ts", "b.*")

    frames = [
        rows("done").withColumnRenamed("bucket_ts", "created_at"),
        detectors.night_alerts(rows("night"), params),
        profiles.profile_alerts(rows("profile"), params),
        profiles.peer_alerts(rows("peers"), params),
        detectors.novelty_alerts(rows("novel"), params),
        detectors.beacon_alerts(rows("beacon"), params),
    ]
    return _union([f.select(*schemas.ALERT_COLUMNS) for f in frames])


# --- jobs --------------------------------------------------------------------------------------


def _put(rows: DataFrame, path: str, name: str, *by: str) -> None:
    """Write a batch's rows as partitions of its own; the same name again replaces them."""
    (
        rows.withColumn("batch", F.lit(name))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by, "batch")
        .parquet(path)
    )


def feature_sink(folder: str, baselines: Callable[[], DataFrame], params: Params = Params()):
    """``foreachBatch`` function over finished minutes: store their features, all rows of a key in one file."""

    def write(minutes: DataFrame, batch_id: int) -> None:
        minutes = minutes.persist()
        metrics = rollup.device_window_metrics(minutes, params, with_profile=True).persist()
        try:
            rows = finished_features(minutes, metrics, baselines(), params)
            _put(rows.repartition(files_for(minutes), "kind", "key"), folder, f"{_query_of(minutes)}-{batch_id}")
        finally:
            metrics.unpersist()
            minutes.unpersist()

    return write


def alert_sink(
    out: str, policies: Callable[[], DataFrame], rules: Callable[[], DataFrame], configured: Sequence[str],
    params: Params = Params(),
):
    """``foreachBatch`` function over findings: cooldown, policies, store, plan notifications.

    Earlier alerts and dispatches are read as far back as the longest cooldown reaches.  Their own batch is left out,
    so a batch that is run again decides as before.
    """

    def write(found: DataFrame, batch_id: int) -> None:
        spark, name = found.sparkSession, f"{_query_of(found)}-{batch_id}"

        def hold(rows: DataFrame, step: str) -> DataFrame:
            """Written once and reread, so that what follows is planned over a table and not over all steps again."""
            path = f"{out}/steps/{step}/batch={name}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        found = found.persist()
        try:
            first = found.agg(F.min("at")).first()[0]
            if first is None:
                return
            waits = [t.agg(F.coalesce(F.max("cooldown_seconds"), F.lit(0))).first()[0] for t in (policies(), rules())]
            others = F.col("batch") != name

            def since(path: str, schema: str, at: str, seconds: int) -> DataFrame:
                low = F.timestamp_seconds(F.lit(first - seconds - 1))
                stored = spark.read.schema(schema + ", day date, batch string").parquet(path)
                return stored.filter(others & (F.col("day") >= low.cast("date")) & (F.col(at) >= low))

            look = max(params.behaviour_cooldown, waits[0])
            earlier = hold(chain.last_alerts(since(f"{out}/alerts", chain.ALERTS, "created_at", look)), "earlier")
            candidates = hold(candidates_of(found, params), "candidates")
            kept = hold(chain.spaced_alerts(candidates, params, earlier), "kept")
            judged = hold(chain.judged_alerts(kept, policies(), params, earlier), "judged")
            _put(judged.withColumn("day", F.to_date("created_at")), f"{out}/alerts", name, "day")
            sent = since(f"{out}/notifications", _LOGS, "dispatched_at", waits[1]).filter("status = 'dispatch'")
            logs = chain.planned_notifications(judged, rules(), configured, params, sent.filter("rule_id is not null"))
            named = logs.join(judged.select(F.col("id").alias("anomaly_id"), "ip", "type"), "anomaly_id")
            _put(named.withColumn("day", F.to_date("dispatched_at")), f"{out}/notifications", name, "day")
        finally:
            found.unpersist()

    return write


# a notification log row with the device and type that its rule's cooldown goes by
_LOGS = schemas.NOTIFICATION_LOGS + ", ip string, type string"


def _empty(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """Make a table's folder, so that the first reader finds one."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def start_live(
    spark: SparkSession,
    flows: DataFrame,
    folder: str,
    baselines: Callable[[], DataFrame],
    policies: Callable[[], DataFrame],
    rules: Callable[[], DataFrame],
    configured: Sequence[str],
    params: Params = Params(),
    history: DataFrame | None = None,
    delay: str = "2 minutes",
    once: bool = False,
) -> list[StreamingQuery]:
    """Start both queries; tables and checkpoints lie under ``folder``.

    ``history`` has aggregates older than the stream, from which the rules' state starts.  With ``once`` both queries
    take what is there and end.  Read ``<folder>/alerts`` and ``<folder>/notifications``.
    """
    features = f"{folder}/features"
    _empty(spark, features, FEATURES + ", batch string", "batch")
    _empty(spark, f"{folder}/alerts", chain.ALERTS + ", day date, batch string", "day", "batch")
    _empty(spark, f"{folder}/notifications", _LOGS + ", day date, batch string", "day", "batch")

    def start(stream: DataFrame, name: str, sink: Callable) -> StreamingQuery:
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoints/{name}")
        writer = writer.foreachBatch(sink)
        query = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)
        query = query.start()
        if once:
            query.awaitTermination()
        return query

    minutes = rollup.minute_rollup(flows.withWatermark("event_ts", delay))
    first = start(minutes, "minutes", feature_sink(features, baselines, params))
    memory = None
    if history is not None:
        metrics = rollup.device_window_metrics(history, params, with_profile=True)
        memory = learned_memory(learning_features(history, metrics, params), params)
    # a file of the first query that was replaced meanwhile comes again under its new name
    source = spark.readStream.schema(FEATURES + ", batch string").option("ignoreMissingFiles", True).parquet(features)
    source = source.drop("batch").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "1 hour")
    return [first, start(live_rules(source, params, memory), "rules", alert_sink(folder, policies, rules, configured, params))]
