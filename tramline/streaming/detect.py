"""Structured Streaming: arrivals from stop changes, vehicles that fall silent, hourly counts; state is per key and bounded.

The same functions serve a live stream and the replay of stored files with the trigger availableNow. Within a micro-batch a
vehicle's rows are put in order; rows older than what its state has seen are late and dropped, so order holds across batches.
A source should bound its micro-batches (maxFilesPerTrigger), as a vehicle's rows of one are in memory together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A vehicle at the stop that it was last reported at within so many seconds has not arrived anew.
SAME_VISIT = 900
#: A vehicle without a report for so many seconds is gone.
GONE_S = 900


def _arrivals(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One row each time a vehicle is first reported at a stop; the state is its last stop and time."""
    rows = pd.concat(batches).sort_values(["t", "event_id"])
    stop, seen = state.get if state.exists else (None, None)
    if seen is not None:
        rows = rows[rows.t >= seen]
    out = []
    for event, t, at in zip(rows.event_id, rows.t, rows.stop, strict=True):
        if at != stop or t - seen > SAME_VISIT:
            out.append((key[0], event, at, t, stop))
        stop, seen = at, t
    if seen is not None:
        state.update((stop, int(seen)))
    yield pd.DataFrame(out, columns=["veh", "event_id", "stop", "t", "from_stop"])


def arrivals(reports: DataFrame) -> DataFrame:
    """Stream of (veh, event_id, stop, t, from_stop) for a stream of reports (veh, event_id, stop, t)."""
    return reports.groupBy("veh").applyInPandasWithState(
        _arrivals, "veh long, event_id long, stop string, t long, from_stop string", "stop string, t long", "append", GroupStateTimeout.NoTimeout
    )


def _silence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row when event time has passed a vehicle's last report by GONE_S; its state goes with it."""
    if state.hasTimedOut:
        last = state.get[0]
        state.remove()
        yield pd.DataFrame({"veh": [key[0]], "last_t": [last]})
        return
    last = max([int(b.t.max()) for b in batches] + ([state.get[0]] if state.exists else []))
    state.update((last,))
    due = (last + GONE_S) * 1000
    if due > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(due)
    else:  # The watermark is past it already: it ends with the next batch.
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
    yield pd.DataFrame({"veh": [], "last_t": []})


def silences(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream of (veh, last_t): vehicles whose last report is GONE_S seconds old by the stream's own clock; reports have veh and t.

    The clock is the watermark, so a halted feed makes nobody gone; a vehicle that comes back is watched anew."""
    timed = reports.select("veh", "t", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("veh").applyInPandasWithState(_silence, "veh long, last_t long", "t long", "append", GroupStateTimeout.EventTimeTimeout)


#: An arrival whose vehicle is silent for so many seconds ends with its last report there; near a stop, metres; speed of a vehicle that stands, metres a second.
SILENT_S, RADIUS_M, STANDS = 120, 60.0, 1.0


class Visit:
    """A vehicle's arrival at a stop, held back until its dwell is known."""

    def __init__(self, held: tuple | None = None) -> None:
        self.stop, self.trip, self.since, self.last, self.named = held or (None, None, None, None, None)
        self.out: list[tuple] = []

    def close(self, moved: bool) -> None:
        """Give the arrival that is held, if any: its dwell runs to the last report at the stop."""
        if self.stop is not None:
            self.out.append((self.stop, self.trip, self.since, self.last - self.since, moved, self.named != self.trip))
        self.stop = None

    def report(self, t: int, trip: int | None, stop: int | None) -> None:
        """A report at a stop, or (null) between stops. The trip that the bus was on when it came keeps the visit, whatever the feed calls it later."""
        if self.last is not None and t < self.last:
            return
        if self.stop is not None and t - self.last > SILENT_S:
            self.close(False)
        if stop != self.stop:
            self.close(True)
            if stop is not None:
                self.stop, self.trip, self.since = stop, trip, t
        self.last, self.named = t, trip


def _visits(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    visit = Visit(state.get if state.exists else None)
    if state.hasTimedOut:
        visit.close(False)
        state.remove()
    else:
        rows = pd.concat(batches).sort_values(["t", "event_id"])
        for t, trip, stop in zip(rows["t"].tolist(), rows["trip"].tolist(), rows["stop"].tolist(), strict=True):
            visit.report(int(t), None if pd.isna(trip) else int(trip), None if pd.isna(stop) else int(stop))
        if visit.last is not None:
            state.update((visit.stop, visit.trip, visit.since, visit.last, visit.named))
            state.setTimeoutTimestamp(max((visit.last + SILENT_S + 1) * 1000, state.getCurrentWatermarkMs() + 1))
    out = pd.DataFrame([(key[0], *x) for x in visit.out], columns=["veh", "stop", "trip", "t", "dwell", "moved", "renamed"])
    yield out.astype({"trip": "Int64"})


def visits(reports: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Stream of (veh, stop, trip, t, dwell, moved, renamed): arrivals with the seconds that the vehicle then stood there.

    reports: veh, event_id, trip, stop (null between stops), t. An arrival is held until its vehicle reports somewhere else (moved) or the stream's clock has passed its last report by
    SILENT_S; so none is given without its dwell. State is per vehicle, so a feed that renames the trip in mid-visit (renamed) hands the visit on. Reports older than the last one are late and dropped."""
    timed = reports.select("veh", "event_id", F.col("trip").cast("long").alias("trip"), F.col("stop").cast("long").alias("stop"), "t", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("veh").applyInPandasWithState(
        _visits, "veh long, stop long, trip long, t long, dwell long, moved boolean, renamed boolean", "stop long, trip long, since long, last long, named long", "append", GroupStateTimeout.EventTimeTimeout
    )


def at_stops(reports: DataFrame, stops: DataFrame, lines: DataFrame) -> DataFrame:
    """reports (veh, event_id, trip, route, x, y, speed, t) with stop: the nearest stop (id, x, y) of their route within RADIUS_M at which they stand, null elsewhere.

    lines (route, stop) says which stops a route serves; its stops are few, so a report meets those in its cell of RADIUS_M and the eight around it."""
    cell = lambda c: F.floor(F.col(c) / RADIUS_M)
    step = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(c) + d))
    places = stops.join(lines, stops["id"] == lines["stop"]).select("route", "stop", F.col("x").alias("sx"), F.col("y").alias("sy"), step("x").alias("_cx"), "y")
    places = places.select("route", "stop", "sx", "sy", "_cx", step("y").alias("_cy")).distinct()
    far = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    stands = F.coalesce(F.col("speed") <= STANDS, F.lit(True))
    slow = reports.where(stands).withColumns({"_cx": cell("x"), "_cy": cell("y")})
    near = slow.join(places, ["route", "_cx", "_cy"]).withColumn("far", far).where(F.col("far") <= RADIUS_M)
    best = near.groupBy("event_id").agg(F.min_by("stop", F.struct("far", "stop")).alias("stop"))
    return reports.join(best, "event_id", "left")


#: A new vehicle counts on a route after so many seconds and reports there; one without a report for LEFT_S has left it.
ADD_S, ADD_REPORTS, LEFT_S = 300, 3, 600


class Fleet:
    """The vehicles of one route: when each was first and last seen there, how often, and whether it counts.

    Seconds are taken in order. A vehicle is due to leave LEFT_S after its last report; what is due by a second is settled before that second's reports. Vehicles are held in order of
    their last report and those that count are counted, so a second costs as much as it has reports and leaves, however many vehicles run. Changes are rows (kind, veh, t, before, after): t is the last report of one that left, the first of one that came."""

    def __init__(self, held: dict[int, list] | None = None, now: int | None = None, since: int | None = None) -> None:
        self.held = dict(sorted((held or {}).items(), key=lambda x: (x[1][1], x[0])))
        self.now, self.since = now, since
        self.members = sum(x[3] for x in self.held.values())
        self.out: list[tuple[str, int, int, int, int]] = []

    def settle(self, until: int) -> None:
        """All that is due by a time. Vehicles due at one second are no longer seen by each other."""
        while self.held:
            last = next(iter(self.held.values()))[1]
            if last + LEFT_S > until:
                return
            due = []
            for veh, x in self.held.items():
                if x[1] != last:
                    break
                due.append((veh, x[3]))
            for veh, _ in due:
                del self.held[veh]
            self.members -= sum(member for _, member in due)
            if self.members:
                self.out += [("drop", veh, last, self.members + 1, self.members) for veh, member in sorted(due) if member]

    def report(self, at: int, vehicles: list[int]) -> None:
        """The reports of one second."""
        if self.now is not None and at < self.now:
            return
        self.settle(at)
        self.now = at
        for veh in sorted(vehicles):
            first, _, n, member = self.held.pop(veh, (at, at, 0, False))
            self.held[veh] = [first, at, n + 1, member]
        for veh in sorted(set(vehicles)):
            first, last, n, member = self.held[veh]
            if not member and last - first >= ADD_S and n >= ADD_REPORTS:
                many = self.members
                self.held[veh][3] = True
                self.members += 1
                if many and (self.since is None or first >= self.since + ADD_S):
                    self.out.append(("add", veh, first, many, many + 1))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, now, since = None, None, None
    if state.exists:
        vehicles, first, last, n, member, now, since = state.get
        held = {v: list(x) for v, *x in zip(vehicles, first, last, n, member, strict=True)}
    fleet = Fleet(held, now, since)
    if state.hasTimedOut:
        fleet.settle(state.getCurrentWatermarkMs() // 1000 - 1)
    else:
        rows = pd.concat(batches)
        rows = rows.sort_values(["t", "veh"])
        for at, group in groupby(zip(rows["t"].tolist(), rows["veh"].tolist(), strict=True), key=lambda r: r[0]):
            if fleet.since is None:
                fleet.since = at
            fleet.report(at, [veh for _, veh in group])
    if fleet.held:
        columns = list(zip(*((v, *x) for v, x in sorted(fleet.held.items())), strict=True))
        state.update((*[list(c) for c in columns], fleet.now, fleet.since))
        due = (min(x[1] for x in fleet.held.values()) + LEFT_S + 1) * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.update(([], [], [], [], [], fleet.now, fleet.since))
    yield pd.DataFrame([(key[0], *x) for x in fleet.out], columns=["route", "kind", "veh", "t", "before", "after"])


def fleet_changes(reports: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Stream of (route, kind, veh, t, before, after): vehicles that come to a route or leave it while others run there; reports have route, veh and t.

    Vehicles seen in the first ADD_S seconds of a route's stream count as already there. A leave is known when the route's own later reports, or the stream's
    clock (a watermark), have passed it; a route that falls silent as a whole has no leaves. The state is a route's vehicles of the last LEFT_S seconds."""
    timed = reports.where("veh IS NOT NULL AND t IS NOT NULL").select("route", "veh", "t", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    state = "vehicles array<long>, first array<long>, last array<long>, n array<long>, member array<boolean>, now long, since long"
    return timed.groupBy("route").applyInPandasWithState(_changes, "route string, kind string, veh long, t long, before long, after long", state, "append", GroupStateTimeout.EventTimeTimeout)


#: Shown forecasts that a key's state holds at most, and how old (event time, seconds) they may grow; a forecast still shown so long after its poll counts.
RING, RING_S, GRACE_S = 400, 7200, 90


def _displays(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For each question the newest forecast seen by then, if it was still shown GRACE_S before; the state is a ring of the newest ones."""
    names = ["veh", "event_id", "t", "seen", "last"]
    rows = pd.concat(batches).sort_values(["t", "asks", "event_id"])
    ring = list(zip(*state.get, strict=True)) if state.exists else []
    newest = ring[-1][0] if ring else None
    out = []
    for event, t, asks, last in zip(rows.event_id.tolist(), rows.t.tolist(), rows.asks.tolist(), rows["last"].tolist(), strict=True):
        newest = t if newest is None else max(newest, t)
        if not asks:
            ring.append((t, event, int(last)))
            if len(ring) > 1 and ring[-2][:2] > ring[-1][:2]:  # a late one takes its place in the order
                ring.sort()
            continue
        shown = next((r for r in reversed(ring) if r[0] <= t), None)
        alive = shown is not None and shown[2] >= t - GRACE_S
        out.append((key[0], event, t, shown[0] if alive else None, shown[2] if alive else None))
    # The newest one never grows old: whether it counts is tested when it is asked for.
    ring = [r for r in ring[:-1] if r[0] >= newest - RING_S][-RING + 1 :] + ring[-1:] if newest is not None else ring
    if ring:
        state.update(tuple(list(c) for c in zip(*ring, strict=True)))
    yield pd.DataFrame(out, columns=names).astype({"seen": "Int64", "last": "Int64"})


def displays(rows: DataFrame) -> DataFrame:
    """Stream of (veh, event_id, t, seen, last): for each question the newest forecast of its vehicle that was on display.

    rows is one stream of both: forecasts (asks false; seen at t, shown until last) and questions (asks true). A key's state holds RING forecasts at
    most. Questions that come after later ones are answered as of their own time, as far as the ring reaches back."""
    kept = rows.select("veh", "event_id", "t", "asks", F.coalesce(F.col("last").cast("long"), F.lit(0)).alias("last"))
    return kept.groupBy("veh").applyInPandasWithState(
        _displays, "veh long, event_id long, t long, seen long, last long", "seen array<long>, ids array<long>, last array<long>", "append", GroupStateTimeout.NoTimeout
    )


def hourly_counts(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of counts by stop and hour of event time, closed by a watermark; `ts` is a timestamp."""
    return reports.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "stop").agg(F.count("*").alias("n"))


def versions_seen(spark: SparkSession, reports: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """alert, version, first_seen, last_seen and polls of all reports (alert, version, t) that the stream has now.

    Each batch leaves its own small table of partial results under its number, so a batch that is run again replaces what it wrote;
    a run under the same name goes on where the last one was."""
    path = f"{folder.rstrip('/')}/tramline-versions-{name or uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("alert", "version").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("polls"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    kinds = {f.name: f.dataType.simpleString() for f in reports.schema.fields}
    schema = f"alert {kinds['alert']}, version {kinds['version']}, first_seen {kinds['t']}, last_seen {kinds['t']}, polls long"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=none")
    query = reports.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema(schema).parquet(f"{path}/batch=*")
    return parts.groupBy("alert", "version").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("polls").alias("polls"))


def replay(spark: SparkSession, stream: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """Run a stream over what its source has now, into a table in `folder` (a new one, or that of a name), and read that table.

    The checkpoint lies beside it, so a run that is interrupted or called again goes on where it was."""
    path = f"{folder.rstrip('/')}/tramline-stream-{name or uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
