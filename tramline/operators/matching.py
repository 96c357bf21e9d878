"""Matches between rows and clocks of vehicles: one-to-one pairs in time, forecasts of another trip, vehicles side by side,
idle clocks, held lists and places mapped twice.

Range and place tests meet on bins by equi joins, tracks side by side in groups of tracks. What depends on earlier choices is an ordered fold whose state is bounded by a
window of time or, for places, by the places of one name."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tramline.operators import beside
from tramline.operators.joins import near
from tramline.operators.lineage import written
from tramline.operators.tracks import folded

# Seconds a forecast stays listed after its time, least seconds to the visit before, most seconds to the arrival.
LISTED_PAST_S, VISIT_GAP_S, ARRIVAL_S = 30, 120, 3600
# Bins (seconds, least number, most missing between two) and metres of vehicles side by side.
SIDE_BIN_S, SIDE_BINS, SIDE_SKIP, SIDE_M = 30, 6, 1, 25.0
# Bins of a chunk of tracks (a day), tracks of a group, most groups of a route's chunk, and tasks that compare groups.
SIDE_CHUNK, SIDE_GROUP, SIDE_GROUPS, SIDE_TASKS = 2880, 1024, 32, 256
# Seconds of a lingering, idle and parked vehicle, and of a gap that ends its clock.
LINGER_S, IDLE_S, PARKED_S, CLOCK_GAP_S = 180, 1800, 5400, 600
# Seconds that one empty answer is bridged, metres between two places of one name that are the same.
EMPTY_S, SAME_PLACE_M = 30, 150.0
# Metres and seconds of a vehicle off its route; seconds that a missing vehicle keeps its number.
OFF_FAR_M, OFF_FAR_S, OFF_FAST_M, OFF_NEAR_M, OFF_NEAR_S, OFF_DETOUR_M = 250.0, 45, 500.0, 120.0, 120, 3000.0
NUMBER_HOLD_S = 45
# Tiers of distance (km) and the cost of each, km a point and most km, most words beyond the query.
TIER_KM, TIER_COST, KM_A_POINT, KM_MOST, BEYOND_MOST = (3, 20, 80), 8, 5, 20, 3


def paired(left: DataFrame, right: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """by, left_id and right_id of pairs of equal key whose times lie `most` seconds apart at most; each row is in one pair at most.

    Both sides have t and id (whole numbers). Left rows choose in order of time, then id: the nearest right row not yet taken, of two
    as near the earlier, then that of the lesser id. Rows with a null key, time or id are in no pair. The fold holds the rows of a
    window of `most` seconds on either side, however many rows a key has."""

    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.select(*by, F.col("t").cast("long").alias("t"), F.lit(n).alias("side"), F.col("id").cast("long").alias("id")).dropna()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, free, out = None, deque(), deque(), []

        def settle(now: int | None) -> None:
            """Choose for the left rows that no later row can reach, and drop right rows out of reach."""
            while waiting and (now is None or waiting[0][0] + most < now):
                t, mine = waiting.popleft()
                while free and free[0][0] < t - most:
                    free.popleft()
                best = min(((abs(at - t), at, other) for at, other in free if at <= t + most), default=None)
                if best:
                    free.remove(best[1:])
                    out.append((*key, mine, best[2]))
            while free and not waiting and now is not None and free[0][0] < now - most:
                free.popleft()

        for batch in batches:
            for k, t, n, i in zip(zip(*[batch[c] for c in by], strict=True), batch["t"], batch["side"], batch["id"], strict=True):
                if k != key:
                    settle(None)
                    free.clear()
                    key = k
                settle(t)
                (free if n else waiting).append((t, i))
            yield pd.DataFrame(out, columns=[*by, "left_id", "right_id"])
            out.clear()
        settle(None)
        yield pd.DataFrame(out, columns=[*by, "left_id", "right_id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*by).schema.fields)
    rows = side(left, 0).unionByName(side(right, 1)).repartition(*by).sortWithinPartitions(*by, "t", "id")
    return rows.mapInPandas(run, f"{kinds}, left_id long, right_id long")


def other_trip(asked: DataFrame, shown: DataFrame, block: int = 600) -> DataFrame:
    """id and pred: the earliest time that a vehicle's other trips show for a stop, where such a trip is about the run it is on.

    asked: id, veh, trip, stop, arrival, t and visit (the vehicle's visit to the stop before, or null). shown: veh, trip, stop, seq, seen,
    until and pred, on display where seen <= t < until. A forecast counts unless it is listed no more, ARRIVAL_S or more from the arrival, or from
    before the last visit; and unless its trip shows its first stop (not begun) or a later stop at an earlier time (already past)."""
    bins = shown.withColumn("bin", F.explode(F.sequence(F.floor(F.col("seen") / block), F.floor((F.col("until") - 1) / block)))).where("until > seen")
    on = (F.col("t") >= F.col("seen")) & (F.col("t") < F.col("until"))
    after = F.col("visit").isNull() | ((F.col("seen") > F.col("visit")) & (F.col("pred") >= F.col("visit") + VISIT_GAP_S))
    rows = asked.withColumn("bin", F.floor(F.col("t") / block)).withColumnRenamed("trip", "own")
    found = rows.join(bins, ["veh", "stop", "bin"]).where(on & (F.col("trip") != F.col("own")) & after)
    found = found.where((F.col("pred") >= F.col("t") - LISTED_PAST_S) & (F.abs(F.col("pred") - F.col("arrival")) < ARRIVAL_S))
    found = found.select("id", "veh", "trip", "bin", "t", "seq", "pred")
    other = bins.select("veh", "trip", "bin", "seen", "until", F.col("seq").alias("seq2"), F.col("pred").alias("pred2"))
    against = on & ((F.col("seq2") == 1) | ((F.col("seq2") > F.col("seq")) & (F.col("pred2") < F.col("pred"))))
    ruled = found.join(other, ["veh", "trip", "bin"]).where(against).select("id", "trip", "seq", "pred").distinct()
    return found.join(ruled, ["id", "trip", "seq", "pred"], "left_anti").groupBy("id").agg(F.min("pred").alias("pred"))


def side_by_side(rows: DataFrame, metres: float = SIDE_M, width: int = SIDE_CHUNK) -> DataFrame:
    """veh, other, a, b and bins of two moving vehicles of one route within `metres`: SIDE_BINS bins of time, no more than SIDE_SKIP missing between two.

    rows have veh, route, id, t, x, y (metres) and moving; a vehicle's first report stands for a bin. The tracks of a route are cut into chunks of `width` bins and
    dealt to at most SIDE_GROUPS groups, and a task compares two groups: what is shuffled are tracks and never the pairs of a bin. A chunk also sees the bins
    around it by which a run could have SIDE_BINS; only runs that cross its border are put together afterwards."""
    reach = (SIDE_BINS - 1) * (1 + SIDE_SKIP)
    if width <= 2 * reach:
        raise ValueError(f"width is more than {2 * reach} bins, not {width}")
    first = rows.groupBy("veh", F.floor(F.col("t") / SIDE_BIN_S).alias("bin")).agg(F.min_by(F.struct("route", "x", "y", "moving"), F.struct("t", "id")).alias("r"))
    first = first.select("veh", "bin", "r.*").where("moving").dropna(subset=["veh", "bin", "route", "x", "y"])
    chunks = F.array_distinct(F.array(F.floor((F.col("bin") - reach) / width), F.floor((F.col("bin") + reach) / width)))
    tracks = first.withColumn("chunk", F.explode(chunks)).groupBy("veh", "chunk").agg(F.collect_list(F.struct("bin", "x", "y", "route")).alias("r"))
    tracks = tracks.select("veh", "chunk", F.col("r.bin").alias("bins"), F.col("r.x").cast("array<double>").alias("xs"), F.col("r.y").cast("array<double>").alias("ys"), F.col("r.route").alias("routes"))
    low, high = F.col("chunk") * width, (F.col("chunk") + 1) * width
    tracks = tracks.withColumns({
        "_all": F.array_distinct("routes"),
        "border": F.exists("bins", lambda b: ((b < low) & (b >= low - 1 - SIDE_SKIP)) | ((b >= high) & (b <= high + SIDE_SKIP))),
    })
    tracks = tracks.withColumn("routes", F.when(F.size("_all") > 1, F.col("routes"))).withColumn("route", F.explode("_all")).drop("_all")
    tracks = written(tracks)

    def runs(of: DataFrame, beyond: bool) -> DataFrame:
        groups = of.groupBy("route", "chunk").agg(F.least(F.lit(SIDE_GROUPS), F.ceil(F.count("*") / SIDE_GROUP)).alias("groups"))
        dealt = of.join(groups, ["route", "chunk"]).withColumn("g", F.pmod(F.xxhash64("veh"), "groups")).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        dealt = dealt.select("route", "chunk", F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"), "g", "veh", "bins", "xs", "ys", "routes")
        id_ = rows.schema["veh"].dataType
        schema = T.StructType([T.StructField("veh", id_), T.StructField("other", id_), *[T.StructField(n, T.LongType()) for n in ("a", "b", "bins")]])
        # The work of two groups grows with their product, so tasks are not dealt by bytes.
        by = ["route", "chunk", "p", "q"]
        found = dealt.repartition(SIDE_TASKS, *by).groupBy(*by)
        return found.applyInArrow(beside.runs_of_groups(metres, SIDE_BINS, SIDE_SKIP, width, beyond, to_arrow_schema(schema)), schema)

    # A run that goes on beyond a chunk has a hit next to the border; vehicles that have none there are not looked at again.
    parts = runs(tracks.where("border"), True)
    order = Window.partitionBy("veh", "other").orderBy("a")
    new = F.when(F.col("a") - F.lag("b").over(order) <= 1 + SIDE_SKIP, 0).otherwise(1)
    joined = parts.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    joined = joined.groupBy("veh", "other", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("bins").alias("bins")).drop("run")
    per = runs(tracks, False).unionByName(joined)
    return per.select("veh", "other", (F.col("a") * SIDE_BIN_S).alias("a"), ((F.col("b") + 1) * SIDE_BIN_S).alias("b"), "bins")


def still_since(rows: DataFrame, radius: float, distance: Callable[[tuple, tuple], float], place: Sequence[str]) -> DataFrame:
    """rows (id, veh, route, t and a place) with since: when the vehicle's clock began.

    A clock runs on while the route is the same, no gap is over CLOCK_GAP_S and the vehicle is within `radius` of where the clock began."""

    def step(clock: tuple | None, values: tuple) -> tuple:
        t, route, *here = values
        if clock is None or clock[1] != route or t - clock[2] > CLOCK_GAP_S or distance(clock[3], here) > radius:
            clock = (t, route, t, here)
        clock = (clock[0], route, t, clock[3])
        return clock, (clock[0],)

    return folded(rows, ["veh"], ["t", "id"], lambda: None, step, "since long", ["t", "route", *place])


def hidden_reason(still: Column, ahead: Column, past: Column, spot: Column) -> Column:
    """Why a vehicle is hidden: parked, idle (nothing forecast ahead), past (out of its listed hours) or linger (at a known spot); else null."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(still < LINGER_S, None).when(still >= PARKED_S, "parked").when((still >= IDLE_S) & ~no(ahead), "idle").when(no(past), "past").when(no(spot), "linger")


def lists_held(polls: DataFrame, by: Sequence[str]) -> DataFrame:
    """polls (t, n entries) with shown_t: the poll whose list is on show, null if none is.

    An empty answer keeps the list of the poll before if that has entries and is EMPTY_S old at most; a second one does not."""
    order = Window.partitionBy(*by).orderBy("t")
    held = (F.lag("n").over(order) > 0) & (F.col("t") - F.lag("t").over(order) <= EMPTY_S)
    return polls.withColumn("shown_t", F.when(F.col("n") > 0, F.col("t")).when(held, F.lag("t").over(order)))


def places_merged(places: DataFrame, distance: Callable[[tuple, tuple], float], metres: float = SAME_PLACE_M) -> DataFrame:
    """places (id, name, rank, y, x) with kept_id: the place that stands for each, itself or one of the same name under `metres` away.

    Names are compared in lower case, places taken by rank, then id; the first kept place that is near enough stands for a place. The fold
    holds the kept places of one name."""

    def step(kept: list, values: tuple) -> tuple:
        id_, *here = values
        stands = next((k for k, there in kept if distance(there, here) < metres), None)
        if stands is None:
            kept.append((id_, here))
        return kept, (id_ if stands is None else stands,)

    rows = places.withColumn("key", F.lower(F.trim("name")))
    return folded(rows, ["key"], ["rank", "id"], list, step, "kept_id long", ["id", "y", "x"]).drop("key")


def off_route(rows: DataFrame) -> DataFrame:
    """rows (id, veh, route, t, off metres, corridor, detour) with hidden: whether the vehicle counts as off its route.

    A clock runs over linked reports (same route, gap of CLOCK_GAP_S at most) that are farther than a limit. A vehicle is hidden by two reports
    over OFF_FAR_M for OFF_FAR_S seconds, by two over OFF_FAST_M, or, where the corridor is known, by two over OFF_NEAR_M for OFF_NEAR_S;
    never under an official detour within OFF_DETOUR_M. Of several reports of a vehicle at one time that of the least id counts, the others get its answer."""
    order = Window.partitionBy("veh").orderBy("t")
    one = rows.groupBy("veh", "t").agg(F.min_by(F.struct("route", "off", "corridor", "detour"), "id").alias("r")).select("veh", "t", "r.*")
    linked = (F.lag("route").over(order) == F.col("route")) & (F.col("t") - F.lag("t").over(order) <= CLOCK_GAP_S)
    one = one.withColumn("linked", F.coalesce(linked, F.lit(False)))
    for name, limit in (("far", F.lit(OFF_FAR_M)), ("fast", F.lit(OFF_FAST_M)), ("near", F.lit(OFF_NEAR_M))):
        over = F.coalesce(F.col("off") > limit, F.lit(False))
        on = over & F.col("linked") & F.lag(over, 1, False).over(order)
        one = one.withColumn(f"{name}_run", F.sum(F.when(on, 0).otherwise(1)).over(order)).withColumn(f"{name}_over", over)
        run = Window.partitionBy("veh", f"{name}_run").orderBy("t")
        one = one.withColumns({f"{name}_n": F.row_number().over(run), f"{name}_s": F.col("t") - F.first("t").over(run)})
    far = F.col("far_over") & (F.col("far_n") >= 2) & (F.col("far_s") >= OFF_FAR_S)
    near = F.col("corridor") & F.col("near_over") & (F.col("near_n") >= 2) & (F.col("near_s") >= OFF_NEAR_S)
    detour = F.col("detour") & (F.col("off") <= OFF_DETOUR_M)
    hidden = (far | (F.col("fast_over") & (F.col("fast_n") >= 2)) | F.coalesce(near, F.lit(False))) & ~F.coalesce(detour, F.lit(False))
    return rows.join(one.select("veh", "t", hidden.alias("hidden")), ["veh", "t"])


def held_numbers(sightings: DataFrame, hold: int = NUMBER_HOLD_S) -> DataFrame:
    """feed, t, route, veh and number, from 1 by vehicle within a route and poll; sightings are feed, t, veh and route.

    A vehicle that a poll lacks keeps its place on its route until `hold` seconds after the first poll without it. Polls that show nobody are not
    in the table and number nobody. Polls meet the places held by an equi join on spans of `hold` seconds."""
    seen = sightings.groupBy("feed", "t", "veh").agg(F.min("route").alias("route"))
    polls = seen.select("feed", "t").distinct().withColumn("next", F.lead("t").over(Window.partitionBy("feed").orderBy("t")))
    again = F.lead("t").over(Window.partitionBy("feed", "veh").orderBy("t"))
    gone = seen.withColumn("again", again).join(polls, ["feed", "t"]).where("next IS NOT NULL AND (again IS NULL OR again > next)")
    held = gone.select("feed", "veh", "route", F.col("next").alias("gone"), "again")
    held = held.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gone") / hold), F.floor((F.col("gone") + hold) / hold))))
    binned = polls.select("feed", "t", F.floor(F.col("t") / hold).alias("bin"))
    kept = binned.join(held, ["feed", "bin"]).where((F.col("t") >= F.col("gone")) & (F.col("t") <= F.col("gone") + hold) & (F.col("again").isNull() | (F.col("t") < F.col("again"))))
    both = seen.select("feed", "t", "route", "veh").unionByName(kept.select("feed", "t", "route", "veh"))
    return both.withColumn("number", F.row_number().over(Window.partitionBy("feed", "t", "route").orderBy("veh")).cast("long"))


def closest_rows(rows: DataFrame, by: Sequence[str], gap: int) -> DataFrame:
    """by, id, t and away of the nearest report of each visit: a key's reports chained over at most `gap` seconds; of two as near the earlier."""
    order = Window.partitionBy(*by).orderBy("t", "id")
    new = F.when(F.col("t") - F.lag("t").over(order) <= gap, 0).otherwise(1)
    visits = rows.withColumn("new", new).withColumn("visit", F.sum("new").over(order))
    best = visits.groupBy(*by, "visit").agg(F.min_by(F.struct("id", "t", "away"), F.struct("away", "t", "id")).alias("r"))
    return best.select(*by, "r.*")


def place_score(i: Column, name: Column, kind: Column, km: Column, settlement: Column, query: Sequence[str]) -> Column:
    """The score of a found place, the lower the better: its place i in the answer, tiers of distance, words beyond the query, a bonus or malus by kind
    (major or minor). A settlement of exactly the queried name goes to the top."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    beyond = F.size(F.filter(words, lambda w: ~F.exists(F.array(*map(F.lit, query)), lambda q: F.startswith(w, q))))
    tier = sum((F.when(km > limit, 1).otherwise(0) for limit in TIER_KM), F.lit(0))
    score = i + TIER_COST * tier + F.least(km, F.lit(KM_MOST)) / KM_A_POINT + F.least(beyond, F.lit(BEYOND_MOST))
    score = score + F.when(kind == "major", -2).when(kind == "minor", 3).otherwise(0)
    return F.when(settlement & (F.array_join(words, " ") == " ".join(query)), -100.0).otherwise(score)


def replay_applied(live: DataFrame, again: DataFrame, disproved: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """id, t, by and source of live rows and those a replay adds. A live row goes only if its id is disproved and no replayed row of its key lies within
    `most` seconds; a replayed row is added only where no live row that stays does. Ids are unique on each side."""
    kept = near(live, again, by, "t", most, most, "semi", id_="id").select("id").unionByName(live.join(disproved, "id", "left_anti").select("id")).distinct()
    stays = live.join(kept, "id", "left_semi")
    added = near(again, stays, by, "t", most, most, "anti", id_="id")
    cols = ["id", "t", *by]
    return stays.select(*cols, F.lit("live").alias("source")).unionByName(added.select(*cols, F.lit("replay").alias("source")))
