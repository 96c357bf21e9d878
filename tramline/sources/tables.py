"""Reading tables, with times as whole seconds; and the file sources and sinks of the collector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the collector's files, by name and in order as in their headers.
ARRIVALS = (
    "epoch LONG, ts_utc STRING, local_time STRING, dow INT, hour INT, minute_of_day INT, route_id STRING, route_name STRING, trip_id STRING, "
    "vehicle_id STRING, stop_id STRING, stop_name STRING, stop_address STRING, stop_lat DOUBLE, stop_lon DOUBLE, stop_index INT, prev_stop_id STRING, "
    "dist_prev_m DOUBLE, prev_arrival_epoch LONG, segment_s LONG, speed_mps DOUBLE, dwell_s INT, passio_pred_epoch LONG, passio_pred_lead_s LONG, source STRING"
)
PREDICTIONS = (
    "epoch LONG, local_time STRING, route_id STRING, route_name STRING, trip_id STRING, vehicle_id STRING, stop_id STRING, stop_name STRING, stop_index INT, "
    "lead_target_s INT, pred_epoch LONG, pred_made_epoch LONG, pred_lead_s INT, pred_minus_actual_s INT, pred_seen_epoch LONG"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, veh, stop, value, t (whole seconds), k: the event log in the roles of vehicles and stops."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("veh"),
        F.col("event_type").alias("stop"),
        "value",
        seconds(F.col("ts")).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def number(x: Column) -> Column:
    """A double from text; null where it is none, or not finite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def csv_rows(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the lines that are not (with their text); gzip is read by its extension.

    The header must have these columns' names in their order; an older, shorter header and rows padded with nulls are fine.
    Raises ValueError on any other header."""
    schema = T.StructType.fromDDL(columns)
    header = spark.read.text(path).first()
    names = header.value.lstrip("\ufeff").strip().split(",") if header else []
    if names != schema.names[: len(names)]:
        raise ValueError(f"header of {path} is {names}, expected {schema.names}")
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.option("columnPruning", "false").csv(path, schema=full, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    bad = F.col("_bad").isNotNull() & (F.size(F.split("_bad", ",")) > len(schema))
    key = F.col(schema.fields[0].name).isNull()
    return rows.where(~bad & ~key).drop("_bad"), rows.where(bad | key).select("_bad")


def checked_feed(lines: DataFrame, schema: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Feeds (column feed) of JSON lines (column value) that have the shape and pass the test (SQL over the feed's fields), and all other lines."""
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    parsed = lines.select("value", F.from_json("value", schema).alias("feed"))
    named = parsed.select("value", "feed", *[F.col(f"feed.{n}").alias(n) for n in fields]).withColumn("fine", F.coalesce(F.expr(test), F.lit(False)))
    return named.where("fine").select("feed"), named.where("NOT fine").select("value")


def rows_lost(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by and lost for the families whose number of rows (n) fell, or that are gone, between two snapshots."""
    now = after.select(*by, F.col("n").alias("now"))
    lost = F.col("n") - F.coalesce("now", F.lit(0))
    return before.join(now, by, "left").withColumn("lost", lost).where("lost > 0").select(*by, "lost")


def raw_polls(spark: SparkSession, path: str) -> DataFrame:
    """One row for each vehicle report of poll lines {t, h, v: [[veh, trip, route, lat, lon, bearing, speed, q, stop, status, vt]]};
    lines that are no JSON are skipped, repeated reports (veh, vt) count once, at their first poll."""
    lines = spark.read.schema("t LONG, h LONG, v ARRAY<ARRAY<STRING>>").json(path, mode="DROPMALFORMED")
    at = {"veh": 0, "trip": 1, "route": 2, "lat": 3, "lon": 4, "speed": 6, "stop": 8, "vt": 10}
    rows = lines.where("v IS NOT NULL").select("t", F.explode("v").alias("x"))
    rows = rows.select("t", *[F.get("x", F.lit(i)).alias(n) for n, i in at.items()])
    kinds = {"lat": "double", "lon": "double", "speed": "double", "vt": "long"}
    rows = rows.withColumns({n: F.col(n).try_cast(k) for n, k in kinds.items()}).where("vt IS NOT NULL")
    names = [c for c in rows.columns if c not in ("veh", "vt")]
    return rows.groupBy("veh", "vt").agg(F.min_by(F.struct(*names), "t").alias("r")).select("veh", "vt", "r.*")


def prediction_updates(spark: SparkSession, path: str) -> DataFrame:
    """[veh, trip, stop, made, predicted, seq, seen?, last?] lines: repeated sightings fold to the first seen and the last."""
    x = F.from_json("value", "ARRAY<STRING>")
    rows = spark.read.text(path).select(x.alias("x")).where("size(x) BETWEEN 6 AND 8")
    names = ("veh", "trip", "stop", "made", "predicted", "seq", "seen", "last")
    rows = rows.select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumns({n: F.col(n).try_cast("long") for n in names[3:]})
    rows = rows.withColumn("seen", F.coalesce("seen", "made")).withColumn("last", F.coalesce("last", "seen"))
    return rows.groupBy(*names[:6]).agg(F.min("seen").alias("seen"), F.max("last").alias("last"))


def overwrite_days(rows: DataFrame, path: str, day: str = "service_day") -> None:
    """Replace just the partitions of the days that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def content_id(value: Column, digits: int = 12) -> Column:
    """The first digits of the SHA-1 of a map's JSON, its keys in order, so that equal content has one id."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(value)))
    return F.substring(F.sha1(F.to_json(ordered)), 1, digits)
