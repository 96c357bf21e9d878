"""Every registered query of the transit side, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.plans import cut_queries, journey_queries, learned_queries, match_queries, track_queries
from tramline.plans.frames import FRAMES
from tramline.plans.more_statements import MORE
from tramline.plans.statements import STATEMENTS

STATEMENTS = STATEMENTS | MORE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {name: s.run for name, s in STATEMENTS.items()} | {name: q for name, (q, _) in FRAMES.items()} | track_queries.QUERIES | cut_queries.QUERIES | match_queries.QUERIES | learned_queries.QUERIES | journey_queries.QUERIES
ORACLES: dict[str, str] = {name: s.oracle() for name, s in STATEMENTS.items()} | {name: sql for name, (_, sql) in FRAMES.items() if sql} | track_queries.ORACLES | cut_queries.ORACLES | match_queries.ORACLES | learned_queries.ORACLES | journey_queries.ORACLES
