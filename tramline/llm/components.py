"""Connected components of a link table, by rounds of contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import forget, gathered, stored

#: Ids whose parents may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_PARENTS = 500_000


def _looked_up(parents: DataFrame, n: int, column: str, to: str) -> DataFrame:
    """parents (id, component) as (column, to), for an equi join."""
    out = parents.select(F.col("id").alias(column), F.col("component").alias(to))
    return F.broadcast(out) if n <= BROADCAST_PARENTS else out


def _roots(parents: DataFrame, n: int) -> DataFrame:
    """parents with every id's root in place of its parent, by pointer jumping."""
    while True:
        jumped = parents.join(_looked_up(parents, n, "component", "next"), "component")
        moved = jumped.select("id", F.col("next").alias("component"), (F.col("next") < F.col("component")).alias("moved"))
        moved = stored(gathered(moved, n), "parents")
        forget(parents)
        parents = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b); only ids that have a link.

    In a round every id takes its least neighbour (or itself) as parent, the trees are flattened, and links
    are carried over to the roots; those within a tree go, so a round leaves half of the ids at most. A hub with
    very many links is pre-aggregated before its shuffle. The rounds' tables are then looked up from the last
    to the first. `links` is read several times, so it should be a stored table. Null ends and links of an id to itself say nothing and are ignored.
    """
    edges, own = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), False
    rounds: list[tuple[DataFrame, int]] = []
    while m := edges.count():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("p")), F.struct(F.col("b").alias("id"), F.col("a").alias("p")))).alias("e"))
        parents = stored(gathered(ends.groupBy("e.id").agg(F.min("e.p").alias("component")), 2 * m), "parents")
        n = parents.count()
        parents = _roots(parents, n)
        rounds.append((parents, n))
        moved = edges.join(_looked_up(parents, n, "a", "x"), "a").join(_looked_up(parents, n, "b", "y"), "b").where("x <> y")
        left = stored(gathered(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), m), "links")
        if own:
            forget(edges)
        edges, own = left, True
    if own:
        forget(edges)
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    found, n = rounds[-1]
    for parents, more in reversed(rounds[:-1]):
        joined = parents.join(_looked_up(found, n, "component", "root"), "component", "left")
        both = stored(gathered(joined.select("id", F.coalesce("root", "component").alias("component")), more), "labels")
        forget(found)
        forget(parents)
        found, n = both, more
    return found
