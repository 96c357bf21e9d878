"""Document fingerprints by consistent weighted sampling (gamma-based).

A text's terms are its words, a term's weight the number of its occurrences. For a term k of weight w and one
of SAMPLES hashings, r and c are Gamma(2, 1) and b uniform on (0, 1), all drawn from the hash of k alone; with
t = floor(ln w / r + b) the term's value is ln a = ln c - r (t - b) - r. The pair (k, t) of the least value is
that hashing's sample, and two texts agree on it with the probability of their generalised Jaccard similarity,
sum(min weights) / sum(max weights). A fingerprint prints 16 bits of every sample, as four hexadecimal digits;
the likeness of two texts is the share of places at which their fingerprints agree, so it is a function of what is
printed: an estimate without bias but for 2^-16, with a standard error of at most 0.5 / sqrt(SAMPLES). Texts without
words have an empty fingerprint, likeness 1 with each other and 0 with all others.

Gamma draws are quantiles at LEVELS levels of equal probability. Words are exploded and counted for a text and its edited
form together, so that a term's draws serve both; the least values are plain aggregates. All steps run on rows, in compiled code, and as texts lie by bucket,
none of them shuffles words.

The next document is found without a global sort: ids are cut at quantiles, cuts evenly into buckets; a
bucket's window sees its own rows and a copy of the first row of the bucket after it. Texts are shuffled once.

Defined cases: null counts as empty; rows without an id come first; repeated ids are ordered by their texts;
the only document is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import GAP, stored, table

#: Independent hashings, how many of them a row is sampled for at once, and levels of the gamma draws.
SAMPLES, AT_ONCE, LEVELS = 64, 2, 4096
#: Documents in a bucket, about; quantiles of the ids at most; buckets whose first ids may be broadcast.
BUCKET, CUTS, BROADCAST_BUCKETS = 500, 64, 500_000
_DOC = ("_bucket", "_n")


def _gamma_quantiles() -> list[float]:
    """Gamma(2, 1) quantiles at the middles of LEVELS parts of equal probability, by bisection of 1 - (1 + x) / e^x."""

    def quantile(p: float) -> float:
        low, high = 0.0, 64.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if 1 - (1 + middle) * math.exp(-middle) < p else (low, middle)
        return low

    return [quantile((k + 0.5) / LEVELS) for k in range(LEVELS)]


def _listed(values: list[float], level: Column) -> Column:
    """The value at a level, from an array that is a constant of the plan."""
    return F.get(F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>"), level.cast("int"))


def _drawn(terms: DataFrame) -> DataFrame:
    """terms (k, w, v and others) with AT_ONCE packed samples of weight w (x0, x1, ...) and of weight v (y0, y1, ...), for every group g of hashings.

    A sample is one long: the value in the upper 47 bits, then 16 bits that tell (k, t); the least long is the sample."""
    rows = terms.withColumns({"lw": F.log(F.col("w").cast("double")), "lv": F.log(F.col("v").cast("double"))})
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // AT_ONCE - 1))))
    each = range(AT_ONCE)
    rows = rows.withColumns({f"h{j}": F.xxhash64("k", F.col("g") * AT_ONCE + j) for j in each})
    gammas = _gamma_quantiles()
    drawn: dict[str, Column] = {}
    for j in each:
        h = F.col(f"h{j}")
        drawn |= {
            f"r{j}": _listed(gammas, h.bitwiseAND(F.lit(LEVELS - 1))),
            f"c{j}": _listed([math.log(x) for x in gammas], F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(LEVELS - 1))),
            f"b{j}": (F.shiftrightunsigned(h, 24).bitwiseAND(F.lit((1 << 24) - 1)) + F.lit(0.5)) / F.lit(float(1 << 24)),
        }
    rows = rows.select("*", *[x.alias(name) for name, x in drawn.items()])
    rows = rows.withColumns({f"{t}{j}": F.floor(F.col(lw) / F.col(f"r{j}") + F.col(f"b{j}")) for t, lw in (("s", "lw"), ("t", "lv")) for j in each})

    def packed(j: int, t: str) -> Column:
        value = F.col(f"c{j}") - F.col(f"r{j}") * (F.col(t) - F.col(f"b{j}") + 1)
        name = (F.shiftrightunsigned(f"h{j}", 48) + F.col(t) * 40503).bitwiseAND(F.lit(65535))
        return F.shiftleft(F.floor((value + 64) * float(1 << 40)), 16).bitwiseOR(name)

    return rows.select(*terms.columns, "g", *[packed(j, f"s{j}").alias(f"x{j}") for j in each], *[packed(j, f"t{j}").alias(f"y{j}") for j in each])


def signatures(texts: DataFrame, keys: tuple[str, ...] = _DOC) -> DataFrame:
    """keys, own and other (fingerprints of the columns `text` and `edited`) of each row with a word; keys name a row."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("own"), "text"), F.struct(F.lit(0).alias("own"), F.col("edited").alias("text"))))
    words = texts.select(*keys, sides.alias("s")).select(*keys, "s.own", F.explode(F.split("s.text", GAP)).alias("word")).where("word <> ''")
    terms = words.groupBy(*keys, F.xxhash64("word").alias("k")).agg(F.sum("own").alias("w"), (F.count("*") - F.sum("own")).alias("v"))
    # A weight of 0 has no logarithm: its samples are null, and no least value.
    least = _drawn(terms).groupBy(*keys, "g").agg(*[F.min(f"{side}{j}").alias(f"{side}{j}") for side in "xy" for j in range(AT_ONCE)])
    digits = {side: F.concat(*[F.lpad(F.hex(F.col(f"{side}{j}").bitwiseAND(F.lit(65535))), 4, "0") for j in range(AT_ONCE)]) for side in "xy"}
    parts = least.select(*keys, F.struct("g", F.lower(digits["x"]).alias("x"), F.lower(digits["y"]).alias("y")).alias("p"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(*keys, F.array_join("p.x", "").alias("own"), F.array_join("p.y", "").alias("other"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the places (four digits each) at which two fingerprints agree."""
    same = [F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(SAMPLES)]
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(sum(same, F.lit(0)) / SAMPLES)


def with_next(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (_bucket, _last, _key, doc_id, text): documents in buckets of consecutive ids; where _last, the
    row is a copy of the document that follows the bucket's own."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_key"))
    ids = rows.select("_key")
    cuts = [k / CUTS for k in range(CUTS)]
    seen = ids.agg(F.count("*").alias("n"), F.percentile_approx("_key", cuts, 4 * CUTS).alias("q"), F.max("_key").alias("top")).first()
    low = sorted(set(seen.q or [0]))
    high = [*low[1:], (seen.top or 0) + 1]
    parts = max(1, -(-seen.n // (len(low) * bucket)))
    # A sum and no lambda: plans with lambdas never count as equal, so the texts' shuffle would not be reused.
    cut = sum(((F.col("_key") >= x).cast("int") for x in low[1:]), F.lit(0))  # keys below the first quantile belong to it

    def at(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("_cut"))

    # Large ids that differ may be equal as doubles, so a width may come out as 0.
    width = F.greatest(F.lit(1.0), (at(high).cast("double") - at(low)) / parts)
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("_key").cast("double") - at(low)) / width)))
    dealt = lambda df: df.withColumn("_cut", cut).withColumn("_bucket", F.col("_cut").cast("long") * parts + inside)
    first = stored(dealt(ids).groupBy("_cut", "_bucket").agg(F.min("_key").alias("_key")), "firsts")
    ends = first.groupBy("_cut").agg(F.max("_bucket").alias("end"))
    before = F.coalesce(F.lag("end").over(Window.orderBy("_cut")), F.max("end").over(Window.partitionBy()))
    ends = ends.select("_cut", before.alias("end"))
    inner = F.lag("_bucket").over(Window.partitionBy("_cut").orderBy("_bucket"))
    copies = stored(first.join(ends, "_cut").select(F.coalesce(inner, "end").alias("_bucket"), "_key"), "copies")
    copies = F.broadcast(copies) if seen.n // bucket < BROADCAST_BUCKETS else copies
    own = dealt(rows).select("_bucket", F.lit(False).alias("_last"), "_key", "doc_id", "text")
    follow = rows.join(copies, "_key").select("_bucket", F.lit(True).alias("_last"), "_key", "doc_id", "text")
    # No bucket is null; said here, as else only one side of a later join would filter for it, and the shuffle would not be reused.
    return own.unionByName(follow).where("_bucket IS NOT NULL")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses; see the module."""
    order = Window.partitionBy("_bucket").orderBy("_last", "_key", "text", "doc_id")
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    rows = with_next(docs).withColumns({"_next": F.lead("text").over(order), "_n": F.row_number().over(order)})
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), part))
    rows = rows.select("_bucket", "_n", "_last", "doc_id", "text", edited.alias("edited"))
    named = rows.select(*_DOC, "_last", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = named.join(signatures(rows), list(_DOC), "left").fillna("", ["own", "other"])
    following = F.lead("own").over(Window.partitionBy("_bucket").orderBy("_n"))
    return both.withColumn("next_own", following).where("NOT _last").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("own").alias("fingerprint"),
        F.col("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
