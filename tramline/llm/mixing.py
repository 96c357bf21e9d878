"""Mixing sources to target weights, in fixed-length blocks of words.

A source's documents, in a hashed order, are one stream of words, cut into blocks of BLOCK words (the last
may be shorter). A target of t words over a stream of L words is t div L whole passes and a part of one
more; in each pass the blocks come in an order of its own, a pseudorandom permutation of their indices that
is computed and never stored. The slots that a source fills are dealt to output shards by a multinomial draw
(each slot's shard is hashed); running counts by shard give every shard its range of the source's slots,
the permutation gives each slot its block, and blocks meet their words by an equi join on the index. The
last slots of the part pass take just the words that are still due, so totals are the targets, rounded down.

All of it is DataFrame expressions; texts are read twice, to count words and to cut them at block borders. Pieces of
texts meet by source and block index, and each block meets its slots (a few) there. Running sums
are taken within groups of about GROUP documents and then over groups, so no task holds a source's rows. Where whole documents
stand for their words (`resampled`), blocks are made without words, from the sizes alone.

Defined cases: a null text has no words; documents without words take none and take part in no block; a
null source is a source, the last; repeated rows are separate documents; with no words at all every target
is 0; an empty table gives an empty result; further columns are ignored. All is hashed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import GAP, WORD, let, stored, table

BLOCK, SHARD, GROUP, CHUNK = 256, 1024, 500, 4096
#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 10_000
# Primes; two of them cannot both divide a number of blocks.
PRIMES = ((99999989, 86028121), (67867967, 49979687), (32452843, 15485863))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and print (a hash of the text), a row each."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("print"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """s (rank by code point, null last), source, source_size, docs, target.

    With sources by the ratio of their cap to their weight, those before the first that can take its share
    of what is left are capped; that share a unit of weight is the level of all others."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    listed = listed.withColumn("s", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    due = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    listed = listed.withColumn("level", due / left)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_)
    share = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return listed.select("s", "source", "source_size", "docs", share.alias("target"))


def _permuted(i: Column, n: Column, seed: Column) -> Column:
    """A bijection of 0..n-1: steps a*x + c modulo n, and between them, on the largest power of two within
    n, an odd factor and a shift."""
    bits = F.floor(F.log2(n.cast("double"))).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    x = i
    for k, (p, q) in enumerate(PRIMES):
        a = F.when(n % p != 0, F.lit(p)).otherwise(F.lit(q)) % n
        x = (a * x + F.pmod(F.xxhash64(seed, F.lit(k)), n)) % n
        odd = F.pmod(F.xxhash64(seed, F.lit(-k - 1)), F.lit(1 << 20)) * 2 + 1
        y = (x * odd) % size
        y = y.bitwiseXOR(F.call_function("shiftright", y, (bits / 2).cast("int") + 1))
        x = F.when(x < size, y).otherwise(x)
    return x


def _known(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def slots(planned: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row for each slot of the mix: s, shard, slot, block, whole (all of it is taken), take (words)."""
    whole_words = F.floor("target").cast("long")
    per = planned.where("target >= 1").select(
        "s",
        "source_size",
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
        whole_words.alias("due"),
        F.expr("floor(target) div source_size").alias("passes"),
    )
    rest = F.col("due") - F.col("passes") * F.col("source_size")
    extra = F.when(rest > 0, F.least(F.col("blocks"), F.ceil(rest / block).cast("long") + 1)).otherwise(F.lit(0))
    per = per.withColumn("slots", F.col("passes") * F.col("blocks") + extra).withColumn("rest", rest)
    per = stored(per.withColumn("shards", F.ceil(F.sum("slots").over(Window.partitionBy()) / shard)), "passes")
    chunks = per.select("s", "slots", "shards", F.explode(F.expr(f"sequence(0, (slots - 1) div {CHUNK})")).alias("chunk"))
    first = F.col("chunk") * CHUNK
    each = chunks.repartition("s", "chunk").select("s", "shards", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("slots")) - 1)).alias("slot"))
    drawn = each.groupBy("s", F.pmod(F.xxhash64("s", "slot", F.lit("shard")), "shards").alias("shard")).agg(F.count("*").alias("n"))
    until = F.sum("n").over(Window.partitionBy("s").orderBy("shard"))
    ranged = drawn.withColumn("first", until - F.col("n"))
    numbered = ranged.select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    rows = numbered.join(_known(per.drop("shards", "slots")), "s")
    turn, place = F.expr("slot div blocks"), F.col("slot") % F.col("blocks")
    rows = rows.select("*", turn.alias("turn"), place.alias("place"))
    rows = rows.withColumn("block", _permuted(F.col("place"), F.col("blocks"), F.xxhash64("s", "turn")))
    rows = stored(rows, "slots")
    last_block = F.col("block") == F.col("blocks") - 1
    short = rows.where(last_block & (F.col("turn") == F.col("passes"))).select("s", F.col("place").alias("short_place"))
    rows = rows.join(_known(stored(short, "short")), "s", "left")
    missing = F.col("blocks") * block - F.col("source_size")
    length = block - F.when(last_block, missing).otherwise(F.lit(0))
    before = F.col("place") * block - F.when(F.col("short_place") < F.col("place"), missing).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(length, F.col("rest") - before))
    take = F.when(F.col("turn") < F.col("passes"), length).otherwise(part)
    return rows.select("s", "shard", "slot", "block", (take == length).alias("whole"), take.alias("take")).where("take > 0")


def placed(rows: DataFrame, sizes: DataFrame, planned: DataFrame, spread: bool = False) -> DataFrame:
    """rows (sizes, or those and more columns) with s and `start`, the place of the document's first word in its source's stream.

    s, g and row name a document; documents that are alike in id, source and text may swap names. spread: rows are short, but what follows
    makes many of each, so they go to as many tasks as shuffles have, whatever their bytes."""
    rows, sizes = (x.join(_known(planned), x.source.eqNullSafe(planned.source)).drop(planned.source) for x in (rows, sizes))
    group = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / GROUP).cast("long"))
    rows, sizes = rows.withColumn("g", group), sizes.withColumn("g", group)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "g") if spread else rows
    inside = Window.partitionBy("s", "g").orderBy("doc_id", "size", "print")
    totals = sizes.groupBy("s", "g").agg(F.sum("size").alias("total"))
    base = totals.select("s", "g", (F.sum("total").over(Window.partitionBy("s").orderBy("g")) - F.col("total")).alias("base"))
    rows = rows.withColumn("row", F.row_number().over(inside)).withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(base.hint("merge") if spread else base, ["s", "g"]).withColumn("start", F.col("base") + F.col("until") - F.col("size"))


def _cut(rows: DataFrame, block: int, words: bool = True) -> DataFrame:
    """s, block, first (place in the stream), n, g, row and, where asked for, words: the texts of placed rows, cut at block borders."""
    def piece(b: Column, w: Column | None = None) -> Column:
        first = F.greatest(F.col("start"), b * block)
        n = F.least(F.col("start") + F.col("size"), (b + 1) * block) - first
        part = [] if w is None else [F.array_join(F.slice(w, (first - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("words")]
        return F.struct(b.alias("block"), first.alias("first"), n.alias("n"), *part)

    indices = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    with_words = lambda w: F.transform(indices, lambda b: piece(b, w))
    pieces = let(F.array_remove(F.split("text", GAP), ""), with_words) if words else F.transform(indices, lambda b: piece(b))
    return rows.where("size > 0").select("s", "g", "row", F.explode(pieces).alias("p")).select("s", "g", "row", "p.*")


def blocks(docs: DataFrame, sizes: DataFrame, planned: DataFrame, block: int = BLOCK, words: bool = True) -> DataFrame:
    """The mix: a row for each slot that takes words, with shard, slot (numbered by source), s, source, block, its words
    (one space between two) and pieces (g, row and n: the documents they are from, and how many words of each).

    Without `words` only these are left out, and docs is not read: the pieces follow from the sizes."""
    texts = sizes
    if words:
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        texts = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("print"), "text")
    pieces = _cut(placed(texts, sizes, planned, spread=not words), block, words)
    whole = pieces.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("first", "n", "g", "row", *["words"] * words))).alias("pieces"))
    whole = whole.withColumn("words", F.array_join(F.col("pieces.words"), " ")) if words else whole
    whole = whole.withColumn("pieces", F.transform("pieces", lambda p: F.struct(p["first"].alias("first"), p["n"].alias("n"), p["g"].alias("g"), p["row"].alias("row"))))
    mix = slots(planned, block).join(whole, ["s", "block"]).join(_known(planned.select("s", "source")), "s")
    end = F.col("block") * block + F.col("take")
    part = F.transform("pieces", lambda p: F.struct(p["g"].alias("g"), p["row"].alias("row"), F.least(p["n"], end - p["first"]).alias("n")))
    taken = [F.expr("CASE WHEN whole THEN words ELSE substring_index(words, ' ', CAST(take AS INT)) END").alias("words")] if words else []
    return mix.select("shard", "slot", "s", "source", "block", *taken, F.filter(part, lambda p: p["n"] > 0).alias("pieces"))


def mixed(docs: DataFrame, block: int = BLOCK, words: bool = True) -> DataFrame:
    """doc_id, source, size, print, source_size, target and taken (words the mix takes, repeats counted), from the mix's blocks.

    Without `words` the blocks have just the places of their words: the same counts, but no text is cut, dealt or written."""
    sizes = stored(word_counts(docs), "sizes")
    planned = stored(targets(sizes), "targets")
    mix = stored(blocks(docs, sizes, planned, block, words), "mix", "zstd")
    used = mix.select("s", F.explode("pieces").alias("p")).groupBy("s", "p.g", "p.row").agg(F.sum("p.n").alias("taken"))
    keys = ["s", "g", "row", "doc_id", "source", "size", "print", "source_size", "target"]
    rows = placed(sizes, sizes, planned).select(*keys).join(used, ["s", "g", "row"], "left")
    return rows.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def copies(docs: DataFrame) -> DataFrame:
    """mixed(docs) where documents have words, with `copies`: how often each comes, taken / size rounded down or up.

    A source's documents in order of size (hashed within one) are a stream, and copies are the change of the rounded
    running sum of taken / size. So those of every size come in their share, and as sizes only grow along the stream,
    the copies' words are within one longest document of the words taken. Sums go by size, within it by
    groups of about GROUP documents, and then over these."""
    rows = stored(mixed(docs, words=False).where("size > 0"), "taken")
    parts = rows.groupBy("s", "size").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    order = F.xxhash64("doc_id", "print", F.lit("copies"))
    rows = rows.join(parts, ["s", "size"]).withColumns({"order": order, "part": F.pmod(order, "parts")})
    totals = rows.groupBy("s", "size", "part").agg((F.sum("taken") / F.col("size")).alias("total"))
    before = Window.partitionBy("s").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("s", "size", "part", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("s", "size", "part").orderBy("order", "g", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum("taken").over(inside)).join(base, ["s", "size", "part"])
    upto, start = (F.floor(F.col("base") + x / F.col("size") + 0.5) for x in (F.col("until"), F.col("until") - F.col("taken")))
    return rows.withColumn("copies", (upto - start).cast("int")).drop("parts", "part", "order", "base", "until")


def resampled(docs: DataFrame) -> DataFrame:
    """docs, each as often as copies() says; those without words once.

    The whole document stands for its words here, so sources meet their targets up to about one document."""
    text = Window.partitionBy("doc_id", "source", "print").orderBy("g", "row")
    times = copies(docs).withColumn("nth", F.row_number().over(text)).where("copies > 0").select("doc_id", "source", "print", "nth", "copies")
    times = stored(times, "copies").withColumnsRenamed({"doc_id": "_id", "source": "_source", "print": "_print", "nth": "_nth"})
    each = docs.select(F.struct("*").alias("d"), "doc_id", "source", F.xxhash64("text").alias("print"), F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)).alias("words"))
    # Documents alike in id, source and text stand in for each other.
    kept = each.where("words").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "print").orderBy(F.xxhash64("d"))))
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("print") == F.col("_print")) & (F.col("nth") == F.col("_nth"))
    again = kept.join(times, met).select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return again.select("d.*").unionByName(each.where("NOT words").select("d.*"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
