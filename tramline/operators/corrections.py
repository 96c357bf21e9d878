"""Corrections of misspelt queries by the words of a text column.

A word meets the vocabulary over an index of deletions: two words that are k edits apart (letters changed, added, dropped, neighbours swapped) share a
string that is left when at most k letters of each are deleted. So a word is compared with the few that share such a string, by an equi join, and
never with the whole vocabulary. Words longer than LONG letters, whose deletions would be too many, meet those of nearly their length instead.

Words under four letters and words with digits stay; up to five letters one edit is allowed, beyond that two. The last word of a query may be
unfinished, so it may also be a word's beginning, one edit off. Of a query's words the best few are kept each, and of their combinations the best
few by a beam from word to word. Two words that make one and a word that is two count as a dropped or an added space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.spelling import edits, spelling
from tramline.operators.lineage import written

# What a space more or less and an unfinished word cost; options of a word, and combinations held.
JOIN, PREFIX, OPTIONS, BEAM = 0.8, 0.3, 3, 10
#: Letters of a word from which on it meets others by length.
LONG = 40


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """word and n: the words (between spaces, in lower case) of a column, and how often each is there."""
    return texts.select(F.explode(F.split(F.lower(text), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def allowed(word: Column) -> Column:
    """Edits that a typed word may be off."""
    size = F.length(word)
    return F.when(word.rlike("[0-9]") | (size < 4), 0).when(size <= 5, 1).otherwise(2)


def _shorter(word: Column) -> Column:
    """The word without each of its letters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _left(word: Column, most: Column) -> Column:
    """What is left of a word when up to `most` letters (2 at most) are deleted."""
    one = F.when((most >= 1) & (F.length(word) > 0), _shorter(word)).otherwise(F.array().cast("array<string>"))
    two = F.when((most >= 2) & (F.length(word) > 1), F.flatten(F.transform(_shorter(word), _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def _index(words: DataFrame, word: str, most: Column) -> DataFrame:
    """words with a row for each key of `word`: deletions, and its length where it is long."""
    c = F.col(word)
    near = F.when(F.length(c) <= LONG + 2, _left(c, most)).otherwise(F.array().cast("array<string>"))
    far = F.when(F.length(c) > LONG - 2, F.array(F.concat(F.lit("\x00"), F.length(c).cast("string")))).otherwise(F.array().cast("array<string>"))
    return words.withColumn("_k", F.explode(F.concat(near, far)))


def _asked(words: DataFrame, word: str, most: Column) -> DataFrame:
    """words with a row for each key that a typed word looks for."""
    c = F.col(word)
    lengths = F.transform(F.sequence(F.length(c) - 2, F.length(c) + 2), lambda n: F.concat(F.lit("\x00"), n.cast("string")))
    return words.withColumn("_k", F.explode(F.when(F.length(c) <= LONG, _left(c, most)).otherwise(lengths)))


def options(asked: DataFrame, vocab: DataFrame, most: int = OPTIONS) -> DataFrame:
    """word, last and options (word, cost, edits; the cheapest first, then the more frequent) of typed words (word, last); those without one are left out."""
    wanted = asked.select("word", "last").distinct().withColumn("lim", allowed(F.col("word"))).where("lim > 0")
    size = F.length("w")
    known = vocab.select(F.col("word").alias("w"), "n")
    index = _index(known.where(size >= 3), "w", F.when(size >= 4, 2).otherwise(1))
    pairs = _asked(wanted, "word", F.col("lim")).join(index, "_k").select("word", "last", "lim", "w", "n").distinct()
    whole = pairs.withColumn("edits", edits("word", "w")).where("edits <= lim").withColumn("cost", spelling("word", "w")).select("word", "last", "w", "n", "edits", "cost")
    # A last word of p letters may begin a word of p + 2 letters or more.
    begun = known.where(size >= 6).withColumn("p", F.explode(F.sequence(F.lit(4), F.length("w") - 2))).withColumn("head", F.substring("w", F.lit(1), F.col("p")))
    heads = _index(begun.select("head").distinct(), "head", F.lit(1))
    met = _asked(wanted.where("last"), "word", F.lit(1)).join(heads, "_k").where(F.length("word") == F.length("head")).select("word", "last", "head").distinct()
    met = met.withColumn("edits", edits("word", "head")).where("edits <= 1").withColumn("cost", spelling("word", "head") + PREFIX)
    parts = met.join(begun.select("head", "w", "n"), "head").select("word", "last", "w", "n", "edits", "cost")
    best = Window.partitionBy("word", "last", "w").orderBy("cost", "edits")
    found = whole.unionByName(parts).withColumn("o", F.row_number().over(best)).where("o = 1")
    place = F.row_number().over(Window.partitionBy("word", "last").orderBy("cost", F.desc("n"), "w"))
    kept = found.withColumn("o", place).where(F.col("o") <= most)
    option = F.struct("o", F.col("w").alias("word"), F.round("cost", 6).alias("cost"), F.col("edits").cast("int").alias("edits"))
    return kept.groupBy("word", "last").agg(F.array_sort(F.collect_list(option)).alias("options"))


def _lookups(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, whole (it is in the vocabulary) and known (it is, or begins a word that is) of distinct typed words."""
    heads = vocab.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("word")).distinct()
    words = asked.select("word").distinct()
    return words.join(vocab.select("word", F.lit(True).alias("whole")), "word", "left").join(heads.withColumn("known", F.lit(True)), "word", "left").fillna(False)


def corrected(queries: DataFrame, vocab: DataFrame, most: int = BEAM) -> DataFrame:
    """q, text, cost, big, risky and place: the corrections of queries (q: words in lower case between spaces), the cheapest first.

    big: worth telling (two edits in a word, two words changed, or a space). risky: a word of five letters or fewer has a plain edit. Queries that repeat count once;
    a query that is null, has no words, or needs no correction has no row."""
    words = F.filter(F.split("q", " "), lambda w: w != "")
    base = queries.select("q").distinct().withColumn("ws", words).where(F.size("ws") > 0)
    each = base.select("q", "ws", F.posexplode("ws").alias("i", "word")).withColumn("last", F.col("i") == F.size("ws") - 1)
    pairs = each.where(~F.col("last")).select("q", "ws", "i", F.concat("word", F.get("ws", F.col("i") + 1)).alias("word"), (F.col("i") + 2 == F.size("ws")).alias("last"))
    cuts = each.where((F.length("word") >= 5) & ~F.col("word").rlike("[0-9]")).withColumn("k", F.explode(F.sequence(F.lit(2), F.length("word") - 2)))
    cuts = cuts.withColumns({"a": F.substring("word", F.lit(1), F.col("k")), "b": F.substring("word", F.col("k") + 1, F.length("word"))})
    asked = each.select("word", "last").unionByName(pairs.select("word", "last"))
    vocab = written(vocab)
    lookups = written(_lookups(asked.select("word").unionByName(cuts.select(F.col("a").alias("word"))).unionByName(cuts.select(F.col("b").alias("word"))), vocab))
    offered = written(options(asked.join(lookups.where("NOT known"), "word", "left_semi").unionByName(pairs.select("word", "last").join(lookups.where("NOT whole"), "word", "left_semi")), vocab))

    own = F.array(F.struct(F.lit(1).alias("o"), F.col("word"), F.lit(0.0).alias("cost"), F.lit(0).alias("edits")))
    short = F.length("word") <= 5
    fair = F.filter("options", lambda x: ~short | (x["cost"] < 1) | (F.substring(x["word"], 1, 1) == F.substring("word", 1, 1)))
    chosen = each.join(lookups, "word").join(offered, ["word", "last"], "left")
    held = F.when(F.col("known") | F.col("options").isNull() | (F.size(fair) == 0), own).otherwise(fair)
    tagged = F.transform(held, lambda x: F.struct(x["word"].alias("word"), x["cost"].alias("cost"), x["edits"].alias("edits"), (short & (x["cost"] >= 1)).alias("risky")))
    rows = chosen.select("q", "i", tagged.alias("options")).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "options"))).alias("steps"))
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("words"), F.lit(0).alias("changed"), F.lit(0).alias("most"), F.lit(False).alias("risky")))

    def longer(c: Column, x: Column) -> Column:
        return F.struct(
            F.round(c["cost"] + x["cost"], 6).alias("cost"), F.concat(c["words"], F.array(x["word"])).alias("words"), (c["changed"] + (x["edits"] > 0).cast("int")).alias("changed"),
            F.greatest(c["most"], x["edits"]).alias("most"), (c["risky"] | x["risky"]).alias("risky"),
        )

    def step(held: Column, s: Column) -> Column:
        return F.slice(F.array_sort(F.flatten(F.transform(held, lambda c: F.transform(s["options"], lambda x: longer(c, x))))), 1, most)

    beam = rows.select("q", F.explode(F.aggregate("steps", start, step)).alias("c")).where("c.changed > 0")
    beam = beam.select("q", F.array_join("c.words", " ").alias("text"), "c.cost", ((F.col("c.most") >= 2) | (F.col("c.changed") > 1)).alias("big"), "c.risky")

    def replaced(new: Column, many: int) -> Column:
        rest = F.slice("ws", F.col("i") + 1 + many, F.greatest(F.lit(0), F.size("ws") - F.col("i") - many))
        return F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("i")), new, rest), " ")

    fixed = F.col("whole") | (F.col("last") & F.col("known"))
    made = pairs.join(lookups, "word").join(offered, ["word", "last"], "left").where(fixed | F.col("options").isNotNull())
    first = F.get("options", F.lit(0))
    joined = made.select("q", replaced(F.array(F.when(fixed, F.col("word")).otherwise(first["word"])), 2).alias("text"), F.round(JOIN + F.when(fixed, 0.0).otherwise(first["cost"]), 6).alias("cost"))
    a, b = (lookups.select(F.col("word").alias(c), F.col("whole").alias(f"{c}_whole"), F.col("known").alias(f"{c}_known")) for c in "ab")
    parted = cuts.join(lookups.where("NOT whole").select("word"), "word").join(a, "a").join(b, "b").where("a_whole AND (b_whole OR (last AND b_known))")
    parted = parted.select("q", replaced(F.array("a", "b"), 1).alias("text"), F.lit(JOIN).alias("cost"))
    spaced = joined.unionByName(parted).select("q", "text", "cost", F.lit(True).alias("big"), F.lit(False).alias("risky"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("cost", "text", "big"))
    return beam.unionByName(spaced).withColumn("place", place).where(F.col("place") <= most)
