"""Language-model scores: prediction by partial matching over bytes, beside a word-frequency base.

The model is a trie of byte contexts of up to ORDER bytes with counts of the byte that follows, gathered over all
training texts (each ended by a byte that no text has). A byte is predicted in the longest context that was
seen; if it never followed there, an escape is paid (its probability estimated from the number of distinct
followers) and the next shorter context is tried without the symbols that the longer one already excluded;
after the empty context all remaining symbols are alike. A text's score is the sum of log10 probabilities.

A byte's score depends on its whole gram (the byte and the ORDER bytes before it) only. So Spark counts the
grams of each order, all of them, as stored tables, and scores each distinct gram once, by joins on its
shorter and shorter ends. The scores of the grams most often in the texts, COMMON_GRAMS at most, go to the tasks (a
bounded table); all others meet their texts in an equi join on the gram, in which no key is frequent.
No count is cut off at any size. Trie is the plain form of the same model, for few texts, in memory.

The base score needs each token's count over all training texts. Token counts are aggregated by 64-bit hash;
the COMMON most frequent ones go to the tasks (a bounded table), all others meet their documents in an
equi join in which no key is frequent, so no key is hot.

Defined cases: a null text is empty and has the end token only; an id that is null counts as an empty text where crc32 deals
rows to folds (so such rows are held out); repeated rows score alike, and rows that repeat an id each by their own text; without training
texts counts are 0 and every byte costs log10(257); an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import hashed_words, ids_as_text, lower_ascii, remainder, short_batches, stored, table

ORDER, COMMON_GRAMS, COMMON = 5, 1_000_000, 150_000
END, SYMBOLS = 0xFF, 257
_END_TOKEN = np.array([0x454E44], np.uint64)
_U = np.uint64


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ORDER bytes before it, packed (the last byte lowest), and where texts start."""
    pad = b"\0" * ORDER
    b = np.frombuffer(pad + pad.join(t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    whole = np.zeros(len(b) - ORDER, _U)
    for k in range(ORDER + 1):
        whole |= b[k : len(b) - ORDER + k] << _U(8 * (ORDER - k))
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1]))
    keep = np.ones(len(whole), bool)
    for k in range(1, ORDER + 1):
        keep[starts[1:] - k] = False
    return whole[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _chunks(batches: Iterator[pd.DataFrame], size: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Rows of batches in runs of about `size` characters."""
    for batch in batches:
        run = (batch.text.str.len().fillna(0).cumsum() // size).to_numpy()
        for k in np.unique(run):
            yield batch[run == k]


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _chunks(batches, 8_000_000):
        grams, starts = _grams([(t or "").encode("utf-8", "surrogatepass") for t in rows.text])
        keys, at, n = np.unique(grams, return_inverse=True, return_counts=True)
        learnt = np.repeat(rows.learn.to_numpy(bool), np.diff(np.append(starts, len(grams))))
        yield pd.DataFrame({"gram": keys.astype(np.int64), "n": n, "learnt": np.bincount(at[learnt], minlength=len(keys))})


def _tokens(text: str | None) -> np.ndarray:
    return np.concatenate((hashed_words(lower_ascii(text))[0], _END_TOKEN))


def _token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _chunks(batches, 8_000_000):
        keys, n = np.unique(np.concatenate([_tokens(t) for t in rows.text]), return_counts=True)
        yield pd.DataFrame({"token": keys.view(np.int64), "n": n})


class Lookup:
    """Values by 64-bit key: one probe of a hashed table, and a binary search where two keys clash."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """Index into the sorted keys, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.slots[self._slot(keys)].astype(np.int64)
        other = np.flatnonzero(self.keys[out] != keys)
        if len(other):
            found = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            out[other] = np.where(self.keys[found] == keys[other], found, -1)
        return out


@dataclass
class _Order:
    """One context length: its grams and contexts, with natural logarithms."""

    grams: Lookup
    count: np.ndarray  # ln of a gram's count
    direct: np.ndarray  # ln of its probability when the context is entered without exclusions
    contexts: Lookup
    escape: np.ndarray  # ln of the escape, entered without exclusions
    below_total: np.ndarray  # ln of the shorter context's denominator, without the symbols seen here
    below_escape: np.ndarray  # ln of the shorter context's escape, likewise
    seen: np.ndarray  # distinct followers


class Trie:
    """The pretrained model: counts of grams of each order (arrays of packed keys and counts), as a table."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.orders: list[_Order] = []
        totals: list[tuple[Lookup, np.ndarray, np.ndarray]] = []
        below: Lookup | None = None
        below_n = np.zeros(0)
        for order, (keys, n) in enumerate(counts):
            by = np.argsort(keys)
            keys, n = keys[by].astype(_U), n[by].astype(np.float64)
            names, at = np.unique(keys >> _U(8), return_inverse=True)
            total, seen = np.bincount(at, n, len(names)), np.bincount(at, minlength=len(names)).astype(np.float64)
            grams, contexts = Lookup(keys), Lookup(names)
            space = total + seen
            rest, new = np.ones(len(names)), np.zeros(len(names))
            if order:
                short = _U((1 << 8 * order) - 1)  # the gram without its first byte
                found = below.at(keys & short)
                known = np.where(found >= 0, below_n[np.maximum(found, 0)], 0.0)
                upper, upper_total, upper_seen = totals[-1]
                up = upper.at(names & _U((1 << 8 * (order - 1)) - 1)) if order > 1 else np.zeros(len(names), np.int64)
                new = np.maximum(upper_seen[up] - np.bincount(at, found >= 0, len(names)), 0)
                rest = upper_total[up] - np.bincount(at, known, len(names)) + new
            with np.errstate(divide="ignore"):
                self.orders.append(
                    _Order(
                        grams, np.log(n), np.log(n) - np.log(space[at]), contexts, np.log(seen / space),
                        np.log(np.maximum(rest, 1e-9)), np.where(new > 0, np.log(np.maximum(new, 1e-9)) - np.log(np.maximum(rest, 1e-9)), 0.0), seen,
                    )
                )
            totals.append((contexts, total, seen))
            below, below_n = grams, n

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each packed gram's last byte after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))  # positions not yet predicted
        entered = np.full(len(grams), -1, np.int64)  # the longer context, whose followers are excluded
        for order in range(len(self.orders) - 1, -1, -1):
            if not len(left):
                break
            level, key = self.orders[order], grams[left] & _U((1 << 8 * (order + 1)) - 1)
            upper = self.orders[order + 1] if order + 1 < len(self.orders) else None
            found = level.grams.at(key)
            fresh = entered < 0
            hit = found >= 0
            at = found[hit]
            gain = level.direct[at]
            if upper is not None:
                old = ~fresh[hit]
                gain[old] = level.count[at[old]] - upper.below_total[entered[hit][old]]
            out[left[hit]] += gain
            miss = ~hit
            left, key, was, fresh = left[miss], key[miss], entered[miss], fresh[miss]
            context = level.contexts.at(key >> _U(8))
            there = context >= 0
            first = there & fresh
            out[left[first]] += level.escape[context[first]]
            if upper is not None:
                out[left[~fresh]] += upper.below_escape[was[~fresh]]
            entered = np.where(there, context, -1)
        if len(left):
            seen = self.orders[0].seen if self.orders and len(self.orders[0].seen) else np.zeros(1)
            out[left] -= np.log(max(SYMBOLS - seen[0], 1.0))
        return out / np.log(10)


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n (over all texts) and learnt (over those with `learn`) of every distinct gram; docs have text and learn."""
    parts = short_batches(docs.select("text", "learn")).mapInPandas(_gram_counts, "gram long, n long, learnt long")
    return stored(parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), "grams")


def _end(gram: Column, size: int) -> Column:
    """The last `size` bytes of a packed gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def order_counts(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """gram and n of every order from 0 to `order`, over the texts learnt from."""
    rows, out = grams.where("learnt > 0").select(_end(F.col("gram"), order + 1).alias("gram"), F.col("learnt").alias("n")), []
    for k in range(order, -1, -1):
        rows = stored(rows.groupBy(_end(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")), f"order{k}")
        out.append(rows)
    return out[::-1]


def trie_counts(docs: DataFrame, order: int = ORDER, nodes: int = COMMON_GRAMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the byte contexts of every order over all texts, for a Trie; an error where an order has more than `nodes` grams."""
    out = []
    for rows in order_counts(gram_counts(docs.select("text", F.lit(True).alias("learn"))), order):
        if rows.count() > nodes:
            raise ValueError(f"more than {nodes} grams of an order; use gram_scores()")
        found = rows.toPandas()
        out.append((found.gram.to_numpy(np.int64).astype(_U), found.n.to_numpy(np.float64)))
    return out


def _small(df: DataFrame, k: int) -> DataFrame:
    """Tables of the two lowest orders have 65,536 rows at most."""
    return F.broadcast(df) if k < 2 else df


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n and score (log10 of the last byte's probability after the others) of every gram; a Trie's numbers."""
    counts = order_counts(grams, order)
    levels: list[tuple[DataFrame, DataFrame]] = []
    upper: DataFrame | None = None
    for k, rows in enumerate(counts):
        each = rows.select(F.shiftright("gram", 8).alias("context"), "gram", "n")
        if k:
            short = counts[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("below"))
            each = each.join(_small(short, k - 1), _end(F.col("gram"), k) == F.col("short")).drop("short")
        else:
            each = each.withColumn("below", F.lit(0))
        per = each.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.sum("below").alias("below"))
        if k:
            above = upper.select(F.col("context").alias("short"), F.col("total").alias("total_"), F.col("seen").alias("seen_"))
            per = per.join(_small(above, k - 1), _end(F.col("context"), k - 1) == F.col("short")).drop("short")
        else:
            per = per.withColumns({"total_": F.lit(0), "seen_": F.lit(0)})
        # What the shorter context has beside the symbols seen here.
        new = F.col("seen_") - F.col("seen")
        rest = F.col("total_") - F.col("below") + new
        per = per.select(
            "context", "total", "seen",
            F.log(F.col("seen") / (F.col("total") + F.col("seen"))).alias("escape"),
            F.when(rest > 0, F.log(rest.cast("double"))).otherwise(F.lit(0.0)).alias("rest"),
            F.when(new > 0, F.log(new / rest)).otherwise(F.lit(0.0)).alias("rest_escape"),
        )
        upper = stored(per, f"contexts{k}")
        spaces = upper.select("context", (F.col("total") + F.col("seen")).alias("space"))
        direct = rows.withColumn("context", F.shiftright("gram", 8)).join(_small(spaces, k), "context")
        levels.append((direct.select(F.col("gram").alias("end"), F.log("n").alias("count"), F.log(F.col("n") / F.col("space")).alias("direct")), upper))
    lowest = levels[0][1].select("seen").first()
    left = math.log(max(SYMBOLS - (lowest.seen if lowest else 0), 1))
    none = F.lit(None).cast("double")
    rows, done = grams.select("gram", "n", F.lit(0.0).alias("sum"), none.alias("in_rest"), none.alias("in_escape")), []
    for k in range(order, -1, -1):
        level, contexts = levels[k]
        here = stored(rows.join(_small(level, k), _end(F.col("gram"), k + 1) == F.col("end"), "left").drop("end"), f"level{k}")
        hit = F.when(F.col("in_rest").isNull(), F.col("direct")).otherwise(F.col("count") - F.col("in_rest"))
        done.append(here.where("count IS NOT NULL").select("gram", "n", (F.col("sum") + hit).alias("sum")))
        context = contexts.select("context", "escape", "rest", "rest_escape")
        missed = here.where("count IS NULL").join(_small(context, k), F.shiftright(_end(F.col("gram"), k + 1), 8) == F.col("context"), "left")
        rows = missed.select(
            "gram",
            "n",
            (F.col("sum") + F.coalesce("in_escape", "escape", F.lit(0.0))).alias("sum"),
            F.col("rest").alias("in_rest"),
            F.col("rest_escape").alias("in_escape"),
        )
    done.append(rows.select("gram", "n", (F.col("sum") - left).alias("sum")))
    return stored(reduce(DataFrame.unionByName, done).select("gram", "n", (F.col("sum") / math.log(10)).alias("score")), "gram_scores")


def _frequent(scores: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams, at most `most` of the most frequent ones, and their scores."""
    step = F.floor(F.log2("n") * 4).cast("int")
    room, least = most, None
    for r in sorted(scores.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    found = scores.where(step >= least if least is not None else F.lit(False)).select("gram", "score").toArrow()
    grams, score = found["gram"].to_numpy().astype(_U), found["score"].to_numpy()
    by = np.argsort(grams)
    return grams[by], score[by]


_READY: dict[str, tuple[Lookup, Lookup]] = {}


def _scorer(model: Broadcast, name: str, train: int, kinds: int) -> Callable:
    """model: the common grams with scores and the common tokens; a worker builds its tables once and keeps the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (frequent, gram_score), common = model.value
        if name not in _READY:
            _READY.clear()
            _READY[name] = Lookup(frequent), Lookup(common[0])
        scores, known = _READY[name]
        n = common[1][np.argsort(common[0])]
        logs = np.log10((n + 0.1) / (train + 0.1 * (kinds + 1)))
        for rows in _chunks(batches):
            grams, starts = _grams([(t or "").encode("utf-8", "surrogatepass") for t in rows.text])
            place = scores.at(grams)
            met = np.flatnonzero(place >= 0)
            value = np.zeros(len(grams))
            value[met] = gram_score[place[met]]
            score = np.add.reduceat(value, starts)
            missed = np.flatnonzero(place < 0)
            row = np.searchsorted(starts, missed, "right") - 1
            pairs, often = np.unique((row.astype(_U) << _U(48)) | grams[missed], return_counts=True)
            edges = np.searchsorted(pairs >> _U(48), np.arange(1, len(rows)).astype(_U))
            rare_grams = np.split((pairs & _U((1 << 48) - 1)).astype(np.int64), edges)
            gram_times = np.split(often, edges)
            out = []
            for text in rows.text:
                tokens, times = np.unique(_tokens(text), return_counts=True)
                at = known.at(tokens)
                here = at >= 0
                out.append((int(times.sum()), int(times[here].sum()), float(logs[at[here]] @ times[here]), tokens[~here].view(np.int64), times[~here]))
            found = pd.DataFrame(out, columns=["n_tokens", "n_common", "common_score", "rare", "times"])
            yield found.assign(rare_grams=rare_grams, gram_times=gram_times, doc_id=rows.doc_id.to_numpy(), print=rows.print.to_numpy(), score=score)

    return run


def _exploded(rows: DataFrame, key: str, times: str) -> DataFrame:
    """doc_id, print, kinds, key and times: one row for each of a row's rare keys, of which it has `kinds`."""
    each = rows.select("doc_id", "print", F.size(key).alias("kinds"), F.explode(F.arrays_zip(F.col(key).alias("key"), F.col(times).alias("times"))).alias("x"))
    return each.select("doc_id", "print", "kinds", F.col("x.key").alias("key"), F.col("x.times").alias("times"))


def _joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with the sums of their doc_id and print."""
    keys = sums.withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    return rows.join(keys, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["print"] == F.col("_print")), "left").drop("_id", "_print")


def scored(docs: DataFrame, usable: Callable[[Column], Column], most: int = COMMON_GRAMS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; learns from texts with usable(doc_id)."""
    train = docs.where(usable(F.col("doc_id"))).select("text")
    counts = stored(short_batches(train).mapInPandas(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
    common = (top.token.to_numpy(np.int64).view(_U), top.n.to_numpy(np.float64))
    kind = (
        "n_tokens long, n_common long, common_score double, rare array<long>, times array<long>, rare_grams array<long>, gram_times array<long>, "
        "doc_id string, print long, score double"
    )
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    learn = F.coalesce(usable(F.col("doc_id")), F.lit(False))
    grams = gram_scores(gram_counts(docs.select("text", learn.alias("learn"))))
    model = docs.sparkSession.sparkContext.broadcast((_frequent(grams, most), common))
    made = short_batches(ids_as_text(rows)).mapInPandas(_scorer(model, uuid.uuid4().hex, total, kinds), kind)
    rows = stored(made.withColumn("doc_id", F.col("doc_id").cast("long")), "scored")
    met = _exploded(rows, "rare", "times").join(counts.withColumnRenamed("token", "key"), "key", "left")
    unit = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (total + 0.1 * (kinds + 1)))
    # Rows repeated with the same id and text come several times; one of them counts.
    times = F.first("kinds") / F.count("*")
    rare = met.groupBy("doc_id", "print").agg(
        (F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)) * times).alias("rare_known"), (F.sum(unit * F.col("times")) * times).alias("rare_score")
    )
    met = _exploded(rows, "rare_grams", "gram_times").join(grams.select(F.col("gram").alias("key"), F.col("score").alias("unit")), "key")
    bytes_ = met.groupBy("doc_id", "print").agg((F.sum(F.col("unit") * F.col("times")) * times).alias("rare_bytes"))
    joined = _joined(_joined(rows.drop("rare", "times", "rare_grams", "gram_times"), rare), bytes_)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.round(F.coalesce("rare_known", F.lit(0)))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_bytes", F.lit(0.0))).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), lambda i: remainder(i, 10) != 0)
    return rows.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
