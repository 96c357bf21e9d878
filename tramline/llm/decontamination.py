"""Benchmark decontamination: runs of a benchmark's words in documents, by Wu-Manber multi-pattern search.

The test strings are windows of WINDOW consecutive words of an item; an item of fewer words is one window of its own length. Windows of one
length are searched together. A block is the last BLOCK words of a stretch as long as a window: a table says for each block's hash how far the
stretch may move on without missing a window (blocks in no window move it by almost a window). Where that is nothing, the block's hash
picks the bucket of windows that end in it, a hash of the whole stretch one of them, and the words themselves are compared before it counts.

Tasks read texts in batches and search pieces of bounded size; a longer text is several pieces, each after the last words of
the one before. A piece's stretches move in lanes side by side, so a step is a few array operations whatever the texts.

The windows go to the tasks as tables of bounded size: items are cut into runs of words, and runs are dealt to sets of at most about SET bytes. One set
is the usual case and needs no shuffle. More sets (a long benchmark) are searched one after another, and their findings, for documents that have any, are
put together by id and hash of the text.

Defined cases: null or empty texts have no words and no hits; items without words match nothing; an item without an id marks words, but is
in no list; items that repeat an id are one; rows that repeat an id are judged each by its own text; an empty table or benchmark gives
an empty result or no hits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import _BASE, _INV, _powers, ids_as_text, mix64, short_batches, stored, table, trimmed

WINDOW, BLOCK = 10, 3
#: Bytes of one set of test strings, about; words of an item's run besides what runs share; bytes of a piece of text; words of a lane.
SET, RUN, PIECE, LANE = 8 << 20, 1000, 1 << 20, 128
#: Java's pattern of what stands between words of a text in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_U = np.uint64
_IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word of a text in lower case."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers(_BASE, len(raw)), out=total[1:])
    value = (total[end] - total[start]) * _powers(_INV, len(raw))[start] if len(start) else np.empty(0, _U)
    return start, end, mix64(value ^ ((end - start).astype(_U) * _U(_BASE)))


def _joined(h: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each of some places."""
    out = np.zeros(len(ends), _U)
    for k in range(n):
        out = mix64(out * _U(_BASE) + h[ends - (n - 1) + k])
    return out


class Patterns:
    """Tables of all windows of `size` words in some runs of words (words joined by a space, and the items that have the run)."""

    def __init__(self, size: int, runs: list[tuple[bytes, tuple[str, ...]]]) -> None:
        self.size, self.block = size, min(BLOCK, size)
        self.text, self.items = b"\0".join(text for text, _ in runs), [items for _, items in runs]
        self.start, self.end, h = _words(np.frombuffer(self.text, np.uint8))
        border = np.searchsorted(self.start, np.cumsum([0, *(len(text) + 1 for text, _ in runs)]))
        windows = np.maximum(0, np.diff(border) - size + 1)
        run = np.repeat(np.arange(len(runs)), windows)
        last = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + border[:-1][run] + size - 1
        whole = _joined(h, last, size)
        order = np.argsort(whole, kind="stable")
        self.whole, self.last, self.run = whole[order], last[order], run[order]
        bits = max(12, min(22, len(last).bit_length() + 6))
        self.low = _U((1 << bits) - 1)
        self.shift = np.full(1 << bits, size - self.block + 1, np.uint8)
        for back in range(size - self.block, -1, -1):  # the nearer to the end, the smaller the move: written last
            self.shift[(_joined(h, last - back, self.block) & self.low).astype(np.int64)] = back
        self.endings = np.unique(_joined(h, last, self.block))

    def window(self, k: int) -> bytes:
        return self.text[self.start[self.last[k] - self.size + 1] : self.end[self.last[k]]]

    def found(self, h: np.ndarray, first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, window) whose hashes agree, over lanes that end stretches at places first to until - 1."""
        at, limit, places = first, until, []
        while len(at):
            ending = _joined(h, at, self.block)
            move = self.shift[(ending & self.low).astype(np.int64)]
            zero = move == 0
            if zero.any():
                ends, blocks = at[zero], ending[zero]
                spot = np.minimum(np.searchsorted(self.endings, blocks), len(self.endings) - 1)
                places.append(ends[self.endings[spot] == blocks])
            at = at + np.maximum(move, 1)
            left = at < limit
            at, limit = at[left], limit[left]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.concatenate(places)
        whole = _joined(h, ends, self.size)
        # Of windows with one hash all are tried: they may be of several runs.
        low, high = np.searchsorted(self.whole, whole, "left"), np.searchsorted(self.whole, whole, "right")
        many = high - low
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(ends, many), np.repeat(low, many) + within


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, first word's number, bytes), of about PIECE bytes; pieces of one text share WINDOW - 1 words."""
    held, size = [], 0
    for k, raw in enumerate(texts):
        at, base, carry, many = 0, 0, b"", 0
        while True:
            end = min(len(raw), at + PIECE)
            while end < len(raw) and _IS_WORD[raw[end]]:
                end += 1
            part = carry + raw[at:end]
            held.append((k, base - many, part))
            size += len(part)
            at = end
            if at >= len(raw):
                break
            yield held
            held, size = [], 0
            start, stop, _ = _words(np.frombuffer(part, np.uint8))
            base, last = base - many + len(start), max(0, len(start) - (WINDOW - 1))
            many = len(start) - last
            carry = part[start[last] : stop[-1]] + b" " if many else b""
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(texts: list[str | None], patterns: list[Patterns]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: number of words, stretches of words (first, end) hit, in order and apart, and the items found."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    count, hits = np.zeros(len(raw), np.int64), {}
    for group in _pieces(raw):
        whole = b"\0".join(p for _, _, p in group)
        start, end, h = _words(np.frombuffer(whole, np.uint8))
        border = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for _, _, p in group)]))
        for (k, base, _), a, b in zip(group, border[:-1], border[1:], strict=True):
            count[k] = max(count[k], base + b - a)
        for p in patterns:
            first, until = border[:-1] + p.size - 1, border[1:]
            lanes = np.maximum(0, -(-(until - first) // LANE))
            within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            begin = np.repeat(first, lanes) + within * LANE
            for place, window in zip(*p.found(h, begin, np.minimum(begin + LANE, np.repeat(until, lanes))), strict=True):
                words = range(place - p.size + 1, place + 1)
                if b" ".join([whole[start[i] : end[i]] for i in words]) == p.window(window):
                    piece = int(np.searchsorted(border, place, "right")) - 1
                    while border[piece + 1] <= place:
                        piece += 1
                    k, base, _ = group[piece]
                    hits.setdefault(k, []).append((int(base + words[0] - border[piece]), p.size, p.items[p.run[window]]))
    out = []
    for k in range(len(raw)):
        spans: list[tuple[int, int]] = []
        for a, n, _ in sorted(hits.get(k, ()), key=lambda x: x[:2]):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], a + n))
            else:
                spans.append((a, a + n))
        out.append((int(count[k]), spans, {i for _, _, items in hits.get(k, ()) for i in items}))
    return out


KIND = "doc_id string, print long, n_words long, hits array<struct<first:long,end:long>>, items array<string>"


def _run(sent) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size: dict[int, list] = {}
        for size, text, items in sent.value:
            by_size.setdefault(size, []).append((text, items))
        patterns = [Patterns(size, runs) for size, runs in sorted(by_size.items())]
        for batch in batches:
            found = search(batch.text.tolist(), patterns)
            rows = [(d, p, n, spans, sorted(items)) for d, p, (n, spans, items) in zip(batch.doc_id, batch["print"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "print", "n_words", "hits", "items"])

    return trimmed(run)


def _windows(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Stored runs of words (words, items, part) of all items, dealt to parts of at most about `most` bytes, and the number of parts."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - WINDOW) / RUN).cast("int")))
    runs = items.select("item", F.explode(F.transform(cuts, lambda c: F.slice("w", c * RUN + 1, F.lit(RUN + WINDOW - 1)))).alias("words"))
    runs = stored(runs.groupBy("words").agg(F.collect_set("item").alias("items")), "runs")
    size = runs.agg(F.coalesce(F.sum(F.length(F.array_join("words", " ")) + 16 * F.size("items")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // most))
    return runs.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts))), parts


def found_in(docs: DataFrame, benchmark: DataFrame, most: int = SET) -> DataFrame:
    """doc_id, n_words, hits (first, end; numbers of words, end exclusive, apart and in order) and items (ids as text) of every document."""
    spark = docs.sparkSession
    runs, parts = _windows(benchmark, most)
    rows = ids_as_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("print", F.xxhash64("text"))

    def part(k: int) -> DataFrame:
        # One set's bytes are bounded, and so is what the driver holds.
        held = runs.where(F.col("part") == k).select(F.least(F.size("words"), F.lit(WINDOW)), F.array_join("words", " "), "items").collect()
        sent = spark.sparkContext.broadcast([(size, text.encode("utf-8", "surrogatepass"), tuple(items)) for size, text, items in held])
        return short_batches(rows).mapInPandas(_run(sent), KIND)

    found = part(0)
    if parts > 1:
        base = found
        more = stored(base.select("doc_id", "print", "hits", "items").where(F.size("hits") > 0).distinct(), "hits")
        for k in range(1, parts):
            more = more.unionByName(stored(part(k).select("doc_id", "print", "hits", "items").where(F.size("hits") > 0).distinct(), "hits"))
        merged = more.groupBy("doc_id", "print").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        merged = merged.withColumnsRenamed({"doc_id": "_id", "print": "_print"})
        met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        found = base.select("doc_id", "print", "n_words").join(merged, met, "left").select("doc_id", "n_words", none(F.col("h"), "array<struct<first:long,end:long>>").alias("hits"), none(F.col("i"), "array<string>").alias("items"))
    kind = docs.schema["doc_id"].dataType
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "hits", "items")


def covered(hits: Column) -> Column:
    """Number of words in stretches that are sorted but may overlap."""
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["first"]))).alias("n"))
    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item; rows without an id are judged by their text as well."""
    marked = docs.select(F.struct("*").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_print"))
    bad = stored(found_in(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), benchmark).where(F.size("hits") > 0).select(F.col("doc_id").alias("_print")).distinct(), "bad")
    return marked.join(bad, "_print", "left_anti").select("d.*")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = covered(F.col("hits"))
    listed = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS m, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT n, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM p) AS ms, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) AS t(i)),
h AS (SELECT s.n, s.i, s.m, p.item_id FROM s JOIN p ON s.win = p.win AND s.m = p.m),
k AS (SELECT n, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT n, i, m FROM h) AS x, unnest(range(i, i + m)) AS t(j) GROUP BY n),
l AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) AS x GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (n) LEFT JOIN l USING (n)"""
