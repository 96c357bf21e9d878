"""N-gram Jaccard join: links between documents whose sets of word n-grams are alike, without misses.

Candidates come from a pigeonhole over a partitioned universe. Sizes fall into bands, each a quarter (or so)
wider than the last. In a band whose largest set has `top` members, two sets that link differ in at most
    apart = floor(top * (1 - t) / t)
members. Every member is hashed to one of `apart + 1 + spare` segments of the band. A set probes segments
with an allocation of 0 (not at all), 1 (equal segments) or 2 (segments that differ by one member at most);
allocations of apart + 1 in sum cannot all fail. The cost of a segment is the number of sets that may share
it, which is large where it has no or one member: such segments get 0, paid first by the spare segments and
then by 2 for reserved ones. Empty segments come first, as a set of the band has one alike by mere chance: a key of these would
hold a share of all sets. So many segments are reserved that they are hardly ever probed; what is left of the tiny ones, if any, is probed all the same.

A segment is keyed by the sum of its members' scrambled hashes, so those of its one-deletion neighbourhood
are differences. Keys are shuffled once; those that no second set has go at once.

A key's sets are not all paired. First each is tested against one pivot of its keys, and the links found so
join sets to groups: thousands of near copies cost about one comparison each. What a key holds besides, sets
of different groups, is compared in blocks of bounded size: by sketches (a parity bit for each hash of a member
modulo a power of two; two sketches differ in no more places than the sets do) that leave clusters of sets
that may link; and within those clusters, again in blocks, by the members themselves. Blocks hold the pairs of
the largest group with the others, and of the others among themselves, so a large group is sent once to few others.
A block gives just a forest of its links, as sets already joined need no second one. Its walk passes freely from a set
to those of its group, so a cluster takes in the whole of every group it meets: a set of that group may link where the
one that was found does not. There is one round of exact comparison for pivots and one for clusters, whatever the
number of near misses.

Sets equal as a whole (128 bits) are one set from the start. Members are 64-bit hashes of n-grams.

Defined cases: null or empty texts have an empty set and link with nothing; a text of fewer words than n is
one n-gram; rows that repeat an id are one document, with the links of all its texts; rows without an id
are their own component (null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import forget, gathered, hashed_words, ids_as_text, lower_ascii, mix64, shingles, short_batches, stored, table, trimmed
from tramline.llm.components import components

#: Weight of one side of a block, about; a set weighs as many as it has members and OVERHEAD more. 4 MB of members.
BLOCK, OVERHEAD = 500_000, 400
#: Ids in one broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_U = np.uint64


class Bands:
    """Sizes' bands for a threshold num / den, and each band's segments."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ratio = 1.25 if 100 * num >= 85 * den else 1.6
        self.low, self.high = [1], [1]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], int(self.low[-1] * self.ratio)))
        return int(np.searchsorted(self.high, size))

    def probed(self, size: int) -> range:
        """Bands of the sets that a set of this size can link with and is not smaller than, its own last."""
        return range(self.of(max(1, -(-size * self.num // self.den))), self.of(size) + 1)

    @lru_cache(None)
    def apart(self, band: int) -> int:
        return self.high[band] * (self.den - self.num) // self.num

    @lru_cache(None)
    def segments(self, band: int) -> tuple[int, int, int]:
        """Segments, how many of them are spare, and how many are reserved for allocation 2: as many as hardly any set has empty segments for beyond the spare ones."""
        need = self.apart(band) + 1
        mean = self.low[band] / need  # members in a segment of the band's least set
        tiny = float(np.exp(-mean) * (1 + mean))
        spare = int(np.ceil(need * tiny * 1.3)) if need > 8 else 0
        count = need + spare
        mean = self.low[band] / count
        empty, full = count * float(np.exp(-mean)), 1 - float(np.exp(-mean) * (1 + mean))
        more = int(np.ceil(1.5 * (empty + 4 * np.sqrt(empty) - spare) / full))
        return count, spare, max(min(need - 1, 1 + need // 64), min(count, more))


def _segment_keys(members: np.ndarray, band: int, own: bool, bands: Bands) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys that a set probes in a band, and those that it only offers there (for its own band)."""
    count, spare, reserved = bands.segments(band)
    label = mix64(np.full(1, band + 1, _U))[0]
    segment = (mix64(members ^ label) % _U(count)).astype(np.int64)
    value = mix64(members + label)
    order = np.argsort(segment, kind="stable")
    size = np.bincount(segment, minlength=count)
    until = np.concatenate(([0], np.cumsum(size)))
    running = np.concatenate((np.zeros(1, _U), np.cumsum(value[order], dtype=_U)))
    total = running[until[1:]] - running[until[:-1]]
    name = mix64(np.arange(count, dtype=np.uint64) + label)
    key = mix64(total + name)

    tiny = np.flatnonzero(size <= 1)
    tiny = tiny[np.argsort(size[tiny], kind="stable")]
    # As many as the empty segments need, and a few for those of one member; the fullest, as their keys are shared least.
    wanted = min(len(tiny) - spare, max(int((size == 0).sum()) - spare, 1 + count // 64))
    double = sorted((j for j in range(reserved) if size[j] > 1), key=lambda j: -size[j])[: max(0, wanted)]
    tiny = tiny[: spare + len(double)]
    probe = np.ones(count, bool)
    probe[tiny] = False

    def lacking_one(j: int) -> np.ndarray:
        return mix64(total[j] - value[order[until[j] : until[j + 1]]] + name[j])

    probes = [key[probe], *(lacking_one(j) for j in double)]
    # Allocation 2 is for segments of two members or more, so one that has one more than such a segment has three.
    offers = [key[~probe], *(lacking_one(j) for j in range(reserved) if size[j] > 2 and j not in double)] if own else []
    return probes, offers


def _sketch(members: np.ndarray) -> bytes:
    """A parity bit for each hash of a member modulo 2^k, with at least as many bits as members (64 at least)."""
    width = 1 << max(6, (max(len(members), 1) - 1).bit_length())
    odd = np.bincount((members & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _print(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: the first name it, both tell sets apart."""
    scrambled = mix64(members)
    return int(scrambled.sum().astype(np.int64)), int(mix64(scrambled ^ _U(0x5BD1E995)).sum().astype(np.int64))


def _sets(n: int, num: int, den: int) -> Callable:
    """Size, print, sketch and keys (those probed, those only offered) of each text's set; of a key 48 bits, as one shared by chance costs a comparison and no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, nothing = Bands(num, den), np.empty(0, _U)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                s = shingles(hashed_words(lower_ascii(text))[0], n)
                probes, offers = [nothing], [nothing]
                # Rows without an id link with nothing.
                probed = bands.probed(len(s)) if len(s) and doc_id is not None else ()
                for band in probed:
                    if bands.apart(band) > 0:  # else only equal sets link there, and those are one set
                        found = _segment_keys(s, band, band == probed[-1], bands)
                        probes += found[0]
                        offers += found[1]
                keys = ((np.concatenate(x) >> _U(16)).view(np.int64) for x in (probes, offers))
                out.append((doc_id, len(s), *_print(s), _sketch(s), *keys))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "id", "check", "sketch", "probes", "offers"])

    return trimmed(run)


def _texts(n: int) -> Callable:
    """Name of each text's set, and the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [_print(shingles(hashed_words(lower_ascii(t))[0], n))[0] for t in batch.text]
            yield pd.DataFrame({"id": names, "text": batch.text})

    return trimmed(run)


class _Block:
    """The sets of one block: name, group (label) and side of each; sets of one label need no link."""

    def __init__(self, rows: dict[str, np.ndarray], num: int, den: int) -> None:
        self.ids, self.labels, self.sides = rows["id"], rows["label"], rows["side"]
        self.num, self.den, self.two = num, den, self.sides.min() != self.sides.max()

    def forest(self, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
        """Edges that join what near() finds: it gives those of an array of places that are near to a place."""
        left, out = np.ones(len(self.ids), bool), []
        while left.any():
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
            while queue:
                x = queue.pop()
                same = np.flatnonzero(left & (self.labels == self.labels[x]))
                left[same] = False
                queue.extend(same.tolist())
                rest = np.flatnonzero(left & (self.sides != self.sides[x]) if self.two else left)
                if len(rest):
                    found = near(x, rest)
                    left[found] = False
                    queue.extend(found.tolist())
                    out += [(int(self.ids[x]), int(self.ids[y])) for y in found]
        return out

    def by_sketch(self, sizes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        """A forest of the pairs whose sizes and sketches allow a link."""
        widths = np.array([len(x) for x in sketches])
        tables: dict[int, np.ndarray] = {}
        row = np.zeros(len(widths), np.int64)
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            row[own] = np.arange(len(own))
            tables[int(w)] = np.frombuffer(b"".join(sketches[k] for k in own), np.uint8).reshape(len(own), w)

        def folded(t: np.ndarray, width: int) -> np.ndarray:
            return np.bitwise_xor.reduce(t.reshape(len(t), -1, width), axis=1)

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[np.abs(sizes[rest] - sizes[x]) * (self.den + self.num) <= (sizes[rest] + sizes[x]) * (self.den - self.num)]
            found, mine = [], np.frombuffer(sketches[x], np.uint8)[None]
            for w in np.unique(widths[rest]):
                part, width = rest[widths[rest] == w], min(int(w), len(sketches[x]))
                apart = np.bitwise_count(folded(tables[int(w)][row[part]], width) ^ folded(mine, width)).sum(1, dtype=np.int64)
                found.append(part[apart * (self.den + self.num) <= (sizes[part] + sizes[x]) * (self.den - self.num)])
            return np.concatenate(found) if found else rest[:0]

        return self.forest(near)

    def by_members(self, members: list[np.ndarray]) -> list[tuple[int, int]]:
        """A forest of the links."""
        sizes = np.array([len(m) for m in members])
        whole, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], owner[order]

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            first, last = np.searchsorted(whole, members[x], "left"), np.searchsorted(whole, members[x], "right")
            held = np.repeat(first - np.concatenate(([0], np.cumsum(last - first)[:-1])), last - first) + np.arange((last - first).sum())
            common = np.bincount(owner[held], minlength=len(members))[rest]
            return rest[self.den * common >= self.num * (sizes[rest] + sizes[x] - common)]

        return self.forest(near)


def _edges(n: int, num: int, den: int, exact: bool) -> Callable:
    """Forests of rows sorted by block; a block's rows may come in several batches."""

    def closed(rows: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        block = _Block(rows, num, den)
        if exact:
            return block.by_members([shingles(hashed_words(lower_ascii(t))[0], n) for t in rows["text"]])
        return block.by_sketch(rows["size"], rows["sketch"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {c: batch[c].to_numpy() for c in batch.columns}
            rows = {c: np.concatenate((held[c], x)) for c, x in new.items()} if held else new
            starts = np.concatenate(([0], np.flatnonzero(rows["block"][1:] != rows["block"][:-1]) + 1))
            edges = [e for a, b in zip(starts[:-1], starts[1:], strict=True) for e in closed({c: x[a:b] for c, x in rows.items()})]
            held = {c: x[starts[-1] :] for c, x in rows.items()}
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(closed(held) if held else [], columns=["a", "b"], dtype="int64")

    return trimmed(run)


def _only(rows: DataFrame, ids: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Semi or anti join with a stored table of keys, broadcast while it is known to be small."""
    right = ids.select(columns).distinct()
    return rows.join(F.broadcast(right) if right.count() <= BROADCAST_IDS else right, columns, f"left_{how}")


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(key, id, pivot): each set of every key that two sets or more have, one of which at least probes it; the pivot probes it."""
    probes, offers = (sets.select("id", F.explode(c).alias("key"), F.lit(c == "probes").alias("probe")) for c in ("probes", "offers"))
    rows = probes.unionByName(offers)
    pivot = F.min(F.when(F.col("probe"), F.col("id")))
    held = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), pivot.alias("pivot")).where("low < high AND pivot IS NOT NULL")
    # A key of very many sets is aggregated before its shuffle, and the join can be split by adaptive execution.
    held = stored(held.select("key", "pivot"), "shared")
    return stored(rows.select("id", "key").join(held, "key").select("key", "id", "pivot"), "keys")


def _forests(blocks: DataFrame, facts: DataFrame, label: str, n: int, num: int, den: int) -> DataFrame:
    """(a, b): the forests of blocks (block, side, id, label), by the members of their sets where facts have texts, else by sketches."""
    run = _edges(n, num, den, "text" in facts.columns)
    rows = blocks.join(facts, "id").repartition("block").sortWithinPartitions("block", "side", "id")
    found = stored(rows.mapInPandas(run, "a long, b long").distinct(), label)
    if "text" in facts.columns:
        forget(facts)
    return found


def _stars(ties: DataFrame, weighed: DataFrame) -> DataFrame:
    """Blocks of ties (pivot, id): a pivot on one side, some of its sets on the other."""
    met = ties.join(weighed, "id").withColumnRenamed("pivot", "p")
    parts = met.groupBy("p").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("parts"))
    rows = met.join(parts, "p").select("id", "p", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    name = F.xxhash64("p", "part").alias("block")
    sides = rows.select(name, F.lit(1).alias("side"), "id").unionByName(rows.select(name, F.lit(0).alias("side"), F.col("p").alias("id")).distinct())
    return sides.withColumn("label", F.col("id"))


def _untested(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, id, label, weight): sets that share a key and are in groups apart; without the pivot, which was tested with all.

    Of keys with the same sets (by 128 bits) one stays."""
    rows = shared.where("id <> pivot").select("key", "id").join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, "id")
    x, y = (F.bit_xor(F.xxhash64("id", F.lit(k))).alias(name) for k, name in ((1, "x"), (2, "y")))
    keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), x, y).where("low < high")
    return rows.join(stored(keys.groupBy("x", "y").agg(F.min("key").alias("key")), "mixed"), "key").drop("x", "y")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (key, id, label, weight): for each key, its largest group with the others, and these among themselves."""
    groups = rows.groupBy("key", "label").agg(F.sum("weight").alias("weight"))
    main = groups.groupBy("key").agg(F.max_by("label", F.struct("weight", "label")).alias("main"), F.max("weight").alias("large"), F.sum("weight").alias("whole"))
    parts = main.where("large < whole").select(
        "key", "main", F.ceil(F.col("large") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("whole") - F.col("large")) / BLOCK).cast("int").alias("others")
    )
    rows = rows.join(parts, "key").withColumn("own", F.col("label") == F.col("main"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("mains")).otherwise(F.col("others"))).cast("int"))

    def each(count: str, kind: str, i: Callable, j: Callable, side: Callable) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: F.struct(F.lit(kind).alias("kind"), i(k).alias("i"), j(k).alias("j"), side(k).alias("side")))

    at = F.col("at")
    with_main = F.when(F.col("own"), each("others", "m", lambda k: at, lambda k: k, lambda k: F.lit(0))).otherwise(each("mains", "m", lambda k: k, lambda k: at, lambda k: F.lit(1)))
    among = F.when(~F.col("own"), each("others", "o", lambda k: F.least(at, k), lambda k: F.greatest(at, k), lambda k: (at > k).cast("int")))
    dealt = rows.select("key", "id", "label", F.explode(F.concat(with_main, F.coalesce(among, F.array().cast("array<struct<kind:string,i:int,j:int,side:int>>")))).alias("b"))
    return dealt.select(F.xxhash64("key", "b.kind", "b.i", "b.j").alias("block"), "b.side", "id", "label")


def _with_groups(near: DataFrame, untested: DataFrame, groups: DataFrame) -> DataFrame:
    """near, and a link from each untested set to the label of its group, where a pair of near has a set of that group."""
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups.select("id", "label"), "id")
    met = stored(ends.select("label").distinct(), "met")
    own = _only(untested.select("id", "label"), met, ["label"], "semi").distinct()
    return stored(near.unionByName(own.select(F.col("label").alias("a"), F.col("id").alias("b"))), "reach")


def _grouped(ids: DataFrame, groups: DataFrame, to: str) -> DataFrame:
    """ids with the component of each, or itself."""
    return ids.join(groups.withColumnRenamed("component", to), "id", "left").withColumn(to, F.coalesce(to, "id"))


def linked_sets(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: links are num/den Jaccard of n-gram sets."""
    kind = "doc_id string, n_shingles long, id long, check long, sketch binary, probes array<long>, offers array<long>"
    made = short_batches(ids_as_text(docs.select("doc_id", "text"))).mapInPandas(_sets(n, num, den), kind)
    with_keys = stored(made.withColumn("doc_id", F.col("doc_id").cast("long")), "sets")
    names = ["id", "check", "n_shingles"]
    rows = stored(with_keys.drop("probes", "offers", "sketch"), "prints")
    total = rows.count()
    first = stored(gathered(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*names).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), total), "firsts")
    copies = rows.join(first.where("n > 1"), names).where("doc_id <> first_id").select("doc_id", "id")
    copies = stored(gathered(copies, total), "copies")
    single = _only(with_keys.where("n_shingles > 0 AND doc_id IS NOT NULL"), copies, ["doc_id", "id"], "anti")
    shared = _shared_keys(single)
    needed = stored(shared.select("id").distinct(), "needed")
    size = F.col("n_shingles").alias("size")
    facts = _only(single.select("id", size, "sketch"), needed, ["id"], "semi").dropDuplicates(["id"])
    facts = stored(gathered(facts, total), "facts")
    forget(with_keys)
    weighed = facts.select("id", (F.col("size") + OVERHEAD).alias("weight"))

    def texts(ids: DataFrame) -> DataFrame:
        """The texts of some sets."""
        where = _only(first.select("id", F.col("first_id").alias("doc_id")), ids, ["id"], "semi")
        held = _only(docs.select("doc_id", "text"), where, ["doc_id"], "semi").select("text")
        found = short_batches(held).mapInPandas(_texts(n), "id long, text string")
        return stored(found.groupBy("id").agg(F.max("text").alias("text")), "texts")

    def ends(edges: DataFrame) -> DataFrame:
        return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    ties = stored(shared.where("id <> pivot").select("pivot", "id").distinct(), "ties")
    near = _forests(_stars(ties, weighed), facts, "near", n, num, den)
    # A star's edges have the pivot first.
    stars = _stars(near.select(F.col("a").alias("pivot"), F.col("b").alias("id")), weighed)
    links = _forests(stars, texts(ends(near)), "links", n, num, den)
    groups = stored(_grouped(needed, components(links), "label").join(weighed, "id"), "groups")
    untested = stored(_untested(shared, groups), "untested")
    near = _forests(_blocks(untested), facts, "near", n, num, den)
    clusters = components(_with_groups(near, untested, groups)).withColumnRenamed("component", "key")
    blocks = stored(_blocks(clusters.join(groups, "id")), "blocks")
    more = _forests(blocks, texts(blocks), "links", n, num, den)
    # A document whose texts differ is in the groups of all of them.
    least = F.min("id").over(Window.partitionBy("doc_id"))
    same = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select(least.alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    final = components(stored(links.unionByName(more).unionByName(same), "all_links")).withColumnRenamed("component", "group")
    named = first.drop("n").join(final, "id", "left").withColumn("group", F.coalesce("group", "id"))
    named = stored(gathered(named, total), "named")
    least = named.groupBy("group").agg(F.min("first_id").alias("component"))
    named = stored(gathered(named.join(least, "group").select(*names, "component"), total), "components")
    out = rows.join(named, names, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents whose component has one of a smaller id; all rows without an id stay.

    Of rows that repeat an id, one stays for each distinct text: the least by its other columns, in their order."""
    links = stored(linked_sets(docs, n, num, den).select("doc_id", "component_id"), "linked")
    dropped = stored(links.where("component_id < doc_id").select("doc_id").distinct(), "dropped")
    repeated = stored(links.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "repeated")
    named = _only(docs.where("doc_id IS NOT NULL"), dropped, ["doc_id"], "anti").select(docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_"))
    copies = _only(named, repeated, ["doc_id"], "semi").groupBy("doc_id", "text").agg(F.min(rest).alias("r"))
    copies = copies.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"r.`{c}`") for c in docs.columns])
    single = _only(named, repeated, ["doc_id"], "anti").select(docs.columns)
    return single.unionByName(copies).unionByName(docs.where("doc_id IS NULL"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_sets(table(spark, sf_dir, "documents"))
