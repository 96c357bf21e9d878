"""Personal data: weak-supervision aggregation of regex, gazetteer and context labelers.

Candidates are the base matches (email, ip, card, phone) and looser ones: digit runs that fail the Luhn or
length test, dotted quads out of range, telephone numbers without a plus, addresses spelled with "at" and
"dot". Five labelers vote on each: the strict pattern's test, the shape, a gazetteer of words before the
span that speak for the kind, one of words that speak against it, and whether the span stands by itself.
Expectation-maximisation over the counts of vote patterns, for each kind, gives the labelers' reliabilities and each
pattern's posterior. A logistic span classifier is trained on those posteriors; it does not see the votes but a span's
own traits: its length, digits, groups and marks, what stands beside it, and the words before it. Looser candidates that it
scores SURE or more are added; base spans always stay.

Everything that touches rows is built-in expressions on the whole text; only the table of counts by votes and traits (kinds
times 2^(5 + traits) rows at most) goes to the driver. Texts are scanned once, candidates are kept as a small table.

A match's place comes from splitting the text at the pattern: the pieces and matches before it sum to its
start. Card separators are first turned into one mark, so that long digit runs need no nested repetition.

Defined cases: a null or empty text has no spans; repeated rows are judged alike, and rows that repeat an id each by their own
text; an empty table gives an empty result; further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import let, stored, table

KINDS = ("email", "ip", "card", "phone")
SURE = 0.95
#: Matches of a text whose places are summed in one go; more are summed in parts, so work does not grow with their square.
PART = 256
#: Code points before a span that the gazetteers look at.
NEAR = 24

#: A run of an address's characters can only match from its first one, or from where the match before ended in mid-run:
#: all later places meet the same end of the run. So a long run is read once, not once from each of its characters.
BEGINS = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
EMAIL = BEGINS + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "[0-9][0-9\x01]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = BEGINS + r"[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++"
NATIONAL = r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Words that, shortly before a span, speak for its kind, and against its being personal.
FOR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|client|adresse)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)\b(version|licen[cs]e|isbn|order|invoice|id|no|nr|token|release|build)\b"


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, m) of the pattern's leftmost matches in the text."""
    kind = "array<struct<start:int,end:int,m:string>>"

    def summed(lengths: Column) -> Column:
        """Places of the matches, given the length before each: in parts of PART, each from where it begins."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int")), lambda c: F.slice(lengths, c * PART + 1, F.lit(PART)))
        wide = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["p"] + F.length(x["m"]))
        first = F.aggregate(F.transform(parts, wide), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["p"]
            end = start + F.length(x["m"])
            new = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

        def placed(part: Column, at: Column) -> Column:
            return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

        return let(parts, lambda ps: let(first, lambda at: F.flatten(F.transform(ps, lambda part, c: placed(part, F.get(at, c))))))

    def from_pieces(pieces: Column, matches: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
        return let(lengths, summed)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(from_pieces(F.split(text, pattern, -1), m)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def _strict(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return _small_parts(m)
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _shaped(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|io)$|dot[\])]")
    if kind == "ip":
        return F.length(m).between(7, 15)
    if kind == "card":
        return F.length(_digits(m)).isin(13, 15, 16)
    return F.length(_digits(m)).between(10, 12)


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,votes:int,traits:int>>"
#: Traits of a span that the classifier sees, as bits in this order.
TRAITS = ("valid", "short", "long", "grouped", "bracketed", "begins", "labelled", "speaks_for", "speaks_against", "joined", "closes")


def _bits(tests: tuple[Column, ...]) -> Column:
    return sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(tests)), F.lit(0))


def _spans(text: Column, kind: str, pattern: str, loose: bool = False, shown: Column | None = None) -> Column:
    """Candidates of a kind as structs: start, kind number, end, base, votes (one bit for each labeler) and traits (one bit each).

    shown: the text as the reader sees it, where `text` has marks in it."""
    # Four bytes a code point: what stands beside a span is then cut out without a walk from the text's start.
    wide = F.encode(text if shown is None else shown, "UTF-32")

    def cut(bytes_: Column, first: Column, count: Column) -> Column:
        return F.decode(F.substring(bytes_, first * 4 + 1, count * 4), "UTF-32")

    def judged(bytes_: Column, x: Column) -> Column:
        base = F.lit(False) if loose else _strict(kind, x["m"])
        before = cut(bytes_, F.greatest(F.lit(0), x["start"] - NEAR), F.least(x["start"], F.lit(NEAR)))
        after = cut(bytes_, x["end"], F.lit(1))

        def described(b: Column, before: Column) -> Column:
            left_free, right_free = ~before.rlike(r"[\p{L}\p{N}_@-]$"), ~after.rlike(r"[\p{L}\p{N}_@]")
            speaks, against = before.rlike(FOR[kind]), before.rlike(AGAINST)
            votes = _bits((b, _shaped(kind, x["m"]), speaks, ~against, left_free & right_free, F.lit(loose)))
            size = F.length(x["m"])
            traits = _bits((
                b, size < 12, size > 18, x["m"].rlike("[0-9][\x01\x20-][0-9]+[\x01\x20.-][0-9]|^[^@\\[(]*?[A-Za-z][._][A-Za-z]"), x["m"].rlike(r"[()\[\]]"),
                x["m"].rlike("^[+A-Za-z]"), before.rlike(r"[:=]\s*$"), speaks, against, ~left_free, after.rlike(r"^[.,;\s]?$"),
            ))
            return F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), b.alias("base"), votes.alias("votes"), traits.alias("traits")
            )

        return let(F.struct(base.alias("b"), before.alias("t")), lambda d: described(d["b"], d["t"]))

    return let(_places(text, pattern), lambda found: F.when(F.size(found) > 0, let(wide, lambda b: F.transform(found, lambda x: judged(b, x)))).otherwise(F.array().cast(SPANS)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text) and spans (start, kind, end, base, votes, traits), looser ones included, sorted."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")
    none = F.array().cast(SPANS)
    some = lambda test, spans: F.when(test, spans).otherwise(none)
    found = F.concat(
        some(F.contains(text, F.lit("@")), _spans(text, "email", EMAIL)),
        some(text.rlike(r"[0-9]\.[0-9]"), _spans(text, "ip", IP)),
        some(text.rlike("[0-9]"), let(marked, lambda t: _spans(t, "card", CARD, shown=text))),
        some(F.contains(text, F.lit("+")), _spans(text, "phone", PHONE)),
        some(text.rlike(r"[\[(]at[\])]"), _spans(text, "email", SPELLED, loose=True)),
        some(text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), _spans(text, "phone", NATIONAL, loose=True)),
    )
    worth = F.filter(found, lambda s: s["base"] | (s["kind"] != 2) | (s["end"] - s["start"]).between(13, 23))
    return rows.select("doc_id", F.xxhash64("text").alias("print"), F.array_sort(worth).alias("spans"))


#: In a pattern of votes: the strict test abstains, as the candidate is of a looser pattern that it does not know.
ABSTAINS = 1 << 5
#: What is held of the strict test beforehand, P(vote | true) and P(vote | false), with this share of the candidates as its weight.
STRICT, HELD = (0.95, 0.15), 0.2


def _votes(pattern: int, labelers: int) -> list[tuple[int, bool]]:
    """(labeler, vote) of those that do not abstain."""
    return [(k, bool(pattern >> k & 1)) for k in range(1 if pattern & ABSTAINS else 0, labelers)]


def reliabilities(counts: dict[int, float], labelers: int = 5, rounds: int = 60) -> tuple[float, list[float], list[float]]:
    """Expectation-maximisation for one kind: share of true spans, and P(vote | true), P(vote | false).

    counts: how many candidates have a pattern of votes. Votes alone do not tell which class is the true one, so
    the strict test (labeler 0) has a prior."""
    soft = {p: 0.5 if p & ABSTAINS else 0.95 if p & 1 else 0.1 for p in counts}
    share, yes, no = 0.5, [0.5] * labelers, [0.5] * labelers
    total = sum(counts.values())
    for _ in range(rounds):
        true = sum(soft[p] * n for p, n in counts.items())
        share = (true + 1) / (total + 2)
        for k in range(labelers):
            cast = [(soft[p] * n, (1 - soft[p]) * n, vote) for p, n in counts.items() for j, vote in _votes(p, labelers) if j == k]
            held = 1 + HELD * total if k == 0 else 2.0
            for side, out, before in ((0, yes, STRICT[0]), (1, no, STRICT[1])):
                hit, all_ = sum(c[side] for c in cast if c[2]), sum(c[side] for c in cast)
                out[k] = (hit + held * (before if k == 0 else 0.5)) / (all_ + held)
        soft = {p: posterior(p, share, yes, no) for p in counts}
    return share, yes, no


def posterior(pattern: int, share: float, yes: list[float], no: list[float]) -> float:
    odds = math.log(share / (1 - share))
    for k, vote in _votes(pattern, len(yes)):
        odds += math.log(yes[k] / no[k]) if vote else math.log((1 - yes[k]) / (1 - no[k]))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def trained(counts: dict[tuple[int, int], float], labelers: int = 5, traits: int = len(TRAITS), steps: int = 600) -> list[float]:
    """Weights (bias first) of a logistic classifier over traits, fitted to the posteriors of the votes.

    counts: how many candidates have a pattern of votes and a pattern of traits."""
    by_votes: dict[int, float] = {}
    by_traits: dict[int, list[float]] = {}
    for (votes, _), n in counts.items():
        by_votes[votes] = by_votes.get(votes, 0) + n
    share, yes, no = reliabilities(by_votes, labelers)
    for (votes, pattern), n in counts.items():
        sums = by_traits.setdefault(pattern, [0.0, 0.0])
        sums[0] += n
        sums[1] += n * posterior(votes, share, yes, no)
    total = sum(by_votes.values())
    rows = [([1.0, *(float(p >> k & 1) for k in range(traits))], y / n, n / total) for p, (n, y) in sorted(by_traits.items())]
    w = [0.0] * (traits + 1)
    for _ in range(steps):
        slope = [1e-4 * x for x in w]
        for x, y, n in rows:
            z = max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))
            e = (1 / (1 + math.exp(-z)) - y) * n
            slope = [s + e * v for s, v in zip(slope, x, strict=True)]
        w = [a - 2.0 * s for a, s in zip(w, slope, strict=True)]
    return w


def classifiers(found: DataFrame) -> dict[int, list[float]]:
    """Weights for each kind, from the counts of votes and traits over all candidates."""
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.traits").agg(F.count("*").alias("n")).collect()
    by_kind: dict[int, dict[tuple[int, int], float]] = {}
    for r in seen:
        by_kind.setdefault(r.kind, {})[r.votes, r.traits] = r.n
    return {kind: trained(counts) for kind, counts in by_kind.items()}


def accepted(found: DataFrame) -> DataFrame:
    """doc_id, print, base (spans) and spans (with what the classifier adds, apart from what base spans cover)."""
    weights = classifiers(found)

    def score(s: Column) -> Column:
        out = F.lit(-50.0)
        for kind, w in sorted(weights.items()):
            z = sum((F.lit(x) * F.shiftright(s["traits"], k).bitwiseAND(F.lit(1)) for k, x in enumerate(w[1:])), F.lit(w[0]))
            out = F.when(s["kind"] == kind, z).otherwise(out)
        return 1 / (1 + F.exp(-out))

    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: ~s["base"] & (score(s) >= SURE))
    rows = found.select("doc_id", "print", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "print", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every accepted span replaced by <KIND>; n_chars follows the new text where it is a column.

    Spans are found again by a document's id and text. Spans that overlap are one, of the kind that begins first."""
    found = accepted(stored(candidates(docs), "candidates")).where(F.size("spans") > 0).select("doc_id", "print", F.explode("spans").alias("s"))
    text_order = Window.partitionBy("doc_id", "print").orderBy("s.start", "s.kind", "s.end")
    reach = F.max("s.end").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("s.start") >= reach, F.lit(True)).cast("int")
    whole = found.distinct().withColumn("new", new).withColumn("part", F.sum("new").over(text_order))
    whole = whole.groupBy("doc_id", "print", "part").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"), F.min_by("s.kind", F.struct("s.start", "s.kind")).alias("kind"))
    spans = whole.groupBy("doc_id", "print").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    spans = stored(spans, "spans").withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    joined = docs.select(F.struct("*").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    joined = joined.join(spans, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    text, mark = F.col("d.text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def kept(s: Column, i: Column) -> Column:
        """What stands between the span before and this one, and its mark."""
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
        return F.concat(F.substring(text, before + 1, s["start"] - before), F.get(mark, s["kind"]))

    rest = F.substring(text, F.element_at("spans", -1)["end"] + 1, F.length(text))
    clean = F.concat(F.array_join(F.transform("spans", kept), ""), rest)
    out = joined.select("d", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("text"))
    new_columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new_columns[c] if c in new_columns else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(candidates(table(spark, sf_dir, "documents")), "candidates")
    rows = accepted(found)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
