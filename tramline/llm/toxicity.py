"""Toxicity by weak supervision.

Voters are lexicon entries and patterns: words, and the first PREFIX bytes of words, that a bounded sample of
labelled training rows shows almost only in toxic documents, short lists of insults, two patterns (several
hits; a shouted hit), and the silence of all these. A voter fires or abstains. A generative label model has each fire
with one probability in toxic documents and another in clean ones. Its parameters come from the voters' means and
co-occurrences over all documents: the off-diagonal covariances are those of one hidden class, u u', wherever
voters are independent given it. Known labels are one voter more, whose covariances with the others are seen on the
labelled sample. Pairs that deviate are estimated as correlated, left out of the fit, and the weight of their voters is shared.
Targets are the model's posteriors, for labelled rows (with the vote of their label, GOLD reliable) and for as many unlabelled
rows, and nothing else; on them a linear classifier over the mined features is trained, which then scores every whole text.

The fit's two samples have MOST rows at most each; voters' statistics cover all documents and are summed by Spark (a
table of voters squared rows). Three scans of the texts; nothing else is shuffled.

Defined cases: null and empty texts have no features and get the score of the bias; a null id counts as an empty text where
crc32 deals rows to folds; repeated rows score alike, and rows that repeat an id each by their own text;
empty tables give an empty result (without labels all scores are the prior's); further columns,
and labels, lang, source and doc_id as inputs of a score, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import ids_as_text, lower_ascii, remainder, short_batches, table
from tramline.llm.labelled import labelled_sample, unlabelled_sample

#: Labelled rows for the fit (and unlabelled ones), features of the classifier and voters, at most; bytes of a word's stem.
MOST, FEATURES, VOTERS, PREFIX = 20_000, 1024, 64, 6
#: Reliability of a known label as a voter; how far above chance a mined term must be.
GOLD, SURE = 0.995, 3.0
# Insults, as voters that need no labels.
INSULTS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting",
    "fr": "idiote imbécile crétin salaud débile ordure",
    "de": "idiotin dumm arschloch abschaum trottel widerlich",
    "es": "idiota imbécil estúpido basura asqueroso inútil",
}
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_"


def terms(raw: bytes) -> set[bytes]:
    """Distinct words without marks at their ends, and stems (a mark, then the first PREFIX bytes)."""
    words = {w.strip(_EDGE) for w in set(raw.split())}
    words |= {b"\x00" + w[:PREFIX] for w in words if len(w) > PREFIX}
    words.discard(b"")
    return words


def _mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, bad = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.text, batch.label, strict=True):
            found = terms(lower_ascii(text))
            seen.update(found)
            if label:
                bad.update(found)
        if len(seen) > 300_000:
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "bad": [bad[t] for t in seen]})
            seen, bad = Counter(), Counter()
    yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "bad": [bad[t] for t in seen]})


def mined(sample: DataFrame, features: int) -> tuple[list[bytes], int, int]:
    """Terms that speak for a toxic text (most telling first), and the sample's rows and toxic rows.

    A term must be SURE standard deviations above chance and four times in five in toxic texts; words whose
    stem is such a term are left to it."""
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = short_batches(sample).mapInPandas(_mined, "term binary, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = max(bad, 1) / max(n, 1)
    expected = F.col("n") * rate
    gain = (F.col("bad") - expected) / F.sqrt(expected * (1 - min(rate, 0.99)) + 1)
    sure = counts.where("n >= 3").withColumn("gain", gain).where(F.col("gain") >= SURE).where("bad >= 0.8 * n")
    found = [bytes(r.term) for r in sure.orderBy(F.desc("gain"), "term").limit(features).collect()]
    stems = {t for t in found if t[:1] == b"\x00"}
    return [t for t in found if t in stems or b"\x00" + t[:PREFIX] not in stems or len(t) <= PREFIX], n, bad


class Voters:
    """Who votes, and which: single features, the lists of insults, several hits, a shouted hit, silence of the others."""

    def __init__(self, features: list[bytes], most: int) -> None:
        self.features = {t: k for k, t in enumerate(features)}
        self.lists = [{lower_ascii(w) for w in x.split()} for x in INSULTS.values()]
        self.single = {t: k for k, t in enumerate(features[: most - len(self.lists) - 3])}
        self.count = len(self.single) + len(self.lists) + 3

    def votes(self, text: str | None) -> tuple[list[int], list[int]]:
        """Numbers of the voters that fire, and of the features that are there."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        found = terms(raw.lower())
        active = [self.features[t] for t in self.features.keys() & found]
        fired = [self.single[t] for t in self.single.keys() & found]
        several, first = len(fired) > 1, len(self.single)
        if fired and any(t[:1] != b"\x00" and t.upper() in raw for t in self.single.keys() & found if len(t) > 3):
            fired.append(first + len(self.lists) + 1)
        fired += [first + k for k, words in enumerate(self.lists) if words & found]
        if several:
            fired.append(first + len(self.lists))
        return sorted(fired) or [self.count - 1], sorted(active)


def _moments(voters: Voters) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = voters.count
        both, rows = np.zeros((k, k), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.text:
                fired = voters.votes(text)[0]
                if fired:
                    both[np.ix_(fired, fired)] += 1
        i, j = np.nonzero(both)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], rows)})

    return run


def label_model(both: np.ndarray, n: int, prior: float, gold: np.ndarray | None = None, passes: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(fire | toxic), P(fire | clean) and each voter's weight, from co-occurrence counts over n documents.

    gold: each voter's covariance with the known label, where there are labels. The hidden class has this prior."""
    mean = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    use = ~np.eye(len(mean), dtype=bool)
    known = (2 * GOLD - 1) * np.sqrt(prior * (1 - prior)) if gold is not None else 0.0
    from_gold = known * gold if gold is not None else np.zeros(len(mean))
    u = 0.3 * spread if gold is None else from_gold / known**2
    for _ in range(passes):
        for _ in range(50):
            u = (u + ((use * cov) @ u + from_gold) / np.maximum(use @ (u * u) + known**2, 1e-15)) / 2
            u = np.maximum(u, 0) if gold is None else u
        left = np.abs(cov - np.outer(u, u)) / np.outer(spread, spread)
        usual = 4 * np.median(left[use]) + 0.05 if use.any() else 1
        use = (left < usual) & ~np.eye(len(mean), dtype=bool)
    linked = (left >= usual) & ~np.eye(len(mean), dtype=bool)
    weight = 1 / (1 + np.where(linked, np.minimum(left, 1), 0).sum(1))
    gap = u / np.sqrt(prior * (1 - prior))
    least = 1 / max(n, 100)
    fires, rests = mean + (1 - prior) * gap, mean - prior * gap
    return np.clip(fires, least, 1 - 1e-4), np.clip(rests, least, 1 - 1e-4), weight


def posteriors(fired: list[list[int]], labels: np.ndarray, prior: float, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability of the toxic class for each row's votes; labels are 1, 0 or -1 (unknown). Voters that do not fire abstain."""
    fires, rests, weight = model
    votes = weight * np.log(fires / rests)
    gold = np.log(GOLD / (1 - GOLD)) * np.select([labels == 1, labels == 0], [1.0, -1.0], 0.0)
    odds = np.log(prior / (1 - prior)) + gold + np.array([votes[f].sum() for f in fired])
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def linear(rows: list[list[int]], target: np.ndarray, features: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier over binary features, fitted to soft labels."""
    at = np.concatenate([np.full(len(r), k) for k, r in enumerate(rows)]) if rows else np.empty(0)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0)
    at, col = at.astype(np.int64), col.astype(np.int64)
    w, n = np.zeros(features), max(len(rows), 1)
    p = float(np.clip(target.mean() if len(target) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, w[col], minlength=len(rows))[: len(rows)]
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(col, e[at], minlength=features) / n + 1e-5 * w, e.sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def _voted(voters: Voters) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [voters.votes(t) for t in batch.text]
            yield pd.DataFrame({"fired": [g[0] for g in got], "active": [g[1] for g in got], "label": batch.label.to_numpy()})

    return run


def _scorer(features: list[bytes], w: np.ndarray, bias: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = dict(zip(features, w.tolist(), strict=True))
        known = weight.keys()
        for batch in batches:
            z = np.array([bias + sum(weight[t] for t in sorted(known & terms(lower_ascii(x)))) for x in batch.text])
            yield batch.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return run


def fitted(docs: DataFrame, labels: DataFrame, usable: Callable, most: int = MOST) -> tuple[list[bytes], np.ndarray, float]:
    """Features, weights and bias of the classifier; usable(doc_id) says which labels may be learnt from."""
    sample = labelled_sample(docs, labels, "toxic", usable, most)
    features, n, bad = mined(sample, FEATURES)
    voters = Voters(features, VOTERS)
    prior = float(np.clip(bad / max(n, 1), 0.01, 0.5))
    seen = short_batches(docs.select("text")).mapInPandas(_moments(voters), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((voters.count, voters.count)), 0
    for r in seen:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = r.n
    known = sample.select("text", "label").unionByName(unlabelled_sample(docs, labels, "toxic", most).select("text", F.lit(-1).alias("label")))
    rows = known.mapInPandas(_voted(voters), "fired array<int>, active array<int>, label int").collect()
    label = np.array([r.label for r in rows], np.int64)
    target = posteriors([r.fired for r in rows], label, prior, label_model(both, total, prior, gold_covariance(rows, voters.count)))
    w, bias = linear([r.active for r in rows], target, max(len(features), 1))
    return features, w[: len(features)], bias


def gold_covariance(rows: list, count: int) -> np.ndarray | None:
    """Each voter's covariance with the label, over the labelled rows; None where there is none of a class."""
    fired, labels = np.zeros((2, count)), np.zeros(2)
    for r in rows:
        if r.label >= 0:
            labels[r.label] += 1
            fired[r.label, r.fired] += 1
    if not labels.all():
        return None
    share = labels[1] / labels.sum()
    return share * (1 - share) * (fired[1] / labels[1] - fired[0] / labels[0])


def scored(docs: DataFrame, labels: DataFrame, usable: Callable) -> DataFrame:
    """doc_id and score of every document: 0 to 1, higher for likelier toxic."""
    features, w, bias = fitted(docs, labels, usable)
    made = short_batches(ids_as_text(docs.select("doc_id", "text"))).mapInPandas(_scorer(features, w, bias), "doc_id string, score double")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; learns from all labels, as a pipeline may. Columns pass as they are."""
    features, w, bias = fitted(docs, labels, lambda _: F.lit(True))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scorer(features, w, bias)
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column(at).to_pylist()})
            yield batch.filter(pa.array(next(judge(iter([texts]))).score.to_numpy() < 0.5))

    return short_batches(docs).mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = scored(docs, labels, lambda i: remainder(i, 5) != 0)
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
