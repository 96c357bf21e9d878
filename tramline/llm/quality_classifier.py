"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse random index vector that follows from its hash alone. Word vectors are kept for BUCKETS rows, half of them for hashes of whole words and
half for those of their last three bytes (which tell shape and script): a row's vector is the sum of the index vectors of the neighbouring words (two on either
side) over all places of its words in the corpus. The sums are taken in Spark: each task adds up its own table of fixed size, tables are cut into CHUNKS and added chunk by
chunk as they stream in, so neither memory nor what reaches the driver (one table) grows with the corpus. A row for each word was built and measured; see the README.

A document is the mean of its words' unit vectors, for whole words and endings, and four measures of the text
(words, distinct share, letters' case, marks). A network of two layers learns from a bounded sample of
MOST labelled rows; a fifth of it sets the temperature that calibrates its probabilities. Two scans.

Defined cases: null and empty texts pool to zero and are scored as such; a null id counts as an empty text where crc32 deals
rows to folds; repeated rows score alike, and rows that repeat an id each by their own text; empty
tables give an empty result (without labels all scores are 0.5); further columns, and labels, lang, source
and doc_id as inputs of a score, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import hashed_words, ids_as_text, mix64, remainder, short_batches, table
from tramline.llm.labelled import labelled_sample

BUCKETS, DIM, CHUNKS, MOST, HIDDEN, SEED = 8192, 32, 64, 20_000, 32, 20
_PAD = b"  "


def index_vectors(h: np.ndarray) -> np.ndarray:
    """A sparse row for each word's hash: four places (which may coincide) are raised or lowered by 1."""
    out = np.zeros((len(h), DIM), np.int16)
    each, bits = np.arange(len(h)), mix64(h ^ np.uint64(SEED))
    for k in range(4):
        part = bits >> np.uint64(16 * k)
        out[each, (part & np.uint64(DIM - 1)).astype(np.int64)] += np.where(part & np.uint64(1 << 10), 1, -1).astype(np.int16)
    return out


def word_rows(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words (first half of the table) and of their last three bytes (second half), and the words' hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    h, _ = hashed_words(raw)
    half = np.uint64(BUCKETS // 2)
    whole = (h % half).astype(np.int64)
    b = np.frombuffer(_PAD + raw + b" ", np.uint8).astype(np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    last = np.flatnonzero(~space[:-1] & space[1:])
    code = b[last] | np.where(space[last - 1], 0, b[last - 1]) << 8 | np.where(space[last - 1] | space[last - 2], 0, b[last - 2]) << 16
    ends = (mix64(code.astype(np.uint64)) % half).astype(np.int64) + BUCKETS // 2
    return whole, ends, h


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BUCKETS, DIM))

    def add(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        gap = np.full(2, BUCKETS)
        whole, ends = (np.concatenate([x for r in rows for x in (r[k], gap)]) for k in (0, 1))
        words, at = np.unique(np.concatenate([h for _, _, h in rows]), return_inverse=True)
        index = np.concatenate((index_vectors(words), np.zeros((1, DIM), np.int16)))
        line = np.full(len(whole) + 2, len(words))
        line[2:][whole < BUCKETS] = at
        v = index[line]
        near = v[:-4] + v[1:-3] + v[3:-1] + v[4:]
        n = len(near)
        for place in (whole[:n], ends[:n]):
            for d in range(DIM):
                total[:, d] += np.bincount(place, near[:, d], minlength=BUCKETS + 1)[:BUCKETS]

    for batch in batches:
        rows, size = [], 0
        for text in batch.text:
            rows.append(word_rows(text))
            size += len(rows[-1][0])
            if size > 200_000:
                add(rows)
                rows, size = [], 0
        if rows:
            add(rows)
    step = BUCKETS // CHUNKS
    yield pd.DataFrame({"chunk": range(CHUNKS), "sums": [total[k * step : (k + 1) * step].tobytes() for k in range(CHUNKS)]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.chunk, batch.sums, strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, np.float64)
    yield pd.DataFrame({"chunk": list(sums), "sums": [v.tobytes() for v in sums.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all rows, centred, from the contexts in all texts."""
    kind = "chunk int, sums binary"
    parts = short_batches(docs.select("text")).mapInPandas(_contexts, kind)
    sums = parts.repartition(CHUNKS, "chunk").mapInPandas(_added, kind).collect()
    table_ = np.zeros((BUCKETS, DIM))
    step = BUCKETS // CHUNKS
    for r in sums:
        table_[r.chunk * step : (r.chunk + 1) * step] += np.frombuffer(r.sums, np.float64).reshape(step, DIM)
    table_ /= np.maximum(np.linalg.norm(table_, axis=1, keepdims=True), 1e-9)
    return (table_ - table_.mean(0)).astype(np.float32)


def features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    whole, ends, _ = word_rows(text)
    out = np.zeros(2 * DIM + 4, np.float32)
    if not len(whole):
        return out
    share = len(np.unique(whole)) / min(len(whole), BUCKETS // 2)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = ((b >= 65) & (b <= 90)).mean()
    marks = (((b > 32) & (b < 48)) | ((b > 57) & (b < 65)) | ((b > 122) & (b < 127))).mean()
    out[:DIM] = np.bincount(whole, minlength=BUCKETS // 2) @ vectors[: BUCKETS // 2] / len(whole)
    out[DIM : 2 * DIM] = np.bincount(ends - BUCKETS // 2, minlength=BUCKETS // 2) @ vectors[BUCKETS // 2 :] / len(ends)
    out[2 * DIM :] = np.log1p(len(whole)), share, upper, marks
    return out


class Network:
    """Two layers with tanh between; probabilities are divided by a temperature set on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60) -> None:
        rng = np.random.default_rng(SEED)
        width = x.shape[1]
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
        self.a, self.b = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN)
        self.c, self.d, self.heat = np.zeros(HIDDEN), np.zeros(1), 1.0
        order = rng.permutation(len(x))
        held, fit = order[: len(x) // 5], order[len(x) // 5 :]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.a, self.b, self.c, self.d)]
        step = 0
        for _ in range(epochs if len(np.unique(y)) > 1 else 0):
            rng.shuffle(fit)
            for first in range(0, len(fit), 256):
                rows = fit[first : first + 256]
                z = (x[rows] - self.mean) / self.spread
                h = np.tanh(z @ self.a + self.b)
                e = (1 / (1 + np.exp(-np.clip(h @ self.c + self.d, -50, 50))) - y[rows]) / len(rows)
                back = np.outer(e, self.c) * (1 - h * h)
                step += 1
                grads = (z.T @ back + 1e-4 * self.a, back.sum(0), h.T @ e + 1e-4 * self.c, e.sum(keepdims=True))
                for p, g, (m, v) in zip((self.a, self.b, self.c, self.d), grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(held) and step:
            z, t = self.logits(x[held]), y[held]
            loss = {k: np.logaddexp(0, np.where(t == 1, -z, z) / k).mean() for k in np.geomspace(0.25, 8, 41)}
            self.heat = float(min(loss, key=loss.get))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.a + self.b) @ self.c + self.d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -50, 50)))


def _pooled(vectors: np.ndarray) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, vectors).tobytes() for t in batch.text], "label": batch.label.to_numpy()})

    return run


def _scorer(vectors: np.ndarray, network: Network) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t, vectors) for t in batch.text]).reshape(len(batch), -1)
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": network.scores(x) if len(x) else []})

    return run


def scored(docs: DataFrame, labels: DataFrame, usable: Callable) -> DataFrame:
    """doc_id and score of every document: 0 to 1, higher for likelier good."""
    vectors = word_vectors(docs)
    sample = labelled_sample(docs, labels, "quality", usable, MOST)
    rows = short_batches(sample).select("text", "label").mapInPandas(_pooled(vectors), "x binary, label int").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIM + 4)
    network = Network(x, np.array([r.label for r in rows], np.float64))
    made = short_batches(ids_as_text(docs.select("doc_id", "text"))).mapInPandas(_scorer(vectors, network), "doc_id string, score double")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = scored(docs, labels, lambda i: remainder(i, 3) != 1)
    return rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
