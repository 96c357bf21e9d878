"""Fill-in-the-middle: texts cut at two line borders and put together again with sentinels, by big-integer bit-parallelism.

A text's UTF-8 bytes become one whole number for each class of bytes: bytes.translate writes a digit 0 or 1 for every byte, and the
digits are read as binary, the text's first byte as the lowest bit. The mask of line feeds, shifted by one, marks where lines
begin; its bit_count is the number of lines, and the place of the k-th line is found by halving: the low half's count tells in which half
it lies. Code points of a part are the bits of the mask of bytes that begin one, below a place.

Lines are `[^\n]*\n|[^\n]+`. Two hashes of the seed and the id choose the borders, the others the form: plain (the text as it is), psm
(prefix, suffix, middle) or spm (suffix, prefix, middle). What is made can be undone exactly: no part holds a sentinel, nor can one arise where a part
meets a sentinel, as a sentinel's first character is none of its others.

Texts go to Python once, with no shuffle; memory is a few times the longest text. Defined cases: a null text is empty, and plain; a null id reads as nothing
in what is hashed; repeated rows are equal; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import short_batches, table, trimmed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50

#: For bytes.translate: a digit for each byte.
_FEEDS = bytes(49 if b == 10 else 48 for b in range(256))
_BEGINS = bytes(48 if 128 <= b < 192 else 49 for b in range(256))


def mask(raw: bytes, digits: bytes) -> int:
    """The bytes of a class as one number: bit i for byte i."""
    return int(raw.translate(digits)[::-1], 2) if raw else 0


def line_starts(raw: bytes) -> int:
    """The first byte of every line: byte 0 and whatever follows a line feed."""
    return (mask(raw, _FEEDS) << 1 | 1) & ((1 << len(raw)) - 1)


def ranked(bits: int, k: int, width: int) -> int:
    """Place of the k-th (from 0) of a number's bits that are 1; its width where there are no more."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - below, at + half, width - half
    return at


def below(bits: int, place: int) -> int:
    return (bits & ((1 << place) - 1)).bit_count()


def transformed(text: str, doc_id: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, code points of prefix and middle (none where plain), and the text that is made."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = line_starts(raw)
    n = starts.bit_count()
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(found[8 * i : 8 * i + 8], 16) for i in range(4))
    if not raw or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ranked(starts, k, len(raw)) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    begins = mask(raw, _BEGINS)
    p, m = below(begins, a), below(begins >> a, b - a)
    prefix, middle, suffix = (part.decode("utf-8", "surrogatepass") for part in (raw[:a], raw[a:b], raw[b:]))
    if h4 % 100 < spm:
        return n, "spm", p, m, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", p, m, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def _run(seed: int, rate: int, spm: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *transformed(t or "", d or "", seed, rate, spm)) for d, t in zip(batch.doc_id, batch.text, strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            # Whole numbers beside nulls; pandas would make them floats.
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return trimmed(run)


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each document; rate of 100 are cut, and spm of 100 of those begin with the suffix."""
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"
    made = short_batches(rows).mapInPandas(_run(seed, rate, spm), kind)
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def restored(output: Column, form: Column) -> Column:
    """The text that a row was made from, out of its output and form alone."""
    parts = F.split(F.substring(output, 4, 2147483647), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilled(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
y AS (SELECT *, CASE WHEN text = '' OR h3 % 100 >= {RATE} OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
z AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM z"""
