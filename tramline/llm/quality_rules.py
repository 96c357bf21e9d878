"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the row's own text, so the job is one scan with neither a
shuffle nor a Python function, and a text's work grows as its length (times a logarithm for sorting).

Defined cases: a null text counts as empty (all measures 0, base_failed true as there are fewer than 50
words); repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
Equality of three-word windows is that of their 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import GAP, let, table, words_of

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by from at or an a "
    "le la les de des et en un une du que qui dans pour par sur au avec "
    "der die das und den von zu mit sich auf für im ist nicht ein eine "
    "el los las y del se por con para una lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if measure / per lies outside [low, high]; one with nothing to divide by passes."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 0.2),
    Rule("upper_case", "n_upper", "word_chars", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more."""

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = let(
            placed,
            lambda s: F.filter(
                F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered(h))

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), count))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and every measure, all from the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    white = " \t\n\x0b\x0c\r"
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), white).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_exclaims"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, Column]]:
    """One boolean expression for each rule: true where a document fails it."""
    out = []
    for r in rules:
        value, per = F.col(r.measure).cast("double"), F.col(r.per)
        low = value < F.lit(r.low) * per if r.low is not None else F.lit(False)
        high = value > F.lit(r.high) * per if r.high is not None else F.lit(False)
        out.append((r.name, (per > 0) & (low | high)))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed, kept and failed_rules (the names of the rules that a document fails)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in compiled(rules)]), lambda x: x.isNotNull())
    rows = measured(docs).withColumns({"base_failed": base, "failed_rules": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        tests += [f"({r.per} > 0 AND {r.measure} < {r.low} * {r.per})"] if r.low is not None else []
        tests += [f"({r.per} > 0 AND {r.measure} > {r.high} * {r.per})"] if r.high is not None else []
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{r"[^\x20\x09-\x0D]+"}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{r"[^\x20\x09-\x0D]"}')) AS ls FROM t),
g AS (SELECT r, i, ws[i] || chr(32) || ws[i+1] || chr(32) || ws[i+2] AS k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM p, (VALUES (0), (1), (2)) AS x(o) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '{GAP}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(text) - length(replace(text, '!', '')) AS n_exclaims,
             length(regexp_replace(text, '{r"\P{Lu}+"}', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(ls) AS n_lines
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept FROM b"""


ORACLE_SQL = _sql()
