"""URL filters: a sort-merge range join of urls with rules.

Host labels are reversed (a.example.net becomes net, example, a, each with a closing mark), so all subdomains of a rule's host lie in
one interval of the sorted keys (host, then path). Urls and rules are cut at quantiles of the keys; within a cut, a sweep in
key order keeps a stack of the rules whose interval is open. Such intervals nest or are apart, so the stack
holds just the rules of the current host's ancestors. A rule that spans cuts is sent to each of them.

Cuts grow with the number of distinct urls, URLS each. A cut of one host with more urls than that is still one task, but of short rows.

Only distinct (host, path) pairs are swept, after partial aggregation, so one url on a third of all rows
is one row here; the verdicts go back to the rows by an equi join, which adaptive execution can split.

Defined cases: a null url or one without :// has empty host and path and matches no rule; repeated page ids
are judged each; an empty table or rule set gives an empty result or the default verdict; further columns
are ignored. Of the rules that fit, the longest text host + path wins, then the longer host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import let, stored, table

# The base rules (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Labels of hosts that the method itself blocks where no rule fits.
BAD_LABELS = ("spam", "pills", "casino", "porn", "viagra", "payday", "lottery")
#: Distinct urls of a cut, about; most cuts; keys sampled for each.
URLS, MOST_CUTS, SAMPLED = 200_000, 4096, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    """Labels from the top domain down, each with a closing mark that sorts below every label character.

    A mark that is part of a host is written as two other characters, so that no label is taken for two."""
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x01"), F.lit("\x01"))


def _above(key: Column) -> Column:
    """The least key above the subtree of a host's key: its last closing mark raised by one."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("\x02"))


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one cut in key order: rule rows (kind 0) come before urls of the same key."""
    stack: list[tuple[str, list[tuple[int, int, str, str, str]]]] = []
    for batch in batches:
        out = []
        for key, kind, host, path, verdict in zip(batch.key, batch.kind, batch.host, batch.path, batch.verdict, strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((len(host) + len(path), len(host), path, host + path, verdict))
                continue
            fits = [r for _, rules in stack for r in rules if path.startswith(r[2])]
            best = max(fits, default=None)
            out.append((host, path, best and best[3], best and best[4]))
        yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])


def matched(urls: DataFrame, rules: DataFrame, each: int = URLS) -> DataFrame:
    """host, path, rule and verdict for each row of urls (distinct host, path; a stored table, as it is read three times); null where no rule fits."""
    cuts = max(1, min(MOST_CUTS, -(-urls.count() // each)))
    keyed = urls.withColumn("key", F.concat(host_key(F.col("host")), "path"))
    bounds = _quantiles(keyed, cuts)
    ruled = rules.withColumn("key", host_key(F.col("host")))
    low, high = _cut(F.col("key"), bounds), _cut(_above(F.col("key")), bounds)
    spread = ruled.select("key", F.lit(0).alias("kind"), "host", "path", "verdict", F.explode(F.sequence(low, high)).alias("cut"))
    rows = keyed.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), _cut(F.col("key"), bounds).alias("cut"))
    return (
        rows.unionByName(spread)
        .repartitionById(len(bounds) + 1, F.col("cut"))
        .sortWithinPartitions("key", "kind", "path")
        .mapInPandas(_swept, "host string, path string, rule string, verdict string")
    )


def _quantiles(keyed: DataFrame, cuts: int) -> list[str]:
    """At most `cuts` - 1 sorted keys that share the urls out evenly; any bounds give the same result.

    They come from a sample whose size is a parameter's multiple, not the table's."""
    if cuts == 1:
        return []
    sample = keyed.select("key").withColumn("o", F.xxhash64("key")).orderBy("o").limit(SAMPLED * cuts)
    keys = sorted({r.key for r in sample.select("key").collect()}, key=lambda k: k.encode())
    return keys[:: max(1, -(-len(keys) // cuts))][1:cuts]


def _cut(key: Column, bounds: Sequence[str], wide: int = 64) -> Column:
    """How many of the sorted bounds are at most the key: counted over every `wide`-th of them, then within one stretch."""
    parts = [list(bounds[k : k + wide]) for k in range(0, len(bounds), wide)]
    if not parts:
        return F.lit(0)
    count = lambda held: F.size(F.filter(held, lambda b: b <= key))
    heads = F.array(*[F.lit(p[0]) for p in parts])
    stretches = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    return let(count(heads), lambda h: F.when(h == 0, 0).otherwise((h - 1) * wide + count(F.get(stretches, h - 1))))


def judge(pages: DataFrame, rules: DataFrame, bad_labels: Sequence[str] = BAD_LABELS) -> DataFrame:
    """pages with host, path, rule (host + path of the winner or null) and verdict (allow or block)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = matched(stored(rows.select("host", "path").distinct(), "urls"), rules)
    bad = F.exists(F.split("host", r"[.-]"), lambda x: x.isin(*bad_labels)) if bad_labels else F.lit(False)
    own = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_LABELS = ", ".join(f"'{x}'" for x in BAD_LABELS)
_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = rf"""
WITH r(rh, rp, rv) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT n, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
j AS (SELECT k.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS o
      FROM k LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN len(list_filter(regexp_split_to_array(host, '[.-]'), lambda x: x IN ({_LABELS}))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM j WHERE o = 1"""
