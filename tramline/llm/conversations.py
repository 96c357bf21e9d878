"""Repair of conversations: the cheapest edits that make their roles follow a grammar, by weighted finite-state composition.

Three machines are composed: the input acceptor (a conversation's rows in order), the edit transducer (keep, rerole, delete,
insert) and the acceptor of role initials `(s?(ua)+)?`. A composed state is (rows read, state of the grammar); its arcs are
made when it is first reached and held by what they depend on (the grammar's state, the row's initial and fault). Weights are
pairs (cost, label string), compared in that order. Rows are read once, so their order is a topological one, and the shortest path is a
single pass that keeps four states. Inserts go before the row they precede (or to the end), so no label string of a layer begins another:
strings compare by the rank of their states in the layer before and what is added, and are never built before the end.

Faults, the first that fits: blank (no character but white space), duplicate (role and text were seen earlier), truncated (the
last character that is no white space is none of `.!?`). Blank and duplicate rows must go; a truncated row that stays costs 5 more.

Texts are shuffled once, by conversation. Equal rows of a turn are one row with a count there. A task streams a
conversation's sorted rows and holds four bytes a row, the running digests of four paths and one batch, whatever the texts' length. One
conversation is one task, since the digest of its repaired text can only be made from its start to its end.

Defined cases: a null id, turn, role or text reads as one space (a null id is a conversation of its own; null turns come first and
count for no gap); rows of one turn are ordered by the hash of role and text; a conversation without rows has zeros, no edits and
the digest of nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import short_batches, table, trimmed

#: The grammar `(s?(ua)+)?`: what each state reads and where that leads; states in which a conversation may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: What the edits cost; a truncated row that is not deleted costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
FINE, BLANK, REPEATED, CUT = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, after the contract's damage; rows that it drops stay with gone set, so that their conversation is known."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    made = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return made.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, gone) with how often each is there (n), its fault and its hash (h), dealt by conversation and sorted."""
    once = rows.withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("h", F.when(F.col("gone"), "").otherwise(F.md5(F.concat("role", F.lit("\x00"), "text").cast("binary"))))
    once = once.withColumns({"role": F.when(F.col("gone"), "").otherwise(F.col("role")), "text": F.when(F.col("gone"), "").otherwise(F.col("text"))})
    once = once.repartition("conv_id").groupBy("conv_id", "turn", "gone", "h", "role", "text").agg(F.count("*").alias("n"))
    early = F.row_number().over(Window.partitionBy("conv_id", "gone", "h", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    shown = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(shown) == 0, BLANK).when(early, REPEATED).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    return once.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "gone", "h", "role", "text")


def _edits(initial: str, fault: int) -> Iterator[tuple[str, int, str]]:
    """The edit transducer's arcs for a row: label, cost and the role initial that it writes (none for a deleted row)."""
    yield "D", DELETE, ""
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        yield "K", KEEP + more, initial
        for role in ROLES:
            yield "R", REROLE + more, role


@lru_cache(None)
def _inserted(state: int) -> tuple[tuple[str, int, str, int], ...]:
    """Ways from a state of the grammar over inserted rows only, at most one to each state: labels, cost, roles and the state."""
    found, last = {state: ("", 0, "", state)}, [("", 0, "", state)]
    while last:
        last = [(e + "I", cost + INSERT, roles + r, GRAMMAR[at][r]) for e, cost, roles, at in last for r in ROLES if r in GRAMMAR[at] and GRAMMAR[at][r] not in found]
        found.update((way[3], way) for way in last)
    return tuple(found.values())


@lru_cache(4096)
def _arcs(state: int, initial: str, fault: int) -> tuple[tuple[str, int, str, int], ...]:
    """Arcs of the composed machine from a state of the grammar over one row, inserts before it included.

    Each is (labels, cost, what is written, next state); what is written has u or a for an inserted row and, last, K (the row as it is), U or A
    (the row with a new role) or nothing."""
    out = []
    for labels, cost, roles, at in _inserted(state):
        for label, more, writes in _edits(initial, fault):
            if not writes or writes in GRAMMAR[at]:
                own = {"D": "", "K": "K", "R": writes.upper()}[label]
                out.append((labels + label, cost + more, roles + own, GRAMMAR[at][writes] if writes else at))
    return tuple(out)


class Path:
    """The shortest paths through a conversation's rows to each state of the grammar, row by row."""

    def __init__(self) -> None:
        #: state: (cost, rank of its label string among the layer's, digest, whether anything was written)
        self.held = {0: (0, 0, hashlib.sha256(), False)}
        self.steps = bytearray()  # four bytes a row: for each state the place of the arc and the state it came from
        self.kinds: list[tuple[str, int]] = []  # initials and faults by number
        self.numbers: dict[tuple[str, int], int] = {}
        self.read = bytearray()

    def add(self, role: str, text: str, fault: int) -> None:
        kind = (role[:1], fault) if role[:1] in ("s", "u", "a") else ("?", fault)
        best: dict[int, tuple[int, int, str, int, int, str]] = {}
        for state, (cost, rank, _, _) in self.held.items():
            for k, (labels, more, writes, to) in enumerate(_arcs(state, *kind)):
                way = (cost + more, rank, labels, state, k, writes)
                if to not in best or way < best[to]:
                    best[to] = way
        order = sorted(best, key=lambda to: best[to][1:3])
        step, new = bytearray(4), {}
        for rank, to in enumerate(order):
            cost, _, _, state, k, writes = best[to]
            step[to] = state << 6 | k
            digest, begun = self.held[state][2:]
            if writes:
                digest = digest.copy()
                for c in writes:
                    line = f"{ROLES[c]}:" if c in ROLES else f"{role if c == 'K' else ROLES[c.lower()]}:{text}"
                    digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
            new[to] = (cost, rank, digest, begun)
        self.held = new
        self.steps += step
        if kind not in self.numbers:
            self.numbers[kind] = len(self.kinds)
            self.kinds.append(kind)
        self.read.append(self.numbers[kind])

    def end(self) -> tuple[int, str, str]:
        """Cost, label string and digest of the shortest path to the end."""
        ways = []
        for state, (cost, rank, digest, begun) in self.held.items():
            for labels, more, roles, to in _inserted(state):
                if to in FINAL:
                    ways.append((cost + more, rank, labels, state, roles, digest, begun))
        cost, _, labels, state, roles, digest, begun = min(ways, key=lambda w: w[:4])
        digest = digest.copy()
        for c in roles:
            digest.update((("\n" if begun else "") + f"{ROLES[c]}:").encode())
            begun = True
        out = [labels]
        for i in range(len(self.read) - 1, -1, -1):
            step = self.steps[4 * i + state]
            state = step >> 6
            out.append(_arcs(state, *self.kinds[self.read[i]])[step & 63][0])
        return cost, "".join(reversed(out)), digest.hexdigest()


class _Conversation:
    """Counts and paths of one conversation, while its rows stream by."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id, self.path = conv_id, Path()
        self.low = self.high = None
        self.turns, self.last = 0, ""
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.begun = False

    def add(self, turn: str | None, role: str, text: str, n: int, fault: int) -> None:
        if turn is not None and (self.high is None or int(turn) != self.high):
            self.high = int(turn)
            self.low = self.high if self.low is None else self.low
            self.turns += 1
        initial = role[:1]
        self.illegal += self.begun and self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last, self.begun = initial, True
        again = BLANK if fault == BLANK else REPEATED
        self.faults[fault] += 1
        self.faults[again] += n - 1
        self.path.add(role, text, fault)
        for _ in range(n - 1):
            self.path.add(role, text, again)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.path.end()
        return (self.conv_id, gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, cost, audit, digest)


COLUMNS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, now = [c.split()[0] for c in COLUMNS.split(", ")], None
    for batch in batches:
        out = []
        for conv_id, turn, role, text, gone, n, fault in zip(batch.conv_id, batch.turn, batch.role, batch.text, batch.gone, batch.n, batch.fault, strict=True):
            if now is None or conv_id != now.conv_id:
                out += [now.row()] if now is not None else []
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, text, n, fault)
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([now.row()] if now is not None else [], columns=names)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, gone): faults, the cheapest edits and the digest of what they give."""
    held = judged(rows).select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "gone", "n", "fault")
    kind: Column = F.col("conv_id").cast(rows.schema["conv_id"].dataType)
    return short_batches(held).mapInPandas(trimmed(_repaired), COLUMNS).withColumn("conv_id", kind)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# States: 0 nothing, 1 after s, 2 after u, 3 after a. w: ways over inserted rows; t: those, then one row.
ORACLE_SQL = r"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crct AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
crcs AS (SELECT list(v ORDER BY b) AS tab FROM crct),
y AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM x, crcs),
z AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM y WHERE kind > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS i, rtrim(text, E' \t\n\v\f\r') AS shown, substr(role, 1, 1) AS a FROM z),
f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lag(a) OVER (PARTITION BY conv_id ORDER BY i) || a AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w(q, p, ins, put) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', E'user:\n'), (1, 2, 'I', E'user:\n'), (3, 2, 'I', E'user:\n'), (2, 3, 'I', E'assistant:\n'), (0, 3, 'II', E'user:\nassistant:\n'), (1, 3, 'II', E'user:\nassistant:\n')),
g(p, a, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
t AS (SELECT q, w.p AS to_, '*' AS a, ins || 'D' AS e, 5 * length(ins) + 2 AS cost, put, 'D' AS own FROM w UNION ALL SELECT q, n, a, ins || 'K', 5 * length(ins), put, 'K' FROM w JOIN g USING (p)
      UNION ALL SELECT q, n, '+', ins || 'R', 5 * length(ins) + 1, put, CASE a WHEN 'u' THEN 'user' ELSE 'assistant' END FROM w JOIN g USING (p) WHERE a <> 's'),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS made FROM x
      UNION ALL SELECT conv_id, i, q, cost, audit, made FROM (
        SELECT r.conv_id, f.i, t.to_ AS q, r.cost + t.cost + CASE WHEN fault = 't' AND own <> 'D' THEN 5 ELSE 0 END AS cost, audit || e AS audit,
               made || put || CASE own WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE own || ':' || text || chr(10) END AS made
        FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN t ON t.q = r.q AND (own = 'D' OR (fault NOT IN ('b', 'd') AND (t.a = '+' OR t.a = f.a)))
        QUALIFY row_number() OVER (PARTITION BY r.conv_id, f.i, t.to_ ORDER BY r.cost + t.cost + CASE WHEN fault = 't' AND own <> 'D' THEN 5 ELSE 0 END, audit || e) = 1)),
m AS (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id),
e AS (SELECT r.conv_id, r.cost + 5 * length(ins) AS cost, r.audit || ins AS audit, made || put AS made, row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + 5 * length(ins), r.audit || ins) AS o
      FROM r JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i JOIN w ON w.q = r.q AND w.p IN (0, 3))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.cost, e.audit,
       sha256(CASE WHEN made = '' THEN '' ELSE substr(made, 1, length(made) - 1) END) AS repaired_sha256
FROM e LEFT JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE o = 1"""
