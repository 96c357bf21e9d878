"""Spelling distances of batches and corrections of queries, against definitions written out and a search over the whole vocabulary."""

from __future__ import annotations

import random
from functools import lru_cache

from tramline.functions import spelling
from tramline.operators import corrections

KEYS = {c: (x + y / 2, y) for y, row in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for x, c in enumerate(row)}


def plain(a, b, weighted=True):
    """The least cost over all ways to turn a into b, letter by letter from the end."""

    def alone(word, k):
        return 0.5 if weighted and ((k and word[k - 1] == word[k]) or word[k + 1 : k + 2] == word[k]) else 1.0

    def change(x, y):
        if x == y:
            return 0.0
        if not weighted:
            return 1.0
        if x in KEYS and y in KEYS and max(abs(p - q) for p, q in zip(KEYS[x], KEYS[y], strict=True)) <= 1:
            return 0.6
        if x in "aeiouy" and y in "aeiouy":
            return 0.7
        return 1.5 if x in "0123456789" or y in "0123456789" else 1.0

    @lru_cache(None)
    def cost(i, j):
        ways = [0.0] if i == j == 0 else []
        if i:
            ways.append(cost(i - 1, j) + alone(a, i - 1))
        if j:
            ways.append(cost(i, j - 1) + alone(b, j - 1))
        if i and j:
            ways.append(cost(i - 1, j - 1) + change(a[i - 1], b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
            ways.append(cost(i - 2, j - 2) + (0.6 if weighted else 1.0))
        return min(ways)

    return cost(len(a), len(b))


def test_distances_of_a_batch():
    rng = random.Random(4)
    words = ["", "a", "été", "日本", "a1b2"] + ["".join(rng.choice("abeoqw12é") for _ in range(rng.randrange(12))) for _ in range(60)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(1500)]
    left, right = zip(*pairs, strict=True)
    for weighted in (True, False):
        assert spelling.distances(left, right, weighted).tolist() == [round(plain(a, b, weighted), 9) for a, b in pairs]
    assert spelling.distances([], []).tolist() == []


def test_distances_of_long_words_in_small_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 50)
    assert spelling.distances(["x" * 300, "ab", ""], ["x" * 299, "ba", "abc"]).tolist() == [0.5, 0.6, 3.0]


def test_nulls(spark):
    rows = spark.createDataFrame([("ab", "ba"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(spelling.spelling("a", "b")).collect()] == [0.6, None, None, 0.0]


def limit(w):
    return 0 if len(w) < 4 or any(c in "0123456789" for c in w) else 1 if len(w) <= 5 else 2


def plain_options(w, last, vocab):
    found = {}
    for v in vocab:
        if limit(w) and abs(len(v) - len(w)) <= 2 and (e := plain(w, v, False)) <= limit(w):
            found[v] = min(found.get(v, (99, 99)), (plain(w, v), e))
        if limit(w) and last and len(v) > len(w) + 1 and (e := plain(w, v[: len(w)], False)) <= 1:
            found[v] = min(found.get(v, (99, 99)), (plain(w, v[: len(w)]) + 0.3, e))
    return [(v, round(c, 6), int(e)) for v, (c, e) in sorted(found.items(), key=lambda x: (x[1][0], -vocab[x[0]], x[0]))][:3]


def plain_corrections(q, vocab):
    ws = [w for w in q.split(" ") if w]
    known = lambda w: any(v.startswith(w) for v in vocab)
    held = [(0.0, (), 0, 0, False)]
    for i, w in enumerate(ws):
        own = [] if known(w) else [x for x in plain_options(w, i == len(ws) - 1, vocab) if len(w) > 5 or x[1] < 1 or x[0][0] == w[0]]
        own = [(v, c, e, len(w) <= 5 and c >= 1) for v, c, e in own] or [(w, 0.0, 0, False)]
        held = sorted((round(h[0] + c, 6), (*h[1], v), h[2] + (e > 0), max(h[3], e), h[4] or r) for h in held for v, c, e, r in own)[:10]
    out = [(c, " ".join(v), most >= 2 or changed > 1, risky) for c, v, changed, most, risky in held if changed]
    for i in range(len(ws) - 1):
        m, end = ws[i] + ws[i + 1], i + 2 == len(ws)
        fix = [(m, 0.0)] if m in vocab or (end and known(m)) else [x[:2] for x in plain_options(m, end, vocab)[:1]]
        out += [(round(0.8 + c, 6), " ".join([*ws[:i], v, *ws[i + 2 :]]), True, False) for v, c in fix]
    for i, w in enumerate(ws):
        if len(w) >= 5 and not any(c in "0123456789" for c in w) and w not in vocab:
            for k in range(2, len(w) - 1):
                if w[:k] in vocab and (w[k:] in vocab or (i == len(ws) - 1 and known(w[k:]))):
                    out.append((0.8, " ".join([*ws[:i], w[:k], w[k:], *ws[i + 1 :]]), True, False))
    return [(*x, n + 1) for n, x in enumerate(sorted(out, key=lambda x: (x[0], x[1], x[2]))[:10])]


def test_corrections_are_those_of_a_search_over_all_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeor") for _ in range(rng.randrange(1, 10))) for _ in range(260)] + ["x" * 41, "y" * 39 + "abc", "route66"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(500)] + [None, "x" * 41, "y" * 39 + "abc"]
    vocab = {}
    for t in texts:
        for w in (t or "").split():
            vocab[w] = vocab.get(w, 0) + 1
    asked = ["", "   ", "x" * 40, "y" * 38 + "abc", "route67", "abc1 dab"]
    for _ in range(70):
        typed = list(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(typed))
            typed[at : at + 1] = rng.choice(([], [rng.choice("abcdeor ")], [typed[at]] * 2))
            typed = typed or ["a"]
        asked.append("".join(typed))
    held = corrections.vocabulary(spark.createDataFrame([(t,) for t in texts], "name string"), "name")
    found = {}
    for r in corrections.corrected(spark.createDataFrame([(q,) for q in [*asked, asked[-1], None]], "q string"), held).collect():
        found.setdefault(r.q, []).append((r.cost, r.text, r.big, r.risky, r.place))
    want = {q: plain_corrections(q, vocab) for q in asked}
    assert {q: sorted(x, key=lambda r: r[4]) for q, x in found.items()} == {q: x for q, x in want.items() if x}
    assert sum(map(bool, want.values())) > 40
