"""Each corpus operator against a plain brute-force version, on awkward rows, empty tables and the smallest real ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import bpe, fingerprints, lm_scoring, mixing, ngram_join, pii, quality_classifier, queries, toxicity
from tramline.llm.common import hashed_words, remainder, shingles
from tramline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUERIES = queries.queries()


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()


def rows(spark, name, folder, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, folder).collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1), (2, 3)], [(i, i + 1) for i in range(40)], [(i, i * 7 % 50) for i in range(50)], [(0, i) for i in range(30)] + [(50, 51)]])
def test_components(spark, edges):
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == union_find([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("which", ["sf_dir", "real_dir"])
def test_ngram_join(spark, request, which, n, num):
    docs = spark.read.parquet(f"{request.getfixturevalue(which)}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = WORD.findall(lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    edges = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = union_find(edges)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_sets(docs, n, num).collect()}
    assert found == {d: (len(s), root.get(d, d)) for d, s in sets.items()}
    if which == "sf_dir" and n == 5:
        assert {r.doc_id for r in ngram_join.deduplicated(docs).collect()} == {d for d in sets if root.get(d, d) == d}


def test_near_misses_take_one_round(spark, monkeypatch):
    """A thousand texts that all miss the threshold narrowly, and few that meet it, in small blocks."""
    calls = []
    monkeypatch.setattr(ngram_join, "BLOCK", 60_000)
    plain = ngram_join._forests
    monkeypatch.setattr(ngram_join, "_forests", lambda *a: calls.append(a[2]) or plain(*a))
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1000):
        words = list(base)
        words[100 : 100 + 16] = [f"x{i}y{k}" for k in range(16)]
        rows.append((i, " ".join(words)))
    for i in range(40):
        words = rows[i * 3][1].split()
        words[5] = f"z{i}"
        rows.append((5000 + i, " ".join(words)))
    found = {r.doc_id: r.component_id for r in ngram_join.linked_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {d: (d - 5000) * 3 if d >= 5000 else d for d, _ in rows}
    assert len(calls) == 4


def test_ids_that_are_null_repeated_or_large(spark):
    text = [" ".join(f"a{i}b{k}" for k in range(60)) for i in range(4)]
    rows = [(2**60 + 1, text[0]), (2**60 + 3, text[0] + " end"), (None, text[0]), (None, text[1]), (5, text[1]), (5, text[2]), (7, text[2]), (9, text[1]), (11, text[3]), (11, "")]
    found = ngram_join.linked_sets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == sorted(
        [(2**60 + 1, 2**60 + 1), (2**60 + 3, 2**60 + 1), (0, 0), (0, 0), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (11, 11)]
    )


@pytest.mark.parametrize(("name", "label", "mod", "out"), [("op2_toxicity", "toxic", 5, 0), ("op6_quality_classifier", "quality", 3, 1)])
def test_classifiers(spark, sf_dir, name, label, mod, out):
    found = rows(spark, name, "/root/testdata/sf0.01")
    truth = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, truth[d]) for d, r in found.items() if r.held_out and truth.get(d) is not None]
    assert len(found) == 1000 and len(held) > 30
    assert sum(p == t for p, t in held) / len(held) >= 0.9
    good, bad = ([r.score for d, r in found.items() if r.held_out and truth.get(d) == y] for y in (1, 0))
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    hits = sum(p and t for p, t in held)
    assert area > 0.8 and hits / max(1, sum(p for p, _ in held)) >= 0.8 and hits / sum(t for _, t in held) >= 0.5
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % mod == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in found.items())
    awkward = QUERIES[name](spark, sf_dir).collect()
    assert len(awkward) == len(documents(spark, sf_dir)) and all(math.isfinite(r.score) for r in awkward)
    by_text = {}
    for d in documents(spark, sf_dir):
        by_text.setdefault(d.text or "", set()).add(next(round(r.score, 9) for r in awkward if r.doc_id == d.doc_id))
    assert all(len(s) == 1 for s in by_text.values())


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    fires = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in ((0.9, 0.02), (0.6, 0.05), (0.5, 0.01), (0.3, 0.3))], 1).astype(np.int64)
    yes, no, _ = toxicity.label_model(fires.T @ fires, len(y), 0.2)
    assert abs(yes[0] - 0.9) < 0.1 and abs(yes[1] - 0.6) < 0.1 and no[0] < 0.06 and abs(yes[3] - no[3]) < 0.05


@pytest.mark.parametrize("name", ["op3_quality_rules", "op8_url_filters"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == want.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("which", ["sf_dir", "real_dir"])
def test_mixing(spark, request, which):
    folder = request.getfixturevalue(which)
    found = rows(spark, "op4_mixing", folder)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found.keys() == docs.keys()
    sizes, taken = Counter(), Counter()
    for d, r in found.items():
        assert r["size"] == len(WORD.findall(docs[d].text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[docs[d].source] += r["size"]
        taken[docs[d].source] += r.taken
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for d, r in found.items():
        s = docs[d].source
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and abs(taken[s] - target[s]) < 1.5
    again = rows(spark, "op4_mixing", folder)
    assert all(again[d].taken == r.taken for d, r in found.items())


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 64, 1000, 99999):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("x")).distinct().agg(F.count("*"), F.min("x"), F.max("x")).first()
        assert tuple(got) == (n, 0, n - 1)


def test_lm_scoring(spark, sf_dir):
    found = rows(spark, "op5_lm_scoring", sf_dir)
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf_dir)}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert found.keys() == docs.keys()
    for d, r in found.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(tokens[d]), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens[d])
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0 and math.isfinite(r.score)


def plain_ppm(texts, order, text):
    """log10 probability of a text (its end included), by escapes with exclusion, one symbol at a time."""
    table = {}
    for t in texts:
        s = b"\0" * order + t.encode() + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                table.setdefault(s[i - k : i], Counter())[s[i]] += 1
    s, total = b"\0" * order + text.encode() + b"\xff", 0.0
    for i in range(order, len(s)):
        out, p, done = set(), 0.0, False
        for k in range(order, -1, -1):
            seen = table.get(s[i - k : i])
            if seen is None:
                continue
            left = {c: x for c, x in seen.items() if c not in out}
            space = sum(left.values()) + len(left)
            if s[i] in left:
                p += math.log10(left[s[i]] / space)
                done = True
                break
            p += math.log10(len(left) / space) if left else 0.0
            out |= set(seen)
        total += p if done else p + math.log10(1 / (257 - len(out)))
    return total


def test_trie_scores_are_those_of_plain_ppm(spark):
    train = ["abracadabra", "abrakadabra abra", "cadabra", "", "the cat sat on the mat"]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    trie = lm_scoring.Trie(lm_scoring.trie_counts(df, 3, 1_000_000))
    for text in ("abra", "cat", "zebra", "", "the the"):
        pad = lm_scoring._grams([text.encode()])[0]
        assert math.isclose(float(trie.scores(pad).sum()), plain_ppm(train, 3, text), rel_tol=1e-6), text


def test_fingerprints(spark, sf_dir):
    found = rows(spark, "op7_fingerprints", sf_dir)
    docs = sorted((r.doc_id, r.text or "") for r in documents(spark, sf_dir))
    by_text, misses = {}, []
    for i, (d, t) in enumerate(docs):
        r, after = found[d], docs[(i + 1) % len(docs)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(r.fingerprint)
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = Counter(WORD.findall(t)), Counter(WORD.findall(other))
            true = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
            # Five standard errors of 64 samples; without a common word likeness is chance, with equal texts it is 1.
            assert 0 <= near <= 1 and abs(near - true) <= 5 * math.sqrt(true * (1 - true) / 64) + 1e-9
            misses.append(near - true)
            if t == other:
                assert near == 1
    assert all(len(x) == 1 for x in by_text.values())
    assert abs(sum(misses) / len(misses)) < 0.01
    for (d, t), (_, u) in zip(docs, docs[1:], strict=False):  # likeness follows from what is printed
        a, b = next(iter(by_text[t])), next(iter(by_text[u]))
        same = sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64 if a and b else float(a == b)
        assert same == found[d].near_next


def test_fingerprints_have_no_bias_over_weights(spark, tmp_path):
    """A thousand pairs of texts with heavy and light words: mean error under 0.03, mean size of an error near that of 64 samples."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1001):
        words = rng.choice(30, rng.integers(1, 12), replace=False)
        rows.append((i, " ".join(w for k in words for w in [f"w{k}"] * int(rng.pareto(1) * 3 + 1))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, str(tmp_path)).collect()}
    off = []
    for i, t in rows[:1000]:
        a, b = Counter(t.split()), Counter(rows[i + 1][1].split())
        off.append(found[i].near_next - sum((a & b).values()) / sum((a | b).values()))
    assert len(rows_of) == 1001 and abs(np.mean(off)) < 0.03 and np.mean(np.abs(off)) < 0.05


def test_bpe(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_padding()
    tok.no_truncation()
    found = rows(spark, "op9_bpe", sf_dir)
    for r in documents(spark, sf_dir):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        got = found[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_spans(text):
    out = []
    digits = lambda s: re.sub(r"\D", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    for k, (kind, (pattern, ok)) in enumerate(tests.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, re.A) if ok(m[0])]
    return sorted(out)


@pytest.mark.parametrize("which", ["sf_dir", "real_dir"])
def test_pii(spark, request, which):
    folder = request.getfixturevalue(which)
    found = rows(spark, "op10_pii", folder)
    for r in documents(spark, folder):
        base, got = plain_spans(r.text or ""), found[r.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(b[3] == k for b in base) for k in pii.KINDS]
        listed = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert got.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got.spans.split(",") if got.spans else [])


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail jo@example.com now", 23, "x"), (2, None, None, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, _id string")
    found = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert found[1].text == "mail <EMAIL> now" and found[1].n_chars == 16 and found[2].text is None and found[3].text == "clean"


def test_hashes_tell_words_apart():
    a, _ = hashed_words(b" one two  three\nthree")
    assert len(a) == 4 and a[2] == a[3] and len(set(a.tolist())) == 3
    assert len(shingles(a, 3)) == 2 and len(shingles(a[:2], 3)) == 1 and len(shingles(a[:0], 3)) == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(kept) <= ids
        if name == "personal_data":
            assert sorted(kept) == sorted(ids)
            assert not any("jo.doe+x@example.com" in (r.text or "") for r in out.collect())
        docs = out.select(docs.columns)
        docs.write.parquet(path := f"{sf_dir}/stage-{name}")
        docs = spark.read.parquet(path)


@pytest.mark.parametrize("most", [0, 200, 1_000_000])
def test_every_gram_counts_however_few_are_common(spark, most):
    """Scores are those of the whole model where only a part of the grams goes to the tasks, or none."""
    texts = ["abracadabra", "abrakadabra abra", "cadabra", None, "the cat sat on the mat", "the zebra sat", "quux Été", "abra", "abra"]
    ids = [0, 1, 2, 3, 4, 5, None, 7, 7]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    train = [t or "" for i, t in zip(ids, texts, strict=True) if i is not None and i < 5]
    found = lm_scoring.scored(df, lambda i: i < 5, most).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[ids.index(r.doc_id)] or ""
        assert math.isclose(r.score, plain_ppm(train, lm_scoring.ORDER, text), rel_tol=1e-9), text


def test_mix_blocks_are_cut_from_their_sources_streams(spark, sf_dir):
    """Slots hold real blocks: equal in every whole pass, a stream's words all there, `taken` the words in them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = mixing.word_counts(docs)
    planned = mixing.targets(sizes)
    mix = mixing.blocks(docs, sizes, planned, 64).collect()
    plan = {r.source: r for r in planned.collect()}
    words = {}
    for r in docs.collect():
        words.setdefault(r.source, Counter()).update(WORD.findall(r.text or ""))
    taken = Counter()
    assert {r.source for r in mix} == {s for s, r in plan.items() if r.target >= 1}
    for source in {r.source for r in mix}:
        mine = [r for r in mix if r.source == source]
        assert len({r.slot for r in mine}) == len(mine) and all(sum(p.n for p in r.pieces) == len(r.words.split(" ")) for r in mine)
        assert sum(len(r.words.split(" ")) for r in mine) == int(plan[source].target)
        full = {}
        for r in mine:
            full[r.block] = max(full.get(r.block, ""), r.words, key=len)
            taken.update({(r.s, p.g, p.row): p.n for p in r.pieces})
        assert all(full[r.block].startswith(r.words) for r in mine)
        if plan[source].target >= plan[source].source_size:
            assert Counter(w for x in full.values() for w in x.split(" ")) == words[source]
    for r in mixing.mixed(docs, 64).collect():
        assert taken[r.s, r.g, r.row] == r.taken


def test_resampled_sources_meet_their_targets(spark):
    """Long documents with the same taken / size come in their share, and repeated or missing ids are rows of their own."""
    rows = [(i, " ".join(["w"] * 3000), "a") for i in range(20)] + [(100 + i, " ".join(["v"] * (7 + i % 90)), "b") for i in range(300)]
    rows += [(None, f"null {i} " * 40, "c") for i in range(30)] + [(7000, f"same {i} " * 40, "c") for i in range(30)] + [(9000, "", "c"), (9000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    longest, out = Counter(), Counter()
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    found = mixing.resampled(docs).collect()
    for r in found:
        out[r.source] += len((r.text or "").split())
    for r in mixing.targets(mixing.word_counts(docs)).collect():
        assert abs(out[r.source] - r.target) <= longest[r.source] + 2, (r.source, out[r.source], r.target)
    assert sum(not r.text for r in found) == 2
    for r in mixing.copies(docs).collect():
        assert math.floor(r.taken / r["size"]) <= r.copies <= math.ceil(r.taken / r["size"])


def test_stages_keep_every_row_without_an_id(spark, sf_dir):
    """Rows without an id are documents each; rows repeated with an id are one."""
    rows = [(None, f"text number {i} of those without any id at all", "a") for i in range(6)] + [(None, None, "a"), (None, "one two", "a"), (None, "one two", "b")]
    docs = spark.createDataFrame(rows + [(1, "an id and a text", "a")] * 2 + [(2, "an id and a text", "b")], "doc_id long, text string, source string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:3] + corpus_pipeline.STAGES[4:]:
        docs = stage(spark, docs, sf_dir).select("doc_id", "text", "source")
        found = [r.text or "" for r in docs.where("doc_id IS NULL").collect()]
        assert sorted(found) == sorted(t or "" for _, t, _ in rows), name
        assert [r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()] == [1], name


def test_words_of_clean_texts_take_no_place_of_toxic_terms(spark):
    rows = [(i, f"awful{i % 4} of", 1) for i in range(40)] + [(100 + i, " ".join(f"fine{k}" for k in range(60)), 0) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert set(toxicity.mined(sample, 10)[0]) >= {b"awful0", b"awful1", b"awful2", b"awful3"}


def test_random_voter_estimates_ruin_toxicity(spark, monkeypatch):
    """The label model's estimates decide: with noise in their place most toxic documents are missed."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    caught = lambda: sum(r.predicted for d, r in rows(spark, "op2_toxicity", folder).items() if r.held_out and d in truth)
    real = caught()
    rng = np.random.default_rng(0)
    monkeypatch.setattr(toxicity, "label_model", lambda both, *_: (rng.uniform(0.001, 0.3, len(both)), rng.uniform(0.001, 0.3, len(both)), np.ones(len(both))))
    assert caught() < real / 2


def test_posteriors_are_those_of_independent_voters():
    model = (np.array([0.5, 0.2]), np.array([0.1, 0.2]), np.ones(2))
    got = toxicity.posteriors([[0], [1], [], [0, 1], []], np.array([-1, -1, -1, 1, 0]), 0.2, model)
    odds = [0.25 * 5, 0.25, 0.25, 0.25 * 5 * 199, 0.25 / 199]
    assert np.allclose(got, [x / (1 + x) for x in odds])


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(4000) < p).astype(float)
    net = quality_classifier.Network(x[:3000], y[:3000])
    got = net.scores(x[3000:])
    assert np.mean(np.abs(got - p[3000:])) < 0.12 and abs(got.mean() - y[3000:].mean()) < 0.05


def test_vectors_of_words_in_like_contexts_are_alike(spark):
    rng = np.random.default_rng(1)
    texts = [(" ".join(f"{rng.choice(['red', 'blue'])} {rng.choice(['paint', 'car', 'door'])} {rng.choice(['seven', 'eight'])} {rng.choice(['apples', 'miles', 'years'])}" for _ in range(60)),) for _ in range(60)]
    v = quality_classifier.word_vectors(spark.createDataFrame(texts, "text string"))
    at = {w: v[quality_classifier.word_rows(w)[0][0]] for w in ("red", "blue", "seven", "eight")}
    like = lambda a, b: float(at[a] @ at[b] / np.linalg.norm(at[a]) / np.linalg.norm(at[b]))
    assert min(like("red", "blue"), like("seven", "eight")) > 0.9 > max(like("red", "seven"), like("blue", "eight"))


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_quality_rules", "op4_mixing", "op5_lm_scoring", "op6_quality_classifier", "op7_fingerprints", "op9_bpe", "op10_pii", "op1_ngram_join"])
def test_null_repeated_and_large_ids(spark, tmp_path, name):
    """Every row comes back once, with its own id to the last digit; ids that are null are held out where crc32 of nothing says so."""
    ids = [None, None, 2**60 + 1, 2**60 + 3, 5, 5, -7, 2**62 + 1]
    texts = ["null one two three", "", "large one", "large one", "same id first text", "same id other text", None, "last " * 30]
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2**60 + 1, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in found)
    if "held_out" in found[0]:
        mod, out = {"op2_toxicity": (5, 0), "op5_lm_scoring": (10, 0), "op6_quality_classifier": (3, 1)}[name]
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % mod == out) for r in found)
    if name == "op9_bpe":
        assert sorted(r.n_tokens for r in found)[:2] == [0, 0] and len({r.ids_sha256 for r in found if r.doc_id == 5}) == 2


def test_remainder_of_a_null_id(spark):
    assert spark.range(1).select(remainder(F.lit(None).cast("long"), 5)).first()[0] == 0


def test_long_words_are_encoded_in_memory_that_grows_as_they_do():
    import tracemalloc

    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    rng = np.random.default_rng(7)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    voc, tok = bpe.Vocabulary(path), Tokenizer.from_file(path)
    tok.no_truncation()
    words = ["".join(rng.choice(letters, n)) for n in (300, 5000, 40_000)]
    assert np.frombuffer(voc.encode([words[1]])[0], "<u4").tolist() == tok.encode(words[1], add_special_tokens=False).ids
    tracemalloc.start()
    ids = voc.encode(words + [words[2] + "x"])
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert [voc.decode(x) for x in ids] == words + [words[2] + "x"] and not any(w in voc.known for w in words)
    million = "".join(rng.choice(letters, 1_000_000))
    assert voc.decode(voc.encode([million])[0]) == million


def test_reliabilities_of_labelers_are_found():
    """Expectation-maximisation against planted labelers; with the strict test's vote as noise the class is still the true one."""
    rng = np.random.default_rng(5)
    true = rng.random(40_000) < 0.6
    yes, no = [0.95, 0.9, 0.4, 0.85, 0.9], [0.1, 0.3, 0.05, 0.5, 0.4]
    votes = np.zeros(len(true), int)
    for k, (a, b) in enumerate(zip(yes, no, strict=True)):
        votes |= (rng.random(len(true)) < np.where(true, a, b)).astype(int) << k
    share, got_yes, got_no = pii.reliabilities(dict(Counter(votes.tolist())))
    assert abs(share - 0.6) < 0.05 and np.allclose(got_yes, yes, atol=0.06) and np.allclose(got_no, no, atol=0.08)
    post = np.array([pii.posterior(v, share, got_yes, got_no) for v in votes])
    assert np.mean((post > 0.5) == true) > 0.9


def test_span_classifier_follows_traits_and_not_votes():
    """Spans with a trait are true nine times in ten: the weights say so; with posteriors of noise they do not."""
    rng = np.random.default_rng(6)
    counts, noise = Counter(), Counter()
    for _ in range(5000):
        trait = int(rng.random() < 0.5)
        true = rng.random() < (0.9 if trait else 0.1)
        votes = sum((rng.random() < ((0.95, 0.9, 0.6, 0.9, 0.9) if true else (0.1, 0.2, 0.1, 0.4, 0.3))[k]) << k for k in range(5))
        counts[votes, trait << 3] += 1
        noise[votes, int(rng.random() < 0.5) << 3] += 1
    w, v = pii.trained(dict(counts)), pii.trained(dict(noise))
    assert w[4] > 2 and w[0] < -1 and abs(v[4]) < 0.4


def test_spans_of_a_text_with_thousands_of_matches(spark):
    text = " ".join(f"a{i}@b.org" for i in range(3000))
    (r,) = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(r"\S+", text)]


def test_redaction_of_texts_that_share_an_id(spark):
    rows = [(1, "mail jo@example.com now"), (1, "a clean text that stays as it is, to the last word"), (1, "mail jo@example.com now"), (None, "ip 10.1.2.3 here"), (None, "none")]
    found = sorted(r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted(["mail <EMAIL> now"] * 2 + [rows[1][1], "ip <IP> here", "none"])


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage's decisions, from its own operator's scores, spans and groups on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    plain = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id: r for r in stages["toxicity"](spark, docs, sf_dir).collect()}
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda _: F.lit(True)).collect()}
    assert kept.keys() == {d for d, s in scores.items() if s < 0.5} and all(kept[d] == plain[d] for d in kept)
    redacted = {r.doc_id: r for r in stages["personal_data"](spark, docs, sf_dir).collect()}
    found = {r.doc_id: r.spans for r in pii.accepted(pii.candidates(docs)).collect()}
    for d, r in plain.items():
        text, reach = r.text, -1
        merged = []
        for s in sorted(found[d], key=lambda s: (s.start, s.kind)):
            if s.start >= reach:
                merged.append([s.start, s.end, s.kind])
            reach = merged[-1][1] = max(merged[-1][1], s.end)
        for a, b, kind in reversed(merged):
            text = text[:a] + f"<{pii.KINDS[kind].upper()}>" + text[b:]
        assert redacted[d].text == text and redacted[d].n_chars == (None if text is None else len(text))
    ids = {r.doc_id: (bytes(r.ids), r.n_tokens) for r in stages["encoding"](spark, docs, sf_dir).collect()}
    voc = bpe.Vocabulary(bpe.vocabulary_path())
    assert all(ids[d] == (voc.encode([r.text])[0], len(ids[d][0]) // 4) for d, r in plain.items())
