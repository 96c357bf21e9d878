"""Conversation repair, fill-in-the-middle and decontamination against plain versions, on awkward rows, empty tables and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from tramline.llm import conversations, decontamination, infilling, queries

NAMES = ["op11_conversation_repair", "op12_infilling", "op13_decontamination"]
CONVERSATIONS = "conv_id long, turn long, role string, text string, h string, n long, fault string"


def conversation_rows():
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u2", "User"], ["hello.", "why?", "cut off", "", "  \n", None, "ok!  ", "a\x1c", "x" * 5000 + ".", "é…", "no. "]
    rows = []
    for c in range(160):
        turn = 0
        for _ in range(rng.randrange(0, 9)):
            rows.append((c if c else None, None if rng.random() < 0.05 else turn, rng.choice(roles[: 3 if c % 2 else 8]), rng.choice(texts[: 3 if c % 3 else 11])))
            turn += rng.choice((0, 1, 1, 1, 2)) if c % 2 else 1
    rows += [(500, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(700)] + [(501, 3, "user", "same.")] * 30
    return [(*r, "h", 1, "f") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The awkward documents, with conversations and a benchmark made for them."""
    out = str(tmp_path_factory.mktemp("new"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rng = random.Random(2)
    base = [r for r in rows if r["text"] and len(r["text"].split()) > 40]
    passage = base[3]["text"].split()[5:30]
    cases = [
        "\n", "\n\n\n", "a\nb\n", "a\nb", "é\n🙂\n日本\nend", "x <P> y\nz", "<", "<\n<\n<", "<S\n>P<\nM>", "a\r\nb\r\n", "line\n" * 500 + "last", "\n".join("<SPM>"[:k] for k in range(6)),
        " ".join(passage), ", ".join(passage[:10]).upper(), " ".join(passage[:9]), "pre " + "--".join(passage) + " post " + " ".join(passage[3:14]), "one two", "Zwei DREI", "zwei drei vier", "ÉTÉ été",
        " ".join(["again"] * 40), "w " * 3000 + " ".join(passage) + " w" * 500,
    ]
    rows += [{"doc_id": 10_000 + i, "text": t, "lang": "x", "source": "x", "n_chars": 1, "score": "", "id": 0, "key": ""} for i, t in enumerate(cases)]
    rows += [{**rows[-3], "doc_id": None}, {**rows[-3], "doc_id": None}, {**rows[4], "doc_id": 10_000}]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    items = [(1, " ".join(passage)), (2, " ".join(passage[:12])), (30, "ONE, two"), (4, "été"), (5, None), (6, "..."), (7, ""), (30, "zwei drei"), (8, " ".join(["again"] * 12)), (9, "never seen anywhere at all " * 3), (None, "drei vier")]
    items += [(100 + i, " ".join(r["text"].split()[k : k + 20])) for i, r in enumerate(rng.sample(base, 6)) for k in (0, 7)]
    items += [(900, " ".join(f"long{i}" for i in range(2500)) + " " + " ".join(passage))]
    spark.createDataFrame([(a, b, "t") for a, b in items], "item_id long, text string, print string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(conversation_rows(), CONVERSATIONS).repartition(3).write.parquet(f"{out}/conversations.parquet")
    return out


def got(spark, name, folder):
    return [r.asDict() for r in queries.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, name, tmp_path):
    for t, kind in (("documents", "doc_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{t}.parquet")
    assert got(spark, name, str(tmp_path)) == []


# --- conversations ---------------------------------------------------------------------------------


def plain_rows(rows):
    """Rows after damage, by conversation."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        held = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, labels, lines) of the best edits, from the end; strings are compared as they are. Two inserts in a gap are enough."""

    @lru_cache(None)
    def best(i, written, inserted):
        ways = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", written) else []

        def go(label, cost, initial, line, i, inserted):
            new = written + initial
            if re.fullmatch("s?(ua)*u?", new):
                c, s, o = best(i, new if new in ("", "s") else "u" if new[-1] == "u" else "ua", inserted)
                ways.append((cost + c, label + s, line + o))

        if inserted < 2:
            go("I", 5, "u", ("user:",), i, inserted + 1)
            go("I", 5, "a", ("assistant:",), i, inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            more = 5 * (faults[i] == "truncated")
            go("D", 2, "", (), i + 1, 0)
            if faults[i] in ("", "truncated"):
                go("K", more, role[:1] or "?", (f"{role}:{text}",), i + 1, 0)
                go("R", 1 + more, "u", (f"user:{text}",), i + 1, 0)
                go("R", 1 + more, "a", (f"assistant:{text}",), i + 1, 0)
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def exhaustive(rows, faults):
    """The same by trying every string of edits, with at most three inserts in a gap."""
    ways = []
    inserts = [()] + [x for k in (1, 2, 3) for x in product("ua", repeat=k)]
    per_row = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        more = 5 * (fault == "truncated")
        own = [("D", 2, "", None)]
        if fault in ("", "truncated"):
            own += [("K", more, role[:1], f"{role}:{text}"), ("R", 1 + more, "u", f"user:{text}"), ("R", 1 + more, "a", f"assistant:{text}")]
        per_row.append(own)
    names = {"u": "user:", "a": "assistant:"}
    for gaps in product(inserts, repeat=len(rows) + 1):
        for edits in product(*per_row):
            label, cost, initials, lines = "", 0, "", []
            for gap, edit in zip(gaps, (*edits, None), strict=True):
                label, cost, initials = label + "I" * len(gap), cost + 5 * len(gap), initials + "".join(gap)
                lines += [names[g] for g in gap]
                if edit:
                    label, cost = label + edit[0], cost + edit[1]
                    if edit[3] is not None:
                        initials += edit[2] or "?"
                        lines.append(edit[3])
            if re.fullmatch("(s?(ua)+)?", initials):
                ways.append((cost, label, tuple(lines)))
    return min(ways)


def test_paths_are_the_best_of_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c."])) for i in range(rng.randrange(3))]
        faults = plain_faults(rows)
        path = conversations.Path()
        for (_, role, text), fault in zip(rows, faults, strict=True):
            path.add(role, text, ["", "blank", "duplicate", "truncated"].index(fault))
        cost, labels, lines = exhaustive(rows, faults)
        assert path.end() == (cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_conversations(spark, folder):
    found = {r["conv_id"]: r for r in got(spark, NAMES[0], folder)}
    want = plain_rows(conversation_rows())
    assert found.keys() == want.keys()
    for conv, rows in want.items():
        r, faults = found[conv], plain_faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        if len(rows) < 60:
            cost, labels, lines = plain_repair(rows, faults)
            assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert len(r["audit"].replace("I", "")) == len(rows)
    assert found[501]["duplicate"] == len(want[501]) - 1


def test_a_long_conversation_streams():
    path = conversations.Path()
    for i in range(20_000):
        path.add("user" if i % 3 else "assistant", f"{i}.", 0)
    cost, labels, _ = path.end()
    assert len(path.steps) == 80_000 and len(labels.replace("I", "")) == 20_000 and cost < 20_000


# --- fill in the middle ----------------------------------------------------------------------------


def test_infilling(spark, folder):
    docs = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        docs.setdefault((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()), r.text or "")
    forms = set()
    for r in got(spark, NAMES[1], folder):
        text = docs[r["doc_id"], r["restored_sha256"]]
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>"))
        a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        out = text if plain else f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 50 else f"<P>{pre}<S>{suf}<M>{mid}"
        form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
        forms.add(form)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (len(lines), form, None if plain else len(pre), None if plain else len(mid))
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}


def test_ranked_bits():
    rng = random.Random(6)
    for _ in range(300):
        width = rng.randrange(1, 200)
        bits = rng.getrandbits(width) & (rng.getrandbits(width) | 1)
        places = [i for i in range(width) if bits >> i & 1]
        assert [infilling.ranked(bits, k, width) for k in range(len(places) + 2)] == [*places, width, width]


def test_infilling_of_a_long_text_and_rates():
    text = "a line of é\n" * 400_000
    n, form, p, m, out = infilling.transformed(text, "5")
    assert n == 400_000 and form != "plain" and sorted(out) == sorted(text + "<P><S><M>") and p % 12 == 0 and m % 12 == 0
    assert {infilling.transformed("a\nb\n", str(i), rate=0)[1] for i in range(30)} == {"plain"}
    assert {infilling.transformed("a\nb\n", str(i), spm=0)[1] for i in range(30)} == {"psm"}


# --- decontamination -------------------------------------------------------------------------------

PLAIN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return PLAIN_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    for text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                items_ = windows.get(tuple(w[i : i + n]))
                if items_:
                    hit.update(range(i, i + n))
                    found |= items_
        yield len(w), hit, {str(i) for i in found if i is not None}


@pytest.mark.parametrize("most", [decontamination.SET, 4000])
def test_decontamination(spark, folder, most):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows, items = docs.collect(), [(r.item_id, r.text) for r in bench.collect()]
    want = [(r.doc_id, n, len(hit), sorted(ids)) for r, (n, hit, ids) in zip(rows, plain_hits([r.text for r in rows], items), strict=True)]
    found = decontamination.found_in(docs, bench, most).select("doc_id", "n_words", decontamination.covered(decontamination.F.col("hits")), "items").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert sum(w[2] > 0 for w in want) > 20
    kept = decontamination.decontaminated(docs, bench).collect()
    assert len(kept) == sum(w[2] == 0 for w in want) and kept[0].__fields__ == docs.columns


@pytest.mark.parametrize(("piece", "lane"), [(1 << 20, 128), (300, 7), (60, 1)])
def test_search_over_pieces_and_lanes(monkeypatch, piece, lane):
    """Random texts over few words, in small pieces and lanes: every window is found, those across borders too."""
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "LANE", lane)
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "b", "é", "longer1"])
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 4, 10, 11, 15))))) for i in range(3, 40) if i % 3 or i < 9]
    items = [x for x in items if len(x[1].split()) > 3]
    texts = [None, "", "..."] + [rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    by_size = {}
    for i, t in items:
        w = plain_words(t)
        by_size.setdefault(min(10, len(w)), []).append((" ".join(w).encode(), (str(i),)))
    patterns = [decontamination.Patterns(size, runs) for size, runs in by_size.items()]
    for (n, spans, ids), (m, hit, want) in zip(decontamination.search(texts, patterns), plain_hits(texts, items), strict=True):
        assert n == m and ids == want and {i for a, b in spans for i in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_long_texts_in_linear_time(spark):
    text = "x" * 3_000_000 + " " + "a b c d e f g h i j " * 150_000
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "nothing like it is here " * 4)], "item_id long, text string")
    r = decontamination.found_in(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert r.n_words == 1_500_001 and r["items"] == ["1"] and [tuple(h) for h in r.hits] == [(1, 1_500_001)]
