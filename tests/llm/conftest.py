from __future__ import annotations

import os
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id long, key string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "idiot", "Été", "naïve", "straße", "日本", "🙂"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 140))) for _ in range(60)]
    near = []
    for t in base[:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    odd = [
        None, "", "   \n\t ", "one", "one two", "One TWO", "a b c", "a b c a b c a b c", "line\nline\nline\n\nother", "x" * 5000, " ".join(["many"] * 3000),
        "mail me at jo.doe+x@example.com or +1 (555) 010-9999, ip 10.0.0.1, card 4111 1111 1111 1111.", "999.1.1.1 and 1.2.3.4.5 and 4111111111111112",
        "jo [at] example [dot] org", "tab\x0bvertical\x0cform\rreturn", "#$%&|<>*#", "\x01\x02 control 1\x012", "<|endoftext|> inside <|endoftext|>", "é" * 10,
    ]
    long_ = [" ".join(rng.choice(vocab) for _ in range(9000))]
    return base + near + base[:10] + [base[0]] * 15 + odd + long_


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """A folder of small tables with every awkward case: nulls, copies, clashing columns, long texts."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i * 3, t, "en", [None, "a", "b", "c"][min(i % 7, 3)], len(t or ""), "s", i, "k") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i * 3, i % 2, int("idiot" in (t or ""))) for i, t in enumerate(texts()) if i % 4] + [(None, 1, 1), (3, None, None), (10**9, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = [
        None, "", "no scheme", "http://net/", "https://a.b.NET/x?y#z", "http://example.net/en/1", "http://www.example.net/de/", "ftp://Example.COM/de/x", "http://example.com",
        "http://x.org/fr/a", "http://x.org/en", "http://spam-farm.org/", "http://a//b://c", "http://.net/", "http://net?x", "http://xexample.com/de/", "http://a..net/",
        "http://net\x01evil/", "http://evil\x01.net/a", "http://net\x02evil/", "http://a\x02.net/", "http://\x00.example.com/de/", "http://\U0010ffff\U0010ffff.org/fr/",
    ] * 2
    spark.createDataFrame([(i // 2, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def real_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    return folder
