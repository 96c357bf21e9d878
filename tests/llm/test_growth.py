"""Work that must not grow faster than the input: keys that many sets have by chance, and texts dealt where sizes are enough."""

from __future__ import annotations

import numpy as np
import pytest

from tramline.llm import mixing, ngram_join
from tramline.llm.common import mix64


def keys_of(s, bands):
    """Keys that a set probes and keys that it has, and whether it probes one of an empty segment."""
    probes, offers, empty = set(), set(), False
    probed = bands.probed(len(s))
    for band in probed:
        if bands.apart(band) > 0:
            p, o = ngram_join._segment_keys(s, band, band == probed[-1], bands)
            label = mix64(np.full(1, band + 1, np.uint64))[0]
            p, o = ({int(k) for x in part for k in x} for part in (p, o))
            empty |= bool(p & {int(k) for k in mix64(mix64(np.arange(bands.segments(band)[0], dtype=np.uint64) + label))})
            probes |= p
            offers |= o
    return probes, probes | offers, empty


@pytest.mark.parametrize("num", [80, 90])
def test_empty_segments_are_not_probed(num):
    rng, bands = np.random.default_rng(3), ngram_join.Bands(num, 100)
    sizes = [20, 33, 53, 85, 137, 220, 353, 565, 905, *rng.integers(20, 1500, 100)] * 8
    assert sum(keys_of(rng.integers(0, 2**63, n).astype(np.uint64), bands)[2] for n in sizes) <= 1
    small = rng.integers(4, 20, 2000)
    assert sum(keys_of(rng.integers(0, 2**63, n).astype(np.uint64), bands)[2] for n in small) <= 10


@pytest.mark.parametrize("num", [80, 90])
def test_links_share_a_probed_key(num):
    rng, bands = np.random.default_rng(4), ngram_join.Bands(num, 100)
    linked = 0
    for n in [*range(4, 60), *rng.integers(60, 900, 300)] * 2:
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        # At the limit: the members that are not common are (100 - num) % of the union.
        apart = int(n * (100 - num) // num)
        mine = int(rng.integers(0, apart + 1))
        x = np.unique(np.concatenate((both, rng.integers(0, 2**63, mine).astype(np.uint64))))
        y = np.unique(np.concatenate((both, rng.integers(0, 2**63, apart - mine).astype(np.uint64))))
        common = len(np.intersect1d(x, y))
        if len(x) == len(y) == common or 100 * common < num * (len(x) + len(y) - common):
            continue
        linked += 1
        (px, hx, _), (py, hy, _) = keys_of(x, bands), keys_of(y, bands)
        assert px & hy or py & hx, n
    assert linked > 500


def test_mix_without_words(spark):
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (i * 37 % 900))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = mixing.stored(mixing.word_counts(docs), "sizes")
    planned = mixing.stored(mixing.targets(sizes), "targets")
    with_, without = (mixing.blocks(docs, sizes, planned, words=w) for w in (True, False))
    assert "words" not in without.columns
    columns = ["shard", "slot", "s", "source", "block", "pieces"]
    found = [sorted(map(str, b.select(columns).collect())) for b in (with_, without)]
    assert found[0] == found[1] and found[0]
    taken = [sorted(mixing.mixed(docs, words=w).select("doc_id", "size", "target", "taken").collect()) for w in (True, False)]
    assert taken[0] == taken[1]
