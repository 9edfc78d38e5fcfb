"""How many pairs the Jaccard join passes on to the exact count."""

import numpy as np
import plain
import pytest

from framewise.llm import parity_join
from framewise.llm.words import U64


@pytest.mark.parametrize(("num", "den"), [(8, 10), (85, 100)])
def test_unrelated_sets_of_a_band_share_no_key(num, den):
    bands = parity_join.Bands(num, den)
    rng = np.random.default_rng(7)
    for size in (150, 433, 700, 1100):
        seen = set()
        for _ in range(40):
            keys = set(parity_join.part_keys(np.sort(rng.integers(0, 1 << 63, size).astype(U64) * U64(2)), bands).tolist())
            assert not keys & seen
            seen |= keys


@pytest.mark.parametrize(("num", "den"), [(8, 10), (85, 100), (1, 2), (95, 100)])
def test_linked_sets_share_a_key(num, den):
    bands = parity_join.Bands(num, den)
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 5, 9, 17, 30, 75, 160, 300, 700, 1500):
        for _ in range(8):
            pool = rng.integers(0, 1 << 63, 4 * size + 8).astype(U64) * U64(2)
            own = bands.differences(2 * size) // 2
            for one, two in ((size - own, own), (size, 0)):
                both = pool[: size - own]
                x = np.unique(np.concatenate([both, pool[size : size + size - one]]))
                y = np.unique(np.concatenate([both, pool[2 * size : 2 * size + two]]))
                assert len(both) * den >= num * (len(x) + len(y) - len(both))
                keys = [set(parity_join.part_keys(s, bands).tolist()) for s in (x, y)]
                assert keys[0] & keys[1]


def test_wide_sketches_never_refute_a_linked_pair_and_refute_large_unlike_sets():
    rng = np.random.default_rng(9)
    for size, more in ((1, 0), (200, 50), (257, 60), (3000, 700)):
        x = rng.integers(0, 1 << 63, size).astype(U64) * U64(2)
        y = np.concatenate([x, rng.integers(0, 1 << 63, more).astype(U64) * U64(2)])
        bits = parity_join.differing_bits(parity_join.wide_sketch(x), parity_join.wide_sketch(y))
        assert bits <= more and bits % 2 == more % 2
        assert bits == parity_join.differing_bits(parity_join.wide_sketch(y), parity_join.wide_sketch(x))
    assert bits > 0.75 * more
    other = rng.integers(0, 1 << 63, 3000).astype(U64) * U64(2)
    assert parity_join.differing_bits(parity_join.wide_sketch(x), parity_join.wide_sketch(other)) > 6000 / 9


def test_texts_of_unlike_long_documents_are_not_compared(spark, monkeypatch):
    base = plain.prose(3, 1500).split(" ")
    rows = [(0, " ".join(base)), (1, " ".join([*base[:1480], "end"]))]
    # Half of each text is the same: keys meet, 512 bits say nothing at this size.
    rows += [(k, " ".join([*base[:750], *(f"w{k}x{j}" for j in range(750))])) for k in range(2, 14)]
    taken = []
    similar = parity_join._similar
    monkeypatch.setattr(parity_join, "_similar", lambda pairs, *rest: taken.append(pairs.count()) or similar(pairs, *rest))
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: 0 if k < 2 else k for k, _ in rows}
    assert sum(taken) == 1
