"""Keys of the SimHash groups: every pair within the radius shares one, and groups stay near a tree's size as the rows grow."""

import itertools
import random

import pytest

from evalframe.llm import simhash


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_pairs_within_the_radius_share_a_key(blocks):
    rng = random.Random(blocks)
    masks = [m % (1 << 64) for m in simhash.key_masks(blocks)]
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
    edges = [64 * i // blocks for i in range(blocks + 1)]  # one bit of any three blocks
    for own in itertools.combinations(range(blocks), 3):
        assert any(not m & sum(1 << edges[i] for i in own) for m in masks)


def test_blocks_grow_with_the_rows():
    got = [simhash.blocks_for(10 ** e) for e in range(0, 19)]
    assert got[0] == 4 and got == sorted(got) and got[-1] > got[8]
    for e, blocks in enumerate(got):
        bits = min((m % (1 << 64)).bit_count() for m in simhash.key_masks(blocks))
        assert 10 ** e / 2 ** bits <= simhash.TREE_ROWS / 4 + 1


def test_more_blocks_find_the_same_components(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for p in prints[:60]:
        q = p
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            q ^= 1 << bit
        prints.append(q)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fp long")
    want = {r.fp: r.root for r in simhash.components(df, bands=4).collect()}
    for blocks in (5, 6, None):
        got = {r.fp: r.root for r in simhash.components(df, bands=blocks).collect()}
        assert got == want
