import random
import re
import string

import numpy as np

from textloom.llm import op4_minhash as mh
from textloom.llm.work import WORD, components, shingle_set, word_hashes


def test_word_hashes_agree_with_the_pattern():
    rng = random.Random(1)
    seen = {}
    for _ in range(300):
        text = "".join(rng.choice("abAB é\t\n\x0b\x0c\r\x1c\xa0") for _ in range(rng.randrange(40)))
        words = re.findall(WORD, text)
        hashes = word_hashes(text)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            key = "".join(c.lower() if c in string.ascii_uppercase else c for c in w)
            assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    assert len(shingle_set(None, 3)) == 0 and len(shingle_set(" \n", 3)) == 0
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("a b c a b c", 3)) == 3
    assert shingle_set("A b", 3) == shingle_set("a B", 3) and shingle_set("a b", 3) != shingle_set("a b c", 3)


def test_super_minhash_estimates_similarity_and_ignores_chunks():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for share in (0.5, 0.85):
        n = 3000
        k = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
        same = (mh.super_minhash(a) == mh.super_minhash(b)).mean()
        assert abs(same - share) < 0.12
    whole = mh.super_minhash(pool)
    assert (whole == np.minimum(mh.super_minhash(pool[:4096]), np.minimum(mh.super_minhash(pool[4096:8192]), mh.super_minhash(pool[8192:])))).all()


def test_bands_miss_almost_no_link_at_the_threshold():
    for t in (0.8, 0.85):
        r = mh.rows_per_band(t)
        assert (1 - t**r) ** (mh.SLOTS // r) <= mh.MISS


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(300, 301), (301, 302), (302, 300)] + [(5, 5)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {i: 100 for i in range(101, 161)} | {x: 7 for x in range(200, 260)} | {301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
