import random

from textloom.llm import op4_minhash as mh
from textloom.llm.work import shingle_set


def brute(rows, k, num, den):
    sets = [(i, set(shingle_set(t, k).tolist())) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def variants(seed, groups=6, copies=14):
    """Groups of copies with differing numbers of changed words, so that many pairs lie near the threshold."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"t{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK_ROWS", 3)  # small blocks, so that stragglers span several
    rows = variants(4)
    for k, num, den in ((3, 85, 100), (5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, num, den).collect()}
        assert got == brute(rows, k, num, den)


def test_edges(spark, edge_docs, no_docs):
    out = mh.near_duplicates(edge_docs).collect()
    assert len(out) == edge_docs.count() and mh.near_duplicates(no_docs).count() == 0
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[1][:1] and by[1][0][0] == 0 and by[2][0] == (0, 2, True) and by[3][0] == (0, 3, True)
    assert by[5] == [(5, 5, True)] * 2 and by[6] == [(5, 5, False)] and by[7] == [(1, 7, True)] and by[8] == [(1, 8, True)]
    assert by[None][0][2] is True
