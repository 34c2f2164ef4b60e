import hashlib
import random

import numpy as np
import pytest

from textloom.llm import op5_suffix
from textloom.llm.op5_suffix import Runs, as_bytes, refined, remove_repeats, suffix_spans


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    """Spliced and mutated passages, periodic runs and tiny alphabets: grams that repeat inside a text and across texts."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 200))) for _ in range(8)] + ["ab" * 60, "a" * 130, "abc" * 40, "é" * 40, "".join(rng.choice("ab") for _ in range(200))]
    rows = []
    for i in range(60):
        t = list("".join(rng.choice(parts)[rng.randrange(20) :] for _ in range(rng.randrange(1, 5))))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((rng.randrange(50), "".join(t)))
    return rows + [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (None, parts[0] * 2), (104, parts[0] * 2)]


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = texts(seed)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_long_periodic_passages(spark):
    """Runs of one gram beyond what a key holds: rules of dashes, repeated syllables, at other phases and lengths."""
    rng = random.Random(7)
    parts = [lambda: "=" * rng.randrange(200, 1500), lambda: "ab" * rng.randrange(100, 900), lambda: "héé" * rng.randrange(60, 300), lambda: "0123456789" * rng.randrange(20, 99)]
    rows = [(i, "".join(rng.choice(parts)() for _ in range(3))) for i in range(30)] + [(40, "ab" * 1500), (41, "x" + "ab" * 1500 + "y"), (42, "ba" * 700)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_runs_cover_all_suffixes_and_their_quarters():
    for text in ("".join(random.Random(5).choice("abcd") for _ in range(3000)), "ab" * 1500):
        r = Runs(as_bytes(text))
        assert r.first[0] == 0 and (r.first[1:] == r.last[:-1] + 1).all() and r.last[-1] == 3000 - 50
        low, high = suffix_spans(r.first, r.last, r.gram, np.full(len(r.first), 15))
        assert (low == r.first).all() and (high == r.last).all()


def test_refinement_separates_grams_with_equal_fingerprints(monkeypatch):
    """With fingerprints that all collide, the bytes still decide."""
    x = as_bytes("a" * 60 + "b" * 60 + "a" * 60)
    at, ids = np.array([0, 60, 120]), np.array([1, 2, 3])
    assert refined(x, at, ids)[0].tolist() == [0, 2]
    monkeypatch.setattr(op5_suffix, "spans_hash", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    left, bucket = refined(x, at, ids)
    assert left.tolist() == [0, 1, 2] and bucket[0] == bucket[2] != bucket[1]


@pytest.mark.parametrize("n", [4, 64])
def test_rows_of_each_step_do_not_depend_on_partitions(spark, n):
    """Rows between the steps, for 4 and 64 partitions."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(texts(4)) if i is not None], "doc_id long, row_key long, text string").repartition(3, "doc_id").cache()
    spans = op5_suffix.region_spans(d, 8 * n, n).cache()
    counts = spans.count(), spans.where("gram is null").count(), op5_suffix.suffix_hits(d, spans, n).count()
    seen = test_rows_of_each_step_do_not_depend_on_partitions.__dict__.setdefault("counts", counts)
    assert all(abs(a - b) <= 0.02 * a for a, b in zip(seen, counts))
    assert spans.where(F.col("last") < F.col("first")).count() == 0


def test_edges(edge_docs, no_docs):
    assert remove_repeats(edge_docs).count() == edge_docs.count() and remove_repeats(no_docs).count() == 0
