"""Toxicity against the same steps in plain Python: counted terms, moments of the votes, triplets, gradient steps."""

import math
import random
from collections import Counter
from statistics import median

import numpy as np
import pytest

from textloom.llm import op8_toxicity as tox


def plain_mined(rows):
    n = {}
    for text, toxic in dict(rows).items():
        words = Counter(tox.WORDS.findall(text.lower()))
        terms = {"w" + w for w in words} | {"4" + w[:4] for w in words if len(w) >= 5}
        for p in {w[:5] for w in words if len(w) >= 6}:
            times = sum(c for w, c in words.items() if len(w) >= 6 and w.startswith(p))
            terms |= {k + p for k, least in (("5", 1), ("d", 2), ("t", 3)) if times >= least}
        for t in terms:
            n.setdefault(t, [0, 0])[toxic] += 1
    return sorted(((t, a, c) for t, (c, a) in n.items() if a >= 3 and a >= 0.6 * (a + c)), key=lambda r: (-r[1] / math.sqrt(r[2] + 1), r[0]))


def plain_label_model(votes, share):
    """A function from votes to the posterior."""
    n, v = len(votes), len(votes[0])
    mean = [sum(r[i] for r in votes) / n for i in range(v)]
    cov = [[sum(r[i] * r[j] for r in votes) / n - mean[i] * mean[j] for j in range(v)] for i in range(v)]
    live, spread = [i for i in range(v) if cov[i][i] > 1e-9], 1 - (2 * share - 1) ** 2
    beta = [0.0] * v
    for i in live:
        est = [cov[i][j] * cov[i][k] / cov[j][k] for j in live for k in live if i != j != k != i and abs(cov[j][k]) > 1e-7]
        est = [x for x in est if x > 0]
        size = math.sqrt(median(est) / spread) if est else 0.0
        others = [cov[i][j] for j in live if j != i]
        beta[i] = min(1.0, size) if not others or median(others) >= 0 else -min(1.0, size)
    rest = [[cov[i][j] - beta[i] * beta[j] * spread for j in range(v)] for i in range(v)]
    own = [math.sqrt(max(1e-6, rest[i][i])) for i in range(v)]
    shrink = [1 / (1 + sum(min(1.0, max(0.0, rest[i][j] / own[i] / own[j])) for j in range(v) if j != i)) for i in range(v)]
    odds = lambda a, b: math.log(min(2, max(0.002, a)) / min(2, max(0.002, b)))

    def posterior(row):
        z = math.log(share / (1 - share))
        for i, x in enumerate(row):
            alpha = mean[i] - beta[i] * (2 * share - 1)
            if beta[i] and x:
                z += shrink[i] * (odds(1 + alpha + beta[i], 1 + alpha - beta[i]) if x > 0 else odds(1 - alpha - beta[i], 1 - alpha + beta[i]))
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    return posterior


def plain_scores(votes, found, n_words, target, n_terms):
    dense = [[float(x > 0) for x in v] + [math.log1p(len(f)), float(len(f) > 1), math.log1p(1000 * len(f) / max(n, 1)), 1.0] for v, f, n in zip(votes, found, n_words, strict=True)]
    size = len(dense[0])
    rows = [[(i, x) for i, x in enumerate(d) if x] + [(size + t, 1.0) for t in f] for d, f in zip(dense, found, strict=True)]
    w, m, s = ([0.0] * (size + n_terms) for _ in range(3))
    sigmoid = lambda row: 1 / (1 + math.exp(-min(30, max(-30, sum(w[i] * x for i, x in row)))))
    for step in range(1, 401):
        g = [1e-5 * x for x in w]
        for row, t in zip(rows, target, strict=True):
            e = (sigmoid(row) - t) / len(rows)
            for i, x in row:
                g[i] += e * x
        for i, x in enumerate(g):
            m[i], s[i] = 0.9 * m[i] + 0.1 * x, 0.99 * s[i] + 0.01 * x * x
            w[i] -= 0.1 * (m[i] / (1 - 0.9**step)) / (math.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return [sigmoid(r) for r in rows]


def test_equals_plain_steps(spark):
    rng = random.Random(3)
    clean, bad = [f"calm{i}" for i in range(80)], ["blargon", "blargish", "blarg", "snorf", "quibbles", "idiot"]
    rows = []
    for i in range(240):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(clean) for _ in range(rng.randrange(3, 30))] + [rng.choice(bad) for _ in range(rng.randrange(1, 4) if toxic else rng.random() < 0.05)]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ("!!!" if rng.random() < 0.1 + 0.3 * toxic else ""), toxic))
    labels = [(i, t) for i, _, t in rows if i % 3]
    docs, lab = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = {i: t for i, t, _ in rows}
    assert len(set(texts.values())) == len(texts)
    mined = plain_mined([(texts[i], t) for i, t in labels])
    assert tox.mine(tox.distinct_texts(docs, lab)) == mined and len(mined) > 8
    read = [tox.Lexicon(mined).read(t) for _, t, _ in rows]
    votes = [r[0] for r in read]
    share = sum(t for _, t in labels) / len(labels)
    want = [plain_label_model(votes, share)(v) for v in votes]
    model = tox.label_model(tox.voted(docs, tox.Lexicon(mined)), share)
    assert model.posterior(np.array(votes)) == pytest.approx(want, abs=1e-6)
    got = {r.doc_id: r.score for r in tox.toxicity(docs, lab).collect()}
    scores = plain_scores(votes, [r[1] for r in read], [r[2] for r in read], want, len(mined))
    assert [got[i] for i in texts] == pytest.approx(scores, abs=1e-4)


def test_label_model_finds_accuracies_of_independent_voters():
    """Posteriors and accuracies against those counted with the truth, which the model never sees."""
    rng = np.random.default_rng(7)
    y = np.where(rng.random(60_000) < 0.3, 1, -1)
    right = (0.9, 0.8, 0.75, 0.7, 0.85)
    votes = np.column_stack([np.where(rng.random(len(y)) < a, y, -y) for a in right]).astype(float)
    model = tox.LabelModel(votes.mean(0), np.cov(votes.T, bias=True), 0.3)
    assert model.accuracy == pytest.approx([2 * a - 1 for a in right], abs=0.03) and model.correlation.max() < 0.05
    keys = [tuple(r) for r in votes]
    every, toxic = Counter(keys), Counter(k for k, t in zip(keys, y, strict=True) if t > 0)
    exact = np.array([toxic[k] / every[k] for k in keys])
    assert np.abs(model.posterior(votes) - exact).mean() < 0.03


def test_label_model_shares_the_weight_of_copied_voters():
    rng = np.random.default_rng(8)
    y = np.where(rng.random(60_000) < 0.5, 1, -1)
    votes = np.column_stack([np.where(rng.random(len(y)) < a, y, -y) for a in (0.9, 0.85, 0.8, 0.75, 0.7)]).astype(float)
    noisy = np.where(rng.random(len(y)) < 0.6, votes[:, 4], np.where(rng.random(len(y)) < 0.7, y, -y))
    both = np.column_stack([votes, noisy])
    model = tox.LabelModel(both.mean(0), np.cov(both.T, bias=True), 0.5)
    assert model.correlation[4, 5] > 0.3 and model.correlation[:4, :4].max() < 0.1 and max(model.shrink[4:]) < min(model.shrink[:4])
