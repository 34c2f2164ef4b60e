"""Toxicity by weak supervision.

Lexicons are mined from the labelled rows that aren't held out: whole words, word beginnings, and beginnings that
come twice or thrice in one text, whose texts are mostly toxic. Many voters (one per lexicon kind, numbers of different bad words, a small fixed lexicon, and patterns)
vote toxic, clean or abstain on every document. A generative label model takes the voters' means and
covariances over all documents: triplets of covariances give each voter's accuracy without labels, what
the accuracies don't explain is correlation and shrinks the correlated voters' weights. The model's
posteriors are the targets of a linear classifier over lexicon hits, which gives the scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import stored, table

#: Texts a mined term needs, and the share of them that must be toxic.
SUPPORT, PRECISION = 3, 0.6
#: Labelled rows that the lexicons are mined from: all of them up to about this many, beyond it those below a hash.
LABELLED_ROWS = 50_000
#: Rows that the linear classifier is fitted on, about: those below a hash of their id, equal ones as one with a weight.
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Fixed: a few common insults, so that an untrained model isn't blind.
SEED_WORDS = frozenset("idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb idiota imbécile estúpido dummkopf arschloch connard basura".split())
YOU = frozenset("you your ur du dein dich tu te vous vos usted tus".split())
WORDS = re.compile(r"\w+")
MASKED = re.compile(r"\b[a-z][*@#$]{1,4}[a-z]+", re.IGNORECASE)
#: Whether a code point is an upper-case character; beyond the table none is.
UPPER = np.array([chr(i).isupper() for i in range(0x20000)])
#: Whole words, beginnings of 4 and 5 letters, beginnings of 5 letters with two and with three words in the text.
KINDS = ("w", "4", "5", "d", "t")
N_LEXICONS = len(KINDS)
#: A term's share of toxic texts from which it votes for its kind; weaker ones only count among a text's bad words.
SURE = 0.95
#: Of so many lexicons a text without a hit is clean; without a repeated beginning it may be anything.
SAYS_CLEAN = 3
N_VOTERS = N_LEXICONS + 8


def terms_of(counts: Counter) -> set[str]:
    """The terms of a text's word counts, tagged by kind."""
    five = Counter()
    for w, n in counts.items():
        if len(w) > 5:
            five[w[:5]] += n
    return {"w" + w for w in counts} | {"4" + w[:4] for w in counts if len(w) > 4} | {k + p for p, n in five.items() for k in "5dt"[:n]}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[bool(toxic)].update(terms_of(Counter(WORDS.findall(text.lower()))))
        keys = list({*n[0], *n[1]})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["term", "toxic", "clean"])


def n_upper(text: str) -> int:
    """Upper-case characters of the whole text."""
    if text.isascii():
        return int(np.count_nonzero(UPPER[np.frombuffer(text.encode(), np.uint8)]))
    return int(np.count_nonzero(UPPER[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(UPPER) - 1)]))


class Lexicon:
    """term -> (number, voter); the voter goes by the term's kind, None for weak terms."""

    def __init__(self, mined: list[tuple[str, int, int]]):
        self.terms: dict[str, tuple[int, int | None]] = {}
        for i, (term, toxic, clean) in enumerate(mined):
            self.terms[term] = i, KINDS.index(term[0]) if toxic >= SURE * (toxic + clean) else None
        self.five = {t[1:] for t in self.terms if t[0] in "5dt"}

    def read(self, text: str) -> tuple[list[int], list[int], int]:
        """Votes of all voters, the numbers of the terms found, and the word count."""
        words = WORDS.findall(text.lower())
        counts, hits, found, bad = Counter(words), [0] * N_LEXICONS, [], set()
        get, five = self.terms.get, {}

        def hit(term: str, of: list[str]) -> None:
            if (x := get(term)) is not None:
                found.append(x[0])
                bad.update(of)
                if x[1] is not None:
                    hits[x[1]] = 1

        for w in counts:
            hit("w" + w, [w])
            if len(w) > 4:
                hit("4" + w[:4], [w])
            if len(w) > 5 and w[:5] in self.five:
                five.setdefault(w[:5], []).append(w)
        for p, of in five.items():
            for k in "5dt"[: sum(counts[w] for w in of)]:
                hit(k + p, of)
        clean = -1 if len(words) >= 5 else 0
        votes = [h or (clean if i < SAYS_CLEAN else 0) for i, h in enumerate(hits)]
        votes += [1 if len(bad) >= k else 0 if bad else clean for k in (2, 3, 5)]
        seeds = sum(counts[w] for w in SEED_WORDS if w in counts)
        near = bool(bad) and any(w in YOU and any(x in bad for x in words[max(0, i - 3) : i + 4]) for i, w in enumerate(words))
        letters = n_upper(text) if len(text) > 20 else 0
        votes += [1 if seeds else clean, int(near), int(letters > 0.5 * len(text)), int("!!!" in text), int(bool(MASKED.search(text)))]
        return votes, sorted(set(found)), len(words)


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About n rows, all where there are fewer: those whose key's hash is below a threshold that the row count gives."""
    share = n / max(1, df.count())
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(share * (1 << 40)))


def distinct_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of about LABELLED_ROWS labelled documents at most, one of each text. The ids are bounded, so they are
    broadcast, and texts are never shuffled."""
    some = sampled(labels, LABELLED_ROWS, "doc_id")
    one = docs.join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return docs.join(F.broadcast(some.join(F.broadcast(one.select("doc_id").distinct()), "doc_id")), "doc_id").select("text", "toxic")


def mine(labelled: DataFrame) -> list[tuple[str, int, int]]:
    """The terms of labelled(text, toxic) whose texts are mostly toxic, counted over all its rows, best first."""
    n = labelled.mapInArrow(_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = n.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    strength = F.col("toxic") / F.sqrt(F.col("clean") + 1.0)
    return [(r.term, r.toxic, r.clean) for r in n.orderBy(strength.desc(), "term").collect()]  # terms of LABELLED_ROWS texts


def voted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, votes, found, n_words) of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, found, n = zip(*(lexicon.read(t or "") for t in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32())), pa.array(n, pa.int64())], ["doc_id", "votes", "found", "n_words"])

    return docs.mapInArrow(run, "doc_id long, votes array<int>, found array<int>, n_words long")


class LabelModel:
    """log-odds = bias + votes' weights, from the voters' means, covariances and the share of toxic rows."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, share: float):
        v = len(mean)
        spread = 1 - (2 * share - 1) ** 2
        live = [i for i in range(v) if cov[i, i] > 1e-9]
        beta = np.zeros(v)
        for i in live:
            # Over all pairs j, k: cov_ij cov_ik / cov_jk = beta_i^2 Var(Y) if the three agree through Y alone.
            est = [cov[i, j] * cov[i, k] / cov[j, k] for j in live for k in live if len({i, j, k}) == 3 and abs(cov[j, k]) > 1e-7]
            est = [x for x in est if x > 0]
            beta[i] = math.sqrt(np.median(est) / spread) if est else 0.0
            beta[i] *= 1 if np.median([cov[i, j] for j in live if j != i] or [0]) >= 0 else -1
        beta = np.clip(beta, -1, 1)
        alpha = mean - beta * (2 * share - 1)
        rest = cov - np.outer(beta, beta) * spread
        own = np.sqrt(np.clip(np.diag(rest), 1e-6, None))
        corr = np.clip(rest / np.outer(own, own), 0, 1)
        np.fill_diagonal(corr, 0)
        self.shrink = 1 / (1 + corr.sum(1))
        odds = lambda a, b: np.log(np.clip(a, 0.002, 2) / np.clip(b, 0.002, 2))
        self.plus = np.where(beta == 0, 0, odds(1 + alpha + beta, 1 + alpha - beta)) * self.shrink
        self.minus = np.where(beta == 0, 0, odds(1 - alpha - beta, 1 - alpha + beta)) * self.shrink
        self.bias, self.accuracy, self.correlation = math.log(share / (1 - share)), beta, corr

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.bias + (votes > 0) @ self.plus + (votes < 0) @ self.minus
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: DataFrame, share: float) -> LabelModel:
    """One aggregation over all documents: counts, sums and products of the votes."""
    at = lambda i: F.col("votes")[i].cast("double")
    pairs = [(i, j) for i in range(N_VOTERS) for j in range(i, N_VOTERS)]
    sums = votes.agg(F.count("*"), *[F.sum(at(i)) for i in range(N_VOTERS)], *[F.sum(at(i) * at(j)) for i, j in pairs]).first()
    n = max(1, sums[0])
    mean = np.array([x or 0.0 for x in sums[1 : 1 + N_VOTERS]]) / n
    cov = np.zeros((N_VOTERS, N_VOTERS))
    for (i, j), x in zip(pairs, sums[1 + N_VOTERS :], strict=True):
        cov[i, j] = cov[j, i] = (x or 0.0) / n - mean[i] * mean[j]
    return LabelModel(mean, cov, share)


def _dense(votes: np.ndarray, found: list, n_words: np.ndarray) -> np.ndarray:
    hits = np.array([len(f) for f in found], float)
    return np.column_stack([(votes > 0), np.log1p(hits), hits > 1, np.log1p(1000 * hits / np.maximum(n_words, 1)), np.ones(len(votes))]).astype(float)


class Linear:
    """Logistic regression on lexicon terms and votes, fitted to weighted soft labels by full-batch gradient steps."""

    def __init__(self, votes: np.ndarray, found: list, n_words: np.ndarray, target: np.ndarray, weight: np.ndarray, n_terms: int, steps: int = 400):
        x = _dense(votes, found, n_words)
        weight = weight / weight.sum()
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        col = np.concatenate([np.asarray(f, np.int64) for f in found]) if len(row) else np.zeros(0, np.int64)
        self.w, self.t = np.zeros(x.shape[1]), np.zeros(n_terms)
        m = [np.zeros_like(self.w), np.zeros_like(self.t)]
        s = [np.zeros_like(self.w), np.zeros_like(self.t)]
        for k in range(1, steps + 1):
            z = x @ self.w + np.bincount(row, self.t[col], len(x))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
            for i, (p, g) in enumerate(((self.w, x.T @ e + 1e-5 * self.w), (self.t, np.bincount(col, e[row], n_terms) + 1e-5 * self.t))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                p -= 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(s[i] / (1 - 0.99**k)) + 1e-8)

    def score(self, votes: np.ndarray, found: list, n_words: np.ndarray) -> np.ndarray:
        z = _dense(votes, found, n_words) @ self.w + np.array([self.t[f].sum() if len(f) else 0.0 for f in found])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """doc_id, score, predicted for every row; also stores nothing of labels but what the lexicons learnt.

    labels(doc_id, toxic): rows for which held_out (a Column of doc_id) is true are not read; null labels are
    skipped, documents without a label are scored alike; of several labels of one id the toxic one counts. Null and
    empty texts are scored as empty, very long ones are read whole. Repeated rows are scored each, equal texts alike;
    further columns are not read; an empty table gives no rows. Terms of equal strength go by name. Without any toxic
    label only the fixed lexicon and the patterns vote, with an assumed share of a tenth."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null")
    if held_out is not None:
        lab = lab.where(~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = lab.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    share = min(0.5, max(0.01, share)) if share else 0.1
    mined = mine(distinct_texts(d.where("text is not null"), lab))
    lexicon = Lexicon(mined)
    votes = stored(voted(d, lexicon))
    labelling = label_model(votes, share)
    sample = sampled(votes, FIT_ROWS, "doc_id").groupBy("votes", "found", "n_words").agg(F.count("*").alias("n")).orderBy("votes", "found", "n_words").collect()
    if not sample:
        return d.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    matrix = np.array([r.votes for r in sample])
    found, n_words = [np.asarray(r.found, np.int64) for r in sample], np.array([r.n_words for r in sample])
    linear = Linear(matrix, found, n_words, labelling.posterior(matrix), np.array([r.n for r in sample], float), max(1, len(mined)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [np.asarray(f, np.int64) for f in batch.column(2).to_pylist()]
                p = linear.score(np.array(batch.column(1).to_pylist()), found, batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return votes.mapInArrow(run, "doc_id long, score double, predicted int")


def is_held_out(doc_id):
    """The contract's folds: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, held_out=is_held_out).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
