import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import op13_spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows):
    """The contract in plain Python over rows (doc_id, text), all words against all."""
    lower, counts = str.maketrans(op13_spelling.UPPER, op13_spelling.LOWER), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def agrees(docs):
    got = sorted(tuple(r) for r in op13_spelling.spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    return want


@pytest.mark.parametrize("letters,size", [("ab", 5), ("abé", 7), ("aÿ×", 11)])
def test_few_letters(spark, letters, size):
    """Dense words over few letters: most have many near words, ties are common, chunks repeat inside a word."""
    rng = random.Random(size)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(size - 1, size + 1))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, [2.0 ** -(j % 7) for j in range(150)], k=60))) for i in range(60)]
    want = agrees(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(w[1] is not None for w in want) > 2


def test_roots_follow_chains(spark):
    """Seven words, each an edit from the next, which is twice as common."""
    chain = ["x" * i + "a" * (7 - i) for i in range(7)]
    want = agrees(spark.createDataFrame([(i, " ".join([w] * (3 << i))) for i, w in enumerate(chain)], "doc_id long, text string"))
    assert len({w[2] for w in want}) == 1


def test_each_place_and_kind_of_edit(spark):
    base = "abcdefghij"
    texts = []
    for n in range(5, 11):
        w = base[:n]
        texts += [w] * 20
        for i in range(n + 1):
            texts += [w[:i] + "z" + w[i:]] * 3
            if i < n:
                texts += [w[:i] + "y" + w[i + 1 :]] * 3 + [w[:i] + w[i + 1 :]] * 3
    agrees(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_words_that_begin_alike_are_not_paired(spark):
    """30,000 words share their first half: what the join puts out are links, and there are none."""
    words = spark.range(30_000).select(F.concat(F.lit("abcdefgh"), F.translate(F.lpad(F.conv((F.col("id") * 7919 % 32768).cast("string"), 10, 8), 8, "0"), "01234567", "klmnopqr")).alias("word"))
    thin = words.where(F.crc32(F.col("word").cast("binary")) % 4 == 0)
    assert op13_spelling.links(thin).join(thin.withColumnRenamed("word", "a"), "a").where(F.levenshtein("a", "b") != 1).isEmpty()
    keys = words.select(F.explode(op13_spelling.chunk_keys(F.col("word"))).alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] <= 8**4


def test_edge_documents(spark, edge_docs, no_docs):
    agrees(edge_docs.withColumn("word", F.lit("x")).withColumn("run", F.lit(1)).withColumn("n", F.lit(None)))
    assert op13_spelling.spelling_groups(no_docs).count() == 0


def test_real_words(spark, sf_dir):
    agrees(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0"))
