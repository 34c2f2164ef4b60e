import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textloom.llm import op11_tokens


@pytest.fixture(scope="module")
def vocabulary(spark):
    return op11_tokens.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def agrees(docs, vocabulary, **settings):
    """Ids equal those of the library, decoding gives the texts' bytes, and no row is lost."""
    out = op11_tokens.encode(docs, vocabulary, **settings)
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.back)) for r in out.withColumn("back", op11_tokens.decoded(F.col("ids"), vocabulary)).collect())
    library = vocabulary.coder().merges
    want = sorted((str(r.doc_id), np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert got == want


@pytest.mark.parametrize("step,overlap", [(24, 8), (16, 16), (300, 20)])
def test_seams_where_anything_meets(spark, vocabulary, step, overlap):
    """Short chunks over contractions, white space of all kinds, runs longer than the overlap, marks and emoji."""
    rng = random.Random(step)
    parts = ["a", "b", "é", "1", "  ", "\n", " ", "'", "'s", "'re", "'r", "e", "ll", "!", "\t", "　", "日本", "😀", "́", "<|endoftext|>", "\x1c"]
    rows = [(i, "".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 30]) for _ in range(rng.randint(1, 200)))) for i in range(250)]
    agrees(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, step=step, overlap=overlap)


def test_runs_without_any_boundary(spark, vocabulary):
    rows = [(1, "a" * 300_000), (2, " " * 100_000 + "b" + "\n" * 40_000), (3, "x1 " * 60_000), (4, "7" * 16_384), (5, "q" * 16_385), (6, "é日 " * 30_000)]
    agrees(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary)


def test_edge_documents(spark, vocabulary, edge_docs, no_docs):
    agrees(edge_docs.withColumn("row", F.lit("x")).withColumn("ids", F.lit(1)), vocabulary)
    assert op11_tokens.encode(no_docs, vocabulary).count() == 0
    with pytest.raises(ValueError):
        op11_tokens.encode(edge_docs, vocabulary, step=8, overlap=9)


def test_query_on_whole_table(spark, vocabulary, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    agrees(docs, vocabulary)
    out = op11_tokens.op11_tokens(spark, sf_dir).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")), "doc_id")
    assert out.count() == docs.count() == out.where("decoded_sha256 = want").count()
