import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import op12_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """The manifest of rows (doc_id, text, lang, source, n_chars) in plain Python."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: digest(field(r[0]), field(r[3]), field(r[2]), field(None if r[4] is None else r[4] + more), field(r[1]))
    trees = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, 1) if hit else leaf(r), r[0]))
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k])]) for k in langs}
    top, out = levels([built[k][-1][0] for k in langs]) if langs else [], []
    for n, k in enumerate(langs):
        for i, x in enumerate(sorted(trees[k])):
            h, proof = x[3], []
            for tree, at in ((built[k], i), (top, n)):
                for level in tree[:-1]:
                    mine = [h] if at % 2 == 0 else [level[at - 1], h]
                    if at % 2 == 0 and at + 1 < len(level):
                        mine.append(level[at + 1])
                    proof += [y for j, y in enumerate(mine) if j != at % 2]
                    h, at = digest(*mine), at // 2
            out.append((x[4], x[2], built[k][-1][0], top[-1][0], "".join(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def agrees(df):
    got = op12_manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    want = plain([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert sorted(map(tuple, got), key=str) == want
    return want


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1025])
def test_sizes_around_a_stride(spark, n):
    agrees(spark.createDataFrame([(i, "x" * (i % 5), "en", "a", i) for i in range(n)], SCHEMA))


def test_many_languages_nulls_and_repeats(spark):
    rows = [(i if i % 9 else None, "é" * (i % 5) if i % 4 else None, None if i % 3 == 0 else f"l{i % 300}", None if i % 7 == 0 else "a", i if i % 5 else None) for i in range(900)]
    want = agrees(spark.createDataFrame(rows + [(3, "again", "en", "a", 1)] * 5, SCHEMA))
    assert {w[-1] for w in want} == {True, False}


def test_edge_documents(spark, edge_docs, no_docs):
    agrees(edge_docs.withColumn("tree", F.lit("x")).withColumn("pos", F.lit(None)).withColumn("leaf", F.lit(1)))
    assert op12_manifest.manifest(no_docs).count() == 0


@pytest.mark.parametrize("n", [63, 64, 65, 3000])
def test_several_strides(spark, monkeypatch, n):
    """Up to six strides of two levels: the query climbs stored rows of upper levels again and again."""
    monkeypatch.setattr(op12_manifest, "STRIDE", 2)
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    agrees(df)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_tampering_is_found_and_only_that(spark, sf_dir):
    out = op12_manifest.op12_manifest(spark, sf_dir)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars is not null")
    assert out.where("not verified").count() == docs.where(hit).count() and out.where(~F.col("verified") & ~hit).isEmpty()
