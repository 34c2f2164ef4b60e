"""Merkle manifest of documents: levels built block by block and stored as parent-linked rows, climbed by a recursive query.

Leaves are sorted by tree (one for each language) and doc_id over all tasks and numbered by partition. The tree is built
ten levels at a time: the up to 1,024 nodes under one ancestor are one row of a shuffle, whose hashes fold in place. What is
stored is a row for each node of every tenth level: its hash, the ancestor it is linked to, and the siblings on the way
there. The top of each language's tree is linked to its leaf in a last tree of the languages, so the recursive query needs
one rule: join a row to its ancestor's, append that one's siblings, fold the hash over them, until there is no ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.work import broadcast_if_small, crc32_sql, stored, table

#: Levels from a stored row to the ancestor it is linked to.
STRIDE = 10
#: The number of the tree of the languages; theirs are counted from 1.
TOP = 0


def field(c: Column) -> Column:
    """- for null, else the bytes that the value's text has, a colon and the text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered, the leaf of the same row with one more character counted where 7 divides the
    checksum of its doc_id; a null count stays null, a null doc_id is never tampered with."""
    leaf = lambda n: F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))), 256)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    kept = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)).alias("other"))
    return kept.select("doc_id", "lang", "leaf", F.coalesce("other", "leaf").alias("tampered"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with tree and pos, their place in it, and the trees (tree, lang, n); null languages and doc_ids come
    first, equal doc_ids go by their leaves. Sorted over all tasks: a row's number is its place in its partition and the
    rows before that, its place in the tree is the number less that of the tree's first row. A language may fill any
    number of partitions; each partition adds one row to what is summed up on the way."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "tampered"]
    at = F.monotonically_increasing_id()
    s = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    s = s.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    sums = F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = s.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(sums, F.lit(0))).drop("rows")
    s = s.join(F.broadcast(parts), "part").withColumn("no", F.col("before") + F.col("at"))
    langs = stored(s.groupBy("lang").agg(F.min("no").alias("first"), F.count("*").alias("n")))
    # Trees are numbered by language in the same way; there are as many as languages.
    by_lang = stored(langs.repartitionByRange(F.col("lang").asc_nulls_first()).sortWithinPartitions(F.col("lang").asc_nulls_first()).withColumn("at", at))
    by_lang = by_lang.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    parts = by_lang.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(sums, F.lit(0))).drop("rows")
    trees = stored(by_lang.join(F.broadcast(parts), "part").select((F.col("before") + F.col("at") + 1).alias("tree"), "lang", "first", "n"))
    small = trees.select("tree", F.col("lang").alias("l"), "first")
    leaves_ = s.join(broadcast_if_small(small), F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "leaf", "tampered", "tree", (F.col("no") - F.col("first")).alias("pos"))
    return stored(leaves_), trees.select("tree", "lang", "n")


def _halved(a: Column) -> Column:
    """The level above: every two hashes are one, a last one without a partner by itself."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat(a[i * 2], F.coalesce(F.get(a, i * 2 + 1), F.lit(""))), 256))


#: The hash (binary) above a node whose hash is {h}, over siblings; a null one stands for a level where the node was alone.
FOLD = """unhex(aggregate({siblings}, lower(hex({h})), (a, s) -> sha2(CASE WHEN s.hash IS NULL THEN a WHEN s.left
  THEN concat(lower(hex(s.hash)), a) ELSE concat(a, lower(hex(s.hash))) END, 256)))"""
NODE = ["tree", "level", "pos", "hash", "up_tree", "up_level", "up_pos", "siblings"]


def blocks(level: DataFrame, sizes: DataFrame, depth: int, top: Column, payload: list[str]) -> DataFrame:
    """NODE and payload of the nodes (tree, pos, hash, *payload) at one level: what each is linked to and its siblings below
    that. sizes(tree, steps): levels from the leaves to the tree's top; top: what the top is linked to. Nodes that are a
    top themselves are left out, but for the leaf of a tree of one."""
    b = level.join(sizes, "tree").where((F.col("steps") > depth) | F.lit(depth == 0)).withColumn("up", F.shiftright("pos", STRIDE))
    b = b.withColumn("ends", F.col("steps") - depth <= STRIDE).withColumn("steps", F.least(F.col("steps") - depth, F.lit(STRIDE)))
    b = b.groupBy("tree", "up", "steps", "ends").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *payload))).alias("x"))
    b = b.withColumn("l0", F.transform("x", lambda x: F.lower(F.hex(x["hash"]))))
    for t in range(1, STRIDE):
        b = b.withColumn(f"l{t}", F.when(F.col("steps") > t, _halved(F.col(f"l{t - 1}"))))
    b = b.withColumn("levels", F.array(*[f"l{t}" for t in range(STRIDE)]))
    bit = lambda j, t: F.floor(j / F.pow(F.lit(2), t)).cast("int")
    sibling = lambda j: lambda t: F.struct(F.unhex(F.get(F.get("levels", t), bit(j, t).bitwiseXOR(1))).alias("hash"), (bit(j, t) % 2 == 1).alias("left"))
    steps = F.when(F.col("steps") > 0, F.sequence(F.lit(0), F.col("steps") - 1)).otherwise(F.array().cast("array<int>"))
    rows = b.select("tree", "up", "ends", F.explode(F.transform("x", lambda x, j: F.struct(x.alias("x"), F.transform(steps, sibling(j)).alias("siblings")))).alias("n"))
    inside = lambda there, here: F.when(F.col("ends"), there).otherwise(here)
    return rows.select(
        "tree", F.lit(depth).alias("level"), F.col("n.x.pos").alias("pos"), F.col("n.x.hash").alias("hash"), inside(top["tree"], F.col("tree")).alias("up_tree"),
        inside(F.when(top["tree"].isNotNull(), 0), F.lit(depth + STRIDE)).alias("up_level"), inside(top["pos"], F.col("up")).alias("up_pos"), "n.siblings", *[F.col(f"n.x.{c}").alias(c) for c in payload],
    )


def build(rows: DataFrame, trees: DataFrame, top: Column, payload: list[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The stored NODE rows over leaves rows(tree, pos, hash, *payload), a table for every STRIDE levels, the first one with
    the payload, and the tops (tree, hash). trees(tree, n): numbers of leaves. A level is folded from the stored rows below,
    so a round is one shuffle of a 1,024th of the nodes of the round before."""
    # Halvings of n, rounded up, until one is left: the binary digits of n - 1.
    sizes = broadcast_if_small(trees.select("tree", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("steps")))
    most = sizes.agg(F.max("steps")).first()[0] or 0
    level, made, tops = rows, [], []
    for depth in range(0, max(most, 1), STRIDE):
        made.append(stored(blocks(level, sizes, depth, top, list(payload) if not depth else [])))
        first = made[-1].where(F.col("pos") % (1 << STRIDE) == 0).withColumn("hash", F.expr(FOLD.format(siblings="siblings", h="hash")))
        ends = ~(F.col("up_tree").eqNullSafe(F.col("tree")))
        tops.append(first.where(ends).select("tree", "hash"))
        level = first.where(~ends).select("tree", F.col("up_pos").alias("pos"), "hash")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return made, stored(out)


PROOF = "array_join(transform(filter({siblings}, s -> s.hash IS NOT NULL), s -> hex(s.hash)), '')"
CLIMB = f"""
WITH RECURSIVE climb (doc_id, leaf, of, up_tree, up_level, up_pos, folded, proof) AS (
  SELECT doc_id, hash, tree, up_tree, up_level, up_pos, {FOLD.format(siblings="siblings", h="tampered")}, unhex({PROOF.format(siblings="siblings")}) FROM {{leaves}}
  UNION ALL
  SELECT c.doc_id, c.leaf, c.of, n.up_tree, n.up_level, n.up_pos, {FOLD.format(siblings="n.siblings", h="c.folded")}, concat(c.proof, unhex({PROOF.format(siblings="n.siblings")}))
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos
)
SELECT doc_id, leaf, of, folded, proof FROM climb WHERE up_tree IS NULL
"""


#: What holds while the recursive query runs. Its rows are as many as leaves times strides, beyond Spark's usual limit of a
#: million; and what each round deals out is even as it is, so it isn't cut into pieces of the advisory size.
LOOP = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "false"}


def climbed(leaves_: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, leaf, of (its tree), folded and proof (the siblings' digests on end) of the leaves' rows, by the recursive query."""
    spark = leaves_.sparkSession
    before = {k: spark.conf.get(k) for k in LOOP}
    try:
        for k, v in LOOP.items():
            spark.conf.set(k, v)
        return stored(spark.sql(CLIMB, leaves=leaves_, nodes=broadcast_if_small(nodes)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings' hex digests on end, from the leaf up, left to right), folded_root
    and verified for each row of docs(doc_id, source, lang, n_chars, text).

    Null fields are written as -; null languages are a tree of their own, the first one; rows without a doc_id come first in
    theirs. Equal doc_ids are ordered by their leaves, and repeated rows are leaves beside each other. Empty and very
    long texts are hashed whole. An empty table gives no rows. Other columns, whatever their names, are not read."""
    rows, trees = placed(stored(leaves(docs)))
    rows = rows.select("tree", "pos", F.unhex("leaf").alias("hash"), "doc_id", F.unhex("tampered").alias("tampered"))
    of_languages = F.struct(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"))
    nodes, subroots = build(rows, trees, of_languages, ["doc_id", "tampered"])
    # Stored, so that the join with the one tree's size is an equi-join and not one with a constant.
    above = stored(subroots.select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), "hash"))
    none = F.lit(None).cast("long")
    last, roots = build(above, above.groupBy("tree").agg(F.count("*").alias("n")), F.struct(none.alias("tree"), none.alias("pos")))
    upper = last[0]
    for part in [*last[1:], *nodes[1:]]:
        upper = upper.unionByName(part)
    root = roots.first()
    done = climbed(nodes[0], upper).join(broadcast_if_small(subroots.select(F.col("tree").alias("of"), F.col("hash").alias("subroot"))), "of")
    hex_ = lambda c: F.lower(F.hex(c))
    root = F.lit(root.hash.hex() if root else None)
    out = done.select("doc_id", hex_("leaf").alias("leaf"), hex_("subroot").alias("subroot"), root.alias("root"), hex_("proof").alias("proof"), hex_("folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = manifest(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
_LEAF = "sha256(" + " || ".join([*[_FIELD.format(c=c) for c in ("doc_id", "source", "lang")], "{n}", _FIELD.format(c="text")]) + ")"
_UP = "list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], '')))"
_NODES = "level, unnest(h) AS h, unnest(range(len(h))) AS pos"
_FOLD = "c.p // 2, sha256(CASE WHEN n.h IS NULL THEN c.f WHEN c.p % 2 = 1 THEN n.h || c.f ELSE c.f || n.h END), c.proof || coalesce(n.h, '')"
ORACLE_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, t) - 1 AS pos FROM (
  SELECT doc_id, lang, {_LEAF.format(n=_FIELD.format(c="n_chars"))} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.format(n=_FIELD.format(c="(n_chars + 1)"))} ELSE leaf END AS t FROM documents)),
up(lang, level, h) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM leaf GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM up WHERE len(h) > 1),
sub AS MATERIALIZED (SELECT lang, level AS steps, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no FROM up WHERE len(h) = 1),
top(level, h) AS (SELECT 0, list(subroot ORDER BY no) FROM sub UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(h) > 1),
root AS (SELECT level AS steps, h[1] AS root FROM top WHERE len(h) = 1),
nodes AS MATERIALIZED (SELECT lang, {_NODES} FROM up), top_nodes AS MATERIALIZED (SELECT {_NODES} FROM top),
c1(k, lang, level, p, f, proof) AS (SELECT k, lang, 0, pos, t, '' FROM leaf
  UNION ALL SELECT c.k, c.lang, c.level + 1, {_FOLD} FROM c1 c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang AND c.level < s.steps
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM c.lang AND n.level = c.level AND n.pos = xor(c.p, 1)),
c2(k, level, p, f, proof) AS (SELECT k, 0, no, f, proof FROM c1 JOIN sub ON sub.lang IS NOT DISTINCT FROM c1.lang AND level = steps
  UNION ALL SELECT c.k, c.level + 1, {_FOLD} FROM c2 c JOIN root r ON c.level < r.steps LEFT JOIN top_nodes n ON n.level = c.level AND n.pos = xor(c.p, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang JOIN c2 USING (k) JOIN root ON c2.level = root.steps
"""
