"""Spelling variants by asymmetric q-chunks: words one edit apart share a chunk, within a shift of one.

Of a pair the shorter word (of equal lengths either) gives its chunks, two disjoint ones of half its length, and the other
one its grams of that length at the places where such a chunk can be: one edit leaves a chunk of the two as it was, and
moves it by one at most. What is left beside that chunk is one edit apart in turn, so it is cut into two chunks as well.
The key of the join is both, three quarters of the word with the lengths, so a bucket holds only words that differ in
the quarter that is left: its size is bounded by the alphabet and that quarter, not by how many words begin alike. The
distance is verified in the join itself, so what it puts out are links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import broadcast_if_small, crc32_sql, drop_stored, stored, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least; how many times as common a word's form is.
LENGTH, COUNT, RATIO = 5, 3, 2
#: Of the occurrences whose checksum this divides, one code point is deleted.
DIVISOR = 97


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: how often the words occur in whole texts, one code point of some occurrences deleted; counted before the
    shuffle and after it, so a word of any frequency costs a row a task."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DIVISOR == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= COUNT)


def _key(length: Column, chunk: int, part: int, gram: Column, inner: Column) -> Column:
    return F.concat_ws("\t", length.cast("string"), F.lit(f"{chunk}{part}"), gram, inner)


def _cut(word: Column, at: Column, size: Column) -> Column:
    return F.substr(word, at + 1, size)


def chunk_keys(word: Column) -> Column:
    """Four keys: each of the word's two chunks with each of the two chunks of what is left beside it."""
    size, q = F.length(word), F.floor(F.length(word) / 2).cast("int")
    r = F.floor((size - q) / 2).cast("int")
    keys = []
    for chunk in (0, 1):
        rest = F.concat(F.left(word, chunk * q), F.substr(word, (chunk + 1) * q + 1))
        keys += [_key(size, chunk, part, _cut(word, chunk * q, q), _cut(rest, part * r, r)) for part in (0, 1)]
    return F.array(*keys)


def gram_keys(word: Column) -> Column:
    """The keys of the words of the same length, or one less, that this one may be an edit away from. A chunk that was left
    as it was is at its place where the edit is behind it, and one place on where it is before; so by length:
    none inserted: both chunks at their places; one inserted: the first chunk at its place or the second one moved."""
    size = F.length(word)
    keys = []
    for longer in (0, 1):
        of = size - longer
        q = F.floor(of / 2).cast("int")
        r = F.floor((of - q) / 2).cast("int")
        for chunk in (0, 1):
            at = chunk * (q + longer)
            rest = F.concat(F.left(word, at), F.substr(word, at + q + 1))
            keys += [_key(of, chunk, part, _cut(word, at, q), _cut(rest, part * (r + longer), r)) for part in (0, 1)]
    return F.array(*keys)


def links(words: DataFrame) -> DataFrame:
    """a, b: the pairs of words(word) that are one inserted, deleted or replaced code point apart, each once."""
    chunks = words.select(F.col("word").alias("a"), F.explode(F.array_distinct(chunk_keys(F.col("word")))).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.explode(F.array_distinct(gram_keys(F.col("word")))).alias("key"))
    shorter = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    near = chunks.join(grams, "key").where(shorter & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): where following the forms ends. Each round follows twice as many as the one before,
    and a form is at least twice as common as its word, so there are few."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = broadcast_if_small(now.select(F.col("word").alias("w"), F.col("root").alias("further")))
        moved = stored(now.join(up, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_stored(now)
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of at least 5 code points that occurs at least 3 times.

    Null texts and those without words give none; very long ones are read whole; a null id is written as nothing before
    the colon. Repeated rows count as often as they stand there. Of equally common near words the one first in
    code-point order is the form. An empty table gives no rows. Other columns, whatever their names, are not read."""
    words = stored(word_counts(docs, id_col, text_col))
    pairs = stored(links(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Partners' counts by a join, best partners by an aggregation: a word of many partners is a row a task.
    partners = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = partners.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    out = stored(words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False))))
    end = roots(out.where("is_form").select("word", F.col("best.form").alias("form")))
    drop_stored(pairs), drop_stored(words)
    mine = lambda c: F.when(F.col("is_form"), c)
    out = out.join(end, "word", "left")
    return out.select("word", mine(F.col("best.form")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), mine(-F.col("best.less")).alias("form_n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


#: DuckDB compares bytes: the letters from U+00C0 on stand for bytes that words don't hold.
_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = UPPER + "0123456789" + "".join(c for c in "!#$%&()*+,-./:;<=>?@[]^_`{|}~")[:28]
ORACLE_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT run, c, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL)),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % {DIVISOR} = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM d)
  WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {COUNT}),
x AS MATERIALIZED (SELECT word, n, length(word) AS l, translate(word, '{_LETTERS}', '{_BYTES}') AS b FROM w),
near AS MATERIALIZED (SELECT p.word, p.n, q.word AS form, q.n AS form_n FROM x p JOIN x q ON abs(p.l - q.l) <= 1 AND p.word <> q.word AND levenshtein(p.b, q.b) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(form, (-form_n, form)) AS form, max(form_n) AS form_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * w.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f e ON e.word = up.root WHERE e.form IS NULL
"""
