"""Sources and sinks: the given tables are written as files to the shared folder and read back, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import corpus, lexical, lookup, ngram
from textloom.operators.shared import new_path, stored
from textloom.plans.queries import ASSETS, EVERY_ASSET, KEYS, LAYERS, LEX, LOW, PAD, RECORDS, _assets, _every_asset, _layers, grams_sql, keys, query, records, sentences, table, words
from textloom.sources import docx, readers, writers

#: Lines of a file as the readers split them, blank ones left out.
DOC_LINES = r"lines AS MATERIALIZED (SELECT source, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS text FROM documents)"
BLANK = r"regexp_matches(text, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$')"


def _written(df: DataFrame, by: str | None = None) -> str:
    """df(value) as text files in a new folder."""
    path = new_path(df.sparkSession, "files")
    (df.write.partitionBy(by) if by else df.write).text(path)
    return path


@query(f"WITH {DOC_LINES} SELECT source, text, count(*) AS cnt, count(*) AS places FROM lines WHERE NOT {BLANK} GROUP BY 1, 2")
def q_read_lines(spark, sf_dir):
    """Documents as text files in folders by source, read as a directory of records; places are distinct file and line."""
    path = _written(table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")), "source")
    r = readers.read_directory(spark, path).where("source_type = 'txt'").withColumn("source", F.regexp_extract("source_path", "source=([^/]*)/", 1))
    return r.groupBy("source", "text").agg(F.count("*").alias("cnt"), F.count_distinct("source_path", "reference").alias("places"))


@query(f"WITH {DOC_LINES} SELECT source_rank, count(*) AS records FROM (SELECT unnest([1, 2]) AS source_rank, text FROM lines WHERE NOT {BLANK}) GROUP BY 1")
def q_read_corpus(spark, sf_dir):
    """One folder listed as the second and third source after a missing one."""
    path = _written(table(spark, sf_dir, "documents").select(F.col("text").alias("value")))
    return readers.read_corpus(spark, [f"{path}-missing", path, path]).groupBy("source_rank").agg(F.count("*").alias("records"))


@query(
    r"""WITH b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
SELECT array_to_string(l, ' ') AS text, count(*) AS cnt FROM b WHERE len(l) > 0 GROUP BY 1"""
)
def q_read_srt(spark, sf_dir):
    """Conversations as subtitle blocks: a number, a time line, the turn's lines."""
    lines = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), lines, F.lit("\n"))
    path = _written(table(spark, sf_dir, "conversations").select(block.alias("value")))
    return readers.read_srt(spark, path, glob="*.txt").groupBy("text").agg(F.count("*").alias("cnt"))


WHITE = BLANK.split("^")[1].split("*$")[0]


@query(
    f"""SELECT doc_id, 'paragraph ' || n AS reference, text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n,
regexp_replace(regexp_replace(unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))), '^{WHITE}+', ''), '{WHITE}+$', '') AS text FROM documents) WHERE text <> ''"""
)
def q_read_docx(spark, sf_dir):
    """Every document as a Word file with a paragraph for each line, read back as records."""
    path = new_path(spark, "files")
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    docx.write_documents(d.select(F.col("doc_id").cast("string").alias("name"), "text"), path)
    r = readers.read_docx(spark, path)
    return r.select(F.regexp_extract("source_path", r"([^/]*)\.docx$", 1).cast("long").alias("doc_id"), "reference", "text")


@query(f"WITH {RECORDS}, {LEX} SELECT DISTINCT word FROM wc")
def q_read_lexicon(spark, sf_dir):
    """A CSV whose keyword is blank for some words and another column stands in for it."""
    w = words(spark, sf_dir).select("word").distinct()
    path = new_path(spark, "files")
    w.select(F.when(F.length("word") % 2 == 0, F.col("word")).alias("keyword"), F.lit("x").alias("note"), F.when(F.length("word") % 2 == 1, F.col("word")).alias("audio_file")).write.csv(path, header=True)
    return readers.read_lexicon(spark, path)


@query(f"WITH {RECORDS}, {LEX}, {ASSETS} SELECT word, asset_id FROM assets WHERE NOT regexp_matches(word, '[ÃÂâÌÉð]')")
def q_read_asset_map(spark, sf_dir):
    a = _assets(spark, sf_dir).where("not word rlike '[ÃÂâÌÉð]'")
    path = new_path(spark, "files")
    a.write.csv(path, header=True, escape='"')
    return readers.read_asset_map(spark, path)


@query(f"WITH {RECORDS}, {LEX}, {ASSETS} SELECT word, asset_id FROM assets WHERE NOT regexp_matches(word, '[ÃÂâÌÉð]')")
def q_read_asset_text(spark, sf_dir):
    """The same map as lines of quoted pairs, each written twice: the later value wins."""
    esc = F.replace(F.replace("word", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pair = lambda v: F.concat(F.lit('"'), esc, F.lit('": "'), v, F.lit('"'))
    a = _assets(spark, sf_dir).where("not word rlike '[ÃÂâÌÉð]'")
    return readers.read_asset_map(spark, _written(a.select(F.concat_ws(",\n", pair(F.lit("old")), pair("asset_id")).alias("value"))), text=True)


KV = f"{RECORDS}, {LEX}, {KEYS}, kv AS (SELECT CASE WHEN length(key) = 4 THEN left(key, 2) || ' ' || key ELSE key END AS key, value FROM keys)"


def _kv(spark, sf_dir) -> DataFrame:
    return keys(spark, sf_dir).select(F.when(F.length("key") == 4, F.concat(F.left("key", F.lit(2)), F.lit(" "), "key")).otherwise(F.col("key")).alias("key"), "value")


@query(f"WITH {KV} SELECT key, value, CASE WHEN contains(key, ' ') THEN 'phrase' ELSE 'token' END AS kind FROM kv")
def q_read_key_values(spark, sf_dir):
    """A flat JSON object for each first letter."""
    by = _kv(spark, sf_dir).groupBy(F.left("key", F.lit(1)).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value"))
    path = new_path(spark, "files")
    by.repartition("file").write.partitionBy("file").text(path)
    return readers.read_key_values(spark, path)


@query(f"WITH {RECORDS}, {LEX}, {KEYS}, {LAYERS} SELECT key, value, removed FROM layers WHERE layer >= 2")
def q_shortcut_files(spark, sf_dir):
    """Shortcuts of the later layers, written and imported again."""
    path = new_path(spark, "files")
    writers.write_shortcuts(_layers(spark, sf_dir).where("layer >= 2").withColumn("row_no", F.concat("key", F.col("layer").cast("string"))), path)
    good, _ = readers.read_shortcuts(spark, path)
    return good.select("key", "value", "removed")


@query(f"WITH {RECORDS}, {LEX}, {KEYS} SELECT key AS line, count(*) AS cnt FROM keys WHERE length(key) % 2 = 1 GROUP BY 1 UNION ALL SELECT key || ' =', count(*) FROM keys WHERE length(key) = 4 GROUP BY 1")
def q_shortcut_errors(spark, sf_dir):
    """Shortcut files in which some lines have no separator and some no value: these are reported, comments aren't."""
    k = keys(spark, sf_dir)
    bad = k.where(F.length("key") % 2 == 1).select(F.col("key").alias("value")).unionByName(k.where(F.length("key") == 4).select(F.concat("key", F.lit(" =")).alias("value")))
    good = k.where(F.length("key") == 6).select(F.concat("key", F.lit("=>"), "value").alias("value")).unionByName(k.select(F.concat(F.lit("# "), "key").alias("value")))
    _, wrong = readers.read_shortcuts(spark, _written(bad.unionByName(good)))
    return wrong.groupBy("line").agg(F.count("*").alias("cnt"))


@query("SELECT o_custkey || '-' || o_orderkey AS verb, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN o_orderpriority || ', ' || o_orderstatus ELSE '—' END AS gloss FROM orders")
def q_read_verbs(spark, sf_dir):
    """Orders as a JSON list per file: a translation, a list of glosses, or neither."""
    verb = F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    row = F.struct(verb.alias("verb"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("translated_verb"), F.when(F.col("o_orderstatus") == "O", F.array("o_orderpriority", "o_orderstatus")).alias("french_trans"))
    o = table(spark, sf_dir, "orders").groupBy(F.pmod(F.col("o_orderkey"), F.lit(64)).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    return readers.read_verbs(spark, _written(o, "file"))


@query(f"WITH {RECORDS}, {grams_sql(2, 3)} SELECT n, {PAD} AS ctx, coalesce(next, '<s>') AS next, cnt FROM model WHERE n = 3")
def q_model_files(spark, sf_dir):
    path = new_path(spark, "files")
    writers.save_model(ngram.combined_model(sentences(spark, sf_dir), 3), path)
    return readers.load_model(spark, path, 3).select("n", F.array_join("ctx", " ", "<s>").alias("ctx"), F.coalesce("next", F.lit("<s>")).alias("next"), "cnt")


@query(f"WITH {RECORDS}, {LEX} SELECT word AS value, false AS marked FROM wc UNION ALL SELECT '', true")
def q_lines_with_mark(spark, sf_dir):
    """The vocabulary as lines that begin with a byte-order mark, which only the first line has."""
    w = words(spark, sf_dir).select(F.col("word").alias("value")).distinct()
    path = new_path(spark, "files")
    writers.write_lines(spark.createDataFrame([("",)], "value string").unionByName(w), path, bom=True)
    lines = readers.read_lines(spark, path, bom=False)  # Spark's own text reader drops a mark
    return lines.select(F.translate("text", "﻿", "").alias("value"), F.col("text").startswith("﻿").alias("marked"))


@query(f"WITH {DOC_LINES} SELECT source || '.clean' AS source_file, 'txt' AS source_type, text, count(*) AS cnt FROM lines WHERE trim(text) <> '' GROUP BY ALL")
def q_clean_tree(spark, sf_dir):
    """Records to a tree that mirrors the sources, read back as the set of text files."""
    path = new_path(spark, "files")
    writers.write_clean_tree(records(spark, sf_dir).withColumn("source_path", F.concat("source_path", F.lit(".txt"))), path)
    return writers.clean_set(spark, path, "txt").groupBy("source_file", "source_type", "text").agg(F.count("*").alias("cnt"))


@query(
    "SELECT o_orderpriority || o_orderdate::DATE AS key, max_by(o_orderkey, o_orderkey)::VARCHAR AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"
)
def q_read_sheet(spark, sf_dir):
    """Orders as one sheet in order of their keys, with incomplete rows; n counts the rows of each key."""
    path = new_path(spark, "files")
    o = table(spark, sf_dir, "orders").withColumn("k", F.concat("o_orderpriority", F.col("o_orderdate").cast("date").cast("string")))
    o = o.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("k").alias("the key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("v"))
    o.write.csv(path, header=True)
    rows, twice = readers.read_sheet(spark, path, "the key", "v")
    return rows.join(twice.select("key", F.size("rows").alias("m")), "key", "left").select("key", "value", F.coalesce("m", F.lit(1)).cast("long").alias("n"))


LETTERS = r"regexp_matches(sentence, '\pL')"


@query(f"WITH {RECORDS}, u AS (SELECT sentence, path, reference FROM recs WHERE sentence <> '' GROUP BY ALL) SELECT sentence, count(*) OVER (PARTITION BY sentence)::INT AS source_count, path, reference FROM u WHERE {LETTERS}")
def q_export_sources(spark, sf_dir):
    path = new_path(spark, "files")
    writers.export_sources(corpus.source_records(records(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="sentence string, source_count int, path string, type string, reference string").drop("type")


@query(f"WITH {RECORDS}, u AS (SELECT sentence, path, reference FROM recs WHERE sentence <> '' GROUP BY ALL) SELECT sentence, count(*)::INT AS source_count FROM u WHERE {LETTERS} GROUP BY 1")
def q_export_unique(spark, sf_dir):
    path = new_path(spark, "files")
    writers.export_unique(corpus.sentence_table(records(spark, sf_dir), max_sources=1), path)
    return spark.read.csv(path, header=True, schema="sentence string, source_count int")


@query(
    f"""WITH {RECORDS}, u AS (SELECT sentence, path, reference FROM recs WHERE sentence <> '' GROUP BY ALL), k AS (SELECT * FROM u WHERE {LETTERS})
SELECT value, count(*) AS cnt FROM (SELECT '  - ' || path || ', ' || reference AS value FROM k UNION ALL SELECT DISTINCT sentence FROM k) GROUP BY 1"""
)
def q_export_document(spark, sf_dir):
    path = new_path(spark, "files")
    writers.export_document(corpus.source_records(records(spark, sf_dir)), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("cnt"))


@query(f"WITH {RECORDS}, {LEX}, t AS (SELECT word, cnt FROM wc ORDER BY cnt DESC, encode(word) LIMIT 100) SELECT 'top' AS part, word || chr(9) || cnt AS line FROM t UNION ALL SELECT 'vocabulary', word FROM wc UNION ALL "
       "SELECT 'summary', sum(cnt) || ' ' || sum(CASE WHEN is_alpha THEN cnt ELSE 0 END) || ' ' || count(*) || ' ' || sum(is_alpha::INT) FROM wc")  # fmt: skip
def q_export_lexical(spark, sf_dir):
    path = new_path(spark, "files")
    writers.export_lexical(lexical.word_counts(words(spark, sf_dir)), path)
    text = lambda part: spark.read.text(f"{path}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line"))
    s = spark.read.json(f"{path}/summary")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("total_tokens", "total_alpha_tokens", "distinct_words", "distinct_alpha_words")])
    return text("top").unionByName(text("vocabulary")).unionByName(s.select(F.lit("summary").alias("part"), line.alias("line")))


@query(f"WITH {RECORDS}, {LEX}, {EVERY_ASSET}, ex AS (SELECT DISTINCT word FROM wc WHERE cnt >= 20), exl AS (SELECT DISTINCT {LOW.format('word')} AS low FROM ex) SELECT word, asset_id FROM assets WHERE word NOT IN (SELECT word FROM ex) AND {LOW.format('word')} NOT IN (SELECT low FROM exl)")
def q_exclude_assets(spark, sf_dir):
    counts = stored(lexical.word_counts(words(spark, sf_dir)))
    return lookup.exclude_assets(_every_asset(counts), counts.where("cnt >= 20").select("word"))
