"""Streams over the given tables: these are written as files, a stream reads them to their end, and what it wrote is compared
with SQL over the whole table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators.shared import new_path, stored
from textloom.plans.queries import HITS, MODEL, PAD, SCORES, asked_model, clean_sql, grams_sql, query, requests, table
from textloom.plans.segmentation import CFG, CTE, DOCUMENT_LINES, KEPT, LINES, lexicon
from textloom.streaming import streams

#: Files that a table is written to and that a batch reads.
FILES, FILES_PER_BATCH = 12, 2


def _line_files(spark, sf_dir) -> str:
    """The lines of all documents as text files; a carriage return inside a line, which would end it, becomes a space."""
    path = new_path(spark, "files")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split(F.translate("text", "\r", " "), "\n", -1)).alias("value"))
    lines.repartition(FILES).write.text(path)
    return path


@query(
    f"""WITH sents AS MATERIALIZED (SELECT sentence, string_split(sentence, ' ') AS toks FROM (SELECT {clean_sql("line")} AS sentence FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE sentence <> ''),
{grams_sql(2, 2)} SELECT {PAD} AS ctx, coalesce(next, '<s>') AS next, cnt, round(p, 9) AS p FROM model"""
)
def q_stream_counts(spark, sf_dir):
    """Counts of all lines, two files a batch, merged in levels; a second call finds nothing new and nothing stale."""
    src, dst = _line_files(spark, sf_dir), new_path(spark, "counts")
    streams.update_counts(spark, src, dst, 2, FILES_PER_BATCH)
    m = streams.read_counts(spark, streams.update_counts(spark, src, dst, 2, FILES_PER_BATCH))
    return m.select(F.array_join("ctx", " ", "<s>").alias("ctx"), F.coalesce("next", F.lit("<s>")).alias("next"), "cnt", F.round("p", 9).alias("p"))


@query(f"WITH {CTE.replace(f'lines AS MATERIALIZED ({LINES})', f'lines AS MATERIALIZED ({DOCUMENT_LINES})')}, {KEPT} SELECT text, count(*) AS cnt FROM kept WHERE text <> '' GROUP BY text")
def q_stream_keep_lang(spark, sf_dir):
    """The target-language text of every line of the documents, batch by batch."""
    src, dst = _line_files(spark, sf_dir), new_path(spark, "kept")
    streams.stream_keep_language(spark, src, dst, f"{dst}-checkpoint", stored(lexicon(spark, sf_dir)), CFG, FILES).awaitTermination()
    return spark.read.text(dst).groupBy(F.col("value").alias("text")).agg(F.count("*").alias("cnt"))


@query(
    f"WITH {MODEL}, {HITS}, {SCORES}, r AS (SELECT request_id, word, score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, length(regexp_replace(word, '[\\x00-\\x7f]', '', 'g')) DESC, encode(word)) AS rank "
    "FROM scores WHERE regexp_matches(word, '[\\pL\\p{Nl}]')) SELECT request_id, word, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 6"
)
def q_stream_suggest(spark, sf_dir):
    """Suggestions for requests that arrive as files."""
    r = requests(spark, sf_dir)
    src, dst = new_path(spark, "requests"), new_path(spark, "suggested")
    r.select("request_id", "text").repartition(FILES).write.json(src)
    model = stored(asked_model(spark, sf_dir, r))
    asked = spark.readStream.schema("request_id long, text string").option("maxFilesPerTrigger", FILES).json(src)
    streams.stream_suggest(asked, model, dst, f"{dst}-checkpoint", 6).awaitTermination()
    return spark.read.parquet(dst).select("request_id", "word", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))
