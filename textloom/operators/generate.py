"""Batch text generation: all active requests take one step per round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.ngram import context_model
from textloom.operators.predict import contexts, longest_match, wanted_contexts
from textloom.operators.search import search_corpus
from textloom.operators.shared import new_path, stored


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts decide: 48 bits of the md5 of their texts, joined by |."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.left(digest, F.lit(12)), 16, 10).cast("long") + 0.5) / float(1 << 48)


#: Rows of the model that a bucket holds on average, most buckets, and files that a bucket's rows are dealt to.
BUCKET_ROWS, MAX_BUCKETS, FILES = 500_000, 100_000, 8


@dataclass
class BucketedModel:
    """A model stored in folders by a hash of the context, as many as its size asks for, so that what a lookup reads follows
    the contexts asked for and not the model. A context of very many continuations is dealt to several files."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def build(model: DataFrame, path: str | None = None, most: int | None = None) -> BucketedModel:
        """Writes ngram(n, ctx, next, cnt, p) to the path, or to a new folder in the shared one. most, a number of rows that
        the model doesn't exceed, sets its buckets; without it the model is stored once more to be counted."""
        spark = model.sparkSession
        path, rows = path or new_path(spark, "model"), model.select("ctx", "next", "p")
        rows = rows if most is not None else stored(rows)
        buckets = min(MAX_BUCKETS, max(1, -(-(rows.count() if most is None else most) // BUCKET_ROWS)))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn("bucket", _bucket(F.col("ctx"), buckets)).repartition(n, "bucket", F.pmod(F.xxhash64("next"), F.lit(FILES)))
        dealt.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)
        return BucketedModel(spark, path, buckets)

    def asked(self, contexts: DataFrame) -> DataFrame:
        """The rows of the buckets that contexts(ctx) fall into; only their numbers, of which there are few, pass through the driver."""
        wanted = sorted(r[0] for r in contexts.select(_bucket(F.col("ctx"), self.buckets)).distinct().collect())
        return self.spark.read.schema("ctx array<string>, next string, p double, bucket int").parquet(self.path).where(F.col("bucket").isin(wanted)).drop("bucket")


@dataclass
class CorpusModel:
    """combined_model() of stored sentences(tokens), counted for the contexts asked for only: each lookup reads all sentences
    and nothing is stored but what it finds. For batches of few rounds that is less work, and far less disk, than a model of
    which they read little.

    A word that was drawn after a matched context of k tokens stands after these somewhere, so the next round's longest match
    has a token more, up to the longest context: shorter ones are no longer asked for."""

    sentences: DataFrame
    max_n: int

    def asked(self, contexts: DataFrame) -> DataFrame:
        return context_model(self.sentences, self.max_n, contexts).select("ctx", "next", "p")


def _bucket(ctx: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ctx), F.lit(buckets)).cast("int")


def generate(requests: DataFrame, model: DataFrame | BucketedModel | CorpusModel, max_ctx: int = 4, max_tokens: int = 40, temperature: float = 1.0, tries: int = 1, seed: int = 42) -> DataFrame:
    """request_id, try, tokens, text, status for requests(request_id, tokens).

    Each step draws from the longest matched context: the likeliest at temperature 0, else by Gumbel's trick with the
    md5 of seed, request, try, step and word, so equal calls agree. A draw of the end, no match, or max_tokens tokens
    ends a text; 'not_in_corpus' is a text whose seed matches nothing. Ties go to the first word, the end last.
    Rounds end when no request is active; each is stored in the shared folder. A step reads the buckets of the model that
    its contexts ask for; a model that isn't bucketed yet is, once. A
    CorpusModel reads the sentences instead."""
    keys = ["request_id", "try"]
    model = model if isinstance(model, (BucketedModel, CorpusModel)) else BucketedModel.build(model)
    active = stored(requests.select("request_id", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try"), "tokens"))
    done = None
    for step in range(max_tokens + 1):
        full = active.where(F.size("tokens") >= max_tokens).select(*keys, "tokens").withColumn("status", F.lit("generated" if step else "full"))
        active = active.where(F.size("tokens") < max_tokens)
        wanted = wanted_contexts(active, max_ctx)
        if step and isinstance(model, CorpusModel):
            # The least context that is sure to match; one of the texts' may be longer, and is asked for as well.
            sure = F.least(F.col("k") + 1, F.lit(min(max_ctx, model.max_n - 1)))
            longer = F.filter(contexts(F.col("tokens"), max_ctx), lambda x: x["k"] >= sure)
            wanted = active.select(F.explode(longer).alias("x")).select("x.ctx").distinct()
        hits = longest_match(active, model.asked(wanted), max_ctx, keys)
        if temperature <= 0:
            weight = F.col("p")
        else:
            weight = F.log("p") / temperature - F.log(-F.log(uniform(F.lit(seed), *[F.col(k) for k in keys], F.lit(step), F.coalesce("next", F.lit("")))))
        # The best continuation by an aggregation, least struct first: a context of very many costs a row a request and task.
        best = F.min(F.struct((-weight).alias("less"), F.col("next").isNull().alias("end"), "next"))
        drawn = hits.groupBy(*keys).agg(best.alias("x"), F.first("k").alias("k")).select(*keys, "x.next", "k", F.lit(True).alias("hit"))
        stepped = stored(active.select(*keys, "tokens").join(drawn, keys, "left"))
        ended = stepped.where("next is null").select(*keys, "tokens", F.when(F.col("hit").isNull() & F.lit(step == 0), "not_in_corpus").otherwise("generated").alias("status"))
        ended = ended.unionByName(full)
        done = ended if done is None else done.unionByName(ended)
        active = stepped.where("next is not null").select(*keys, F.array_append("tokens", F.col("next")).alias("tokens"), "k")
        if active.isEmpty():
            break
    else:
        done = done.unionByName(active.select(*keys, "tokens").withColumn("status", F.lit("generated")))
    return done.withColumn("text", F.array_join("tokens", " "))


def candidates(requests: DataFrame, model: DataFrame | BucketedModel | CorpusModel, k: int = 5, **settings) -> DataFrame:
    """The first k distinct texts of max(6k, 10) tries per request, in order of their first try."""
    made = generate(requests, model, tries=max(6 * k, 10), **settings)
    first = made.groupBy("request_id", "text").agg(F.min("try").alias("try"), F.first("status").alias("status"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy("try"))).where(f"rank <= {k}")


def flag_known(texts: DataFrame, sentences: DataFrame) -> DataFrame:
    """status 'original' for texts that are sentences of the corpus."""
    known = sentences.select(F.col("sentence").alias("s")).distinct().withColumn("known", F.lit(True))
    return texts.join(known, F.col("text") == F.col("s"), "left").withColumn("status", F.when(F.col("known"), "original").otherwise(F.col("status"))).drop("s", "known")


def generation_report(requests: DataFrame, model: DataFrame | BucketedModel | CorpusModel, sentences: DataFrame, k: int = 5, match_limit: int = 8, max_sources: int = 3, **settings) -> DataFrame:
    """request_id, text, settings, primary, candidates, matches, match_count: the candidates of each request, the first one's
    status against the corpus, and the sentences found for the first one. Requests without text are left out."""
    made = flag_known(candidates(requests.where("text <> ''"), model, k, **settings), sentences)
    each = made.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "status"))).alias("candidates"))
    first = each.select("request_id", "candidates", F.col("candidates")[0].alias("primary"))
    found = search_corpus(first.select(F.col("request_id").alias("query_id"), F.col("primary.text").alias("query")), sentences, match_limit, max_sources)
    m = found.groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sentence", "is_exact", "source_count", "sources"))).alias("matches"))
    told = F.create_map(*[F.lit(str(x)) for kv in {"num_candidates": k, "match_limit": match_limit, "max_sources": max_sources, **settings}.items() for x in kv])
    out = requests.select("request_id", "text").join(first, "request_id").join(m, "request_id", "left")
    return out.select("request_id", "text", told.alias("settings"), "primary", "candidates", "matches", F.coalesce(F.size("matches"), F.lit(0)).alias("match_count"))
