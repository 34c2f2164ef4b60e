"""Corpus search, concordance and neighbour counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.shared import broadcast_if_small, new_path, stored

#: Characters of a gram, and postings that a bucket of a stored index holds on average.
GRAM, BUCKET_ROWS = 3, 2_000_000
#: Stands for the space in sentences that hold one; no other word has a space.
SPACE = " "


def _grams(c: Column, k: int) -> Column:
    """The distinct grams of k characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def _asked(queries: DataFrame) -> DataFrame:
    """query, at, kind, piece, pieces, gram: the pieces of each distinct query between its spaces, and a gram of each.

    A sentence holds a query of one piece if a word of it holds that, and one of several only if one word ends with the
    first, one begins with the last, and those between are words. Empty pieces tell nothing; a query of spaces alone
    has the piece SPACE."""
    q = queries.where("query is not null and query <> ''").select("query").distinct().withColumn("parts", F.when(F.trim("query") == "", F.array(F.lit(SPACE))).otherwise(F.split("query", " ", -1)))
    q = q.select("query", F.size("parts").alias("size"), F.size(F.filter("parts", lambda x: x != "")).alias("pieces"), F.posexplode("parts").alias("at", "piece")).where("piece <> ''")
    kind = F.when(F.col("size") == 1, "in").when(F.col("at") == 0, "end").when(F.col("at") == F.col("size") - 1, "start").otherwise("whole")
    q = q.select("query", "at", kind.alias("kind"), "piece", "pieces")
    return q.withColumn("gram", F.when(F.col("kind") == "end", F.right("piece", F.lit(GRAM))).otherwise(F.left("piece", F.lit(GRAM))))


def _places(sentences: DataFrame) -> DataFrame:
    """sid, word: the distinct words of each sentence, and SPACE if it has a space."""
    words = F.concat(F.array_distinct(F.split("sentence", " ", -1)), F.when(F.col("sentence").contains(" "), F.array(F.lit(SPACE))).otherwise(F.array().cast("array<string>")))
    return sentences.select("sid", F.explode(words).alias("word")).where("word <> ''")


def _words(places: DataFrame) -> DataFrame:
    """word, n, first: how many sentences hold each word, and the first of them."""
    return places.groupBy("word").agg(F.count("*").alias("n"), F.min("sid").alias("first"))


def _word_grams(words: DataFrame, sizes: list[int]) -> DataFrame:
    """gram, word, n, first: words(word, n, first) by their grams."""
    return words.select(F.explode(F.concat(*[_grams(F.col("word"), k) for k in sizes])).alias("gram"), "word", "n", "first")


def _chosen(asked: DataFrame, grams: DataFrame, limit: int) -> DataFrame:
    """query, sure, word: words of which a sentence that is among the first to hold the query has one.

    A sentence with a word that holds a query of one piece holds the query, which is sure. So as many such sentences as asked
    for are where these words come first, and of words that come later none is needed. Of other queries it is the words that
    fit the piece which fewest sentences hold; one of which some piece fits no word is left out."""
    w, piece, kind = F.col("word"), F.col("piece"), F.col("kind")
    sure = (kind == "in") & (piece == F.col("query"))
    fits = F.when(kind == "in", w.contains(piece)).when(kind == "end", w.endswith(piece)).when(kind == "start", w.startswith(piece)).otherwise(w == piece)
    fit = lambda on: grams.join(broadcast_if_small(stored(asked.where(on))), "gram").where(fits)
    early = fit(sure).select("query", "first", "word").withColumn("rank", F.dense_rank().over(W.partitionBy("query").orderBy("first")))
    early = early.where(F.col("rank") <= limit).select("query", F.lit(True).alias("sure"), "word")
    rest = stored(fit(~sure).select("query", "at", "pieces", "word", "n"))
    each = rest.groupBy("query", "at").agg(F.sum("n").alias("n"), F.first("pieces").alias("pieces"))
    best = each.groupBy("query").agg(F.min(F.struct("n", "at")).alias("b"), F.count("*").alias("found"), F.first("pieces").alias("pieces"))
    best = best.where("found = pieces").select("query", F.col("b.at").alias("at"))
    return stored(early.unionByName(rest.join(best, ["query", "at"], "left_semi").select("query", F.lit(False).alias("sure"), "word")))


def _found(chosen: DataFrame, places: DataFrame, sentences: DataFrame, limit: int) -> DataFrame:
    """query, sid: candidates. As sids rise in corpus order, of a word that is sure only the first places count, and the
    sentence that is the query itself."""
    sure, rest = chosen.where("sure").select("query", "word"), stored(chosen.where("not sure").select("query", "word"))
    first = W.partitionBy("word").orderBy("sid")
    heads = places.join(broadcast_if_small(stored(sure.select("word").distinct())), "word", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit)
    early = heads.join(sure, "word").select("query", "sid")
    exact = sentences.select("sentence", "sid").join(sure.select("query").distinct(), F.col("sentence") == F.col("query")).select("query", "sid")
    held = places.join(broadcast_if_small(rest), "word").select("query", "sid")
    return early.unionByName(exact).unionByName(held).distinct()


def _hits(queries: DataFrame, found: DataFrame, sentences: DataFrame, limit: int, max_sources: int) -> DataFrame:
    """Candidates found(query, sid) with their sentences: verified, ordered, cut off and given to each query_id."""
    hits = sentences.join(found, "sid").where(F.col("sentence").contains(F.col("query"))).withColumn("is_exact", F.col("sentence") == F.col("query"))
    order = W.partitionBy("query").orderBy(F.col("is_exact").desc(), "first_rank", "sentence")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(limit)}")
    hits = hits.join(queries.select("query_id", "query"), "query")
    return hits.select("query_id", "sentence", "is_exact", "rank", "source_count", F.slice("sources", 1, max_sources).alias("sources"))


def _with_ids(sentences: DataFrame) -> DataFrame:
    """The sentences with sid, which rises in corpus order."""
    order = ("first_rank", "sentence")
    s = sentences.select("sentence", "first_rank", "source_count", "sources").repartitionByRange(*order).sortWithinPartitions(*order)
    return s.withColumn("sid", F.monotonically_increasing_id())


def search_corpus(queries: DataFrame, sentences: DataFrame, limit: int = 8, max_sources: int = 3) -> DataFrame:
    """query_id, sentence, is_exact, rank, source_count, sources for queries(query_id, query); query_ids are unique.

    The whole sentence first, then sentences that hold the query anywhere, in corpus order; empty queries match nothing.
    For one search no index is built: the sentences' distinct words are counted, those that fit a piece of a query are found
    by a gram of it, and the sentences with words for a query's rarest piece are verified. All joins are equi-joins."""
    s = stored(_with_ids(sentences))
    queries = stored(queries.select("query_id", "query"))
    asked = stored(_asked(queries))
    sizes = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # at most GRAM of them
    places = _places(s)
    chosen = _chosen(asked, _word_grams(stored(_words(places)), sizes or [GRAM]), limit)
    return _hits(queries, _found(chosen, places, s, limit), s, limit, max_sources)


@dataclass
class SubstringIndex:
    """An index of sentences for many searches, in one folder: the sentences, the places (word, sid) of their distinct words
    and the postings (gram, word, n, first) of the words' grams of one to GRAM characters, both in folders by bucket, sorted."""

    spark: SparkSession
    path: str
    buckets: int
    word_buckets: int

    @staticmethod
    def build(sentences: DataFrame, path: str | None = None) -> SubstringIndex:
        """Writes the index to the path, or to a new folder in the shared one. A word that very many sentences hold is one
        bucket's, spread over as many files as tasks wrote it: places are not shuffled by word."""
        spark = sentences.sparkSession
        path = path or new_path(spark, "index")
        _with_ids(sentences).write.parquet(f"{path}/sentences")
        s = spark.read.parquet(f"{path}/sentences")
        number = lambda rows: max(1, -(-(rows or 0) // BUCKET_ROWS))
        word_buckets = number(s.agg(F.sum(F.length("sentence") - F.length(F.replace("sentence", F.lit(" "), F.lit(""))) + 2)).first()[0])
        _written(_places(s), "word", word_buckets, f"{path}/places")
        words = stored(_words(spark.read.schema("sid long, word string").parquet(f"{path}/places")))
        grams = _word_grams(words, list(range(1, GRAM + 1)))
        buckets = number(grams.count())
        _written(grams, "gram", buckets, f"{path}/postings")
        return SubstringIndex(spark, path, buckets, word_buckets)

    def _read(self, part: str, schema: str, keys: DataFrame) -> DataFrame:
        """The rows of a part for the keys(gram) or keys(word): only their buckets are read, whose numbers pass through the driver."""
        key, n = ("word", self.word_buckets) if part == "places" else ("gram", self.buckets)
        wanted = sorted(r[0] for r in keys.select(_bucket(F.col(key), n)).distinct().collect())
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{part}").where(F.col("bucket").isin(wanted)).drop("bucket")

    def search(self, queries: DataFrame, limit: int = 8, max_sources: int = 3) -> DataFrame:
        """What search_corpus() returns, from the buckets that the queries ask for."""
        queries = stored(queries.select("query_id", "query"))
        asked = stored(_asked(queries))
        chosen = _chosen(asked, self._read("postings", "gram string, word string, n long, first long", asked), limit)
        s = self.spark.read.parquet(f"{self.path}/sentences")
        return _hits(queries, _found(chosen, self._read("places", "sid long, word string", chosen), s, limit), s, limit, max_sources)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, key: str, buckets: int, path: str) -> None:
    rows.withColumn("bucket", _bucket(F.col(key), buckets)).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)


def suggestion_examples(suggestions: DataFrame, requests: DataFrame, sentences: DataFrame, limit: int = 2) -> DataFrame:
    """Sentences that hold the request's text followed by the suggested word."""
    q = suggestions.join(requests.select("request_id", "text"), "request_id")
    q = q.select(F.struct("request_id", "word").alias("query_id"), F.concat_ws(" ", "text", "word").alias("query"))
    return search_corpus(q, sentences, limit, 1).select("query_id.request_id", "query_id.word", "sentence", "rank")


def concordance(sentences: DataFrame, sequence: list[str], window: int = 4, key: str = "sentence") -> DataFrame:
    """key, pos (1-based), prev, next, left, right of every occurrence of the tokens; prev and next are null at the edges."""
    seq, n, t = F.array(*[F.lit(x) for x in sequence]), len(sequence), F.col("tokens")
    at = F.filter(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n) == seq)
    rows = sentences.where(F.size(t) >= n).select(key, "tokens", F.explode(at).alias("pos"))
    start = F.greatest(F.col("pos") - window, F.lit(1))
    return rows.select(
        key, "pos", F.get(t, F.col("pos") - 2).alias("prev"), F.get(t, F.col("pos") + n - 1).alias("next"),
        F.array_join(F.slice(t, start, F.col("pos") - start), " ").alias("left"), F.array_join(F.slice(t, F.col("pos") + n, F.lit(window)), " ").alias("right"),
    )


def neighbour_counts(sentences: DataFrame, sequence: list[str], k: int = 30) -> DataFrame:
    """side, token, cnt: the k commonest tokens right before and right after the sequence."""
    c = concordance(sentences, sequence)
    n = c.select(F.explode(F.array(F.struct(F.lit("prev").alias("side"), F.col("prev").alias("token")), F.struct(F.lit("next").alias("side"), F.col("next").alias("token")))).alias("x"))
    n = n.select("x.*").where("token is not null").groupBy("side", "token").agg(F.count("*").alias("cnt"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.col("cnt").desc(), "token"))).where(f"rank <= {k}")
