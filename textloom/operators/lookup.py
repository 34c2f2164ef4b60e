"""Dimension lookups: assets, calendar, shortcut keys, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.shared import stored


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one that was loaded last; aggregated, so repeated keys combine before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def lookup_asset(words: DataFrame, assets: DataFrame) -> DataFrame:
    """words(word, ...) with asset_id: the exact word's, else that of its form without low tone; other tones never match."""
    exact = assets.select(F.col("word").alias("w1"), F.col("asset_id").alias("a1"))
    canon = assets.where(F.col("word") == T.strip_low_tone_mark(F.col("word"))).select(F.col("word").alias("w2"), F.col("asset_id").alias("a2"))
    bare = words.withColumn("canon", T.strip_low_tone_mark(F.col("word")))
    j = bare.join(exact, F.col("word") == F.col("w1"), "left").join(canon, F.col("canon") == F.col("w2"), "left")
    return j.withColumn("asset_id", F.coalesce("a1", "a2")).drop("w1", "a1", "w2", "a2", "canon")


def canonical_conflicts(assets: DataFrame) -> DataFrame:
    """canon, n: canonical keys that stand for several assets."""
    return assets.groupBy(T.strip_low_tone_mark(F.col("word")).alias("canon")).agg(F.count_distinct("asset_id").alias("n")).where("n > 1")


def exclude_assets(assets: DataFrame, excluded: DataFrame) -> DataFrame:
    """Assets whose raw or canonical key isn't in excluded(word), which is stored, as it is read for both."""
    excluded = stored(excluded.select("word").distinct())
    e = excluded.select(T.strip_low_tone_mark(F.lower(F.trim("word"))).alias("canon")).distinct()
    a = assets.withColumn("canon", T.strip_low_tone_mark(F.lower(F.trim("word"))))
    return a.join(e, "canon", "left_anti").join(excluded.select("word").distinct(), "word", "left_anti").drop("canon")


def calendar_lookup(requests: DataFrame, calendar: DataFrame, offset_days: int = 0, intro: str | None = None, default_intro: str = "") -> DataFrame:
    """requests(request_id, day) with target_day and text; a given intro replaces the default one, else goes in front."""
    r = requests.withColumn("target_day", F.date_add("day", offset_days))
    c = calendar.select(F.col("day").alias("d"), F.col("text").alias("found"))
    j = r.join(c, F.col("target_day") == F.col("d"), "left").drop("d")
    text = F.col("found")
    if intro is not None:
        rest = F.substr(text, F.lit(len(default_intro) + 1))
        text = F.when(text.startswith(default_intro) & F.lit(bool(default_intro)), F.concat(F.lit(intro), rest)).otherwise(F.concat(F.lit(intro + ", "), text))
    return j.withColumn("text", text).drop("found")


def calendar_phrase(days: DataFrame, months: DataFrame, intro: str) -> DataFrame:
    """day, text: intro, day name (English day name), number, month's own name, year; months(month_no, name)."""
    names = months.where("month_no between 1 and 12").groupBy("month_no").agg(F.min("name").alias("name"))  # twelve rows at most
    d = days.withColumn("m", F.month("day")).join(F.broadcast(names), F.col("m") == F.col("month_no"), "left")
    return d.select("day", F.format_string("%s %s (%s) %d %s %d", F.lit(intro), "day_name", F.date_format("day", "EEEE"), F.dayofmonth("day"), "name", F.year("day")).alias("text"))


def prefix_hints(prefixes: DataFrame, keys: DataFrame, limit: int = 6) -> DataFrame:
    """prefix, key, value, rank: longer keys that start with the prefix, exact case before folded, then by length and key.

    Keys are exploded into their proper prefixes (folded) of the lengths that are asked for, which makes the range
    lookup an equi-join. 'key?' is left out where 'key' itself is listed."""
    max_len = prefixes.agg(F.max(F.length("prefix"))).first()[0] or 0
    k = keys.where((F.length("key") > 1)).withColumn("stem", F.regexp_replace("key", r"\?$", ""))
    k = k.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key") - 1, F.lit(max(1, max_len)))), lambda n: F.lower(F.left("key", n)))))
    j = prefixes.select("prefix").distinct().join(k, F.lower("prefix") == F.col("p"))
    j = j.withColumn("exact", F.col("key").startswith(F.col("prefix")))
    j = j.withColumn("twin", F.max(~F.col("key").endswith("?")).over(W.partitionBy("prefix", "stem"))).where(~(F.col("key").endswith("?") & F.col("twin")))
    order = W.partitionBy("prefix").orderBy(F.col("exact").desc(), F.length("key"), F.lower("key"), "key")
    return j.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(limit)}").select("prefix", "key", "value", "rank")


def ambiguous_keys(keys: DataFrame) -> DataFrame:
    """key: those that are a proper prefix of another key, by an equi-join on exploded proper prefixes."""
    k = keys.select("key").distinct()
    p = k.where(F.length("key") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.left("key", n))).alias("key")).distinct()
    return k.join(p, "key", "left_semi")


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key")).orderBy("key")


def overlay(layers: DataFrame) -> DataFrame:
    """layers(layer, key, value, removed): the latest layer's row per key; a removal deletes the key and its optional
    twin (key? or key without ?) of the same or earlier layers."""
    latest = layers.groupBy("key").agg(F.max_by(F.struct("layer", "value", "removed"), "layer").alias("x")).select("key", "x.*")
    gone = layers.where("removed").select("layer", F.regexp_replace("key", r"\?$", "").alias("stem")).groupBy("stem").agg(F.max("layer").alias("gone"))
    kept = latest.where("not removed").withColumn("stem", F.regexp_replace("key", r"\?$", "")).join(gone, "stem", "left")
    return kept.where("gone is null or layer > gone").select("key", "value", "layer")


def optional_aliases(keys: DataFrame) -> DataFrame:
    """Keys, and for those that end in ? also the key without it unless it is taken."""
    bare = keys.where(F.col("key").endswith("?")).withColumn("key", F.regexp_replace("key", r"\?$", "")).where("key <> ''")
    return keys.unionByName(bare.join(keys.select("key"), "key", "left_anti"))


def duplicates(rows: DataFrame, key: str, row_no: str = "row_no") -> DataFrame:
    """Keys that occur more than once, with their row numbers."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(row_no)).alias("rows")).where(F.size("rows") > 1)


def split_kinds(pairs: DataFrame) -> DataFrame:
    """kind: phrase for keys with white space, else token."""
    return pairs.withColumn("kind", F.when(F.col("key").rlike(r"\s"), "phrase").otherwise("token"))


def candidate_urls(word: Column, asset_id: Column, api: str, store: str) -> Column:
    """Where an asset may be found, best first."""
    return F.array(F.concat(F.lit(api.rstrip("/") + "/"), F.url_encode(word)), T.asset_url(F.concat(word, F.lit(".mp3")), store), T.asset_url(F.concat(asset_id, F.lit(".mp3")), store))
