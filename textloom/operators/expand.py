"""Shortcut and date expansion over text tables. Maps are tables; distinct tokens are expanded once and joined back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.operators.lookup import ambiguous_keys
from textloom.operators.shared import broadcast_if_small, stored

DATE = r"(?<!\w)\d{1,2}-\d{1,2}-\d{4}(?!\w)|(?<!\w)\d{1,2} \d{1,2} \d{4}(?!\w)"
MAX_RULES = 5000
#: Passes of settle()'s first round; each further one has twice as many. Characters, and times its length, that a text may
#: grow by before it is called growing.
FIRST_PASSES, GROWTH_CHARS, GROWTH_TIMES = 8, 10_000, 16
STABLE, CYCLE, GROWING = "stable", "cycle", "growing"


def settle(df: DataFrame, column: str, once: Callable[[Column], Column]) -> DataFrame:
    """df with the column's text changed by once() again and again until it stays as it is, and end: how that came out.

    'stable' is a text that one more pass doesn't change; 'cycle' one that came back to where it had been, and is left
    there; 'growing' one that grew beyond 16 times its length and 10,000 characters, as by a rule whose output holds its
    own key. A round takes some passes over the rows in one plan and ends each row by itself; the rows that no pass has
    ended go to the next round, of twice as many passes, until there are none. Cycles are found by comparing with a text
    remembered at every power of two of passes, so of any length, without keeping what came before."""
    text = F.col(column)
    limit = GROWTH_TIMES * F.coalesce(F.length(text), F.lit(0)) + GROWTH_CHARS
    start = F.struct(text.alias("text"), text.alias("anchor"), F.lit(0).alias("n"), F.lit(1).alias("power"), limit.alias("limit"), F.lit(None).cast("string").alias("end"))

    def step(s: Column, new: Column) -> Column:
        end = F.when(new.eqNullSafe(s["text"]), STABLE).when(new == s["anchor"], CYCLE).when(F.length(new) > s["limit"], GROWING)
        again = s["n"] + 1 == s["power"]
        return F.struct(
            new.alias("text"), F.when(again, new).otherwise(s["anchor"]).alias("anchor"), F.when(again, 0).otherwise(s["n"] + 1).alias("n"),
            F.when(again, s["power"] * 2).otherwise(s["power"]).alias("power"), s["limit"].alias("limit"), end.alias("end"),
        )

    left, done, passes = df.withColumn("__state", start), None, FIRST_PASSES
    while True:
        one = lambda s, _: F.when(s["end"].isNotNull(), s).otherwise(let(once(s["text"]), lambda new: step(s, new)))
        now = stored(left.withColumn("__state", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("__state"), one)))
        ended = now.where("__state.end is not null")
        done = ended if done is None else done.unionByName(ended)
        left, passes = now.where("__state.end is null"), passes * 2
        if left.isEmpty():
            return done.select(*[F.col("__state.text").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns], "__state.end")


def _pairs(df: DataFrame, rows: int = MAX_RULES) -> list[tuple[str, str]]:
    """A rule table as a literal, longest key first; refused beyond the checked size."""
    got = df.where("key <> ''").select("key", "value").distinct().limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"over {rows} rules")
    return sorted(((r.key, r.value) for r in got), key=lambda x: (-len(x[0]), x[0]))


def expand_dates(texts: DataFrame, calendar: DataFrame, key: str = "text_id") -> DataFrame:
    """Dates d-m-yyyy or 'd m yyyy' outside words become the calendar's text; unknown dates stay."""
    t = texts.select(key, "text", F.posexplode_outer(F.regexp_extract_all("text", F.lit(DATE), F.lit(0))).alias("i", "found"))
    t = t.withColumn("d", F.try_to_timestamp(F.translate("found", " ", "-"), F.lit("d-M-yyyy")).cast("date"))
    t = t.join(calendar.select(F.col("day").alias("d"), F.col("text").alias("new")), "d", "left")
    g = t.groupBy(key, "text").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "found").alias("s")))).alias("x"))
    parts = F.zip_with(F.split("text", DATE, -1), "x", lambda p, s: F.concat(p, F.coalesce(s["s"], F.lit(""))))
    return g.select(key, F.when(F.col("text").isNotNull(), F.array_join(parts, "")).alias("text"))


def expand_phrases(df: DataFrame, phrases: list[tuple[str, str]], column: str = "text") -> DataFrame:
    """df with the column's phrases replaced at word boundaries, the longest that occurs first, again after each hit, and end
    (see settle())."""
    rules = sorted((r for r in phrases if r[0] and r[0] != r[1]), key=lambda r: (-len(r[0]), r[0]))

    def once(s: Column) -> Column:
        out = s
        for a, b in reversed(rules):
            pattern = r"(?U)(?<!\w)\Q" + a + r"\E(?!\w)"
            out = F.when(s.rlike(pattern), F.regexp_replace(s, F.lit(pattern), F.lit(b.replace("\\", r"\\").replace("$", r"\$")))).otherwise(out)
        return out

    return settle(df, column, once)


def _composed(rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """One replacement: of the keys in a text of ASCII only the longest."""
    rules = [r for r in rules if r[0] and r[0] != r[1]]
    if not rules:
        return lambda s: s
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules])

    def once(s: Column) -> Column:
        hit = F.get(F.filter(table, lambda r: s.contains(r["a"])), F.lit(0))
        return F.when(s.rlike(r"^[\x00-\x7f]*$"), let(hit, lambda h: F.when(h.isNotNull(), F.replace(s, h["a"], h["b"])).otherwise(s))).otherwise(s)

    return once


def compose(df: DataFrame, rules: list[tuple[str, str]], column: str = "token") -> DataFrame:
    """df with keys replaced inside the column's texts of ASCII only, the longest of rules (in that order) first, until none
    is left, and end (see settle())."""
    return settle(df, column, _composed(rules))


def _tokens(texts: DataFrame, key: str) -> DataFrame:
    """Tokens and the white space between them, in order."""
    return texts.select(key, F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\s+|[^\s]+"), F.lit(0))).alias("pos", "token"))


def dated_shortcuts(shortcuts: DataFrame, aliases: DataFrame, calendar: DataFrame, today: date, default_intro: str = "") -> DataFrame:
    """shortcuts(key, value) and, where they don't list it, each alias(token, offset_days, intro) of a day that the calendar
    has: its text, with the alias's own intro in place of the default one or, where there is none, in front."""
    days = aliases.select(F.lower("token").alias("key"), F.date_add(F.lit(today), F.col("offset_days")).alias("d"), "intro")
    text = F.col("text")
    rest = F.substr(text, F.lit(len(default_intro) + 1))
    new = F.when(F.col("intro").isNull(), text).when(text.startswith(default_intro + " "), F.concat("intro", rest)).otherwise(F.concat("intro", F.lit(", "), text))
    found = days.join(calendar.select("day", "text"), F.col("d") == F.col("day")).select("key", new.alias("value"))
    return shortcuts.select("key", "value").unionByName(found.join(shortcuts.select("key"), "key", "left_anti"))


def expand_types(types: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """token, expanded, how, stable, end: exact key, ASCII case-folded key, a letter with one or two digits as part key,
    composition, or as it is. end says how composition came out (see settle()), stable whether that is to no further change."""
    s = shortcuts.select("key", "value").dropDuplicates(["key"])
    folded = s.groupBy(F.lower("key").alias("lk")).agg(F.min_by("value", "key").alias("lv"))
    t = types.select("token").distinct().join(s.select(F.col("key").alias("k"), F.col("value").alias("v")), F.col("token") == F.col("k"), "left")
    t = t.join(folded, F.lower("token") == F.col("lk"), "left")
    ascii_ = F.col("token").rlike(r"^[\x00-\x7f]*$")
    keyed = F.coalesce("v", F.when(ascii_, F.col("lv")))
    how = F.when(F.col("v").isNotNull(), "exact").when(F.col("lv").isNotNull() & ascii_, "folded")
    t = t.select("token", keyed.alias("keyed"), how.alias("how"), F.when(keyed.isNull(), F.col("token")).alias("expanded"))
    t = compose(t, _pairs(shortcuts.where(r"key rlike '^[A-Za-z]?[^A-Za-z\\s]*[0-9]{1,2}$'")), "expanded")
    how = F.coalesce("how", F.when(F.col("expanded") != F.col("token"), "composed").otherwise("none"))
    return t.select("token", F.coalesce("keyed", "expanded").alias("expanded"), how.alias("how"), (F.col("end") == STABLE).alias("stable"), "end")


def expand_tokens(texts: DataFrame, shortcuts: DataFrame, key: str = "text_id") -> DataFrame:
    """key, text with every token expanded, and stable, whether all of its expansions came to an end; white space stays as it is.

    Distinct tokens are expanded once and stored. Only those that this changes or that never end are joined to the texts;
    while there are few of them they are broadcast, so a frequent token isn't gathered in one task."""
    rows = _tokens(texts, key)
    types = expand_types(rows.where(~F.col("token").rlike(r"^\s")), shortcuts).where("not (expanded <=> token and stable)")
    types = broadcast_if_small(stored(types))
    j = rows.join(types, "token", "left")
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("expanded", "token").alias("t")))).alias("x"), F.min(F.coalesce("stable", F.lit(True))).alias("stable"))
    text = F.coalesce(F.array_join(F.transform("x", lambda x: x["t"]), ""), F.lit(""))
    return texts.select(key).join(g, key, "left").select(key, text.alias("text"), F.coalesce("stable", F.lit(True)).alias("stable"))


def finalize(df: DataFrame, rules: list[tuple[str, str]], column: str = "token") -> DataFrame:
    """df with the longest key at the end of the column's text replaced, then composition, until nothing changes, and end
    (see settle())."""
    if not rules:
        return df.withColumn("end", F.lit(STABLE))
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules])
    inside = _composed(rules)

    def once(s: Column) -> Column:
        hit = F.get(F.filter(table, lambda r: s.endswith(r["a"])), F.lit(0))
        tail = let(hit, lambda h: F.when(h.isNotNull(), F.concat(F.left(s, F.length(s) - F.length(h["a"])), h["b"])).otherwise(s))
        return let(let(tail, inside), inside)

    return settle(df, column, once)


def expand_live(tokens: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """token, shown, ambiguous: a trailing token that is a key and could grow into a longer one stays as typed."""
    amb = ambiguous_keys(shortcuts).withColumn("ambiguous", F.lit(True))
    t = stored(tokens.select("token").distinct()).join(amb, F.col("token") == F.col("key"), "left").drop("key").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    t = t.join(expand_types(t, shortcuts), "token")
    return t.select("token", F.when(F.col("ambiguous"), F.col("token")).otherwise(F.col("expanded")).alias("shown"), "ambiguous")


def auto_complete(tokens: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """token, value of tokens that are keys no longer key starts with."""
    k = shortcuts.join(ambiguous_keys(shortcuts), "key", "left_anti")
    return tokens.select("token").distinct().join(k.select(F.col("key").alias("token"), "value"), "token")
