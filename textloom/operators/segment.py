"""Language segmentation of mixed text: classify token types, smooth, merge spans, keep the target language."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.shared import broadcast_if_small, stored

EN, FR, BOTH, TARGET, OTHER, PUNCT = "English", "French", "English/French", "Target", "Other", "PUNCT"
LABELS = [EN, FR, BOTH, TARGET, OTHER]


@dataclass
class Settings:
    """Word lists are small parameters; the lexicons are tables."""

    protected: list[str] = field(default_factory=list)
    stop_en: list[str] = field(default_factory=list)
    stop_fr: list[str] = field(default_factory=list)
    verb_special: list[str] = field(default_factory=list)
    base_chars: str = "ɛɔŋəʉ"
    hint_chars: str = "éèêàùçœ"
    hint_suffixes: list[str] = field(default_factory=lambda: ["ment", "tion"])
    prefixes: list[str] = field(default_factory=lambda: ["l", "d", "j", "qu"])
    verb_suffixes: list[str] = field(default_factory=lambda: ["ait", "aient", "ons", "ez", "ent"])
    derivational: list[str] = field(default_factory=lambda: ["ique", "able", "eur"])
    low: dict[str, str] = field(default_factory=dict)
    marks: str = "́̀̂̌̄"
    score_threshold: float = 3.2
    margin: float = 0.55


#: Verb endings and the infinitive endings tried in their place; endings tried for a derived word's family;
#: the least score for a verb ending to count, and from which an undecided word is in both languages.
FAMILY, VERB_SCORE, BOTH_SCORE = ("", "e", "er", "ir", "on", "onne"), 1.2, 5.4
LEMMAS = [
    (["irent"], 5, ["ir"]), (["erent"], 5, ["er"]), (["aient"], 5, ["er", "ir", "re", "oir"]), (["ions", "iez"], 4, ["er", "ir", "re", "oir"]),
    (["erai", "eras", "erez"], 4, ["er"]), (["irai", "iras", "irez"], 4, ["ir"]), (["ait", "ais", "ant", "ent", "ons", "ez"], 3, ["er", "ir", "re", "oir"]),
    (["it", "is"], 2, ["er", "ir", "re", "oir"]), (["a"], 1, ["er"]),
]


def _ends(c: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | c.endswith(s)
    return out


def lemma_candidates(c: Column) -> Column:
    """Infinitives that a verb form may come from; no stem gives none."""
    parts = []
    for suffixes, cut, endings in LEMMAS:
        if suffixes == ["it", "is"]:
            on = _ends(c, suffixes) & ~_ends(c, ["ait", "ais"])
        else:
            on = _ends(c, suffixes)
        stem = F.left(c, F.greatest(F.length(c) - cut, F.lit(0)))
        parts.append(F.when(on & (F.length(c) > cut), F.array(*[F.concat(stem, F.lit(e)) for e in endings])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def family_candidates(c: Column, derivational: list[str]) -> Column:
    parts = []
    for s in derivational:
        base = F.left(c, F.greatest(F.length(c) - len(s), F.lit(0)))
        parts.append(F.when(c.endswith(s) & (F.length(c) > len(s)), F.array(*[F.concat(base, F.lit(e)) for e in FAMILY])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *parts))


def looks_like_target(c: Column, in_lexicon: Column, base_chars: str) -> Column:
    """In the lexicon, or with a distinctive letter, a combining mark, or a letter with caron or macron."""
    return in_lexicon | c.rlike(f"[{base_chars}\\p{{Mn}}]") | T.unicode_form(c, "NFD").rlike("[̌̄]")


def classify_types(types: DataFrame, lexicon: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """types(token) with normalized, core, label and the Zipf scores; lexicon(lang in en, fr, target; word; zipf).

    Distinct token types are classified once; lexicon columns come by joins on the word, its suffix after an
    apostrophe, its low-tone form and exploded candidate lemmas. The first matching rule decides. The lexicon, the types
    and these with their columns are stored, as each is read several times."""
    s, c = settings, F.col("core")
    lex = lexicon.groupBy("word").agg(
        F.max(F.when(F.col("lang") == "en", 1)).isNotNull().alias("en"), F.max(F.when(F.col("lang") == "fr", 1)).isNotNull().alias("fr"), F.max(F.when(F.col("lang") == "target", 1)).isNotNull().alias("tg"),
        F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("zipf"))), F.lit(0.0)).alias("ez"), F.coalesce(F.max(F.when(F.col("lang") == "fr", F.col("zipf"))), F.lit(0.0)).alias("fz"),
    )
    lex = stored(lex)
    t = types.select("token").distinct().withColumn("normalized", F.lower(T.normalize_text(F.col("token"))))
    t = t.withColumn("core", T.strip_quotes(F.col("normalized")))
    t = t.withColumn("assumed", T.assume_low_tone(c, s.low, s.marks) if s.low else c).withColumn("suffix", F.regexp_extract("normalized", "(?s)^[^']*'(.*)$", 1))

    def joined(df: DataFrame, key: str, prefix: str) -> DataFrame:
        side = lex.select(F.col("word").alias(f"{prefix}w"), *[F.col(x).alias(f"{prefix}{x}") for x in ("en", "fr", "tg", "ez", "fz")])
        df = df.join(side, F.col(key) == F.col(f"{prefix}w"), "left").drop(f"{prefix}w")
        for x, default in (("en", False), ("fr", False), ("tg", False), ("ez", 0.0), ("fz", 0.0)):
            df = df.withColumn(f"{prefix}{x}", F.coalesce(f"{prefix}{x}", F.lit(default)))
        return df

    typed = t = stored(joined(joined(joined(stored(t), "core", "c_"), "assumed", "a_"), "suffix", "s_"))
    fr_words = lex.where("fr").select(F.col("word").alias("cand"))

    def any_french(df: DataFrame, cands: Column, name: str) -> DataFrame:
        hit = typed.select("token", F.explode(cands).alias("cand")).join(fr_words, "cand", "left_semi").select("token", F.lit(True).alias(name)).distinct()
        return df.join(hit, "token", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    t = any_french(t, lemma_candidates(c), "lemma")
    t = any_french(t, lemma_candidates(F.col("suffix")), "s_lemma")
    t = any_french(t, family_candidates(c, s.derivational), "family")
    target = lambda col, p: looks_like_target(col, F.col(f"{p}tg"), s.base_chars)
    assumed_is_target = (F.col("assumed") != c) & target(F.col("assumed"), "a_")
    t = t.withColumn("is_target", target(c, "c_")).withColumn("assumed_target", assumed_is_target)
    ascii_ = lambda col: col.rlike(r"^[\x00-\x7f]*$")

    def verb(col: Column, p: str, lemma: str, blocked: Column) -> Column:
        plain = ~col.contains("'") & ascii_(col) & ~col.isin(*s.protected, "")
        by_score = _ends(col, s.verb_suffixes) & (F.col(f"{p}fz") >= VERB_SCORE) & (F.col(f"{p}fz") >= F.col(f"{p}ez"))
        return plain & (col.isin(*s.verb_special, "\x00") | (~blocked & (F.col(lemma) | by_score)))

    n, ez, fz = F.col("normalized"), F.col("c_ez"), F.col("c_fz")
    prefix = F.regexp_extract(n, "(?s)^([^']*)'", 1)
    hint = lambda col: col.rlike(f"[{s.hint_chars}]") | _ends(col, s.hint_suffixes)
    apostrophe = n.contains("'") & prefix.isin(*s.prefixes) & (F.col("suffix") != "") & (F.col("s_fr") | F.col("suffix").isin(*s.stop_fr, "\x00") | verb(F.col("suffix"), "s_", "s_lemma", F.lit(False)) | hint(F.col("suffix")))
    decisive = F.when(ez - fz >= s.margin, EN).when(fz - ez >= s.margin, FR)
    dictionary = F.when(F.col("c_en") & ~F.col("c_fr"), EN).when(F.col("c_fr") & ~F.col("c_en"), FR).when(F.col("c_en") & F.col("c_fr"), F.when(F.col("assumed_target"), TARGET).otherwise(F.coalesce(decisive, F.lit(BOTH))))
    scored = F.when(F.greatest(ez, fz) >= s.score_threshold, F.coalesce(decisive, F.when(ascii_(c) & (F.greatest(ez, fz) >= BOTH_SCORE), BOTH)))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    marked = T.unicode_form(c, "NFD").rlike(f"[{s.marks}]")
    french_hint = ~c.contains("'") & ~c.rlike(f"[{s.base_chars}]") & ~(marked & (letters <= 3)) & hint(c)
    en, fr = c.isin(*s.stop_en, "\x00"), c.isin(*s.stop_fr, "\x00")
    label = (
        F.when(T.is_punct(F.col("token")) & ~F.col("token").rlike(r"\p{N}"), PUNCT).when(apostrophe, FR).when(n.contains("'") & ~F.col("c_en") & ~F.col("c_fr"), TARGET).when(c == "", OTHER)
        .when(c.isin(*s.protected, "\x00") | F.col("is_target"), TARGET).when(en & ~fr, EN).when(fr & ~en, FR).when(en & fr, BOTH).when(verb(c, "c_", "lemma", F.col("assumed_target")), FR)
        .when(dictionary.isNotNull(), dictionary).when(scored.isNotNull(), scored).when(french_hint, FR)
        .when(~c.contains("'") & ascii_(c) & ~c.isin(*s.protected, "\x00") & F.col("family"), FR).when(F.col("assumed_target"), TARGET).when(T.is_titlecase(F.col("token")), OTHER).otherwise(TARGET)
    )
    return t.select("token", "normalized", "core", label.alias("label"), ez.alias("en_zipf"), fz.alias("fr_zipf"))


def token_rows(lines: DataFrame) -> DataFrame:
    """line_id, pos, token of lines(line_id, text)."""
    return lines.select("line_id", F.posexplode(T.tokenize(F.coalesce("text", F.lit("")))).alias("pos", "token"))


def label_tokens(lines: DataFrame, lexicon: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """token_rows() with the columns of classify_types(). The classified types are stored and, while there are few of them,
    broadcast, so a frequent token isn't gathered in one task; more are dealt out and hashed, which sorts no tokens."""
    rows = token_rows(lines)
    return rows.join(broadcast_if_small(stored(classify_types(rows, lexicon, settings)), otherwise="shuffle_hash"), "token")


def smooth_labels(tokens: DataFrame, threshold: float = 3.2) -> DataFrame:
    """Promotes Other tokens next to target ones, as one pass from the left would.

    In a run of promotable tokens (punctuation passed over) all are promoted if the token before the run is
    target, else only the last if the token after it is. Tokens are dealt out by line once, and stay so for merge_spans()."""
    can = (F.col("label") == OTHER) & (F.col("core") != "") & (F.greatest("en_zipf", "fr_zipf") < threshold) & (F.col("core").rlike(r"[^\x00-\x7f]") | F.col("core").contains("'"))
    word, line = F.col("label") != PUNCT, W.partitionBy("line_id")
    before = lambda *order: line.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    t = tokens.withColumn("can", can)
    t = t.withColumn("right", F.last(F.when(word, F.struct("can", "label")), ignorenulls=True).over(before(F.desc("pos"))))
    t = t.withColumn("left", F.last(F.when(word & ~F.col("can"), F.col("label")), ignorenulls=True).over(before("pos")))
    promote = F.col("can") & ((F.col("left") == TARGET) | (F.coalesce(~F.col("right.can"), F.lit(False)) & (F.col("right.label") == TARGET)))
    return t.withColumn("label", F.when(F.coalesce(promote, F.lit(False)), TARGET).otherwise(F.col("label"))).drop("can", "left", "right")


def merge_spans(tokens: DataFrame) -> DataFrame:
    """line_id, span_no, language, tokens, text: runs of one label; punctuation joins the open span, before any it is dropped."""
    line = W.partitionBy("line_id").orderBy("pos")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    t = tokens.withColumn("lang", F.last(F.when(F.col("label") != PUNCT, F.col("label")), ignorenulls=True).over(upto)).where("lang is not null")
    changed = F.coalesce(F.col("lang") != F.lag("lang").over(line), F.lit(True))
    t = t.withColumn("changed", changed.cast("int")).withColumn("span_no", F.sum("changed").over(upto))
    s = t.groupBy("line_id", "span_no").agg(F.first("lang").alias("language"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    s = s.withColumn("tokens", F.transform("x", lambda x: x["token"]))
    return s.select("line_id", "span_no", "language", "tokens", T.detokenize(F.col("tokens")).alias("text"))


def group_by_language(spans: DataFrame) -> DataFrame:
    """One array of span texts per language, in order, empty where there is none."""
    p = spans.groupBy("line_id").pivot("language", LABELS).agg(F.array_sort(F.collect_list(F.struct("span_no", "text"))))
    texts = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast("array<struct<span_no:bigint,text:string>>")), lambda x: x["text"])
    return p.select("line_id", *[texts(c).alias(c) for c in LABELS])


def _kept(spans: DataFrame, rules: T.Rules, tone_rules: T.Rules, language: str) -> DataFrame:
    joined = spans.where(F.col("language") == language).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "text"))).alias("x"))
    text = T.clean_document(F.array_join(F.transform("x", lambda x: x["text"]), " "), rules, tone_rules)
    out = joined.select("line_id", text.alias("text"))
    return out.select("line_id", T.detokenize(T.collapse_repeats(T.tokenize(F.col("text")))).alias("text")).where("text <> ''")


def keep_language(lines: DataFrame, lexicon: DataFrame, settings: Settings = Settings(), rules: T.Rules = (), tone_rules: T.Rules = (), language: str = TARGET) -> DataFrame:
    """line_id, text: the spans of one language joined, normalised, repeats collapsed; lines without any are left out."""
    return _kept(merge_spans(smooth_labels(label_tokens(lines, lexicon, settings), settings.score_threshold)), rules, tone_rules, language)


def filter_records(records: DataFrame, lexicon: DataFrame, settings: Settings = Settings(), rules: T.Rules = (), tone_rules: T.Rules = ()) -> DataFrame:
    """Records of a directory with their target-language text only and their provenance; records without any are left out."""
    # Stored, so that a row's number, a short key for its tokens, is the same wherever it is read.
    r = stored(records.withColumn("line_id", F.monotonically_increasing_id()))
    kept = keep_language(r.select("line_id", "text"), lexicon, settings, rules, tone_rules)
    return r.drop("text").join(kept, "line_id").select(*records.columns)


def segment_report(lines: DataFrame, lexicon: DataFrame, settings: Settings = Settings(), rules: T.Rules = (), tone_rules: T.Rules = ()) -> DataFrame:
    """line_id, tokens, spans, grouped texts by language and the target text only. Lines are classified once; their labelled
    tokens and spans are stored, and the parts of the report are read from these."""
    tokens = stored(smooth_labels(label_tokens(lines, lexicon, settings), settings.score_threshold))
    spans = stored(merge_spans(tokens))
    t = tokens.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "label"))).alias("tokens"))
    s = spans.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "language", "text"))).alias("spans"))
    kept = _kept(spans, rules, tone_rules, TARGET).withColumnRenamed("text", "target_only")
    return t.join(s, "line_id", "left").join(group_by_language(spans), "line_id", "left").join(kept, "line_id", "left")


def expand_lexicon(terms: DataFrame) -> DataFrame:
    """word: each term and its single words, quotes stripped."""
    return terms.select(F.explode(F.array_union(F.array("word"), F.split("word", " "))).alias("word")).select(T.strip_quotes(F.lower(F.trim("word"))).alias("word")).where("word <> ''").distinct()


def union_lexicons(frequent: DataFrame, strict: DataFrame) -> DataFrame:
    """word, is_strict of both lists."""
    both = frequent.select("word", F.lit(False).alias("s")).unionByName(strict.select("word", F.lit(True).alias("s")))
    return both.groupBy("word").agg(F.max("s").alias("is_strict"))


def word_types_v1(tokens: DataFrame, lexicon: DataFrame, stopwords: DataFrame, base_chars: str) -> DataFrame:
    """token, hit and foreign of tokens(token): each distinct one is looked up once, by joins with lexicon(word) and
    stopwords(word) of any size. A token in the lexicon or with one of base_chars is a hit; one that isn't in the lexicon is
    foreign if it is a stopword or has one or two characters, all ASCII. Tokens with punctuation or symbols are neither."""
    t = tokens.select("token").distinct().withColumn("core", F.regexp_replace(F.lower("token"), '^["«»]+|["«»]+$', ""))
    listed = lambda words, name: broadcast_if_small(stored(words.select(F.col("word").alias("core")).where("core <> ''").distinct())).withColumn(name, F.lit(True))
    t = t.join(listed(lexicon, "known"), "core", "left").join(listed(stopwords, "stop"), "core", "left")
    is_word = ~F.col("token").rlike(f"[{T.P_OR_S}]") & (F.col("core") != "")
    known, stop = F.coalesce("known", F.lit(False)), F.coalesce("stop", F.lit(False))
    hit = known | (F.col("core").rlike(f"[{base_chars}]") if base_chars else F.lit(False))
    return t.select("token", (is_word & hit).alias("hit"), (is_word & ~known & (stop | F.col("core").rlike(r"^[\x00-\x7f]{1,2}$"))).alias("foreign"))


def keep_words_v1(lines: DataFrame, lexicon: DataFrame, stopwords: DataFrame, base_chars: str) -> DataFrame:
    """The earlier line filter over lines(line_id, text): line_id, text; lexicon(word) and stopwords(word) are tables.

    With ' : ' the side where the target dominates (both: the line); else target words and the punctuation next to
    them. A mark is kept after a kept token or before a kept word, a colon only between both; marks already kept count
    as kept tokens for the next one. Lines that keep nothing are left out. line_ids are unique; lines are stored with
    their tokens, whose distinct types are classified once; hits and foreign ones are broadcast while they are few."""
    d = lines.select("line_id", F.trim(F.coalesce("text", F.lit(""))).alias("line"))
    side = lambda i: F.trim(F.regexp_extract("line", r"(?s)^(.*?)\s:\s(.*)$", i))
    d = stored(d.withColumn("l", side(1)).withColumn("r", side(2)).withColumn("tokens", T.tokenize_edges(F.col("line"))))
    both = "l <> '' and r <> ''"
    types = d.select(F.explode("tokens").alias("token"))
    types = types.unionByName(d.where(both).select(F.explode(F.concat(T.tokenize_edges(F.col("l")), T.tokenize_edges(F.col("r")))).alias("token")))
    types = broadcast_if_small(stored(word_types_v1(types, lexicon, stopwords, base_chars).where("hit or foreign")))
    tagged = lambda c: F.transform(T.tokenize_edges(F.col(c)), lambda t: F.struct(F.lit(c).alias("side"), t.alias("token")))
    sided = d.where(both).select("line_id", F.inline(F.concat(tagged("l"), tagged("r")))).join(types, "token")
    count = lambda c, kind: F.count_if((F.col("side") == c) & F.col(kind))
    sums = sided.groupBy("line_id").agg(*[count(c, k).alias(f"{c}_{k}") for c in "lr" for k in ("hit", "foreign")])
    wins = lambda c: (F.col(f"{c}_hit") > 0) & (F.col(f"{c}_hit") >= F.col(f"{c}_foreign"))
    sums = sums.select("line_id", wins("l").alias("lt"), wins("r").alias("rt")).where("lt or rt")
    decided = stored(d.join(sums, "line_id").select("line_id", F.when(~F.col("rt"), F.col("l")).when(~F.col("lt"), F.col("r")).otherwise(F.col("line")).alias("text")))
    rest = d.join(decided.select("line_id"), "line_id", "left_anti").select("line_id", F.posexplode("tokens").alias("pos", "token")).join(types.select("token", "hit"), "token", "left")
    rest = rest.withColumn("hit", F.coalesce("hit", F.lit(False)))
    t = F.col("token")
    rest = rest.withColumn("mark", t.rlike(f"^[{T.P_OR_S}]+$"))
    by = W.partitionBy("line_id").orderBy("pos")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    # Marks follow a kept token while no colon has come between; a colon is kept only just before a word.
    stop = F.when(~F.col("mark"), F.struct("pos", "hit")).when(t == ":", F.struct("pos", F.lit(False).alias("hit")))
    rest = rest.withColumn("chain", F.coalesce(F.last(stop, ignorenulls=True).over(before)["hit"], F.lit(False))).withColumn("next", F.coalesce(F.lead("hit").over(by), F.lit(False)))
    keep = F.when(~F.col("mark"), F.col("hit")).when(t == ":", F.col("chain") & F.col("next")).otherwise(F.col("chain") | F.col("next"))
    kept = rest.where(keep).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["token"]), " "), r"\s+([,.;:!?])", "$1"))
    return decided.unionByName(kept.select("line_id", text.alias("text"))).where("text <> ''")
