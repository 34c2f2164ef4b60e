"""Column functions over the given tables, each with SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import expand, lexical, lookup, segment
from textloom.plans.queries import CAL, KEYS, LEX, RECORDS, _calendar, clean_sql, edges_sql, keys, query, sentences, table, words

#: Small invented parameter tables.
LOW = {"a": "à", "e": "è", "i": "ì", "o": "ò", "u": "ù"}
MARKS = "́̀̂̌̄"
FIXES = {"12*": "dozen", "no": "nine"}
SPELLINGS = ["tion", "ou", "ount"]
ALIASES = [("the", 0, None), ("of", 1, "fair"), ("zz", 2, "fair")]
TODAY = date(1995, 6, 17)
RAW = r"SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]')) AS word FROM documents"


def vocabulary(spark, sf_dir) -> DataFrame:
    return words(spark, sf_dir).select("word").distinct()


@query("SELECT doc_id, text AS repaired, text AS plain, true AS kept FROM documents")
def q_repair_text(spark, sf_dir):
    """Every damaged text (UTF-8 read as Latin-1) must come back as it was; undamaged ones, and damaged ones with a letter that no Latin-1 text holds, are kept."""
    d = table(spark, sf_dir, "documents")
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    mixed = F.concat(damaged, F.lit("\u2126"))
    return d.select("doc_id", T.repair_mojibake(damaged).alias("repaired"), T.repair_mojibake(F.col("text")).alias("plain"), (T.repair_mojibake(mixed) == mixed).alias("kept"))


_FIRST = "regexp_replace(word, '[aeiou]', CASE regexp_extract(word, '[aeiou]') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LOW.items()) + " ELSE '' END)"
#: Letters that decompose into a base and one of MARKS, as far as the given tables hold any.
_MARKED = "[áéíóúýńśźćàèìòùǹâêîôûŷŵĉĝĥĵŝǎěǐǒǔčďňřšťžāēīōū]"


@query(
    f"""WITH {RECORDS}, {LEX} SELECT word, CASE WHEN marked THEN word ELSE {_FIRST} END AS first_low, CASE WHEN marked THEN word ELSE translate(word, '{"".join(LOW)}', '{"".join(LOW.values())}') END AS all_low
FROM (SELECT word, regexp_matches(word, '{_MARKED}') AS marked FROM wc)"""
)
def q_assume_low_tone(spark, sf_dir):
    low = lambda mode: T.assume_low_tone(F.col("word"), LOW, MARKS, mode)
    return vocabulary(spark, sf_dir).select("word", low("first").alias("first_low"), low("all").alias("all_low"))


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, chr(1))) AS tokens_md5 FROM (SELECT doc_id, {edges_sql('text')} AS t FROM documents)")
def q_edge_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokenize_edges(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "\x01").cast("binary")).alias("tokens_md5"))


_PLAIN = "regexp_replace(lower({0}), '^[\"“”«»]+|[\"“”«»]+$', '', 'g')"
COLLAPSE = rf"""list_filter(t, lambda x, i: NOT regexp_matches(x, '[\pL\p{{Nl}}]') OR i = 1 OR {_PLAIN.format("t[i - 1]")} <> {_PLAIN.format("x")})"""


@query(rf"SELECT doc_id, len(c)::INT AS n_kept, md5(array_to_string(c, '|')) AS kept_md5 FROM (SELECT doc_id, {COLLAPSE} AS c FROM (SELECT doc_id, regexp_extract_all(text, '[\pL\pN\pM''’ʼ]+|[^\s]') AS t FROM documents))")
def q_collapse_repeats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.collapse_repeats(T.tokenize(F.col("text"))).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_kept"), F.md5(F.array_join("t", "|").cast("binary")).alias("kept_md5"))


#: Punctuation or symbols but for the apostrophe.
EDGE = r"(?:[^\PP'']|\pS)+"


@query(rf"SELECT word, regexp_replace(regexp_replace(regexp_replace(lower(trim(word)), '^{EDGE}', ''), '{EDGE}$', ''), '^''+', '') AS cleaned FROM ({RAW})")
def q_clean_word(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("word")).distinct()
    return w.select("word", T.clean_word(F.col("word")).alias("cleaned"))


@query(
    f"""WITH {RECORDS}, {LEX} SELECT word, CASE WHEN contains(word, 'tion') OR contains(word, 'ou') THEN 'variant' ELSE 'standard' END AS category,
CASE WHEN contains(word, 'tion') THEN 'tion' WHEN contains(word, 'ount') THEN 'ount' WHEN contains(word, 'ou') THEN 'ou' END AS key FROM wc"""
)
def q_spelling_category(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("word", T.spelling_category(F.col("word"), SPELLINGS).alias("x")).select("word", "x.*")


_ENCODED = "replace(replace(url_encode(word), '%2A', '*'), '~', '%7E')"


@query(
    rf"""WITH {RECORDS}, {LEX}, a AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(strip_accents(word), '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS flat FROM wc)
SELECT word, 'https://x.test/a/' || md5(word) || '/' || replace({_ENCODED}, '%2F', '/') AS url, coalesce(nullif(flat, ''), 'file') AS name FROM a"""
)
def q_asset_urls(spark, sf_dir):
    """Where an asset of each word would be stored."""
    w = vocabulary(spark, sf_dir)
    key = F.concat(F.md5(F.col("word").cast("binary")), F.lit("/"), "word")
    return w.select("word", T.asset_url(key, "https://x.test/a/").alias("url"), T.safe_name(F.col("word")).alias("name"))


@query(
    f"""WITH {RECORDS}, {LEX} SELECT word, 'https://x.test/api/' || {_ENCODED} || ' https://x.test/s/' || replace({_ENCODED}, '%2F', '/') || '.mp3 https://x.test/s/' || md5(word) || '.mp3' AS urls FROM wc"""
)
def q_candidate_urls(spark, sf_dir):
    """Where the asset of each word may be, best first."""
    urls = lookup.candidate_urls(F.col("word"), F.md5(F.col("word").cast("binary")), "https://x.test/api", "https://x.test/s/")
    return vocabulary(spark, sf_dir).select("word", F.array_join(urls, " ").alias("urls"))


@query("SELECT doc_id, right(text, 240) AS context FROM documents")
def q_trim_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_context(F.col("text"), 240).alias("context"))


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CASE k WHEN '12*' THEN 'dozen' WHEN 'no' THEN 'nine' END, k) AS key FROM (SELECT l_orderkey, l_linenumber,
CASE WHEN l_returnflag = 'N' THEN 'no' WHEN l_linestatus = 'F' THEN l_quantity::INT || '*' ELSE l_quantity::INT || '''x' END AS k FROM lineitem)"""
)
def q_normalize_key(spark, sf_dir):
    n = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(F.col("l_returnflag") == "N", F.lit(" no ")).when(F.col("l_linestatus") == "F", F.concat(n, F.lit("'"))).otherwise(F.concat(n, F.lit("'x")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.normalize_key(raw, FIXES).alias("key"))


def _read_escapes_sql(c: str) -> str:
    for a, b in ((r"'\\'", "chr(0)"), (r"""'\"'""", """'"'"""), (r"'\n'", "chr(10)"), (r"'\r'", "chr(13)"), (r"'\t'", "chr(9)"), ("chr(0)", r"'\'")):
        c = f"replace({c}, {a}, {b})"
    return c


@query(rf"""SELECT doc_id, text AS unescaped, {_read_escapes_sql(r"replace(replace(replace(text, 'n', '\n'), 'e', '\e'), 't', '\\t')")} AS mixed, {_read_escapes_sql("text")} AS plain FROM documents""")
def q_unescape(spark, sf_dir):
    """Texts whose backslashes, quotes and line ends are escaped, texts with known, unknown and doubled escapes, and texts as they are."""
    escaped, mixed = F.col("text"), F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    for a, b in (("n", "\\n"), ("e", "\\e"), ("t", "\\\\t")):
        mixed = F.replace(mixed, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", T.unescape(escaped).alias("unescaped"), T.unescape(mixed).alias("mixed"), T.unescape(F.col("text")).alias("plain"))


@query("SELECT doc_id, text AS decoded FROM documents")
def q_decode_bytes(spark, sf_dir):
    """Even documents, and those that Latin-1 can't hold, come as UTF-8 with a byte-order mark, the others as Latin-1."""
    d = table(spark, sf_dir, "documents")
    narrow = F.col("text").rlike(r"^[\x00-\xff]*$")
    raw = F.when((F.col("doc_id") % 2 == 0) | ~narrow, F.encode(F.concat(F.lit("﻿"), "text"), "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return d.select("doc_id", T.decode_bytes(raw).alias("decoded"))


@query(
    f"WITH {RECORDS}, {LEX}, ex AS (SELECT DISTINCT unnest(string_split({clean_sql('text')}, ' ')) AS word FROM benchmark) SELECT word, cnt FROM wc ANTI JOIN ex USING (word)"
)
def q_words_without_benchmark(spark, sf_dir):
    ex = table(spark, sf_dir, "benchmark").select(F.explode(T.split_words(T.clean_text(F.col("text")))).alias("word"))
    return lexical.word_counts(lexical.lexical_tokens(sentences(spark, sf_dir), ex)).select("word", "cnt")


@query(
    f"WITH {RECORDS}, {LEX} SELECT word, bool_or(s) AS is_strict FROM (SELECT word, false AS s FROM wc WHERE cnt >= 5 UNION ALL SELECT DISTINCT unnest(string_split({clean_sql('text')}, ' ')), true FROM benchmark) GROUP BY word"
)
def q_union_lexicons(spark, sf_dir):
    frequent = lexical.word_counts(words(spark, sf_dir)).where("cnt >= 5")
    strict = table(spark, sf_dir, "benchmark").select(F.explode(F.split(T.clean_text(F.col("text")), " ")).alias("word"))
    return segment.union_lexicons(frequent, strict)


@query(
    f"""WITH {RECORDS}, {LEX}, {KEYS}, {CAL}, al AS (SELECT * FROM (VALUES ('the', 0, NULL), ('of', 1, 'fair'), ('zz', 2, 'fair')) v(key, off, intro)),
found AS (SELECT al.key, CASE WHEN intro IS NULL THEN text WHEN starts_with(text, 'market ') THEN intro || substr(text, 7) ELSE intro || ', ' || text END AS value FROM al JOIN cal ON cal.day = DATE '{TODAY}' + off::INT)
SELECT key, value FROM keys WHERE key <> 'of' UNION ALL SELECT key, value FROM found ANTI JOIN (SELECT key FROM keys WHERE key <> 'of') USING (key)"""
)
def q_dated_shortcuts(spark, sf_dir):
    """Keys with relative dates: 'the?' is a key of its own, 'of' is free because it is left out of the list."""
    k = keys(spark, sf_dir).where("key <> 'of'")
    aliases = spark.createDataFrame(ALIASES, "token string, offset_days int, intro string")
    return expand.dated_shortcuts(k, aliases, _calendar(spark, sf_dir), TODAY, "market")
