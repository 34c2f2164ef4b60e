"""Column transforms for text. Everything is built-in functions but Unicode normal forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]
SPACES = r"(?U)[\s\x1c-\x1f]+"
PUNCT = ".,;:!?\""
#: Characters that mark text decoded as Latin-1 by mistake, and those folded to ' and ".
SUSPICIOUS, APOSTROPHES, QUOTES = "ÃÂâÌÉð", "‘’`´ʼ", "“”«»"
TOKEN = r"[\p{L}\p{N}\p{M}'’ʼ]+|[^\s]"
P_OR_S = r"\p{P}\p{S}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """A generator of the one value, for select() and withColumn(): filters on the new column aren't moved below it, where
    they would compute the value a second time."""
    return F.explode(F.array(value))


def unicode_form(c: Column, form: str) -> Column:
    """NFC, NFD or NFKD of a string column, by Arrow batches; batches of plain ASCII pass unread."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(x)).as_py() in (True, None):
            return x
        return pa.array([None if s is None else unicodedata.normalize(form, s) for s in x.to_pylist()], pa.string())

    return run(c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; anything else is kept."""
    fixed = lambda x: F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x)
    return let(c, lambda x: F.when(x.rlike(f"[{SUSPICIOUS}]") & x.rlike(r"^[\x00-\xFF]*$"), fixed(x)).otherwise(x))


def normalize_text(c: Column) -> Column:
    c = F.translate(repair_mojibake(F.coalesce(c, F.lit(""))), APOSTROPHES + QUOTES + "﻿", "'" * len(APOSTROPHES) + '"' * len(QUOTES))
    return unicode_form(c, "NFC")


def ordered(rules: Rules) -> Rules:
    """Longest source first, stable otherwise; a source's first rule wins."""
    seen = dict.fromkeys(a for a, _ in rules)
    first = {a: b for a, b in reversed(rules)}
    return sorted(((a, first[a]) for a in seen), key=lambda r: -len(r[0]))


def _quoted(words) -> str:
    return "|".join("\\Q" + w + "\\E" for w in words)


def apply_rules(c: Column, rules: Rules) -> Column:
    """Sequential replacement, longest source first; later rules see the output of earlier ones."""
    rules = ordered(rules)
    if not rules:
        return c
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules])
    return F.when(c.rlike(_quoted(a for a, _ in rules)), F.aggregate(table, c, lambda s, r: F.replace(s, r["a"], r["b"]))).otherwise(c)


def strip_low_tone_mark(c: Column, mark: str = "̀") -> Column:
    return unicode_form(F.translate(unicode_form(c, "NFD"), mark, ""), "NFC")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_text(c: Column, rules: Rules = (), tone_rules: Rules = (), punct: str = PUNCT) -> Column:
    """Normalised, rules applied, lower case, punctuation deleted, white space collapsed; null gives ''."""
    c = apply_rules(apply_rules(normalize_text(c), list(rules)), list(tone_rules))
    return collapse_spaces(F.translate(F.lower(c), punct, ""))


def clean_document(c: Column, rules: Rules = (), tone_rules: Rules = ()) -> Column:
    """As clean_text, but case, punctuation and spacing stay."""
    return unicode_form(apply_rules(apply_rules(normalize_text(c), list(rules)), list(tone_rules)), "NFC")


def assume_low_tone(c: Column, low: dict[str, str], marks: str, mode: str = "first") -> Column:
    """Words without any of the marks (in NFD) get the low form of their first bare vowel, or of all."""
    if mode not in ("first", "all"):
        raise ValueError("mode is 'first' or 'all'")
    vowels = "".join(low)
    if mode == "all":
        changed = F.aggregate(F.split(c, ""), F.lit(""), lambda s, x: F.concat(s, F.coalesce(F.create_map(*[F.lit(v) for kv in low.items() for v in kv])[x], x)))
    else:
        at = F.regexp_instr(c, F.lit(f"[{vowels}]"))
        new = F.create_map(*[F.lit(v) for kv in low.items() for v in kv])[F.substr(c, at, F.lit(1))]
        changed = F.when(at > 0, F.concat(F.left(c, at - 1), new, F.substr(c, at + 1))).otherwise(c)
    return F.when(unicode_form(c, "NFD").rlike(f"[{marks}]"), c).otherwise(changed)


def strip_note_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)\bn\.\s*b\.", "")


def tokenize(c: Column) -> Column:
    """Runs of letters, digits, marks and apostrophes; every other visible character alone."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokenize_edges(c: Column) -> Column:
    """White-space chunks with punctuation and symbols peeled off both ends, one by one."""
    chunks = F.filter(F.split(c, SPACES), lambda x: x != "")
    lead = lambda x: F.regexp_extract(x, f"^[{P_OR_S}]*", 0)
    tail = lambda x: F.regexp_extract(x, f"(?<![{P_OR_S}])[{P_OR_S}]+$", 0)
    chars = lambda s: F.filter(F.split(s, ""), lambda y: y != "")

    def peel(x: Column) -> Column:
        core = F.regexp_extract(x, f"^[{P_OR_S}]*(.*?)[{P_OR_S}]*$", 1)
        return F.when(core == "", chars(lead(x))).otherwise(F.concat(chars(lead(x)), F.array(core), chars(tail(x))))

    return F.flatten(F.transform(chunks, peel))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def detokenize(tokens: Column) -> Column:
    """Joined by spaces, none before closing or after opening punctuation."""
    glue = lambda s, t: F.when(s == "", t).when(t.isin(*".,!?;:)]}") | F.right(s, F.lit(1)).isin(*'([{"'), F.concat(s, t)).otherwise(F.concat(s, F.lit(" "), t))
    return F.trim(F.aggregate(tokens, F.lit(""), glue))


def is_punct(c: Column) -> Column:
    """No letter and no letter number anywhere."""
    return ~c.rlike(r"[\p{L}\p{Nl}]")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, '^["“”«»]+|["“”«»]+$', "")


def collapse_repeats(tokens: Column) -> Column:
    """Of adjacent tokens equal but for case the first stays; punctuation breaks a run."""
    plain = lambda t: strip_quotes(F.lower(t))
    return let(tokens, lambda ts: F.filter(ts, lambda t, i: is_punct(t) | (i == 0) | ~F.coalesce(plain(F.get(ts, i - 1)) == plain(t), F.lit(False))))


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def is_numeric_pointer(c: Column) -> Column:
    """Numbers with their separators, and arrows."""
    return c.rlike(r"^[\p{N}\p{P}\p{S}]+$")


def is_alpha_word(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{Mn}' -]*\p{L}[\p{L}\p{Mn}' -]*$")


def is_titlecase(c: Column) -> Column:
    """Two letters or more, the first upper, all others lower case."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return letters.rlike(r"^\p{Lu}\p{Ll}+$")


def non_ascii_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\x00-\x7f]", ""))


def rhs_of_assignment(c: Column) -> Column:
    return F.trim(F.when(c.contains("="), F.regexp_extract(c, r"(?s)^[^=]*=(.*)$", 1)).otherwise(c))


def clean_word(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(c)), r"^[\p{P}\p{S}&&[^']]+|[\p{P}\p{S}&&[^']]+$", "")
    return F.regexp_replace(c, "^'+", "")


def spelling_category(c: Column, keys: list[str]) -> Column:
    """struct(category, key): 'variant' with the longest key that the word holds, else 'standard'."""
    keys = F.array(*[F.lit(k) for k in sorted(dict.fromkeys(keys), key=lambda k: -len(k))])
    key = F.get(F.filter(keys, lambda k: c.contains(k)), F.lit(0))
    return F.struct(F.when(key.isNull(), "standard").otherwise("variant").alias("category"), key.alias("key"))


def asset_url(key: Column, base: str) -> Column:
    """base/key with the key percent-encoded but for its slashes."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def safe_name(c: Column) -> Column:
    """An ASCII file stem: marks dropped, anything odd as one underscore."""
    plain = F.regexp_replace(unicode_form(c, "NFKD"), r"[^\x00-\x7f]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("file"))


def trim_context(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def normalize_key(c: Column, fixes: dict[str, str] | None = None) -> Column:
    """Digits with an apostrophe become N*, then the fix map applies."""
    c = F.regexp_replace(F.trim(c), r"^(\d+)'$", "$1*")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])[c], c) if fixes else c


def unescape(c: Column) -> Column:
    for a, b in ((r"\\", "\x00"), (r"\"", '"'), (r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), ("\x00", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_bytes(content: Column) -> Column:
    """Bytes as UTF-8 (its byte-order mark dropped) where valid, else as Latin-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")
