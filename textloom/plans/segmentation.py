"""Segmentation queries: German is the target language, English and French are foreign; the lexicon comes from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexical, segment
from textloom.plans.queries import clean_sql, edges_sql, norm_sql, query, records, table, tokens_by_lang

CFG = segment.Settings(stop_en=["the", "of", "and"], stop_fr=["le", "la", "et", "de"], protected=["die"], verb_special=["est"], base_chars="ßäöü")


def lexicon(spark, sf_dir) -> DataFrame:
    z = lexical.zipf(tokens_by_lang(spark, sf_dir)).where("lang in ('en', 'fr', 'de') and cnt >= 3")
    return z.select(F.when(F.col("lang") == "de", "target").otherwise(F.col("lang")).alias("lang"), "word", F.round("zipf", 9).alias("zipf"))


def _name(kind: str, *ids: str):
    return F.concat(F.lit(kind), *[F.concat(F.lit(":"), F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in ids]).alias("line_id")


def lines(spark, sf_dir) -> DataFrame:
    """Every benchmark item and every turn of the conversations as mixed lines; a turn's id has the number of the row
    among those of one turn, so repeated rows stay apart."""
    c = table(spark, sf_dir, "conversations").withColumn("copy", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("text", "role")))
    b = table(spark, sf_dir, "benchmark")
    return c.select(_name("c", "conv_id", "turn", "copy"), "text").unionByName(b.select(_name("b", "item_id"), "text"))


def document_lines(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return d.select(_name("d", "doc_id", "line_no"), "text")


def all_lines(spark, sf_dir) -> DataFrame:
    """lines() and every line of documents."""
    return document_lines(spark, sf_dir).unionByName(lines(spark, sf_dir))


def _ends(c: str, suffixes) -> str:
    return "(" + (" OR ".join(f"suffix({c}, '{s}')" for s in suffixes) or "false") + ")"


def _lemmas(c: str) -> str:
    out = "[]::VARCHAR[]"
    for suffixes, cut, endings in segment.LEMMAS:
        on = _ends(c, suffixes) + (f" AND NOT {_ends(c, ['ait', 'ais'])}" if suffixes == ["it", "is"] else "")
        stem = f"left({c}, length({c}) - {cut})"
        out = f"list_concat({out}, CASE WHEN {on} AND length({c}) > {cut} THEN [{', '.join(f'{stem} || {e!r}' for e in endings)}] ELSE [] END)"
    return out


def _family(c: str) -> str:
    out = "[]::VARCHAR[]"
    for s in CFG.derivational:
        base = f"left({c}, length({c}) - {len(s)})"
        ends = ", ".join(f"{base} || {e!r}" for e in segment.FAMILY)
        out = f"list_concat({out}, CASE WHEN suffix({c}, '{s}') AND length({c}) > {len(s)} THEN [{ends}] ELSE [] END)"
    return out


def _in(c: str, values) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in [*values, chr(1)])})"


ASCII = r"'^[\x00-\x7f]*$'"
HINT = lambda c: f"(regexp_matches({c}, '[{CFG.hint_chars}]') OR {_ends(c, CFG.hint_suffixes)})"
SCORED = f"ez - fz >= {CFG.margin} THEN '{segment.EN}' WHEN fz - ez >= {CFG.margin} THEN '{segment.FR}'"


def _verb(c: str, ez: str, fz: str, lemma: str, blocked: str) -> str:
    return (
        f"(NOT contains({c}, '''') AND regexp_matches({c}, {ASCII}) AND NOT {_in(c, [*CFG.protected, ''])} AND ({_in(c, CFG.verb_special)} OR (NOT {blocked} AND ({lemma} OR ({_ends(c, CFG.verb_suffixes)} AND {fz} >= 1.2 AND {fz} >= {ez})))))"
    )


LINES = """SELECT 'b:' || item_id AS line_id, text FROM benchmark UNION ALL
    SELECT 'c:' || conv_id || ':' || turn || ':' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY text, role), text FROM conversations"""
DOCUMENT_LINES = "SELECT 'd:' || doc_id || ':' || (i - 1) AS line_id, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
CTE = rf"""lines AS MATERIALIZED ({LINES}),
rows_ AS MATERIALIZED (SELECT line_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT line_id, regexp_extract_all(text, '[\pL\pN\pM''’ʼ]+|[^\s]') AS t FROM lines)),
zn AS (SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest(string_split({clean_sql('text')}, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2),
z AS (SELECT lang, word, cnt, round(log10(cnt * 1e9 / sum(cnt) OVER (PARTITION BY lang)), 9) AS zipf FROM zn),
lex AS MATERIALIZED (SELECT word, bool_or(lang = 'en') AS en, bool_or(lang = 'fr') AS fr, bool_or(lang = 'de') AS tg, coalesce(max(CASE WHEN lang = 'en' THEN zipf END), 0) AS ez, coalesce(max(CASE WHEN lang = 'fr' THEN zipf END), 0) AS fz
    FROM z WHERE lang IN ('en', 'fr', 'de') AND cnt >= 3 GROUP BY word),
t0 AS (SELECT token, n, regexp_replace(n, '^["“”«»]+|["“”«»]+$', '', 'g') AS core, regexp_extract(n, '(?s)^[^'']*''(.*)$', 1) AS suf, regexp_extract(n, '(?s)^([^'']*)''', 1) AS pre FROM (SELECT DISTINCT token, lower({norm_sql('token')}) AS n FROM rows_)),
hit AS (SELECT k, token FROM (SELECT 'l' AS k, token, unnest({_lemmas('core')}) AS w FROM t0 UNION ALL SELECT 's', token, unnest({_lemmas('suf')}) FROM t0 UNION ALL SELECT 'f', token, unnest({_family('core')}) FROM t0) SEMI JOIN (SELECT word FROM lex WHERE fr) ON w = word),
t1 AS MATERIALIZED (SELECT t0.*, coalesce(c.en, false) AS en, coalesce(c.fr, false) AS fr, coalesce(c.tg, false) AS tg, coalesce(c.ez, 0) AS ez, coalesce(c.fz, 0) AS fz, coalesce(s.fr, false) AS sfr, coalesce(s.ez, 0) AS sez, coalesce(s.fz, 0) AS sfz,
    token IN (SELECT token FROM hit WHERE k = 'l') AS lemma, token IN (SELECT token FROM hit WHERE k = 's') AS slemma, token IN (SELECT token FROM hit WHERE k = 'f') AS family FROM t0 LEFT JOIN lex c ON c.word = core LEFT JOIN lex s ON s.word = suf),
types AS MATERIALIZED (SELECT token, n AS normalized, core, ez AS en_zipf, fz AS fr_zipf, CASE
    WHEN NOT regexp_matches(token, '[\pL\p{{Nl}}]') AND NOT regexp_matches(token, '\pN') THEN '{segment.PUNCT}'
    WHEN contains(n, '''') AND {_in('pre', CFG.prefixes)} AND suf <> '' AND (sfr OR {_in('suf', CFG.stop_fr)} OR {_verb('suf', 'sez', 'sfz', 'slemma', 'false')} OR {HINT('suf')}) THEN '{segment.FR}'
    WHEN contains(n, '''') AND NOT en AND NOT fr THEN '{segment.TARGET}' WHEN core = '' THEN '{segment.OTHER}'
    WHEN {_in('core', CFG.protected)} OR tg OR regexp_matches(core, '[{CFG.base_chars}\p{{Mn}}]') THEN '{segment.TARGET}'
    WHEN {_in('core', CFG.stop_en)} AND NOT {_in('core', CFG.stop_fr)} THEN '{segment.EN}' WHEN {_in('core', CFG.stop_fr)} AND NOT {_in('core', CFG.stop_en)} THEN '{segment.FR}'
    WHEN {_verb('core', 'ez', 'fz', 'lemma', 'false')} THEN '{segment.FR}' WHEN en AND NOT fr THEN '{segment.EN}' WHEN fr AND NOT en THEN '{segment.FR}'
    WHEN en AND fr THEN CASE WHEN {SCORED} ELSE '{segment.BOTH}' END
    WHEN greatest(ez, fz) >= {CFG.score_threshold} AND CASE WHEN {SCORED} WHEN regexp_matches(core, {ASCII}) AND greatest(ez, fz) >= 5.4 THEN 'x' END IS NOT NULL THEN CASE WHEN {SCORED} ELSE '{segment.BOTH}' END
    WHEN NOT contains(core, '''') AND NOT (regexp_matches(core, '[áéíóúàèìòùâêîôûǎěǐǒǔāēīōū]') AND length(regexp_replace(core, '[^\pL]', '', 'g')) <= 3) AND {HINT('core')} THEN '{segment.FR}'
    WHEN NOT contains(core, '''') AND regexp_matches(core, {ASCII}) AND family THEN '{segment.FR}'
    WHEN regexp_matches(regexp_replace(token, '[^\pL]', '', 'g'), '^\p{{Lu}}\p{{Ll}}+$') THEN '{segment.OTHER}' ELSE '{segment.TARGET}' END AS label FROM t1),
labelled AS MATERIALIZED (SELECT r.line_id, r.pos, t.* FROM rows_ r JOIN types t USING (token)),
w AS (SELECT *, label = '{segment.OTHER}' AND core <> '' AND greatest(en_zipf, fr_zipf) < {CFG.score_threshold} AND (regexp_matches(core, '[^\x00-\x7f]') OR contains(core, '''')) AS can FROM labelled WHERE label <> '{segment.PUNCT}'),
w2 AS (SELECT *, last_value(CASE WHEN NOT can THEN label END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, lead(can) OVER o AS rc, lead(label) OVER o AS rl FROM w WINDOW o AS (PARTITION BY line_id ORDER BY pos)),
smooth AS MATERIALIZED (SELECT line_id, pos, token, CASE WHEN coalesce(can AND (l = '{segment.TARGET}' OR (NOT rc AND rl = '{segment.TARGET}')), false) THEN '{segment.TARGET}' ELSE label END AS label FROM w2
    UNION ALL SELECT line_id, pos, token, label FROM labelled WHERE label = '{segment.PUNCT}'),
s1 AS (SELECT *, last_value(CASE WHEN label <> '{segment.PUNCT}' THEN label END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lang FROM smooth),
s2 AS (SELECT *, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY line_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM s1 WHERE lang IS NOT NULL),
s3 AS (SELECT *, sum(ch) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS span_no FROM s2),
spans AS MATERIALIZED (SELECT line_id, span_no, first(lang) AS language, trim(list_reduce(list(token ORDER BY pos), lambda s, t: CASE WHEN t IN ('.', ',', '!', '?', ';', ':', ')', ']', '}}') OR right(s, 1) IN ('(', '[', '{{', '"') THEN s || t ELSE s || ' ' || t END)) AS text FROM s3 GROUP BY 1, 2)"""
ALL = CTE.replace(f"lines AS MATERIALIZED ({LINES})", f"lines AS MATERIALIZED ({LINES} UNION ALL {DOCUMENT_LINES})")


def _classified_sql(cte: str) -> str:
    return f"WITH {cte} SELECT token, normalized, label, round(en_zipf, 9)::DOUBLE AS en_zipf, round(fr_zipf, 9)::DOUBLE AS fr_zipf FROM types"


def _smoothed_sql(cte: str) -> str:
    return f"WITH {cte} SELECT line_id, pos::INT AS pos, token, label FROM smooth"


def _spans_sql(cte: str) -> str:
    return f"WITH {cte} SELECT line_id, span_no, language, text FROM spans"


def _grouped_sql(cte: str) -> str:
    each = ", ".join(f"coalesce(string_agg(CASE WHEN language = '{x}' THEN text END, ' | ' ORDER BY span_no), '') AS \"{x}\"" for x in segment.LABELS)
    return f"WITH {cte} SELECT line_id, {each} FROM spans GROUP BY line_id"


def _classified(spark, sf_dir, of) -> DataFrame:
    return segment.classify_types(segment.token_rows(of(spark, sf_dir)), lexicon(spark, sf_dir), CFG).drop("core")


def _smoothed(spark, sf_dir, of) -> DataFrame:
    return segment.smooth_labels(segment.label_tokens(of(spark, sf_dir), lexicon(spark, sf_dir), CFG), CFG.score_threshold)


def _grouped(smoothed: DataFrame) -> DataFrame:
    g = segment.group_by_language(segment.merge_spans(smoothed))
    return g.select("line_id", *[F.array_join(F.col(f"`{x}`"), " | ").alias(x) for x in segment.LABELS])


@query(_classified_sql(CTE))
def q_classify_tokens(spark, sf_dir):
    return _classified(spark, sf_dir, lines)


@query(_smoothed_sql(CTE))
def q_smooth_labels(spark, sf_dir):
    return _smoothed(spark, sf_dir, lines).select("line_id", "pos", "token", "label")


@query(_spans_sql(CTE))
def q_spans(spark, sf_dir):
    return segment.merge_spans(_smoothed(spark, sf_dir, lines)).drop("tokens")


@query(_grouped_sql(CTE))
def q_grouped(spark, sf_dir):
    return _grouped(_smoothed(spark, sf_dir, lines))


# The same over the lines of documents too.
@query(_classified_sql(ALL))
def q_classify_tokens_all(spark, sf_dir):
    return _classified(spark, sf_dir, all_lines)


@query(_smoothed_sql(ALL))
def q_smooth_labels_all(spark, sf_dir):
    return _smoothed(spark, sf_dir, all_lines).select("line_id", "pos", "token", "label")


@query(_spans_sql(ALL))
def q_spans_all(spark, sf_dir):
    return segment.merge_spans(_smoothed(spark, sf_dir, all_lines)).drop("tokens")


@query(_grouped_sql(ALL))
def q_grouped_all(spark, sf_dir):
    return _grouped(_smoothed(spark, sf_dir, all_lines))


_BARE = "regexp_replace(lower({0}), '^[\"“”«»]+|[\"“”«»]+$', '', 'g')"
KEPT = rf"""kt AS (SELECT line_id, regexp_extract_all(nfc_normalize({norm_sql("string_agg(text, ' ' ORDER BY span_no)")}), '[\pL\pN\pM''’ʼ]+|[^\s]') AS t FROM spans WHERE language = '{segment.TARGET}' GROUP BY line_id),
kc AS (SELECT line_id, list_filter(t, lambda x, i: NOT regexp_matches(x, '[\pL\p{{Nl}}]') OR i = 1 OR {_BARE.format("t[i - 1]")} <> {_BARE.format("x")}) AS t FROM kt),
kept AS MATERIALIZED (SELECT line_id, trim(list_reduce(t, lambda s, x: CASE WHEN x IN ('.', ',', '!', '?', ';', ':', ')', ']', '}}') OR right(s, 1) IN ('(', '[', '{{', '"') THEN s || x ELSE s || ' ' || x END)) AS text FROM kc WHERE len(t) > 0)"""


@query(f"WITH {ALL}, {KEPT} SELECT line_id, text FROM kept WHERE text <> ''")
def q_keep_lang(spark, sf_dir):
    return segment.keep_language(all_lines(spark, sf_dir), lexicon(spark, sf_dir), CFG)


@query(
    f"""WITH {CTE}, {KEPT}, tk AS (SELECT line_id, string_agg(pos || '=' || token || '/' || label, '|' ORDER BY pos) AS tokens FROM smooth GROUP BY 1), sp AS (SELECT line_id, string_agg(language || ':' || text, '|' ORDER BY span_no) AS spans FROM spans GROUP BY 1)
SELECT line_id, md5(tokens) AS tokens_md5, spans, text AS target_only FROM tk LEFT JOIN sp USING (line_id) LEFT JOIN (SELECT * FROM kept WHERE text <> '') USING (line_id)"""
)
def q_segment_report(spark, sf_dir):
    r = segment.segment_report(lines(spark, sf_dir), lexicon(spark, sf_dir), CFG)
    tokens = F.array_join(F.transform("tokens", lambda x: F.concat(x["pos"].cast("string"), F.lit("="), x["token"], F.lit("/"), x["label"])), "|")
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["language"], F.lit(":"), x["text"])), "|")
    return r.select("line_id", F.md5(tokens.cast("binary")).alias("tokens_md5"), spans.alias("spans"), "target_only")


@query(
    f"""WITH {CTE.replace(f"lines AS MATERIALIZED ({LINES})", f"lines AS MATERIALIZED ({DOCUMENT_LINES})")}, {KEPT}, src AS (SELECT 'd:' || doc_id || ':' || (i - 1) AS line_id, source, doc_id * 16777216 + i AS unit_no, 'line ' || i AS reference, line
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) SELECT source AS source_path, reference, unit_no, text FROM src JOIN kept USING (line_id) WHERE text <> '' AND trim(line) <> ''"""
)
def q_filter_records(spark, sf_dir):
    """Records with their target-language text only."""
    r = records(spark, sf_dir).withColumn("reference", F.concat("reference", F.lit("@"), "unit_no"))
    out = segment.filter_records(r, lexicon(spark, sf_dir), CFG)
    return out.select("source_path", F.substring_index("reference", "@", 1).alias("reference"), "unit_no", "text")


LEX_V1, STOP_V1, CHARS_V1 = ["der", "und"], ["the", "of", "le"], "ßäöü"
_CORE = "regexp_replace(lower({0}), '^[\"«»]+|[\"«»]+$', '', 'g')"
_WORD = r"(NOT regexp_matches({0}, '[\pP\pS]') AND {0} <> '')"


def _target_v1(c: str) -> str:
    core = _CORE.format(c)
    return f"({core} <> '' AND ({_in(core, LEX_V1)} OR regexp_matches({core}, '[{CHARS_V1}]')))"


def _foreign_v1(c: str) -> str:
    core = _CORE.format(c)
    return rf"({core} <> '' AND NOT {_in(core, LEX_V1)} AND ({_in(core, STOP_V1)} OR regexp_matches({core}, '^[\x00-\x7f]{{1,2}}$')))"


def _dominant_v1(c: str) -> str:
    count = lambda test: f"len(list_filter(ts, lambda x: {_WORD.format('x')} AND {test('x')}))"
    return f"(SELECT {count(_target_v1)} > 0 AND {count(_target_v1)} >= {count(_foreign_v1)} FROM (SELECT {edges_sql(c)} AS ts))"


_SIDE = r"trim(regexp_extract(line, '(?s)^(.*?)\s:\s(.*)$', {0}))"


@query(
    rf"""WITH d AS MATERIALIZED (SELECT line_id, trim(text) AS line FROM ({DOCUMENT_LINES})), s AS (SELECT line_id, line, {_SIDE.format(1)} AS l, {_SIDE.format(2)} AS r FROM d),
sided AS (SELECT *, {_dominant_v1('l')} AS lt, {_dominant_v1('r')} AS rt FROM s WHERE l <> '' AND r <> ''),
decided AS MATERIALIZED (SELECT * FROM (SELECT line_id, CASE WHEN lt AND NOT rt THEN l WHEN rt AND NOT lt THEN r WHEN lt AND rt THEN line END AS text FROM sided) WHERE text IS NOT NULL),
tok AS (SELECT line_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT line_id, {edges_sql('line')} AS t FROM d ANTI JOIN decided USING (line_id))),
m AS (SELECT *, regexp_matches(token, '^[\pP\pS]+$') AS mark, {_WORD.format('token')} AND {_target_v1('token')} AS hit FROM tok),
c AS (SELECT *, coalesce(last_value(CASE WHEN NOT mark THEN hit WHEN token = ':' THEN false END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chain,
    coalesce(lead(hit) OVER (PARTITION BY line_id ORDER BY pos), false) AS nxt FROM m),
k AS (SELECT line_id, trim(regexp_replace(string_agg(token, ' ' ORDER BY pos), '\s+([,.;:!?])', '\1', 'g')) AS text FROM c WHERE CASE WHEN NOT mark THEN hit WHEN token = ':' THEN chain AND nxt ELSE chain OR nxt END GROUP BY line_id)
SELECT line_id, text FROM (SELECT * FROM decided UNION ALL SELECT * FROM k) WHERE text <> ''"""
)
def q_line_filter_v1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    d = d.select(_name("d", "doc_id", "line_no"), "text")
    words = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    return segment.keep_words_v1(d, words(LEX_V1), words(STOP_V1), CHARS_V1)


@query(rf"WITH w AS (SELECT unnest(list_concat([w], string_split(w, ' '))) AS x FROM (SELECT trim(lower({norm_sql('text')})) AS w FROM benchmark)) SELECT DISTINCT regexp_replace(x, '^[\"“”«»]+|[\"“”«»]+$', '', 'g') AS word FROM w WHERE regexp_replace(x, '^[\"“”«»]+|[\"“”«»]+$', '', 'g') <> ''")
def q_expand_lexicon(spark, sf_dir):
    return segment.expand_lexicon(table(spark, sf_dir, "benchmark").select(F.trim(F.lower(T.normalize_text(F.col("text")))).alias("word")))

