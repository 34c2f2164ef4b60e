"""The queries that segment, clean and expand cover every line, turn and document."""

import random
import re

import pytest

from textloom.operators import expand, generate, lookup, ngram, reshape
from textloom.operators.shared import children, shared_dir
from textloom.plans import queries as plans
from textloom.plans import segmentation
from textloom.sources import writers


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    text = "der alte hund und der alte hund und der alte hund\nthe old dog and the old dog and the old dog\n\nzettel am ende"
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    put("documents", [(1, text, "de", "a", len(text)), (2, "abc1 e1 Hund420", "de", "a", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    put("conversations", [(1, 0, "user", "erste frage"), (1, 1, "assistant", "zweite antwort"), (1, 1, "assistant", "zweite antwort")], "conv_id long, turn long, role string, text string")
    put("benchmark", [(1, "nur ein posten")], "item_id long, text string")
    return str(at)


def test_all_lines_are_segmented(spark, small):
    ids = {"d:1:0", "d:1:1", "d:1:2", "d:1:3", "d:2:0", "c:1:0:1", "c:1:1:1", "c:1:1:2", "b:1"}
    assert {r.line_id for r in segmentation.all_lines(spark, small).collect()} == ids
    full = ids - {"d:1:2"}
    tokens = plans.QUERIES["q_smooth_labels_all"](spark, small).collect()
    assert {r.line_id for r in tokens} == full and len(tokens) == 11 + 11 + 3 + 3 + 2 + 2 + 2 + 3
    assert {r.token for r in tokens} == {r.token for r in plans.QUERIES["q_classify_tokens_all"](spark, small).collect()} >= {"zettel", "antwort", "posten"}
    spans = plans.QUERIES["q_spans_all"](spark, small).collect()
    assert {r.line_id for r in spans} == full == {r.line_id for r in plans.QUERIES["q_grouped_all"](spark, small).collect()}
    kept = {r.line_id: r.text for r in plans.QUERIES["q_keep_lang"](spark, small).collect()}
    assert kept["d:1:3"] == "zettel am ende" and kept["c:1:1:2"] == "zweite antwort"


def test_all_documents_are_cleaned_and_expanded(spark, small):
    assert {r.doc_id for r in plans.QUERIES["q_clean_document_all"](spark, small).collect()} == {1, 2}
    got = {r.text_id: r.text for r in plans.QUERIES["q_expand_tokens_all"](spark, small).collect()}
    assert set(got) == {1, 2} and got[2] == "abcone ê Hund4xx"


def test_assets_of_all_words_are_excluded_or_kept(spark, small):
    """Words of odd length have an asset as those of even length have; none of them is as frequent as the excluded ones."""
    kept = {r.word for r in plans.QUERIES["q_exclude_assets"](spark, small).collect()}
    assert kept == {"der", "alte", "hund", "und", "the", "old", "dog", "and", "zettel", "am", "ende", "abc1", "e1", "hund420"}


def test_more_than_ten_thousand_keys(spark):
    required = spark.range(10_500).selectExpr("cast(id as string) as k")
    assert reshape.missing_keys(spark.createDataFrame([("a", "7"), (None, "8")], "e string, k string"), required, "e", "k").count() == 2 * 10_499
    rows = spark.range(10_500).selectExpr("'v' as verb", "cast(id as string) as tense", "id as row_no", "'x' as value")
    assert reshape.group_tenses(rows, spark.range(10_500).selectExpr("cast(id as string) as tense", "'g' as grp", "'h' as header"), ["h"]).count() == 10_500


def test_the_lexicon_is_read_once(spark):
    """Rows of the lexicon are counted as they are made: a lexicon that is derived anew for each join costs that many passes."""
    made = spark.sparkContext.accumulator(0)

    def lexicon(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    words = [("fr", "marcher", 4.0), ("en", "dog", 4.0), ("target", "hund", 4.0)]
    lex = spark.createDataFrame(words, "lang string, word string, zipf double").coalesce(1).mapInArrow(lexicon, "lang string, word string, zipf double")
    lines = spark.createDataFrame([("1", "der hund marchait , (dog) l'hund"), ("2", "hund, dog")], "line_id string, text string")
    spans = segmentation.segment.merge_spans(segmentation.segment.smooth_labels(segmentation.segment.label_tokens(lines, lex, segmentation.CFG)))
    assert spans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(line_id") == 1
    assert {r.language for r in spans.collect()} >= {"Target", "English"} and made.value == len(words)


@pytest.fixture
def passes(spark):
    """A DataFrame of rows that counts how often each of them is made."""

    def of(rows, schema):
        made = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(run, schema), lambda: made.value / len(rows)

    return of


def test_model_reads_its_sentences_once(passes, tmp_path):
    s, times = passes([(["a", "b", "c"],), (["a", "b"],)], "tokens array<string>")
    model = ngram.combined_model(s, 3)
    writers.save_model(model, f"{tmp_path}/m")
    assert times() == 1 and model.sparkSession.conf.get(writers.ORDERS[0]) == "0"
    assert {(r.next, r.cnt) for r in model.sparkSession.read.parquet(f"{tmp_path}/m/n=2").where("ctx[0] = 'a'").collect()} == {("b", 2)}


def test_word_counts_are_read_once(passes, tmp_path):
    c, times = passes([("aa", 3, True), ("bb", 1, True)], "word string, cnt long, is_alpha boolean")
    writers.export_lexical(c, f"{tmp_path}/lex")
    assert times() == 1
    e, times = passes([("aa",)], "word string")
    assert {r.word for r in lookup.exclude_assets(c.select("word"), e).collect()} == {"bb"} and times() == 1


def test_unchanged_tokens_are_not_joined(spark, passes):
    words = [(i, f"word{i:05d}x e1 zz") for i in range(60)]
    texts, keys = spark.createDataFrame(words, "text_id long, text string"), spark.createDataFrame([("e1", "ê")], "key string, value string")
    out = expand.expand_tokens(texts, keys)
    tables = [spark.read.parquet(f).count() for f in out.inputFiles() if "stored-" in f]
    assert sum(tables) == 1 and {r.text for r in out.collect()} == {t.replace("e1", "ê") for _, t in words}
    t, times = passes([("e1",), ("zz",)], "token string")
    assert {r.token: r.shown for r in expand.expand_live(t, keys).collect()} == {"e1": "ê", "zz": "zz"} and times() == 1


def test_generation_stores_no_model(spark, small):
    """Texts are those that a stored model gives, for contexts of any length, and the queries write no model to disk."""
    rng = random.Random(5)
    said = [([rng.choice("abcd") for _ in range(rng.randrange(0, 6))],) for _ in range(60)]
    s = spark.createDataFrame(said, "tokens array<string>")
    r = spark.createDataFrame([(1, ["a"]), (2, ["b", "zz"]), (3, ["zz", "c"]), (4, ["a", "b", "c"]), (5, []), (6, ["d", "d"])], "request_id long, tokens array<string>")
    for max_ctx, max_n, heat in [(2, 3, 0.0), (2, 3, 0.8), (3, 3, 0.8), (1, 4, 0.0), (3, 4, 1.0)]:
        each = [generate.generate(r, m, max_ctx=max_ctx, max_tokens=5, temperature=heat, tries=3) for m in (ngram.combined_model(s, max_n), generate.CorpusModel(s, max_n))]
        a, b = (sorted((x.request_id, x["try"], x.text, x.status) for x in d.collect()) for d in each)
        assert a == b and len(a) == 18
    before = set(children(spark, shared_dir(spark)))
    for name in ("q_generate_argmax", "q_generate_sampled", "q_generation_report"):
        assert plans.QUERIES[name](spark, small).count() > 0
    assert not [x for x in set(children(spark, shared_dir(spark))) - before if x.startswith("model-")]


def test_coverage_counts_distinct_grams_in_parts(spark, monkeypatch):
    """Any tokens, and parts of the keys one after the other, give what the model's rows give; nothing of no sentences."""
    rng = random.Random(6)
    said = [([rng.choice(["a", "b", "", "x\ny", "\\", "\\n", "n"]) for _ in range(rng.randrange(0, 6))],) for _ in range(60)]
    s = spark.createDataFrame(said, "tokens array<string>")
    for max_n in (2, 3, 5):
        want = sorted(ngram.model_coverage(ngram.with_probability(ngram.ngram_counts(s, range(2, max_n + 1)))).collect())
        for places in (10**9, 60):
            monkeypatch.setattr(ngram, "PASS_PLACES", places)
            assert sorted(ngram.coverage(s, max_n).collect()) == want and len(want) == max_n - 1
    assert ngram.coverage(s.limit(0), 3).count() == 0
    words = ngram.coverage(s, 4)._jdf.queryExecution().executedPlan().toString()
    assert "ctx" not in words


def test_model_shuffles_one_string_a_place_and_stores_sentences_only(spark, tmp_path):
    """Windows are shuffled once for all orders, as one string each; saving a model stores no counts beside it."""
    s = spark.createDataFrame([(["a", "b", "c", "d", "e", "f"],), (["a", "b\n", "\\c"],)], "tokens array<string>")
    before = set(children(spark, shared_dir(spark)))
    m = ngram.combined_model(s, 5)
    plan = m._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"REPARTITION_BY_NUM.*?Project \[(.*?)\]\s*\n", plan, re.S)
    assert dealt and all(x.startswith("concat_ws(") and x.count(" AS ") == 1 for x in dealt)
    writers.save_model(m, f"{tmp_path}/m")
    assert {x.split("-")[0] for x in set(children(spark, shared_dir(spark))) - before} == {"sentences"}
    want = ngram.with_probability(ngram.ngram_counts(s, range(2, 6)))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/m").select(*want.columns).collect())) == sorted(map(str, want.collect()))
