import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import expand, reshape


@pytest.fixture(scope="module")
def on(spark):
    """Applies a column function to strings."""

    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        out = [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]
        return out if len(out) > 1 else out[0]

    return run


def test_normal_forms(on):
    assert on(T.repair_mojibake, "cafÃ©", "Âge", "Ã¢ ok", "日本Ã©", None) == ["café", "Âge", "â ok", "日本Ã©", None]
    assert on(T.normalize_text, "﻿l’a “x” é", None) == ["l'a \"x\" é", ""]
    assert on(T.strip_low_tone_mark, "àè á", "ǹ") == ["ae á", "n"]


def test_rules_are_sequential_longest_first(on):
    rules = [("a", "b"), ("ab", "x"), ("xb", "q"), ("b", "c")]
    assert on(lambda c: T.apply_rules(c, rules), "aab", "zz", "ab") == ["cx", "zz", "x"]
    assert on(lambda c: T.clean_text(c, [("sì", "si")]), ' sì, "foo" bar ’ ', "N. B. foo", None) == ["si foo bar '", "n b foo", ""]
    assert on(T.strip_note_markers, "foo n. b. bar N.B. xn. b.") == "foo  bar  xn. b."
    assert on(lambda c: T.clean_document(c, [("a", "b")]), "A a! ") == "A b! "


def test_low_tone(on):
    low = {"a": "à", "e": "è"}
    assert on(lambda c: T.assume_low_tone(c, low, "̀́"), "kate", "káte", "xx") == ["kàte", "káte", "xx"]
    assert on(lambda c: T.assume_low_tone(c, low, "̀́", "all"), "kate") == "kàtè"


def test_tokens(on):
    assert on(T.tokenize, "ab'c d́e, x!") == ["ab'c", "d́e", ",", "x", "!"]
    assert on(T.tokenize_edges, "(a-b), x. ?!") == ["(", "a-b", ")", ",", "x", ".", "?", "!"]
    assert on(T.split_words, "", "a b") == [[], ["a", "b"]]
    join = lambda c: T.detokenize(T.tokenize(c))
    assert on(join, 'a , b ( c ) "d', "x ! y") == ['a, b (c) "d', "x! y"]
    assert on(lambda c: T.collapse_repeats(T.split_words(c)), "Si Si si", "foo a a bar", "a , a a") == [["Si"], ["foo", "a", "bar"], ["a", ",", "a"]]


def test_predicates(on):
    assert on(T.is_numeric_pointer, "12:30", "-->", "a1") == [True, True, False]
    assert on(T.is_alpha_word, "ab'c", "a1", "-") == [True, False, False]
    assert on(T.is_titlecase, "Foo", "FOO", "F", "foo", "Ébc") == [True, False, False, False, True]
    assert on(T.non_ascii_count, "aéñ", "a") == [2, 0]
    assert on(T.rhs_of_assignment, "a = b = c", "x") == ["b = c", "x"]
    assert on(T.clean_word, " ''Foo's! ") == "foo's"
    assert on(lambda c: T.spelling_category(c, ["a", "ab"])["key"], "xab", "xa", "z") == ["ab", "a", None]


def test_names_and_keys(on):
    assert on(lambda c: T.asset_url(c, "https://s/"), "a b/é+.mp3") == "https://s/a%20b/%C3%A9%2B.mp3"
    assert on(T.safe_name, "é à/b", "日") == ["e_a_b", "file"]
    assert on(lambda c: T.normalize_key(c, {"3*": "tri"}), "12'", "3'", "x") == ["12*", "tri", "x"]
    assert on(T.unescape, r"a\"b\n\\n") == 'a"b\n\\n'
    assert on(lambda c: T.trim_context(c, 3), "abcdef") == "def"
    assert on(lambda c: T.decode_bytes(F.encode(c, "ISO-8859-1")), "café") == "café"


def test_expansion(spark, on):
    keys = spark.createDataFrame([("n1", "ń"), ("n12", "ň"), ("Ab", "cd")], "key string, value string")
    texts = spark.createDataFrame([(1, "n1  ab zz\n"), (2, None)], "text_id long, text string")
    assert {r.text_id: r.text for r in expand.expand_tokens(texts, keys).collect()} == {1: "ń  cd zz\n", 2: ""}
    live = {r.token: (r.shown, r.ambiguous) for r in expand.expand_live(spark.createDataFrame([("n1",), ("n12",), ("q",)], "token string"), keys).collect()}
    assert live == {"n1": ("n1", True), "n12": ("ň", False), "q": ("q", False)}
    done = {r.token for r in expand.auto_complete(spark.createDataFrame([("n1",), ("n12",)], "token string"), keys).collect()}
    assert done == {"n12"}
    cal = spark.createDataFrame([("2024-03-05", "market")], "day string, text string").withColumn("day", F.col("day").cast("date"))
    d = spark.createDataFrame([(1, "on 5-3-2024, 5 3 2024, x5-3-2024 and 6-3-2024"), (2, None)], "text_id long, text string")
    assert {r.text_id: r.text for r in expand.expand_dates(d, cal).collect()} == {1: "on market, market, x5-3-2024 and 6-3-2024", 2: None}


def test_spans(on):
    got = on(lambda c: reshape.marker_spans(c, ["ab", "abc", "b"]), "abc xab b ab", "")
    assert [(s.start, s.end, s.found) for s in got[0]] == [(0, 3, "abc"), (8, 9, "b"), (10, 12, "ab")] and got[1] == []
