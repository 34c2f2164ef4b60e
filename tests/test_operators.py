import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, expand, generate, lexical, lookup, ngram, predict, reshape, search, segment
from textloom.operators.shared import children, shared_dir, stored


def sents(spark, *texts):
    return spark.createDataFrame([(t, t.split(), i) for i, t in enumerate(texts)], "sentence string, tokens array<string>, first_rank int").withColumn("sources", F.array()).withColumn("source_count", F.lit(0))


def reqs(spark, *texts):
    return spark.createDataFrame([(i, t.split(), t) for i, t in enumerate(texts)], "request_id long, tokens array<string>, text string")


def test_sentence_table(spark):
    rows = [("A b.", "f1", "line 2", 0, 2), ("a b", "f1", "line 1", 0, 1), ("a b", "f0", "line 9", 1, 9), (None, "f0", "line 1", 1, 1), ("License: x", "f0", "line 3", 1, 3)]
    r = spark.createDataFrame(rows, "text string, source_path string, reference string, source_rank int, unit_no long").withColumn("source_type", F.lit("txt"))
    got = corpus.sentence_table(r, phrases=["license"]).collect()
    assert len(got) == 1 and got[0].sentence == "a b" and got[0].source_count == 3 and [s.reference for s in got[0].sources] == ["line 1", "line 2", "line 9"]


def test_sources_are_counted_whole_and_listed_to_the_limit(spark):
    r = spark.createDataFrame([("a b", f"f{i % 7}", f"line {i}", 0, i, "txt") for i in range(300)] + [("c", "f", "line 1", 0, 1, "txt")], "text string, source_path string, reference string, source_rank int, unit_no long, source_type string")
    got = {x.sentence: x for x in corpus.sentence_table(r, max_sources=2).collect()}
    assert got["a b"].source_count == 300 and [(s.path, s.reference) for s in got["a b"].sources] == [("f0", "line 0"), ("f0", "line 7")] and got["c"].source_count == 1
    assert corpus.sentence_sources(r).count() == 301 and {x.sentence: x.tokens for x in corpus.distinct_sentences(r).collect()} == {"a b": ["a", "b"], "c": ["c"]}
    n = corpus.number_rows(r.repartition(5), "unit_no", "source_path").orderBy("row_id").collect()
    assert [x.row_id for x in n] == list(range(1, 302)) and [x.unit_no for x in n] == sorted(x.unit_no for x in n)


def test_the_model_of_asked_contexts_is_a_part_of_the_whole_one(spark):
    s = sents(spark, "a b c", "a b d", "b c", "x a b", "c")
    r = reqs(spark, "a b", "zz", "x a b", "")
    whole, part = ngram.combined_model(s, 3), ngram.context_model(s, 3, predict.wanted_contexts(r, 2))
    asked = {("b",), ("a", "b"), ("zz",)}
    rows = lambda m: {(x.n, tuple(x.ctx), x.next, x.cnt, x.p) for x in m.collect()}
    assert rows(part) == {x for x in rows(whole) if x[1] in asked} and len(rows(part)) > 3


def test_search_finds_any_substring(spark):
    """Queries of one character to whole sentences, over few letters and marks that patterns know, against a scan."""
    rng = random.Random(6)
    made = dict.fromkeys("".join(rng.choice(["a", "b", " ", "é", ".", "(", "\\", "😀"]) for _ in range(rng.randint(1, 30))) for _ in range(150))
    texts = [*made, "x" * 5000 + "needle" + "y" * 5000]
    s = spark.createDataFrame([(t, i, i % 7, ["p"] * (i % 5)) for i, t in enumerate(texts)], "sentence string, first_rank long, source_count int, sources array<string>")
    asked = [t[i : i + n] for t in rng.sample(texts, 40) for i, n in [(rng.randint(0, len(t) - 1), rng.choice([1, 2, 3, 4, 9, 40]))]] + ["", None, "zzz", "a", "needle", "é", "😀", "()", texts[3]]
    want = set()
    for i, q in enumerate(asked):
        found = [(t != q, k, t) for k, t in enumerate(texts) if q and q in t]
        want |= {(i, t, not odd, r + 1, k % 7, min(k % 5, 2)) for r, (odd, k, t) in enumerate(sorted(found)[:6])}
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    small = search.BUCKET_ROWS
    try:
        search.BUCKET_ROWS = 500
        many = search.SubstringIndex.build(s)
    finally:
        search.BUCKET_ROWS = small
    assert many.buckets > 5
    for out in (search.search_corpus(q, s, 6, 2), many.search(q, 6, 2)):
        assert {(r.query_id, r.sentence, r.is_exact, r["rank"], r.source_count, len(r.sources)) for r in out.collect()} == want
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    read = many._read("postings", "sid long, gram string", search._asked(q.where("query = 'needle'")))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert read.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1)).distinct().count() <= 4
    assert search.search_corpus(q.limit(0), s).isEmpty() and many.search(q.limit(0)).isEmpty()


def texts_of(spark, f, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "token string")
    return {r.token: (r.x, r.end) for r in f(df.withColumn("x", F.col("token"))).collect()}


def test_expansions_come_to_their_end(spark):
    long = [(f"<{i}>", f"<{i + 1}>") for i in range(40)]
    ring = [("k1", "k2"), ("k2", "k3"), ("k3", "k1")]
    assert texts_of(spark, lambda d: expand.compose(d, long, "x"), "a<0>b<0>", "é<0>", None) == {"a<0>b<0>": ("a<40>b<40>", "stable"), "é<0>": ("é<0>", "stable"), None: (None, "stable")}
    got = texts_of(spark, lambda d: expand.compose(d, ring, "x"), "ak1", "y")
    assert got["ak1"][1] == "cycle" and got["ak1"][0] in ("ak1", "ak2", "ak3") and got["y"] == ("y", "stable")
    got = texts_of(spark, lambda d: expand.compose(d, [("a", "ba")], "x"), "a", "b")
    assert got["a"][1] == "growing" and got["a"][0].endswith("ba") and got["b"] == ("b", "stable")
    assert texts_of(spark, lambda d: expand.compose(d, [("aa", "b"), ("bb", "c")], "x"), "aaaa", "éaa") == {"aaaa": ("c", "stable"), "éaa": ("éaa", "stable")}
    words = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    assert texts_of(spark, lambda d: expand.expand_phrases(d, words, "x"), "w0 and w7, w20w1") == {"w0 and w7, w20w1": ("w20 and w20, w20w1", "stable")}
    assert texts_of(spark, lambda d: expand.expand_phrases(d, [("of the", "o'the"), ("o'the and", "o&")], "x"), "of the and of the", "oof the") == {"of the and of the": ("o& o'the", "stable"), "oof the": ("oof the", "stable")}
    assert texts_of(spark, lambda d: expand.finalize(d, [("o3", "ō")], "x"), "ntoho3", "x") == {"ntoho3": ("ntohō", "stable"), "x": ("x", "stable")}
    got = texts_of(spark, lambda d: expand.finalize(d, [("ing", "in"), ("in", "ing")], "x"), "ping", "y")
    assert got["ping"][1] == "cycle" and got["y"] == ("y", "stable")


def test_types_say_how_they_were_expanded(spark):
    keys = spark.createDataFrame([("x1", "y2"), ("p1", "q1"), ("q1", "p1")], "key string, value string")
    types = {r.token: (r.expanded, r.how, r.stable, r.end) for r in expand.expand_types(spark.createDataFrame([("x1",), ("X1",), ("ap1",), ("y",)], "token string"), keys).collect()}
    assert types["x1"] == ("y2", "exact", True, "stable") and types["X1"] == ("y2", "folded", True, "stable") and types["y"] == ("y", "none", True, "stable")
    assert types["ap1"][2:] == (False, "cycle")


def test_relative_dates(spark):
    import datetime

    keys = spark.createDataFrame([("now", "taken")], "key string, value string")
    aliases = spark.createDataFrame([("Tom", 1, "next day"), ("now", 0, None), ("tod", 0, None), ("far", 90, None), ("yes", -1, "the day before")], "token string, offset_days int, intro string")
    calendar = spark.createDataFrame([(datetime.date(2024, 2, 28 + i), t) for i, t in enumerate(["market a", "market b"])] + [(datetime.date(2024, 2, 27), "quiet")], "day date, text string")
    got = {r.key: r.value for r in expand.dated_shortcuts(keys, aliases, calendar, datetime.date(2024, 2, 28), "market").collect()}
    assert got == {"now": "taken", "tod": "market a", "tom": "next day b", "yes": "the day before, quiet"}


def test_long_prefixes_and_repeated_months(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    keys = spark.createDataFrame([(long, "1"), (long[:20], "2")], "key string, value string")
    assert [r.key for r in lookup.prefix_hints(spark.createDataFrame([(long[:18],)], "prefix string"), keys).orderBy("rank").collect()] == [long[:20], long]
    import datetime

    months = spark.createDataFrame([(m, f"m{m}") for m in range(1, 13)] * 3 + [(13, "x"), (None, "y")], "month_no int, name string")
    days = spark.createDataFrame([(datetime.date(2024, 12, 5), "thu")], "day date, day_name string")
    assert [r.text for r in lookup.calendar_phrase(days, months, "On").collect()] == ["On thu (Thursday) 5 m12 2024"]


def test_overlapping_quotas_take_in_turn(spark):
    items = spark.createDataFrame([(i, "ab") for i in range(3)], "item_id long, name string")
    assert [(r.quota, r.rank, r.item_id) for r in reshape.take_quota(items, [("ab", 1), ("a", 2)]).orderBy("item_id").collect()] == [(0, 1, 0), (1, 1, 1), (1, 2, 2)]


def test_filtered_records_keep_their_provenance(spark):
    lex = spark.createDataFrame([("en", "house", 5.0), ("target", "mba", 0.0)], "lang string, word string, zipf double")
    rows = [("house mba", "f", "txt", "line 1", 0, 1), ("house", "f", "txt", "line 2", 0, 2), ("mba", "f", "srt", "subtitle 1", 1, 1)]
    r = spark.createDataFrame(rows, "text string, source_path string, source_type string, reference string, source_rank int, unit_no long")
    got = segment.filter_records(r, lex)
    assert got.columns == r.columns and {(x.text, x.source_type, x.reference) for x in got.collect()} == {("mba", "txt", "line 1"), ("mba", "srt", "subtitle 1")}


def test_ngrams_sum_to_one_and_count_all_windows(spark):
    s = sents(spark, "a b a", "a", "c a b")
    m = ngram.combined_model(s, 4)
    totals = m.groupBy("n", "ctx").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in totals)
    by_n = {r.n: r.c for r in m.groupBy("n").agg(F.sum("cnt").alias("c")).collect()}
    assert by_n == {n: sum(len(t) + n - 1 for t in (["a"] * 3, ["a"], ["a"] * 3)) for n in (2, 3, 4)}
    assert m.where("n = 2 and ctx = array('a')").where("next = 'b'").first().cnt == 2
    assert ngram.combined_model(s.limit(0), 3).count() == 0


def test_suggest(spark):
    s = sents(spark, *["x y p"] * 3, "x y q", "z y r", "n b")
    m = ngram.combined_model(s, 3)
    longest = predict.longest_match(reqs(spark, "x y", "u y", "u v", ""), m, 2).collect()
    assert {(r.request_id, r.k) for r in longest} == {(0, 2), (1, 1)}
    scores = {r.word: r.score for r in predict.interpolated(reqs(spark, "x y"), m, 2).collect()}
    assert scores == {"p": pytest.approx(0.55 * 0.75 + 0.45 * 0.6), "q": pytest.approx(0.55 * 0.25 + 0.45 * 0.2), "r": pytest.approx(0.45 * 0.2)}
    assert [r.word for r in predict.suggest(reqs(spark, "n"), m).collect()] == []  # the lone pair is dropped
    merged = spark.createDataFrame([(0, "Si", 0.25), (0, "si", 0.25), (0, "sí", 0.5), (0, "!", 0.9)], "request_id long, word string, score double")
    ranked = predict.ranked(predict.hygiene(predict.display_merge(merged), reqs(spark, "a")), 5).orderBy("rank").collect()
    assert [(r.word, r.score) for r in ranked] == [("sí", 0.5), ("si", 0.5)]


def test_fallback_takes_the_first_attempt_with_rows(spark):
    m = ngram.combined_model(sents(spark, "a b", "c d"), 2)
    r = spark.createDataFrame([(0, ["zz"], ["a"]), (1, ["c"], ["a"])], "request_id long, v0 array<string>, v1 array<string>")
    assert {(x.request_id, x.attempt, x.word) for x in predict.match_with_fallback(r, m, 1, ["v0", "v1"]).collect()} == {(0, 1, "b"), (1, 0, "d")}


def test_generate(spark):
    s = sents(spark, "a b c", "a b c", "a d")
    m = stored(ngram.combined_model(s, 3))
    g = generate.flag_known(generate.generate(reqs(spark, "a", "nope"), m, temperature=0.0), s)
    assert {(r.request_id, r.text, r.status) for r in g.collect()} == {(0, "a b c", "original"), (1, "nope", "not_in_corpus")}
    one = generate.candidates(reqs(spark, "a"), m, k=2, temperature=1.0, seed=1).orderBy("rank").collect()
    assert one == generate.candidates(reqs(spark, "a"), m, k=2, temperature=1.0, seed=1).orderBy("rank").collect() and {r.text for r in one} <= {"a b c", "a d"}
    drawn = generate.generate(reqs(spark, "a"), m, temperature=1.0, tries=300)
    assert abs(drawn.where("text = 'a d'").count() / 300 - 1 / 3) < 0.1


def test_steps_read_the_buckets_asked_for(spark, monkeypatch):
    """The model is ten times as large, a step's buckets hold as many rows."""
    read = []
    for size in (2_000, 20_000):
        monkeypatch.setattr(generate, "BUCKET_ROWS", 100)
        words = spark.range(size).selectExpr("2 as n", "array(concat('w', id)) as ctx", "concat('w', id + 1) as next", "1 as cnt", "1.0D as p")
        m = generate.BucketedModel.build(words)
        assert m.buckets == size // 100
        asked = m.asked(spark.createDataFrame([(["w5"],), (["w77"],)], "ctx array<string>"))
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
        read.append(asked.count())
        g = generate.generate(reqs(spark, "w5", "w77 w78", "none"), m, max_ctx=2, max_tokens=6, temperature=0.0)
        assert {(r.text, r.status) for r in g.collect()} == {("w5 w6 w7 w8 w9 w10", "generated"), ("w77 w78 w79 w80 w81 w82", "generated"), ("none", "not_in_corpus")}
    assert read[1] < 2 * read[0] < 1000


def test_search_and_concordance(spark):
    s = sents(spark, "of the sea", "sea", "the sea of", "x the sea of the sea")
    q = spark.createDataFrame([(1, "sea"), (2, ""), (3, None)], "query_id long, query string")
    hits = search.search_corpus(q, s, limit=3).orderBy("rank").collect()
    assert [(h.sentence, h.is_exact) for h in hits] == [("sea", True), ("of the sea", False), ("the sea of", False)]
    c = sorted((r.sentence, r.pos, r.prev, r.next, r.left, r.right) for r in search.concordance(s, ["the", "sea"], 1).where("sentence like 'x%'").collect())
    assert c == [("x the sea of the sea", 2, "x", "of", "x", "of"), ("x the sea of the sea", 5, "of", None, "of", "")]
    n = {(r.side, r.token): r.cnt for r in search.neighbour_counts(s, ["the", "sea"]).collect()}
    assert n == {("prev", "of"): 2, ("prev", "x"): 1, ("next", "of"): 2}


def test_lexical(spark):
    s = sents(spark, "k = a b", "--> 12", "a 3")
    c = lexical.word_counts(lexical.lexical_tokens(s, spark.createDataFrame([("B",)], "word string")))
    assert {(r.word, r.cnt) for r in c.collect()} == {("a", 2)}
    assert lexical.lexical_summary(c).first().asDict() == {"total_tokens": 2, "total_alpha_tokens": 2, "distinct_words": 1, "distinct_alpha_words": 1}
    assert lexical.lexical_summary(c.limit(0)).first().total_tokens == 0


def smooth_by_hand(labels, can):
    out = list(labels)
    for i, lab in enumerate(out):
        if lab == segment.OTHER and can[i]:
            near = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(out) and out[j] == segment.PUNCT:
                    j += step
                near.append(out[j] if 0 <= j < len(out) else None)
            if segment.TARGET in near:
                out[i] = segment.TARGET
    return out


def test_smoothing_equals_a_pass_from_the_left(spark):
    rng, rows, want = random.Random(1), [], {}
    for line in range(400):
        labels = [rng.choice([segment.OTHER, segment.OTHER, segment.TARGET, segment.EN, segment.PUNCT]) for _ in range(rng.randrange(1, 9))]
        can = [rng.random() < 0.8 for _ in labels]
        rows += [(line, i, "é" if c else "e", lab, "é" if c else "e", 0.0, 0.0) for i, (lab, c) in enumerate(zip(labels, can))]
        want[line] = smooth_by_hand(labels, can)
    df = spark.createDataFrame(rows, "line_id long, pos int, token string, label string, core string, en_zipf double, fr_zipf double")
    got = {}
    for r in segment.smooth_labels(df).orderBy("line_id", "pos").collect():
        got.setdefault(r.line_id, []).append(r.label)
    assert got == want


def test_segmentation(spark):
    lex = spark.createDataFrame([("en", "house", 5.0), ("en", "the", 7.0), ("fr", "maison", 5.0), ("fr", "parler", 4.0), ("fr", "table", 4.0), ("en", "table", 4.9), ("target", "mba", 0.0)], "lang string, word string, zipf double")
    cfg = segment.Settings(stop_en=["of"], stop_fr=["le"], protected=["ok"])
    words = ["mba", "House", "maison", "l'maison", "ŋga", "of", "le", "parlait", "table", "ok", "Zorro", "zorro", ",", "k'a", "natation"]
    got = {r.token: r.label for r in segment.classify_types(spark.createDataFrame([(w,) for w in words], "token string"), lex, cfg).collect()}
    t, en, fr = segment.TARGET, segment.EN, segment.FR
    assert got == {"mba": t, "House": en, "maison": fr, "l'maison": fr, "ŋga": t, "of": en, "le": fr, "parlait": fr, "table": en, "ok": t, "Zorro": segment.OTHER, "zorro": t, ",": segment.PUNCT, "k'a": t, "natation": fr}
    lines = spark.createDataFrame([(1, "the house, mba mba ŋga! maison"), (2, "house"), (3, None)], "line_id long, text string")
    spans = segment.merge_spans(segment.smooth_labels(segment.label_tokens(lines, lex, cfg))).orderBy("line_id", "span_no").collect()
    assert [(s.line_id, s.language, s.text) for s in spans] == [(1, en, "the house,"), (1, t, "mba mba ŋga!"), (1, fr, "maison"), (2, en, "house")]
    assert {(r.line_id, r.text) for r in segment.keep_language(lines, lex, cfg).collect()} == {(1, "mba ŋga!")}
    rep = {r.line_id: r for r in segment.segment_report(lines, lex, cfg).collect()}
    assert rep[1][segment.FR] == ["maison"] and rep[2][segment.TARGET] == [] and rep[1].target_only == "mba ŋga!"
    assert {r.word for r in segment.expand_lexicon(spark.createDataFrame([('"Foo bar"',)], "word string")).collect()} >= {"bar", "foo"}


def test_line_filter(spark):
    lines = ["the house : mba ŋga", "mba : ŋga", "the mba, le ŋ.", "the house", None, "mba ?! : the", "mba:, ŋ", "x ( mba"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, text string")
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {r.line_id: r.text for r in segment.keep_words_v1(df, words("mba", "", None, "mba"), words("the", "le"), "ŋga").collect()}
    assert got == {0: "mba ŋga", 1: "mba : ŋga", 2: "mba, ŋ.", 5: "mba ?!", 6: "mba, ŋ", 7: "( mba"} or got == {0: "mba ŋga", 1: "mba : ŋga", 2: "mba, ŋ.", 5: "mba ?!", 6: "mba, ŋ", 7: "( mba", 3: "x"}


def test_line_filter_with_a_large_lexicon(spark):
    """500,000 words, beyond what is broadcast: the same lines stay as with the words that occur."""
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["w17", "W400001", "foo,", "the", "9", "w999999", ":", "x!"]) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    big = spark.range(500_000).selectExpr("concat('w', id) as word")
    few = spark.createDataFrame([("w17",), ("w400001",)], "word string")
    run = lambda lex: {(r.line_id, r.text) for r in segment.keep_words_v1(df, lex, stop, "").collect()}
    assert run(big) == run(few) and len(run(few)) > 20


def test_lookups(spark):
    a = spark.createDataFrame([("ba", "1"), ("bá", "2"), ("bà", "3")], "word string, asset_id string")
    w = spark.createDataFrame([("bà",), ("bá",), ("bâ",), ("kò",)], "word string")
    assert {r.word: r.asset_id for r in lookup.lookup_asset(w, a).collect()} == {"bà": "3", "bá": "2", "bâ": None, "kò": None}
    assert [(r.canon, r.n) for r in lookup.canonical_conflicts(a).collect()] == [("ba", 2)]
    assert {r.word for r in lookup.exclude_assets(a, spark.createDataFrame([("bà",)], "word string")).collect()} == {"bá"}
    layers = spark.createDataFrame([(1, "a?", "x", False), (1, "b", "y", False), (2, "b", "z", False), (2, "a", None, True), (3, "c", "q", False)], "layer int, key string, value string, removed boolean")
    assert {(r.key, r.value) for r in lookup.overlay(layers).collect()} == {("b", "z"), ("c", "q")}
    keys = spark.createDataFrame([("ab", "1"), ("abc", "2"), ("Abd", "3"), ("abc?", "4"), ("x?", "5")], "key string, value string")
    hints = lookup.prefix_hints(spark.createDataFrame([("ab",)], "prefix string"), keys).orderBy("rank").collect()
    assert [r.key for r in hints] == ["abc", "Abd"]
    assert {r.key for r in lookup.ambiguous_keys(keys).collect()} == {"ab", "abc"}
    assert {r.key for r in lookup.optional_aliases(keys).collect()} == {"ab", "abc", "Abd", "abc?", "x?", "x"}


def test_reshape(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, None, [])], "id long, l array<string>, r array<string>")
    assert sorted((r.id, r.row_no, r.l, r.r) for r in reshape.zip_lists(d, ["l", "r"], ["id"]).collect()) == [(1, 1, "a", "x"), (1, 2, "b", "—"), (2, 1, "—", "—")]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(["ab", "a", "ac", "b"])], "item_id long, name string")
    assert sorted(r.name for r in reshape.take_quota(items, [("a", 2), ("ab", 1), ("b", 1)]).collect()) == ["a", "ab", "b"]
    n = corpus.number_rows(items, "name").orderBy("row_id").collect()
    assert [(r.name, r.row_id) for r in n] == [("a", 1), ("ab", 2), ("ac", 3), ("b", 4)]


def test_patterns_claim_their_places_in_turn(spark):
    def plain(text, patterns):
        taken, out = set(), []
        for p in sorted(set(patterns) - {""}, key=lambda p: (-len(p), p)):
            for i in range(len(text) - len(p) + 1):
                at = set(range(i, i + len(p)))
                if text[i : i + len(p)] == p and not at & taken:
                    taken |= at
                    out.append((i, i + len(p), p))
        return sorted(out)

    rng = random.Random(5)
    texts = ["ab cde", "", None, "aaaaa", "é😀ab", *["".join(rng.choice("ab é") for _ in range(rng.randint(0, 60))) for _ in range(80)]]
    for patterns in (["b cde", "ab"], ["aa", "ab", "ba", "aab", "é ", ""], [], ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 5))) for _ in range(200)]):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("text", reshape.claimed_spans(F.col("text"), patterns).alias("s"))
        for r in df.collect():
            assert (r.s is None) if r.text is None else [(x.start, x.end, x.found) for x in r.s] == plain(r.text, patterns)
    assert reshape.with_stripped(["mɑ̀", "ab"]) == ["mɑ̀", "ab", "mɑ"]


def test_thousands_of_patterns(spark):
    patterns = [f"k{i}x" for i in range(5000)]
    text = " ".join(f"k{i % 7000}x" for i in range(100_000))
    got = spark.createDataFrame([(text,)], "text string").select(F.size(reshape.claimed_spans(F.col("text"), patterns))).first()[0]
    assert got == sum(i % 7000 < 5000 for i in range(100_000))


def test_quotas_equal_taking_in_turn(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(names)), "item_id long, name string")
    for quotas in ([("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))), rng.randint(0, 12)) for _ in range(40)], [("zz", 3)], [("a", 0), ("", 500)]):
        left, want = list(enumerate(names)), []
        for q, (p, n) in enumerate(quotas):
            took = [x for x in left if x[1].startswith(p)][:n]
            left = [x for x in left if x not in took]
            want += [(q, r + 1, i) for r, (i, _) in enumerate(took)]
        assert sorted((r.quota, r["rank"], r.item_id) for r in reshape.take_quota(items, quotas).collect()) == sorted(want)


def test_a_thousand_quotas_take_few_jobs(spark):
    items = spark.range(20_000).selectExpr("id as item_id", "lpad(cast(id % 1000 as string), 3, '0') as name")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quotas", "quotas")
    got = reshape.take_quota(items, [(f"{i:03d}", 2) for i in range(1000)]).count()
    assert got == 2000 and len(status.getJobIdsForGroup("quotas")) < 60


def test_missing_keys_by_bits(spark):
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 200):
        required = [f"k{i}" for i in range(n)]
        rows = [(rng.choice(["a", "b", None]), rng.choice([*required, "other", None])) for _ in range(150)] + [("none", "other")]
        have = {}
        for e, k in rows:
            have.setdefault(e, set()).add(k)
        want = {(e, k) for e, ks in have.items() for k in required if k not in ks}
        req = spark.createDataFrame([(k,) for k in [*required, *required[:3], None]], "k string")
        out = reshape.missing_keys(spark.createDataFrame(rows, "e string, k string"), req, "e", "k")
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
        assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_models_shuffle_a_row_a_place_and_store_no_copy(spark):
    """Orders 2 to 5 equal plain counts, for sentences of any length; grams beyond the first words are shuffled once; no
    model is stored to count or to choose from."""
    rng = random.Random(3)
    said = [[rng.choice("abc") for _ in range(rng.randrange(0, 7))] for _ in range(80)] + [["a", "x\ny", "a", "", "b"], ["", ""], ["\n"], ["a", "b", "", "c"]]
    s = spark.createDataFrame([(" ".join(t), t) for t in said], "sentence string, tokens array<string>").repartition(3)
    for low, high in [(2, 5), (2, 4), (2, 2), (3, 3), (5, 5)]:
        grams = Counter()
        for t in said:
            for n in range(low, high + 1) if t else ():
                p = [None] * (n - 1) + t + [None] * (n - 1)
                grams.update((n, tuple(p[i : i + n - 1]), p[i + n - 1]) for i in range(len(t) + n - 1))
        total = Counter()
        for (n, ctx, _), c in grams.items():
            total[n, ctx] += c
        m = ngram.combined_model(s, high) if low == 2 else ngram.ngram_model(s, low)
        assert {(r.n, tuple(r.ctx), r.next): (r.cnt, r.p) for r in m.collect()} == {g: (c, c / total[g[:2]]) for g, c in grams.items()}
        assert m.count() == len(grams) and (low > 2 or sum(grams.values()) == ngram.gram_number(s, high))
    counts = ngram._keyed_counts(s, range(2, 6))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan(counts).count("Exchange hashpartitioning(") == plan(counts.groupBy("k", "n", "ctx").count()).count("Exchange hashpartitioning(") == 1
    folder = shared_dir(spark)
    before = set(children(spark, folder))
    m = ngram.combined_model(s, 4)
    assert sorted(ngram.coverage(s, 4).collect()) == sorted(ngram.model_coverage(m).collect())
    for seed in (["a", "b"], ["zz"], ["zz", "c"]):
        assert ngram.order_for(s, seed, 4).collect() == ngram.choose_order(m, seed).collect()
    b = generate.BucketedModel.build(ngram.combined_model(s, 3), most=ngram.gram_number(s, 3))
    assert not [x for x in set(children(spark, folder)) - before if x.startswith("stored-")]
    assert ("a",) in {tuple(r.ctx) for r in b.asked(spark.createDataFrame([(["a"],), (["zz"],)], "ctx array<string>")).collect()}


def test_an_index_holds_grams_of_distinct_words_only(spark):
    """Two hundred sentences of two words have no more postings than those words have grams."""
    s = spark.createDataFrame([(f"alpha beta {'gamma ' * i}end", i, 1, ["p"]) for i in range(200)], "sentence string, first_rank long, source_count int, sources array<string>")
    index = search.SubstringIndex.build(s)
    words = ["alpha", "beta", "gamma", "end", " "]
    assert spark.read.parquet(f"{index.path}/postings").count() == sum(len({w[i : i + k] for i in range(len(w) - k + 1)}) for w in words for k in (1, 2, 3))
    q = spark.createDataFrame([(1, "a"), (2, "ta ga"), (3, " "), (4, "beta end"), (5, "a"), (6, "gamma gamma en")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): r.sentence.count("gamma") for r in index.search(q, 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (2, 1): 1, (2, 2): 2, (3, 1): 0, (3, 2): 1, (4, 1): 0, (5, 1): 0, (5, 2): 1, (6, 1): 2, (6, 2): 3}
