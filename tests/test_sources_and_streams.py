import os
import random
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import corpus, ngram, segment
from textloom.sources import docx as docx_source
from textloom.sources import readers, writers
from textloom.streaming import streams


def docx(path, paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def test_readers(spark, tmp_path):
    d = tmp_path / "src" / "nested"
    d.mkdir(parents=True)
    (tmp_path / "src" / "a.txt").write_bytes("﻿one\n\n two \n".encode() + b"\xff three")
    (tmp_path / "src" / "~$b.txt").write_text("never")
    (d / "s.srt").write_text("1\n00:00 --> 00:01\nhello\nthere\n\n2\n00:02 --> 00:03\n\n3\n00:03 --> 00:04\nbye\n")
    docx(d / "w.docx", ["p1", "", "p3"])
    (d / "bad.docx").write_text("no zip")
    got = sorted((r.text, r.source_type, r.reference, r.source_rank) for r in readers.read_corpus(spark, [f"{tmp_path}/none", f"{tmp_path}/src"]).collect())
    assert got == [(" three", "txt", "line 4", 1), (" two ", "txt", "line 3", 1), ("bye", "srt", "subtitle 2", 1), ("hello there", "srt", "subtitle 1", 1), ("one", "txt", "line 1", 1), ("p1", "docx", "paragraph 1", 1), ("p3", "docx", "paragraph 3", 1)]
    assert readers.read_corpus(spark, []).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    """Ranges of 300 bytes over files of any line end: numbers as in the whole file, blank lines counted."""
    rng = random.Random(4)
    want = set()
    for k, end in enumerate(["\n", "\r\n", "\r", "\n"]):
        lines = [rng.choice(["", " ", "é" * rng.randint(1, 400), f"line {i}", "x" * rng.randint(1, 90)]) for i in range(200)]
        (tmp_path / f"{k}.txt").write_bytes((("\ufeff" if k == 1 else "") + end.join(lines) + (end if k == 3 else "")).encode())
        want |= {(f"{k}.txt", f"line {i + 1}", t) for i, t in enumerate(lines) if t.strip()}
    (tmp_path / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        rows = readers.read_lines(spark, str(tmp_path))
        assert {(r.source_path.rpartition("/")[2], r.reference, r.text) for r in rows.collect()} == want
        assert readers.numbered_lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_word_documents(spark, tmp_path):
    rows = [("a b/c", "one\n\n two <&> \x01three\t\nend"), ("empty", ""), ("none", None), ("long", "\n".join(f"p {i}" for i in range(25_000)))]
    out = f"{tmp_path}/out"
    docx_source.write_documents(spark.createDataFrame(rows, "name string, text string"), out)
    got = readers.read_docx(spark, out).collect()
    assert {(docx_source.document_name(r.source_path), r.reference, r.text) for r in got if "long" not in r.source_path} == {("a b/c", "paragraph 1", "one"), ("a b/c", "paragraph 3", "two <&> three"), ("a b/c", "paragraph 4", "end")}
    assert len(got) == 25_003 and {r.unit_no for r in got if "long" in r.source_path} == set(range(1, 25_001))
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    nested = f'<w:document xmlns:w="{w}"><w:body><w:p><w:t>a</w:t><w:txbx><w:p><w:t>b</w:t></w:p></w:txbx><w:t>c</w:t></w:p><w:p/><w:p><w:t>d</w:t></w:p></w:body></w:document>'
    for name, xml in (("nested", nested), ("cut", nested[:-30])):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", xml)
    (tmp_path / "short.docx").write_bytes((tmp_path / "nested.docx").read_bytes()[:60])
    whole = readers._records(readers._whole(spark, str(tmp_path), "*.docx").mapInArrow(readers._from_bytes, docx_source.SCHEMA), "paragraph ", "docx", 0)
    for rows in (readers.read_docx(spark, str(tmp_path)), whole):
        assert {(r.reference, r.text) for r in rows.where("source_path like '%nested%'").collect()} == {("paragraph 1", "abc"), ("paragraph 2", "b"), ("paragraph 4", "d")}
        assert rows.where("source_path like '%cut%' or source_path like '%short%'").isEmpty() and rows.count() == 25_006
    assert docx_source.DocxReader({"path": out}).partitions()[0].names and readers.read_docx(spark, f"{tmp_path}/missing").isEmpty()


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿word,asset_id\na,1\na,2\n,3\nb,4\n")
    assert {(r.word, r.asset_id) for r in readers.read_asset_map(spark, f"{tmp_path}/m.csv").collect()} == {("a", "2"), ("b", "4")}
    (tmp_path / "m.ts").write_text('x = {"k\\"1": "v1", "b": "2",\n"b": "3"}')
    assert {(r.word, r.asset_id) for r in readers.read_asset_map(spark, f"{tmp_path}/m.ts", text=True).collect()} == {('k"1', "v1"), ("b", "3")}
    (tmp_path / "l.csv").write_text("x,audio_file,z\n1,foo,q\n2,,r\n")
    assert {r.word for r in readers.read_lexicon(spark, f"{tmp_path}/l.csv").collect()} == {"foo"}
    (tmp_path / "k.json").write_text('{"a b": "1", "c": "2"}')
    assert {(r.key, r.kind) for r in readers.read_key_values(spark, f"{tmp_path}/k.json").collect()} == {("a b", "phrase"), ("c", "token")}
    (tmp_path / "s.txt").write_text("key\tvalue\n# note\na\tb c\nd=>e\nf=g\n!gone\nbroken\n")
    good, bad = readers.read_shortcuts(spark, f"{tmp_path}/s.txt")
    assert [(r.key, r.value, r.removed) for r in good.orderBy("row_no").collect()] == [("a", "b c", False), ("d", "e", False), ("f", "g", False), ("gone", None, True)]
    assert [r.line for r in bad.collect()] == ["broken"]
    writers.write_shortcuts(good, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a\tb c", "d\te", "f\tg", "!gone"]
    (tmp_path / "v.json").write_text('[{"verb": "x", "french_trans": ["a", "b"]}, {"verb": "y", "translated_verb": "t"}, {"verb": "z"}]')
    assert {r.verb: r.gloss for r in readers.read_verbs(spark, f"{tmp_path}/v.json").collect()} == {"x": "a, b", "y": "t", "z": "—"}
    (tmp_path / "sheet.csv").write_text("k,v\na,1\nb,\na,2\n")
    rows, twice = readers.read_sheet(spark, f"{tmp_path}/sheet.csv", "k", "v")
    assert [(r.key, r.value) for r in rows.collect()] == [("a", "2")] and [(r.key, r.rows) for r in twice.collect()] == [("a", [2, 4])]


def test_model_round_trip_and_exports(spark, tmp_path):
    s = spark.createDataFrame([("b a", ["b", "a"])], "sentence string, tokens array<string>")
    m = ngram.combined_model(s, 3)
    writers.save_model(m, f"{tmp_path}/m")
    assert readers.load_model(spark, f"{tmp_path}/m", 2).count() == m.where("n = 2").count()
    source = F.array(F.struct(F.lit("f").alias("path"), F.lit("txt").alias("type"), F.lit("line 1").alias("reference")))
    s = s.withColumn("sources", source).withColumn("source_count", F.lit(1))
    for f, rows in ((writers.export_sources, corpus.source_rows(s)), (writers.export_unique, s), (writers.export_document, corpus.source_rows(s))):
        f(rows, f"{tmp_path}/{f.__name__}")
        assert spark.read.text(f"{tmp_path}/{f.__name__}").count() >= 1
    writers.write_lines(s.select(F.col("sentence").alias("value")), f"{tmp_path}/bom", bom=True)
    part = next((tmp_path / "bom").glob("part-*"))
    assert part.read_bytes() == "﻿b a\n".encode()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("the house mba ŋga\nthe house\nmba ŋga\nmba ŋga\n")
    lex = spark.createDataFrame([("en", "house", 5.0), ("en", "the", 7.0), ("target", "mba", 0.0)], "lang string, word string, zipf double")
    streams.stream_keep_language(spark, str(src), f"{tmp_path}/kept", f"{tmp_path}/c1", lex).awaitTermination(120)
    assert [r.value for r in spark.read.text(f"{tmp_path}/kept").select("value").collect()] == ["mba ŋga"] * 3
    streams.stream_ngram_counts(spark, str(src), f"{tmp_path}/counts", f"{tmp_path}/c2", 2).awaitTermination(120)
    (src / "2.txt").write_text("the sea\n")
    streams.stream_ngram_counts(spark, str(src), f"{tmp_path}/counts", f"{tmp_path}/c2", 2).awaitTermination(120)
    m = {r.next: r.p for r in streams.read_counts(spark, f"{tmp_path}/counts").where("ctx = array('the')").collect()}
    assert m == {"house": 2 / 3, "sea": 1 / 3}
    (tmp_path / "req").mkdir()
    (tmp_path / "req" / "r.json").write_text('{"request_id": 1, "text": "The"}')
    r = spark.readStream.schema("request_id long, text string").json(str(tmp_path / "req"))
    streams.stream_suggest(r, streams.read_counts(spark, f"{tmp_path}/counts"), f"{tmp_path}/sug", f"{tmp_path}/c3").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/sug").where("rank = 1").first().word == "house"


def test_counts_are_merged_in_levels(spark, tmp_path):
    """Forty batches: few folders, equal sums; batches tried again and a merge cut off change nothing."""
    store, want = streams.CountStore(spark, f"{tmp_path}/counts"), Counter()
    rng = random.Random(1)
    for batch in range(40):
        rows = [(2, [rng.choice("abc")], rng.choice(["x", "y", None]), rng.randint(1, 9)) for _ in range(5)]
        counts = spark.createDataFrame(rows, streams.COUNTS).groupBy("n", "ctx", "next").agg(F.sum("cnt").alias("cnt")).coalesce(1)
        store.add(counts, batch)
        for n, ctx, nxt, c in rows:
            want[n, ctx[0], nxt] += c
        if batch % 7 == 3:  # as after a failure between the write and the stream's commit
            store.add(counts, batch)
    read = lambda: {(r.n, r.ctx[0], r.next): r.cnt for r in store.read().collect()}
    assert read() == want and len(store.runs()[0]) <= 9
    spark.createDataFrame([(2, ["a"], "x", 999)], streams.COUNTS).write.parquet(f"{tmp_path}/counts/run-5-0-63")
    (tmp_path / "counts" / "run-5-0-63" / "_SUCCESS").unlink()
    assert read() == want
    assert streams.CountStore(spark, f"{tmp_path}/none").read().isEmpty()


def test_changed_sources_are_counted_anew(spark, tmp_path):
    src, dst = tmp_path / "src", f"{tmp_path}/dst"
    src.mkdir()

    def put(name, text, time):
        (src / name).write_text(text)
        os.utime(src / name, (time, time))

    def built():
        whole = ngram.ngram_counts(spark.read.text(str(src)).select(F.split("value", " ").alias("tokens")), range(2, 3))
        return {(tuple(r.ctx), r.next, r.cnt) for r in whole.collect()}

    def counts(path):
        return {(tuple(r.ctx), r.next, r.cnt) for r in streams.CountStore(spark, f"{path}/counts").read().collect()}

    for i in range(6):
        put(f"{i}.txt", f"a b {i}\na c\n", 1_700_000_000 + i)
    assert streams.update_counts(spark, str(src), dst, 2, files_per_batch=1).endswith("gen-0") and counts(f"{dst}/gen-0") == built()
    assert len(streams.CountStore(spark, f"{dst}/gen-0/counts").runs()[0]) == 3
    put("new.txt", "a b\n", 1_700_000_100)
    assert streams.update_counts(spark, str(src), dst, 2).endswith("gen-0") and counts(f"{dst}/gen-0") == built()
    put("3.txt", "z z\n", 1_700_000_200)
    (src / "4.txt").unlink()
    assert {(r.file.rpartition("/")[2], r.why) for r in streams.stale_counts(spark, str(src), f"{dst}/gen-0").collect()} == {("3.txt", "changed"), ("4.txt", "gone")}
    assert streams.update_counts(spark, str(src), dst, 2).endswith("gen-1") and counts(f"{dst}/gen-1") == built()


def test_stale_models_are_built_again(spark, tmp_path):
    path, src = f"{tmp_path}/model", tmp_path / "s.txt"
    s = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    src.write_text("a b")
    old = 1_600_000_000
    os.utime(src, (old, old))
    stale = lambda: streams.stale_model(spark, path, [str(src), f"{tmp_path}/none"])
    assert stale() == "missing"
    assert streams.current_model(spark, path, [str(src)], lambda: ngram.combined_model(s, 3)).count() > 0 and stale() is None
    os.utime(src)
    os.utime(src, (2_000_000_000, 2_000_000_000))
    assert stale() == f"older than {src}"
    os.utime(src, (old, old))
    writers.save_model(ngram.ngram_model(s, 3), path)
    assert stale() == "no short contexts"
    writers.save_model(ngram.ngram_model(s, 2), path)
    assert stale() is None
    next((tmp_path / "model").glob("n=2/*.parquet")).write_bytes(b"PAR1 no")
    for crc in (tmp_path / "model").glob("n=2/.*.crc"):
        crc.unlink()
    assert stale() == "broken"


def debounced(spark, tmp_path, batches, late):
    """What the stream puts out over the batches of (event_id, user_id, seconds), a new start of the query for each."""
    src, schema = str(tmp_path / "events"), "event_id long, user_id long, s long"
    for i in range(1, len(batches) + 1):
        rows = spark.createDataFrame(batches[i - 1], schema).select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(src)
        out = streams.debounce_stream(events, "user_id", "ts", "event_id", "100 seconds", late)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("user_id >= 0").select("event_id", "user_id", F.unix_seconds("ts")).collect())


def test_debounce_stream_equals_the_batch(spark, tmp_path):
    """Shuffled events with ties, over restarts; a far event of another key then closes the watermark."""
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 3), 1_000_000 + rng.randint(0, 60) * rng.choice([7, 50])) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = sorted((r.event_id, r.user_id, r.s) for r in streams.debounce(batch, "user_id", "ts", "100 seconds").collect())
    cut = [rows[:70], rows[70:110], rows[110:], [(-1, -1, 9_000_000)], [(-2, -1, 9_000_001)]]
    assert debounced(spark, tmp_path, cut, "1 hour") == want and len(want) > 4


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    cut = [[(1, 0, 1000), (2, 0, 5000)], [(3, 0, 4950)], [(4, 0, 1050), (5, 0, 4910)], [(6, -1, 90_000)], [(7, -1, 90_001)]]
    assert debounced(spark, tmp_path, cut, "10 minutes") == [(1, 0, 1000), (2, 0, 5000)]


def test_sheets_of_several_files_keep_their_order(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("k,v\n" + "".join(f"key{i},{n}-{i}\n" for i in range(40)))
    rows, twice = readers.read_sheet(spark, str(tmp_path), "k", "v")
    assert {r.key: r.value for r in rows.collect()} == {f"key{i}": f"2-{i}" for i in range(40)}
    assert {r.key: r.rows for r in twice.collect()}["key5"] == [7, 7, 7]


def test_exports_line_by_line(spark, tmp_path):
    source = "array<struct<path:string,type:string,reference:string>>"
    s = spark.createDataFrame([("b a", ["b", "a"], [("f", "txt", "line 1"), ("g", "txt", "line 2")], 2), ("c, d", ["c,", "d"], [], 0), ("12", ["12"], [], 0)], f"sentence string, tokens array<string>, sources {source}, source_count int")
    writers.export_sources(corpus.source_rows(s), f"{tmp_path}/1")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/1", header=True).collect()), key=str) == [("b a", "2", "f", "txt", "line 1"), ("b a", "2", "g", "txt", "line 2"), ("c, d", "0", None, None, None)]
    writers.export_unique(s, f"{tmp_path}/2")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/2", header=True).collect())) == [("b a", "2"), ("c, d", "0")]
    writers.export_document(corpus.source_rows(s), f"{tmp_path}/3")
    assert [r.value for r in spark.read.text(f"{tmp_path}/3").collect()] == ["b a", "  - f, line 1", "  - g, line 2", "c, d"]
    writers.write_clean_tree(spark.createDataFrame([("x", "p/a.txt", "txt"), ("y", "p/b.docx", "docx")], "text string, source_path string, source_type string"), f"{tmp_path}/4")
    assert {(r.text, r.source_file) for r in writers.clean_set(spark, f"{tmp_path}/4", "docx").collect()} == {("y", "b.clean")} and writers.clean_set(spark, f"{tmp_path}/4").count() == 2
