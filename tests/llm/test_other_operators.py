import gzip
import hashlib
import random
import re
import statistics
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import op2_language, op3_warc, op6_secrets, op7_decontaminate, op8_toxicity, op9_mixing, op10_quality, warc


# ---- language -------------------------------------------------------------------------------------
def test_language_fuses_evidence(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op2_language.TextModel(docs)
    out = op2_language.identify(op2_language.document_evidence(docs), model).join(docs.select("doc_id", docs.lang.alias("want")), "doc_id")
    assert out.where("lang = want").count() >= 0.97 * docs.count()
    pages = spark.createDataFrame([(i, f"http://a.de/{i}", '<html lang="de">x') for i in range(40)] + [(90, "http://a.de/q", "<p>12345"), (91, None, None), (92, "http://b.fr/fr/", "<p>1")], "page_id long, url string, html string")
    rows = op2_language.page_evidence(pages).unionByName(op2_language.document_evidence(docs))
    got = {r.page_id: r for r in op2_language.identify(rows, model).where("kind = 'page'").collect()}
    assert len(got) == 43 and got[0].declared == "de" and got[92].suffix == "fr" and got[91].declared is None and 0 < got[91].posterior <= 1
    assert op2_language.identify(op2_language.document_evidence(edge_docs), model).count() == edge_docs.count()
    assert op2_language.identify(op2_language.document_evidence(no_docs), op2_language.TextModel(no_docs)).count() == 0


def test_language_of_held_out_documents(spark):
    """Trained on two thirds of the documents, judged on the rest, which the model has never counted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    model = op2_language.TextModel(docs.where("not out"))
    held = docs.where("out and length(text) >= 20").select("doc_id", "text", F.lit(None).cast("string").alias("source"), F.col("lang").alias("want"))
    out = op2_language.identify(op2_language.document_evidence(held), model).join(held.select("doc_id", "want"), "doc_id").collect()
    assert len(out) > 200 and sum(r.lang == r.want for r in out) >= 0.97 * len(out)


def test_language_column_with_many_values(spark):
    rows = [(i, f"die und der {i}", "de") for i in range(6)] + [(10 + i, f"the and of {i}", "en") for i in range(5)] + [(20 + i, f"zzq qxx {i}", f"x{i}") for i in range(9)]
    docs = spark.createDataFrame([*rows, (40, None, "x0"), (41, "the", None)], "doc_id long, text string, lang string")
    few, all_ = op2_language.TextModel(docs, languages=2), op2_language.TextModel(docs, languages=11)
    assert few.langs == ["de", "en", "other"] and len(all_.langs) == 11 and op2_language.TextModel(docs).langs == all_.langs
    out = op2_language.identify(op2_language.document_evidence(docs.withColumn("source", F.lit(None).cast("string"))), few).collect()
    assert len(out) == 22 and {r.text_lang for r in out if 20 <= r.doc_id < 40} == {"other"}


def plain_fusion(rows, model):
    """rows of (id, text, declared, suffix, host, domain): the same fusion in plain Python."""
    import numpy as np

    k, n = len(model.langs), {}
    for r in rows:
        g = op2_language.trigrams(r[1])
        s = model.log_p[:, g].sum(1, dtype=np.float64) * (min(1.0, op2_language.EVIDENCE / len(g)) if len(g) else 0.0)
        n[r[0]] = s, int(np.argmax(s))
    seen = {c: Counter((r[c], n[r[0]][1]) for r in rows if r[c]) for c in (2, 3, 4, 5)}
    base = np.array([1.0 + sum(f == i for _, f in n.values()) for i in range(k)])
    base /= base.sum()
    out = {}
    for r in rows:
        s, first = n[r[0]]
        own = np.eye(k)[first]
        count = lambda c: np.array([float(seen[c][r[c], i]) for i in range(k)]) - own if r[c] else np.zeros(k)
        d = count(5)
        prior = (d + op2_language.DOMAIN_WEIGHT * base) / (d.sum() + op2_language.DOMAIN_WEIGHT)
        c = count(4)
        z = s + np.log((c + op2_language.HOST_WEIGHT * prior) / (c.sum() + op2_language.HOST_WEIGHT))
        for col in (2, 3):
            if r[col] in model.langs:
                at = model.langs.index(r[col])
                per = np.array([sum(seen[col][x, i] for x in model.langs) for i in range(k)])
                z = z + np.log((np.array([seen[col][r[col], i] for i in range(k)]) + np.where(np.arange(k) == at, 2.0, 0.5)) / (per + 1.5 + 0.5 * k))
        e = np.exp(z - z.max())
        out[r[0]] = model.langs[int(np.argmax(z))], round(float(e.max() / e.sum()), 6)
    return out


def test_language_equals_a_plain_fusion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op2_language.TextModel(docs)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = spark.createDataFrame([(1000 + i, f"http://a{i % 3}.b.de/{'fr' if i % 2 else 'x'}/{i}", f'<html lang="{["de", "fr", "xx"][i % 3]}">der die das und ein {i}') for i in range(30)], "page_id long, url string, html string")
    rows = op2_language.page_evidence(pages.unionByName(more))
    want = plain_fusion([(r.page_id, r.text, r.declared, r.suffix, r.host, r.domain) for r in rows.collect()], model)
    got = {r.page_id: (r.lang, r.posterior) for r in op2_language.identify(rows, model).collect()}
    assert got.keys() == want.keys()
    for i, (lang, p) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, abs=2e-5)


# ---- WARC -----------------------------------------------------------------------------------------
PAGES = [(3, "http://a/é b", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny\x00é"), (1, "again", "same"), (None, "u", "same"), (6, "u", "w" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    op3_warc.write_warc(pages, f"file://{tmp_path}/w")
    rows = op3_warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(rows) == len(PAGES) and Counter(r.record_type for r in rows) == {"response": 4, "revisit": 4}
    by = {(r.page_id, r.record_type): r for r in rows}
    assert bytes(by[5, "response"].payload) == PAGES[4][2].encode() and by[5, "response"].payload_bytes == len(PAGES[4][2].encode())
    assert by[3, "revisit"].refers_to == 1 and by[1, "revisit"].refers_to == 1 and by[None, "revisit"].refers_to == 1 and by[4, "revisit"].refers_to == 2
    for r in rows:
        assert r.payload_digest == warc.digest_of(("same" if r.page_id in (1, 3, None) else {2: "", 4: "", 5: PAGES[4][2], 6: PAGES[7][2]}[r.page_id]).encode())
    assert op3_warc.read_warc(spark, f"file://{tmp_path}/w", payload=False).where("record_type = 'revisit' and page_id = 3").count() == 1


def test_warc_reads_plain_and_foreign_archives_and_pushes_predicates(tmp_path):
    data = b"".join(warc.record_bytes(i, 0, "u", t, b"p" * 9, 9, warc.digest_of(b"p" * 9), None if t == "response" else 1) for i, t in ((1, "response"), (2, "revisit")))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.warc.gz").write_bytes(warc.member(data[: data.index(b"WARC/1.1", 5)]) + warc.member(data[data.index(b"WARC/1.1", 5) :]))
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("page_id", LongType()), StructField("record_type", StringType()), StructField("payload_bytes", LongType())])
    reader = warc.WarcReader({"path": str(tmp_path)}, schema)
    assert len(reader.partitions()) == 3
    for part in reader.partitions():
        assert list(reader.read(part)) == [(1, "response", 9), (2, "revisit", 9)]
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 0)]))
    assert len(left) == 1 and [list(reader.read(x)) for x in reader.partitions()] == [[(2, "revisit", 9)]] * 3


def test_warc_of_no_pages_and_of_repeated_payloads_against_plain_python(spark, tmp_path):
    schema = "page_id long, url string, html string"
    assert op3_warc.read_warc(spark, f"{tmp_path}/missing").count() == 0
    op3_warc.write_warc(spark.createDataFrame([], schema), f"{tmp_path}/none")
    assert op3_warc.read_warc(spark, f"{tmp_path}/none").count() == 0
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 5}/{i}", rng.choice([None, "", "a", "b" * 70_000, f"own {i}", "hot", "hot", "hot"])) for i in rng.sample(range(1000), 200)]
    first = {}
    for i, _, body in rows:
        first[body or ""] = min(i, first.get(body or "", i))
    want = {(i, len((b or "").encode()), warc.digest_of((b or "").encode()), "response" if first[b or ""] == i else "revisit", None if first[b or ""] == i else first[b or ""]) for i, _, b in rows}
    d = spark.createDataFrame(rows, schema).repartition(7)
    op3_warc.write_warc(d, f"{tmp_path}/w")  # no scheme: Spark's default file system
    got = op3_warc.read_warc(spark, f"{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r) for r in got.collect()} == want and got.count() == 200
    heads = op3_warc.read_warc(spark, f"{tmp_path}/w", payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r) for r in heads.collect()} == want
    assert not [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".writing")]


def test_warc_skips_members_by_seeking(tmp_path):
    body = bytes(random.Random(4).randrange(256) for _ in range(3_000_000))
    record = lambda i: warc.member(warc.record_bytes(i, 0, "u", "response", body, len(body), warc.digest_of(body), None))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(record(1) + record(2))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(len(out := self.f.read(n)))
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    with path.open("rb") as f:
        m = warc._Members(warc._Lines(Counted(f), 4096))
        for i in (1, 2):
            h = warc.headers(m)
            assert warc.page_of(h["warc-record-id"]) == i
            m.seek(int(h["content-length"]), 1)
        assert warc.headers(m) is None
    assert sum(read) < 40_000
    with path.open("rb") as f:
        m = warc._Members(warc._Lines(f))
        assert m.read(int(warc.headers(m)["content-length"])).endswith(body)


# ---- secrets --------------------------------------------------------------------------------------
def plain_base(text):
    out = []
    for k, (p, n, g) in enumerate(((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(out)


def test_secrets(spark, edge_docs, no_docs):
    rng = random.Random(6)
    tok = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    rows = [(i, f"words here é api_key = \"{tok(hexa, 20)}\" and Token:short AKIA{tok(upper, 16)} ſecret=abcdefabcdef {tok(hexa, 40)} tail ordinarylongword{i}") for i in range(120)]
    hidden = f"XKIA{tok(upper, 16)}"
    rows.append((500, f"plain text, {hidden} then nothing"))
    rows.append((501, "an ordinary text with averyveryverylongword and src/main/java/com/example/file.txt"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = op6_secrets.fit(d)
    got = {r.doc_id: r for r in op6_secrets.secrets(d, model).collect()}
    for i, t in rows:
        base = plain_base(t)
        assert op6_secrets.base_spans(t) == base
        joined = ",".join(f"{op6_secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
    assert got[500].spans == f"model:12:{12 + len(hidden)}" and got[501].spans == ""
    assert op6_secrets.secrets(edge_docs, op6_secrets.fit(no_docs)).count() == edge_docs.count() and op6_secrets.secrets(no_docs, model).count() == 0


def planted(seed, n):
    """(text, what kind is hidden in it): credentials that no base pattern takes, among ordinary words."""
    rng = random.Random(seed)
    tok = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    alnum, upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    vocabulary = [tok("etaoinshrdlu", rng.randrange(2, 16)) for _ in range(600)]
    words = lambda: " ".join(rng.choices(vocabulary, k=150))
    labelled = [f"{words()} password={tok(alnum, rng.randrange(20, 33))} {words()} AKIA{tok(upper, 16)} {tok(hexa, rng.choice([32, 40]))} {words()}" for _ in range(n)]
    hidden = [("assign", tok(alnum, rng.randrange(20, 33))) for _ in range(n)] + [("access", rng.choice(["ASIA", "AGPA"]) + tok(upper, 16)) for _ in range(n)] + [("hex", f"{tok(hexa, 15)}-{tok(hexa, 15)}") for _ in range(n)]
    return labelled, [(k, h, f"{words()} {h} {words()}") for k, h in hidden], [words() for _ in range(n)]


def test_secrets_finds_planted_variants_and_leaves_words_alone(spark):
    labelled, hidden, ordinary = planted(31, 150)
    rows = [(i, t) for i, t in enumerate([*labelled, *(t for _, _, t in hidden), *ordinary])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in op6_secrets.secrets(d, op6_secrets.fit(d)).collect()}
    for kind in op6_secrets.KINDS:
        mine = [(len(labelled) + i, h, t) for i, (k, h, t) in enumerate(hidden) if k == kind]
        found = sum(f"model:{t.index(h)}:{t.index(h) + len(h)}" in got[i].spans.split(",") for i, h, t in mine)
        assert found >= 0.9 * len(mine), kind
    assert sum(got[len(labelled) + len(hidden) + i].n_model for i in range(len(ordinary))) == 0


def test_secrets_are_learned_from_all_values_and_all_ordinary_tokens(spark):
    rng = random.Random(10)
    tok = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    values = {"access": {f"AKIA{tok(upper, 16)}" for _ in range(1500)}, "hex": {tok(hexa, n) for n in [32, 40, 300] * 800}}
    words = [tok("etaoinshrdlu", rng.randrange(12, 16)) for _ in range(7000)]
    words += words[:500]
    tokens = [*words, *sorted(values["access"]), *sorted(values["hex"]), *sorted(values["hex"])]
    rng.shuffle(tokens)
    d = spark.createDataFrame([(i, " ".join(tokens[i::300])) for i in range(300)], "doc_id long, text string").repartition(7)
    model = op6_secrets.fit(d)
    pairs = Counter(p for w in map(op6_secrets.symbols, words) for p in zip(f"^{w}", f"{w}$", strict=True))
    assert {(a, b): n for a, x in model.background.n.items() for b, n in x.items()} == pairs
    assert set(model.automata) == set(values)
    for kind, (a, cut) in model.automata.items():
        out = [v for v in values[kind] if (xxhash.xxh64_intdigest(v, seed=42) ^ 1 << 63) % 5 == (1 << 63) % 5]
        inside = [op6_secrets.symbols(v) for v in values[kind].difference(out)]
        taken, ends = Counter(), Counter()
        for s in inside:
            q = 0
            for c in s:
                taken[q, c] += 1
                q = a.to[q][c]
            ends[q] += 1
        assert {(q, c): n for q, x in enumerate(a.n) for c, n in x.items()} == taken and a.ends == [ends[q] for q in range(len(a.to))]
        plain = op6_secrets.Automaton(inside)
        assert (plain.to, plain.n, plain.ends) == (a.to, a.n, a.ends)
        scores = [a.bits(s) - model.background.bits(s) for s in map(op6_secrets.symbols, out)]
        assert abs(cut - max(op6_secrets.MIN_BITS, statistics.median(scores) / 2)) < 0.05


def test_samples_of_values_merge_to_the_smallest_ranks():
    values = [f"value-{i:05}" for i in range(9000)]
    s = op6_secrets.Smallest()
    for v in values + values[::-1]:
        s.add("hex", v)
    s.cut("hex")
    assert set(s.kept["hex"]) == set(sorted(values, key=op6_secrets._rank)[: op6_secrets.TRAIN])


def test_automaton_merges_states_and_prefers_its_format():
    rng = random.Random(7)
    words = ["A" * 4 + "".join(rng.choice("A9") for _ in range(16)) for _ in range(400)]
    a = op6_secrets.Automaton(words)
    reachable, todo = set(), [0]
    while todo:
        q = todo.pop()
        if q not in reachable:
            reachable.add(q)
            todo += a.to[q].values()
    assert len(reachable) < 200 and a.bits(words[0]) > a.bits("h" * 20)


def test_an_unseen_symbol_costs_the_same_however_many_values_were_seen():
    rng = random.Random(12)
    costs = []
    for n in (200, 20_000):
        a = op6_secrets.Automaton("".join(rng.choice("h9") for _ in range(16)) for _ in range(n))
        costs.append(a.bits("h9" * 8) - a.bits("h9h9h9-h9h9h9h9h9"))
    assert abs(costs[0] - costs[1]) < 1


# ---- benchmark ------------------------------------------------------------------------------------
def test_decontamination(spark, edge_docs, no_docs):
    rng = random.Random(8)
    item = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    bench = [(i, item(rng.randrange(10, 60))) for i in range(30)] + [(90, None), (91, "short"), (92, "")]
    filler = lambda: item(200)
    rows, want = [], set()
    for i, t in bench[:30]:
        edited = list(t)
        for _ in range(2):
            edited[rng.randrange(len(t))] = "#"
        rows += [(3 * i, f"{filler()} {t.upper()}\n{filler()}"), (3 * i + 1, f"{filler()} {''.join(edited)} {filler()}"), (3 * i + 2, filler())]
        want.add((3 * i, i))
        if len(t) >= 80:
            want.add((3 * i + 1, i))
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = op7_decontaminate.matches(d, b).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert want <= pairs and not {x for x, _ in pairs} & {r for r, _ in rows if r % 3 == 2}
    texts = dict(rows)
    for r in got:
        if r.doc_id % 3 == 0:
            assert texts[r.doc_id][r.start : r.end] == dict(bench)[r.item_id].upper() and r.edits == 0
    assert {r.doc_id for r in op7_decontaminate.decontaminate(d, b).collect()} == {i for i, _ in rows} - {i for i, _ in pairs}
    assert op7_decontaminate.matches(edge_docs, b).count() == 0 and op7_decontaminate.matches(no_docs, b.limit(0)).count() == 0
    assert op7_decontaminate.decontaminate(edge_docs, b).count() == edge_docs.count()


def test_short_items_match_whole_between_spaces(spark):
    b = spark.createDataFrame([(1, "Two words"), (2, "a  rather short item here"), (3, "x"), (4, " "), (5, "two"), (6, None)], "item_id long, text string")
    rows = [(1, "these are\ttwo  WORDS indeed"), (2, "two wordsmiths"), (3, "it has a rather short\nitem here"), (4, "rather short item here"), (5, "x"), (6, ""), (7, None), (8, "two two words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in op7_decontaminate.matches(d, b).collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    want = {(i, j) for i, t in rows for j, x in ((r.item_id, r.text) for r in b.collect()) if plain(x) and f" {plain(x)} " in f" {plain(t)} "}
    assert set(got) == want and got[1, 1] == (0, 10, 20) and got[8, 5] == (0, 0, 7)
    assert op7_decontaminate.decontaminate(d, b).count() == len(rows)


def test_every_excerpt_with_few_edits_is_found_by_brute_force(spark):
    """Whole items and long excerpts with edits, against the best local alignment of every piece with every text."""
    rng = random.Random(18)
    item = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    bench = [(i, item(rng.randrange(8, 40))) for i in range(6)]
    rows = []
    for i in range(24):
        t = list(bench[i % 6][1])
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice(["", "#", "zz"])
        rows.append((i, f"{item(12)} {''.join(t)} {item(12)}"))
    index = op7_decontaminate.Index(bench)
    want = set()
    for i, t in rows:
        x = op7_decontaminate.normalised(t)[0]
        for j, (p, k) in enumerate(zip(index.piece, index.edits, strict=True)):
            row = [0] * (len(x) + 1)
            for n, c in enumerate(p, 1):
                new = [n]
                for m in range(1, len(x) + 1):
                    new.append(min(row[m - 1] + (x[m - 1] != c), row[m] + 1, new[-1] + 1))
                row = new
            if min(row) <= k:
                want.add((i, index.item[j]))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op7_decontaminate.matches(d, b).collect()} == want and 10 < len(want) < 60


def test_alignment_equals_plain_dynamic_programming():
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        p = "".join(rng.choice("abcd ") for _ in range(80)).strip().ljust(60, "z")
        t = list(p)
        for _ in range(rng.randrange(5)):
            j = rng.randrange(len(t))
            t[j : j + rng.randrange(2)] = rng.choice(["", "x", "yy"])
        text = "lead " * 5 + "".join(t) + " tail" * 5
        index = op7_decontaminate.Index([(1, p)])
        x = op7_decontaminate.normalised(text)[0]
        pattern = index.piece[0]
        row = [0] * (len(x) + 1)
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j in range(1, len(x) + 1):
                new.append(min(row[j - 1] + (x[j - 1] != c), row[j] + 1, new[-1] + 1))
            row = new
        best = min(row)
        found = [m for pc, d in index.candidates(x) if pc == 0 and (m := index.align(x, pc, d))]
        if best <= index.edits[0]:
            assert found and min(m[0] for m in found) == best
        else:
            assert not found
        assert np.all(index.bound > 0)


# ---- toxicity -------------------------------------------------------------------------------------
def test_toxicity_held_out_accuracy(spark, edge_docs, no_docs):
    rng = random.Random(10)
    clean = [f"w{i}" for i in range(300)]
    bad = ["blarg" + s for s in "abcdefgh"] + ["snorf", "quib"]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.15
        words = [rng.choice(clean) for _ in range(rng.randrange(10, 80))]
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = op8_toxicity.toxicity(d, lab, held_out=op8_toxicity.is_held_out).withColumn("h", op8_toxicity.is_held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in got if got[i].h]
    truth = dict(labels)
    hit = sum(got[i].predicted and truth[i] for i in held)
    assert 200 < len(held) < 400 and hit >= 0.95 * sum(truth[i] for i in held) and hit >= 0.95 * sum(got[i].predicted for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    flipped = spark.createDataFrame([(i, 1 - t if got[i].h else t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in op8_toxicity.toxicity(d, flipped, held_out=op8_toxicity.is_held_out).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels are never read
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    assert op8_toxicity.toxicity(edge_docs, none).count() == edge_docs.count() and op8_toxicity.toxicity(no_docs, none).count() == 0


def test_shouting_is_counted_over_the_whole_text():
    import sys

    shouts = op8_toxicity.N_LEXICONS + 5
    vote = lambda text: op8_toxicity.Lexicon([]).read(text)[0][shouts]
    assert vote("calm words " * 300 + "LOUD ÉCRITS " * 900) == 1 and vote("LOUD WORDS " * 250 + "calm words " * 9000) == 0
    assert vote("LOUD ÉCRITS " * 3) == 1 and vote("calm words " * 3) == 0 and vote("LOUD") == 0
    assert all(op8_toxicity.n_upper(chr(i)) == chr(i).isupper() for i in range(sys.maxunicode + 1))


# ---- mixing ---------------------------------------------------------------------------------------
def test_mixing_meets_targets(spark, edge_docs, no_docs):
    rng = random.Random(11)
    rows = [(i, "x " * rng.randrange(0, 400), None if i % 11 == 0 else rng.choice("aaaaaaabcdefg")) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op9_mixing.mix(d).collect()
    assert len(out) == 1500 and sum({r.source: r.target for r in out}.values()) == pytest.approx(sum(r.size for r in out))
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert mine[0].source_size == sum(r.size for r in mine) and mine[0].target <= 3 * mine[0].source_size + 1e-6
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(1000, 0.03 * mine[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, op9_mixing.mix(d.repartition(9)).collect()), key=str)
    e = op9_mixing.mix(edge_docs)
    assert e.count() == edge_docs.count() and op9_mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [(1, 5, 33, 100), (5, 20, 33, 40), tuple(range(1, 90))])
def test_mixing_fills_small_sources(spark, sizes):
    """Small sources beside a large one repeat as often as they may."""
    rows = [(i, "x " * n, f"s{i:02}") for i, n in enumerate(sizes)] + [(1000 + i, "x " * 500, "z") for i in range(100)]
    out = op9_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source <> 'z'").collect()
    assert len(out) == len(sizes) and all(r.target == r.taken == 3 * r.size for r in out)


def test_mixing_fills_blocks_of_a_small_corpus(spark):
    """Sources below their cap, the weights 5, 2, 1 in turn: within two of their own blocks."""
    rows = [(i, "x " * n, f"s{i}") for i, n in enumerate((60, 33, 40, 65))]
    for r in op9_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert abs(r.target - r.taken) < 2 * -(-r.size // -(-r.size // 32)) and r.target < 3 * r.size


# ---- quality --------------------------------------------------------------------------------------
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, edge_docs, no_docs):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "é# ", "\t"]) for _ in range(rng.randrange(60))), rng.choice(["en", None]), "s") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in op10_quality.quality(d).collect():
        want = plain_counts(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    got = op10_quality.quality(edge_docs).collect()
    assert len(got) == edge_docs.count() and op10_quality.quality(no_docs).count() == 0


def test_quality_fences_adapt_and_bins_nest(spark):
    x = spark.range(0, 5000).withColumn("b", op10_quality.sketch_bin(F.col("id"))).withColumn("top", op10_quality.bin_top(F.col("b")))
    assert x.where("top < id or top > id * 1.13 + 1").count() == 0
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "s") for i in range(300)] + [(900, " ".join(f"#w{j}##" for j in range(40)), "en", "s")]
    bad = [r.doc_id for r in op10_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not kept").collect()]
    assert bad == [900]
