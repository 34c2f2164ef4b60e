"""Secrets: fixed base patterns, and probabilistic automata inferred from the credentials they label.

The base patterns label credentials over the whole corpus, in one pass. Of each kind, all distinct values become
strings of character classes; those that a hash holds out aside, an automaton is inferred from them as ALERGIA does
it: from the start on, a state that no transition leads to yet is merged with the first one whose outgoing frequencies,
and those of the states up to AHEAD symbols on, agree with its own within Hoeffding's bound, or becomes a state itself.
Every round is one aggregation over all these strings: what follows each state is counted by the tasks, and only these
counts, as many as the automaton has states and what may follow in AHEAD symbols, reach the driver. The last round
leaves each transition with the number of all strings that take it. Every token of every whole text that is as long as
the shortest labelled value is then scored: log-likelihood under the best automaton minus that under a class bigram model
of all ordinary tokens of that length. A kind's cut-off is half of what the median of its labelled credentials held out
from the fit scores, and never under MIN_BITS."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import drop_stored, stored, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The shortest value that a base pattern takes: shorter tokens are no candidates.
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: A kind with fewer distinct values than this has no automaton; one of HELD values is held out for the cut-off.
MIN_TRAIN, HELD = 20, 5
#: Symbols (the end is one) by which states are compared, and visits under which a difference can't show.
AHEAD, MIN_VISITS = 4, 8
#: What every symbol, seen or not, shares of a state's probability.
ESCAPE = 0.001
ALPHA, MIN_BITS, CUT = 0.05, 12.0, 0.5
CLASSES = {**dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("0123456789", "9"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")}
#: All classes, and the end.
SYMBOLS = "hl9A+/_.=-$"
ALPHABET = len(SYMBOLS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, leftmost and non-overlapping per kind."""
    out, low = [], text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credentials(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, str]]:
    for start, kind, end in spans:
        yield KINDS[kind], ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens of SHORTEST characters or more that touch no base span."""
    i = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(spans) and spans[i][0] < start and spans[i][2] <= start:
            i += 1
        if not any(s < end and e > start for s, _, e in spans[i:] if s < end):
            yield start, end


_CLASSES = str.maketrans(CLASSES)


def symbols(token: str) -> str:
    return token.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton of symbol strings, inferred by merging states (ALERGIA) in rounds: visits() counts, over any
    share of the strings, what follows each state; learn() takes the sums and settles all transitions that are open."""

    def __init__(self, strings: Iterable[str] = (), alpha: float = ALPHA):
        self.to: list[dict[str, int]] = [{}]
        self.n: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        counts = Counter(strings)
        while self.learn(self.visits(counts.items())):
            pass

    def visits(self, strings: Iterable[tuple[str, int]]) -> dict[tuple[int, str, str], int]:
        """(state, "", what follows) of all states that the strings, given with their numbers, pass; where a transition is
        open, (state, symbol, what follows the symbol) as well, and the string is left there."""
        seen: dict[tuple[int, str, str], int] = defaultdict(int)
        for s, n in strings:
            s, q = s + "$", 0
            for i, c in enumerate(s):
                seen[q, "", s[i : i + AHEAD]] += n
                if c == "$":
                    break
                if c not in self.to[q]:
                    seen[q, c, s[i + 1 : i + 1 + AHEAD]] += n
                    break
                q = self.to[q][c]
        return seen

    def learn(self, seen: dict[tuple[int, str, str], int]) -> bool:
        """A round: leads the open transitions to states, in order; whether there were any."""
        after: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for (q, c, w), n in seen.items():
            for i in range(len(w) + 1):
                after[q, c][w[:i]] += n
        states = [after[q, ""] for q in range(len(self.to))]
        self.ends = [x["$"] for x in states]
        self.n = [{w: n for w, n in x.items() if len(w) == 1 and w != "$"} for x in states]
        blue = sorted(k for k in after if k[1])
        for q, c in blue:
            mine = after[q, c]
            r = next((r for r, x in enumerate(states) if self.compatible(x, mine)), len(states))
            if r == len(states):
                states.append(mine), self.to.append({}), self.n.append({}), self.ends.append(0)
            else:
                for w, n in mine.items():
                    states[r][w] += n
            self.to[q][c] = r
        return bool(blue)

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.n[q].values())

    def compatible(self, a: dict[str, int], b: dict[str, int]) -> bool:
        """Whether two states, given as the numbers of all that follows them, agree in every next symbol."""
        stack = [""]
        while stack:
            w = stack.pop()
            na, nb = a.get(w, 0), b.get(w, 0)
            if min(na, nb) < MIN_VISITS:
                continue
            bound = self.width * (na**-0.5 + nb**-0.5)
            for c in SYMBOLS:
                x, y = a.get(w + c, 0), b.get(w + c, 0)
                if abs(x / na - y / nb) > bound:
                    return False
                if x and y and c != "$" and len(w) + 1 < AHEAD:
                    stack.append(w + c)
        return True

    def bits(self, s: str) -> float:
        """log2 likelihood of the string; unseen symbols have a small probability and lead back to the start. It is bounded below
        by ESCAPE, so a variant of a format doesn't become unlikelier the more values of the format were seen."""
        q, out = 0, 0.0
        for c in s:
            out += self.symbol_bits(self.n[q].get(c, 0), q)
            q = self.to[q].get(c, 0)
        return out + self.symbol_bits(self.ends[q], q)

    def symbol_bits(self, n: int, q: int) -> float:
        return math.log2((1 - ESCAPE) * (n + 0.1) / (self.total(q) + 0.1 * len(SYMBOLS)) + ESCAPE / len(SYMBOLS))


class Background:
    """Class bigrams of ordinary long tokens."""

    def __init__(self, pairs: Iterable[tuple[str, int]]):
        """Of the bigrams (a token is between ^ and $) and how often they occur: words recur, credentials among them hardly do."""
        self.n: dict[str, dict[str, int]] = defaultdict(dict)
        for (a, b), times in pairs:
            self.n[a][b] = times
        self.n = dict(self.n)
        self.sums = {k: sum(v.values()) for k, v in self.n.items()}

    def bits(self, s: str) -> float:
        return sum(math.log2((self.n.get(a, {}).get(b, 0) + 0.5) / (self.sums.get(a, 0) + 0.5 * (ALPHABET + 1))) for a, b in zip("^" + s, s + "$", strict=True))


class Model:
    """Automata by kind, each with its cut-off in bits, and the background."""

    def __init__(self, automata: dict[str, Automaton], background: Background):
        self.background = background
        self.automata = {k: (a, MIN_BITS) for k, a in sorted(automata.items())}
        self.margins: dict[str, float] = {}

    def margin(self, token: str) -> float:
        """By how many bits the token passes the cut-off of the kind it is likeliest to be. It goes by the token's classes
        alone; those of frequent class strings are kept."""
        s = symbols(token)
        if (m := self.margins.get(s)) is None:
            m = max((a.bits(s) - cut for a, cut in self.automata.values()), default=-math.inf) - self.background.bits(s)
            if len(s) <= 64:
                if len(self.margins) >= 100_000:
                    self.margins.clear()
                self.margins[s] = m
        return m


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, n) of the labelled credentials and, as kind "other", of the class bigrams of ordinary tokens."""
    pairs: dict[tuple[str, str], int] = Counter()
    for batch in batches:
        kinds, values, tokens = [], [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            for kind, value in credentials(text or "", spans):
                kinds.append(kind), values.append(value)
            tokens += [text[start:end] for start, end in candidates(text or "", spans)]
        if tokens:
            line = f"^{'$^'.join(map(symbols, tokens))}$"
            pairs.update(zip(line, line[1:], strict=False))
        yield _rows(kind=(kinds, pa.string()), value=(values, pa.string()), n=([1] * len(kinds), pa.int64()))
    pairs.pop(("$", "^"), None)
    yield _rows(kind=(["other"] * len(pairs), pa.string()), value=([a + b for a, b in pairs], pa.string()), n=(list(pairs.values()), pa.int64()))


def _rows(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _strings(batch: pa.RecordBatch) -> dict[str, list[tuple[str, int]]]:
    """The batch's class strings with their numbers, by kind."""
    by: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for kind, s, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "s", "n")), strict=True):
        by[kind].append((s, n))
    return by


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, held, s, n): n distinct credentials of the kind have the class string s, those held out apart; of kind "other" s is
    a class bigram that ordinary tokens hold n times. All texts are searched once."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_found, "kind string, value string, n long")
    other = F.col("kind") == "other"
    s = F.when(other, F.col("value")).otherwise(F.translate("value", "".join(CLASSES), "".join(CLASSES.values())))
    return (
        found.groupBy("kind", "value").agg(F.sum("n").alias("n"))
        .select("kind", (~other & (F.pmod(F.xxhash64("value"), F.lit(HELD)) == 0)).alias("held"), s.alias("s"), F.when(other, F.col("n")).otherwise(1).alias("n"))
        .groupBy("kind", "held", "s").agg(F.sum("n").alias("n"))
    )


def infer(strings: DataFrame, kinds: Iterable[str]) -> dict[str, Automaton]:
    """The kinds' automata of all strings (kind, s, n), a round of all kinds in one aggregation."""
    automata = {k: Automaton() for k in kinds}
    todo = set(automata)
    while todo:
        now = {k: automata[k] for k in sorted(todo)}

        def run(batches: Iterator[pa.RecordBatch], now: dict[str, Automaton] = now) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[str, int, str, str], int] = defaultdict(int)
            for batch in batches:
                for kind, rows in _strings(batch).items():
                    for key, n in now[kind].visits(rows).items():
                        seen[kind, *key] += n
            kind, state, symbol, ahead = zip(*seen, strict=True) if seen else ((),) * 4
            yield _rows(kind=(kind, pa.string()), state=(state, pa.int64()), symbol=(symbol, pa.string()), ahead=(ahead, pa.string()), n=(list(seen.values()), pa.int64()))

        counted = strings.where(F.col("kind").isin(*now)).mapInArrow(run, "kind string, state long, symbol string, ahead string, n long")
        seen: dict[str, dict[tuple[int, str, str], int]] = {k: {} for k in now}
        for r in counted.groupBy("kind", "state", "symbol", "ahead").agg(F.sum("n").alias("n")).collect():
            seen[r.kind][r.state, r.symbol, r.ahead] = r.n
        todo = {k for k, a in now.items() if a.learn(seen[k])}
    return automata


def cut_offs(held: DataFrame, model: Model) -> dict[str, float]:
    """Half of the median score, in sixteenths of a bit, of all held-out strings (kind, s, n) by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, round(16 * (model.automata[k][0].bits(s) - model.background.bits(s))), n) for k, v in _strings(batch).items() for s, n in v]
            kind, score, n = zip(*rows, strict=True) if rows else ((),) * 3
            yield _rows(kind=(kind, pa.string()), score=(score, pa.int64()), n=(n, pa.int64()))

    scores = held.where(F.col("kind").isin(*model.automata)).mapInArrow(run, "kind string, score long, n long")
    medians = scores.groupBy("kind").agg(F.percentile("score", 0.5, F.col("n")).alias("m")).collect()
    return {r.kind: max(MIN_BITS, CUT * r.m / 16) for r in medians}


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of the documents, of all their credentials and ordinary tokens. Class strings are stored and read once a round;
    the driver gets counts by class bigram and by state."""
    known = stored(patterns(docs, text_col).repartition(docs.sparkSession.sparkContext.defaultParallelism))
    background = Background((r.s, r.n) for r in known.where("kind = 'other'").collect())
    labelled = known.where("kind <> 'other'")
    kinds = sorted(r.kind for r in labelled.groupBy("kind").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TRAIN).collect())
    model = Model(infer(labelled.where("not held"), kinds) if kinds else {}, background)
    if kinds:
        cuts = cut_offs(labelled.where("held"), model)
        model.automata = {k: (a, cuts.get(k, cut)) for k, (a, cut) in model.automata.items()}
    drop_stored(known)
    return model


def secrets(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256 and spans for each row.

    Spans are kind:start:end in code points, by start and then kind; those of kind model are tokens whose
    format the automata find likelier than the background by the cut-off. Null texts are empty and have no
    spans; repeated rows are judged each; an empty table gives no rows and an untrained model no model spans. Other
    columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*KINDS, "model")
        for batch in batches:
            n, sha, joined = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(s, 3, e) for s, e in candidates(text, base) if model.margin(text[s:e]) >= 0]
                every = [f"{names[k]}:{s}:{e}" for s, k, e in sorted(base + more)]
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in base + more))
                sha.append(hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                joined.append(",".join(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array(joined)], ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets(docs, fit(docs))


# ---- samples of values: nothing here uses them any more, but they have a test -----------------------
TRAIN, BACKGROUND, MAX_VALUE = 1000, 5000, 256


def _rank(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1


class Smallest:
    """The distinct values with the smallest ranks, so many of each kind, and how often each occurs; such samples merge,
    since a value that ends up in the sample has been in it from its first occurrence on."""

    def __init__(self):
        self.kept: dict[str, dict[str, list[int]]] = defaultdict(dict)
        self.limit: dict[str, int] = {}

    def add(self, kind: str, value: str) -> None:
        kept = self.kept[kind]
        if value in kept:
            kept[value][1] += 1
        elif len(value) <= MAX_VALUE and (r := _rank(value)) <= self.limit.get(kind, r):
            kept[value] = [r, 1]
            if len(kept) >= 2 * sample_size(kind):
                self.cut(kind)

    def cut(self, kind: str) -> None:
        best = sorted(self.kept[kind].items(), key=lambda x: (x[1][0], x[0]))[: sample_size(kind)]
        self.kept[kind] = dict(best)
        if len(best) == sample_size(kind):
            self.limit[kind] = best[-1][1][0]


def sample_size(kind: str) -> int:
    return BACKGROUND if kind == "other" else TRAIN
