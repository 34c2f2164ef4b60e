"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; those that validate (Luhn, octets, calendar, number groups) are replaced by a
keyed Feistel permutation of their own format: characters within their class, addresses within 32 bits,
dates within the 146,097 days of four centuries (189 x 773, so no cycle walking is needed). Equal values
give equal pseudonyms in all documents, different values different ones, and separators stay in place.
The round function is SHA-256 over key, kind, round and the other half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import let, table

ROUNDS, KEY = 8, "replace this key in production"
_LOCAL = "A-Za-z0-9._%+-"
#: An address begins where its run of characters does, or where the match before has ended inside that run, so that no run is
#: read from each of its places. A domain has 127 labels at most.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{0,126}}\.[A-Za-z]{{2,}}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
#: Groups of digits, 13 digits or more, one space or hyphen between them; stops before an address or date. Possessive, so that runs of any length need no stack.
RUN = rf"(?<!\d)\d(?:(?! (?:{IP}|{DATE}))[ -]?\d){{12,}}+"
PATTERN = "|".join((EMAIL, IP, DATE, SSN, PHONE, RUN))
#: Card formats inside a run: numbers of groups, and the digits of these.
SHAPES = {1: r"\d{13,19}", 3: r"\d{4}[ -]\d{6}[ -]\d{4,5}", 4: r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,4}", 5: r"(?:\d{4}[ -]){4}\d{1,3}"}
#: A run again, its cards between marks; what is left is searched for the other kinds and for cards in other groups.
OPEN, CLOSE, NEXT = "\x01", "\x02", "\x03"
INSIDE = "|".join((f"{OPEN}[^{CLOSE}]*{CLOSE}", DATE, SSN, PHONE, CARD))
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: The first day of the permuted dates and the two moduli whose product is the number of days.
FIRST_DAY, HIGH, LOW = "1800-01-01", 189, 773


def _hash(key: str, kind: str, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _turned(c: Column, by: Column) -> Column:
    base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    size = F.when(c.between("0", "9"), 10).otherwise(26)
    return F.when(base.isNull(), c).otherwise(F.char((base + (F.ascii(c) - base + by) % size).cast("int")))


def _rounds(state: Column, left, right) -> Column:
    """Even rounds replace l by left(l, r, round), odd ones r by right(r, l, round)."""
    step = lambda s, i: F.when(i % 2 == 0, F.struct(left(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right(s["r"], s["l"], i).alias("r")))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), state, step)


def permuted_text(s: Column, kind: str, key: str) -> Column:
    """Letters and digits change within their class; everything else stays."""
    turn = lambda x, other, i: F.array_join(F.transform(F.split(x, ""), lambda c, j: _turned(c, _hash(key, kind, i, j, other))), "")
    half = F.length(s).cast("int").bitwiseAND(~1) / 2
    halves = F.struct(F.left(s, half.cast("int")).alias("l"), F.substr(s, (half + 1).cast("int")).alias("r"))
    return let(_rounds(halves, turn, turn), lambda x: F.concat(x["l"], x["r"]))


def permuted_pair(left: Column, right: Column, a: int, b: int, kind: str, key: str) -> Column:
    """A permutation of the pairs (l, r) with l < a and r < b."""
    add = lambda m: lambda x, other, i: (x + _hash(key, kind, i, other)) % m
    return _rounds(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), add(a), add(b))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def with_digits(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    put = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["o"], F.left(s["d"], F.lit(1))).alias("o"), F.substr(s["d"], F.lit(2)).alias("d"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["d"].alias("d")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("o"), digits.alias("d")), put, lambda s: s["o"])


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn's sum from the right; odd: which digits are doubled, 1 for a whole number, 0 for one without check digit."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, j: F.when(j % 2 == odd, double(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _date(m: Column) -> Column:
    iso = F.when(F.substr(m, F.lit(5), F.lit(1)) == "-", m).otherwise(F.concat_ws("-", F.right(m, F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.left(m, F.lit(2))))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _day(m: Column) -> Column:
    day = F.datediff(_date(m), F.lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < HIGH * LOW), day)


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it doesn't validate."""
    card = F.length(digits_of(m)).between(13, 19) & m.rlike(f"^(?:{CARD})$") & (luhn_sum(digits_of(m), 1) % 10 == 0)
    octets = F.forall(F.split(m, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{IP})$"), F.when(octets, "ip")).when(m.rlike(f"^(?:{DATE})$"), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(f"^(?:{SSN})$"), "ssn").when(card, "card").when(m.rlike(f"^(?:{PHONE})$") & F.length(digits_of(m)).between(8, 15), "phone")
    )


def marked(run: Column) -> Column:
    """The run with each valid card of a known format between marks; from the left, at one place the format first that has four groups of four.

    Each group is written down with the number of groups that are a card from it on; one replacement then takes as many
    groups at each place, so a run of any length is read once."""
    groups = F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))

    def chosen(g: Column, i: Column) -> Column:
        """How many groups from this one on are a card, 0 if none."""
        out = F.lit("0")
        for n in (5, 3, 1, 4):  # the last one is tried first
            text = F.concat(*[F.get(g, i + k) for k in range(n)])
            valid = text.rlike(f"^[ -]?{SHAPES[n]}$") & F.length(digits_of(text)).between(13, 19) & (luhn_sum(digits_of(text), 1) % 10 == 0)
            out = F.when(F.coalesce(valid, F.lit(False)), str(n)).otherwise(out)
        return out

    each = let(groups, lambda g: F.transform(g, lambda x, i: F.concat(F.lit(NEXT), chosen(g, i), x)))
    group = f"([^{NEXT}]*+)"
    cards = [f"{NEXT}{n}{group}" + f"{NEXT}.{group}" * (n - 1) for n in SHAPES]
    put = OPEN + "".join(f"${i}" for i in range(1, 1 + sum(SHAPES))) + CLOSE + f"${1 + sum(SHAPES)}"
    text = F.regexp_replace(F.array_join(each, ""), "|".join([*cards, f"{NEXT}0{group}"]), put)
    return F.regexp_replace(F.replace(text, F.lit(OPEN + CLOSE), F.lit("")), f"{OPEN}([ -])", f"$1{OPEN}")


def pieces(m: Column) -> Column:
    """struct(gaps, found): what a candidate consists of; each of found is struct(m, kind)."""
    strip = lambda x: F.translate(x, OPEN + CLOSE, "")
    inner = lambda x: F.when(x.startswith(OPEN), F.struct(strip(x).alias("m"), F.lit("card").alias("kind"))).otherwise(F.struct(x.alias("m"), kind_of(x).alias("kind")))
    run = let(marked(m), lambda t: F.struct(F.split(t, INSIDE, -1).alias("gaps"), F.transform(F.regexp_extract_all(t, F.lit(INSIDE), F.lit(0)), inner).alias("found")))
    one = F.struct(F.array(F.lit(""), F.lit("")).alias("gaps"), F.array(F.struct(m.alias("m"), kind_of(m).alias("kind"))).alias("found"))
    return F.when(m.rlike(f"^(?:{RUN})$"), run).otherwise(one)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    last = F.length(m) - F.length(F.substring_index(m, ".", -1))
    email = F.concat(permuted_text(F.left(m, (last - 1).cast("int")), "email", key), F.substr(m, last.cast("int")))
    octet = lambda i: F.split(m, r"\.")[i].try_cast("int")
    ip = let(permuted_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, "ip", key), lambda p: F.concat_ws(".", *[F.expr("0") + x for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))
    day = let(permuted_pair(F.floor(_day(m) / LOW), _day(m) % LOW, HIGH, LOW, "date", key), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * LOW + p["r"]).cast("int")))
    sep = F.substr(m, F.lit(3), F.lit(1))
    date = let(day, lambda d: F.when(F.substr(m, F.lit(5), F.lit(1)) == "-", F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy"))))
    d = digits_of(m)
    body = permuted_text(F.left(d, (F.length(d) - 1).cast("int")), "card", key)
    card = let(body, lambda b: with_digits(m, F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string"))))
    country = F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-])|)", 0)
    rest = F.substr(m, (F.length(country) + 1).cast("int"))
    phone = F.concat(country, with_digits(rest, permuted_text(digits_of(rest), "phone", key)))
    ssn = with_digits(m, permuted_text(d, "ssn", key))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(m)


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(F.flatten(F.transform(found, lambda s: s["kinds"])), lambda k: k == kind)).cast("long")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, counts: bool = True) -> DataFrame:
    """The same rows with personal data in text_col replaced, and n_<kind> columns of what was replaced unless counts is off.

    Null texts stay null, with counts of 0; texts without candidates, empty ones included, are returned as they
    are; repeated rows get equal results; an empty table gives no rows. Other columns pass through, whatever
    their names, except n_<kind> ones, which the counts replace (the struct of what was found takes a name that
    no column has). Dates are yyyy-mm-dd, dd/mm/yyyy and dd.mm.yyyy, no
    other order; those outside 1800 to 2199 stay. Cards are looked for beside other digits too: as 13 to 19 digits on
    end, in fours (4-4-4-4, its last group of 1 to 4, or a fifth of 1 to 3), as 4-6-5 or 4-6-4; in other groups only
    where the digits beside them, up to 19, are the card's."""
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    new = lambda p: F.array_join(F.zip_with(p["gaps"], p["found"], lambda x, s: F.concat(x, F.coalesce(pseudonym(s["m"], s["kind"], key), F.lit("")))), "")
    replaced = lambda ps: F.transform(ps, lambda p: F.struct(F.transform(p["found"], lambda s: s["kind"]).alias("kinds"), new(p).alias("new")))
    pii = "__pii" + "_" * max(map(len, docs.columns))
    d = docs.withColumn(pii, let(F.transform(F.coalesce(found, F.array().cast("array<string>")), pieces), replaced))
    parts = F.zip_with(F.split(text, PATTERN, -1), F.col(pii), lambda x, s: F.concat(x, F.coalesce(s["new"], F.lit(""))))
    d = d.withColumn(text_col, F.when(F.size(pii) > 0, F.array_join(parts, "")).otherwise(text))
    for k in KINDS if counts else ():
        d = d.withColumn(f"n_{k}", _count(pii, k))
    return d.drop(pii)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "text", *[f"n_{k}" for k in KINDS])
