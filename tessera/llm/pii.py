"""Format-preserving Feistel pseudonyms for personal data, in DataFrame expressions only.

Candidates are found by one pattern, validated by their own rules (checksums, ranges, calendars),
and replaced by a keyed permutation of their own format: a value is a list of symbols, each modulo
its radix, and a Feistel network alternates between the halves of the list, adding to each symbol of
one half its own piece of a keyed digest of the other; a list of one symbol goes through a keyed table.
Symbols that cannot move (separators) are no part of the list. Check digits are computed anew, dates stay dates, separators stay where
they are, so equal values get equal pseudonyms in every document, different values different ones,
and the key holder can invert them (``inverse=True``). Values that fail validation are left alone.

Kinds: email, iban, ip (IPv4), date (ISO, or with / or . and day or month first), ssn, card (13 to 19
digits with a right Luhn digit), phone (10 to 15 digits, with a country code or a bracketed or
separated area code). Dates move within their era (the years 1000, 1900 and 2100 begin one); dates
that only make sense month first keep a day past the 12th, so that they are read so again.

The key is an argument; ``configured_key`` reads it from the session and fails where there is none.

Defined results: an address has at most 126 labels before its last; values of any length are moved whole,
in time in proportion to their length; a date written without leading zeros turns back into the same date, perhaps with
them; null text stays null with no values; a text without valid values is returned as
it is; repeated rows are answered once each; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table

ROUNDS = 8
#: The key of the registered query, which shows the operator on invented data: no secret.
QUERY_KEY = "tessera-query-key"
KEY_CONF = "spark.tessera.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[12][0-9]{3}|[0-9]{1,2}\.[0-9]{1,2}\.[12][0-9]{3})(?![0-9A-Za-z/]|[.-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])"
NANP = r"(?:\+1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}"
PHONE = rf"(?<![0-9A-Za-z+])(?:{NANP}|\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)[\x20.-]?)?[0-9]{{2,4}}(?:[\x20.-]?[0-9]{{2,4}}){{1,4}})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, CARD))


def within(x: Column, f) -> Column:
    """``f`` of a value computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


#: Symbols that one digest serves: SHA-512 in words of 32 bits.
WORDS = 16


def configured_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"no key for pseudonyms: set {KEY_CONF}")
    return key


def digest(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 512)


def feistel(values: Column, radix: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of lists of numbers, each modulo its radix (array<bigint>)."""
    half = lambda p: F.floor(F.size(p["v"]) / 2).cast("int")
    ends = lambda p, c: (F.slice(p[c], F.lit(1), half(p)), F.slice(p[c], half(p) + 1, F.size(p[c]) - half(p)))

    def added(x: Column, r: Column, other: Column, i: Column) -> Column:
        """``x`` plus the digests of ``other``: symbol j takes word j % WORDS of digest j / WORDS."""
        said = digest(key, kind, F.size(x), i, F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        blocks = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / WORDS).cast("int")), lambda b: digest(h, b))

        def symbol(hs, v, j):
            h = F.element_at(hs, F.floor(j / WORDS).cast("int") + 1)
            d = F.conv(F.substr(h, F.pmod(j, F.lit(WORDS)) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
            return F.pmod(v - d if inverse else v + d, F.element_at(r, j + 1))

        return F.element_at(F.transform(F.transform(F.array(said), blocks), lambda hs: F.transform(x, lambda v, j: symbol(hs, v, j))), 1)

    def many(q: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            a = F.when(even, acc["a"]).otherwise(added(acc["a"], q["ra"], acc["b"], i))
            b = F.when(even, added(acc["b"], q["rb"], acc["a"], i)).otherwise(acc["b"])
            return F.struct(a.alias("a"), b.alias("b"))

        order = [*range(ROUNDS)][:: -1 if inverse else 1]
        return F.aggregate(F.array(*map(F.lit, order)), F.struct(q["a"].alias("a"), q["b"].alias("b")), step, lambda acc: F.concat(acc["a"], acc["b"]))

    def tabled(at: Column, r: Column) -> Column:
        """A single symbol: the numbers below its radix in the order of their digests."""
        every = F.sequence(F.lit(0).cast("bigint"), r - 1)
        order = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(digest(key, kind, "table", r, x).alias("h"), x.alias("x")))), lambda s: s["x"])
        return F.array((F.array_position(order, at) - 1) if inverse else F.element_at(order, (at + 1).cast("int")))

    def moved(p: Column) -> Column:
        (a, b), (ra, rb) = ends(p, "v"), ends(p, "r")
        halves = F.struct(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"))
        return F.when(F.size(p["v"]) > 1, within(halves, many)).when(F.size(p["v"]) == 1, tabled(p["v"][0], p["r"][0])).otherwise(p["v"])

    return within(F.struct(values.alias("v"), radix.alias("r")), moved)  # each list is made once, not once a symbol


def letters(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def by_class(v: Column, kind: str, key: str, inverse: bool, first_digits: str = "any") -> Column:
    """Permute letters and digits within their class; all else stays. ``first_digits``: "nonzero"
    keeps a first digit other than zero so; "group" keeps the first digit of each group of digits in
    2-9 or in 0-1."""

    def spec(c: Column, i: Column, cs: Column) -> Column:
        """struct(at, base, radix, value) of a symbol."""
        pair = lambda base, radix: F.struct(F.lit(base).cast("bigint").alias("base"), F.lit(radix).cast("bigint").alias("radix"))
        out = F.when(c.between("a", "z"), pair(97, 26)).when(c.between("A", "Z"), pair(65, 26))
        if first_digits == "nonzero":
            out = out.when((i == 0) & c.between("1", "9"), pair(49, 9)).when((i == 0) & (c == "0"), pair(48, 1))
        elif first_digits == "group":
            begins = (i == 0) | ~F.element_at(cs, F.greatest(i, F.lit(1))).between("0", "9")
            out = out.when(begins & c.between("2", "9"), pair(50, 8)).when(begins & c.between("0", "1"), pair(48, 2))
        out = out.when(c.between("0", "9"), pair(48, 10)).otherwise(F.struct(F.ascii(c).cast("bigint").alias("base"), F.lit(1).cast("bigint").alias("radix")))
        return within(out, lambda s: F.struct(i.alias("at"), s["base"].alias("base"), s["radix"].alias("radix"), (F.ascii(c) - s["base"]).cast("bigint").alias("value")))

    def apply(specs: Column) -> Column:
        """The symbols that can move are permuted among themselves and sorted back to their places."""
        return within(F.filter(specs, lambda s: s["radix"] > 1), lambda free: rejoined(specs, free))

    def rejoined(specs: Column, free: Column) -> Column:
        moved = feistel(F.transform(free, lambda s: s["value"]), F.transform(free, lambda s: s["radix"]), kind, key, inverse)
        put = F.zip_with(free, moved, lambda s, x: F.struct(s["at"].alias("at"), F.char(x + s["base"]).alias("c")))
        fixed = F.transform(F.filter(specs, lambda s: s["radix"] == 1), lambda s: F.struct(s["at"].alias("at"), F.char(s["base"]).alias("c")))
        return F.array_join(F.transform(F.array_sort(F.concat(put, fixed)), lambda s: s["c"]), "")

    return within(letters(v), lambda cs: within(F.transform(cs, lambda c, i: spec(c, i, cs)), apply))


def digits(v: Column) -> Column:
    return F.transform(letters(F.regexp_replace(v, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn(ds: Column, doubled: int) -> Column:
    """Luhn sum of digits; ``doubled``: parity, from the right, of the places that count double."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.reverse(ds), lambda d, i: F.when(i % 2 == doubled, twice(d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def mod97(v: Column) -> Column:
    """Remainder by 97 of letters and digits read as in an IBAN."""
    return F.aggregate(letters(v), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def card(v, key, inverse):
    body = by_class(F.substr(v, F.lit(1), F.char_length(v) - 1), "card", key, inverse, "nonzero")
    return F.element_at(F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn(digits(b), 0) % 10) % 10).cast("string"))), 1)


def iban(v, key, inverse):
    def close(b):
        rest = F.concat(F.regexp_replace(b, " ", ""), F.substr(v, F.lit(1), F.lit(2)), F.lit("00"))
        return F.concat(F.substr(v, F.lit(1), F.lit(2)), F.lpad((98 - mod97(rest)).cast("string"), 2, "0"), b)

    return F.element_at(F.transform(F.array(by_class(F.substr(v, F.lit(5)), "iban", key, inverse)), close), 1)


def ip(v, key, inverse):
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("bigint"))
    return F.array_join(F.transform(feistel(parts, F.array(*[F.lit(256).cast("bigint")] * 4), "ip", key, inverse), lambda x: x.cast("string")), ".")


def ssn(v, key, inverse):
    area, group, serial = (F.substr(v, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    at = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    radix = F.array(*(F.lit(r).cast("bigint") for r in (898, 99, 9999)))
    out = F.transform(F.array(feistel(at, radix, "ssn", key, inverse)), lambda x: F.concat_ws("-", F.lpad((x[0] + F.when(x[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((x[1] + 1).cast("string"), 2, "0"), F.lpad((x[2] + 1).cast("string"), 4, "0")))
    return F.element_at(out, 1)


def phone(v, key, inverse):
    code = F.regexp_extract(v, r"^\+(?:1|[0-9]{1,3}(?=[\x20.(-])|[0-9])", 0)
    return F.concat(code, by_class(F.substr(v, F.char_length(code) + 1), "phone", key, inverse, "group"))


def email(v, key, inverse):
    local, host, top = F.regexp_extract(v, "^(.*)@", 1), F.regexp_extract(v, r"@(.*)\.[^.]*$", 1), F.regexp_extract(v, r"(\.[^.]*)$", 1)
    return F.concat(by_class(local, "local", key, inverse), F.lit("@"), by_class(host, "host", key, inverse), top)


def day_of(v: Column) -> Column:
    """struct(y, m, d, form) of a date; null where it is none. Forms: 1 ISO, 2 day first, 3 month first."""
    n = lambda p, g: F.regexp_extract(v, p, g).cast("int")
    iso, other = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$"
    of = lambda y, m, d, form: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(form).alias("form"))

    def real(x: Column) -> Column:
        leap = ((x["y"] % 4 == 0) & (x["y"] % 100 != 0)) | (x["y"] % 400 == 0)
        last = F.when(x["m"] == 2, F.when(leap, 29).otherwise(28)).when(x["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return x["m"].between(1, 12) & (x["d"] >= 1) & (x["d"] <= last)

    options = F.when(v.rlike(iso), F.array(of(n(iso, 1), n(iso, 2), n(iso, 3), 1))).when(v.rlike(other), F.array(of(n(other, 3), n(other, 2), n(other, 1), 2), of(n(other, 3), n(other, 1), n(other, 2), 3)))
    return F.get(F.filter(options, real), F.lit(0))


def factors(n: int) -> tuple[int, int]:
    """n as a product of two numbers as near to each other as its divisors allow."""
    a = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return n // a, a


#: Eras within which dates move: first day, first day after.
ERAS = ("1000-01-01", "1900-01-01", "2100-01-01", "3000-01-01")
#: Months of 31 days, and months with a 30th.
LONG_MONTHS, OTHER_MONTHS = [1, 3, 5, 7, 8, 10, 12], [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def longs(*xs) -> Column:
    return F.array(*(x.cast("bigint") if isinstance(x, Column) else F.lit(x).cast("bigint") for x in xs))


def date(v, key, inverse):
    def in_era(d, start, end):
        a, b = factors((dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days)
        first = F.lit(start).cast("date")
        n = F.datediff(d, first).cast("bigint")
        moved = feistel(longs(F.floor(n / b), n % b), longs(a, b), start, key, inverse)
        return within(moved, lambda p: F.date_add(first, (p[0] * b + p[1]).cast("int")))

    def by_day(x):
        d = F.make_date(x["y"], x["m"], x["d"])
        out = F.lit(None).cast("date")
        for start, end in zip(ERAS, ERAS[1:], strict=False):
            out = F.when((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")), in_era(d, start, end)).otherwise(out)
        return out

    def month_first(x):
        """Only days past the 12th are read so; they stay past it, and in the calendar."""
        index = lambda months: (F.array_position(F.array(*map(F.lit, months)), x["m"]) - 1).cast("bigint")
        pick = lambda months, i: F.element_at(F.array(*map(F.lit, months)), (i + 1).cast("int"))
        of = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        year = x["y"] - 1000
        go = lambda name, values, radix, build: within(feistel(longs(*values), longs(*radix), name, key, inverse), build)
        return (
            F.when(x["d"] <= 28, go("us28", (year, x["m"] - 1, x["d"] - 13), (2000, 12, 16), lambda p: of(p[0] + 1000, p[1] + 1, p[2] + 13)))
            .when(x["d"] == 31, go("us31", (year, index(LONG_MONTHS)), (2000, 7), lambda p: of(p[0] + 1000, pick(LONG_MONTHS, p[1]), F.lit(31))))
            .when(x["m"] != 2, go("us30", (year, index(OTHER_MONTHS), x["d"] - 29), (2000, 11, 2), lambda p: of(p[0] + 1000, pick(OTHER_MONTHS, p[1]), p[2] + 29)))
            .otherwise(go("us29", (F.floor((x["y"] % 100) / 4) - 1,), (24,), lambda p: of(F.when(x["y"] % 100 == 0, x["y"]).otherwise(F.floor(x["y"] / 100) * 100 + 4 * (p[0] + 1)), F.lit(2), F.lit(29))))
        )

    def moved(x):
        mark = F.when(v.contains("/"), "/").otherwise(".")
        pad = lambda n: F.when(F.char_length(v) == 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        day_first = within(by_day(x), lambda d: F.concat(pad(F.dayofmonth(d)), mark, pad(F.month(d)), mark, F.date_format(d, "yyyy")))
        us = within(month_first(x), lambda t: F.concat(pad(t["m"]), mark, pad(t["d"]), mark, t["y"].cast("string")))
        return F.when(x["form"] == 1, F.date_format(by_day(x), "yyyy-MM-dd")).when(x["form"] == 2, day_first).otherwise(us)

    return within(day_of(v), moved)


def kind_of(v: Column) -> Column:
    """The kind of a valid value; null where it is none."""
    n = F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    whole = lambda p: v.rlike(f"^(?:{p})$")
    return (
        F.when(v.contains("@"), "email")
        .when(whole(IBAN) & (mod97(F.regexp_replace(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))), " ", "")) == 1), "iban")
        .when(whole(IP), "ip")
        .when(whole(DATE), F.when(day_of(v).isNotNull(), "date"))
        .when(whole(SSN), F.when(~v.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(PHONE) & n.between(10, 15), "phone")
        .when(whole(CARD) & (luhn(digits(v), 1) % 10 == 0), "card")
    )


def pseudonym(v: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a value of a kind; other values as they are."""
    out = F.when(kind.isNull(), v)
    for name, f in (("email", email), ("iban", iban), ("ip", ip), ("date", date), ("ssn", ssn), ("card", card), ("phone", phone)):
        out = out.when(kind == name, f(v, key, inverse))
    return out


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Per row: id, text with pseudonyms, number of values replaced, their kinds in order."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col).cast("string")
    hot = text.rlike("[0-9]|@") & text.rlike(ANY)
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), text.alias("text"), F.when(hot, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).alias("found"))
    kinds = rows.withColumn("found", F.transform("found", lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind"))))
    moved = kinds.withColumn("new", F.transform("found", lambda x: pseudonym(x["v"], x["kind"], key, inverse)))
    rebuilt = F.array_join(F.zip_with(F.split("text", ANY), "new", lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))), "")
    valid = F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k.isNotNull())
    return moved.select(id_col, F.when(F.col("found").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), F.when(F.col("found").isNull(), 0).otherwise(F.size(valid)).cast("bigint").alias("n_private"), F.coalesce(F.array_join(valid, ","), F.lit("")).alias("kinds"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), QUERY_KEY)
