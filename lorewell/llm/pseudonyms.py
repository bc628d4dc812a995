"""Format-preserving Feistel pseudonyms for numbers and dates (operator 3).

DataFrame and SQL functions only. The same value gets the same pseudonym under one key, wherever it stands. Every kind is a
permutation of the valid values of its format, so a pseudonym is valid too, and the same key takes it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import free_name

#: Where a session names the key of the query; without it a key that protects nothing is used, for made-up tables only.
KEY_NAME, OPEN_KEY = "spark.lorewell.pseudonyms.key", "no secret"
ROUNDS = 8
#: Days permute among themselves within a Gregorian cycle of 400 years, 189 * 773 days, counted from the year 1; the last cycle
#: ends with the year 9999 and has 93 * 1567.
CYCLE, DAY_A, DAY_B, LAST_CYCLE, LAST_A, LAST_B = 146097, 189, 773, 24, 93, 1567
DAY_ZERO = "0001-01-01"
#: Valid social security numbers: areas 1 to 899 but 666, then groups 1 to 99 by serials 1 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999

# What is looked for. Longer forms come first.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+\d{1,3} ?)?\(\d{3}\) ?\d{3}-\d{4}"
ISO_DATE, DOT_DATE, US_DATE = r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}/\d{2}/\d{4}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
# a number does not start or end within a longer one
PATTERN = rf"{EMAIL}|{PHONE}|(?<![\w.-])(?:{ISO_DATE}|{DOT_DATE}|{US_DATE}|{IP}|{SSN}|{CARD})(?![\w-]|\.\d)"


def _round(key: str, tweak: Column, i: Column, half: Column, mod: Column) -> Column:
    """The keyed round function: 60 bits of SHA-256, reduced."""
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)").cast("long"), mod)


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, tweak: Column, key: str) -> Column:
    """struct(a, b): a keyed permutation of pairs with 0 <= a < mod_a and 0 <= b < mod_b."""

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["a"] + _round(key, tweak, i, s["b"], mod_a), mod_a)
        right = F.pmod(s["b"] + _round(key, tweak, i, s["a"], mod_b), mod_b)
        return F.when(i % 2 == 0, F.struct(left.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def unfeistel(a: Column, b: Column, mod_a: Column, mod_b: Column, tweak: Column, key: str) -> Column:
    """The inverse of feistel()."""

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["a"] - _round(key, tweak, i, s["b"], mod_a), mod_a)
        right = F.pmod(s["b"] - _round(key, tweak, i, s["a"], mod_b), mod_b)
        return F.when(i % 2 == 0, F.struct(left.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of the digit strings of one length (2 to 36 digits)."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    tweak = F.concat(F.lit(f"{kind}:"), n.cast("string"))
    f = unfeistel if inverse else feistel
    s = f(F.left(digits, u).cast("long"), F.right(digits, v).cast("long"), power(u), power(v), tweak, key)
    return F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0"))


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once."""
    both = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def card(value: Column, key: str, inverse: bool = False) -> Column:
    """All digits but the last permute; the last is the check digit of the others."""
    d = only_digits(value)
    head = permute_digits(F.left(d, F.char_length(d) - 1), "card", key, inverse)
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(head, F.lit("0"))) % 10, F.lit(10))
    return refill(value, F.concat(head, check.cast("string")))


def ssn(value: Column, key: str, inverse: bool = False) -> Column:
    """Areas, and groups with serials, permute among the valid ones."""
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    f = unfeistel if inverse else feistel
    s = f(area - 1 - (area > 666).cast("long"), (group - 1) * SERIALS + serial - 1, F.lit(AREAS).cast("long"), F.lit(GROUPS * SERIALS).cast("long"), F.lit("ssn"), key)
    new_area = s["a"] + 1 + (s["a"] >= 665).cast("long")
    return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / SERIALS) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % SERIALS + 1).cast("string"), 4, "0"))


def phone(value: Column, key: str, inverse: bool = False) -> Column:
    """The ten digits permute; what stands ahead of them, a country's code, stays."""
    ahead = F.substring_index(value, "(", 1)
    own = F.substring(value, F.char_length(ahead) + 1, F.char_length(value))
    return F.concat(ahead, refill(own, permute_digits(only_digits(own), "phone", key, inverse)))


def ip(value: Column, key: str, inverse: bool = False) -> Column:
    """The 32 bits permute."""
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    f = unfeistel if inverse else feistel
    s = f(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.lit("ip"), key)
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])


def day(date: Column, key: str, inverse: bool = False) -> Column:
    """A day of the same cycle, of the years 1 to 9999; one permutation for all formats."""
    number = F.date_diff(date, F.lit(DAY_ZERO).cast("date")).cast("long")
    cycle = F.floor(number / CYCLE)
    rest = number - cycle * CYCLE
    is_last = cycle == LAST_CYCLE
    mod_a, mod_b = (F.when(is_last, F.lit(x)).otherwise(F.lit(y)).cast("long") for x, y in ((LAST_A, DAY_A), (LAST_B, DAY_B)))
    f = unfeistel if inverse else feistel
    s = f(F.floor(rest / mod_b), rest % mod_b, mod_a, mod_b, F.lit("day"), key)
    return F.date_add(F.lit(DAY_ZERO).cast("date"), (cycle * CYCLE + s["a"] * mod_b + s["b"]).cast("int"))


def email(value: Column, key: str, inverse: bool = False) -> Column:
    """Digits and letters of the local part permute within their kinds, in blocks of 10; the domain stays."""
    local = F.substring_index(value, "@", 1)
    letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))
    digits = only_digits(local)
    f = unfeistel if inverse else feistel
    power = lambda k, radix: F.round(F.pow(F.lit(float(radix)), k)).cast("long")

    def number(text: Column) -> Column:
        return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 97)

    def text_of(x: Column, n: Column) -> Column:
        return F.when(n > 0, F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.chr((F.pmod(F.floor(x / power(i, 26)), F.lit(26)) + 97).cast("long"))), "")).otherwise("")

    def block(i: Column) -> Column:
        part = F.substring(letters, i * 20 + 1, F.lit(20))
        n = F.char_length(part)
        u = F.floor(n / 2).cast("int")
        s = f(F.when(u > 0, number(F.left(part, u))).otherwise(0), number(F.right(part, n - u)), power(u, 26), power(n - u, 26), F.concat(F.lit("mail:"), n.cast("string")), key)
        return F.concat(text_of(s["a"], u), text_of(s["b"], n - u))

    n_blocks = F.ceil(F.char_length(letters) / 20).cast("int")
    new_letters = F.when(n_blocks > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1), block), "")).otherwise("")

    def digit_block(i: Column) -> Column:
        part = F.substring(digits, i * 18 + 1, F.lit(18))
        n = F.char_length(part)
        one = f(F.lit(0), part.cast("long"), F.lit(1).cast("long"), F.lit(10).cast("long"), F.lit("mail1"), key)["b"].cast("string")
        return F.when(n == 1, one).otherwise(permute_digits(part, "mail", key, inverse))

    d_blocks = F.ceil(F.char_length(digits) / 18).cast("int")
    new_digits = F.when(d_blocks > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(d_blocks, F.lit(1)) - 1), digit_block), "")).otherwise("")

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"), F.lit(1).alias("d"))

    def step(s: Column, c: Column) -> Column:
        letter, digit = c.rlike("^[A-Za-z]$"), c.rlike("^[0-9]$")
        plain = F.substring(new_letters, s["k"], F.lit(1))
        put = F.when(letter, F.when(c.rlike("^[A-Z]$"), F.upper(plain)).otherwise(plain)).when(digit, F.substring(new_digits, s["d"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], put).alias("out"), (s["k"] + letter.cast("int")).alias("k"), (s["d"] + digit.cast("int")).alias("d"))

    return F.concat(F.aggregate(F.split(local, ""), start, step, lambda s: s["out"]), F.lit("@"), F.substring_index(value, "@", -1))


def _date(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(value, F.lit(pattern)).cast("date")


def kind_of(value: Column) -> Column:
    """The kind of a valid value, null for what only looks like one: cards pass the Luhn test, octets are below 256 and have no
    leading zero, dates exist, social security numbers have an area, a group and a serial that are given out."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), "email")
        .when(whole(PHONE), "phone")
        .when(whole(ISO_DATE), F.when(_date(value, "yyyy-MM-dd").isNotNull(), "iso_date"))
        .when(whole(DOT_DATE), F.when(_date(value, "dd.MM.yyyy").isNotNull(), "dot_date"))
        .when(whole(US_DATE), F.when(_date(value, "MM/dd/yyyy").isNotNull(), "us_date"))
        .when(whole(IP), F.when(F.forall(octets, lambda x: (x.cast("int") < 256) & ~x.rlike("^0.")), "ip"))
        .when(whole(SSN), F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(CARD), F.when(luhn_sum(only_digits(value)) % 10 == 0, "card"))
    )


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    return (
        F.when(kind == "email", email(value, key, inverse))
        .when(kind == "phone", phone(value, key, inverse))
        .when(kind == "iso_date", F.date_format(day(_date(value, "yyyy-MM-dd"), key, inverse), "yyyy-MM-dd"))
        .when(kind == "dot_date", F.date_format(day(_date(value, "dd.MM.yyyy"), key, inverse), "dd.MM.yyyy"))
        .when(kind == "us_date", F.date_format(day(_date(value, "MM/dd/yyyy"), key, inverse), "MM/dd/yyyy"))
        .when(kind == "ip", ip(value, key, inverse))
        .when(kind == "ssn", ssn(value, key, inverse))
        .when(kind == "card", card(value, key, inverse))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """All columns, text with every valid value replaced, and found: its (kind, value, pseudonym) in order of place.

    What only looks like a value stays. A null text stays null with nothing found, repeated rows are treated alike, an empty
    table gives no row; inverse undoes the same key's work. Columns of any name stay; where docs has found, the new one is
    named found_ (with as many underscores as it takes).
    """
    into = free_name(docs.columns, "found")
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    raw = F.when(has, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = [free_name([*docs.columns, into], n) for n in ("raw", "kinds", "all")]
    one, two, three = names
    kinds = F.transform(one, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value")))
    found = F.transform(two, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.when(x["kind"].isNotNull(), pseudonym(x["value"], x["kind"], key, inverse)).otherwise(x["value"]).alias("pseudonym")))
    # the text between values, each followed by its replacement
    between = F.split("text", PATTERN, -1)
    woven = F.array_join(F.zip_with(between, F.transform(three, lambda x: x["pseudonym"]), lambda s, p: F.concat(s, F.coalesce(p, F.lit("")))), "")
    out = docs.withColumn(one, raw).withColumn(two, kinds).withColumn(three, found)
    return out.withColumn("text", F.when(F.size(one) > 0, woven).otherwise(F.col("text"))).withColumn(into, F.filter(three, lambda x: x["kind"].isNotNull())).drop(*names)


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of their valid numbers, dates and addresses."""
    from lorewell.session import table

    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_NAME, OPEN_KEY))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")
