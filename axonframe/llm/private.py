r"""Personal data: format-preserving Feistel pseudonyms, in DataFrame and SQL operations only.

One pattern finds candidates; each is then validated by kind (Luhn digit, octets, calendar, ISO 7064 for IBAN). What is
valid is permuted within its format by a keyed Feistel network, so equal values get equal pseudonyms in all
documents and different values different ones; what is not valid stays.

 - card: 13 to 19 digits, blanks or hyphens between groups of four or of 4-6-5 and 4-6-4; all but the last digit permuted, Luhn digit made anew
 - iban: letters of the country kept, letters and digits of the account permuted within their kinds, check digits made anew;
   in one piece, or in groups of four with the length of its country
 - phone: + and country code kept, the other digits permuted; also (ddd) ddd-dddd, ddd-ddd-dddd, and national numbers of 9 to 12
   digits with a leading 0, which is kept
 - ssn: ddd-dd-dddd outside of the never assigned ranges; the digits permuted, again and again until they are outside as well
 - ip: four octets, permuted as one 32-bit number; IPv6 addresses with a digit and two groups at least, in full or shortened by
   ::, permuted as 128 bits and written in full
 - date: yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy of the 72,900 days from 1900-01-01, permuted among these days; dd/mm/yyyy with a
   day above 12, permuted among such days; days and months without a leading 0 stay so
 - email: letters and digits before the @ permuted, their case and the domain kept
 - secret: 32 or more hexadecimal digits with a letter and a digit among them, permuted; keys with a known prefix, which is
   kept, their letters and digits permuted within their kinds and cases
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting of the session that holds the key of `op9_pii_pseudonyms`.
KEY_SETTING = "spark.axonframe.pseudonyms.key"
ROUNDS = 8
#: How often a value is permuted again at most until it has a wanted form: it misses it once in 10 ** 16 at the least.
AGAIN = 64
#: Countries by the length of their IBAN, for those printed in groups: their end cannot be told from words that follow.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: The kinds, the one that is tried first leading, each with the pattern of its candidates.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_GROUPED})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,99}|xox[abprs]-[A-Za-z0-9-]{10,99}[A-Za-z0-9])(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![A-Za-z0-9])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9])|(?<![A-Za-z0-9+./-])0[1-9](?:[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,6}){0,2}|(?:[ .-][0-9]{2}){4})(?![A-Za-z0-9/-]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![A-Za-z0-9/-])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])|(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![A-Za-z0-9:])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Stands around what the pattern finds while a text is cut; a character that no text should hold (texts that do are cut otherwise).
MARK = "\ufdd0"
_DAYS, _HALF = 72_900, 270
_LETTERS, _AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(n: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: n as (n div b, n mod b), each side in turn moved by a hash of the other."""

    def step(s: Column, i: Column) -> Column:
        moved = lambda x: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), tweak, i, x).cast("binary"), 256), 1, 14), 16, 10).cast("long")
        left, right = s["l"], s["r"]
        return F.when(i % 2 == 0, F.struct(((left + moved(right) % a) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + moved(left) % b) % b).alias("r")))

    start = F.struct(((n - n % b) / b).cast("long").alias("l"), (n % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _chunk(text: Column, base: int, tweak: Column, key: str) -> Column:
    """A short string of digits of the base, permuted among strings of its length."""
    size = F.length(text)
    half = F.floor(size / 2)
    number = F.conv(text, base, 10).cast("long")
    a, b = (F.round(F.pow(F.lit(float(base)), x)).cast("long") for x in (half, size - half))
    return F.lpad(F.lower(F.conv(feistel(number, a, b, tweak, key).cast("string"), 10, base)), size, "0")


def permuted(text: Column, base: int, kind: str, key: str) -> Column:
    """A string of digits of the base (10, 16 or 26, lower case), permuted among strings of its length, twelve at a time."""
    parts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 12).cast("int"))
    one = lambda i: _chunk(F.substring(text, i * 12 + 1, F.lit(12)), base, F.concat_ws("/", F.lit(f"{kind}{base}"), F.length(text), i), key)
    return F.when(F.length(text) > 0, F.array_join(F.transform(parts, one), "")).otherwise(F.lit(""))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, which: str, new: Column) -> Column:
    """m with its characters of the class `which` replaced by those of new, in order."""
    chars = F.split(m, "")
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), f"[^{which}]", ""))
    return _let(new, lambda n: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{which}]"), F.substring(n, place(i), F.lit(1))).otherwise(c)), ""))


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits, every other one from the right doubled (less nine if above it)."""
    value = lambda d, double: F.when(double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i % 2 == (0 if last_doubled else 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string of capital letters (10 to 35) and digits."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97)


def _cased(m: Column, new: Column) -> Column:
    """new with capitals where m, of the same length, has them."""
    chars = F.split(m, "")
    return F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.get(chars, i).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")


def _swapped(m: Column, kind: str, key: str) -> Column:
    """m with its letters permuted among letters and its digits among digits; places and case stay."""
    letters = F.lower(F.regexp_replace(m, "[^A-Za-z]", ""))
    new = F.translate(permuted(F.translate(letters, _LETTERS, _AS_DIGITS), 26, kind, key), _AS_DIGITS, _LETTERS)
    whole = _refilled(_cased(m, _refilled(m, "A-Za-z", new)), "0-9", permuted(_digits(m), 10, kind, key))
    return F.when(F.length(m) > 0, whole).otherwise(m)


def _again(start: Column, step, done) -> Column:
    """start moved on by step until it is done, which keeps a permutation one among the values that are done."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(AGAIN)), step(start), lambda x, _: F.when(done(x), x).otherwise(step(x)))


def _groups(m: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null if it has too many groups."""
    of = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = of(F.substring_index(m, "::", 1)), of(F.substring_index(m, "::", -1))
    whole = F.when(m.contains("::"), F.when(F.size(left) + F.size(right) <= 7, F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right))).otherwise(F.split(m, ":"))
    return F.when(F.size(whole) == 8, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def _parts_date(m: Column, year: int, month: int, day: int) -> Column:
    parts = F.split(m, "[./]")
    two = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    return F.try_to_date(F.concat_ws("-", F.get(parts, F.lit(year)), two(month), two(day)), "yyyy-MM-dd")


def _month_first(m: Column) -> Column:
    return _parts_date(m, 2, 0, 1)


def _day_first(m: Column) -> Column:
    return _parts_date(m, 2, 1, 0)


def _date_of(m: Column) -> Column:
    return F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.contains("."), _day_first(m)).otherwise(F.coalesce(_month_first(m), _day_first(m)))


def _day(m: Column) -> Column:
    return F.date_diff(_date_of(m), F.lit("1900-01-01").cast("date"))


def _assigned(digits: Column) -> Column:
    """Whether nine digits are outside the ranges of social security numbers that are never assigned."""
    return ~digits.rlike("^(?:000|666|9)|^...00|0000$")


def _valid() -> dict:
    return {
        "email": lambda m: F.lit(True),
        "iban": lambda m: _let(F.replace(m, F.lit(" "), F.lit("")), lambda x: _mod97(F.concat(F.substring(x, 5, 30), F.substring(x, 1, 4))) == 1),
        "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
        "phone": lambda m: F.length(_digits(m)).between(7, 15),
        "card": lambda m: _let(_digits(m), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, False) % 10 == 0) & ~d.rlike("^0+$")),
        "ssn": lambda m: _assigned(_digits(m)),
        "date": lambda m: F.coalesce(_day(m).between(0, _DAYS - 1), F.lit(False)),
        "ip": lambda m: F.when(m.contains(":"), m.rlike("[0-9]") & m.rlike("[0-9A-Fa-f]:+[0-9A-Fa-f]") & _groups(m).isNotNull()).otherwise(~F.exists(F.split(m, r"\."), lambda o: F.try_to_number(o, F.lit("999")) > 255)),
    }


def _pseudonyms(key: str) -> dict:
    def card(m: Column) -> Column:
        body = F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 1)
        whole = _let(permuted(body, 10, "card", key), lambda p: F.concat(p, ((10 - _luhn_sum(p, True) % 10) % 10).cast("string")))
        return _refilled(m, "0-9", whole)

    def iban(m: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = lambda p: F.lpad((98 - _mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0")
        account = F.substring(F.replace(m, F.lit(" "), F.lit("")), 5, 30)
        letters = F.lower(F.regexp_replace(account, "[^A-Z]", ""))
        swapped = F.upper(F.translate(permuted(F.translate(letters, _LETTERS, _AS_DIGITS), 26, "iban", key), _AS_DIGITS, _LETTERS))
        digits = permuted(_digits(account), 10, "iban", key)
        whole = _let(_refilled(_refilled(account, "A-Z", swapped), "0-9", digits), lambda p: F.concat(country, check(p), p))
        return _refilled(m, "A-Z0-9", whole)

    def phone(m: Column) -> Column:
        code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?![0-9])|0)?", 0)
        rest = F.substring(m, F.length(code) + 1, F.lit(40))
        return F.concat(code, _refilled(rest, "0-9", permuted(_digits(rest), 10, "phone", key)))

    def ip(m: Column) -> Column:
        number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
        new = feistel(number, F.lit(1 << 16), F.lit(1 << 16), F.lit("ip"), key)
        four = _let(new, lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255) for s in (24, 16, 8, 0)]))
        eight = _let(permuted(_groups(m), 16, "ip6", key), lambda n: F.concat_ws(":", *[F.substring(n, 4 * i + 1, 4) for i in range(8)]))
        return F.when(m.contains(":"), eight).otherwise(four)

    def date(m: Column) -> Column:
        moved = lambda n: feistel(n, F.lit(_HALF), F.lit(_HALF), F.lit("date"), key)
        on = lambda n: F.date_add(F.lit("1900-01-01").cast("date"), n.cast("int"))
        short = m.rlike("^[0-9][./]|[./][0-9][./]")
        form = lambda n, long, brief: F.when(short, F.date_format(on(n), brief)).otherwise(F.date_format(on(n), long))
        day_first = m.contains("/") & _month_first(m).isNull()  # moved on until the day is above 12 again, so that it reads the same way
        first = _let(_day(m).cast("long"), lambda n: F.when(day_first, _again(n, moved, lambda x: F.dayofmonth(on(x)) > 12)).otherwise(moved(n)))
        made = lambda n: F.when(m.rlike("^[0-9]{4}-"), F.date_format(on(n), "yyyy-MM-dd")).when(m.contains("."), form(n, "dd.MM.yyyy", "d.M.yyyy"))
        return _let(first, lambda n: made(n).when(day_first, form(n, "dd/MM/yyyy", "d/M/yyyy")).otherwise(form(n, "MM/dd/yyyy", "M/d/yyyy")))

    def email(m: Column) -> Column:
        name = F.substring_index(m, "@", 1)
        return F.concat(_swapped(name, "email", key), F.substring(m, F.length(name) + 1, F.lit(400)))

    def secret(m: Column) -> Column:
        new = permuted(F.lower(m), 16, "secret", key)
        prefix = F.regexp_extract(m, "^(AKIA|ASIA|gh[pousr]_|[spr]k_(?:live|test)_|xox[abprs]-)", 0)
        keyed = F.concat(prefix, _swapped(F.substring(m, F.length(prefix) + 1, F.lit(200)), "secret", key))
        return F.when(prefix != "", keyed).when(m == F.lower(m), new).otherwise(F.upper(new))

    def ssn(m: Column) -> Column:
        return _refilled(m, "0-9", _again(_digits(m), lambda d: permuted(d, 10, "ssn", key), _assigned))

    return {
        "email": email, "iban": iban, "secret": secret, "phone": phone, "card": card, "date": date, "ip": ip, "ssn": ssn,
    }


def _judged(m: Column, key: str) -> Column:
    """struct(kind, new) of a candidate: the first kind whose pattern it matches and whose check it passes, else no kind."""
    valid, made = _valid(), _pseudonyms(key)
    out = None
    for kind, pattern in KINDS.items():
        test = m.rlike(f"^(?:{pattern})$") & valid[kind](m)
        value = F.struct(F.lit(kind).alias("kind"), made[kind](m).alias("new"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def pseudonymised(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, text, and n_<kind> for each kind) for each row of docs: the text with its personal data replaced.

    Who has the key can undo the pseudonyms, and with the same key equal values are equal in all runs; an empty key is an error.
    A null text stays null with counts of 0; a text without personal data stays as it is. Repeated rows get the same
    result. Ids may be null; other columns are not read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    has = F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY)
    marked = F.split(F.regexp_replace("text", ANY, f"{MARK}$0{MARK}"), MARK)
    by_mark = F.transform(marked, lambda x, i: F.when(i % 2 == 1, _judged(x, key)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new"))))
    gaps, hits = F.split("text", ANY), F.regexp_extract_all("text", F.lit(ANY), 0)
    other = F.flatten(F.transform(gaps, lambda g, i: F.array(F.struct(F.lit(None).cast("string").alias("kind"), g.alias("new")), F.when(i < F.size(gaps) - 1, _judged(F.get(hits, i), key)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("new"))))))
    parts = F.when(has, F.when(F.col("text").contains(MARK), other).otherwise(by_mark))
    found = rows.select("id", "text", parts.alias("parts"))
    found = found.select("id", F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("text"), F.filter(F.transform("parts", lambda p: p["kind"]), lambda k: k.isNotNull()).alias("kinds"))
    n = lambda kind: F.coalesce(F.size(F.filter("kinds", lambda k: k == kind)), F.lit(0)).cast("long")
    return found.select("id", "text", *[F.when(F.col("kinds").isNull(), F.lit(0)).otherwise(n(k)).cast("long").alias(f"n_{k}") for k in KINDS])


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the key of the session's setting KEY_SETTING; without one, under a key of this run alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs, spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)).withColumnRenamed("id", "doc_id")
