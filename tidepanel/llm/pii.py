"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Validated numbers and dates are permuted by a keyed Feistel network on their own
value range, so the result has the same format, is valid again, and equal values
get equal pseudonyms in every document while different values stay different:

* card numbers (13 to 19 digits that pass the Luhn check): all digits but the last, which is the check digit of the result
* telephone numbers with a country code (+ or 00), in any grouping, or of ten digits with an area code in brackets or
  three groups: the last ten digits, so that the forms of one number stay linked
* IPv4 addresses with octets up to 255: all 32 bits
* dates (year-month-day, day.month.year or day/month/year, 1700 to 2099): the days of these 400 years

Mail addresses keep their domain and secrets (a key word, a sign and 16 or more
characters) their length; what goes is replaced by a keyed hash.

A round adds a keyed SHA-256 of one half to the other, modulo that half's range;
ranges need not be equal, and no range has to be walked in cycles.

A run of digit groups, each a space or hyphen from the next, may hold a card number
beside other numbers. Any of its sequences of whole groups can be one: those of a
usual form (a single group, 4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4) come first, then the
longer, then the earlier; those that overlap with one taken are not. Digits inside
a longer undivided group are not a card number.

Defined results
* A null text is empty. Numbers that fail their check, and all other text, stay as they are.
* Rows that repeat an id are rewritten row by row. An empty table gives an empty result.
* Other columns stay as they are in ``pseudonymised``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What may follow a group of a run of digits, and dates and addresses, which are no part of one.
_WHOLE = r"(?![\p{L}\p{N}]|\.\d)"
_OTHER = r"(?!\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}/-])|\d{2}[./]\d{2}[./]\d{4})"
# The patterns of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?i:token|secret|password|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_-]{16,}",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3} ?\(\d{3}\) ?\d{3}[ -]?\d{4}(?!\d)",
    "date": r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}/-])",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    "tel": r"(?<![\p{L}\p{N}+])(?:\+|(?<![.-])00)(?=(?:[ .()/-]{0,2}\d){8,15}(?![ -]?\d))\d{1,4}(?:[ .()/-]{0,2}\d)++(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}]|[ .-]\d)",
    "card": rf"(?<![\p{{L}}\p{{N}}.])(?=\d(?:[ -]?\d){{12}})\d++{_WHOLE}(?:[ -]{_OTHER}\d++{_WHOLE})*+",
}
_ANY = "|".join(PATTERNS.values())
_FIRST_DAY, _DAYS = "1700-01-01", (189, 773)  # 400 Gregorian years are 146,097 = 189 * 773 days


def keyed(key: str, *parts: Column) -> Column:
    """A number below 2**60 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of the pairs with ``left`` below ``a`` and ``right`` below ``b``, as a struct (l, r)."""

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(i % 2 == 0, F.struct(((l + keyed(key, F.lit(kind), i, a, r) % a) % a).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), ((r + keyed(key, F.lit(kind), i, b, l) % b) % b).alias("r"))
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    term = lambda i: F.when((n - i) % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i))


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of as many digits (2 to 18)."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    moved = feistel(F.substring(digits, F.lit(1), half).cast("bigint"), F.substring(digits, half + 1, n).cast("bigint"), power(half), power(n - half), key, kind)
    return let(moved, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))


def new_card(match: Column, key: str) -> Column:
    def renewed(digits: Column) -> Column:
        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    def taken(groups: Column) -> Column:
        """The sequences of groups ``a`` to ``b`` (from 0) that are card numbers, with their digits."""

        def numbers(i: Column) -> Column:
            def number(j: Column) -> Column:
                parts = F.slice(groups, i + 1, j - i + 1)
                form = F.array_join(F.transform(parts, lambda g: F.length(g).cast("string")), "-")
                usual = (i == j) | form.isin("4-4-4-4", "4-4-4-4-3", "4-6-5", "4-6-4")
                digits = F.array_join(parts, "")
                return F.struct(F.when(usual, 0).otherwise(1).alias("rank"), (-F.length(digits)).alias("less"), i.alias("a"), j.alias("b"), digits.alias("digits"))

            valid = lambda c: c["less"].between(-19, -13) & (luhn_sum(c["digits"]) % 10 == 0)
            # A sequence of more than 19 groups has too many digits.
            return F.filter(F.transform(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), number), valid)

        best = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), numbers)))
        none = F.filter(best, lambda c: F.lit(False))
        apart = lambda c, others: ~F.exists(others, lambda o: (o["a"] <= c["b"]) & (c["a"] <= o["b"]))
        return F.aggregate(best, none, lambda s, c: F.when(apart(c, s), F.concat(s, F.array(c))).otherwise(s))

    def put(groups: Column, cards: Column) -> Column:
        def group(g: Column, i: Column) -> Column:
            card = F.get(F.filter(cards, lambda c: (c["a"] <= i) & (i <= c["b"])), F.lit(0))
            before = lambda c: F.length(F.array_join(F.slice(groups, c["a"] + 1, i - c["a"]), ""))
            return let(card, lambda c: F.when(c.isNull(), g).otherwise(F.substring(c["new"], before(c) + 1, F.length(g))))

        return F.array_join(F.zip_with(F.transform(groups, group), F.regexp_extract_all(match, F.lit("[ -]"), F.lit(0)), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")

    def whole(groups: Column) -> Column:
        new = lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), renewed(c["digits"]).alias("new"))
        return let(F.transform(taken(groups), new), lambda cards: F.when(F.size(cards) > 0, put(groups, cards)).otherwise(match))

    return let(F.regexp_extract_all(match, F.lit(r"\d+"), F.lit(0)), whole)


def new_tel(match: Column, key: str) -> Column:
    """The last ten digits are permuted (all after the sign, if there are fewer)."""

    def renewed(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 10, F.lit(0))
        return refilled(match, F.concat(F.substring(digits, F.lit(1), kept), permuted_digits(F.substring(digits, kept + 1, F.length(digits)), key, "phone")))

    return let(digits_of(match), renewed)


def new_phone(match: Column, key: str) -> Column:
    open_ = F.locate("(", match)
    rest = F.substring(match, open_, F.length(match))
    return F.concat(F.substring(match, F.lit(1), open_ - 1), refilled(rest, permuted_digits(digits_of(rest), key, "phone")))


def new_ip(match: Column, key: str) -> Column:
    def renewed(o: Column) -> Column:
        high, low = F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))
        size = F.lit(65536).cast("bigint")
        moved = feistel(high, low, size, size, key, "ip")
        byte = lambda v, k: (F.shiftright(v, k).bitwiseAND(255)).cast("string")
        new = let(moved, lambda s: F.concat_ws(".", byte(s["l"], 8), byte(s["l"], 0), byte(s["r"], 8), byte(s["r"], 0)))
        return F.when(F.array_max(o) <= 255, new).otherwise(match)

    return let(F.transform(F.split(match, r"\."), lambda x: x.cast("int")), renewed)


def new_date(match: Column, key: str) -> Column:
    sign = F.regexp_extract(match, r"\D", 0)
    fields = F.transform(F.split(match, r"\D"), lambda x: x.cast("int"))

    def renewed(f: Column) -> Column:
        first, month, last = F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2))
        year, day = F.when(sign == "-", first).otherwise(last), F.when(sign == "-", last).otherwise(first)
        iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        valid = year.between(1700, 2099) & F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull()
        n = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_FIRST_DAY).cast("date"))
        a, b = (F.lit(x).cast("bigint") for x in _DAYS)
        moved = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], a, b, key, "date")
        day_of = let(moved, lambda s: F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")))
        shape = F.when(sign == "-", "yyyy-MM-dd").when(sign == ".", "dd.MM.yyyy").otherwise("dd/MM/yyyy")
        written = let(day_of, lambda d: F.when(sign == "-", F.date_format(d, "yyyy-MM-dd")).when(sign == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))
        return F.when(valid & shape.isNotNull(), written).otherwise(match)

    return let(fields, renewed)


def new_email(match: Column, key: str) -> Column:
    at = F.locate("@", match)
    local = F.lower(F.substring(match, F.lit(1), at - 1))
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local, F.lower(match)), 256), 1, 16), F.substring(match, at, F.length(match)))


def new_secret(match: Column, key: str) -> Column:
    value = F.regexp_extract(match, r"[A-Za-z0-9_-]+$", 0)
    hashed = lambda v: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), v), 512)
    grown = F.when(F.length(value) <= 128, F.substring(hashed(value), F.lit(1), F.length(value))).otherwise(F.rpad(hashed(value), F.length(value), "0"))
    return F.concat(F.substring(match, F.lit(1), F.length(match) - F.length(value)), grown)


_NEW = {"email": new_email, "secret": new_secret, "phone": new_phone, "date": new_date, "ip": new_ip, "tel": new_tel, "card": new_card}


def renewed(match: Column, key: str) -> Column:
    out = match
    for kind in reversed(PATTERNS):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), _NEW[kind](match, key)).otherwise(out)
    return out


def replaced(text: Column, key: str) -> Column:
    """(text, n): the text with pseudonyms in the place of personal data, and how many were put in."""
    found = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    new = F.transform(found, lambda m: renewed(m, key))
    joined = lambda n: F.array_join(F.zip_with(F.split(text, _ANY, -1), n, lambda part, m: F.concat(part, F.coalesce(m, F.lit("")))), "")
    changed = lambda n: F.size(F.filter(F.zip_with(found, n, lambda a, b: a != b), lambda x: x))
    whole = let(new, lambda n: F.struct(joined(n).alias("text"), changed(n).cast("bigint").alias("n")))
    return F.when(text.rlike(r"[0-9@=:]"), whole).otherwise(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten; all columns kept, no shuffle and no Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(text_col, replaced(text, key)["text"])
