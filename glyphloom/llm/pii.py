"""Format-preserving pseudonyms of personal data, as column expressions only.

One pattern finds candidates, each kind validates its own (check digits, ranges, calendar),
and a keyed Feistel network permutes what is valid inside its format: digits stay digits,
check digits are made anew, dates stay dates. Equal values get equal pseudonyms in every
document, and the key's holder can invert them. Text around a value isn't touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEMO_KEY = "glyphloom-demo-key"
"""For tests and the registered query; a deployment passes its own secret."""

# The shapes of candidates, in order of trial.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++\.(?!\.)[A-Za-z0-9.-]*[A-Za-z0-9-]"
"""The domain is one run of characters, for a repeated group would take the matcher one call deeper with every label; two dots end it later."""
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 33: "RU",
}
"""Countries by their IBANs' length."""


def _iban_form(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


OF_COUNTRY = "|".join(_iban_form(*item) for item in IBAN_LENGTHS.items())
OTHER_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IBAN = f"(?<![A-Za-z0-9])(?:(?:{OF_COUNTRY})(?![A-Za-z0-9])|{OTHER_IBAN}(?![A-Za-z0-9]))"
HEX = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./-])[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE_FORMS = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\(0\) ?)?[0-9]{1,3}|0[0-9])(?:[ .-][0-9]{2}){3,4}(?![0-9])",
    r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\) ?|[0-9]{1,5}[ ./-])[0-9]{4,9}(?![0-9])",
    r"\+[0-9]{8,15}(?![0-9])",
)
PHONE = "|".join(PHONE_FORMS)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*[0-9](?![0-9])(?!(?<=[ -][0-9]{1,3})[./][0-9])"
"""A run of digit groups, in which cards stand."""
CARD_SHAPES = {
    9: r"[0-9]{4}([ -])(?:[0-9]{4}\1){3}[0-9]{3}",
    7: r"[0-9]{4}([ -])(?:[0-9]{4}\1){2}[0-9]{4}|[0-9]{4}([ -])[0-9]{3}\2[0-9]{3}\2[0-9]{3}",
    5: r"[0-9]{4}([ -])(?:[0-9]{6}\1[0-9]{4,5}|[0-9]{5}\1[0-9]{6}|[0-9]{4}\1[0-9]{5})",
    3: r"[0-9]{6}[ -][0-9]{13}",
    1: r"[0-9]{13,19}",
}
"""Issued groupings of cards by their number of groups and separators; a card has one kind of separator."""
WHOLE_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
FORMS = {"email": EMAIL, "iban": IBAN, "hex": HEX, "iso": ISO_DATE, "day": DAY_DATE, "ip": IPV4, "ssn": SSN, "card": CARD, "phone": PHONE}


def any_of(kinds: list[str]) -> str:
    return "|".join(f"(?:{FORMS[kind]})" for kind in kinds)


ANY = any_of(list(FORMS))  # the one capturing group is the day date's mark
SOME = "[0-9@]"
"""Every shape holds one of these; a scan for them alone is many times faster than for the shapes."""
FIRST_DAY, DAYS, DAY_PARTS = "1800-01-01", 146_097, (189, 773)
"""The first day of a calendar cycle of 400 years, and its days, which are a product of two numbers."""
HALF_CYCLE, LOWEST, HIGHEST = 73_048, -5, 20
"""Days of the first 200 years; the cycles of which only the years 0 to 199 and 9800 to 9999 have four digits."""


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A permutation of pairs (left < a, right < b): each round adds a keyed hash of one half to the other."""

    def round_(halves: Column, i: Column) -> Column:
        def noise(half: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
            return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

        even = F.struct(((halves["l"] + noise(halves["r"]) % a) % a).alias("l"), halves["r"].alias("r"))
        odd = F.struct(halves["l"].alias("l"), ((halves["r"] + noise(halves["l"]) % b) % b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """A string of up to 36 decimal digits as another of the same length."""

    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10), k).cast("decimal(20,0)").cast("long")
    out = feistel(digits.substr(F.lit(1), half), digits.substr(half + 1, n), size(half), size(n - half), F.concat_ws("|", tweak, n.cast("string")), key)
    return F.concat(F.lpad(out["l"].cast("string"), half, "0"), F.lpad(out["r"].cast("string"), n - half, "0"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits, from the left, replaced by ``digits``."""

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(state: Column, char: Column) -> Column:
        digit = char.rlike("[0-9]")
        return F.struct(
            F.concat(state["out"], F.when(digit, digits.substr(state["at"], F.lit(1))).otherwise(char)).alias("out"),
            (state["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(value, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column, first_double: int) -> Column:
    """Luhn sum from the right; ``first_double`` is the place from the right, 0 or 1, that is doubled first."""

    reverse = F.split(F.reverse(digits), "")
    values = F.transform(reverse, lambda c, i: F.when(i % 2 == first_double, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def mod97(text: Column) -> Column:
    """Remainder of an IBAN's number, letters counting as 10 to 35."""

    def add(rest: Column, char: Column) -> Column:
        letter = F.ascii(char) - 55
        return F.when(char.rlike("[0-9]"), (rest * 10 + F.coalesce(char.try_cast("int"), F.lit(0))) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _email(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("user"), F.substring(digest, 1, 16), F.lit("@mail.invalid"))


def _valid_card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), F.lit("card"), key)
    check = (10 - luhn_sum(body, 0) % 10) % 10
    return F.when(luhn_sum(digits, 1) % 10 == 0, refilled(value, F.concat(body, check.cast("string"))))


def _cards(value: Column, key: str) -> Column:
    """A run's pieces: the cards in it replaced, wherever their groups begin, and the candidates of other kinds between them.

    A run without a card of an issued grouping is one if it has a card's length and check digit.
    """

    def split(tokens: Column) -> Column:
        # (first token, tokens) of every card; "at" is the first token that is in none.
        none = F.array().cast("array<struct<i:int,size:int>>")

        def window(i: Column, size: Column | int) -> Column:
            return F.array_join(F.slice(tokens, i, size), "")

        def step(state: Column, i: Column) -> Column:
            sizes = [F.when(window(i, k).rlike(f"^(?:{shape})$") & (luhn_sum(digits_of(window(i, k)), 1) % 10 == 0), F.lit(k)) for k, shape in CARD_SHAPES.items()]

            def put(size: Column) -> Column:
                cards = F.concat(state["cards"], F.array(F.struct(i.alias("i"), size.alias("size"))))
                return F.when(size > 0, F.struct(cards.alias("cards"), (i + size).alias("at"))).otherwise(state)

            return F.when(i < state["at"], state).otherwise(_let(F.coalesce(*sizes, F.lit(0)), put))

        def in_turn(cards: Column) -> Column:
            """Text, card, text, ..., text."""

            end = lambda k: F.coalesce(F.get(cards, k)["i"] + F.get(cards, k)["size"], F.lit(1))
            turns = F.transform(cards, lambda c, k: F.array(window(end(k - 1), c["i"] - end(k - 1)), window(c["i"], c["size"])))
            last = end(F.size(cards) - 1)
            return F.concat(F.flatten(turns), F.array(window(last, F.size(tokens) - last + 1)))

        start = F.struct(none.alias("cards"), F.lit(1).alias("at"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, lambda s: s["cards"]), in_turn)

    def whole(pieces: Column) -> Column:
        valid = value.rlike(f"^{WHOLE_CARD}$") & (luhn_sum(digits_of(value), 1) % 10 == 0)
        return F.when((F.size(pieces) == 1) & valid, F.array(F.lit(""), value, F.lit(""))).otherwise(pieces)

    pieces = _let(_let(F.regexp_extract_all(value, F.lit("([0-9]+|[ -]+)"), F.lit(1)), split), whole)
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(_piece(_valid_card(p, key), n=1))).otherwise(_cut(p, OTHERS))))


def _iban(value: Column, key: str) -> Column:
    bare = F.regexp_replace(value, " ", "")
    country, account = F.substring(bare, 1, 2), bare.substr(F.lit(5), F.length(bare))
    number = digits_of(account)
    changed = refilled(account, permuted_digits(number, F.lit("iban"), key))
    check = F.lpad((98 - mod97(F.concat(changed, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(check, digits_of(changed))
    valid = (mod97(F.concat(account, F.substring(bare, 1, 4))) == 1) & (F.length(number) >= 6)
    return F.when(valid, refilled(value, whole))


def _hex(value: Column, key: str) -> Column:
    """Runs of 24 hexadecimal digits, each permuted in its place."""

    low = F.lower(value)
    parts = F.sequence(F.lit(0), F.ceil(F.length(low) / 24).cast("int") - 1)
    number = lambda s: F.coalesce(F.conv(s, 16, 10).cast("long"), F.lit(0))

    def part(i: Column) -> Column:
        run = low.substr(i * 24 + 1, F.lit(24))
        n = F.length(run)
        half = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(16), k).cast("long")
        out = feistel(number(run.substr(F.lit(1), half)), number(run.substr(half + 1, n)), size(half), size(n - half), F.concat_ws("|", F.lit("hex"), i.cast("string"), n.cast("string")), key)
        return F.concat(F.lpad(F.hex(out["l"]), half, "0"), F.lpad(F.hex(out["r"]), n - half, "0"))

    changed = F.array_join(F.transform(parts, part), "")
    return F.when(value == low, F.lower(changed)).otherwise(F.upper(changed))


def _moved_day(day: Column, key: str) -> Column:
    """Another day of the date's own cycle of 400 years. The first and the last half cycle of four-digit years are one."""

    a, b = DAY_PARTS
    start = F.lit(FIRST_DAY).cast("date")
    days = F.datediff(day, start)
    cycle, at = F.floor(days / DAYS), F.pmod(days, F.lit(DAYS))
    out = feistel(F.floor(at / b), at % b, F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit("date"), key)
    new = out["l"] * b + out["r"]
    edge = F.when(new < HALF_CYCLE, F.lit(HIGHEST)).otherwise(F.lit(LOWEST))
    own = F.when(cycle.isin(LOWEST, HIGHEST), edge).otherwise(cycle)
    return F.date_add(start, (own * DAYS + new).cast("int"))


def _iso_date(value: Column, key: str) -> Column:
    return F.date_format(_moved_day(value.try_cast("date"), key), "yyyy-MM-dd")


def _day_date(value: Column, key: str) -> Column:
    """Slashes: month first if that is a date, else day first. Dots and hyphens: day first. Two digits for day and month."""

    parts = F.split(value, "[./-]")
    mark = F.regexp_extract(value, "[./-]", 0)
    one, two = F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0")
    month_first = F.concat_ws("-", parts[2], one, two).try_cast("date")
    day_first = F.concat_ws("-", parts[2], two, one).try_cast("date")
    as_month = (mark == "/") & month_first.isNotNull()
    moved = _moved_day(F.when(as_month, month_first).otherwise(day_first), key)
    day, month = F.date_format(moved, "dd"), F.date_format(moved, "MM")
    return F.concat_ws("", F.when(as_month, month).otherwise(day), mark, F.when(as_month, day).otherwise(month), mark, F.date_format(moved, "yyyy"))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    out = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.lit("ip"), key)
    text = F.concat_ws(".", F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256)
    return F.when(F.array_max(parts) <= 255, text)


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    area, group, serial = (F.split(value, "-")[k].cast("long") for k in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("long")
    out = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), F.lit("ssn"), key)
    new = F.floor(out["l"] / 99) + 1
    new = new + (new >= 666).cast("long")
    three = F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((out["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((out["r"] + 1).cast("string"), 4, "0"))
    return F.when(valid, three)


def _phone(value: Column, key: str) -> Column:
    """All digits after a country code; numbers of 7 to 15 digits."""

    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = value.substr(F.length(country) + 1, F.length(value))
    digits = digits_of(rest)
    return F.when(F.length(digits).between(7, 15), F.concat(country, refilled(rest, permuted_digits(digits, F.lit("phone"), key))))


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "iban": _iban, "hex": _hex, "iso": _iso_date, "day": _day_date, "ip": _ip, "ssn": _ssn, "phone": _phone,
}
OTHERS = [kind for kind in FORMS if kind not in ("iban", "card")]
"""Kinds looked for beside cards in a run of digit groups."""
IN_IBAN = [kind for kind in FORMS if kind != "iban"]
"""Kinds looked for in what has an IBAN's shape but not its check digits."""


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""

    return F.element_at(F.transform(F.array(value), then), 1)


def _piece(text: Column, n: int = 0, candidate: bool = False) -> Column:
    return F.struct(F.lit(n).alias("n"), text.alias("text"), F.lit(candidate).alias("candidate"))


def _cut(value: Column, kinds: list[str]) -> Column:
    """The text cut at its candidates, as an array of pieces."""

    form = any_of(kinds)
    found = F.transform(F.regexp_extract_all(value, F.lit(form), F.lit(0)), lambda v: _piece(v, candidate=True))
    between = F.transform(F.split(value, form, -1), lambda t: _piece(t))
    return F.flatten(F.zip_with(between, found, lambda p, c: F.array(p, F.coalesce(c, _piece(F.lit(""))))))


def _each(pieces: Column, then: Callable[[Column], Column]) -> Column:
    """Every candidate replaced by its pieces."""

    return F.flatten(F.transform(pieces, lambda p: F.when(p["candidate"], then(p["text"])).otherwise(F.array(p))))


def _made(value: Column, new: Column, otherwise: Callable[[], Column]) -> Column:
    return _let(new, lambda v: F.when(v.isNotNull(), F.array(F.struct((v != value).cast("int").alias("n"), v.alias("text"), F.lit(False).alias("candidate")))).otherwise(otherwise()))


def _shaped(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{FORMS[kind]})$")


def replaced(value: Column, key: str) -> Column:
    """The text's pieces, (n, text, candidate) each, n being 1 where a value was replaced.

    A candidate is of the first kind whose shape it has whole and whose check it passes. Runs
    of digit groups and the rest of a failed IBAN are searched for the values in them first.
    """

    def mail(v: Column) -> Column:
        head = F.substring_index(v, "..", 1)
        parted = v.contains("@") & v.contains("..") & head.contains("@")
        rest = v.substr(F.length(head) + 1, F.length(v))
        return F.when(parted, F.concat(F.array(_piece(head, candidate=True)), _cut(rest, list(FORMS)))).otherwise(F.array(_piece(v, candidate=True)))

    def iban(v: Column) -> Column:
        failed = lambda: F.concat(F.array(_piece(F.substring(v, 1, 4))), _cut(v.substr(F.lit(5), F.length(v)), IN_IBAN))
        return F.when(_shaped(v, "iban"), _made(v, _iban(v, key), failed)).otherwise(F.array(_piece(v, candidate=True)))

    def other(v: Column) -> Column:
        tried = [F.when(_shaped(v, kind), KINDS[kind](v, key)) for kind in OTHERS]
        return _made(v, F.coalesce(*tried), lambda: F.array(_piece(v)))

    def card(v: Column) -> Column:
        first = [kind for kind in FORMS if kind not in ("iban", "card", "phone")]
        earlier = v.rlike(f"^(?:{any_of(first)})$")
        return F.when(_shaped(v, "card") & ~earlier, _cards(v, key)).otherwise(F.array(_piece(v, candidate=True)))

    return _each(_each(_each(_each(_cut(value, list(FORMS)), mail), iban), card), other)


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with all columns, ``text`` with pseudonyms; ``found`` names a column for the number of values replaced.

    A text is cut at its candidates, which are replaced and put back between the cuts; texts
    without one aren't cut. Null stays null. Rows keep their partition.
    """

    value = F.col(text)
    hit = value.rlike(SOME) & value.rlike(ANY)

    def joined(pieces: Column) -> Column:
        n = F.aggregate(pieces, F.lit(0), lambda s, p: s + p["n"])
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), n.cast("long").alias("n"))

    out = F.when(hit, _let(replaced(value, key), joined)).otherwise(F.struct(value.alias("text"), F.lit(0).cast("long").alias("n")))
    if found is None:
        return docs.withColumn(text, out["text"])
    both = docs.withColumn("_pseudonymised", out)
    return both.withColumns({found: F.col("_pseudonymised.n"), text: F.col("_pseudonymised.text")}).drop("_pseudonymised")
