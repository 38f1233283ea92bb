"""Personal numbers, dates, addresses and secrets replaced by keyed pseudonyms of the same format, in SQL expressions alone."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.functions.arrays import let

#: What may be private, as fixed patterns; the checks below decide. Every alternative starts at a boundary and runs on
#: without going back, so that a text of one long word takes linear time. First the
#: letters of the Latin, Greek and Cyrillic scripts, and digits.
_LETTERS = "A-Za-z0-9À-ɏͰ-ӿ"
EMAIL = rf"(?<![{_LETTERS}._%+-])[{_LETTERS}._%+-]{{1,64}}+@[{_LETTERS}-]++(?:\.[{_LETTERS}-]++)+"
SECRET = r"(?<![A-Za-z0-9])(?i:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
SPACED_PHONE = r"(?<![0-9+] )(?<![0-9A-Za-z+])[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9]| [0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}+(?:[ .-]?(?:\(0?[0-9]{1,4}\)|[0-9]{1,4}+)){2,8}+(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([/-])[0-9]{2}\2[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\3[0-9]{4})(?![0-9]|[./-][0-9])"
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
LONG_DATE = rf"(?<![0-9A-Za-z])(?:[0-9]{{1,2}} {MONTH} [0-9]{{4}}|{MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![0-9])"
ANY = "|".join([EMAIL, SECRET, ACCESS_KEY, IBAN, PHONE, SPACED_PHONE, ABROAD, ADDRESS, CARD, SOCIAL, DATE, LONG_DATE])
#: What a text with any of these must hold.
HINT = r"[0-9@]|(?i:token|secret|key|passw)"
#: Prefixes and lengths of card numbers.
ISSUER = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12})$"

#: Days from 1920-01-01 to 2099-06-06, 256 times 256 of them, are moved among themselves; so are all others of the years 1
#: to 9999, which are 6439 times 557.
FIRST_DAY, SPAN = "1920-01-01", 256
EARLIEST, OTHERS = "0001-01-01", (6439, 557)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, domain: str, rounds: int = 10) -> Column:
    """A keyed permutation of the pairs (left below a, right below b): in turn each half is shifted by a hash of the other."""

    def step(state: Column, turn: Column) -> Column:
        l, r, a, b = (state[x] for x in "lrab")
        even = turn % 2 == 0
        half = F.when(even, r).otherwise(l)
        shift = F.conv(F.substring(_digest(key, F.lit(domain), a, b, turn, half), 1, 15), 16, 10).cast("long")
        moved = F.pmod(F.when(even, l).otherwise(r) + shift, F.when(even, a).otherwise(b))
        return let(moved, lambda m: F.struct(F.when(even, m).otherwise(l).alias("l"), F.when(even, r).otherwise(m).alias("r"), a.alias("a"), b.alias("b")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def digits_pseudonym(digits: Column, key: str, domain: str) -> Column:
    """A string of 2 to 18 digits as another of the same length."""

    def moved(d: Column, n: Column, half: Column) -> Column:
        size = [F.pow(F.lit(10.0), x).cast("long") for x in (half, n - half)]
        new = feistel(d.substr(F.lit(1), half).cast("long"), d.substr(half + 1, n - half).cast("long"), *size, key, domain)
        return let(new, lambda m: F.concat(F.lpad(m["l"].cast("string"), half, "0"), F.lpad(m["r"].cast("string"), n - half, "0")))

    return let(digits, lambda d: let(F.length(d), lambda n: let(F.floor(n / 2).cast("int"), lambda half: moved(d, n, half))))


def _card(text: Column, key: str) -> Column:
    """A number of a known issuer that its check digit confirms: issuer and length stay, the check digit fits again."""
    gap = F.regexp_extract(text, "[ -]", 0)
    places = lambda whole, *sizes: F.concat_ws(" ", *[whole.substr(sum(sizes[:i]) + 1, n) for i, n in enumerate(sizes)])

    def checked(body: Column) -> Column:
        check = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda c: F.call_function("luhn_check", F.concat(body, c)))
        return F.concat(body, F.element_at(check, 1))

    def written(whole: Column) -> Column:
        spaced = F.when(F.length(whole) == 15, places(whole, 4, 6, 5)).otherwise(places(whole, 4, 4, 4, 4))
        return F.when(gap == "", whole).when(gap == "-", F.translate(spaced, " ", "-")).otherwise(spaced)

    def moved(digits: Column) -> Column:
        fixed = F.when(digits.startswith("4"), 1).otherwise(4)
        body = F.concat(digits.substr(F.lit(1), fixed), digits_pseudonym(digits.substr(fixed + 1, F.length(digits) - fixed - 1), key, "card"))
        return F.when(digits.rlike(ISSUER) & F.call_function("luhn_check", digits), let(let(body, checked), written))

    return let(F.regexp_replace(text, "[ -]", ""), moved)


def _phone(text: Column, key: str) -> Column:
    shape = r"^((?:\+1[ .-]?)?\(?)([0-9]{3})([^0-9]+)([0-9]{3})([.-])([0-9]{4})$"
    part = [F.regexp_extract(text, shape, i) for i in range(1, 7)]
    new = digits_pseudonym(F.concat(part[1], part[3], part[5]), key, "phone")
    return let(new, lambda n: F.concat(part[0], n.substr(1, 3), part[2], n.substr(4, 3), part[4], n.substr(7, 4)))


def _address(text: Column, key: str) -> Column:
    byte = [F.split(text, r"\.").getItem(i).cast("long") for i in range(4)]
    moved = feistel(byte[0] * 256 + byte[1], byte[2] * 256 + byte[3], F.lit(65536), F.lit(65536), key, "address")
    return let(moved, lambda m: F.concat_ws(".", *[x.cast("string") for half in ("l", "r") for x in (F.shiftright(m[half], 8), m[half] % 256)]))


def _social(text: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999; anything else is no such number."""
    area, middle, serial = (F.split(text, "-").getItem(i).cast("long") for i in range(3))
    good = (area > 0) & (area != 666) & (area < 900) & (middle > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(index * 99 + middle - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "social")

    def shown(m: Column) -> Column:
        where = F.floor(m["l"] / 99)
        new = F.when(where >= 665, where + 2).otherwise(where + 1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((m["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((m["r"] + 1).cast("string"), 4, "0"))

    return F.when(good, let(moved, shown))


def _reshaped(shape: Column, new: Column, first: Column | int = 0) -> Column:
    """shape with its digits from the first one on replaced by those of new, one after the other."""
    at = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def filled(new: Column) -> Column:
        def put(state: Column, c: Column) -> Column:
            digit, turn = c.between("0", "9"), state["seen"] - first + 1
            return F.struct(F.concat(state["out"], F.when(digit & (turn >= 1), new.substr(turn, F.lit(1))).otherwise(c)).alias("out"), (state["seen"] + F.when(digit, 1).otherwise(0)).alias("seen"))

        return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), at, put, lambda s: s["out"])

    return let(new, filled)


def _abroad(text: Column, key: str) -> Column:
    """A number with a country's prefix, of 8 to 15 digits: the prefix (two digits if nothing ends it) and the marks stay."""
    ahead = F.length(F.regexp_extract(text, r"^\+([0-9]{1,3})[^0-9]", 1))

    def moved(digits: Column, prefix: Column) -> Column:
        new = digits_pseudonym(digits.substr(prefix + 1, F.length(digits) - prefix), key, "abroad")
        return F.when(F.length(digits).between(8, 15), _reshaped(text, new, prefix))

    return let(F.regexp_replace(text, "[^0-9]", ""), lambda digits: let(F.when(ahead > 0, ahead).otherwise(2), lambda prefix: moved(digits, prefix)))


def _remainder(account: Column) -> Column:
    """An account number of letters (A is 10) and digits, as one number, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), lambda s, c: ((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def _iban(text: Column, key: str) -> Column:
    """An account number that its check digits confirm: country, letters and blanks stay, the check digits fit again."""

    def part(digits: Column, size: Column, domain: str) -> Column:
        return F.when(size >= 2, digits_pseudonym(digits, key, domain)).otherwise(digits)

    def moved(digits: Column, n: Column) -> Column:
        tail = F.least(n, F.lit(16))
        return F.concat(part(digits.substr(F.lit(1), n - tail), n - tail, "iban head"), part(digits.substr(n - tail + 1, tail), tail, "iban"))

    def told(bare: Column) -> Column:
        account = bare.substr(F.lit(5), F.length(bare) - 4)
        good = F.length(bare).between(15, 34) & (_remainder(F.concat(account, bare.substr(1, 4))) == 1)

        def finished(new: Column) -> Column:
            check = F.lpad((98 - _remainder(F.concat(new, bare.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
            return _reshaped(text, F.concat(check, F.regexp_replace(new, "[A-Z]", "")))

        digits = let(F.regexp_replace(account, "[A-Z]", ""), lambda d: let(F.length(d), lambda n: moved(d, n)))
        return F.when(good, let(_reshaped(account, digits), finished))

    return let(F.regexp_replace(text, " ", ""), told)


def _moved_day(day: Column, key: str) -> Column:
    """Another day, for one counted from FIRST_DAY: of those from there on that SPAN allows, or of all others."""
    earlier = F.datediff(F.lit(FIRST_DAY).cast("date"), F.lit(EARLIEST).cast("date"))

    def near(d: Column) -> Column:
        return let(feistel(F.floor(d / SPAN), d % SPAN, F.lit(SPAN), F.lit(SPAN), key, "date"), lambda s: s["l"] * SPAN + s["r"])

    def far(index: Column) -> Column:
        moved = feistel(F.floor(index / OTHERS[1]), index % OTHERS[1], F.lit(OTHERS[0]), F.lit(OTHERS[1]), key, "far date")
        return let(moved, lambda s: s["l"] * OTHERS[1] + s["r"] - earlier)

    def other(d: Column) -> Column:
        place = let(F.when(d < 0, d + earlier).otherwise(d - SPAN * SPAN + earlier), far)
        return let(place, lambda p: F.when(p < 0, p).otherwise(p + SPAN * SPAN))

    return F.date_add(F.lit(FIRST_DAY).cast("date"), let(day, lambda d: F.when(d.between(0, SPAN * SPAN - 1), near(d)).otherwise(other(d))).cast("int"))


def _date(text: Column, key: str) -> Column:
    """A day of the years 1 to 9999 that exists, written year first, or month or day first; others stay.

    The writing is read off once: the year's place, the marks between, and whether month or day comes first. Of two
    readings of one writing month first is taken. Where a month or day has one digit, none gets a zero ahead of it.
    """
    mark = F.regexp_extract(text, "[./-]", 0)
    part = [F.try_element_at(F.split(text, "[./-]"), F.lit(i)) for i in (1, 2, 3)]
    ahead = F.length(part[0]) == 4
    short = ~ahead & ((F.length(part[0]) == 1) | (F.length(part[1]) == 1))

    def day_of(month: Column, day: Column) -> Column:
        year = F.when(ahead, part[0]).otherwise(part[2])
        return F.datediff(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))

    month_first = F.when(mark == "/", day_of(part[0], part[1]))
    day_first = day_of(part[1], part[0])
    day = F.when(ahead, day_of(part[1], part[2])).otherwise(F.coalesce(month_first, day_first))
    by_month = month_first.isNotNull()
    year = F.when(ahead, part[0]).otherwise(part[2])

    def shown(new: Column) -> Column:
        y = F.date_format(new, "yyyy")
        m, d = (F.when(short, F.date_format(new, form[0])).otherwise(F.date_format(new, form)) for form in ("MM", "dd"))
        return F.when(ahead, F.concat(y, mark, m, mark, d)).when(by_month, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))

    return let(day, lambda told: F.when(told.isNotNull() & (year != "0000"), let(_moved_day(told, key), shown)))


def _long_date(text: Column, key: str) -> Column:
    """A day that exists with the month's English name, before the month or behind it."""
    forms = ("d MMMM yyyy", "MMMM d, yyyy")
    days = [F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")) for form in forms]

    def shown(day: Column, form: str) -> Column:
        return let(day, lambda d: F.when(d.isNotNull(), F.date_format(_moved_day(d, key), form)))

    return F.coalesce(*[shown(day, form) for day, form in zip(days, forms)])


def pseudonym(match: Column, key: str) -> Column:
    """What stands for a match of ANY; null if a check shows that it is no private value."""
    hexes = _digest(key, F.lit("key"), match)
    head = F.regexp_extract(match, r"^(.*?[=:]\s*[\"']?)[A-Za-z0-9+/_-]+$", 1)
    secret = match.substr(F.length(head) + 1, F.length(match) - F.length(head))
    return (
        F.when(match.contains("@"), F.concat(F.lit("user."), F.substring(_digest(key, F.lit("email"), F.lower(match)), 1, 12), F.lit("@mail.invalid")))
        .when(match.rlike("[=:]"), F.concat(head, F.repeat(_digest(key, F.lit("secret"), secret), 1 + F.floor(F.length(secret) / 64).cast("int")).substr(F.lit(1), F.length(secret))))
        .when(match.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))))
        .when(match.rlike(f"^(?:{IBAN})$"), _iban(match, key))
        .when(match.rlike(f"^(?:{PHONE})$"), _phone(match, key))
        .when(match.rlike(f"^(?:{SPACED_PHONE})$"), _reshaped(match, digits_pseudonym(F.regexp_replace(match, " ", ""), key, "phone")))
        .when(match.startswith("+"), _abroad(match, key))
        .when(match.rlike(f"^(?:{ADDRESS})$"), _address(match, key))
        .when(match.rlike(f"^(?:{CARD})$"), _card(match, key))
        .when(match.rlike(f"^(?:{SOCIAL})$"), _social(match, key))
        .when(match.rlike("[A-Za-z]"), _long_date(match, key))
        .otherwise(_date(match, key))
    )


#: The key without a secret, for tests and trials.
PUBLIC_KEY = "takewise"


def session_key(spark: SparkSession) -> str:
    """The key of the session's spark.takewise.pseudonymKey; without it a warning, and a key that everybody can read here."""
    key = spark.conf.get("spark.takewise.pseudonymKey", None)
    if key is None:
        warnings.warn("spark.takewise.pseudonymKey isn't set: the pseudonyms have a public key and can be undone by anybody", stacklevel=2)
    return key or PUBLIC_KEY


def pseudonymise(docs: DataFrame, text: str = "text", key: str = PUBLIC_KEY, count: str = "n_private") -> DataFrame:
    """docs with private values in text replaced, and a column count, how many were.

    Numbers and dates that their checks confirm are moved by a Feistel permutation of their format under key: a card
    number stays one of its issuer, a date a date of the same writing. Equal values have equal pseudonyms in all
    documents, different ones of a format different ones. Mail addresses and secrets have keyed digests in their place.
    What fails its check (the check digits of a card or account number, a day that doesn't exist) stays as it is, as do
    telephone numbers without any mark between their digits or a country's prefix, which any number looks like. A null text stays null with 0 replaced, as does an empty one; each row is dealt with by
    itself, so repeated rows and ties make no difference, and a text of any length is dealt with whole. Other columns of
    whatever names pass through; if one is called count already, the new one gets an underscore more. One projection of
    SQL functions: no shuffle, no Python. Whoever knows key can undo the pseudonyms, so give one of your own.
    """
    while count in docs.columns:
        count += "_"
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    column = F.col(names[text])
    found = inner.select("*", F.when(column.rlike(HINT), F.regexp_extract_all(column, F.lit(ANY), F.lit(0))).alias("found"))
    found = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    filled = F.zip_with(F.col("found"), F.col("new"), lambda old, new: F.coalesce(new, old))
    some = F.coalesce(F.size("found"), F.lit(0)) > 0
    whole = F.array_join(F.zip_with(F.split(column, ANY, -1), filled, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    many = F.when(some, F.size(F.filter("new", lambda x: x.isNotNull()))).otherwise(0).cast("long")
    return found.select(*[(F.when(some, whole).otherwise(column) if c == text else F.col(k)).alias(c) for c, k in names.items()], many.alias(count))
