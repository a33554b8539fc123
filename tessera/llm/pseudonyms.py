"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For tests and demonstrations. Pass another in production: who knows it can reverse the pseudonyms.
KEY = "change this key"
ROUNDS = 8
#: A walk ends at the first valid value; the chance that so many steps meet none is under 2**-40 for each kind.
STEPS = 64

# Patterns of the kinds, in the order in which they are tried. Each is bounded, so no text makes it slow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]{0,64}[0-9])(?=[0-9]{0,64}[a-f])[0-9a-f]{16,64}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "us_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|/[0-9])",
    "eu_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[a-f:]{0,40}[0-9])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){2,6}(?::[0-9a-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "world_phone": r"(?<![0-9+])\+(?!1[ .(-])[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{4}(?: [0-9]{4}){3,15}|[0-9]{4}(?:-[0-9]{4}){3,15})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Stands in every text that has a match.
HINT = "[0-9@]|AKIA|ASIA"
#: Days from the first of January 1900 to the end of 2099, and two factors whose product is hardly larger.
DAYS, DAY_FACTORS, DAY_ONE = 73_049, (271, 270), "1900-01-01"


def _number(text: Column) -> Column:
    """48 keyed bits of a text."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def _rounds(start: Column, step: Callable[[Column, Column], Column], n: int = ROUNDS) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)


def permute_pair(left: Column, right: Column, a: int, b: int, tweak: Column) -> Column:
    """Feistel network over Z_a x Z_b: rounds in turn add a keyed hash of one half to the other. A struct (l, r)."""

    def step(s: Column, i: Column) -> Column:
        of_l = _number(F.concat_ws("|", tweak, i.cast("string"), s["l"].cast("string")))
        of_r = _number(F.concat_ws("|", tweak, i.cast("string"), s["r"].cast("string")))
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + of_r) % a).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + of_l) % b).cast("long").alias("r"),
        )

    return _rounds(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: lambdas aren't compiled, so what stands in one runs as often as it does."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(text: Column, stream: Column, letters: tuple[str, ...]) -> Column:
    """Moves each character on within its alphabet by 16 bits of the stream; characters of no alphabet stay."""

    def one(j: Column, hashed: Column) -> Column:
        def moved(c: Column, at: Column) -> Column:
            by = F.conv(F.substr(hashed, j * 4 - 3, F.lit(4)), 16, 10).cast("int")
            base, size, below = F.lit(0), F.lit(len(letters[0])), len(letters[0])
            for alphabet in letters[1:]:
                base = F.when(at > below, below).otherwise(base)
                size = F.when(at > below, len(alphabet)).otherwise(size)
                below += len(alphabet)
            return F.when(at == 0, c).otherwise(
                F.substr(F.lit("".join(letters)), base + (at - 1 - base + by) % size + 1, F.lit(1))
            )

        return let(F.substr(text, j, F.lit(1)), lambda c: moved(c, F.instr(F.lit("".join(letters)), c)))

    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(
        let(stream, lambda hashed: F.array_join(F.transform(places, lambda j: one(j, hashed)), ""))
    )


def permute_text(text: Column, tweak: Column, letters: tuple[str, ...]) -> Column:
    """Feistel network over texts of one format: each half in turn is moved on, within its characters' alphabets, by a
    keyed hash of the other. Texts of up to 64 characters."""
    half = F.floor(F.length(text) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        def hashed(x: Column) -> Column:
            return F.sha2(F.concat_ws("|", tweak, i.cast("string"), x).cast("binary"), 512)

        even = i % 2 == 0
        return F.struct(
            F.when(even, _shift(s["l"], hashed(s["r"]), letters)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_shift(s["r"], hashed(s["l"]), letters)).alias("r"),
        )

    start = F.struct(
        F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda end: F.concat(end["l"], end["r"])
    )


def _walk(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid value after start on its cycle: a permutation of the valid values."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), step(start), lambda x, _: F.when(valid(x), x).otherwise(step(x))
    )


_DIGITS = ("0123456789",)
_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef",)
_UPPER = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",)
_UPPER_KINDS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FOURS = "^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """m with its digits, or what kind says, replaced one by one."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(f"^{kind}$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, the rightmost one not."""

    def step(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    """Keeps the first digit, moves the others but the last, which is the check digit made anew. Groups of four digits
    are read from the left, and the first four with a valid check digit are a card, wherever they begin."""

    def made(d: Column) -> Column:
        first = F.substr(d, F.lit(1), F.lit(1))
        body = F.substr(d, F.lit(2), F.length(d) - 2)
        return F.concat(first, permute_text(body, F.concat_ws("|", key, F.lit("card"), first), _DIGITS))

    def checked(x: Column) -> Column:
        return F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string"))

    def whole(d: Column) -> Column:
        return F.when(luhn_sum(d) % 10 == 0, let(let(made(d), checked), lambda x: _refill(m, x)))

    def step(s: Column, k: Column, d: Column) -> Column:
        four = F.substr(d, k * 4 + 1, F.lit(16))
        valid = (s["skip"] == 0) & (F.length(four) == 16) & (luhn_sum(four) % 10 == 0)
        group = F.substr(d, k * 4 + 1, F.lit(4))
        return F.struct(
            F.when(valid, F.concat(s["out"], let(made(four), checked)))
            .when(s["skip"] > 0, s["out"])
            .otherwise(F.concat(s["out"], group))
            .alias("out"),
            F.when(valid, 3).otherwise(F.greatest(s["skip"] - 1, F.lit(0))).alias("skip"),
        )

    def groups(d: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"))
        places = F.sequence(F.lit(0), (F.length(d) / 4).cast("int") - 1)
        out = F.aggregate(places, start, lambda s, k: step(s, k, d), lambda s: s["out"])
        return let(out, lambda x: F.when(x != d, _refill(m, x)))

    return let(_digits(m), lambda d: F.when(m.rlike(_FOURS), groups(d)).otherwise(whole(d)))


def _iban(m: Column, key: Column) -> Column:
    """Account numbers whose check digits are right: the country stays, the account's digits and letters move within
    their kind, the check digits are made anew."""

    def rest(x: Column) -> Column:
        """The remainder by 97 of a text of digits and capitals, A standing for 10."""

        def step(s: Column, c: Column) -> Column:
            n = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)
            return F.when(n > 0, (s * 100 + n + 9) % 97).otherwise((s * 10 + c.cast("int")) % 97)

        return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda s, c: step(s, c).cast("int"))

    def moved(x: Column) -> Column:
        country, body = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5), F.length(x))
        new = permute_text(body, F.concat_ws("|", key, F.lit("iban"), country), _UPPER_KINDS)

        def told(y: Column) -> Column:
            check = F.lpad((98 - rest(F.concat(y, country, F.lit("00")))).cast("string"), 2, "0")
            return _refill(m, F.concat(country, check, y), "[0-9A-Z]")

        return F.when(
            rest(F.concat(body, F.substr(x, F.lit(1), F.lit(4)))) == 1, let(new, told)
        )

    return let(F.regexp_replace(m, " ", ""), moved)


def _world_phone(m: Column, key: Column) -> Column:
    """Numbers of 8 to 15 digits with a country's prefix: the first two digits stay, the others move."""

    def moved(d: Column) -> Column:
        first = F.substr(d, F.lit(1), F.lit(2))
        made = permute_text(F.substr(d, F.lit(3), F.length(d)), F.concat_ws("|", key, F.lit("world"), first), _DIGITS)
        return F.when(F.length(d).between(8, 15), let(F.concat(first, made), lambda x: _refill(m, x)))

    return let(_digits(m), moved)


def _phone(m: Column, key: Column) -> Column:
    """Moves the ten national digits; numbers with an area code and an exchange from 200 up stay so."""

    def moved(d: Column, tail: Column) -> Column:
        def valid(x: Column) -> Column:
            return x.rlike("^[2-9]..[2-9]") == tail.rlike("^[2-9]..[2-9]")

        made = _walk(tail, lambda x: permute_text(x, F.concat_ws("|", key, F.lit("phone")), _DIGITS), valid)
        return let(F.concat(F.substr(d, F.lit(1), F.length(d) - 10), made), lambda x: _refill(m, x))

    return let(_digits(m), lambda d: let(F.substr(d, F.length(d) - 9, F.lit(10)), lambda tail: moved(d, tail)))


def _ssn(m: Column, key: Column) -> Column:
    """Valid numbers: no area 000, 666 or from 900 up, no group 00, no serial 0000."""
    rule = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"

    def moved(d: Column) -> Column:
        return _walk(d, lambda x: permute_text(x, F.concat_ws("|", key, F.lit("ssn")), _DIGITS), lambda x: x.rlike(rule))

    return let(_digits(m), lambda d: F.when(d.rlike(rule), let(moved(d), lambda x: _refill(m, x))))


def _ip(m: Column, key: Column) -> Column:
    """IPv4 addresses without leading zeros, as a permutation of the 32-bit numbers."""
    part = F.split(m, r"\.")
    o = [F.get(part, F.lit(k)).cast("int") for k in range(4)]
    out = let(
        permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, F.concat_ws("|", key, F.lit("ip"))),
        lambda s: F.concat_ws(
            ".",
            *[x.cast("string") for x in (F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256)],
        ),
    )
    return F.when((F.greatest(*o) <= 255) & ~m.rlike(r"(^|\.)0[0-9]"), out)


def _day(date: Column, key: Column, valid: Callable[[Column], Column] | None = None) -> Column:
    """The pseudonym of a date from 1900 to 2099, else null."""
    a, b = DAY_FACTORS
    first = F.to_date(F.lit(DAY_ONE))

    def step(x: Column) -> Column:
        s = permute_pair(F.floor(x / b), x % b, a, b, F.concat_ws("|", key, F.lit("date")))
        return let(s, lambda p: p["l"] * b + p["r"])

    def fine(x: Column) -> Column:
        inside = (x >= 0) & (x < DAYS)
        return inside & valid(F.date_add(first, F.least(x, F.lit(DAYS - 1)).cast("int"))) if valid else inside

    return let(
        F.datediff(date, first).cast("long"),
        lambda n: F.when((n >= 0) & (n < DAYS), F.date_add(first, _walk(n, step, fine).cast("int"))),
    )


def _date(m: Column, pattern: str) -> Column:
    return F.to_date(F.try_to_timestamp(m, F.lit(pattern)))


def _us_date(m: Column, key: Column) -> Column:
    """Month first where that is a date; else day first, and then the pseudonym's day is over 12 too, so that it reads
    as it was written."""
    us, eu = _date(m, "MM/dd/yyyy"), _date(m, "dd/MM/yyyy")
    late = _day(eu, F.concat_ws("|", key, F.lit("eu")), lambda d: F.dayofmonth(d) > 12)
    return F.when(us.isNotNull(), F.date_format(_day(us, key), "MM/dd/yyyy")).when(
        eu.isNotNull(), F.date_format(late, "dd/MM/yyyy")
    )


def _email(m: Column, key: Column) -> Column:
    """Moves the local part's letters and digits within their kind, keyed by the domain, which stays."""
    part = F.split(m, "@")
    domain = F.get(part, F.lit(1))
    local = permute_text(F.get(part, F.lit(0)), F.concat_ws("|", key, F.lit("email"), F.lower(domain)), _LETTERS)
    return F.concat(local, F.lit("@"), domain)


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match, null if it isn't valid."""

    def tweak(name: str) -> Column:
        return F.concat_ws("|", key, F.lit(name))

    def body(n: int, letters: tuple[str, ...], name: str) -> Column:
        return F.concat(
            F.substr(m, F.lit(1), F.lit(n)), permute_text(F.substr(m, F.lit(n + 1), F.length(m)), tweak(name), letters)
        )

    return (
        F.when(kind == "email", _email(m, key))
        .when(kind == "access_key", body(4, _UPPER, "access_key"))
        .when(kind == "secret", body(0, _HEX, "secret"))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "iso_date", F.date_format(_day(_date(m, "yyyy-MM-dd"), key), "yyyy-MM-dd"))
        .when(kind == "us_date", _us_date(m, key))
        .when(kind == "eu_date", F.date_format(_day(_date(m, "dd.MM.yyyy"), key), "dd.MM.yyyy"))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ipv6", permute_text(m, tweak("ipv6"), _HEX))
        .when(kind == "world_phone", _world_phone(m, key))
        .when(kind == "card", _card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str = KEY, report: bool = True) -> DataFrame:
    """docs with each valid e-mail address, access key, secret, IP address, phone, social security, account (IBAN) and card
    number and date in text replaced by its pseudonym: a keyed permutation within its format, so equal values stay equal in all
    documents and different ones different. n_chars, if there, follows the text. With ``report``, adds n_private and private_kinds,
    in the place of columns so named.

    Numbers that fail validation (check digit, octets, calendar) stay. Null texts stay null, with n_private 0. Very long
    texts are searched whole. Where kinds overlap, the first start wins, then the first kind of PATTERNS. All of it is a
    projection: no shuffle, no Python.
    """
    k = F.lit(key)
    text = F.col("text")
    found = F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
        lambda m: F.struct(m.alias("m"), _kind(m).alias("k")),
    )
    made = F.transform(
        F.col("__pii_found"), lambda x: F.struct(x["k"].alias("k"), x["m"].alias("m"), pseudonym(x["m"], x["k"], k).alias("p"))
    )
    # The pieces between the matches, one more than there are matches.
    joined = F.zip_with(
        F.split(text, ANY, -1),
        F.col("__pii_made"),
        lambda piece, x: F.concat(piece, F.coalesce(x["p"], x["m"], F.lit(""))),
    )
    none = F.array().cast("array<struct<m:string,k:string>>")
    out = docs.withColumn("__pii_found", F.when(text.rlike(HINT) & text.rlike(ANY), found).otherwise(none))
    out = out.withColumn("__pii_made", made)
    valid = F.filter(F.col("__pii_made"), lambda x: x["p"].isNotNull())
    out = out.withColumn("__pii_text", F.when(F.size("__pii_made") > 0, F.array_join(joined, "")).otherwise(text))
    changes = {"text": F.col("__pii_text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.size("__pii_made") > 0, F.length("__pii_text").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars")
        )
    if report:
        kinds = F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["k"])))
        changes |= {"n_private": F.size(valid).cast("long"), "private_kinds": F.array_join(kinds, ",")}
    return out.withColumns(changes).drop("__pii_found", "__pii_made", "__pii_text")
