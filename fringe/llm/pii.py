"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

A text is split at everything that looks like personal data. What proves valid (Luhn digit, calendar
date, IBAN remainder, octets, digit count) is replaced by a keyed permutation of itself within its format, a Feistel
network whose rounds add keyed hashes of one half to the other half: equal values get equal pseudonyms
in every document, different ones different pseudonyms, and whoever has the key can undo it (``restore``). What
doesn't validate stays as it is.

Equal means the same value, not the same letters: phone numbers are compared by country code and digits, e-mail addresses
and IPv6 addresses without regard to case, and IPv6 addresses in full. E-mail domains, country codes and the bank's letters in an
IBAN stay readable; national phone numbers without a country code and secrets that aren't hexadecimal are not looked for.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Gregorian days repeat after 400 years: 146,097 days, which is 189 * 773.
FIRST_DAY, DAY_HALVES = "1700-01-01", (189, 773)

_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# A local part is taken once, from its first character, and labels are bounded: a long run of letters costs one pass.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+(?<=[\p{L}\p{N}])@" + _LABEL + r"(?:\." + _LABEL + r"){1,8}"
SECRET = r"(?i:(?:token|secret|password|passwd|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"'])[0-9A-Fa-f]{16,128}(?=[\"'])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(countries: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}{f' [A-Z0-9]{{{rest}}}' if rest else ''})"


# Of a country without a known length any from 15 to 34 characters may be one.
_IBAN_OF_OTHERS = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?)"
IBAN = _NO_WORD_BEFORE + "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join([_iban(c, n) for n, c in IBAN_LENGTHS.items()] + [_IBAN_OF_OTHERS]) + ")" + _NO_WORD_AFTER
DATE_YMD = r"(?<![\p{L}\p{N}\-/.])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{L}\p{N}]|[\-/.][0-9])"
DATE_DMY = r"(?<![\p{L}\p{N}\-/.])[0-9]{2}([/.\-])[0-9]{2}\1[0-9]{4}(?![\p{L}\p{N}]|[\-/.][0-9])"
IP = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"
# Eight groups, or :: in place of some and at least three others, with a digit among them.
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:{_GROUP}(?::{_GROUP}){{7}}|(?=[A-Fa-f:]*[0-9])(?={_GROUP}(?::{{1,2}}{_GROUP}){{2}}){_GROUP}(?::{_GROUP}){{0,6}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}\p{{N}}:]|\.[0-9])"
#: Country codes of one and of two digits; all others have three.
COUNTRY_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# A phone number ends where another value begins. North American numbers have ten digits after +1. In others groups may be
# separated by blanks and then by dots or hyphens, but no blank follows those, and a group after a blank begins no date, IP
# address, SSN, card or decimal number. From 8 to 15 digits. With eleven a number is whole at the next blank, so that a number that
# happens to follow neither joins it nor changes its pseudonym; a shorter one takes the groups that follow.
_OTHER_NUMBER = (
    r"(?![0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.|-[0-9]{2}-)[0-9]{4}(?![0-9])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    r"|[0-9]{4}(?:-[0-9]{4}){3}(?![0-9])|[0-9]{4}(?: [0-9]{4}){3}(?![0-9]| [0-9]{4}(?![0-9./\-]))|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![0-9])|[0-9]{13})"
)
_DIGIT = r"[ .\-()]{0,2}[0-9]"
_DIGITS_MORE = f"(?:{_DIGIT}" * 7 + ")?" * 7  # written out: a look-behind may hold no repeated group
_WHOLE = rf"(?<!\+{_DIGIT * 11}{f'(?:{_DIGIT}' * 4 + ')?' * 4})"
_NORTH_AMERICA = r"1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
_ELSEWHERE = (
    rf"[0-9]{{1,3}}(?:[.\-]?| {_OTHER_NUMBER})(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:[.\-]?| {_OTHER_NUMBER})[0-9]{{2,12}}"
    rf"(?:{_WHOLE} {_OTHER_NUMBER}(?![0-9]+(?:[.,/][0-9]|:[0-9A-Fa-f:]))[0-9]{{2,12}}){{0,3}}(?:[.\-][0-9]{{2,12}}){{0,3}}(?<=\+{_DIGIT * 8}{_DIGITS_MORE})"
)
PHONE = rf"(?<![\p{{L}}\p{{N}}+])\+(?:{_NORTH_AMERICA}{_NO_WORD_AFTER}|{_ELSEWHERE}{_NO_WORD_AFTER})"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
CARD = r"(?<![\p{L}\p{N}.\-])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![\p{L}\p{N}]|[.\-][0-9])"
ANY = "|".join(p.replace(r"\1", r"\k<sep>").replace(r"([/.\-])", r"(?<sep>[/.\-])") for p in (EMAIL, SECRET, IBAN, DATE_YMD, DATE_DMY, IP6, IP, PHONE, SSN, CARD))
KINDS = ("email", "secret", "iban", "date", "ip", "ip6", "phone", "ssn", "card")


def key_column(key: str) -> Column:
    """struct<inner, outer> of two keys made from ``key``, as literals: for small tests, as plans print them."""
    return F.struct(*[F.lit(v).alias(n) for n, v in _derived(key).items()])


def _derived(key: str) -> dict[str, str]:
    return {name: sha256(f"{name}|{key}".encode()).hexdigest() for name in ("inner", "outer")}


def _secret(spark: SparkSession, key: str) -> Column:
    """The same as the value of a one-row table, which plans don't print."""
    rows = spark.createDataFrame([tuple(_derived(key).values())], "inner string, outer string")
    return rows.select(F.struct("inner", "outer").alias("key")).scalar()


def _keyed(key: Column, tweak: Column, round_: Column, half: Column, bits: int = 256) -> Column:
    """A keyed hash, nested like an HMAC: one key within the message's hash, the other around it."""
    inner = F.sha2(F.concat_ws("|", key["inner"], tweak, round_.cast("string"), half.cast("string")), 256)
    return F.sha2(F.concat(key["outer"], inner), bits)


def _rounds(n: int, inverse: bool) -> Column:
    return F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(n - 1))


def _feistel(a: Column, b: Column, a_size: Column, b_size: Column, tweak: Column, key: Column, inverse: bool = False) -> Column:
    """struct<a, b>: a permutation of the pairs with 0 <= a < a_size and 0 <= b < b_size."""

    def step(state: Column, i: Column) -> Column:
        sa, sb = state["a"], state["b"]
        add = lambda half: F.conv(F.substring(_keyed(key, tweak, i, half), 1, 15), 16, 10).cast("long") * (-1 if inverse else 1)
        new_a = F.when(i % 2 == 0, F.pmod(sa + add(sb) % a_size, a_size)).otherwise(sa)
        new_b = F.when(i % 2 == 1, F.pmod(sb + add(sa) % b_size, b_size)).otherwise(sb)
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(_rounds(ROUNDS, inverse), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, tweak: Column, key: Column, inverse: bool = False) -> Column:
    """A permutation of the digit strings of this length (2 to 34 digits)."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = _feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long"), size(left), size(n - left), F.concat_ws(":", tweak, n.cast("string")), key, inverse)
    return _let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), left, "0"), F.lpad(o["b"].cast("string"), n - left, "0")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_letters(text: Column, tweak: Column, key: Column, hexadecimal: bool = False, inverse: bool = False) -> Column:
    """A permutation within the character classes: a-z, A-Z and 0-9 (or the hexadecimal digits); the rest stays."""

    def shifted(half: Column, pad: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(half, i, F.lit(1))
            by = F.conv(F.substring(pad, (i - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            move = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + (-by if inverse else by), F.lit(len(alphabet))) + 1, F.lit(1))
            if hexadecimal:  # in one case all sixteen digits, in mixed case each class for itself
                one_case = F.when(text.rlike("^[0-9a-f]*$"), move("0123456789abcdef")).when(text.rlike("^[0-9A-F]*$"), move("0123456789ABCDEF"))
                return F.coalesce(one_case, F.when(c.rlike("[0-9]"), move("0123456789")).when(c.rlike("[a-f]"), move("abcdef")).otherwise(move("ABCDEF")))
            lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
            return F.when(c.rlike("[a-z]"), move(lower)).when(c.rlike("[A-Z]"), move(upper)).when(c.rlike("[0-9]"), move(digit)).otherwise(c)

        return F.when(F.length(half) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), ""))

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        new_a = F.when(i % 2 == 1, shifted(a, _keyed(key, tweak, i, b, 512))).otherwise(a)
        new_b = F.when(i % 2 == 0, shifted(b, _keyed(key, tweak, i, a, 512))).otherwise(b)
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    left = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), left).alias("a"), F.substring(text, left + 1, F.length(text)).alias("b"))
    return _let(F.aggregate(_rounds(6, inverse), start, step), lambda o: F.concat(o["a"], o["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""

    def one(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        nth = F.length(_digits(F.substring(value, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The Luhn sum; every second digit is doubled, from the last (0) or the last but one (1) on."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of an IBAN's characters, letters as 10 to 35."""

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(chars, i, F.lit(1))
        code = F.ascii(c)
        return F.when(c.rlike("[0-9]"), (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(chars)), F.lit(0), add)


def _date_of(value: Column) -> Column:
    """The valid calendar date of a match, within the 400 years from ``FIRST_DAY``; else null."""
    d = _digits(value)
    part = lambda start, n: F.substring(d, start, n)
    iso = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    dmy = F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2))
    mdy = F.concat_ws("-", part(5, 4), part(1, 2), part(3, 2))
    found = F.when(value.rlike("^[0-9]{4}-"), F.try_to_date(iso, "yyyy-MM-dd")).otherwise(F.coalesce(F.try_to_date(dmy, "yyyy-MM-dd"), F.try_to_date(mdy, "yyyy-MM-dd")))
    return F.when((found >= FIRST_DAY) & (found < "2100-01-01"), found)


def kind_of(value: Column) -> Column:
    """The kind of one match of ``ANY`` that validates; null for one that doesn't."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    d = _digits(value)
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.rlike("^[A-Za-z_\\-]+\\s{0,3}[=:]"), F.lit("secret"))
        .when(value.contains(":"), F.when(F.size(F.split(_full_ip6(value), ":")) == 8, F.lit("ip6")))
        .when(value.rlike("^[A-Z]{2}"), F.when(_iban_valid(value), F.lit("iban")))
        .when(value.startswith("+"), F.when(F.length(d).between(8, 15), F.lit("phone")))
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.\-][0-9]{2}[/.\-][0-9]{4}"), F.when(_date_of(value).isNotNull(), F.lit("date")))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit("ssn")))
        .when(F.length(d).between(13, 19), F.when((luhn_sum(d, 1) % 10 == 0) & d.rlike("[1-9]"), F.lit("card")))
    )


def _iban_valid(value: Column) -> Column:
    c = F.regexp_replace(value, " ", "")
    return F.length(c).between(15, 34) & (_mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1)


def _full_ip6(value: Column) -> Column:
    """Eight groups of four lower-case digits."""
    halves = F.split(F.lower(value), "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    missing = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(groups(0)) - F.size(groups(1))))
    return F.array_join(F.transform(F.concat(groups(0), missing, groups(1)), lambda g: F.lpad(g, 4, "0")), ":")


def _pseudonym(value: Column, kind: Column, key: Column, inverse: bool = False) -> Column:
    d = _digits(value)
    at = F.instr(value, "@")
    # Without regard to case, each letter in the case of the one it replaces; a short local part is moved differently in each domain.
    local, domain = F.substring(value, F.lit(1), at - 1), F.substring(value, at, F.length(value))
    moved = permute_letters(F.lower(local), F.concat(F.lit("email"), F.lower(domain)), key, inverse=inverse)
    cased = lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), lambda i: F.when(F.substring(local, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), "")
    email = F.concat(F.when(F.length(moved) == F.length(local), _let(moved, cased)).otherwise(moved), domain)
    mark = F.regexp_extract(value, "^[^\"']*[\"']", 0)
    secret = F.concat(mark, permute_letters(F.substring(value, F.length(mark) + 1, F.length(value)), F.lit("secret"), key, hexadecimal=True, inverse=inverse))
    # IBAN: country and letters stay, the digits after the check digits are permuted, then the check digits follow.
    compact = F.regexp_replace(value, " ", "")
    body = F.substring(compact, F.lit(5), F.length(compact))
    new_body = _let(_digits(body), lambda b: F.when(F.length(b) > 1, _refill(body, permute_digits(b, F.concat(F.lit("iban"), F.substring(compact, 1, 2)), key, inverse))).otherwise(body))
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(compact, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = _let(new_body, lambda b: _refill(value, F.concat(check(b), _digits(b))))
    # Dates: the day's number within 400 years.
    number = F.datediff(_date_of(value), F.lit(FIRST_DAY).cast("date"))
    a_size, b_size = DAY_HALVES
    moved = _feistel(F.floor(number / b_size), number % b_size, F.lit(a_size), F.lit(b_size), F.lit("date"), key, inverse)
    new_day = _let(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (m["a"] * b_size + m["b"]).cast("int")))
    day_first = F.try_to_date(F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)), "yyyy-MM-dd").isNotNull()
    order = F.when(value.rlike("^[0-9]{4}-"), F.date_format(new_day, "yyyyMMdd")).when(day_first, F.date_format(new_day, "ddMMyyyy")).otherwise(F.date_format(new_day, "MMddyyyy"))
    date = _refill(value, order)
    octet = lambda i: F.element_at(F.split(value, r"\."), i).cast("long")
    ip = _let(
        _feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), F.lit("ip"), key, inverse),
        lambda m: F.concat_ws(".", *[F.floor(m[h] / 256) if hi else m[h] % 256 for h in ("a", "b") for hi in (True, False)]),
    )
    groups = permute_letters(F.replace(_full_ip6(value), F.lit(":"), F.lit("")), F.lit("ip6"), key, hexadecimal=True, inverse=inverse)
    ip6 = _let(groups, lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(g, i * 4 + 1, F.lit(4))), ":"))
    country = F.regexp_extract(d, COUNTRY_CODE, 1)
    national = F.substring(d, F.length(country) + 1, F.length(d))
    phone = _refill(value, F.concat(country, permute_digits(national, F.concat(F.lit("phone"), country), key, inverse)))
    # SSN: area 001-665 and 667-899, group 01-99, serial 0001-9999 are all that exist.
    area = F.substring(d, 1, 3).cast("long")
    ssn_moved = _feistel(F.when(area > 666, area - 2).otherwise(area - 1), (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key, inverse)
    ssn = _let(
        ssn_moved,
        lambda m: F.concat_ws(
            "-",
            F.lpad(F.when(m["a"] >= 665, m["a"] + 2).otherwise(m["a"] + 1).cast("string"), 3, "0"),
            F.lpad((F.floor(m["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((m["b"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )
    payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key, inverse)
    card = _refill(value, _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string"))))
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "date", date)
        .when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "card", card).otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Rows ``<id_col>, <text_col>, n_found, kinds`` for every row: the text with pseudonyms and the kinds found, in order.

    Without a shuffle and without Python; a text without a digit or ``@`` is passed on after one scan.
    A null text stays null with nothing found; an empty one stays empty; repeated rows get the same
    result; other columns are ignored. The key is no part of the plan.
    """
    text = F.col(text_col)
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    kinds = F.transform(matches, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    suspect = text.rlike("[0-9@]")
    found = docs.select(F.col(id_col), text.alias(text_col), F.when(suspect, kinds).alias("found"), _secret(docs.sparkSession, key).alias("key"))
    new = F.transform(F.col("found"), lambda x: _pseudonym(x["value"], x["kind"], F.col("key"), inverse))
    pieces = F.split(F.col(text_col), ANY, -1)
    woven = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(F.col("pieces"), 1, F.size("new")).alias("p"), F.col("new").alias("n")), lambda x: F.concat(x["p"], x["n"])), ""), F.element_at("pieces", -1))
    any_valid = F.coalesce(F.exists("found", lambda x: x["kind"].isNotNull()), F.lit(False))
    found = found.withColumn("new", F.when(any_valid, new)).withColumn("pieces", F.when(any_valid, pieces))
    kinds_found = F.coalesce(F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return found.select(id_col, F.when(any_valid, woven).otherwise(F.col(text_col)).alias(text_col), F.size(kinds_found).alias("n_found"), F.array_join(kinds_found, ",").alias("kinds"))


def restore(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows with the values that ``pseudonymize`` replaced.

    IPv6 addresses come back in full. A date with the month first comes back only if its pseudonym can't be read with the day first.
    """
    return pseudonymize(docs, key, id_col, text_col, inverse=True)
