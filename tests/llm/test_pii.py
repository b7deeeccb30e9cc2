import datetime
import hashlib
import ipaddress
import re
import string

import pytest
from pyspark.sql import functions as F

from fringe.llm import pii

KEY = "test-key"
COLUMN = pii.key_column
SCHEMA = "doc_id long, text string, kinds int, found string"


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in pii.pseudonymize(df, key).collect()}


def test_kinds_formats_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111; not 4111111111111112 nor 12345",
        "born 1987-02-28 not 1987-02-29 but 28/02/1987 and 02/29/2000",
        "a.b9@mail.example.com and a.b9@mail.example.com.",
        "ip 10.0.255.1 not 10.0.256.1 nor 1.2.3.4.5",
        "tel +1 (162) 555-6820 ssn 123-45-6789 bad 000-12-3456",
        "DE89370400440532013000 bad DE89370400440532013001",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        None, "", "no data here, only words.", "4111-1111-1111-1111",
    ]
    got = run(spark, texts)
    assert [got[i].kinds for i in range(7)] == ["card,card", "date,date,date", "email,email", "ip", "phone,ssn", "iban", "secret"]
    numbers = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0].text)
    assert numbers[0].replace(" ", "") == numbers[1] != "4111111111111111" and luhn(numbers[1])
    assert "not 4111111111111112 nor 12345" in got[0].text
    assert got[10].text.replace("-", "") == numbers[1]
    iso, dmy, mdy = re.search(r"born (\S+) not 1987-02-29 but (\S+) and (\S+)", got[1].text).groups()
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(dmy, "%d/%m/%Y").date() and datetime.datetime.strptime(mdy, "%m/%d/%Y")
    first, second = re.findall(r"\S+@mail\.example\.com", got[2].text)
    assert first == second != "a.b9@mail.example.com" and re.fullmatch(r"[a-z]\.[a-z]\d", first.split("@")[0])
    assert "not 10.0.256.1 nor 1.2.3.4.5" in got[3].text and all(int(o) < 256 for o in re.search(r"ip ([\d.]+)", got[3].text)[1].split("."))
    assert re.fullmatch(r"tel \+1 \(\d{3}\) \d{3}-\d{4} ssn \d{3}-\d\d-\d{4} bad 000-12-3456", got[4].text)
    iban = got[5].text.split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE" and "DE89370400440532013001" in got[5].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[6].text) and got[6].text != texts[6]
    assert got[7].text is None and got[7].n_found == 0 and got[8].text == "" and got[9].text == texts[9]
    other = run(spark, texts[:1], "another key")
    assert other[0].text != got[0].text


@pytest.mark.parametrize(("low", "n", "width"), [(0, 100, 2), (0, 1000, 3)])
def test_digit_permutation_is_one_to_one(spark, low, n, width):
    df = spark.range(low, low + n).select(F.lpad(F.col("id").cast("string"), width, "0").alias("d"))
    out = [r.p for r in df.select(pii.permute_digits(F.col("d"), F.lit("t"), COLUMN(KEY)).alias("p")).collect()]
    assert len(set(out)) == n and all(len(p) == width for p in out)


def test_days_and_letters_are_one_to_one(spark):
    days = spark.sql("select explode(sequence(date'1999-12-01', date'2000-03-31')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("d"))
    out = [r.p for r in days.select(pii._pseudonym(F.col("d"), F.lit("date"), COLUMN(KEY)).alias("p")).collect()]
    assert len(set(out)) == len(out) and all("1700-01-01" <= p < "2100-01-01" for p in out)
    pairs = spark.range(26 * 10).select(F.concat(F.char(F.col("id") % 26 + 97), F.floor(F.col("id") / 26).cast("string")).alias("s"))
    out = [r.p for r in pairs.select(pii.permute_letters(F.col("s"), F.lit("t"), COLUMN(KEY)).alias("p")).collect()]
    assert len(set(out)) == 260


def test_long_text_and_empty_table(spark):
    text = "word 10.1.2.3 " * 5000
    got = run(spark, [text, "a" * 300_000 + " 1 @", "-" * 300_000 + "@1", "x@" + "a-" * 150_000])
    assert [got[i].n_found for i in (1, 2, 3)] == [0, 0, 0]
    assert got[0].n_found == 5000 and len(set(re.findall(r"[\d.]{7,}", got[0].text))) == 1
    assert pii.pseudonymize(spark.createDataFrame([], SCHEMA), KEY).count() == 0


VALUES = {
    "email": ["a.b9@mail.example.com"],
    "secret": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'],
    "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "BE68 5390 0754 7034", "NO93 8601 1117 947"],
    "date": ["2024-05-17", "28/02/1987", "28.02.1987"],
    "ip": ["192.168.10.20", "10.0.255.1"],
    "phone": ["+1 (168) 555-5254", "+1 168 555 5254", "+11685555254", "+49 30 123456", "+44 20 7946 0958", "+33 12-34-56-78-90", "+49 (30) 1234-5678"],
    "ip6": ["2001:db8::ff00:42:8329", "FE80:0:0:0:202:B3FF:FE1E:8329"],
    "ssn": ["123-45-6789"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"],
}


def test_each_kind_directly_after_each(spark):
    one = [(k, v) for k, values in VALUES.items() for v in values]
    pairs = [((k, v), (m, w)) for k, v in one for m, w in one]
    texts = [v for _, v in one] + [f"{v} {w}" for (_, v), (_, w) in pairs]
    got = run(spark, texts)
    alone = {v: got[i].text for i, (_, v) in enumerate(one)}
    assert [got[i].kinds for i in range(len(one))] == [k for k, _ in one]
    wrong = [(v, w, got[len(one) + i].kinds) for i, ((k, v), (m, w)) in enumerate(pairs) if got[len(one) + i].kinds != f"{k},{m}" or got[len(one) + i].text != f"{alone[v]} {alone[w]}"]
    assert not wrong


def test_phone_stops_at_plain_numbers(spark):
    phones = ["+1 (168) 555-5254", "+1-168-555-5254", "+1 168 555 5254", "+33 12-34-56-78-90", "+49 (30) 1234-5678"]
    tails = ["12 apples", "2024", "12.5 kg", "1234 5678 9012"]
    got = run(spark, phones + [f"{p} {t}" for p in phones for t in tails] + ["+49 30 1234 5678 9012 34", "+49 30 1234567 12.50"])
    for i, p in enumerate(phones):
        assert got[i].kinds == "phone" and got[i].text != p
        assert [got[len(phones) + i * len(tails) + j].text for j in range(len(tails))] == [f"{got[i].text} {t}" for t in tails]
    assert [r.kinds for i, r in sorted(got.items())[-2:]] == ["phone", "phone"] and got[len(got) - 1].text.endswith(" 12.50")


class Python:
    """The permutations by themselves, in plain Python, and their inverses."""

    def __init__(self, key, inverse=False):
        self.inner, self.outer = (hashlib.sha256(f"{n}|{key}".encode()).hexdigest() for n in ("inner", "outer"))
        self.sign = -1 if inverse else 1

    def keyed(self, tweak, i, half, wide=False):
        inner = hashlib.sha256("|".join([self.inner, tweak, str(i), str(half)]).encode()).hexdigest()
        return (hashlib.sha512 if wide else hashlib.sha256)((self.outer + inner).encode()).hexdigest()

    def feistel(self, a, b, a_size, b_size, tweak):
        for i in range(8)[:: self.sign]:
            add = self.sign * int(self.keyed(tweak, i, a if i % 2 else b)[:15], 16)
            a, b = (a, (b + add) % b_size) if i % 2 else ((a + add) % a_size, b)
        return a, b

    def digits(self, d, tweak):
        n = len(d) // 2
        a, b = self.feistel(int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n), f"{tweak}:{len(d)}")
        return f"{a:0{n}}{b:0{len(d) - n}}"

    def letters(self, text, tweak, alphabets):
        n = len(text) // 2
        halves = [text[:n], text[n:]]
        for i in range(6)[:: self.sign]:
            pad, own = self.keyed(tweak, i, halves[i % 2], wide=True), halves[1 - i % 2]
            out = ""
            for k, c in enumerate(own):
                alphabet = next((a for a in alphabets if c in a), None)
                by = self.sign * int(pad[k % 64 * 2 : k % 64 * 2 + 2], 16)
                out += alphabet[(alphabet.index(c) + by) % len(alphabet)] if alphabet else c
            halves[1 - i % 2] = out
        return "".join(halves)


HEX, SIMPLE = ["0123456789abcdef"], [string.ascii_lowercase, string.digits]


def by_hand(value, kind, p):
    d = re.sub("[^0-9]", "", value)
    fill = lambda digits: (lambda rest: re.sub("[0-9]", lambda _: next(rest), value))(iter(digits))
    if kind == "card":
        payload = p.digits(d[:-1], "card")
        return fill(payload + next(c for c in "0123456789" if luhn(payload + c)))
    if kind == "phone":
        country = re.match(pii.COUNTRY_CODE, d)[1]
        return fill(country + p.digits(d[len(country) :], f"phone{country}"))
    if kind == "ssn":
        area, rest = int(d[:3]), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1
        a, b = p.feistel(area - (2 if area > 666 else 1), rest, 898, 99 * 9999, "ssn")
        return f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if kind == "ip":
        o = list(map(int, value.split(".")))
        a, b = p.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ip6":
        return ipaddress.ip_address(int(p.letters(ipaddress.ip_address(value).exploded.replace(":", ""), "ip6", HEX), 16)).exploded
    if kind == "email":
        local, domain = value.split("@")
        new = p.letters(local.lower(), f"email@{domain.lower()}", SIMPLE)
        return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + "@" + domain
    if kind == "secret":
        return value[:9] + p.letters(value[9:-1], "secret", HEX) + value[-1]
    if kind == "iban":
        c = value.replace(" ", "")
        new = p.digits(c[4:], f"iban{c[:2]}")
        check = 98 - int("".join(str(int(x, 36)) for x in f"{new}{c[:2]}00")) % 97
        return fill(f"{check:02}{new}")
    form = "%Y-%m-%d" if value[4] == "-" else f"%d{value[2]}%m{value[2]}%Y"
    n = (datetime.datetime.strptime(value, form).date() - datetime.date(1700, 1, 1)).days
    a, b = p.feistel(n // 773, n % 773, 189, 773, "date")
    return (datetime.date(1700, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(form)


def test_all_kinds_as_plain_python_and_back(spark):
    one = [(k, v) for k, values in VALUES.items() for v in values]
    got = run(spark, [v for _, v in one])
    back = {r.doc_id: r.text for r in pii.restore(spark.createDataFrame([(i, r.text, 0, "x") for i, r in got.items()], SCHEMA), KEY).collect()}
    for i, (kind, value) in enumerate(one):
        assert got[i].text == by_hand(value, kind, Python(KEY)) != value, (kind, value)
        plain = ipaddress.ip_address(value).exploded if kind == "ip6" else value
        assert by_hand(got[i].text, kind, Python(KEY, inverse=True)) == plain == back[i]


def test_equal_values_stay_linked_however_they_are_written(spark):
    got = run(spark, ["+49 170 1234567", "+491701234567", "Bob@x.com", "bob@x.com", "BOB@x.com", "2001:db8::1:0:2", "2001:0DB8:0:0:0:1::2", "a@x.com", "a@y.com", "a::b std::vector 12::30", "2001:0db8:0:0:0:1:0:2"])
    text = [got[i].text for i in range(len(got))]
    assert re.sub("[^0-9]", "", text[0]) == text[1][1:] and text[0].startswith("+49 ")
    assert text[2].lower() == text[3] == text[4].split("@")[0].lower() + "@x.com" and text[2][0].isupper()
    assert text[5] == text[6] == text[10] and got[9].n_found == 0
    many = run(spark, [f"a@{c}.com" for c in string.ascii_lowercase])
    assert len({r.text[0] for r in many.values()}) > 5


def test_the_key_is_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    out = pii.pseudonymize(df, "very-secret-key")
    plan = out._jdf.queryExecution().toString()
    assert "very-secret-key" not in plan and not any(v in plan for v in pii._derived("very-secret-key").values())


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "ip 10.0.0.1", "k", "p", "f"), (1, "ip 10.0.0.1", "k", "p", "f"), (None, None, "k", "p", "f")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, key string, pieces string, new string"), KEY)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "n_found", "kinds"] and len(got) == 3 and len({r.text for r in got}) == 2


@pytest.mark.parametrize(
    "number",
    ["+49 170 1234567", "+49 170 123 45 67", "+44 7700 900123", "+86 138 1234 5678", "+351 912 345 678", "+91 98765 43210", "+55 11 91234-5678"],
)
def test_what_follows_a_phone_number_leaves_it_alone(spark, number):
    """A number behind it neither joins a whole phone number nor changes its pseudonym."""
    texts = [number, f"call {number} 12 apples", f"{number} 2024", f"{number} 3 4 5", f"at {number}, 17 times"]
    out = [r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "key").orderBy("doc_id").collect()]
    assert out[0] != number
    assert out[1:] == [t.replace(number, out[0]) for t in texts[1:]]
