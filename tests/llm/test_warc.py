import datetime
import random
import time

from fringe.llm import warc

UTC = datetime.UTC


def test_bytes_round_trip(spark):
    body = bytes(range(256)) * 20
    files = [
        b"".join(warc.encode_record("response", f"http://h/{i}", "2024-01-01T00:00:00Z", f"urn:{i}", 200, {"ETag": '"x"', "X-Y": "a: b"}, body[i:]) for i in range(3)),
        warc.encode_record("revisit", "http://h/0", "2024-01-02T00:00:00.5Z", "urn:r", 304, {}, b"", compress=False), b"", None,
    ]
    got = warc.read_records(spark.createDataFrame([(f, 1) for f in files], "content binary, status int")).collect()
    assert [bytes(r.payload) for r in got] == [body, body[1:], body[2:], b""]
    assert got[0].headers == {"etag": '"x"', "x-y": "a: b"} and got[0].status == 200 and got[3].type == "revisit"


def brute(rows):
    out = {}
    for r in rows:
        if r["type"] != "revisit":
            continue
        if not (r["profile"].endswith("not-modified") if r["profile"] else r["status"] == 304):
            out[r["record_id"]] = ("other_profile", None)
            continue
        key = lambda x: (x["date"] is not None, x["date"] or datetime.datetime.min, x["record_id"])
        uri = r["refers_to_uri"] or r["uri"]
        limit = (True, r["refers_to_date"], "~") if r["refers_to_date"] else key(r)
        same = [x for x in rows if x["type"] == "response" and x["status"] == 200 and x["uri"] is not None and x["uri"] == uri and key(x) <= limit]
        base = max(same, key=key, default=None)
        if base is None:
            out[r["record_id"]] = ("missing", None)
            continue
        a, b = r["headers"].get("etag"), base["headers"].get("etag")
        m, n = r["headers"].get("last-modified"), base["headers"].get("last-modified")
        agree = a == b if a and b else (m == n if m and n else None)
        out[r["record_id"]] = ("no_validator" if agree is None else "resolved" if agree else "mismatch", base["record_id"])
    return out


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        uri = rng.choice(["http://hot.org/a"] * 6 + [f"http://h.org/{rng.randrange(20)}", None])
        headers = {k: rng.choice("12") for k in ("etag", "last-modified") if rng.random() < 0.7} | {"content-length": "5", "server": str(i)}
        revisit = rng.random() < 0.5
        date = None if rng.random() < 0.03 else start + datetime.timedelta(seconds=rng.randrange(300))
        rows.append({"type": "revisit" if revisit else rng.choice(["response", "response", "request"]), "uri": uri, "date": date, "record_id": f"r{i:04}", "status": 304 if revisit else rng.choice([200, 200, 404]), "headers": headers, "digest": None, "payload": f"p{i}".encode(),
                     "profile": rng.choice([warc.NOT_MODIFIED, warc.NOT_MODIFIED, warc.IDENTICAL, None]) if revisit else None, "refers_to_uri": "http://hot.org/a" if revisit and rng.random() < 0.2 else None,
                     "refers_to_date": start + datetime.timedelta(seconds=rng.randrange(300), milliseconds=500) if revisit and rng.random() < 0.2 else None, "problem": None})
    rows.append(rows[0] | {"type": "revisit", "status": 200, "profile": None, "record_id": "r9999"})
    df = spark.createDataFrame([{**r, "slice": 1} for r in rows] + [{**rows[0], "type": "response", "status": 200, "problem": "cut short", "slice": 1, "record_id": "bad"}], warc.RECORD_SCHEMA + ", slice int")
    got = {r.record_id: r for r in warc.resolve_revisits(df, slices=7).collect()}
    want = brute(rows)
    by_id = {r["record_id"]: r for r in rows}
    assert {k: (r.resolution, r.base_id) for k, r in got.items()} == want
    for k, r in got.items():
        if r.resolution == "resolved":
            base = by_id[r.base_id]
            assert bytes(r.payload) == base["payload"] and r.headers == {**base["headers"], **{h: v for h, v in by_id[k]["headers"].items() if h != "content-length"}}
        else:
            assert r.payload is None and r.headers is None


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], warc.RECORD_SCHEMA)
    assert warc.resolve_revisits(df).count() == 0
    date = datetime.datetime(2024, 1, 1)
    one = ("response", "http://a/", date, "r", None, None, None, 200, {"etag": "1"}, None, b"x", None)
    again = ("revisit", "http://a", date + datetime.timedelta(1), "v", warc.NOT_MODIFIED, None, None, 304, {"etag": "W/1"}, None, b"", None)
    got = warc.resolve_revisits(spark.createDataFrame([one, one, again, again], warc.RECORD_SCHEMA)).collect()
    assert [r.resolution for r in got] == ["resolved", "resolved"] and bytes(got[0].payload) == b"x"
    unequal = [one[:10] + (x, None) for x in (b"1", b"2", b"3")]
    got = {bytes(warc.resolve_revisits(spark.createDataFrame([*rows, again], warc.RECORD_SCHEMA)).first().payload) for rows in (unequal, unequal[::-1])}
    assert len(got) == 1


def test_damaged_files(spark):
    """What is left of each file, and a problem where something is missing; reading goes on behind it."""
    record = lambda i, **kw: warc.encode_record("response", f"http://h/{i}", "2024-01-01T00:00:00.123456Z", f"urn:{i}", 200, {"Set": "a"}, b"payload" * 50, **kw)
    bad = bytearray(record(1))
    bad[len(bad) // 2] ^= 0xFF
    plain = record(2, compress=False)
    length = plain.split(b"Content-Length: ")[1].split(b"\r")[0]
    files = {
        "corrupt member": record(0) + bytes(bad) + record(3),
        "junk": b"\x1f\x8b\x08 no gzip at all" + record(3),
        "cut member": record(0) + record(1)[:-20],
        "length": plain.replace(b"Content-Length: " + length, b"Content-Length: abc"),
        "cut record": plain[:-300],
        "text": b"hello\nworld",
    }
    got = {}
    for name, data in files.items():
        rows = warc.read_records(spark.createDataFrame([(data,)], "content binary")).collect()
        got[name] = ([r.record_id for r in rows if r.problem is None], sum(r.problem is not None for r in rows))
    assert got == {"corrupt member": (["urn:0", "urn:3"], 1), "junk": (["urn:3"], 1), "cut member": (["urn:0"], 1), "length": ([], 1), "cut record": ([], 1), "text": ([], 0)}
    one = warc.read_records(spark.createDataFrame([(record(0),)], "content binary")).first()
    assert one.date.microsecond == 123456 and one.profile is None


def test_reading_is_linear_in_a_files_size():
    """Thousands of members in one file: each is read once."""
    record = warc.encode_record("response", "http://h/", "2024-01-01T00:00:00Z", "urn:0", 200, {}, random.Random(1).randbytes(20_000))
    began = time.perf_counter()
    assert sum(1 for _ in warc.parse_records(record * 4000)) == 4000  # 80 MB
    assert time.perf_counter() - began < 20


def test_repeated_headers():
    data = warc.encode_record("response", "http://h/", "2024-01-01T00:00:00Z", "urn:0", 200, {"Vary": "a\r\nVary: b"}, b"")
    assert dict(next(warc.parse_records(data))["headers"])["vary"] == "a, b"


def test_canonical_url(spark):
    urls = {"https://www.A.org:443/b/?z=1&utm_source=x&a=2#f": "a.org/b?a=2&z=1", "http://a.org": "a.org", "http://a.org/?ref=1": "a.org", "mailto:x": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", warc.canonical_url(df.u).alias("c")).collect()} == urls
