"""WARC records, and the resolution of not-modified revisits.

A revisit says that the server answered 304: its content is that of the latest earlier full response
for the same url. The two are brought together by an as-of join on the canonical url, accepted only
if the validators agree, and the stored headers are updated by those that a 304 may change.

The as-of join runs in two steps, as one url may hold most rows: time is cut into slices; within a
slice of a url rows are ordered by a window, and across slices only the last response of each is
carried on.

Files are read in one pass, a bounded piece at a time. What can't be read is a row with a ``problem``, and reading
goes on behind it.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .url_filter import ascii_lower

RECORD_SCHEMA = (
    "type string, uri string, date timestamp, record_id string, profile string, refers_to_uri string, refers_to_date timestamp, status int, headers map<string,string>, digest string, payload binary, problem string"
)
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The end of the profile's name in all versions of the format.
NOT_MODIFIED_END = "/revisit/server-not-modified"
PIECE = 1 << 18
#: Headers of the stored response that a 304 doesn't change: they describe the stored content or one connection.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "transfer-encoding")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
SLICES = 256


def encode_record(kind: str, uri: str, date: str, record_id: str, status: int, headers: dict[str, str], payload: bytes, compress: bool = True, profile: str = NOT_MODIFIED, more: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own; ``more`` are further WARC fields."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "Status")
    http = f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode("utf-8") + payload
    fields = {"WARC-Type": kind, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Record-ID": f"<{record_id}>", "Content-Type": "application/http;msgtype=response"}
    if kind == "revisit":
        fields["WARC-Profile"] = profile
    else:
        fields["WARC-Payload-Digest"] = f"md5:{md5(payload).hexdigest()}"
    fields |= {"Content-Length": str(len(block)), **(more or {})}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    record = head.encode("utf-8") + block + b"\r\n\r\n"
    return gzip.compress(record, 1, mtime=0) if compress else record


_GZIP = b"\x1f\x8b\x08"


def _members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members of a file one at a time, each with its problem if it is cut short or corrupt (then what could be read of it); a plain file as it is."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] != _GZIP[:2]:
            if rest := data[at:].strip():
                yield rest if at else data, None
            return
        member, parts, problem, began = zlib.decompressobj(31), [], None, at
        try:
            while not member.eof and at < len(data):
                parts.append(member.decompress(view[at : at + PIECE]))
                at += min(PIECE, len(data) - at) - len(member.unused_data)
            if not member.eof:
                problem = "gzip member is cut short"
        except zlib.error as e:
            problem = f"gzip member is corrupt: {e}"
            found = data.find(_GZIP, began + 1)
            at = len(data) if found < 0 else found
        yield b"".join(parts), problem


def _fields(stream: io.BytesIO) -> dict[str, str]:
    """Fields up to an empty line, names in lower case; values of a name that repeats are joined by commas."""
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _time(text: str | None) -> datetime | None:
    try:
        found = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


_EMPTY = {"type": None, "uri": None, "date": None, "record_id": None, "profile": None, "refers_to_uri": None, "refers_to_date": None, "status": None, "headers": [], "digest": None, "payload": b"", "problem": None}


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes.

    A record or member that is cut short or corrupt gives what is left of it, with a ``problem``; a length that is no
    number ends its member.
    """
    for member, broken in _members(data):
        stream, problem = io.BytesIO(member), broken
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            fields = _fields(stream)
            length = fields.get("content-length", "0")
            if not (length.isascii() and length.isdigit()):
                problem = f"content-length is no number: {length[:40]}"
                yield _EMPTY | {"type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id", "").strip("<>"), "problem": problem}
                problem = None
                break
            body = stream.read(int(length))
            own, problem = (broken or "record is cut short") if len(body) < int(length) else None, None
            block = io.BytesIO(body)
            status, headers = None, {}
            if fields.get("content-type", "").startswith("application/http"):
                first = block.readline().split()
                status = int(first[1]) if len(first) > 1 and first[1].isdigit() and len(first[1]) < 9 else None
                headers = _fields(block)
            yield {
                "type": fields.get("warc-type"),
                "uri": fields.get("warc-target-uri"),
                "date": _time(fields.get("warc-date")),
                "record_id": fields.get("warc-record-id", "").strip("<>"),
                "profile": fields.get("warc-profile"),
                "refers_to_uri": fields.get("warc-refers-to-target-uri"),
                "refers_to_date": _time(fields.get("warc-refers-to-date")),
                "status": status,
                "headers": sorted(headers.items()),
                "digest": fields.get("warc-payload-digest"),
                "payload": block.read(),
                "problem": own,
            }
        if problem:  # nothing of the member could be given with it
            yield _EMPTY | {"problem": problem}


def read_records(files: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of WARC files that are given as bytes, such as Spark's ``binaryFile`` source reads them.

    A null or empty file holds no records. Records with a ``problem`` are what is left of damaged ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, moment = pa.string(), pa.timestamp("us", "UTC")
        kinds = dict(zip(_EMPTY, (text, text, moment, text, text, text, moment, pa.int32(), pa.map_(text, text), text, pa.binary(), text), strict=True))

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds.items()], list(kinds))

        for whole in batches:
            rows, held = [], 0
            for data in whole.column(0):
                for record in parse_records(data.as_py() or b""):
                    rows.append(record)
                    held += len(record["payload"])
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return files.select(content_col).mapInArrow(run, RECORD_SCHEMA)


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment and tracking parameters; the rest of the query sorted, no slash at the path's end.

    Null for a null url and for one without ``://``.
    """
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_replace(F.regexp_replace(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """A row for each revisit: record_id, url, date, resolution, base_id, base_date, headers, payload.

    ``resolution`` is ``resolved``; ``mismatch`` if the latest earlier full response has other
    validators; ``no_validator`` if the revisit names none that the response has; ``missing`` if there is no earlier response;
    ``other_profile`` for a revisit that says something else than not modified (without a profile, a status 304 says so). Payload and
    merged headers come with ``resolved`` only. Earlier is by date, then record id; where a revisit says to which url and date it
    refers, these stand for its own. A null date is
    before all others; records of a null url find nothing. Repeated response records are the same base, of unequal ones with one id, date and
    validators that of the largest payload digest; repeated revisits each give their row; records with a ``problem``
    and extra columns are ignored; an empty table gives no rows.
    """
    if "problem" in records.columns:
        records = records.where("problem is null")
    full = (F.col("type") == "response") & (F.col("status") == 200)
    visit = F.col("type") == "revisit"
    says = visit & F.coalesce(F.col("profile").endswith(NOT_MODIFIED_END), F.col("status") == 304, F.lit(False))
    # Validators go through the join; payloads and all headers follow by id.
    validators = F.struct(F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    url = F.when(visit, F.coalesce(canonical_url(F.col("refers_to_uri")), canonical_url(F.col("uri")))).otherwise(canonical_url(F.col("uri")))
    at = F.when(visit, F.coalesce("refers_to_date", "date")).otherwise(F.col("date"))
    # Behind all responses of the date that it refers to.
    nth = F.when(visit & F.col("refers_to_date").isNotNull(), F.lit("\U0010ffff")).otherwise(F.col("record_id"))
    rows = records.where(full | visit).select(url.alias("url"), at.alias("at"), nth.alias("nth"), "date", "record_id", full.alias("full"), says.alias("says"), validators.alias("own"), "headers")
    rows = materialize(rows.withColumn("seconds", F.coalesce(F.unix_timestamp("at"), F.lit(-(1 << 40)))), "captures")
    first, last = rows.where("at is not null").agg(F.min("seconds"), F.max("seconds")).first()
    width = ((last or 0) - (first or 0)) // slices + 1
    rows = rows.withColumn("slice", F.floor(F.greatest(F.col("seconds") - (first or 0), F.lit(-1)) / width))
    base = F.struct(F.coalesce("date", F.lit("0001-01-01").cast("timestamp")).alias("at"), "record_id", "date", "own")

    ends = rows.where("full and url is not null").groupBy("url", "slice").agg(F.max(base).alias("end"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = rows.where("not full and url is not null").select("url", "slice").distinct()
    points = ends.unionByName(wanted.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))).groupBy("url", "slice").agg(F.max("end").alias("end"))
    carried = points.select("url", "slice", F.max("end").over(before).alias("carried"))
    within = Window.partitionBy("url", "slice").orderBy(F.col("at").asc_nulls_first(), "nth", F.col("full").desc(), "own").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last(F.when(F.col("full"), base), ignorenulls=True).over(within)).where("not full")
    found = near.join(carried, ["url", "slice"], "left").withColumn("base", F.when(F.col("url").isNotNull(), F.coalesce("near", "carried")))

    same_etag = _weak(F.col("own.etag")) == _weak(F.col("base.own.etag"))
    same_time = F.col("own.modified") == F.col("base.own.modified")
    # An entity tag decides where both have one; else the modification time.
    agrees = F.coalesce(same_etag, same_time)
    resolution = F.when(~F.col("says"), "other_profile").when(F.col("base").isNull(), "missing").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    told = F.when(F.col("says"), F.col("base"))
    found = found.select("record_id", "url", "date", "headers", resolution.alias("resolution"), told["record_id"].alias("base_id"), told["date"].alias("base_date"), told["own"].alias("base_own"))
    bases = records.where(full).select(F.col("record_id").alias("b_id"), F.col("date").alias("b_date"), validators.alias("b_own"), F.col("headers").alias("b_headers"), "payload")
    # Ids are unique in what crawlers write. Only where they aren't, payloads are shuffled once more to take one record of each.
    if not rows.where("full").groupBy("record_id", "date").count().where("count > 1").isEmpty():
        content = F.struct("b_headers", "payload")
        bases = bases.groupBy("b_id", "b_date", "b_own").agg(F.max_by(content, F.struct(F.sha2("payload", 256), F.to_json("b_headers"))).alias("kept")).select("b_id", "b_date", "b_own", "kept.*")
    same = (F.col("base_id") == F.col("b_id")) & F.col("base_date").eqNullSafe(F.col("b_date")) & F.col("base_own").eqNullSafe(F.col("b_own"))
    met = found.join(bases, (F.col("resolution") == "resolved") & same, "left")
    new = F.map_filter("headers", lambda k, v: ~k.isin(*FIXED_HEADERS))
    merged = F.when(F.col("resolution") == "resolved", F.map_concat(F.map_filter("b_headers", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new))
    return met.select("record_id", "url", "date", "resolution", "base_id", "base_date", merged.alias("headers"), "payload")


#: The crawl that the query makes of ``pages``, in seconds: page n is captured at START + n * PAGE_SECONDS and again in other ways around it, see ``captures_of``.
START, PAGE_SECONDS = 1_700_000_000, 10
EARLY, VISIT, CHANGE, LATE = -5, 50_000, 100_000, 200_000
EARLY_EVERY, NO_TAG_EVERY, OTHER_EVERY, CHANGED_EVERY = 11, 5, 13, 7


def captures_of(page: int | None, url: str | None, html: str | None) -> Iterator[bytes]:
    """The records of one page: a full response and a revisit after it.

    Some pages have a revisit before their first response, some revisits no validator or another profile, and some pages
    a second, changed response, followed by a revisit that names either version.
    """
    number = page or 0
    at = START + number * PAGE_SECONDS
    iso = lambda s: datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def response(body: bytes, when: int, mark: str) -> bytes:
        headers = {"Content-Type": "text/html", "Content-Length": str(len(body)), "ETag": f'"{md5(body).hexdigest()}"', "Date": iso(when), "Server": "a"}
        return encode_record("response", url or "", iso(when), f"urn:page:{page}:{mark}", 200, headers, body)

    def visit(tag: str | None, when: int, mark: str, profile: str = NOT_MODIFIED) -> bytes:
        headers = {"Content-Length": "0", "Date": iso(when), "Cache-Control": "max-age=60"} | ({"ETag": f'W/"{tag}"'} if tag else {})
        return encode_record("revisit", url or "", iso(when).replace("Z", ".500Z"), f"urn:visit:{page}:{mark}", 304, headers, b"", profile=profile)

    body = (html or "").encode("utf-8")
    changed = body + b"!"
    tag, new_tag = md5(body).hexdigest(), md5(changed).hexdigest()
    if number % EARLY_EVERY == 0:
        yield visit(tag, at + EARLY, "0")
    yield response(body, at, "a")
    yield visit(tag if number % NO_TAG_EVERY else None, at + VISIT, "1", NOT_MODIFIED if number % OTHER_EVERY else IDENTICAL)
    if number % CHANGED_EVERY == 0:
        yield response(changed, at + CHANGE, "b")
        yield visit(tag if number % (2 * CHANGED_EVERY) else new_tag, at + LATE, "2")


def crawl_of(pages: DataFrame) -> DataFrame:
    """``pages`` as WARC bytes, a row for each capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                for record in captures_of(*row):
                    out.append(record)
                    held += len(record)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "content binary")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """page_id, visit, url, resolution, base_page, base_mark, payload_md5, n_bytes, headers (one line each) of every revisit of ``crawl_of(pages)``."""
    records = materialize(read_records(crawl_of(pages)), "records")
    out = resolve_revisits(records)
    part = lambda c, i: F.element_at(F.split(F.col(c), ":"), i)
    lines = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.col("headers")[k])), "\n")
    return out.select(
        part("record_id", -2).cast("long").alias("page_id"), part("record_id", -1).alias("visit"), "url", "resolution", part("base_id", -2).cast("long").alias("base_page"), part("base_id", -1).alias("base_mark"),
        F.md5("payload").alias("payload_md5"), F.octet_length("payload").cast("long").alias("n_bytes"), lines.alias("headers"),
    )


def oracle() -> str:
    """The same over ``pages`` as DuckDB SQL: the as-of join as a window over all captures of a url."""
    iso = lambda s: f"strftime(make_timestamp(({s})::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
    return f"""
    with a as (select page_id, coalesce(html, '') as html, substr(url, instr(url, '://') + 3) as rest, instr(url, '://') > 0 as ok, {START} + page_id * {PAGE_SECONDS} as first from pages),
    b as (select *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))) as kept,
      regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', ''), '^www[.]', '') as host from a),
    c as (select page_id, first, md5(html) as tag, md5(html || '!') as new_tag, strlen(html) as n_bytes, case when ok then host || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as url from b),
    d as (select url, first as seconds, 0 as half, page_id, 'a' as mark, true as complete, true as says, tag, n_bytes from c
      union all select url, first + {CHANGE}, 0, page_id, 'b', true, true, new_tag, n_bytes + 1 from c where page_id % {CHANGED_EVERY} = 0
      union all select url, first + {EARLY}, 1, page_id, '0', false, true, tag, null from c where page_id % {EARLY_EVERY} = 0
      union all select url, first + {VISIT}, 1, page_id, '1', false, page_id % {OTHER_EVERY} <> 0, case when page_id % {NO_TAG_EVERY} <> 0 then tag end, null from c
      union all select url, first + {LATE}, 1, page_id, '2', false, true, case when page_id % {2 * CHANGED_EVERY} = 0 then new_tag else tag end, null from c where page_id % {CHANGED_EVERY} = 0),
    e as (select *, last_value(case when complete then {{'page': page_id, 'mark': mark, 'tag': tag, 'n': n_bytes, 'at': seconds}} end ignore nulls)
      over (partition by url order by seconds, half, case when complete then 'urn:page:' else 'urn:visit:' end || page_id || ':' || mark rows unbounded preceding) as base from d),
    f as (select * exclude (base), case when says and url is not null then base end as base from e where not complete),
    g as (select *, case when not says then 'other_profile' when base is null then 'missing' when tag is null then 'no_validator' when base.tag = tag then 'resolved' else 'mismatch' end as resolution from f)
    select page_id, mark as visit, url, resolution, base.page as base_page, base.mark as base_mark, case when resolution = 'resolved' then base.tag end as payload_md5, case when resolution = 'resolved' then base.n end as n_bytes,
      case when resolution = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || base.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || {iso("seconds")} || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'server: a' end as headers
    from g"""
