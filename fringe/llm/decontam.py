"""Benchmark decontamination by template windows.

A text's template has typed placeholders for numbers (in digits or in English words), units (in any
case) and names; a re-parameterised question keeps its template. Windows of five template words are joined by hash with those of the benchmark,
and an item leaks into a document if at least 80 % of its windows occur there close together and its
slots are filled consistently: what one number or name of the item became, it became everywhere, and
no two of them became the same. Where a document holds the template several times, one such place is enough.

1. Items of one template whose slots repeat in the same places are one class.
2. Documents are read once. A bitmap of all window hashes of the benchmark, whose size is fixed, passes on the
   windows that may be among them, with their places and what their slots hold; a larger benchmark lets
   more through, and changes nothing in the result.
3. A class is listed under its rarest windows only, so many that a document with 80 % of its windows
   has one of them. Hash join: documents' windows with these lists.
4. The pairs of document and class are judged on all their windows and slots.

Two templates are compared, as a capital may be a name or a sentence's start: with every capitalised
word as a name slot, and with none. Windows of fewer than three literal words say too little and are
not used. An item without any usable window in either is one window of all its words, with its numbers,
names and arithmetic signs, and leaks where these follow one another (form ``verbatim``); one without a
word holds nothing to find.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringe.session import spread

from .near_dup import text_slices
from .scratch import materialize, short_batches
from .textset import mix, word_hashes

WIDTH = 5
LITERAL_WORDS = 3
PERCENT = 80
#: Share of slots that must agree, in percent.
CONSISTENT_PERCENT = 80
#: Bits of a window's hash by which the bitmap of the benchmark's windows is addressed: 8 MB, however many there are.
BITMAP_BITS = 26
#: Between the slots of a window; no text's template holds it.
BETWEEN = "\x1f"

NUM, NAME, UNIT = "\x01", "\x02", "\x03"
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "mph", "kmh", "hz", "khz", "mhz", "ghz", "v", "w", "kw",
    "dollars", "cents", "euros", "pounds", "percent", "degrees",
)
_UNIT = rf"(?P<unit> ?(?:(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})\b|[%°€£]))?"
_UPPER = "A-ZÀ-ÖØ-Þ"
# Each pattern begins with one set of characters, which the regular expression engine scans for.
_NUMBERS = rf"(?<=[0-9])(?P<num>[0-9]*(?:[.,][0-9]+)*){_UNIT}|(?<=[$€£])(?= *[0-9])(?P<currency>)"
_SLOT = {
    "literal": re.compile(rf"[0-9$€£](?:{_NUMBERS})"),
    "names": re.compile(rf"[{_UPPER}0-9$€£](?:(?<=[{_UPPER}])(?<!\w[{_UPPER}])(?P<name>[\w'’-]*)|{_NUMBERS})"),
}
# English numbers in words; "one" is left out, as it is a pronoun as often as a number.
_ONES = ("two", "three", "four", "five", "six", "seven", "eight", "nine")
_TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000}
_IN_WORDS = {"one": 1} | {w: i for i, w in enumerate(_ONES, 2)} | {w: i for i, w in enumerate(_TEENS, 10)} | {w: 10 * i for i, w in enumerate(_TENS, 2)}
_SPELLED = re.compile(rf"(?i)\b(?=[tfsen])(?:{'|'.join((*_TENS, *_TEENS, *_ONES))})(?:[- ](?:one|{'|'.join(_ONES)}|{'|'.join(_SCALES)})\b|\b)(?:[- ](?:{'|'.join(_SCALES)})\b)?")
_CONTROL = re.compile(f"[{NUM}{NAME}{UNIT}]")
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
_STEP = np.random.default_rng(77).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
FORMS = ("names", "literal")
VERBATIM = "verbatim"
#: Words of a whole item by which it is first looked for.
KEY_WORDS = 5
_SIGNS = r"+*/=<>^%$€£°−×÷"
# Numbers, signs, characters of scripts without spaces, and runs of anything else but white space and punctuation.
_WORD = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[{re.escape(_SIGNS)}]|(?<=[0-9])\s*-(?=\s*[0-9])|[\u3040-\u30ff\u3400-\u9fff]|[^\s0-9!-/:-@\[-`{{-~“”‘’«»„…–—¿¡。，、？！：；\u3040-\u30ff\u3400-\u9fff{re.escape(_SIGNS)}]+")


def _in_digits(m: re.Match) -> str:
    value = 0
    for word in re.split("[- ]", m[0].lower()):
        value = value * _SCALES[word] if word in _SCALES else value + _IN_WORDS[word]
    return str(value)


def template(text: str, form: str, values: list[str] | None = None) -> bytes:
    """The template as words between spaces; ``values`` receives what its placeholders stand for, in order."""

    def slot(m: re.Match) -> str:
        kind, unit = m.lastgroup, ""
        if kind == "unit":
            kind, unit = "num", m["unit"]
        marks = {"name": NAME, "num": NUM, "currency": UNIT}[kind] + (f" {UNIT}" if unit else "")
        if values is not None:
            values.append(m[0][: len(m[0]) - len(unit)].lower())
            if unit:
                values.append(unit.strip().lower())
        return f" {marks} "

    if NUM in text or NAME in text or UNIT in text:
        text = _CONTROL.sub(" ", text)
    text = _SPELLED.sub(_in_digits, text)
    return _SLOT[form].sub(slot, text).lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION)


_SLOT_HASHES = np.sort(word_hashes([f"{NUM} {NAME} {UNIT}"])[0])


def windows(texts: Sequence[str | None], form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place (in template words) of every usable window."""
    words, at = word_hashes([template(t or "", form).decode("utf-8", "surrogatepass") for t in texts])
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled, slots = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    is_slot = np.isin(words, _SLOT_HASHES)
    for j in range(WIDTH):
        rolled += words[j : j + n] * _STEP[j]
        slots += is_slot[j : j + n]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    usable = (owner[:n] == owner[WIDTH - 1 :]) & (slots <= WIDTH - LITERAL_WORDS)
    which = np.flatnonzero(usable)
    return mix(rolled[which] + np.uint64(FORMS.index(form))), owner[which], which - at[owner[which]]


def all_words(text: str | None) -> list[str]:
    return [w.strip() for w in _WORD.findall((text or "").lower())]


def _key_hashes(texts: Sequence[str | None], widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place of every window of each width (up to ``KEY_WORDS``) over all words of the texts."""
    words, at = word_hashes([" ".join(all_words(t)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for width in widths:
        n = len(words) - width + 1
        if n <= 0:
            continue
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += words[j : j + n] * _STEP[j]
        which = np.flatnonzero(owner[:n] == owner[width - 1 :])
        found.append((mix(rolled[which] + np.uint64(len(FORMS) + width)), owner[which], which - at[owner[which]]))
    hashes, owners, places = zip(*found, strict=True)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)


def _slots(text: str, form: str) -> list[str]:
    """For each template word its slot's kind and value, empty for a literal word."""
    values: list[str] = []
    words = template(text, form, values).split()
    rest = iter(values)
    marks = {m.encode(): m for m in (NUM, NAME, UNIT)}
    return [marks[w] + next(rest) if w in marks else "" for w in words]


@dataclass
class Item:
    """A class of items: its form, window hashes and their places, and for each template word which slot it is (empty for a literal one). A ``verbatim`` one has its words there."""

    form: str
    hashes: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    slots: list[str] = field(default_factory=list)

    @property
    def node(self) -> bytes:
        return blake2b(repr((self.form, self.hashes, self.places, self.slots)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def describe(texts: Sequence[str | None]) -> list[list[Item]]:
    """For each item's text its class in every form in which it has a usable window; else the verbatim one; none for an item without a word."""
    out: list[list[Item]] = [[] for _ in texts]
    for form in FORMS:
        hashes, owner, places = windows(texts, form)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            # Slots of one value bear one number, so that items which differ in values alone are one class.
            seen: dict[str, str] = {"": ""}
            slots = [seen.setdefault(s, f"{s[0]}{len(seen)}") if s else "" for s in _slots(texts[i] or "", form)]
            part = slice(bounds[i], bounds[i + 1])
            out[i].append(Item(form, hashes[part].tolist(), places[part].tolist(), slots))
    for i, text in enumerate(texts):
        if not out[i] and (words := all_words(text)):
            out[i].append(Item(VERBATIM, _key_hashes([text], [min(KEY_WORDS, len(words))])[0][:1].tolist(), [0], words))
    return out


@dataclass
class Hits:
    """The windows of a text that may be the benchmark's: place, hash and, between ``BETWEEN``, the slots of each. A ``verbatim`` one has all the text's words as slots."""

    form: str
    places: list[int]
    hashes: list[int]
    slots: list[str]


def find_hits(texts: Sequence[str | None], member, widths: Sequence[int]) -> list[list[Hits]]:
    """For each text its hits in every form; ``member`` tells which of an array of hashes may be the benchmark's, ``widths`` are those of the verbatim keys."""
    out: list[list[Hits]] = [[] for _ in texts]
    for form in (*FORMS, VERBATIM) if widths else FORMS:
        hashes, owner, places = _key_hashes(texts, widths) if form == VERBATIM else windows(texts, form)
        met = np.flatnonzero(member(hashes))
        met = met[np.argsort(owner[met], kind="stable")]
        bounds = np.searchsorted(owner[met], np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            of = met[bounds[i] : bounds[i + 1]]
            at = places[of].tolist()
            if form == VERBATIM:
                slots = all_words(texts[i])
            else:
                all_slots = _slots(texts[i] or "", form)
                slots = [BETWEEN.join(all_slots[p : p + WIDTH]) for p in at]
            out[i].append(Hits(form, at, hashes[of].tolist(), slots))
    return out


def _leaks_in(share: float, agree: float) -> bool:
    return 100 * share >= PERCENT and 100 * agree >= CONSISTENT_PERCENT


def _judge(hits: Sequence[tuple[int, int, int]], n_item: int, item_slots: Sequence[str], text_slots: dict[int, str]) -> tuple[float, float]:
    """Containment and consistency of hits (text place, item place, hash).

    Slots of the item and what fills them are paired one to one, the most frequent pairs first; the share of
    slots that these pairs cover is the consistency.
    """
    filled = {q + j: text_slots[p + j] for p, q, _ in hits for j in range(WIDTH) if item_slots[q + j]}
    count = Counter((item_slots[q], value) for q, value in filled.items())
    slots: set[str] = set()
    values: set[str] = set()
    held = 0
    for (slot, value), n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        if slot not in slots and value not in values:
            slots.add(slot)
            values.add(value)
            held += n
    return len({h for *_, h in hits}) / n_item, held / len(filled) if filled else 1.0


def _alignments(pairs: Sequence[tuple[int, int, int]], n_item: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Of pairs (text place, item place, hash) those of each alignment (text place less item place) that may hold ``PERCENT`` of the item.

    First by the alignment alone, then with what inserted or missing words have moved by less than half the item: of
    each item place the hit that moved least.
    """
    ordered = sorted(pairs, key=lambda x: x[0] - x[1])
    shifts = np.array([p - q for p, q, _ in ordered])
    drift = length // 2
    for shift in np.unique(shifts).tolist():
        for reach in sorted({0, drift}):
            near = ordered[np.searchsorted(shifts, shift - reach) : np.searchsorted(shifts, shift + reach, "right")]
            if 100 * len(near) < PERCENT * n_item:
                continue
            of_place: dict[int, tuple[int, int, int]] = {}
            for x in near:
                old = of_place.get(x[1])
                if old is None or abs(x[0] - x[1] - shift) < abs(old[0] - old[1] - shift):
                    of_place[x[1]] = x
            yield list(of_place.values())


def compare(found: Hits, item: Item) -> tuple[float, float]:
    """Containment of the item's windows in a stretch of the text, and how consistently its slots are filled there.

    Of the stretches in which the item leaks, the one with the largest; only if it leaks in none, the largest of all.
    A stretch is a run of close hits, or one alignment of the item with the text. A verbatim item is there or isn't.
    """
    if item.form == VERBATIM:
        size = len(item.slots)
        there = any(h == item.hashes[0] and found.slots[p : p + size] == item.slots for p, h in zip(found.places, found.hashes, strict=True))
        return float(there), float(there)
    places = defaultdict(list)
    for h, p in zip(item.hashes, item.places, strict=True):
        places[h].append(p)
    near = [k for k, h in enumerate(found.hashes) if h in places]
    hits = [(found.places[k], found.hashes[k]) for k in near]
    if 100 * len({h for _, h in hits}) < PERCENT * len(places):
        return len({h for _, h in hits}) / len(places), 0.0
    text_slots = {found.places[k] + j: x for k in near for j, x in enumerate(found.slots[k].split(BETWEEN))}
    length = max(item.places) + WIDTH
    reach = 2 * length
    runs, start = [], 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k][0] - hits[k - 1][0] > reach:
            runs.append(hits[start:k])
            start = k

    def best_of(stretches: Iterator[list[tuple[int, int, int]]]) -> tuple[bool, float, float]:
        return max(((_leaks_in(*x), *x) for hits_ in stretches for x in [_judge(hits_, len(places), item.slots, text_slots)]), default=(False, 0.0, 0.0))

    def whole(run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        first = run[0][0] - min(places[run[0][1]])
        return [(p, min(places[h], key=lambda q, p=p: abs((p - q) - first)), h) for p, h in run]

    best = best_of(whole(run) for run in runs)
    if not best[0]:  # a run may hold the item several times, with slots filled in different ways
        several = [[(p, q, h) for p, h in run for q in places[h]] for run in runs if 100 * len({h for _, h in run}) >= PERCENT * len(places)]
        best = max(best, best_of(x for pairs in several for x in _alignments(pairs, len(places), length)))
    return best[1:]


_LIST = {"hashes": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "slots": pa.list_(pa.string())}
_LIST_SCHEMA = "hashes array<long>, places array<int>, slots array<string>"


def _signed(hashes: Sequence[int]) -> list[int]:
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def _classes(benchmark: DataFrame) -> DataFrame:
    """A row for each item (item_id, item) and form: item_id, node, form, hashes, places, slots."""
    names = ["item_id", "node", "form", *_LIST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "item"):
                found = [(i, x) for i, own in zip(batch.column("item_id").to_pylist(), describe(batch.column("item").to_pylist()), strict=True) for x in own]
                kinds = (pa.int64(), pa.binary(), pa.string(), *_LIST.values())
                rows = [(i, x.node, x.form, _signed(x.hashes), x.places, x.slots) for i, x in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return benchmark.distinct().mapInArrow(run, f"item_id long, node binary, form string, {_LIST_SCHEMA}")


def _bitmap(spark: SparkSession, windows_: DataFrame):
    """A broadcast bitmap of the hashes' first ``BITMAP_BITS`` bits: at most 2^BITMAP_BITS / 64 rows of 64 bits reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = windows_.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, item_id, containment, consistency, form of every leak into ``docs`` (id, text) of ``benchmark`` (item_id, item)."""
    members = materialize(_classes(benchmark), "members")
    classes = materialize(members.drop("item_id").dropDuplicates(["node"]), "classes")
    windows_ = materialize(classes.select("node", "form", F.explode(F.array_distinct("hashes")).alias("hash")), "windows")
    # A class's windows, the rarest first: one more than a document may lack.
    counted = windows_.join(windows_.groupBy("form", "hash").agg(F.count("*").alias("df")), ["form", "hash"])
    by_node = Window.partitionBy("node")
    ranked = counted.select("node", "form", "hash", F.row_number().over(by_node.orderBy("df", "hash")).alias("rank"), F.count("*").over(by_node).alias("size"))
    lists = materialize(ranked.where(f"rank <= size - ({PERCENT} * size + 99) div 100 + 1").select("form", "hash", "node"), "lists")
    widths = sorted(r[0] for r in classes.where(F.col("form") == VERBATIM).select(F.least(F.size("slots"), F.lit(KEY_WORDS))).distinct().collect())
    bitmap = _bitmap(docs.sparkSession, windows_)
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["doc", "id", "form", *_LIST]

    def member(hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - BITMAP_BITS)
        return (bitmap.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 40
        for whole in batches:
            id_kind = whole.schema.field("id").type
            for batch in text_slices(whole, "text"):
                found = [(doc + k, i, x) for k, (i, own) in enumerate(zip(batch.column("id").to_pylist(), find_hits(batch.column("text").to_pylist(), member, widths), strict=True)) for x in own]
                doc += batch.num_rows
                rows = [(d, i, x.form, _signed(x.hashes), x.places, x.slots) for d, i, x in found]
                kinds = (pa.int64(), id_kind, pa.string(), *_LIST.values())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    with short_batches(docs.sparkSession):
        found = materialize(spread(docs).mapInArrow(hits, f"doc long, id {id_type}, form string, {_LIST_SCHEMA}"), "hits")
    probes = found.select("doc", "form", F.explode(F.array_distinct("hashes")).alias("hash"))
    pairs = probes.join(lists, ["form", "hash"]).select("doc", "node").distinct()
    of_class = classes.select("node", F.col("form"), *[F.col(c).alias(f"item_{c}") for c in _LIST])
    pairs = pairs.join(of_class, "node").join(found, ["doc", "form"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                share, agree = compare(Hits(r["form"], r["places"], r["hashes"], r["slots"]), Item(r["form"], r["item_hashes"], r["item_places"], r["item_slots"]))
                if _leaks_in(share, agree):
                    rows.append((r["doc"], r["id"], r["node"], share, agree, r["form"]))
            kinds = (pa.int64(), batch.schema.field("id").type, pa.binary(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc", "id", "node", "containment", "consistency", "form"])

    leaks = pairs.mapInArrow(confirm, f"doc long, id {id_type}, node binary, containment double, consistency double, form string")
    order = F.struct(F.array_position(F.array(*map(F.lit, (*FORMS, VERBATIM))), F.col("form")).alias("at"), (-F.col("containment")).alias("less"), "containment", "consistency", "form")
    best = leaks.join(members.select("node", "item_id"), "node").groupBy("doc", "id", "item_id").agg(F.min(order).alias("best"))
    return best.select("id", "item_id", "best.containment", "best.consistency", "best.form")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows ``<id_col>, item_id, containment, consistency, form``: every item that leaks into a document.

    An item of several forms is reported in the first in which it leaks. Null and empty texts leak nothing and
    hold nothing; a null id is reported as null; repeated documents each report their own rows, repeated items one; other
    columns are ignored; an empty table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item"))
    return _find(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), items).withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents into which an item leaks, found by their texts' digests; a null text stays."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item"))
    bad = _find(docs.select(F.md5(text_col).alias("id"), F.col(text_col).alias("text")), items)
    bad = materialize(bad.select(F.col("id").alias("leak_digest")).distinct(), "leaks")
    return docs.join(bad, F.md5(docs[text_col]) == bad["leak_digest"], "left_anti")
