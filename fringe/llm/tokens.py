"""Token ids in Parquet files: list columns, ordered, with encodings and row groups under control.

The file format: one folder of Parquet files in ascending id order, with the columns

    doc_id, part, start_in_part, n_tokens      delta encoded
    token_ids  array<int>                      dictionary encoded

``part`` numbers the files in that order, and ``start_in_part`` counts the tokens before a document
within its part; the small table of token counts by part turns it into a place in the whole stream. Row
groups are small enough to be read alone and pages carry column indexes, so a range of documents, or
the lengths of all of them, is read without the rest of the ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .near_dup import text_slices
from .scratch import new_path, short_batches
from .textset import IS_SPACE, lowered, span_hashes

END_ID = 1
#: Between words that are encoded together; a word that holds it is encoded alone.
MARK = "\0"
#: Words whose ids a worker remembers before it starts afresh, and how many it gathers before it sorts them in.
REMEMBERED, RECENT = 2_000_000, 100_000
#: Words that the library encodes at a time; its results take far more memory than the ids.
ENCODED_WORDS = 10_000
#: Fixed value: the words that a tokenizer may look at one by one, none of which holds or crosses white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

FORMAT_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#token_ids.list.element": "true",
}


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


#: The lowest 0 to 8 bytes of a number.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _parts(step: dict | None, name: str) -> list[dict]:
    if step is None:
        return []
    return [x for part in step[name] for x in _parts(part, name)] if step["type"] == "Sequence" else [step]


def encodes_words(settings: dict) -> bool:
    """Whether a tokenizer of these settings reads upper case as lower and gives a text the ids of its white-space separated words in turn.

    Anything that isn't known to do so isn't taken to.
    """
    fine = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
    normal = _parts(settings.get("normalizer"), "normalizers")
    first = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    then = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    special = all(a["content"].startswith("<|") for a in settings.get("added_tokens", []))
    return all(n in fine for n in normal) and {"type": "Lowercase"} in normal and _parts(settings.get("pre_tokenizer"), "pretokenizers") in ([first], [first, then]) and special and not settings.get("truncation") and not settings.get("padding")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all elements of spans, one span after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


class _Known:
    """Word hashes in order, with where each word's ids are in the pool, and its bytes in theirs."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros((0, 4), np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and which are known."""
        if not len(self.keys):
            return np.zeros((len(keys), 4), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.places[at], self.keys[at] == keys

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.places = np.insert(self.keys, at, keys), np.insert(self.places, at, places, axis=0)


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file.

    Where the file's settings say that words end at white space and case doesn't matter, a text's ids are its words' ids
    in turn. Each distinct word is then encoded by the library once and found again by its hash and its bytes; a text is
    a gather. With any other settings, for texts with an accent that joins the letter before it or with what could be
    a special token's string, and where two words have one hash, the library encodes the texts as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = encodes_words(json.loads(self.tokenizer.to_str()))
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.main, self.recent = _Known(), _Known()
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.words, self.words_used = np.zeros(1 << 16, np.uint8), 0

    def plain(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids and each one's number. The library takes many words as one text, with a mark of its own id between them."""
        mark = self.plain([MARK])[0]
        if len(mark) != 1:
            ids = self.plain(words)
            return np.array([x for one in ids for x in one], np.int32), np.array([len(one) for one in ids], np.int64)
        joined = [f" {MARK} ".join(words[a : a + 1000]) + f" {MARK}" for a in range(0, len(words), 1000)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.array(one.ids, np.int32) for one in encoded])
        ends = np.flatnonzero(flat == mark[0])
        return flat[flat != mark[0]], np.diff(np.concatenate(([-1], ends))) - 1

    def _keep(self, flat: np.ndarray, pool: str, used: str) -> int:
        """Put values behind those of a pool; where they begin."""
        values, start = getattr(self, pool), getattr(self, used)
        while start + len(flat) > len(values):
            values = np.concatenate((values, np.zeros_like(values)))
        values[start : start + len(flat)] = flat
        setattr(self, pool, values)
        setattr(self, used, start + len(flat))
        return start

    def _places(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
        """Start and size in the pool of each word (a hash, and a span of lower-case ``data``); None if a word has another's hash."""
        if len(self.main.keys) + len(self.recent.keys) + len(keys) > self.remembered:
            self._forget()
        out, known = self.main.find(keys)
        missing = np.flatnonzero(~known)
        late, known = self.recent.find(keys[missing])
        out[missing[known]] = late[known]
        missing = missing[~known]
        old = np.ones(len(keys), bool)
        old[missing] = False
        if not np.array_equal(lengths[old], out[old, 3]) or not np.array_equal(data[_spans(starts[old], lengths[old])], self.words[_spans(out[old, 2], lengths[old])]):
            return None
        if not len(missing):
            return out
        word = lambda i: data[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-8")
        parts = [self._encode_words([word(i) for i in missing[a : a + ENCODED_WORDS]]) for a in range(0, len(missing), ENCODED_WORDS)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = self._keep(flat, "pool", "used")
        first_word = self._keep(data[_spans(starts[missing], lengths[missing])], "words", "words_used")
        own = lengths[missing]
        out[missing] = np.stack((first + np.cumsum(sizes) - sizes, sizes, first_word + np.cumsum(own) - own, own), 1)
        self.recent.add(keys[missing], out[missing])
        if len(self.recent.keys) > RECENT:
            self.main.add(self.recent.keys, self.recent.places)
            self.recent = _Known()
        return out

    def _as_they_are(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.plain([t or "" for t in texts])
        return np.array([x for one in ids for x in one], np.int32), np.array([len(one) for one in ids], np.int64)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if not self.by_words:
            return self._as_they_are(texts)
        parts = [(t or "").encode("utf-8") for t in texts]
        odd = [i for i, p in enumerate(parts) if b"<|" in p or b"\xcc" in p or b"\0" in p]
        whole = dict(zip(odd, self.plain([texts[i] or "" for i in odd]), strict=True))
        data = np.frombuffer(b"\n".join(b"" if i in whole else p for i, p in enumerate(parts)) + b"\n", np.uint8)
        space = IS_SPACE[data]
        before, after = np.concatenate(([True], space[:-1])), np.concatenate((space[1:], [True]))
        # A full stop or comma that ends a word is a word of its own to the tokenizer as well.
        stop = _STOP[data] & after & np.concatenate(([False], _LETTER[data[:-1]]))
        starts = np.flatnonzero(~space & before | stop)
        sizes = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, np.int32)
        if len(starts):
            lengths = np.flatnonzero(space & ~before | stop) - starts
            keys, first, which = np.unique(span_hashes(data, starts), return_index=True, return_inverse=True)
            data = lowered(data)
            if not self._same_words(data, starts, lengths, first[which]):
                return self._as_they_are(texts)
            places = self._places(keys, data, starts[first], lengths[first])
            if places is None:
                return self._as_they_are(texts)
            places = places[which, :2]
            flat = self.pool[_spans(places[:, 0], places[:, 1])]
            upto = np.cumsum(places[:, 1])
            text_lengths = [1 + (0 if i in whole else len(p)) for i, p in enumerate(parts)]
            words_before = np.searchsorted(starts, np.concatenate(([0], np.cumsum(text_lengths))))
            sizes = np.diff(np.concatenate(([0], upto))[words_before])
        if whole:
            pieces = np.split(flat, np.cumsum(sizes)[:-1])
            for i, ids in whole.items():
                pieces[i] = np.array(ids, np.int32)
                sizes[i] = len(ids)
            flat = np.concatenate(pieces)
        return flat, sizes

    @staticmethod
    def _same_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> bool:
        """Whether each word has the bytes of the word of its hash that came first: eight at a time, as one number."""
        if not np.array_equal(lengths, lengths[like]):
            return False
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        place, of, left = starts, starts[like], lengths
        while len(place):
            kept = _KEPT[np.minimum(left, 8)]
            if not np.array_equal(eight[place] & kept, eight[of] & kept):
                return False
            longer = left > 8
            place, of, left = place[longer] + 8, of[longer] + 8, left[longer] - 8
        return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text and write the folder ``path``.

    A null or empty text is the end id alone. Null ids come first; rows of one id are ordered by their
    text's hash and text; repeated rows are written as often as they occur. Other columns are ignored; an empty
    table gives a folder without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                flat, sizes = encode(batch.column("text").to_pylist())
                counts = sizes + 1
                ends = np.cumsum(counts)
                ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = flat
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.full(len(counts), part), pa.int32()),
                        pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "token_ids"],
                )
                start += int(ends[-1]) if len(ends) else 0

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spread = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    encoded = spread.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, token_ids array<int>")
    with short_batches(docs.sparkSession):
        encoded.write.options(**FORMAT_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written folder: doc_id, start (in the whole stream), n_tokens, token_ids."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row for each written part, so it is sent to all tasks, and the ids stay where they are read.
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "token_ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a written folder; the ids are digested where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            digests = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")), pa.array(digests, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path)
    digests = rows.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return digests.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` to a new folder beside the checkpoints and return its path."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return path
