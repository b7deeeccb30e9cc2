"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, labels every position, and a document's
probabilities are the mean over all its positions. It is trained here, in numpy, by backpropagation
through time: on a bounded sample of labelled rows (``fit``), or from there on every byte of all labelled
rows in Spark tasks (``fit_whole``). Prediction runs in tasks over whole texts, window after window, so a
text's length costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringe.session import spread

from .scratch import short_batches, shuffles_dropped

WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: documents of a language, windows of a document.
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 4
STEPS = 700
BATCH = 256
#: Learning from all rows: how often they are dealt out (each row once), about how many bytes of text a shard has, windows of a step, and the first rate of each round.
SHARD_BYTES, SHARD_BATCH, RATES = 2 << 20, 512, (0.006, 0.003)
#: Bytes of text that a task learns from at a time, and the fixed point of summed weights.
HELD_BYTES, FIXED = 4 << 20, 1 << 20
#: How much more a position of a rare language may weigh than one of the most frequent.
MOST_WEIGHT = 16.0
#: Windows that a task holds at a time.
TASK_WINDOWS = 4096
UNDETERMINED = "und"
#: The parts of a network that are learned.
WEIGHTS = ("table", "recurrent", "inner", "out", "bias")
#: Length classes of a text: up to 64, 256, 1024, 4096 bytes, and longer.
LENGTH_BOUNDS = (64, 256, 1024, 4096)
#: A length class's floor lies ``OF_GAP`` of the way from even scores to the score that all but ``LOW_SHARE`` of its labelled texts reach, if it has ``FLOOR_ROWS`` of them.
LOW_SHARE, OF_GAP, FLOOR_ROWS, HIGHEST_FLOOR = 0.005, 0.8, 20, 0.9


@dataclass
class Network:
    """Weights of both directions: input tables (2, 256, 3H), recurrent (2, H, 3H), bias of the candidate's recurrent part (2, H), output (2H, C), (C); and which bytes the training windows hold."""

    languages: list[str]
    table: np.ndarray
    recurrent: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    seen: np.ndarray | None = None
    #: Bytes of text that ``fit_whole`` has learned from.
    learned: int = 0

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[1]


def new_network(languages: Sequence[str], hidden: int, rng: np.random.Generator) -> Network:
    h, c = hidden, len(languages)
    return Network(
        list(languages),
        rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32),
        np.zeros((2, h), np.float32),
        rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, c)).astype(np.float32),
        np.zeros(c, np.float32),
    )


def _forward(net: Network, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """States (T, 2H, B) for codes and mask (T, B); a masked position passes the state on unchanged.

    Features come before the batch, so that each gate is one run of memory.
    """
    steps, batch = codes.shape
    h = net.hidden
    codes = codes.astype(np.intp)
    states = np.empty((steps, 2 * h, batch), net.table.dtype)
    whole = bool(mask.all())
    for d in (0, 1):
        table, recurrent, shift = np.ascontiguousarray(net.table[d].T), np.ascontiguousarray(net.recurrent[d].T), net.inner[d][:, None]
        state = np.zeros((h, batch), net.table.dtype)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x = table.take(codes[t], axis=1)
            u = recurrent @ state
            gates = x[: 2 * h]
            gates += u[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            reset, update = gates[:h], gates[h:]
            inner = u[2 * h :]
            inner += shift
            candidate = reset * inner
            candidate += x[2 * h :]
            np.tanh(candidate, out=candidate)
            new = state - candidate
            new *= update
            new += candidate
            if not whole:
                new = np.where(mask[t], new, state)
            states[t, d * h : (d + 1) * h] = state = new
    return states


def _predict(net: Network, states: np.ndarray) -> np.ndarray:
    """Probabilities (T, C, B)."""
    logits = net.out.T @ states
    logits += net.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _gradients(net: Network, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray, of_label: np.ndarray | None = None, work: dict | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Backpropagation through time of the mean cross entropy over all positions, weighted by ``of_label`` where it is given.

    Both directions take a step together: the second reads from the end. ``work`` keeps the arrays of one call for the next.
    """
    steps, batch = codes.shape
    h, kind = net.hidden, net.table.dtype
    work = {} if work is None else work
    if work.get("shape") != (steps, batch, h, kind):
        sizes = {"states": (steps + 1, 2, h, batch), "u": (steps, 2, 3 * h, batch), "gates": (steps, 2, 2 * h, batch), "candidates": (steps, 2, h, batch), "to_table": (steps, 2, 3 * h, batch), "from_out": (steps, 2, h, batch), "x": (2, 3 * h, batch), "to_u": (2, 3 * h, batch), "a": (2, h, batch), "b": (2, h, batch)}
        work |= {n: np.zeros(size, kind) for n, size in sizes.items()} | {"shape": (steps, batch, h, kind)}
    states, u, gates, candidates, to_table, from_out, x, to_u, a, b = (work[n] for n in ("states", "u", "gates", "candidates", "to_table", "from_out", "x", "to_u", "a", "b"))
    whole = bool(mask.all())
    live_at = np.stack((mask, mask[::-1]), 1)[:, :, None]
    table, recurrent = (np.ascontiguousarray(w.transpose(0, 2, 1)) for w in (net.table, net.recurrent))
    table[:, : 2 * h] *= 0.5
    recurrent[:, : 2 * h] *= 0.5
    places = codes.astype(np.intp)
    shift = net.inner[:, :, None]
    for i in range(steps):
        for d in (0, 1):
            table[d].take(places[i if d == 0 else -1 - i], axis=1, out=x[d], mode="clip")
        np.matmul(recurrent, states[i], out=u[i])
        gate, candidate, new = gates[i], candidates[i], states[i + 1]
        np.add(x[:, : 2 * h], u[i, :, : 2 * h], out=gate)
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        inner = u[i, :, 2 * h :]
        inner += shift
        np.multiply(gate[:, :h], inner, out=candidate)
        candidate += x[:, 2 * h :]
        np.tanh(candidate, out=candidate)
        np.subtract(states[i], candidate, out=new)
        new *= gate[:, h:]
        new += candidate
        if not whole:
            np.copyto(new, states[i], where=~live_at[i])
    outs = net.out.reshape(2, h, -1)
    delta = np.matmul(outs[0].T, states[1:, 0])
    delta += np.matmul(outs[1].T, states[1:, 1])[::-1]
    delta += net.bias[:, None]
    delta -= delta.max(1, keepdims=True)
    np.exp(delta, out=delta)
    delta /= delta.sum(1, keepdims=True)
    weight = (mask if of_label is None else mask * of_label[labels]).astype(kind)
    weight /= weight.sum()
    each = np.arange(batch)
    loss = -float((np.log(delta[:, labels, each] + 1e-9) * weight).sum())
    delta[:, labels, each] -= 1
    delta *= weight[:, None]
    back = delta[::-1]
    grads = {
        "out": np.concatenate([np.matmul(states[1:, d], x.transpose(0, 2, 1)).sum(0) for d, x in ((0, delta), (1, back))]),
        "bias": delta.sum((0, 2)),
        "recurrent": np.zeros_like(net.recurrent),
        "inner": np.zeros_like(net.inner),
    }
    np.matmul(outs[0], delta, out=from_out[:, 0])
    np.matmul(outs[1], back, out=from_out[:, 1])
    carried = np.zeros((2, h, batch), kind)
    for i in range(steps - 1, -1, -1):
        reset, update, inner, candidate, to = gates[i, :, :h], gates[i, :, h:], u[i, :, 2 * h :], candidates[i], to_table[i]
        carried += from_out[i]
        live = carried if whole else carried * live_at[i]
        kept = live * update
        np.multiply(candidate, candidate, out=a)
        np.subtract(1, a, out=a)
        np.subtract(live, kept, out=b)
        np.multiply(a, b, out=to[:, 2 * h :])
        np.subtract(1, update, out=a)
        a *= kept
        np.subtract(states[i], candidate, out=b)
        np.multiply(a, b, out=to[:, h : 2 * h])
        np.multiply(to[:, 2 * h :], reset, out=to_u[:, 2 * h :])
        np.subtract(1, reset, out=a)
        a *= inner
        np.multiply(a, to_u[:, 2 * h :], out=to[:, :h])
        to_u[:, : 2 * h] = to[:, : 2 * h]
        grads["recurrent"] += np.matmul(states[i], to_u.transpose(0, 2, 1))
        grads["inner"] += to_u[:, 2 * h :].sum(2)
        if not whole:
            np.copyto(kept, carried, where=~live_at[i])
        np.matmul(net.recurrent, to_u, out=carried)
        carried += kept
    # Positions of a byte are brought together by a product with one column for each byte that occurs.
    used = np.flatnonzero(np.bincount(places.ravel(), minlength=256))
    column = np.zeros(256, np.intp)
    column[used] = np.arange(len(used))
    of_byte = np.zeros((2, 3 * h, len(used)), kind)
    hot = np.zeros((batch, len(used)), kind)
    for t in range(steps):
        at = column[places[t]]
        hot[each, at] = 1
        of_byte[0] += to_table[t, 0] @ hot
        of_byte[1] += to_table[-1 - t, 1] @ hot
        hot[each, at] = 0
    grads["table"] = np.zeros_like(net.table)
    grads["table"][:, used] = of_byte.transpose(0, 2, 1)
    return grads, loss


def train(windows: Sequence[bytes], labels: Sequence[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """A network fitted to byte windows, by Adam; the same input gives the same network."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, rng)
    if len(languages) < 2:
        return net
    codes, mask = _lay_out(windows)
    net.seen = np.bincount(codes[mask], minlength=256) > 0
    classes = np.array([languages.index(x) for x in labels])
    _descend(net, codes, mask, classes, (rng.integers(0, len(windows), min(batch, len(windows))) for _ in range(steps)), steps, 0.02)
    return net


def _descend(net: Network, codes: np.ndarray, mask: np.ndarray, classes: np.ndarray, picks: Iterable[np.ndarray], steps: int, first_rate: float, of_label: np.ndarray | None = None) -> None:
    """Adam in place, a step for each pick of windows."""
    first = {n: np.zeros_like(getattr(net, n)) for n in WEIGHTS}
    second = {n: np.zeros_like(getattr(net, n)) for n in WEIGHTS}
    work: dict = {}
    for step, pick in enumerate(picks, 1):
        grads, _ = _gradients(net, codes[:, pick], mask[:, pick], classes[pick], of_label, work)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = first_rate * min(1.0, 1.2 - step / steps)
        for n in WEIGHTS:
            g = grads[n] / max(1.0, norm)
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            getattr(net, n)[...] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)


def _lay_out(windows: Sequence[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Codes and mask (T, B) of windows of up to ``width`` bytes."""
    sizes = np.array([len(w) for w in windows])
    codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), np.uint8).reshape(len(windows), width)
    return np.ascontiguousarray(codes.T), np.arange(width)[:, None] < sizes[None, :]


def document_probabilities(net: Network, texts: Sequence[str], task_windows: int = TASK_WINDOWS, unseen_even: bool = False) -> np.ndarray:
    """Mean position probabilities (documents, languages) over every byte of every text.

    With ``unseen_even`` a byte that the training windows don't hold counts evenly for all languages, as nothing was learned about it.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(parts)), counts)
    data = np.frombuffer(b"".join(p + b"\0" * (-len(p) % WINDOW) for p in parts), np.uint8).reshape(-1, WINDOW)
    in_window = np.full(len(owner), WINDOW)
    in_window[np.cumsum(counts)[counts > 0] - 1] -= (-sizes % WINDOW)[counts > 0]
    # Full windows first, so that most batches need no mask.
    order = np.argsort(in_window < WINDOW, kind="stable")
    sums = np.zeros((len(parts), len(net.languages)))
    for a in range(0, len(order), task_windows):
        rows = order[a : a + task_windows]
        codes = np.ascontiguousarray(data[rows].T)
        mask = np.arange(WINDOW)[:, None] < in_window[rows][None, :]
        probs = _predict(net, _forward(net, codes, mask))
        if unseen_even and net.seen is not None and not net.seen[codes].all():
            probs = np.where(net.seen[codes][:, None], probs, np.float32(1 / len(net.languages)))
        if not mask.all():
            probs *= mask[:, None]
        np.add.at(sums, owner[rows], probs.sum(0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def _labelled(docs: DataFrame, usable: Column | None, text_col: str, lang_col: str) -> DataFrame:
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    return labelled if usable is None else labelled.where(usable)


def labelled_sample(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame | None:
    """Rows id, lang, text: up to ``docs_per_language`` labelled rows of each language with a text, for which ``usable`` holds; None if there are none. The sample of a sample is itself.

    Those of the smallest hash of id and text, a repeated row once, and no more however many ids are null.
    """
    labelled = _labelled(docs, usable, text_col, lang_col)
    counts = dict(labelled.groupBy(lang_col).agg(F.approx_count_distinct(F.xxhash64(F.col(id_col).cast("string"), text_col))).collect())
    if not counts:
        return None
    labelled = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chance = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    share = None
    for lang, n in sorted(counts.items()):  # half as many again are ranked, so that enough are
        limit = F.lit(1.5 * docs_per_language / n + 1e-3)
        share = F.when(F.col("lang") == lang, limit) if share is None else share.when(F.col("lang") == lang, limit)
    few = labelled.withColumn("chance", chance).where(F.col("chance") < share).dropDuplicates(["lang", "id", "text"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id", "text"))
    return few.withColumn("nth", nth).where(F.col("nth") <= docs_per_language).select("id", "lang", "text")


def fit_sample(labelled: DataFrame, windows_per_doc: int = WINDOWS_PER_DOC, **options) -> Network | None:
    """A network from a ``labelled_sample``: ``windows_per_doc`` windows of each text reach the driver."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for id_, lang, text in zip(rows["id"], rows["lang"], rows["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                places = np.unique(np.linspace(0, max(0, len(data) - WINDOW), windows_per_doc).astype(int))
                out += [(id_, lang, data[p : p + WINDOW]) for p in places]
            yield pd.DataFrame(out, columns=["id", "lang", "window"])

    sample = sorted((r.lang, r.id or "", bytes(r.window)) for r in labelled.mapInPandas(cut, "id string, lang string, window binary").collect())
    if not sample:
        return None
    return train([w for _, _, w in sample], [lang for lang, _, _ in sample], **options)


def fit(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC, **options) -> Network | None:
    """A network from labelled rows of ``docs`` for which ``usable`` holds; None if there are none.

    The sample is ``docs_per_language`` documents of each language at most (chosen by a hash of id and text)
    and ``windows_per_doc`` windows of each, spread over the whole text: a documented bound, so what
    reaches the driver doesn't grow with the table.
    """
    labelled = labelled_sample(docs, usable, text_col, lang_col, id_col, docs_per_language)
    return None if labelled is None else fit_sample(labelled, windows_per_doc, **options)


def fit_whole(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """A network from every byte of all labelled rows of ``docs`` for which ``usable`` holds; None if there are none.

    It starts from the network of ``fit``. Rows are dealt by a hash of id and text to rounds and shards, each row to one;
    a round's shards all start from its network and step through their rows, and the mean of what they learn, by windows, is
    the next round's. Languages weigh alike, up to ``MOST_WEIGHT``. The driver gets one network's numbers, and partitions don't change the result.
    """
    net = fit(docs, usable, text_col, lang_col, id_col)
    if net is None:
        return None
    labelled = _labelled(docs, usable, text_col, lang_col).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit("deal")).alias("place"))
    sizes = dict(labelled.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect())
    shards = -(-sum(sizes.values()) // (len(RATES) * SHARD_BYTES))
    of_label = np.array([min(MOST_WEIGHT, max(sizes.values()) / sizes[lang]) for lang in net.languages], net.table.dtype)
    net.seen = np.zeros(256, bool)
    for k, rate in enumerate(RATES):
        own = labelled.where(F.pmod("place", F.lit(len(RATES))) == k).withColumn("shard", F.pmod(F.shiftright("place", 8), F.lit(shards)))
        net = _learned(net, own, shards, of_label, rate)
    return net


def _learned(net: Network, rows: DataFrame, shards: int, of_label: np.ndarray, rate: float) -> Network:
    """The mean network of what all shards of rows (lang, text, place, shard) learn, as whole numbers, so that no order of sums matters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(sum(getattr(net, n).size for n in WEIGHTS) + 257, np.int64)
        texts: list[bytes] = []
        labels: list[int] = []
        shard, held, windows, own = None, 0, 0, net
        class_of = {lang: i for i, lang in enumerate(net.languages)}

        def step() -> None:
            nonlocal held, windows
            cut = [t[p : p + WINDOW] for t in texts for p in range(0, len(t), WINDOW)]
            classes = np.repeat(labels, [-(-len(t) // WINDOW) for t in texts])
            codes, mask = _lay_out(cut)
            sums[-257:-1] += np.bincount(codes[mask], minlength=256)
            if len(net.languages) > 1:
                picks = np.array_split(np.random.default_rng(windows).permutation(len(cut)), -(-len(cut) // SHARD_BATCH))
                _descend(own, codes, mask, classes, picks, len(picks), rate, of_label)
            windows += len(cut)
            texts.clear()
            labels.clear()
            held = 0

        def end() -> None:
            nonlocal windows
            if texts:
                step()
            if windows:
                weights = np.concatenate([getattr(own, n).ravel() for n in WEIGHTS]).astype(np.float64)
                sums[:-257] += np.rint(weights * FIXED).astype(np.int64) * windows
                sums[-1] += windows
                windows = 0

        for batch in batches:
            for of, lang, text in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if of != shard:
                    end()
                    shard, own = of, replace(net, **{n: getattr(net, n).copy() for n in WEIGHTS})
                texts.append(text.as_py().encode("utf-8", "surrogatepass"))
                labels.append(class_of[lang])
                held += len(texts[-1])
                if held >= HELD_BYTES:
                    step()
        end()
        if sums[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "lang").select("shard", "lang", "text")
    with short_batches(rows.sparkSession), shuffles_dropped(rows.sparkSession):
        found = dict(dealt.mapInArrow(run, "sums array<long>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect())
    if not found:
        return net
    flat, out, at = np.array([found[i] for i in range(len(found))], np.int64), {}, 0
    for n in WEIGHTS:
        old = getattr(net, n)
        out[n] = (flat[at : at + old.size] / (float(FIXED) * flat[-1])).astype(old.dtype).reshape(old.shape)
        at += old.size
    return replace(net, **out, seen=net.seen | (flat[-257:-1] > 0), learned=net.learned + int(flat[-257:-1].sum()))


def language(net: Network | None, text: Column, unseen_even: bool = False) -> Column:
    """struct<lang string, score double> of a text column: the language of the largest pooled probability.

    ``und`` with score 0 for a null text and one without a letter, and for every text without a network.
    """

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang = np.full(len(texts), UNDETERMINED, object)
            score = np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net is not None else []
            start, held = 0, 0
            for k, i in enumerate(rows):  # about 4 MB of text at a time
                held += len(texts.iloc[i])
                if held > 4 << 20 or k == len(rows) - 1:
                    group = rows[start : k + 1]
                    probs = document_probabilities(net, [texts.iloc[j] for j in group], unseen_even=unseen_even)
                    best = probs.argmax(1)
                    lang[group] = np.array(net.languages, object)[best]
                    score[group] = np.minimum(1.0, probs[np.arange(len(group)), best])
                    start, held = k + 1, 0
            yield pd.DataFrame({"lang": lang, "score": score})

    return run(text)


def score_floors(net: Network, scored: DataFrame) -> list[float]:
    """For each length class the score (with ``unseen_even``) below which a text is in none of the languages.

    It is set on all rows (length, lang, score; ``length`` is the ``floor_class``) of labelled texts, counted by whole ten-thousandths of the score, so that these texts stay, and lies above even scores however many
    languages there are (two at least: of one the score is always 1). Longer texts score more surely, so a class of fewer than ``FLOOR_ROWS`` rows takes the floor of the
    next shorter one; without a shorter one it has none (0).
    """
    # At most 10,001 counts for each class, however many rows.
    counts = scored.where(F.col("lang") != UNDETERMINED).groupBy("length", F.floor(F.col("score") * 10_000).cast("int").alias("of_10000")).count().collect()
    even = 1 / len(net.languages)
    floors: list[float] = []
    for k in range(len(LENGTH_BOUNDS) + 1):
        steps = sorted((r.of_10000, r["count"]) for r in counts if r.length == k)
        upto = np.cumsum([n for _, n in steps])
        shorter = floors[-1] if floors else 0.0
        if not steps or upto[-1] < FLOOR_ROWS:
            floors.append(shorter)
        else:
            low = steps[int(np.searchsorted(upto, int(LOW_SHARE * (upto[-1] - 1)), "right"))][0] / 10_000
            floors.append(min(HIGHEST_FLOOR, even + OF_GAP * (low - even)))
    return floors


def floor_class(text: Column) -> Column:
    """The number of a text's length class, from 0."""
    return sum(((F.octet_length(text) > bound).cast("int") for bound in LENGTH_BOUNDS), F.lit(0))


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows ``<id_col>, held_out, lang_pred, score``, learned from the rows that aren't held out."""
    net = fit(docs, ~held_out(F.col(id_col)), text_col, lang_col, id_col)
    found = spread(docs.select(F.col(id_col), F.col(text_col))).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language(net, F.col(text_col)).alias("out"))
    return found.select(id_col, "held_out", F.col("out.lang").alias("lang_pred"), "out.score")
