"""Chat formatting with loss masks found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. Nothing is assumed about
its inside: the conversation is rendered turn by turn, and what each longer prefix adds to the one
before it is that turn's span. Rendering the turn once more with its text replaced by a probe finds
where the text lies inside the span. A template whose longer output does not begin with the shorter
one has rewritten history; its conversations are reported as such, with no spans. A template may refuse
a prefix, such as no turn or a lone system turn: that prefix adds nothing, and its turns are found in the next one.

The output is one string with spans (start, end, text_start, text_end, loss). Reading it back takes roles
and texts from the string's marks alone, and what is learned from by the spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: The marks of the template below, which begin with < or [. In texts each gets a backslash after its first character.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_NEEDS = re.compile(r"\\|" + "|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes are doubled and each mark gets one after its first character, so that a plain scan finds no mark."""
    if "\\" not in text and "<" not in text and "[" not in text:
        return text
    return _NEEDS.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _name(role: str) -> str:
    """A role on one line: its line ends get a backslash, which ``unescape`` takes off again."""
    return escape(role).replace("\n", "\\\n")


def inst_template(turns: Sequence[Turn]) -> str:
    """``<s>[INST] user [/INST]`` and ``assistant </s>``; a system turn in its own marks, any other role named."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"<<SYS>>{body}<</SYS>>")
        else:
            out.append(f"<<ROLE>>{_name(role)}\n{body}<</ROLE>>")
    return "".join(out)


_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>>(?P<system>.*?)<</SYS>>|<<ROLE>>(?P<role>(?:\\.|[^\\\n])*)\n(?P<text>.*?)<</ROLE>>", re.DOTALL)


def parse_inst(formatted: str) -> list[Turn]:
    """The turns of an ``inst_template`` string, by its marks alone."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        if found["role"] is not None:
            out.append((unescape(found["role"]), unescape(found["text"])))
        else:
            out.append((found.lastgroup, unescape(found[found.lastgroup])))
        at = found.end()
    return out


#: Stands in for a text while its place is looked for; no mark and nothing that needs escaping.
PROBE = "\u2063probe\u2063"


class HistoryRewritten(ValueError):
    """A longer conversation does not begin with the shorter one's output."""


def _place(template: Template, turns: Sequence[Turn], k: int, before: str, now: str) -> tuple[int, int]:
    """Where the text of turn ``k`` lies in ``now``, the output of ``turns``."""
    probed = template([*turns[:k], (turns[k][0], PROBE), *turns[k + 1 :]])
    if not probed.startswith(before) or probed.count(PROBE, len(before)) != 1:
        raise HistoryRewritten(f"turn {k + 1}: its text has no single place")
    head = probed.index(PROBE, len(before))
    tail = len(probed) - head - len(PROBE)
    if now[:head] != probed[:head] or now[len(now) - tail :] != probed[len(probed) - tail :] or head + tail > len(now):
        raise HistoryRewritten(f"turn {k + 1}: what surrounds its text depends on it")
    return head, len(now) - tail


def render_incrementally(turns: Sequence[Turn], template: Template = inst_template) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The formatted string, and for each turn (start, end, text_start, text_end) in it.

    Raises ``HistoryRewritten`` if a prefix's output changes once a turn is added, or if a turn's text
    can't be told from what the template puts around it. A prefix that the template refuses is passed over; what it
    raises for all turns or for a probe is raised. Of turns that only come out together all but the last end with their text.
    """
    spans: list[tuple[int, int, int, int]] = []
    try:
        before = template([])
    except Exception:  # the template is any function: it may refuse no turns in whatever way
        before = ""
    waiting: list[int] = []
    for k in range(1, len(turns) + 1):
        waiting.append(k - 1)
        try:
            now = template(turns[:k])
        except Exception:
            if k == len(turns):
                raise
            continue
        if not now.startswith(before):
            raise HistoryRewritten(f"turn {k} changes what came before it")
        start = len(before)
        for i in waiting:
            head, tail = _place(template, turns[:k], i, before, now)
            if head < start:
                raise HistoryRewritten(f"turn {i + 1}: its text stands before an earlier turn's")
            end = len(now) if i == k - 1 else tail
            spans.append((start, end, head, tail))
            start = end
        before, waiting = now, []
    return before, spans


def format_one(turns: Sequence[Turn], template: Template, loss_roles: Sequence[str]) -> dict:
    """A conversation's output and spans; with ``problem`` no spans, and no output if the template raises for all turns."""
    try:
        text, spans = render_incrementally(turns, template)
    except Exception as e:  # a template is a black box: what it raises is this conversation's problem, not the job's
        try:
            whole = template(turns)
        except Exception:
            whole = None
        return {"formatted": whole, "spans": [], "problem": str(e) if isinstance(e, HistoryRewritten) else f"template raised {type(e).__name__}: {e}"}
    return {
        "formatted": text,
        "spans": [{"start": a, "end": b, "text_start": c, "text_end": d, "loss": role in loss_roles} for (a, b, c, d), (role, _) in zip(spans, turns, strict=True)],
        "problem": None,
    }


def format_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = inst_template,
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """A row for each conversation: ``<id_col>, formatted, spans, problem``.

    Turns are ordered by turn (null first), then role and text, so ties give the same output on every
    run; repeated rows are repeated turns. A null role or text counts as empty; a null id is a
    conversation of its own. Other columns are ignored; an empty table gives no rows.
    A conversation is the unit of the result and is held by one task; conversations are spread by a
    hash of their id, so a text or first turn that many share does not gather anywhere.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_one([(t["role"], t["text"]) for t in turns], template, loss_roles) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[name] for o in out], kind) for name, kind in _FORMATTED.items())], ["id", *_FORMATTED])

    # One pass of Python for each conversation: a function's column would be made again for each of its uses.
    out = grouped.select(F.col(id_col).alias("id"), "turns").mapInArrow(run, f"id {id_type}, formatted string, spans array<struct<start:int,end:int,text_start:int,text_end:int,loss:boolean>>, problem string")
    return out.withColumnRenamed("id", id_col)


_SPAN = pa.struct([*((name, pa.int32()) for name in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())])
_FORMATTED = {"formatted": pa.string(), "spans": pa.list_(_SPAN), "problem": pa.string()}


def read_back(formatted: DataFrame, id_col: str = "conv_id", parse: Callable[[str], list[Turn]] = parse_inst) -> DataFrame:
    """Digests of what the formatted strings hold: turns by ``parse``, and the text under the loss mask by the spans.

    A null string holds no turns; one that can't be parsed is a ``problem``.
    """

    def digests(text: str | None, spans: list[dict], problem: str | None) -> tuple[int, str, int, str, int, str | None]:
        turns, text = [], text or ""
        try:
            turns = parse(text)
        except ValueError as e:
            problem = problem or str(e)
        digest = sha256()
        for role, own in turns:
            digest.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
        under = "".join(unescape(text[m["text_start"] : m["text_end"]]) for m in spans if m["loss"])
        return len(turns), digest.hexdigest(), len(under), sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text), problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "problem": pa.string()}
        for batch in batches:
            out = [digests(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("formatted", "spans", "problem")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds.values()))], ["id", *kinds])

    id_type = formatted.schema[id_col].dataType.simpleString()
    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "spans", "problem")
    return rows.mapInArrow(run, f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problem string").withColumnRenamed("id", id_col)


def with_probe_conversation(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose two texts are made of the template's own marks."""
    own = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def oracle() -> str:
    """DuckDB SQL for the query: digests from the table itself, the length from the template's parts."""
    marked = "replace(body, '\\', '\\\\')"
    for mark in MARKS:
        marked = f"replace({marked}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return f"""
    with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    b as (select *, length({marked}) + case role when 'user' then {len("<s>[INST]  [/INST]")} when 'assistant' then {len("  </s>")} when 'system' then {len("<<SYS>><</SYS>>")} else {len("<<ROLE>><</ROLE>>") + 1} + length(role) end as chars from a)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
      cast(coalesce(sum(length(body)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(body, '' order by turn nulls first, role, body) filter (role = 'assistant'), '')) as loss_sha256,
      cast(sum(chars) as bigint) as formatted_chars, cast(null as varchar) as problem
    from b group by conv_id"""
