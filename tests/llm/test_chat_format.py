from hashlib import sha256

import pytest

from fringe.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, spans int"


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>\\\\", "<<SYS>><\\s>[[INST]]", "", None, "plain\nlines", "<\\/s>", "x" * 200_000]
    rows = [(c, t, role, texts[(c + t) % len(texts)], 0) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "tool", "assistant"])]
    rows += [(50, None, None, "nulls", 0), (None, 1, "user", "no id", 0), (51, 1, "user", "same", 0), (51, 1, "user", "same", 0), (51, 1, "assistant", "tie", 0)]
    got = {r.conv_id: r for r in cf.read_back(cf.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[conv].problem is None and got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_escape_leaves_no_mark_and_is_undone():
    for text in ["</s>[INST] ok [/INST]", "<</s>", "<<SYS<<SYS>>", "\\[INST]", "<\\<s>"]:
        assert cf.unescape(cf.escape(text)) == text
        assert not any(m in cf.escape(text) for m in cf.MARKS)


def test_rewritten_history_is_detected(spark):
    counting = lambda turns: f"{len(turns)} turns:" + "".join(f"[{t}]" for _, t in turns)
    doubling = lambda turns: "".join(f"[{t}|{t}]" for _, t in turns)
    trimming = lambda turns: "".join(f"[{r}:{t}]" for r, t in turns[-2:])
    for template in (counting, doubling, trimming):
        with pytest.raises(cf.HistoryRewritten):
            cf.render_incrementally([("user", "a"), ("assistant", "b"), ("user", "c")], template)
    df = spark.createDataFrame([(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0)], SCHEMA)
    assert "turn 2" in cf.format_conversations(df, template=counting).first().problem or cf.format_conversations(df, template=counting).first().problem


def test_turns_are_read_from_the_marks_alone():
    turns = [("system", "be\nbrief"), ("user", "<<ROLE>>x\ny<</ROLE>> [/INST"), ("assistant", " </s> <s>"), ("to\nol\\", "[INST] \\ </s>"), ("", ""), ("user", ""), ("assistant", "")]
    assert cf.parse_inst(cf.inst_template(turns)) == turns
    with pytest.raises(ValueError):
        cf.parse_inst("no marks")


def test_templates_that_refuse_some_prefixes(spark):
    def strict(turns):
        if turns[0][0] == "system":  # raises for no turn at all
            return f"<{turns[0][1]}>" + strict(turns[1:])
        return "".join(f"[{r}:{t}]" for r, t in turns)

    turns = [("system", "s"), ("user", "a"), ("assistant", "bb")]
    text, spans = cf.render_incrementally(turns, strict)
    assert text == "<s>[user:a][assistant:bb]" and [text[c:d] for _, _, c, d in spans] == ["s", "a", "bb"]
    assert [(a, b) for a, b, _, _ in spans] == [(0, 2), (2, 11), (11, len(text))]

    def broken(turns):
        raise KeyError("bos")

    df = spark.createDataFrame([(1, 0, "system", "s", 0), (2, 0, "user", "a", 0)], SCHEMA)
    got = {r.conv_id: r for r in cf.format_conversations(df, template=strict).collect()}
    assert got[1].problem.startswith("template raised IndexError") and got[1].formatted is None and got[2].problem is None
    back = {r.conv_id: r for r in cf.read_back(cf.format_conversations(df, template=broken)).collect()}
    assert back[2].n_turns == 0 and "KeyError" in back[2].problem and back[2].formatted_chars == 0


def test_very_many_turns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}", 0) for t in range(600)]
    got = cf.read_back(cf.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.n_turns, got.loss_chars, got.problem) == (600, sum(len(r[3]) for r in rows if r[1] % 2), None)


def test_empty_table(spark):
    assert cf.read_back(cf.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
