import hashlib

import public_tokenizers
from auxograph.llm.chat import HOSTILE, escape, format_conversations, read_back, reserved_ids, unescape
from auxograph.llm.shared import Scratch
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "\\", "im_end", ">", " ", "a"]), max_size=12).map("".join))
def test_escape_is_undone(text):
    assert unescape(escape(text)) == text
    assert "<|" not in escape(text)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(said), len(loss), digest(loss))
    return out


def test_round_trip(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (c + t) + HOSTILE * (t % 3)) for c in range(6) for t in range(1 + c)]
    rows += [(9, 0, "user", None), (9, 1, "assistant", ""), (9, 2, None, "x"), (10, None, "assistant", "last"), (10, 600, "assistant", "é字"), (10, 3, "a\nb<|", "<|endoftext|>")]
    rows += [(None, 0, "assistant", "no conversation")]
    stored = format_conversations(spark.createDataFrame(rows, SCHEMA), PATH, Scratch(spark, "chat"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(stored, PATH).collect()}
    assert got == brute(rows)


def test_masks_and_offsets(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi there"), (1, 2, "assistant", "")]
    stored = format_conversations(spark.createDataFrame(rows, SCHEMA), PATH, Scratch(spark, "chat")).orderBy("turn").collect()
    at = 0
    start, middle, end = reserved_ids(PATH)
    for r in stored:
        assert r.token_start == at and r.n_tokens == len(r.ids) == len(r.loss_mask)
        at += r.n_tokens
        assert r.ids[0] == start and r.ids[-1] == end and r.ids.count(middle) == 1
    text = stored[1].ids[stored[1].ids.index(middle) + 1 : -1]
    assert [i for i, m in zip(stored[1].ids, stored[1].loss_mask) if m] == text
    assert not any(stored[0].loss_mask) and not any(stored[2].loss_mask)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "same")] * 3
    stored = format_conversations(spark.createDataFrame(rows, SCHEMA), PATH, Scratch(spark, "chat"))
    assert read_back(stored, PATH).first().n_turns == 3
    nothing = format_conversations(spark.createDataFrame([], SCHEMA), PATH, Scratch(spark, "chat"))
    assert read_back(nothing, PATH).count() == 0


def test_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "word <|im_end|> " * 120_000), (1, 1, "assistant", "é" * 900_000), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "a")]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = ("rank", "ids", "loss_mask", "token_start", "n_tokens", "_conv", "_part", "_none")
    extra = frame.withColumns({c: F.lit("clash") for c in clashing})
    stored = format_conversations(extra, PATH, Scratch(spark, "chat"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(stored, PATH).collect()}
    assert got[1] == brute(rows)[1] and got[2][0] == 3 and got[2][2] == 3
    again = {r.conv_id: r.turns_sha256 for r in read_back(format_conversations(frame.repartition(4), PATH, Scratch(spark, "chat")), PATH).collect()}
    assert again[2] == got[2][1]
