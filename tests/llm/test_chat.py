"""Operator 13: exact round trips of roles, parts and trained texts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from consign.llm import chat

T = chat.Template()
MARKS = [*T.controls, "\\", "\n", "<", "[", "[/", "INST]", "s>", "é", "ok "]
TEXT = st.lists(st.one_of(st.sampled_from(MARKS), st.text(max_size=3)), max_size=6).map("".join)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return {"type": kind, "text": text, "ref": ref, "width": width, "height": height, "seconds": seconds, "pages": pages}


PARTS = st.lists(st.one_of(st.none(), TEXT.map(lambda t: part("text", t)), st.just(part("text")),
                           st.sampled_from(["image", "audio", "document", "video"]).map(lambda k: part(k, ref="r"))), max_size=5)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", None]), TEXT), st.one_of(st.none(), PARTS)),
                 max_size=5)


def contents(parts):
    """Neighbouring texts as one, empty ones gone; other parts as their placeholder."""
    out = []
    for p in parts or []:
        if p is None:
            continue
        if p["type"] != "text":
            out.append((T.placeholders.get(p["type"], T.other),))
        elif p["text"]:
            if out and isinstance(out[-1], str):
                out[-1] += p["text"]
            else:
                out.append(p["text"])
    return out


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_turns_come_back(turns):
    f = chat.Flattener(T, chat.Expansion())
    for role, parts in turns:
        f.turn(role, parts)
    whole = "".join(f.out)
    assert chat.parse(whole, T) == [(role or "", contents(parts)) for role, parts in turns]
    trained = [T.unescape(whole[s["start"]:s["end"]]) for s in f.spans]
    assert trained == [c for role, parts in turns if role == "assistant" for c in contents(parts) if isinstance(c, str)]
    places = [(whole[a["at"]:], T.placeholders.get(a["kind"], T.other)) for a in f.attachments]
    assert all(rest.startswith(mark) for rest, mark in places)
    assert len(places) == sum(1 for _, parts in turns for p in parts or [] if p and p["type"] != "text")


def test_expanded_tokens_and_references():
    f = chat.Flattener(T, chat.Expansion())
    f.turn("user", [part("text", "see"), part("image", ref="a.png", width=57, height=28), part("image", ref="b.png"),
                    part("audio", ref="c.wav", seconds=2.01), part("audio", ref="d.wav", seconds=float("nan")),
                    part("document", ref="e.pdf", pages=3), part("document", ref="f.pdf"), part("video", ref="g.mp4")])
    f.turn("assistant", [part("text", "yes "), part("image", ref="h.png", width=1, height=1), part("text", "no")])
    assert [(a["turn"], a["part"], a["ref"], a["tokens"]) for a in f.attachments] == [
        (0, 1, "a.png", 3), (0, 2, "b.png", 256), (0, 3, "c.wav", 51), (0, 4, "d.wav", 1), (0, 5, "e.pdf", 1536),
        (0, 6, "f.pdf", 512), (0, 7, "g.mp4", 1), (1, 1, "h.png", 1)]
    whole = "".join(f.out)
    assert whole == ("[INST]see[IMG][IMG][AUDIO][AUDIO][DOC][DOC][FILE][/INST]" "[ANS]yes [IMG]no</s>")
    assert [whole[s["start"]:s["end"]] for s in f.spans] == ["yes ", "no"]


def test_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Template(other="[a[b]")
    with pytest.raises(ValueError):
        chat.Template(other="a\\")
    with pytest.raises(ValueError):
        chat.parse("[INST]open", T)


def digest(turns):
    order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))
    whole = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in order)
    trained = "".join(x or "" for _, r, x in order if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_conversations_of_a_table(spark):
    long = "lang \\ </s> " * 60_000  # two such turns exceed a piece
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 0, None, "x"),
            (3, 0, "tool [ROLE]", "a\nb"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "user", "n"), (None, None, "assistant", "m"),
            *[(4, i, "assistant" if i % 2 else "user", long) for i in range(5)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.withColumn("parts", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("h", F.lit(0))
    pieces = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(pieces).collect()}
    assert got == {c: digest([t[1:] for t in rows if t[0] == c]) for c in {r[0] for r in rows}}
    assert pieces.filter("conv_id = 4").count() > 1
    assert pieces.filter("conv_id = 1").first()["formatted"] == "[INST]hi[/INST][ANS]\\</s>\\[INST] ok \\[/INST]</s>"


def test_typed_content_of_a_table(spark):
    content = [[part("text", "look ["), part("image", ref="i1", width=56, height=56)], None, [None, part("document", ref="d1")]]
    rows = [("c", i, "user" if i != 1 else "assistant", p) for i, p in enumerate(content)]
    df = spark.createDataFrame(rows, f"conv_id string, turn int, role string, content array<{chat.PART}>")
    (r,) = chat.format_conversations(df, content=F.col("content")).collect()
    assert r.formatted == "[INST]look [[IMG][/INST][ANS]</s>[INST][DOC][/INST]" and r.n_turns == 3
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "i1", 4), (2, 1, "document", "d1", 512)]
    assert r.expanded_tokens == 516 and all(r.formatted[a.at] == "[" for a in r.attachments)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0
