from __future__ import annotations

import hashlib
import time
from collections import defaultdict

import brute

from pyspark.sql import functions as F

from siftwall.llm import chat, queries

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_event_log(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "wro"),
        (1, 1, 2, "delta", "assistant", "ng"),
        (1, 1, 3, "regenerate", None, None),
        (1, 1, 5, "delta", "assistant", "d"),
        (1, 1, 4, "delta", "assistant", "goo"),
        (1, 1, 4, "delta", "assistant", "goo"),  # sent twice
        (1, 0, 9, "edit", "user", "hello"),
        (1, 2, 10, "unknown", None, "x"),
    ]
    got = chat.reconstruct(spark.createDataFrame(log, EVENTS)).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "good"), ("", "")]


def test_round_trip_of_hard_texts(spark):
    texts = [t or "" for _, t in brute.EDGES] + ["&nl;", "&amp;lt;", "<|im_end|>\n", "\n\n"]
    rows = [(7, k, "assistant" if k % 2 else "user\n&nl;", t) for k, t in enumerate(texts)]
    rows += [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(docs)
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [(t.role, t.text) for t in back[7].turns] == [(r, t) for _, _, r, t in rows[:-1]]
    assert back[7].learned == texts[1::2]
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]
    for r in rendered.collect():
        for s in r.loss_spans:
            assert "<" not in r.formatted[s.start : s.start + s.length]


def test_query(spark):
    turns = defaultdict(list)
    for r in brute.rows("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    hard = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", hard), (1, "assistant", hard)]
    got = queries.op5_chat_format(spark, brute.SMALL).collect()
    assert {r.conv_id for r in got} == set(turns) and len(got) == len(turns)
    for r in got:
        own = sorted(turns[r.conv_id])
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == digest("".join(f"{a}\n{t}\n" for _, a, t in own))
        assert r.loss_sha256 == digest(learned)


def test_empty(spark):
    assert chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS))).count() == 0


def test_streamed_log_gives_the_rows_back(spark):
    texts = [t for _, t in brute.EDGES] + ["x" * 5000, "\U0001f600" * 700, "draft: "]
    rows = [(c, k, "assistant" if k % 2 else "user", t) for c in range(12) for k, t in enumerate(texts)]
    rows += [(50, 0, "user", "twice"), (50, 0, "user", "twice"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed_events(frame.withColumn("kind", F.lit("clash")).withColumn("seq", F.lit("clash")))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.groupBy("conv_id", "seq").count().where("count > 1").isEmpty()
    got = defaultdict(list)
    for r in chat.reconstruct(log).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    want = defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role or "", t or ""))
    assert got == want
    assert chat.streamed_events(frame.limit(0)).count() == 0


def test_many_turns_in_one_conversation(spark):
    turns = spark.range(20_000).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("<\u00e9 "), "id").alias("text"),
    )
    began = time.monotonic()
    (back,) = chat.read_back(chat.render(turns)).collect()
    assert time.monotonic() - began < 10
    assert len(back.turns) == 20_000
    assert back.learned == [f"<\u00e9 {i}" for i in range(1, 20_000, 2)]
