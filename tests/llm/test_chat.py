"""Chats read back from their formatted form; layouts by fingerprint."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from headersieve.llm.chat import (
    digest_chats,
    format_chats,
    fingerprint,
    paths_of_record,
    running_sums,
    turns_of_records,
    turns_of_table,
)
from headersieve.llm.queries import op6_chat_formatting


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in chats.items():
        turns = sorted(turns)
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        yield conv, len(turns), sha(said), len(learnt), sha(learnt)


def as_sorted(rows):
    return sorted(rows, key=str)


def test_query_against_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = op6_chat_formatting(spark, sf_dir).collect()
    assert as_sorted(tuple(r)[:5] for r in got) == as_sorted(expected(rows))


def test_odd_turns(spark):
    nasty = ["[END][TURN assistant]x", "\\[", "[\\", "\\\\(", "\\(", "<|end|>", "é😀\n", "", None, "a\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(None, None, None, None), (2, 0, "user]", "q"), (2, 0, "user]", "q"), (2, 5, "assistant", "z" * 50_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, loss string")
    got = digest_chats(format_chats(turns_of_table(table))).collect()
    assert as_sorted(tuple(r)[:5] for r in got) == as_sorted(expected(rows))
    assert digest_chats(format_chats(turns_of_table(table.limit(0)))).count() == 0


def test_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        2: {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        3: {"response": "b", "prompt": "a"},
        4: {"prompt": "a", "completion": "b"},
        5: {"instruction": "a", "input": "", "output": "b"},
        6: {"question": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(7, "no json"), (8, None)]
    got = {r.conv_id: r for r in turns_of_records(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()}
    for k in range(1, 6):
        assert [(t.turn >= 0, t.role, t.text) for t in got[k].turns] == [(True, "user", "a"), (True, "assistant", "b")], k
    assert all(got[k].turns is None and got[k].layout is None for k in (6, 7, 8))
    assert fingerprint(paths_of_record(records[3])) == fingerprint({"prompt", "response"})


CHAT_ROWS = "conv_id bigint, turn bigint, role string, text string"


def in_plain_python(rows):
    """The formatted chat and loss mask of each conversation."""
    signs = {"\\": "\\\\", "[": "\\(", "]": "\\)", "<": "\\{", ">": "\\}"}
    escape = lambda text: "".join(signs.get(c, c) for c in text or "")
    chats = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        chat, mask = chats.get(conv, ("", []))
        chat += f"[TURN {escape(role)}]"
        end = len(chat) + len(escape(text))
        chats[conv] = (chat + escape(text) + "[END]", mask + ([(len(chat), end)] if role == "assistant" else []))
    return chats


def test_chats_do_not_go_to_python_workers(spark):
    """Batches of chats in Python workers took an executor beyond its memory."""
    table = spark.createDataFrame([(1, 0, "user", "a")], CHAT_ROWS)
    plan = digest_chats(format_chats(turns_of_table(table)))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Python" not in plan


def test_formatted_and_loss_against_plain_python(spark):
    draw = random.Random(6)
    parts = ["\\", "[", "]", "<", ">", "(", ")", "{", "}", "0", "1", "2", "é", "😀", "\ufeff", "\u0000", "\n", "[END]", "[TURN user]", "ab "]
    text = lambda some: "".join(draw.choice(some) for _ in range(draw.randint(0, 25)))
    ascii_only = [p for p in parts if p.isascii()]
    rows = []
    for conv in range(120):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "assistant", None, text(parts)])
            rows.append((conv, turn, role, draw.choice([None, text(parts if conv % 2 else ascii_only)])))
    # A text that begins with a byte order mark, alone and after others.
    rows += [(200, 0, "assistant", "\ufeffa"), (200, 1, "assistant", "\ufeff"), (201, 0, "user", "é"), (201, 1, "assistant", "")]
    chats = format_chats(turns_of_table(spark.createDataFrame(rows, CHAT_ROWS)))
    got = {r.conv_id: (r.formatted, [(m.start, m.end) for m in r.loss]) for r in chats.collect()}
    assert got == in_plain_python(rows)
    assert as_sorted(tuple(r)[:5] for r in digest_chats(chats).collect()) == as_sorted(expected(rows))


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"<{k}> é"[: 3 + k % 5]) for k in range(5000)]
    chats = format_chats(turns_of_table(spark.createDataFrame(rows, CHAT_ROWS)))
    got = chats.collect()[0]
    assert (got.formatted, [(m.start, m.end) for m in got.loss]) == in_plain_python(rows)[1]
    assert as_sorted(tuple(r)[:5] for r in digest_chats(chats).collect()) == as_sorted(expected(rows))


def test_running_sums(spark):
    lists = [[], [7], [1, 2], [3, 0, 5], list(range(8)), list(range(100))]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", running_sums(F.col("x")).alias("sums"))
    for r in got.collect():
        assert r.sums == [sum(r.x[: k + 1]) for k in range(len(r.x))]


def test_unknown_layout_has_an_empty_chat(spark):
    records = spark.createDataFrame([(1, json.dumps({"question": "a"})), (2, None)], "conv_id bigint, record string")
    chats = format_chats(turns_of_records(records))
    assert [(r.formatted, r.loss) for r in chats.collect()] == [("", []), ("", [])]
    assert as_sorted(map(tuple, digest_chats(chats).collect())) == [(k, 0, sha(""), 0, sha(""), 0) for k in (1, 2)]
