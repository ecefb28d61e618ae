"""Chat examples against plain Python, their masks, and what can be read back."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from gridscope.llm import oracle
from gridscope.llm.chat import conversation_digest, escaped, prefix_target_examples, unescaped
from gridscope.llm.queries import op2_prefix_targets

ODD = ["", "plain", "</turn>", "<turn>", r"<\turn", r"<\\/turn>\n", "\\", "<", "<<turn", "</turn>\n<turn>user\nx", "é𝄞\n\n", r"\### Assistant: </turn> ok"]


def test_escapes_can_be_undone(spark, frame):
    rows = frame("t string", *ODD).select("t", escaped(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescaped(F.col("e")).alias("back")).collect():
        assert r["back"] == r["t"]
        assert "<turn" not in r["e"] and "</turn" not in r["e"]
        if "turn" not in r["t"]:
            assert r["e"] == r["t"]


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = [t for r, t in turns if r == "assistant"]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
    return out


def test_odd_conversations(spark, frame):
    rows = [(1, k, ("user", "assistant", "a&b\n&n", None)[k % 4], t) for k, t in enumerate(ODD)]
    rows += [(2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (2, 0, "user", None), (3, None, "user", "no reply"), (None, 5, "assistant", "y"), (None, 4, None, "z")]
    rows += [(4, k, "assistant" if k % 2 else "user", "word " * 300) for k in range(60)]
    talks = frame("conv_id long, turn long, role string, text string, example int, turns string", *[(*r, 1, "t") for r in rows])
    examples = prefix_target_examples(talks)
    got = {r["conv_id"]: tuple(r)[1:5] for r in conversation_digest(examples).collect()}
    assert got == expected(rows)
    made = examples.collect()
    assert len([r for r in made if r["conv_id"] == 4]) == 30
    chars = {}
    for r in made:
        chars[r["conv_id"]] = chars.get(r["conv_id"], 0) + len(r["text"])
        if r["loss_end"] > r["loss_start"]:
            assert r["text"][: r["loss_start"]].endswith("<turn>assistant\n")
            assert r["text"][r["loss_end"] :] == "</turn>\n"
    assert {r["conv_id"]: r["formatted_chars"] for r in conversation_digest(examples).collect()} == chars
    # Each example's context is the example of the turn before it, continued.
    four = sorted((r for r in made if r["conv_id"] == 4), key=lambda r: r["example"])
    assert all(b["text"].startswith(a["text"]) for a, b in zip(four, four[1:]))


def test_no_rows(spark, frame):
    none = frame("conv_id long, turn long, role string, text string", (1, 1, "user", "x")).limit(0)
    assert conversation_digest(prefix_target_examples(none)).collect() == []


def test_the_plan_is_native_and_shuffles_once(spark):
    plan = op2_prefix_targets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = connection.execute(f"SELECT {', '.join(names)} FROM ({oracle.PREFIX_TARGETS})").fetchall()
    got = op2_prefix_targets(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 5
