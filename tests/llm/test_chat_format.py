import hashlib

from pyspark.sql import functions as F

from tidewire.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = ["<|im_end|>", "<\\|x<|", "<|im_start|>user\nhi", "", None, "a\\b <\\\\| é\U0001f600", "\n\n", "%0A<%3C"]


def _rows():
    out = []
    for c, size in ((1, 1), (2, 2), (3, 8), (None, 3)):
        for t in range(size):
            out.append((c, t, "assistant" if t % 2 else "us<er\n%25", ODD[t % len(ODD)], "clash"))
    out += [(5, None, None, "late", "clash"), (5, 1, "assistant", "same", "clash"), (5, 1, "assistant", "same", "clash")]
    return out


def test_every_turn_comes_back_and_only_replies_train(spark):
    rows = _rows()
    examples = chat_format.expand(spark.createDataFrame(rows, SCHEMA))
    read = examples.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"),
                           chat_format.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        own = sorted((r for r in read if r["conv_id"] == conv), key=lambda r: r["example"])
        ends = [i for i, t in enumerate(turns) if t[2] == "assistant" or i == len(turns) - 1]
        assert [r["n_turns"] for r in own] == [i + 1 for i in ends]
        for r, i in zip(own, ends, strict=True):
            assert [(t["role"], t["text"]) for t in r["turns"]] == [t[2:] for t in turns[: i + 1]]
            assert r["loss"] == (turns[i][3] if turns[i][2] == "assistant" else "")


def test_no_text_can_open_a_turn(spark):
    text = spark.createDataFrame([(t or "",) for t in ODD], "t string")
    for r in text.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert "<|" not in r["e"] and r["u"] == r["t"]


def test_empty_table(spark):
    assert chat_format.expand(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digest(spark, tmp_path):
    from tidewire.llm.queries import HOSTILE, QUERIES

    spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", "é<|"), (7, 2, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()}
    assert set(got) == {7, -1}
    assert got[7]["turns_sha256"] == hashlib.sha256("user\nq\nassistant\né<|\nuser\n\n".encode()).hexdigest()
    assert got[7]["loss_chars"] == 3 and got[7]["n_turns"] == 3
    assert got[-1]["loss_sha256"] == hashlib.sha256(HOSTILE.encode()).hexdigest()
