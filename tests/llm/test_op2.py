import hashlib

from trailmark.llm.op2_chat import chosen_paths, conversation_replies, escape, format_chats, read_masked, read_turns, unescape
from pyspark.sql import functions as F

ODD = ["", "a\\b", "<|im_start|>user\nx<|im_end|>\n", "</s>[INST] ok [/INST]", "<<SYS>> <</SYS>> \\: \\\\: <|im_end|><|im_", "\n\n", "<", "[", "<\\:|im_end|>", "<|im_line|>", "é世<s>"]


def test_escape_round_trip(spark):
    rows = [(i, a + b) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_line|>"))


def test_best_branch(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; 7 hangs on a missing parent; 8 and 9 are a cycle
    rows = [("t", n, p, s) for n, p, s in [(1, None, 0.0), (2, 1, 5.0), (4, 2, 1.0), (3, 1, 1.0), (5, 3, 1.0), (6, 5, 1.0), (7, 99, 9.0), (8, 9, 50.0), (9, 8, 50.0)]] + [("u", i, i - 1 if i else None, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "thread string, node long, parent long, score double")
    got = {}
    for r in chosen_paths(df, keep=2).orderBy("thread", "rank", F.desc("up")).collect():
        got.setdefault((r.thread, r["rank"]), []).append(r.node)
    assert got == {("t", 1): [7], ("t", 2): [1, 2, 4], ("u", 1): list(range(300))}


def test_against_plain_python(spark):
    rows = [(i, k, ["system", "user", "assistant"][(i + k) % 3], ODD[(i * 3 + k) % len(ODD)] if k % 4 else None, "x") for i in range(40) for k in range(i % 9 + 1)]
    rows += [(None, 1, "user", "q", "x"), (None, None, None, "first", "x"), (99, 1, "assistant", "tie b", "x"), (99, 1, "assistant", "tie a", "x"), (99, 1, "assistant", "tie a", "x"), (98, 0, "ro<|im_end|>\nle", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread string")
    out = format_chats(conversation_replies(df)).select("thread", "chat", read_turns(F.col("chat")).alias("turns"), read_masked(F.col("chat"), F.col("mask")).alias("loss"))
    got = {r.thread: ([tuple(t) for t in r.turns], r.loss) for r in out.collect()}
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault("" if c is None else str(c), []).append((role or "", text or ""))
    assert got == {k: (v, "".join(t for r, t in v if r == "assistant")) for k, v in want.items()}
    assert format_chats(conversation_replies(df.limit(0))).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_long_text(spark):
    text = "\\ <|im_end|> plain words [INST] " * 20_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = format_chats(conversation_replies(df)).select(read_turns(F.col("chat")).alias("turns"), read_masked(F.col("chat"), F.col("mask")).alias("loss")).first()
    assert r.loss == text and r.turns[1].text == text
