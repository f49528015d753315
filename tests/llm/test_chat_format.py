import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catchwater.llm import chat_format, queries
from tests.llm import cases

MARKS = ["\\", "<", "<turn>", "</turn>", "<body>", "<image>", "### Assistant:", "\\</turn>", "<\\/turn>", "</turn", "é🎉", "\n", " ok "]
PICTURE = "![a](http://x/a.png)"


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    r, out = random.Random(3), []
    for conv in range(30):
        for turn in range(r.randrange(1, 7)):
            text = "".join(r.choice([*MARKS, PICTURE, "![b](y.mp3)![c](z.pdf)"]) for _ in range(r.randrange(12)))
            out.append((conv, turn, r.choice(["user", "assistant", "system"]), text))
    out += [(50, None, "user", "first"), (50, 1, None, None), (50, 1, "<turn>\n", "\\"), (50, 0, "assistant", ""), (None, 0, "assistant", "lost"), (51, 0, "assistant", "x" * 300_000), (51, 0, "assistant", "x" * 300_000)]
    return out


def wanted(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hexed("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(said), hexed(said))
    return out


def test_texts_come_back_whole(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "conv_id long, turn long, role string, text string, formatted string, n_tokens int")
    out = chat_format.formatted(df.select("*", chat_format.parts_of(F.col("text")).alias("parts")))
    assert out.columns == ["conv_id", "formatted", "n_tokens", "turns"]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digest(out).collect()}
    assert got == wanted(rows())
    empty = df.limit(0).select("*", chat_format.parts_of(F.col("text")).alias("parts"))
    assert chat_format.digest(chat_format.formatted(empty)).count() == 0


def test_parts_of_each_kind(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), None, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    parts = [part("text", text="see <image> "), part("image", uri="a.png", width=57, height=28), part("text", text="and"), part("audio", uri="b.wav", seconds=1.5), part("document", uri="c.pdf", pages=2), part("image", uri="d.png"), part("odd", text="?"), part(None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="yes"), part("image", uri="e.png")]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = chat_format.formatted(df)
    row = out.first()
    assert row["formatted"] == "<turn>user<body>see <\\image> <image>and<audio><document><image>?</turn><turn>assistant<body>yes<image></turn><turn>user<body></turn>"
    assert [(a["kind"], a["uri"], a["tokens"]) for t in row["turns"] for a in t["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", "d.png", 1), ("image", "e.png", 1)]
    assert row["n_tokens"] == 3 + 38 + 1536 + 2
    turns = chat_format.read(out).first()["turns"]
    assert [(t["role"], t["text"], t["learned"]) for t in turns] == [("user", "see <image> and?", ""), ("assistant", "yes", "yes"), ("user", "", "")]
    start = sum(len(x) + len("</turn>") for x in row["formatted"].split("</turn>")[:1]) + row["turns"][1]["skip"]
    assert row["formatted"][start : start + row["turns"][1]["take"]] == "yes<image>"


def test_marks_are_checked():
    for marks in ({"turn": "turn>"}, {"turn": "<body>"}, {"end": "<tu"}, {"image": "<a<b>"}, {"image": "<\\>"}):
        with pytest.raises(ValueError):
            chat_format.Template(**marks)


def test_the_query(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    want = wanted([*rows(), (-7, 0, "user", said), (-7, 1, "assistant", said)])
    frame = queries.op13_chat_formatting(spark, path)
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in frame.collect()} == want
    plan = frame._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_many_cases(spark):
    """The rows that every operator has to bear, as messages."""
    df = cases.frame(spark).select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), chat_format.parts_of(F.col("text")).alias("parts"), "lang")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.digest(chat_format.formatted(df)).collect()}
    want = {}
    for i, t, *_ in cases.rows():
        n, chars = want.get(i, (0, 0))
        want[i] = (n + 1, chars + len(t or ""))
    assert got == want
