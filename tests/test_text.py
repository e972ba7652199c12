"""Text expressions and segmentation: positions, linear time, texts that hold any character."""

import random
import re
import time

from pyspark.sql import functions as F

from lexloom.config import GDPR_PATTERNS, GENERIC_PATTERNS
from lexloom.functions.text import cut, running, strip
from lexloom.operators.chunking import chunk, segments


def texts(spark, *rows):
    return spark.createDataFrame([(t,) for t in rows], "t string")


def test_segments_equal_plain_python(spark):
    rnd = random.Random(1)
    bits = ["Art 1", "Article 22", "CHAPTER\nIV", " ", "\n", "\n\n", "x", "", "y z ", "1. ", "\r\n", "(a) ", "", "\ue000", "🙂", "\x00", "PART 3"]
    rows = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 300))) for _ in range(150)] + ["", "\n", "" * 40]
    for pattern, ignore in [("^", False), *[(p, i) for _, p, i in (*GDPR_PATTERNS, *GENERIC_PATTERNS)]]:
        got = texts(spark, *rows).select("t", segments(F.col("t"), pattern, ignore).alias("s")).collect()
        for r in got:
            t, flags = r["t"], re.M | re.I if ignore else re.M
            # Java has no line start after the last line feed of a text
            starts = [m.start() for m in re.finditer(pattern, t, flags) if m.start() < len(t) or not t]
            want = [(t[a:b], a) for a, b in zip(starts, [*starts[1:], len(t)]) if len(t[a:b].strip()) >= 30]
            assert [(x["text"], x["start"]) for x in r["s"]] == want, (pattern, t)


def test_nothing_is_taken_out_of_a_text(spark):
    body = "The controller shall process personal data lawfully and keep it no longer than needed for it.\ue000"
    law = f"CHAPTER I\nArticle 1\n{body}\nArticle 2\n{body}\n"
    out = chunk(spark.createDataFrame([("GDPR", law)], "law string, text string")).orderBy("seq").collect()
    assert [r["char_offset"] for r in out] == [law.index("Article 1"), law.index("Article 2")]
    assert all(r["text"] == f"{r['article_ref']}\n{body}" for r in out)
    plain = chunk(spark.createDataFrame([("GDPR", body)], "law string, text string")).first()
    assert plain["text"] == body and plain["level"] == "document"


def test_cut_puts_the_text_together_again(spark):
    rows = ["", "a", "\na\n\nb", "ab" * 50, "b", "xy\nb"]
    got = texts(spark, *rows).select("t", cut(F.col("t"), "^|b").alias("c")).collect()
    assert all(r["c"]["before"] + "".join(r["c"]["parts"]) == r["t"] for r in got)


def test_running_sums(spark):
    rows = [[], [5], list(range(500)), [1] * 64, [2] * 65, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<bigint>").select("i", running(F.col("x")).alias("s")).collect()
    for r in got:
        x = rows[r["i"]]
        assert r["s"] == (None if x is None else [sum(x[:i]) for i in range(len(x))])


def test_time_goes_with_the_length(spark):
    lines = texts(spark, "\n".join(f"a line of some thirty characters or so {i}" for i in range(100_000)))
    blanks = texts(spark, "x" + " " * 100_000 + "y" + " " * 100_000)
    for df, column, want in ((lines, F.size(segments(F.col("t"), "^")), 100_000), (blanks, F.length(strip(F.col("t"))), 100_002)):
        df.limit(0).select(column).collect()
        start = time.time()
        assert df.select(column.alias("n")).first()["n"] == want
        assert time.time() - start < 15


def test_chunks_take_no_shuffle_and_keep_odd_texts(spark):
    long = "\n\n".join(f"Part {i} of a text that has no headings at all. " + "x" * 300 for i in range(30))
    rows = [("GDPR", None), ("GDPR", ""), ("GDPR", long), ("LGPD", None), ("ZZ", ""), ("ZZ", f"1. {long}")]
    out = chunk(spark.createDataFrame(rows, "law string, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    found = [(r["law"], r["seq"], r["text"]) for r in out.collect()]
    assert sorted(t or "" for law, _, t in found if law == "LGPD") == [""] and [t for law, _, t in found if law == "LGPD"] == [None]
    assert [s for law, s, t in found if law == "GDPR" and t in (None, "")] == [0, 0]
    pieces = [t for law, _, t in found if law == "GDPR" and t]
    assert len(pieces) > 1 and all(len(t) <= 4000 for t in pieces) and "\n\n".join(pieces) == long
