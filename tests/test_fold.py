"""Folding against the tables of Python, on every character of the basic plane and on texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexloom.functions.fold import fold
from lexloom.operators import tfidf


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_every_character_of_the_basic_plane(spark):
    rows = [(c, chr(c)) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    got = {r["c"]: r["f"] for r in spark.createDataFrame(rows, "c int, t string").select("c", fold(F.col("t")).alias("f")).collect()}
    assert {c: got[c] for c, t in rows if got[c] != plain(t)} == {}


def test_texts(spark):
    rnd = random.Random(2)
    rows = ["", "plain", "ﬁne Ｆｕｌｌ ǻ ạ", "é 한국어 ½ ﷺ", "🙂 𝒜 é"] + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0xAC00, 0xD7A4), rnd.randrange(0xFB00, 0xFB07), rnd.randrange(0x300, 0x370)])) for _ in range(60)) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    for r in got:
        # beyond the basic plane a character stays
        assert r["f"] == (None if r["t"] is None else "".join(plain(c) if ord(c) < 0x10000 else c for c in r["t"]))


def test_terms_are_folded(spark):
    df = spark.createDataFrame([("Ｌａｗ ﬁle É. ạb ǻc",)], "t string")
    assert df.select(tfidf.terms(F.col("t")).alias("x")).first()["x"] == ["law", "file", "ab", "ac", "law file", "file ab", "ab ac"]
