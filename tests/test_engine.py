"""Every query of the engine against its SQL on the smallest tables; chunking against Python's re; stores; stages; report."""

import glob
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.config import GENERIC_PATTERNS, KEYWORDS, LAW_PATTERNS, PIPEDA_KEYWORDS
from lexloom.operators import extract as ex
from lexloom.operators import gaps, store
from lexloom.operators.chunking import chunk, large_pieces, segments
from lexloom.operators.validate import validate_json
from lexloom.plans import queries as q
from lexloom.plans import stages
from lexloom.plans.report import Report
from lexloom.sources import xmi
from lexloom.sources.laws import parse_specs, read_laws

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(records):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr(tuple(plain(v) for v in r)) for r in records)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = rows(got.select(cols).collect())
    if name in q.ORACLE_SQL:
        want = duck.sql(q.ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        assert found == rows(duck.sql(f"select {', '.join(cols)} from ({q.ORACLE_SQL[name]})").fetchall())
    else:
        assert found


def python_segments(text, pattern, ignore):
    at = [m.start() for m in re.finditer(pattern, text, re.M | (re.I if ignore else 0))]
    out = [(text[a:b], a) for a, b in zip(at, [*at[1:], len(text)])]
    return [(t, a) for t, a in out if len(t.strip()) >= 30]


FRAGMENTS = ["CHAPTER IV", "Article 12", "article 3", "1. ", "  2. ", "(a) ", "\n", "\n\n", "Section 1798.100", "§ 7", "Art. 5º", "4.1 ", "4.1.2 ", "Schedule 1", "Capítulo II", " lorem ipsum dolor sit amet consectetur", " ", "\u0085", "٣. ", "\r\n", "PART 2", "Principle 9"]


def test_segments_equal_python(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for patterns in (*LAW_PATTERNS.values(), GENERIC_PATTERNS):
        for _, pattern, ignore in patterns:
            got = {r["i"]: [(s["text"], s["start"]) for s in r["s"]] for r in df.select("i", segments(F.col("t"), pattern, ignore).alias("s")).collect()}
            for i, t in enumerate(texts):
                assert got[i] == python_segments(t, pattern, ignore), (pattern, t)


def python_pieces(text, most):
    out, cur, at = [], "", 0
    for p in re.split(r"\n{2,}", text):
        if len(cur) + len(p) > most and cur:
            out.append((cur, at))
            at += len(cur)
            cur = p
        else:
            cur = cur + "\n\n" + p if cur else p
    return [*out, (cur, at)] if cur.strip() else out


def test_large_pieces_equal_python(spark):
    rnd = random.Random(6)
    texts = ["\n" * rnd.randint(0, 3) + ("\n" * 2).join("x" * rnd.randint(0, 30) for _ in range(rnd.randint(1, 12))) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", large_pieces(F.col("t"), 50).alias("s")).collect():
        assert [(s["text"], s["start"]) for s in r["s"]] == python_pieces(texts[r["i"]], 50)


def test_chunk_hierarchy(spark):
    out = chunk(spark.createDataFrame([(k, v) for k, v in q.STATUTES.items() if k in ("GDPR", "CCPA", "FLAT")], "law string, text string")).orderBy("law", "seq").collect()
    gdpr = [(r["level"], r["article_ref"][:10]) for r in out if r["law"] == "GDPR"]
    assert ("chapter", "CHAPTER II") in gdpr and ("chapter", "CHAPTER I") not in gdpr
    assert [level for level, _ in gdpr[:3]] == ["article", "clause", "clause"]
    assert sum(r["article_ref"] == "Article 3" for r in out) > 1  # split at blank lines
    assert {r["level"] for r in out if r["law"] == "CCPA"} == {"clause", "section"}
    assert [r["level"] for r in out if r["law"] == "FLAT"] == ["document"]
    for r in out:
        words = PIPEDA_KEYWORDS if r["law"] == "PIPEDA" else KEYWORDS
        assert r["concept_tags"] == [c for c, ks in words.items() if any(k in r["text"].lower() for k in ks)]


def test_store_is_idempotent(spark, tmp_path):
    rows = chunk(spark.createDataFrame(list(q.STATUTES.items()), "law string, text string"))
    s = store.ParquetStore(spark, str(tmp_path / "chunks"))
    n = s.ingest(rows)
    assert n == rows.select("chunk_id").distinct().count() and s.ingest(rows) == 0


def test_retries_and_absence():
    answers = iter(["nonsense", '{"name": "x", "role": "Nobody"}', '```json\n{"name": "x", "role": "ThirdParty"}\n```'])
    got = ex.attempts_of("Actor", "GDPR", "Article 1", "text", lambda s, u, n: next(answers))
    assert [g[1] for g in got] == [False, False, True]
    assert ex.attempts_of("Right", "GDPR", "Article 1", "text", ex.dry_run_backend)[0][2]
    with pytest.raises(ValueError):
        ex.build_prompt("Nothing", "GDPR", "Article 1", "")


def test_unwrap():
    assert ex.unwrap('{"X": {"_a": 1, "__b": [{"_c": 2}]}}') == '{"a": 1, "__b": [{"c": 2}]}'
    assert not validate_json("Jurisdiction", '{"name": " EU "}')[1]


def test_stages_to_report(spark, tmp_path):
    path = tmp_path / "gdpr.txt"
    path.write_text("CHAPTER I\nArticle 1\nThe controller must process personal data on the basis of consent for the purpose of research. The data subject shall have the right of access. Data are kept no longer than necessary. Consent may be withdrawn. Each security measure must ensure accuracy.\nArticle 2\nNothing to see in this article, a text without anything.\n")
    laws = parse_specs([f"gdpr={path}", "broken"])
    s = store.ParquetStore(spark, str(tmp_path / "chunks"))
    assert stages.ingest(spark, laws, s) == 2
    attempts = stages.extract(s.read(), str(tmp_path / "attempts"))
    out = stages.statements(attempts).collect()
    assert [r["article_ref"] for r in out] == ["Article 1"]
    assert out[0]["legal_basis_types"] == ["Consent"] and out[0]["has_retention"] and out[0]["has_consent_withdrawal"]
    assert "legalBasis" in xmi.to_xmi("PolicyStatement", out[0]["statement_json"]) and "EClass" in xmi.ecore()
    assert "Coverage matrix" in stages.analyse(stages.statements(attempts), str(tmp_path / "report.txt"))


def test_refused_file(spark):
    with pytest.raises(ValueError):
        read_laws(spark, {"A": "x.docx"})


def test_report(spark):
    r = Report(q.statements(spark, SF))
    assert "PAIRWISE" in r.text() and '"pairwise_deltas"' in r.json()
    cov = gaps.coverage(q.statements(spark, SF))
    assert cov.count() == len(r.laws)


def test_stream(spark, tmp_path):
    from lexloom.streaming.ingest import ingest_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "FLAT.txt").write_text(q.STATUTES["FLAT"])
    s = store.ParquetStore(spark, str(tmp_path / "chunks"))
    for _ in range(2):
        ingest_stream(spark, str(folder), s, str(tmp_path / "checkpoint")).awaitTermination()
    assert s.read().count() == 1


def test_prompt_takes_the_whole_vocabulary(spark, tmp_path):
    """The only asked words stand at ranks above 512."""
    from pyspark.sql import functions as F

    frequent = " ".join(f"w{i} w{i}" for i in range(600))
    rows = [(1, frequent), (2, "w1 licensed under the apache license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), "doc_id")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = q.retrieve_prompt(spark, str(tmp_path)).collect()
    assert any("apache license" in str(r) for r in found)


def test_rules_keep_the_whole_sentence():
    import json

    from lexloom.operators.extract import rules_backend

    sentence = "The consent " + "of the data subject or of the parent " * 30 + "is given for one purpose."
    answer = json.loads(rules_backend("LegalBasis", "GDPR", "Article 1", f"A first one. {sentence} A last one."))
    assert answer["evidence"] == sentence
