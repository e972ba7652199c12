"""Chunk rows against a plain Python model; retrieval, stores, prompts, back ends and assembly."""

import hashlib
import http.server
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.config import GENERIC_PATTERNS, KEYWORDS, LAW_PATTERNS, PASS1_CONCEPTS, PIPEDA_KEYWORDS
from lexloom.functions.text import strip
from lexloom.operators import extract as ex
from lexloom.operators import gaps, prompts, retriever, store, tfidf
from lexloom.operators.chunking import chunk
from lexloom.operators.validate import CLASSES, ENUMS, validate_json
from lexloom.plans import queries as q
from lexloom.plans import stages
from lexloom.sources import xmi


# chunks


def model_segments(text, pattern, ignore):
    at = [m.start() for m in re.finditer(pattern, text, re.M | (re.I if ignore else 0))]
    return [(text[a:b], a) for a, b in zip(at, [*at[1:], len(text)]) if len(text[a:b].strip()) >= 30]


def model_pieces(text, most):
    out, cur, at = [], "", 0
    for p in re.split(r"\n{2,}", text):
        if len(cur) + len(p) > most and cur:
            out.append((cur, at))
            at += len(cur)
            cur = p
        else:
            cur = cur + "\n\n" + p if cur else p
    return [*out, (cur, at)] if cur.strip() else out


def model_chunks(law, text, least=100, most=4000):
    """Level by level, each segment stripped before the next level looks into it."""
    patterns = LAW_PATTERNS.get(law, GENERIC_PATTERNS)
    ref = lambda t: re.sub(r"\s+", " ", t.split("\n")[0].strip())[:80]
    rows = []
    tops = [(patterns[0][0], ref(t), "", t.strip(), t[:64], a) for t, a in model_segments(text, *patterns[0][1:])] or [("document", law, "", text.strip(), text[:64], 0)]
    for top in tops:
        inner = [(patterns[1][0], ref(t), top[1], t.strip(), t[:64], top[5] + a) for t, a in model_segments(top[3], *patterns[1][1:])]
        for own in inner or [top]:
            rows.append(own)
            if inner and len(patterns) > 2:
                rows += [(patterns[2][0], ref(t), own[1], t.strip(), t[:64], own[5] + a) for t, a in model_segments(own[3], *patterns[2][1:]) if len(t.strip()) >= least]
    out = []
    for level, name, parent, body, head, start in rows:
        pieces = model_pieces(body, most) if len(body) > most else []
        for t, h, a in [(p.strip(), p[:64], start + at) for p, at in pieces] or [(body, head, start)]:
            words = PIPEDA_KEYWORDS if law == "PIPEDA" else KEYWORDS
            tags = [c for c, ks in words.items() if any(k in t.lower() for k in ks)]
            out.append((hashlib.sha1(f"{law}|{name}|{h}".encode()).hexdigest()[:16], name, parent, level, tags, t, a, len(out)))
    return out


PARTS = {
    "GDPR": ["CHAPTER I\n", "CHAPTER IV Rights\n", "Article 1\n", "Article 22 Profiling\n", "1. ", "\n\n2. "],
    "LGPD": ["CAPÍTULO I\n", "CAPITULO II\n", "Art. 5º ", "Artigo 7 ", "§ 1º ", "1. "],
    "CCPA": ["Section 1798.100\n", "§ 1798.140.5 ", "(a) ", "\n (b) "],
    "PIPEDA": ["Schedule 1\n", "Principle 3\n", "4.1 Accountability\n", "4.10 Challenging\n", "4.1.2 ", " 4.3.1 "],
    "OTHER": ["PART I\n", "TITLE 4\n", "Section 2 ", "Art. 9\n", "1. ", "(c) "],
}
PROSE = ["The controller shall process personal data by consent.\n", "short\n", "\n\n", " ", "A consumer may opt-out of a transfer to a third country at any time, by e-mail or form.\n", "Data are kept no longer than necessary. ", "x" * 700 + "\n\n", "organization\n"]


@pytest.mark.parametrize("law", sorted(PARTS))
def test_chunks_equal_the_model(spark, law):
    rnd = random.Random(law)
    texts = [q.STATUTES[law]] + ["".join(rnd.choice(PARTS[law]) if rnd.random() < 0.45 else rnd.choice(PROSE) for _ in range(rnd.randint(0, 45))) for _ in range(40)]
    texts.append(PARTS[law][0] + PARTS[law][2] + ("word " * 400 + "\n\n") * 7)  # oversize, with paragraphs
    texts.append(PARTS[law][0] + PARTS[law][2] + "word " * 1500)  # and without
    # a law a text, of one family, so that the rows of each can be told apart
    for n, text in enumerate(texts):
        want = model_chunks(law, text)
        if n in (0, len(texts) - 1, len(texts) - 2) or n % 8 == 0:
            got = chunk(spark.createDataFrame([(law.lower(), text)], "law string, text string"), laws=[law]).orderBy("seq").collect()
            assert [tuple(r)[1:] for r in got] == [(a, b, c, d, e, f, g, h) for a, b, c, d, e, f, g, h in want], text
    found = chunk(spark.createDataFrame([(law, t) for t in texts], "law string, text string").repartition(3), laws=[law]).collect()
    want = sorted(tuple(map(str, r)) for t in texts for r in model_chunks(law, t))
    assert sorted(tuple(map(str, tuple(r)[1:])) for r in found) == want


def test_strip_equals_python(spark):
    texts = ["\x1c a \x1f", " b ", "\x85c\x0b", "​d", " \x1d\x1e "]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strip(F.col("t")).alias("s")).collect()
    assert all(r["s"] == texts[r["i"]].strip() for r in got)


# stores


def test_store_replaces(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, law string, text string, seq long")
    assert s.ingest(rows(("a", "X", "one", 0), ("a", "X", "two", 1), ("b", "X", "b", 2), ("c", "Y", "c", 3), ("d", "Z", "d", 4)), replace=True) == 4
    held = lambda: sorted((r["chunk_id"], r["law"], r["text"]) for r in s.read().collect())
    assert held() == [("a", "X", "two"), ("b", "X", "b"), ("c", "Y", "c"), ("d", "Z", "d")]
    assert s.ingest(rows(("a", "X", "three", 0), ("e", "X", "e", 1))) == 1 and ("a", "X", "two") in held()
    new = rows(("a", "Y", "moved", 0), ("c", "Z", "c2", 1), ("c", "Z", "c3", 2), ("f", "X", "f", 3))
    for _ in range(2):
        assert s.ingest(new, replace=True) == 3
        assert held() == [("a", "Y", "moved"), ("b", "X", "b"), ("c", "Z", "c3"), ("d", "Z", "d"), ("e", "X", "e"), ("f", "X", "f")]
    assert s.ingest(rows(("a", "Z", "gone", 0)), replace=True) == 1  # Y is left without rows
    assert s.stats() == {"": 6, "X": 3, "Z": 3}


def test_statement_store(spark, tmp_path):
    typed = q._typed(spark).withColumn("seq", F.when(F.col("law") == "A", 0).otherwise(1).cast("long")).withColumns({"article_ref": F.concat(F.lit("Art "), "law"), "statement_json": F.to_json("stmt")})
    s = store.StatementStore(spark, str(tmp_path / "statements"))
    assert s.store_many(typed) == 3 and s.store_many(typed) == 3 and s.stats() == {"": 3, "A": 1, "B": 1, "C": 1}
    row = s.for_law("b").first()
    assert (row["statement_id"], row["source_clause"], row["has_dpia"]) == ("two", "Art B", True)
    assert s.store_many(typed, replace=False) == 0
    made = s.for_law("C").first()["statement_id"]
    prefix = '{"statementId": "", "description": "d"'[:64]
    assert len(made) == 16 and prefix


# retrieval


def law_chunks(spark):
    texts = ["consent of the data subject and withdrawal of consent", "transfer to a third country", "consent by e-mail", "nothing at all to see"]
    rows = [(law, f"{law}{i}", f"Art {i}", ["LegalBasis"] if "consent" in t or "nothing" in t else ["DataTransfer"], t) for law in ("AA", "BB") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "law string, chunk_id string, article_ref string, concept_tags array<string>, text string")


def test_counts_equal_python(spark):
    texts = ["the the cat", "", "Été été a b cc", "x"]
    df = spark.createDataFrame([("L", str(i), t) for i, t in enumerate(texts)], "law string, chunk_id string, text string")
    got = sorted((r["chunk_id"], r["term"], r["tf"]) for r in tfidf.counts(df).collect())
    assert got == [("0", "cat", 1), ("0", "the", 2), ("0", "the cat", 1), ("0", "the the", 1), ("2", "cc", 1), ("2", "ete", 2), ("2", "ete cc", 1), ("2", "ete ete", 1)]


def test_retriever(spark, tmp_path):
    path = str(tmp_path / "vocabulary")
    embedder = retriever.fitted_embedder(law_chunks(spark), path)
    assert embedder.laws() == ["AA", "BB"]
    with retriever.Retriever(law_chunks(spark), embedder) as r:
        hits = r.retrieve("LegalBasis", "aa", query_text="consent withdrawal").collect()
        assert [h["chunk_id"] for h in hits] == ["AA0", "AA2", "AA3"] and hits[2]["score"] == 0.0 and hits[0]["score"] > hits[1]["score"] > 0
        assert len(r.retrieve("LegalBasis", "AA", 1).collect()) == 1
        assert [h["chunk_id"] for h in r.retrieve("LegalBasis", "AA", query_text="consent", min_score=1e-6).collect()] == ["AA2", "AA0"]
        assert r.retrieve("Right", "AA").count() == 0 and r.retrieve_for_prompt("Right", "bb") == "[No relevant text found for Right in bb]"
        assert r.retrieve_for_prompt("DataTransfer", "BB").startswith("[Source: BB | Art 1 | score=")
        assert r.stats() == {"": 8, "AA": 4, "BB": 4}
        with pytest.raises(KeyError):
            r.retrieve("LegalBasis", "CC")
    before = sorted(map(tuple, tfidf.load(spark, path).collect()))
    more = law_chunks(spark).filter("law = 'AA'").withColumns({"law": F.lit("CC"), "text": F.lit("other words")})
    assert retriever.fitted_embedder(law_chunks(spark).union(more), path).laws() == ["AA", "BB", "CC"]  # the first two are reused
    after = tfidf.load(spark, path)
    assert sorted(map(tuple, after.filter("law <> 'CC'").collect())) == before and after.filter("law = 'CC'").count() == 3


def test_retriever_with_a_model(spark):
    calls = []

    def encode(texts):
        calls.append(len(texts))
        return [[t.count("consent"), t.count("transfer"), 1.0] for t in texts]

    model = retriever.ModelEmbedder(encode, 2).fit(None)
    with retriever.Retriever(law_chunks(spark), model) as r:
        assert [h["chunk_id"] for h in r.retrieve("LegalBasis", "AA", 2, "consent consent").collect()] == ["AA0", "AA2"]
        assert r.retrieve("LegalBasis", "ZZ").count() == 0
    assert model.embed(law_chunks(spark)).select("vector").distinct().count() == 4


def test_files_to_retriever(spark, tmp_path):
    path = tmp_path / "law.txt"
    path.write_text(q.STATUTES["GDPR"])
    at = str(tmp_path / "chunks"), str(tmp_path / "vocabulary")
    first = retriever.ingest_file(spark, str(path), "gdpr", *at)
    again = retriever.ingest_file(spark, str(path), "gdpr", *at)
    assert (first["new_chunks"], again["new_chunks"], again["chunks"]) == (first["chunks"], 0, first["chunks"])
    with retriever.retriever_from_files(spark, {"GDPR": str(path)}, *at) as r:
        assert r.retrieve("RetentionPolicy", "GDPR").count() == 3


# prompts, back ends, assembly


def test_guides_are_of_the_model():
    assert set(prompts.GUIDES) == {*PASS1_CONCEPTS, "PersonalData"}
    kinds = {f.name: f.kind for fields in CLASSES.values() for f in fields}
    for concept, g in prompts.GUIDES.items():
        assert not validate_json(concept, g.example[1])[1], concept
        own = {f.name: f.kind for f in CLASSES[concept]}
        for name, signs in g.signs.items():
            assert set(signs) <= set(ENUMS[own.get(name, kinds[name])]), (concept, name)
        system, user = prompts.build_prompt(concept, "GDPR", "Article 6", "the text")
        assert user.endswith("Text:\nthe text") and g.example[1] in user and prompts.SENTINELS.get(concept, "{}") in user
    for concept, key in prompts.SENTINELS.items():
        got = ex.attempts_of(concept, "GDPR", "Article 1", "t", lambda s, u, n, key=key: json.dumps({key: True}))
        assert len(got) == 1 and got[0][1] and got[0][2]
    with pytest.raises(ValueError):
        prompts.build_prompt("Nothing", "GDPR", "Article 1", "")


def test_answers_are_unwrapped():
    answers = iter(['{"Actor": {"_name": " x ", "_role": "ThirdParty"}}'])
    got = ex.attempts_of("Actor", "GDPR", "Article 1", "t", lambda s, u, n: (next(answers), 7, 3))
    assert got[0][1] and json.loads(got[0][3])["name"] == "x" and got[0][5:] == (7, 3)


def test_ids_are_made_up_once(spark):
    raw = '{"name": "x", "role": "ThirdParty"}'
    a, b = (json.loads(validate_json("Actor", raw)[0])["actorId"] for _ in range(2))
    assert a == b and re.fullmatch("act_[0-9a-f]{8}", a)
    assert json.loads(validate_json("Actor", '{"actorId": "", "name": "x", "role": "ThirdParty"}')[0])["actorId"] == ""
    parts = json.loads(validate_json("LegalBasis", '{"type": "Consent", "evidence": "e", "jurisdiction": [{"name": "A"}, {"name": "A"}]}')[0])
    assert len({j["jurisdictionId"] for j in parts["jurisdiction"]}) == 2


ARTICLE = "The controller must process personal data on the basis of consent for the purpose of research. The data subject shall have the right of access. Each security measure must ensure accuracy."


def test_assembly_by_a_back_end(spark, tmp_path):
    rows = spark.createDataFrame([("GDPR", a, c, t) for a, t in (("Article 1", ARTICLE), ("Article 2", "Nothing.")) for c in PASS1_CONCEPTS], "law string, article_ref string, concept string, text string")
    ex.extract(rows).write.parquet(str(tmp_path / "attempts"))
    attempts = spark.read.parquet(str(tmp_path / "attempts"))
    good = json.loads(ex.assemble(ex.results(attempts)).filter("article_ref = 'Article 1'").first()["statement_json"])

    def backend(system, user, most, good=good):
        assert most == 4096
        return (json.dumps({"PolicyStatement": {"_" + k: v for k, v in good.items()}}), 10, 5) if "refused" in user else ("{}", 10, 5)

    built = stages.built(attempts, str(tmp_path / "assembly"), backend)
    log = spark.read.parquet(str(tmp_path / "assembly")).orderBy("attempt").collect()
    assert [(r["article_ref"], r["attempt"], r["success"]) for r in log] == [("Article 1", 1, False), ("Article 1", 2, True)]  # nothing was found of the other
    assert any("missing" in e for e in log[0]["errors"]) and log[0]["tokens_in"] == 10
    s = store.StatementStore(spark, str(tmp_path / "statements"))
    assert s.store_many(stages.valid(built)) == 1 and stages.rejects(built).count() == 0
    by_rule = stages.built(attempts)
    assert [r["article_ref"] for r in stages.valid(by_rule).collect()] == ["Article 1"]
    refused = stages.rejects(by_rule).collect()
    assert [r["article_ref"] for r in refused] == ["Article 2"] and any("actor: nothing found" in e for e in refused[0]["errors"])
    text = stages.summary(attempts, spark.read.parquet(str(tmp_path / "assembly")), 1, 0)
    assert "Articles: 2" in text and "18 requests, 18 calls" in text and "Second pass: 2 calls, 1 put together, 0 failed" in text and "Tokens read and written: 20 and 10" in text
    never = stages.built(attempts, str(tmp_path / "never"), ex.dry_run_backend, 1)
    assert stages.valid(never).count() == 0 and stages.rejects(never).count() == 1 and spark.read.parquet(str(tmp_path / "never")).count() == 2
    assert xmi.write_statements(s.read(), str(tmp_path / "xmi")) == 1
    assert "legalBasis" in (tmp_path / "xmi" / "gdpr_Article_1.xmi").read_text()
    xmi.write_ecore(spark, str(tmp_path / "m.ecore"))
    assert (tmp_path / "m.ecore").read_text() == xmi.ecore()


def test_rules_equal_a_direct_call(spark):
    got = {(r["law"], r["article_ref"], r["concept"], r["json_str"]) for r in q._extracted(spark).collect()}
    want = set()
    for law, text in q.STATUTES.items():
        for _, ref, _, level, _, body, _, _ in model_chunks(law, text):
            if level in store.STRUCTURAL_LEVELS:
                for c in PASS1_CONCEPTS:
                    raw = ex.rules_backend(c, law, ref, body)
                    want.add((law, ref, c, validate_json(c, raw)[0] if raw != "{}" else ex.FALLBACKS[c]))
    assert got <= want and {g[:3] for g in got} == {w[:3] for w in want}


@pytest.fixture
def endpoint():
    """A local server that is busy twice, loading once, and then answers in either protocol."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer(200, {"data": [{"id": "known"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked, self.headers.get("x-api-key")))
            code = {1: 429, 2: 503, 3: 429}.get(len(seen), 200)
            if asked["model"] == "bad":
                code = 400
            self.answer(code, {"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 4, "completion_tokens": 2}} if "chat" in self.path else {"content": [{"type": "text", "text": "{}"}], "usage": {"input_tokens": 5, "output_tokens": 1}})

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_back_ends(endpoint, monkeypatch):
    import urllib.error

    url, seen = endpoint
    own = ex.HttpBackend(url, "known", busy=(0, 0), loading=(0,))
    own.check()
    assert own("s", "u") == ("{}", 4, 2) and len(seen) == 4 and seen[0][1]["temperature"] == 0 and seen[0][1]["max_tokens"] == 2048
    with pytest.raises(ex.BackendError):
        ex.HttpBackend(url, "unknown").check()
    with pytest.raises(urllib.error.HTTPError):
        ex.HttpBackend(url, "bad")("s", "u")
    with pytest.raises(ex.BackendError):
        ex.HttpBackend("http://127.0.0.1:9", "known").check()
    hosted = ex.HostedBackend(url, "known")
    monkeypatch.delenv("LEXLOOM_API_KEY", raising=False)
    with pytest.raises(ex.BackendError):
        hosted.check()
    monkeypatch.setenv("LEXLOOM_API_KEY", "k")
    hosted.check()
    assert hosted("s", "u", 4096) == ("{}", 5, 1) and seen[-1][2] == "k" and seen[-1][1]["max_tokens"] == 4096


def test_matrix_cell(spark):
    cov = gaps.coverage(q.statements(spark, "/root/testdata/sf0.001"))
    law = cov.first()["law"]
    assert gaps.cell(cov, "Rights granted", law.lower()).count() == 1 and gaps.cell(cov, "No such", law).count() == 0


def test_fallback_of_a_law_without_structure(spark):
    rows = spark.createDataFrame([("X", f"ref {i:03}", ["T"], "clause") for i in range(150)] + [("Y", "a", ["T"], "article"), ("Y", "a", ["T"], "article"), ("Y", "b", ["T"], "clause")], "law string, article_ref string, concept_tags array<string>, level string")
    assert [r["article_ref"] for r in store.articles(rows, "x").collect()] == [f"ref {i:03}" for i in range(100)]
    assert [r["article_ref"] for r in store.articles(rows, "y").collect()] == ["a"]


def test_metamodel(spark, tmp_path):
    from lexloom.sources import metamodel

    text = metamodel.dumped()
    classes, enums = metamodel.parsed(text)
    assert metamodel.differences(classes, enums) == [] and enums == ENUMS
    (tmp_path / "m.json").write_text(text.replace('"Actor"', '"Agent"', 1).replace('"Days"', '"Day"'))
    with pytest.raises(ValueError):
        metamodel.read(spark, str(tmp_path / "m.json"))
    (tmp_path / "m.json").write_text(text.replace('"Days"', '"Day"').replace('"evidence"', '"proof"'))
    assert metamodel.differences(*metamodel.read(spark, str(tmp_path / "m.json"))) == ["LegalBasis.evidence: field missing", "LegalBasis.proof: field unknown", "RetentionUnit: values ['Day', 'Days']"]
    with pytest.raises(FileNotFoundError):
        metamodel.read(spark, str(tmp_path / "none.json"))


def test_columns_of_answers(spark):
    raw = ['```json\n{"a": 1}\n```', '{"a": 1}', "```nope\n```", '{"X": {"_a": [{"_b": 1}]}}', "broken", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    out = {r["i"]: (r["f"], r["u"]) for r in df.select("i", ex.strip_fences(F.col("raw")).alias("f"), ex.unwrapped(F.col("raw")).alias("u")).collect()}
    assert [out[i][0] for i in range(4)] == ['{"a": 1}', '{"a": 1}', "pe", raw[3]]  # "nope": leading letters of json go
    assert out[3][1] == '{"a": [{"b": 1}]}' and out[4][1] is None and out[5][1] is None


def test_empty_policy(spark):
    from lexloom.operators.validate import empty_policy_error

    df = spark.sql("SELECT 1 AS i, named_struct('statements', array(1)) AS p UNION ALL SELECT 2, named_struct('statements', CAST(array() AS array<int>)) UNION ALL SELECT 3, named_struct('statements', CAST(NULL AS array<int>))")
    assert {r["i"]: r["e"] for r in df.select("i", empty_policy_error(F.col("p")).alias("e")).collect()} == {1: False, 2: True, 3: True}
    assert validate_json("LegalBasis", '{"type": "x", "evidence": "e", "jurisdiction": []}')[1] == ["type: not one of " + ", ".join(ENUMS["LegalBasisType"]), "jurisdiction: at least 1 needed"]


def test_law_files(spark, tmp_path):
    from lexloom.sources.laws import laws_with_vocabulary, read_laws

    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree \xff\n")
    (tmp_path / "b.md").write_text("# b\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = {r["law"]: r["text"] for r in read_laws(spark, {"a": str(tmp_path / "a.txt"), "B": str(tmp_path / "b.md"), "PIPEDA": str(tmp_path / "c.pdf")}, lambda content, width: [f"{len(content)} bytes", f"{width}"]).collect()}
    assert rows == {"A": "one\ntwo\nthree �\n", "B": "# b\n", "PIPEDA": "4 bytes\n\n0.5"}
    with pytest.raises(FileNotFoundError):
        read_laws(spark, {"A": str(tmp_path / "none.txt")})
    chunks = spark.createDataFrame([("A",), ("A",), ("B",)], "law string")
    assert [r["law"] for r in laws_with_vocabulary(chunks, chunks.filter("law = 'B'")).collect()] == ["B"]
    assert read_laws(spark, {}).count() == 0


def test_command_line(tmp_path, capfd, spark):
    path = tmp_path / "gdpr.txt"
    path.write_text(f"CHAPTER I\nArticle 1\n{ARTICLE} Consent may be withdrawn at any time.\nArticle 2\nNothing at all is stated in this article of the law.\n")
    work = ["--work", str(tmp_path / "work"), "--report", str(tmp_path / "report.txt")]
    assert stages.main(["--laws", f"GDPR={path}", "--no-concept-tags", "--xmi", str(tmp_path / "xmi"), *work]) == 0
    out = capfd.readouterr().out
    assert "new chunks" in out and "Statements stored: 1" in out and "XMI files: 1" in out and "Coverage matrix" in out
    assert [r["article_ref"] for r in spark.read.parquet(str(tmp_path / "work/rejects")).collect()] == ["Article 2"]
    assert stages.main(["--stage", "extract", "--dry-run", *work]) == 0
    assert re.search(r"(\d+) requests, \1 calls, 0 answered, \1 absent, 0 failed", capfd.readouterr().out)
    assert (tmp_path / "report.txt").read_text().startswith("=") and list((tmp_path / "xmi").glob("*.xmi"))
