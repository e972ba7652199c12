"""Stored vectors and postings: the answers of a scan of all texts, from few blocks, whatever was added when."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import postings, tfidf

CHUNKS = "law string, chunk_id string, text string, concept_tags array<string>"
ASKED = {"Right": "alpha beta alpha gamma", "Purpose": "beta delta delta", "Nothing": "zzz"}


def chunk_rows(n, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"] + [f"w{i}" for i in range(40)]
    return [(rnd.choice(["AA", "AA", "BB"]), f"{seed}-{i:05d}", " ".join(rnd.choices(words, weights=[9, 7, 5, 3] + [1] * 44, k=rnd.randrange(0, 30))), rnd.sample(["Right", "Purpose", "Nothing"], rnd.randrange(0, 4))) for i in range(n)]


def answers(df):
    return sorted((r["law"], r["concept"], r["rk"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """900 chunks in three ingests, small blocks and shards."""
    chunks = spark.createDataFrame(chunk_rows(900), CHUNKS)
    vocabulary = tfidf.fitted(chunks)
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "BLOCK", 8)
    patch.setattr(postings, "SHARD", 200)
    p = postings.Postings(spark, str(tmp_path_factory.mktemp("index")))
    for k in range(3):
        assert p.add(chunks.filter(F.substring("chunk_id", -1, 1).cast("int") % 3 == k), vocabulary) > 200
    yield chunks, vocabulary, p
    patch.undo()


@pytest.mark.parametrize(("k", "least", "tagged"), [(3, 0.0, True), (3, 0.0, False), (40, 0.0, True), (5, 1e-9, False), (1000, 0.2, True), (1, 0.3, False)])
def test_answers_are_those_of_all_texts(spark, index, k, least, tagged):
    chunks, vocabulary, p = index
    queries = tfidf.queries_table(spark, ASKED)
    want = answers(tfidf.retrieve(chunks, queries, k, least, tagged=tagged, vocabulary=vocabulary))
    assert answers(p.retrieve(queries, vocabulary, k, least, tagged)) == want
    assert want or least


def test_few_blocks_are_opened(spark, index):
    _, vocabulary, p = index
    asked = p.asked(tfidf.queries_table(spark, {"Right": "alpha"}), vocabulary)
    first = p._sums(asked.filter("block = 0")).groupBy("law", "concept").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    opened = p.opened(asked, first.select("law", "concept", F.get("s", F.lit(0)).alias("least")))
    assert 0 < opened.count() < asked.count() / 2


def test_what_is_there_is_not_added_again(spark, index):
    chunks, vocabulary, p = index
    assert p.add(chunks, vocabulary) == 0 and p.vectors().count() == 900
    stored = {(r["chunk_id"], r["term"]): round(r["w"], 9) for r in tfidf.exploded(p.vectors()).collect()}
    assert stored == {(r["chunk_id"], r["term"]): round(r["w"], 9) for r in tfidf.vectors(chunks, vocabulary).collect()}
    assert p.vectors().filter("vector IS NULL").count() > 0  # chunks without words stand there too


def test_merged_postings_answer_alike(spark, index):
    _, vocabulary, p = index
    queries = tfidf.queries_table(spark, ASKED)
    before, n = answers(p.retrieve(queries, vocabulary, 10)), p.versions.read().count()
    assert p.merged() == 900 and p.versions.read().count() < n
    assert answers(p.retrieve(queries, vocabulary, 10)) == before
    p.versions.vacuum()
    assert answers(p.retrieve(queries, vocabulary, 10)) == before and p.vectors().count() == 900


def test_an_empty_index(spark, tmp_path):
    p = postings.Postings(spark, str(tmp_path / "none"))
    none = spark.createDataFrame([], CHUNKS)
    assert p.add(none, tfidf.fitted(none)) == 0 and not p.exists()
    with pytest.raises(FileNotFoundError):
        p.vectors()


def test_vectors_are_stored_at_ingest(spark, tmp_path):
    from lexloom.operators import retriever
    from lexloom.operators.postings import Postings
    from lexloom.operators.store import ParquetStore
    from lexloom.plans import queries as q

    at = str(tmp_path / "chunks"), str(tmp_path / "vocabulary")
    for law in ("GDPR", "CCPA"):
        (tmp_path / f"{law}.txt").write_text(q.STATUTES[law])
    first = retriever.ingest_file(spark, str(tmp_path / "GDPR.txt"), "gdpr", *at)
    assert first["embedded"] == first["chunks"] > 3
    assert retriever.ingest_file(spark, str(tmp_path / "GDPR.txt"), "GDPR", *at)["embedded"] == 0
    with retriever.retriever_from_files(spark, {law: str(tmp_path / f"{law}.txt") for law in ("GDPR", "CCPA")}, *at) as r:
        stored = Postings(spark, retriever.index_of(at[0])).vectors()
        assert sorted(x["chunk_id"] for x in stored.collect()) == sorted(x["chunk_id"] for x in ParquetStore(spark, at[0]).read().collect())
        plain = retriever.Retriever(ParquetStore(spark, at[0]).read(), retriever.TfIdfEmbedder.load(spark, at[1]))
        for concept, law in (("RetentionPolicy", "GDPR"), ("Right", "ccpa"), ("Purpose", "GDPR")):
            want = [(x["chunk_id"], x["rk"], round(x["score"], 9)) for x in plain.retrieve(concept, law, 4).collect()]
            assert [(x["chunk_id"], x["rk"], round(x["score"], 9)) for x in r.retrieve(concept, law, 4).collect()] == want
        with pytest.raises(KeyError):
            r.retrieve("Right", "ZZ")


def test_registered_vocabulary_is_fitted_once(spark, tmp_path, monkeypatch):
    from lexloom.plans import queries

    spark.createDataFrame([(1, "de", "web", "ein Wort und noch ein Wort"), (2, "en", "web", "a word and a word")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(map(tuple, queries._vocabulary(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tfidf, "fit", lambda *_: 1 / 0)
    assert sorted(map(tuple, queries._vocabulary(spark, str(tmp_path)).collect())) == first
    assert {r[0] for r in first} == {"de", "en"}


@pytest.fixture
def nothing_broadcast(spark):
    """Tables too large to broadcast, partitions as they were dealt."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_terms_of_a_law_are_ranked_in_parts(spark, monkeypatch):
    """Many ties, and fewer terms kept than a part holds; then more than there are."""
    from collections import Counter

    monkeypatch.setattr(tfidf, "PARTS", 3)
    rows = chunk_rows(60, 5)
    chunks = spark.createDataFrame(rows, CHUNKS)
    for most in (7, 5000):
        want = []
        for law in ("AA", "BB"):
            ctf = Counter(t for r in rows if r[0] == law for w in [r[2].split()] for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
            want += [(law, t, n) for t, n in sorted(ctf.items(), key=lambda x: (-x[1], x[0]))[:most]]
        found = tfidf.fit(chunks, most)
        assert sorted((r["law"], r["term"], r["ctf"]) for r in found.collect()) == sorted(want)
    import re

    assert re.search(r"hashpartitioning\(law#\d+, _p#", found._jdf.queryExecution().executedPlan().toString())


def test_postings_of_one_law_lie_in_many_tasks(spark, nothing_broadcast):
    chunks = spark.createDataFrame([("AA", *r[1:]) for r in chunk_rows(200, 6)], CHUNKS)
    rows = postings.blocks(tfidf.sparse(chunks, tfidf.fitted(chunks)))
    assert rows.select(F.spark_partition_id()).distinct().count() > 8
    assert rows.agg(F.sum(F.size("entries"))).first()[0] == tfidf.vectors(chunks, tfidf.fitted(chunks)).count()


def test_stored_postings_are_dealt_by_shard_too(spark, nothing_broadcast, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 10)
    chunks = spark.createDataFrame([("AA", f"{i:03d}", "alpha", []) for i in range(200)], CHUNKS)
    rows = postings.dealt(postings.blocks(tfidf.sparse(chunks, tfidf.fitted(chunks))))
    assert rows.select(F.spark_partition_id()).distinct().count() > 4 and rows.agg(F.sum(F.size("entries"))).first()[0] == 200


def test_blocks_of_one_question_lie_in_many_tasks(spark, index, nothing_broadcast):
    _, vocabulary, p = index
    asked = p.asked(tfidf.queries_table(spark, {"Right": " ".join(f"w{i}" for i in range(40))}), vocabulary).filter("law = 'AA'")
    reached = spark.createDataFrame([("AA", "Right", 0.0)], "law string, concept string, least double")
    rows = p.opened(asked, reached)
    assert rows.count() == asked.count() and rows.select(F.spark_partition_id()).distinct().count() > 4


def test_texts_stay_where_they_are_for_prompts(spark):
    """Hits that are few, though Spark can't know."""
    from pyspark.sql import Window

    many = spark.range(1_000_000).select(F.concat(F.lit("A"), F.col("id") % 2).alias("law"), F.col("id").cast("string").alias("chunk_id"), F.lit("r").alias("article_ref"), F.concat(F.lit("t"), "id").alias("text"), F.col("id").alias("n"))
    first = Window.partitionBy("law").orderBy("n")
    hits = many.withColumn("rk", F.row_number().over(first)).filter("rk <= 2").select("law", F.lit("c").alias("concept"), "chunk_id", F.lit(0.5).alias("score"), "rk")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        found = tfidf.prompt_texts(hits, many)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("law = 'A0'").first()["prompt"] == "[Source: A0 | r | score=0.500]\nt0\n\n---\n\n[Source: A0 | r | score=0.500]\nt2"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rare_pairs_are_not_counted_one_by_one(spark, monkeypatch):
    """Frequent words in rare pairs: only what can be among the first is counted by term, and the first are right, ties at their end
    and a law of few words too."""
    from collections import Counter

    rnd = random.Random(3)
    rows = [("AA", f"{i:03d}", " ".join([*rnd.choices([f"f{k}" for k in range(12)], k=40), *(f"r{rnd.randrange(9000)}" for _ in range(60))]), []) for i in range(40)]
    rows += [("BB", "1", "one two one two", []), (None, "2", "nowhere at all", []), ("AA", "none", None, [])]
    chunks, seen, ranked = spark.createDataFrame(rows, CHUNKS), [], tfidf.ranked
    monkeypatch.setattr(tfidf, "ranked", lambda df, k: seen.append(df) or ranked(df, k))
    for most in (10, 30):
        want = []
        for law in ("AA", "BB"):
            of = [(t, set(t)) for t in ([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] for r in rows if r[0] == law and r[2] for w in [r[2].split()])]
            ctf, df = Counter(x for t, _ in of for x in t), Counter(x for _, t in of for x in t)
            want += [(law, t, n, df[t]) for t, n in sorted(ctf.items(), key=lambda x: (-x[1], x[0]))[:most]]
        seen.clear()
        assert sorted((r["law"], r["term"], r["ctf"], r["df"]) for r in tfidf.fit(chunks, most).collect()) == sorted(want)
        assert seen[-1].filter("law = 'AA'").count() < 300 < 2000 < len({x for r in rows[:40] for w in [r[2].split()] for x in zip(w, w[1:])})


def test_only_chunks_with_a_tag_asked_for_get_vectors(spark, monkeypatch):
    """Rows that share an id, of which one has the tag and the other the word, stay together."""
    rows = [("AA", f"{i:03d}", "alpha beta", ["Other"]) for i in range(50)] + [("AA", "x", "beta", ["Right"]), ("AA", "x", "alpha alpha", []), ("AA", "y", "alpha", ["Right", "Other"]), ("AA", "z", None, None)]
    chunks, seen, sparse = spark.createDataFrame(rows, CHUNKS), [], tfidf.sparse
    monkeypatch.setattr(tfidf, "sparse", lambda c, v: seen.append(c) or sparse(c, v))
    found = tfidf.retrieve(chunks, tfidf.queries_table(spark, {"Right": "alpha"}), 5).collect()
    assert [(r["chunk_id"], r["rk"]) for r in sorted(found, key=lambda r: r["rk"])] == [("y", 1), ("x", 2)]
    assert sorted(r["chunk_id"] for r in seen[0].collect()) == ["x", "x", "y"]


def test_ascii_is_not_looked_up(spark):
    """Each character is looked up once, and those of ASCII texts not at all."""
    from lexloom.functions.fold import fold

    assert str(fold(F.col("t"))).count("translate(") == 1


def test_letters_that_stay_are_not_gone_through_one_by_one(spark):
    """What is not decomposed is in no class that sends a text the slow way, and there ASCII goes in pieces."""
    import re

    from lexloom.functions import fold as f

    many = f.tables()[2]
    shown = f._class(list(many))
    assert all(re.match(f"[{shown}]", c) for c in many) and not re.search(f"[{shown}]", "ß–“”„æœøł€")
    text = "Straße – “naïve”\r\nœuvre ½ ﬁn… 한글 \U0001f600 é x"
    want = "".join(f.folded(c) if ord(c) < 0x10000 else c for c in text)
    assert spark.createDataFrame([(text,)], "t string").select(f.fold(F.col("t"))).first()[0] == want
