"""Registered queries of the engine over the driver's tables and over small statutes, with the SQL each is compared with."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.config import DELTA, ENUMS, FALLBACKS, JURISDICTIONS, KEYWORDS, MATRIX, MAX_TERMS, PASS1_CONCEPTS, PIPEDA_KEYWORDS
from lexloom.functions.text import percent
from lexloom.operators import extract as ex
from lexloom.operators import gaps, store, tagging, tfidf
from lexloom.operators.chunking import chunk, chunk_id, large_pieces, reference, segments
from lexloom.operators.postings import Postings
from lexloom.operators.prompts import GUIDES, body
from lexloom.operators.compiled import validate
from lexloom.operators.validate import ddl, statement_rules
from lexloom.plans.chunk_sql import chunk_sql, listed, pieces_sql
from lexloom.sources.shared import filesystem, shared_dir, spread
from lexloom.sources.versions import Versions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Statements derived from the star tables: a law is a nation; suppliers give values, customers give flags.
_ARRAYS = [("legal_basis_types", "LegalBasisType", 1, 0.0), ("right_types", "RightType", 3, 1000.0), ("constraint_types", "ConstraintType", 5, 2000.0), ("purpose_categories", "PurposeCategory", 7, 500.0), ("transfer_mechanisms", "TransferMechanism", 11, 4000.0)]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("law")))  # 25 rows at any scale
    none = F.expr("CAST(array() AS array<string>)")
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    values = [F.when(F.col("s_acctbal") > least, F.array(F.element_at(F.array(*[F.lit(v) for v in ENUMS[enum]]), (F.col("s_suppkey") * step % len(ENUMS[enum]) + 1).cast("int")))).otherwise(none).alias(c) for c, enum, step, least in _ARRAYS]
    left = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("statement_id"), "law", *values, F.lit(False).alias("has_retention"), F.lit(False).alias("has_dpia"), F.lit(False).alias("has_consent_withdrawal"))
    c = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    right = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("statement_id"), "law", *[none.alias(n) for n, *_ in _ARRAYS], (F.col("c_acctbal") > 6000).alias("has_retention"), (F.col("c_mktsegment") == "BUILDING").alias("has_dpia"), (F.col("c_acctbal") < 2000).alias("has_consent_withdrawal"))
    return left.unionByName(right)


_STATEMENTS = (
    "WITH stmt AS (SELECT 's' || s_suppkey AS statement_id, n_name AS law, "
    + ", ".join(f"CASE WHEN s_acctbal > {least} THEN [{listed(ENUMS[enum])}[CAST(s_suppkey * {step} % {len(ENUMS[enum])} + 1 AS BIGINT)]] ELSE CAST([] AS VARCHAR[]) END AS {c}" for c, enum, step, least in _ARRAYS)
    + ", false AS has_retention, false AS has_dpia, false AS has_consent_withdrawal FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'c' || c_custkey, n_name, "
    + ", ".join("CAST([] AS VARCHAR[])" for _ in _ARRAYS)
    + ", c_acctbal > 6000, c_mktsegment = 'BUILDING', c_acctbal < 2000 FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    + "cov AS (SELECT law, count(*) AS total, "
    + ", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in gaps.SETS)
    + ", "
    + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in gaps.FLAGS)
    + " FROM stmt GROUP BY law) "
)


def _cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.coverage(statements(spark, sf_dir))


def _concept(name: str, column: str) -> None:
    @query(_STATEMENTS + f", uni AS (SELECT list_sort(list_distinct(flatten(list({column})))) AS u FROM cov) SELECT law, array_to_string({column}, ',') AS present, array_to_string(list_filter(u, lambda x: NOT list_contains({column}, x)), ',') AS absent FROM cov, uni".replace(") , uni", "), uni"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gaps.concept_coverage(_cov(spark, sf_dir), column).select("law", F.array_join("present", ",").alias("present"), F.array_join("absent", ",").alias("absent"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _name, _column in (("q1_legal_basis", "legal_basis_types"), ("q2_rights", "right_types"), ("q5_transfer", "transfer_mechanisms"), ("q6_constraints", "constraint_types"), ("q7_purposes", "purpose_categories")):
    _concept(_name, _column)


def _flag(name: str, column: str) -> None:
    @query(_STATEMENTS + f"SELECT law, {column} AS flagged, total, round({column} / total, 6) AS rate, {column} / total >= 0.3 AS mandates FROM cov")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gaps.flag_coverage(_cov(spark, sf_dir), column).withColumn("rate", F.round("rate", 6))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _name, _column in (("q3_retention", "has_retention"), ("q4_dpia", "has_dpia"), ("consent_withdrawal", "has_consent_withdrawal")):
    _flag(_name, _column)


def _delta_sql(where: str) -> str:
    parts = []
    for i, (label, column, note) in enumerate(DELTA):
        if column in gaps.FLAGS:
            said = note.replace("{a}", "' || a.law || '").replace("{b}", "' || b.law || '")
            pct = lambda t: f"CAST(CAST(round_even({t}.{column} / {t}.total * 100, 0) AS BIGINT) AS VARCHAR) || '%'"  # noqa: B023, E731
            parts.append(f"SELECT a.law AS law_a, b.law AS law_b, {i} AS ord, '{label}' AS dimension, '' AS missing, '{said} (' || a.law || ': ' || {pct('a')} || ' of statements; ' || b.law || ': ' || {pct('b')} || ' of statements)' AS note FROM cov a, cov b WHERE {where} AND a.{column} / a.total >= 0.3 AND b.{column} / b.total < 0.3")
        else:
            missing = f"list_filter(a.{column}, lambda x: NOT list_contains(b.{column}, x))"
            parts.append(f"SELECT a.law AS law_a, b.law AS law_b, {i} AS ord, '{label}' AS dimension, array_to_string({missing}, ',') AS missing, '{note}' AS note FROM cov a, cov b WHERE {where} AND len({missing}) > 0")
    return _STATEMENTS + " UNION ALL ".join(parts)


@query(_delta_sql("a.law <> b.law"))
def q8_delta_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.deltas(_cov(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@query(_delta_sql("a.law < b.law"))
def q8_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.deltas(_cov(spark, sf_dir), both_ways=False).withColumn("missing", F.array_join("missing", ","))


@query(_STATEMENTS + " UNION ALL ".join(f"SELECT {i} AS ord, '{label}' AS dimension, law, '{'rate' if c in gaps.FLAGS else 'set'}' AS kind, " + ("NULL AS vals, NULL AS n, " + f"round({c} / total, 6) AS rate" if c in gaps.FLAGS else f"array_to_string({c}, ',') AS vals, CAST(len({c}) AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS rate") + " FROM cov" for i, (label, c) in enumerate(MATRIX)))
def q9_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.matrix(_cov(spark, sf_dir)).withColumns({"vals": F.array_join("vals", ","), "rate": F.round("rate", 6)})


_WIDE = [f"NATION_{i}" for i in range(25)]


@query(_STATEMENTS + " UNION ALL ".join(f"SELECT {i} AS ord, '{label}' AS dimension, " + ", ".join(f"max(round({f'{c} / total' if c in gaps.FLAGS else f'CAST(len({c}) AS DOUBLE)'}, 6)) FILTER (law = '{law}') AS {law}" for law in _WIDE) + " FROM cov" for i, (label, c) in enumerate(MATRIX)))
def q9_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gaps.matrix_wide(_cov(spark, sf_dir), _WIDE)
    return out.select("ord", "dimension", *[F.round(law, 6).alias(law) for law in _WIDE])


@query(_STATEMENTS + ", v AS (SELECT law, unnest(right_types) AS v FROM cov), o AS (SELECT v, min(law) AS law FROM v GROUP BY v HAVING count(*) = 1) SELECT cov.law, coalesce(string_agg(o.v, ',' ORDER BY o.v), '') AS only_here FROM cov LEFT JOIN o ON o.law = cov.law GROUP BY cov.law".replace(") , v", "), v"))
def only_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.only_in(_cov(spark, sf_dir), "right_types").select("law", F.array_join("only", ",").alias("only_here"))


@query(_STATEMENTS + "SELECT v AS value, string_agg(law, ',' ORDER BY law) AS laws FROM (SELECT law, unnest(transfer_mechanisms) AS v FROM cov) GROUP BY v")
def value_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.value_laws(_cov(spark, sf_dir), "transfer_mechanisms").select("value", F.array_join("laws", ",").alias("laws"))


@query(_STATEMENTS + "SELECT law, count(*) AS n FROM stmt GROUP BY ROLLUP (law)")
def statement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(statements(spark, sf_dir))


# Texts: a chunk is a line or a document, a law is a language.
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("law"), "source", "text")


_LINES = r"WITH seg AS (SELECT doc_id, lang, unnest(string_split_regex(chr(57344) || regexp_replace(text, '\n', chr(10) || chr(57344), 'g'), chr(57344))[2:]) AS t, generate_subscripts(string_split_regex(chr(57344) || regexp_replace(text, '\n', chr(10) || chr(57344), 'g'), chr(57344))[2:], 1) AS pos FROM documents), off AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg) "


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments at line starts."""
    return _documents(spark, sf_dir).select("doc_id", "law", F.posexplode(segments(F.col("text"), "^")).alias("pos", "x")).select("doc_id", "law", "pos", "x.text", "x.start")


@query(_LINES + r"SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length(t) AS INTEGER) AS n FROM off WHERE length(trim(t, chr(32) || chr(9) || chr(10) || chr(13))) >= 30")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "start", F.length("text").alias("n"))


@query(_LINES + r"SELECT doc_id, CAST(start AS BIGINT) AS start, left(sha1(lang || '|' || left(trim(regexp_replace(string_split(t, chr(10))[1], '\s+', ' ', 'g')), 80) || '|' || left(t, 64)), 16) AS chunk_id FROM off WHERE length(trim(t, chr(32) || chr(9) || chr(10) || chr(13))) >= 30")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "start", chunk_id(F.col("law"), reference(F.col("text")), F.col("text")).alias("chunk_id"))


_LONG = "WITH RECURSIVE long AS (SELECT doc_id, text AS body FROM documents WHERE length(text) > 4000), " + pieces_sql("long", "doc_id", "\n", "chr(10)")


@query(_LONG + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY d) - 1 AS INTEGER) AS pos, length(text) AS n, CAST(start AS BIGINT) AS start, sha1(text) AS digest FROM pieces")
def split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _documents(spark, sf_dir).filter(F.length("text") > 4000)
    rows = long.select("doc_id", F.posexplode(large_pieces(F.col("text"), 4000, "\n", "\n")).alias("pos", "x"))
    return rows.select("doc_id", "pos", F.length("x.text").alias("n"), F.col("x.start").alias("start"), F.sha1(F.col("x.text").cast("binary")).alias("digest"))


#: Keywords that occur in the invented prose.
WORDS = {"Licence": ["license", "licensed"], "Contact": ["@", "+1 ("], "Function": [" the ", " der ", " que ", " les "], "Shout": ["!!"]}
_TAGS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{c}' END" for c, words in WORDS.items()) + "], lambda x: x IS NOT NULL)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).withColumn("concept_tags", tagging.tags(F.col("text"), WORDS))


@query(f"SELECT doc_id, array_to_string({_TAGS}, ',') AS tags FROM documents")
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("concept_tags", ",").alias("tags"))


@query(f"SELECT lang AS law, c AS concept, count(*) AS n FROM (SELECT lang, unnest({_TAGS}) AS c FROM documents) GROUP BY ALL")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_counts(_tagged(spark, sf_dir))


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND list_contains({_TAGS}, 'Licence')")
def chunks_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_concept(_tagged(spark, sf_dir).withColumn("law", F.upper("law")), "Licence", "EN").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source ILIKE '%RC1%'")
def chunks_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_article(_documents(spark, sf_dir).withColumnRenamed("source", "article_ref"), "RC1").select("doc_id")


@query("SELECT doc_id, lang AS law FROM documents WHERE doc_id = 7")
def chunk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(_documents(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")), 7).select("doc_id", "law")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(source), 'src7')")
def article_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter(store.article_filter(F.col("source"), "C1, src7")).select("doc_id", "source")


@query(f"SELECT DISTINCT source AS article_ref, array_to_string({_TAGS}, ',') AS tags FROM documents WHERE lang = 'de'")
def articles_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select(F.upper("law").alias("law"), F.col("source").alias("article_ref"), F.lit("article").alias("level"), "concept_tags")
    return store.articles(rows, "de").select("article_ref", F.array_join("concept_tags", ",").alias("tags"))


@query("SELECT DISTINCT lang AS law FROM documents")
def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.laws(_documents(spark, sf_dir))


@query("SELECT lang AS law, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(_documents(spark, sf_dir))


_IDS = "WITH r AS (SELECT left(sha1(text), 16) AS chunk_id, doc_id AS seq, lang AS law FROM documents) "


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("chunk_id"), F.col("doc_id").alias("seq"), "law")


@query(_IDS + "SELECT chunk_id, min(seq) AS seq FROM r WHERE seq % 2 = 1 AND chunk_id NOT IN (SELECT chunk_id FROM r WHERE seq % 2 = 0) GROUP BY chunk_id")
def store_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir)
    return store.new_rows(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("chunk_id", "seq")


@query(_IDS + ", s AS (SELECT chunk_id, max(seq) AS seq FROM r WHERE seq % 2 = 1 GROUP BY chunk_id) SELECT chunk_id, seq FROM s UNION ALL SELECT chunk_id, seq FROM r WHERE seq % 2 = 0 AND chunk_id NOT IN (SELECT chunk_id FROM s)".replace(") , s", "), s"))
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir)
    return store.replaced(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("chunk_id", "seq")


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("law", F.format_string("%08d", "doc_id").alias("chunk_id"), F.col("source").alias("article_ref"), "text")


def _kept_at(spark: SparkSession, sf_dir: str) -> str:
    """A folder in the shared one for what is made of the documents once a session: named by the application and the state of the table's
    files, so that a table that has changed has another and nothing is read that other code has made."""
    fs, at = filesystem(spark, f"{sf_dir}/documents.parquet")
    files = [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in (fs.listStatus(at) or [])]
    return f"{shared_dir(spark).rstrip('/')}/lexloom-index-{hashlib.sha1(repr((spark.sparkContext.applicationId, sorted(files))).encode()).hexdigest()[:16]}"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the documents, each a chunk, when first asked for, and stored whole or not at all."""
    kept = Versions(spark, f"{_kept_at(spark, sf_dir)}/vocabulary", "law")

    def first(manifest: dict, _):
        if manifest["schema"]:
            return None
        rows = tfidf.fit(_doc_chunks(spark, sf_dir))
        part, folders = kept.add(rows)
        return {"schema": rows.schema.jsonValue(), "live": {part: folders}}, len(folders)

    if not kept.latest():
        kept.update(first)
    return kept.read()


def _postings(spark: SparkSession, sf_dir: str) -> Postings:
    """The index of the documents, ingested when first asked for."""
    postings = Postings(spark, f"{_kept_at(spark, sf_dir)}/postings")
    if not postings.exists():
        postings.add(_doc_chunks(spark, sf_dir), _vocabulary(spark, sf_dir))
    return postings


_TF = (
    f"WITH w AS (SELECT lang AS law, printf('%08d', doc_id) AS chunk_id, regexp_extract_all(translate(lower(text), '{tfidf.ACCENTED}', '{tfidf.PLAIN}'), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM documents), "
    "t AS (SELECT law, chunk_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM w), "
    "tf AS (SELECT law, chunk_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT lang AS law, count(*) AS n FROM documents GROUP BY 1), "
    f"v AS (SELECT * FROM (SELECT law, term, sum(tf) AS ctf, count(*) AS df, row_number() OVER (PARTITION BY law ORDER BY sum(tf) DESC, encode(term)) AS k FROM tf GROUP BY 1, 2) WHERE k <= {MAX_TERMS}), "
    "idf AS (SELECT v.law, term, ctf, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM v JOIN n USING (law)), "
    "x AS (SELECT law, chunk_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (law, term)), nm AS (SELECT law, chunk_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1, 2) "
)


@query(_TF + "SELECT law, term, CAST(ctf AS BIGINT) AS ctf, df, round(idf, 6) AS idf FROM idf")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).withColumn("idf", F.round("idf", 6))


@query(_TF + "SELECT law, term, count(*) AS n, round(sum(w / norm), 4) AS total FROM x JOIN nm USING (law, chunk_id) GROUP BY 1, 2")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tfidf.exploded(_postings(spark, sf_dir).vectors())
    return v.groupBy("law", "term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


_ASKED = {"Function": "the and of der und que les", "Licence": "licensed under the apache license"}
_TOP = _TF + (
    "q AS (SELECT concept, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM (VALUES " + ", ".join(f"('{c}', string_split('{t}', ' '))" for c, t in _ASKED.items()) + ") AS z(concept, a)), "
    "qt AS (SELECT concept, term, count(*) AS c FROM q GROUP BY 1, 2), qw AS (SELECT law, concept, term, (1 + ln(c)) * idf AS qw FROM qt JOIN idf USING (term)), qn AS (SELECT law, concept, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1, 2), "
    "dot AS (SELECT x.law, concept, chunk_id, sum(w * qw) AS dot FROM x JOIN qw ON x.law = qw.law AND x.term = qw.term GROUP BY 1, 2, 3), "
    "s AS (SELECT d.law, d.concept, d.chunk_id, d.dot / (nm.norm * qn.qn) AS score FROM dot d JOIN nm ON nm.law = d.law AND nm.chunk_id = d.chunk_id JOIN qn ON qn.law = d.law AND qn.concept = d.concept) "
)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).retrieve(tfidf.queries_table(spark, _ASKED), _vocabulary(spark, sf_dir), 3, 1e-9, tagged=False)


_RANKED = "r AS (SELECT law, concept, chunk_id, score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY law, concept ORDER BY round(score, 12) DESC, chunk_id) AS rk FROM s) WHERE rk <= 3) "


@query(_TOP.replace(") q AS", "), q AS") + ", " + _RANKED + "SELECT law, concept, round(score, 5) AS score, rk FROM r")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("law", "concept", F.round("score", 5).alias("score"), "rk")


@query(
    _TOP.replace(") q AS", "), q AS") + ", " + _RANKED + "SELECT r.law, r.concept, string_agg('[Source: ' || r.law || ' | ' || d.source || ' | score=' || printf('%.3f', score) || ']' || chr(10) || d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rk) AS prompt "
    "FROM r JOIN documents d ON printf('%08d', d.doc_id) = r.chunk_id GROUP BY 1, 2"
)
def retrieve_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.prompt_texts(_hits(spark, sf_dir), _doc_chunks(spark, sf_dir))


_CAND = (
    ", cand AS (SELECT lang AS law, printf('%08d', doc_id) AS chunk_id, c AS concept FROM (SELECT *, unnest({tags}) AS c FROM documents)), "
    "every AS (SELECT law, concept, chunk_id, coalesce(score, 0) AS score FROM cand LEFT JOIN s USING (law, concept, chunk_id) WHERE concept IN (SELECT concept FROM z1)) "
    "SELECT law, concept, chunk_id, round(score, 5) AS score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY law, concept ORDER BY round(score, 12) DESC, chunk_id) AS rk FROM every) WHERE rk <= 40"
)
#: Texts that few of the tagged chunks share a term with, and a concept without a query of its own.
_SPARSE = {"Licence": "apache 2.0 zzyzx", "Shout": "Shout"}


@query((_TOP.replace(") q AS", "), z1 AS (SELECT unnest(" + listed(list(_SPARSE)) + ") AS concept), q AS").replace(", ".join(f"('{c}', string_split('{t}', ' '))" for c, t in _ASKED.items()), "('Licence', ['apache', 'zzyzx']), ('Shout', ['shout'])") + _CAND).replace("{tags}", _TAGS))
def retrieve_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by tag, with those that score zero; the default of a concept without a query is its name."""
    chunks = _doc_chunks(spark, sf_dir).withColumn("concept_tags", tagging.tags(F.col("text"), WORDS))
    known = tfidf.queries_table(spark, {"Licence": _SPARSE["Licence"]})
    queries = tfidf.asked(spark.createDataFrame([(c,) for c in _SPARSE], "concept string"), known)
    return tfidf.retrieve(chunks, queries, 40).select("law", "concept", "chunk_id", F.round("score", 5).alias("score"), "rk")


_COS = "WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score FROM embeddings, q) "


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and a stated query set: ids divisible by 100."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.filter("id % 100 = 0").withColumnRenamed("id", "qid")


@query(_COS + "SELECT qid, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5")
def rank_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.nearest(*_vectors(spark, sf_dir), 5).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rk")


@query(_COS + "SELECT qid, vec_id, round(score, 6) AS score FROM s WHERE score >= 0.3")
def embedding_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.nearest(*_vectors(spark, sf_dir), None, 0.3).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, concept, CASE WHEN NOT list_contains({_TAGS}, concept) THEN 'no tag' END AS skipped FROM documents, (SELECT unnest({listed(list(WORDS))}) AS concept)")
def extract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.plan(_tagged(spark, sf_dir), list(WORDS)).select("doc_id", "concept", "skipped")


_TURNS = "WITH t AS (SELECT conv_id, role <> 'user' AS ok, role = 'system' AS gone, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ok DESC, n DESC) AS k FROM t), d AS (SELECT * FROM b WHERE k = 1) "


@query(_TURNS + "SELECT (SELECT count(*) FROM t) AS calls, count(*) AS requests, count(*) FILTER (gone) AS absent, count(*) FILTER (NOT ok) AS failed, round(coalesce(count(*) FILTER (NOT ok) * 100.0 / nullif(count(*) - count(*) FILTER (gone), 0), 0), 6) AS failure_pct FROM d")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a request, its turns are the attempts: those of the user fail, those of the system tell of absence."""
    return ex.stats(_log(spark, sf_dir)).withColumn("failure_pct", F.round("failure_pct", 6))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select(F.lit("L").alias("law"), F.col("conv_id").cast("string").alias("article_ref"), F.lit("Purpose").alias("concept"), F.row_number().over(_turns()).alias("attempt"), (F.col("role") != "user").alias("success"), (F.col("role") == "system").alias("absent"), F.concat(F.lit("n"), F.row_number().over(_turns())).alias("json_str"), F.expr("CAST(array() AS array<string>)").alias("errors"))


@query(_TURNS + "SELECT CAST(conv_id AS VARCHAR) AS article_ref, ok AS success, gone AS absent, 'n' || n AS json_str, CAST((SELECT max(n) FROM t WHERE t.conv_id = d.conv_id) AS INTEGER) AS attempts FROM d")
def attempt_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request the attempt that succeeded last, or else the last."""
    return ex.results(_log(spark, sf_dir)).select("article_ref", "success", "absent", "json_str", "attempts")


def _turns():
    return Window.partitionBy("conv_id").orderBy("turn")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.k'), '') IN ('', '0') AS absent FROM events")
def absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    shown = F.concat(F.lit('{"duration": '), F.coalesce(k, F.lit("null")), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), ex.absent(F.lit("RetentionPolicy"), shown).alias("absent"))


# Small statutes, ASCII at the boundaries: preambles, empty parents, short and blank-led clauses, equal ids, oversize articles.
_BODY = "The controller shall process personal data lawfully and keep it no longer than necessary for the purpose."
STATUTES = {
    "GDPR": f"Recital text that is lost because it stands before the first chapter.\nCHAPTER I\nGeneral\nArticle 1\nSubject matter\n1. {_BODY}\n2. Short clause here, dropped.\n\n3. {_BODY} Consent may be withdrawn at any time by e-mail.\nArticle 2\n{_BODY}\nCHAPTER II\nA chapter without articles stays itself as a chunk of the law.\nCHAPTER III\nArticle 3\n" + "\n\n".join([_BODY * 12] * 5),
    "CCPA": f"Title\nSection 1798.100\nRights of consumers\n(a) A consumer shall have the right to know what personal information is collected.\n(b) {_BODY}\nSection 1798.105.\nThis section has no clauses but a business purpose and a right to delete.",
    "PIPEDA": f"Preamble\nSchedule 1\n4.1 Accountability\nAn organization is responsible for personal information under its control.\n4.1.1 {_BODY} Accountability rests with the organization and its designated individuals.\n4.3 Consent\nThe knowledge and consent of the individual are required for collection, use or disclosure.",
    "LGPD": f"CAPITULO I\nArt. 1o Esta lei trata de dados pessoais com finalidade e consentimento do titular.\n1. {_BODY}\nArt. 2o O tratamento segue base legal e o prazo de conserva de dados do titular.",
    "OTHER": f"PART I\nSection 1 scope\n{_BODY}\n1. {_BODY}\nSection 2 more\n{_BODY}",
    "FLAT": f"No structure at all in this text. {_BODY}",
}


def _statutes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUTES.items()), "law string, text string")


#: Where each concept's closed value stands in its answer.
_VALUE = {"LegalBasis": "type", "ProcessingActivity": "action", "Actor": "role", "Purpose": "category", "Right": "type", "Constraint": "type", "RetentionPolicy": "trigger", "DataTransfer": "mechanism", "ConsentWithdrawal": "channel[0]"}


def _ruled(concept: str) -> str:
    """The value that the rules find in `t`, lower-cased text."""
    out = "CASE " + " ".join(f"WHEN regexp_matches(t, {listed([rule])[1:-1]}) THEN '{value}'" for value, rule in ex.RULES[concept]) + " END"
    return f"CASE WHEN {out} IS NOT NULL THEN CASE WHEN contains(t, 'email') OR contains(t, 'e-mail') THEN 'Email' ELSE 'OnlineForm' END END" if concept == "ConsentWithdrawal" else out


def _extracted(spark: SparkSession) -> DataFrame:
    rows = chunk(_statutes(spark)).filter(F.col("level").isin(store.STRUCTURAL_LEVELS))
    return ex.results(ex.extract(ex.plan(rows, PASS1_CONCEPTS, use_tags=False)))


_PICK = f"{listed(PASS1_CONCEPTS)}[CAST(event_id % {len(PASS1_CONCEPTS)} + 1 AS BIGINT)]"
_DEFAULT = "CASE concept " + " ".join(f"WHEN '{c}' THEN '{FALLBACKS[c]}'" for c in PASS1_CONCEPTS) + " END"


@query(f"SELECT event_id, concept, coalesce(CASE WHEN value >= 50 THEN props END, {_DEFAULT}) AS json_str FROM (SELECT event_id, value, props, {_PICK} AS concept FROM events)")
def concept_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a concept without an answer."""
    concept = F.element_at(F.array(*[F.lit(c) for c in PASS1_CONCEPTS]), (F.col("event_id") % len(PASS1_CONCEPTS) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", concept.alias("concept"), F.when(F.col("value") >= 50, F.col("props")).alias("raw"))
    return rows.select("event_id", "concept", ex.fallback(F.col("concept"), F.col("raw")).alias("json_str"))


_CODES = [*JURISDICTIONS, "XX"]
_PLACES = "(VALUES " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}')" for k, v in JURISDICTIONS.items()) + ") AS j(law, id, name, about)"


@query(f"WITH c AS (SELECT n_name, upper({listed(_CODES)}[CAST(n_nationkey % {len(_CODES)} + 1 AS BIGINT)]) AS law FROM nation) SELECT n_name, c.law, coalesce(j.id, c.law) AS id, coalesce(j.name, c.law) AS name, coalesce(j.about, '') AS about, n_name AS source FROM c LEFT JOIN {_PLACES} ON j.law = c.law")
def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulation that a law stands for, or a generic one; codes in either case."""
    code = F.element_at(F.array(*[F.lit(c.lower()) for c in _CODES]), (F.col("n_nationkey") % len(_CODES) + 1).cast("int"))
    df = read(spark, sf_dir, "nation").select("n_name", code.alias("law"))
    of = lambda path: F.get_json_object(ex.regulation(F.col("law"), F.col("n_name")), path)
    return df.select("n_name", of("$.name").alias("law"), of("$.jurisdiction[0].jurisdictionId").alias("id"), of("$.jurisdiction[0].name").alias("name"), of("$.description").alias("about"), of("$.source_clause").alias("source"))


def _typed(spark: SparkSession) -> DataFrame:
    base = '{"statementId": "%s", "description": "d", "actor": {"name": "a", "role": "DataController"}, "purposes": [{"description": "p", "category": "Research"}, {"description": "p", "category": "Analytics"}, {"description": "q", "category": "Research"}], "processingActivity": {"description": "x", "action": "%s", "riskAssessmentReference": %s, "dataProcessed": [{"description": "d", "source": "s", "category": "HealthData", "sensitivity": "High", "identifiability": "Identified"}]}, "legalBasis": {"type": "Consent", "evidence": "e", "jurisdiction": [{"name": "EU"}]}, "governingRegulations": [{"name": "R", "jurisdiction": [{"name": "EU"}]}], "constraints": [{"type": "Usage", "expression": "e", "enforcementLevel": "SHALL"}], "rightImpacted": [{"type": "Access", "triggerCondition": "t", "fulfillmentProcess": "f"}], "consentWithdrawal": %s}'
    channel = '[{"channel": ["Email"], "deadline": "d", "effectOnPriorProcessing": "none"}]'
    rows = [("A", base % ("one", "Share", "null", "[]")), ("B", base % ("two", "Use", '"Art. 35"', channel)), ("C", base % ("", "Transfer", '"DPIA"', "[]"))]
    return spark.createDataFrame(rows, "law string, raw string").select("law", F.from_json("raw", ddl("PolicyStatement")).alias("stmt"))


_ASKS = list(GUIDES)
_BODIES = "CASE concept " + " ".join(f"WHEN '{c}' THEN {listed([body(c)])[1:-1]}" for c in _ASKS) + " END"


@query(f"SELECT doc_id, concept, 'Law: ' || lang || chr(10) || 'Provision: ' || source || chr(10) || {_BODIES} || chr(10) || chr(10) || 'Text:' || chr(10) || text AS prompt FROM (SELECT *, {listed(_ASKS)}[CAST(doc_id % {len(_ASKS)} + 1 AS BIGINT)] AS concept FROM documents)")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.element_at(F.array(*[F.lit(c) for c in _ASKS]), (F.col("doc_id") % len(_ASKS) + 1).cast("int"))
    return ex.prompts(_documents(spark, sf_dir).withColumnRenamed("source", "article_ref").withColumn("concept", concept)).select("doc_id", "concept", "prompt")


@query(_delta_sql("a.law <> b.law").replace("WITH stmt", "WITH dl AS (WITH stmt", 1) + "), p AS (SELECT a.n_name AS law_a, b.n_name AS law_b FROM nation a, nation b WHERE a.n_name <> b.n_name AND a.n_name IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey) AND b.n_name IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey)), l AS (SELECT law_a, law_b, string_agg('  ' || dimension || ': ' || CASE WHEN missing = '' THEN '(structural gap)' ELSE array_to_string(list_sort(string_split(missing, ',')), ', ') END || CASE WHEN note <> '' THEN chr(10) || '    → ' || note ELSE '' END, chr(10) ORDER BY ord) AS t FROM dl GROUP BY 1, 2) SELECT law_a, law_b, CASE WHEN t IS NULL THEN 'No gaps found: ' || law_a || ' and ' || law_b || ' appear equivalent.' ELSE 'Obligations in ' || law_a || ' not present in ' || law_b || ':' || chr(10) || chr(10) || t END AS summary FROM p LEFT JOIN l USING (law_a, law_b)")
def q8_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.summaries(_cov(spark, sf_dir))


from lexloom.plans import derived  # noqa: E402, F401  registers the queries over statutes and statements made of the tables
