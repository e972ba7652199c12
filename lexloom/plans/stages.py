"""The stages from law files to the report, each a table that is written before the next reads it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import MAX_CHUNK, MIN_CHUNK, PASS1_CONCEPTS, RETRIES, TOP_K
from lexloom.operators import extract as ex
from lexloom.operators import store as st
from lexloom.operators import tfidf
from lexloom.operators.chunking import chunk
from lexloom.operators.postings import Postings
from lexloom.operators.retriever import fitted_embedder, index_of
from lexloom.operators.compiled import validate
from lexloom.operators.validate import ddl, statement_rules
from lexloom.plans.report import Report
from lexloom.sources import xmi
from lexloom.sources.laws import parse_specs, read_laws
from lexloom.sources.shared import shared_table


def ingest(spark: SparkSession, laws: dict[str, str], store: st.ParquetStore, min_chars: int = MIN_CHUNK, max_chars: int = MAX_CHUNK) -> int:
    return store.ingest(chunk(read_laws(spark, laws), min_chars, max_chars, list(laws)))


def extract(chunks: DataFrame, out: str, backend: ex.Backend | None = None, top_k: int = TOP_K, retries: int = RETRIES, articles: str | None = None, use_tags: bool = True, vocabulary: str | None = None, at_once: int = ex.AT_ONCE, index: str | None = None) -> DataFrame:
    """Attempts, as written to `out`. The passages of a concept are retrieved once a law, not once an article; with the rule-based
    back end the article's own text is read as well. With a vocabulary and an index, new chunks are embedded and indexed there first. An actor is always asked for: no keyword tags one, and a statement needs one."""
    spark = chunks.sparkSession
    own = chunks.filter(F.col("level").isin(st.STRUCTURAL_LEVELS)).filter(st.article_filter(F.col("article_ref"), articles))
    rows = own.groupBy("law", "article_ref").agg(F.array_distinct(F.flatten(F.collect_list("concept_tags"))).alias("concept_tags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("own_text"))
    planned = ex.plan(rows, PASS1_CONCEPTS, use_tags)
    terms = fitted_embedder(chunks, vocabulary).vocabulary if vocabulary else None
    asked = tfidf.asked(spark.createDataFrame([(c,) for c in PASS1_CONCEPTS], "concept string"), tfidf.queries_table(spark))
    if terms is not None and index:
        postings = Postings(spark, index)
        postings.add(chunks, terms)
        found = postings.retrieve(asked, terms, top_k)
    else:
        found = tfidf.retrieve(chunks, asked, top_k, vocabulary=terms)
    hits = tfidf.prompt_texts(found, chunks)
    wanted = planned.filter(F.col("skipped").isNull() | (F.col("concept") == "Actor")).join(hits, ["law", "concept"], "left")
    text = F.concat_ws("\n\n", "own_text", "prompt") if backend else F.col("own_text")
    ex.extract(wanted.select("law", "article_ref", "concept", text.alias("text")), backend, retries, at_once).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def built(attempts: DataFrame, out: str | None = None, backend: ex.Backend | None = None, retries: int = RETRIES, at_once: int = ex.AT_ONCE) -> DataFrame:
    """(law, article_ref, statement_json, errors): the statement of each article, put together by rule, or by a back end whose attempts
    are written to `out`."""
    done = ex.results(attempts)
    if backend is None:
        return ex.assemble(done).select("law", "article_ref", "statement_json", F.transform("missing", lambda m: F.concat(m, F.lit(": nothing found"))).alias("errors"))
    ex.assembled(done, backend, retries, at_once).write.mode("overwrite").parquet(out)
    last = F.max_by(F.struct("statement_json", "errors"), "attempt").alias("b")
    return attempts.sparkSession.read.parquet(out).groupBy("law", "article_ref").agg(last).select("law", "article_ref", "b.statement_json", "b.errors")


def judged(rows: DataFrame) -> DataFrame:
    """rows of `built`, typed, with warnings, and with all that speaks against a statement as `errors` (none: it is valid)."""
    known = validate(rows.withColumn("concept", F.lit("PolicyStatement")).withColumnRenamed("errors", "before"), "concept", "statement_json")
    ruled = statement_rules(known.withColumn("stmt", F.from_json("normal", ddl("PolicyStatement"))))
    # what validation says is said of what a missing part left; the parts come first
    return ruled.withColumn("errors", F.concat("before", F.when(F.col("valid"), F.col("rule_errors")).otherwise(F.col("errors"))))


def rejects(rows: DataFrame) -> DataFrame:
    """(law, article_ref, statement_json, errors): articles without a valid statement, and why."""
    return judged(rows).filter(F.size("errors") > 0).select("law", "article_ref", "statement_json", "errors")


def valid(rows: DataFrame) -> DataFrame:
    """(law, article_ref, statement_json, stmt, warnings) of the valid statements, as a StatementStore takes them."""
    return judged(rows).filter(F.size("errors") == 0).select("law", "article_ref", "statement_json", "stmt", "warnings")


def statements(attempts: DataFrame) -> DataFrame:
    """Valid statements with id, typed tree, denormalised columns and rule warnings."""
    rows = valid(built(attempts))
    ident = st.statement_id(F.col("law"), F.col("article_ref"), F.col("stmt.statementId"), F.col("stmt.description"))
    return rows.select(ident.alias("statement_id"), "law", "article_ref", st.source_clause(F.col("stmt.source_clause"), F.col("article_ref")).alias("source_clause"), "statement_json", "stmt", "warnings", *[c.alias(n) for n, c in st.denormalised("stmt").items()])


#: Failures in per cent of the requests that were not absent, above which the summary says so.
HINT = 20.0


def summary(attempts: DataFrame, assembly: DataFrame | None = None, stored: int = 0, files: int = 0) -> str:
    """What a run has done, in words; two rows reach the driver."""
    s = ex.stats(attempts).first()
    used = attempts.agg(F.sum("tokens_in").alias("read"), F.sum("tokens_out").alias("written"), F.countDistinct("law").alias("laws"), F.countDistinct("law", "article_ref").alias("articles")).first()
    lines = [f"Laws: {used['laws']}", f"Articles: {used['articles']}", f"First pass: {s['requests']} requests, {s['calls']} calls, {s['requests'] - s['absent'] - s['failed']} answered, {s['absent']} absent, {s['failed']} failed"]
    if s["requests"] > s["absent"]:
        lines.append(f"Failed of those not absent: {s['failure_pct']:.1f}%" + (", the model may be too small" if s["failure_pct"] > HINT else ""))
    read, written = used["read"] or 0, used["written"] or 0
    if assembly is not None:
        a = assembly.agg(F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("ok"), F.countDistinct("law", "article_ref").alias("n"), F.sum("tokens_in").alias("read"), F.sum("tokens_out").alias("written")).first()
        lines.append(f"Second pass: {a['calls']} calls, {a['ok']} put together, {a['n'] - a['ok']} failed")
        read, written = read + (a["read"] or 0), written + (a["written"] or 0)
    lines += [f"Statements stored: {stored}", f"XMI files: {files}"]
    return "\n".join([*lines, f"Tokens read and written: {read} and {written}"] if read or written else lines)


def analyse(rows: DataFrame, path: str | None = None) -> str:
    text = Report(rows).text()
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom", description="Law files to statements and gaps.")
    p.add_argument("--laws", nargs="*", default=[], metavar="LAW=PATH")
    p.add_argument("--work", default="lexloom-work", help="folder of the tables")
    p.add_argument("--stage", choices=["ingest", "extract", "assemble", "analyse", "all"], default="all")
    p.add_argument("--articles", help="comma list of parts of article references")
    p.add_argument("--top-k", type=int, default=TOP_K)
    p.add_argument("--retries", type=int, default=RETRIES)
    p.add_argument("--no-concept-tags", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--url", help="OpenAI-compatible endpoint; without it the rules answer")
    p.add_argument("--model", default="")
    p.add_argument("--hosted", action="store_true", help="the endpoint speaks the messages protocol; its key is in LEXLOOM_API_KEY")
    p.add_argument("--at-once", type=int, default=ex.AT_ONCE, help="calls to the endpoint at a time")
    p.add_argument("--report")
    p.add_argument("--xmi", help="folder for a file of each statement")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, done = st.ParquetStore(spark, f"{a.work}/chunks"), st.StatementStore(spark, f"{a.work}/statements")
    kind = ex.HostedBackend if a.hosted else ex.HttpBackend
    backend = ex.dry_run_backend if a.dry_run else kind(a.url, a.model) if a.url else None
    if isinstance(backend, ex.HttpBackend) and a.stage in ("extract", "assemble", "all"):
        backend.check()
    if a.stage in ("ingest", "all"):
        print(f"{ingest(spark, parse_specs(a.laws), store)} new chunks")
    stored = files = 0
    if a.stage in ("extract", "all"):
        extract(store.read(), f"{a.work}/attempts", backend, a.top_k, a.retries, a.articles, not a.no_concept_tags, f"{a.work}/vocabulary", a.at_once, index_of(f"{a.work}/chunks"))
    if a.stage in ("assemble", "all"):
        rows = shared_table(spark, built(spark.read.parquet(f"{a.work}/attempts"), f"{a.work}/assembly", backend, a.retries, a.at_once), "built")
        rejects(rows).write.mode("overwrite").parquet(f"{a.work}/rejects")
        stored = done.store_many(valid(rows))
        files = xmi.write_statements(done.read(), a.xmi) if a.xmi and done.exists() else 0
    if a.stage in ("extract", "assemble", "all"):
        second = spark.read.parquet(f"{a.work}/assembly") if backend and a.stage != "extract" else None
        print(summary(spark.read.parquet(f"{a.work}/attempts"), second, stored, files))
    if a.stage in ("analyse", "all"):
        print("The repository is empty." if not done.exists() or done.read().isEmpty() else analyse(done.read(), a.report))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
