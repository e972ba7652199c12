"""Chunk and statement stores: first-wins and last-wins upserts, look-ups, counts."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.config import STRUCTURAL_LEVELS
from lexloom.functions.text import short_hash, sorted_set
from lexloom.sources.shared import discard, shared_table
from lexloom.sources.versions import Versions


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by order; among equals the same one every time. The least row is combined before the shuffle, so a
    hot key costs one row a task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), _order(rows, order)).alias("_r")).select("_r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), _order(rows, order)).alias("_r")).select("_r.*")


def _order(rows: DataFrame, order: str) -> Column:
    return F.struct(F.col(order), F.xxhash64(*rows.columns))


def new_rows(store: DataFrame, rows: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """What an insert that ignores known keys appends."""
    return first_wins(rows, key, order).join(store.select(key).distinct(), key, "left_anti").select(rows.columns)


def replaced(store: DataFrame, rows: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """The store after an upsert that replaces."""
    return store.join(rows.select(key).distinct(), key, "left_anti").select(store.columns).unionByName(last_wins(rows, key, order).select(store.columns))


class ParquetStore:
    """A table in a folder, in subfolders by law, with one row a key. Each ingest is a version of its own: it is there as a whole or
    not at all, and of two at a time the second starts again from what the first has left (see `Versions`)."""

    stamp = "ingested_at"

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.versions = Versions(spark, self.path, "law")

    def exists(self) -> bool:
        return self.versions.latest() > 0

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or one of those before it."""
        rows = self.versions.read(version)
        if rows is None:
            raise FileNotFoundError(f"{self.path} holds no rows yet")
        return rows

    def ingest(self, rows: DataFrame, order: str = "seq", replace: bool = False) -> int:
        """The number of rows written. Known keys are left alone, the first of equal new ones wins; with replace the last does, and
        takes the place of a known one, in whatever law that stands. Either can be run again. An order that is named _ is not stored."""
        change = self._replacing if replace else self._adding
        return self.versions.update(lambda manifest, old: change(rows, order, manifest, old))

    def _stamped(self, rows: DataFrame, order: str) -> DataFrame:
        return (rows.drop(order) if order.startswith("_") else rows).withColumn(self.stamp, F.current_timestamp())

    def _added(self, manifest: dict, new: DataFrame, gone: set[str | None]) -> dict:
        """The manifest with new beside what stands under other laws than those of `gone`."""
        part, folders = self.versions.add(new)
        live = {p: kept for p, own in manifest["live"].items() if (kept := [f for f in own if folder_value(f) not in gone])}
        return {"schema": manifest["schema"] or new.schema.jsonValue(), "live": live | {part: folders}}

    def _adding(self, rows: DataFrame, order: str, manifest: dict, old: DataFrame | None):
        fresh = new_rows(old, rows, self.key, order) if old is not None else first_wins(rows, self.key, order)
        new = shared_table(self.spark, self._stamped(fresh, order), "new")
        try:
            n = new.count()
            return (self._added(manifest, self._as_stored(new, old), set()), n) if n else None
        finally:
            discard(new)

    def _replacing(self, rows: DataFrame, order: str, manifest: dict, old: DataFrame | None):
        """Only the laws that lose or gain rows are written anew."""
        new = shared_table(self.spark, self._stamped(last_wins(rows, self.key, order), order), "new")
        try:
            n = new.count()
            if not n:
                return None
            if old is None:
                return self._added(manifest, new, set()), n
            touched = new.select("law").union(old.join(new.select(self.key), self.key, "left_semi").select("law")).distinct()
            kept = old.join(touched, "law", "left_semi").join(new.select(self.key), self.key, "left_anti").select(old.columns)
            whole = self._as_stored(kept.unionByName(new.select([c for c in old.columns if c in new.columns]), allowMissingColumns=True), old)
            return self._added(manifest, whole, {r["law"] for r in touched.collect()}), n  # a row a law
        finally:
            discard(new)

    @staticmethod
    def _as_stored(new: DataFrame, old: DataFrame | None) -> DataFrame:
        """With the columns of the store, in their order."""
        if old is None:
            return new
        return new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])

    def stats(self) -> dict[str, int]:
        """Rows by law, and in all under an empty name."""
        return {r["law"] or "": r["n"] for r in stats(self.read()).collect()}


def folder_value(folder: str) -> str | None:
    """What a subfolder by a column stands for: Spark writes what a path can't hold as % and two hexadecimal digits."""
    value = unquote(folder.partition("=")[2])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


class StatementStore(ParquetStore):
    """Statements under their ids, last one wins, with the columns that coverage questions ask for."""

    stamp = "stored_at"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "statement_id")

    def store_many(self, statements: DataFrame, replace: bool = True) -> int:
        """statements (law, article_ref, stmt, statement_json; seq, or else they come by law and article), typed and valid."""
        order = [F.col("seq").alias("seq")] if "seq" in statements.columns else [F.struct(F.upper("law"), "article_ref").alias("_seq")]
        ident = statement_id(F.col("law"), F.col("article_ref"), F.col("stmt.statementId"), F.col("stmt.description"))
        rows = statements.select(
            ident.alias("statement_id"), F.upper("law").alias("law"), "article_ref", source_clause(F.col("stmt.source_clause"), F.col("article_ref")).alias("source_clause"), "statement_json", "stmt",
            *([F.col("warnings")] if "warnings" in statements.columns else []), *[c.alias(n) for n, c in denormalised("stmt").items()], *order,
        )
        return self.ingest(rows, rows.columns[-1], replace)

    def for_law(self, law: str) -> DataFrame:
        return statements_for_law(self.read(), law)


def by_concept(chunks: DataFrame, concept: str, law: str | None = None) -> DataFrame:
    out = chunks.filter(F.array_contains("concept_tags", concept))
    return out.filter(F.col("law") == law.upper()) if law else out


def by_article(chunks: DataFrame, ref: str, law: str | None = None) -> DataFrame:
    """Case-insensitive; % and _ in ref are wildcards."""
    out = chunks.filter(F.col("article_ref").ilike(f"%{ref}%"))
    return out.filter(F.col("law") == law.upper()) if law else out


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def article_filter(ref: Column, wanted: str | None) -> Column:
    """A comma list of literal parts, any of which the reference holds, whatever the case; None or blank lets all pass."""
    terms = [t.strip().lower() for t in (wanted or "").split(",") if t.strip()]
    return reduce(lambda a, b: a | b, [F.contains(F.lower(ref), F.lit(t)) for t in terms]) if terms else F.lit(True)


def articles(chunks: DataFrame, law: str) -> DataFrame:
    """Distinct (article_ref, concept_tags) of the structural levels; of all levels, 100 at most, where a law has none."""
    own = chunks.filter(F.col("law") == law.upper())
    pick = lambda df: df.select("article_ref", "concept_tags").distinct().orderBy("article_ref")
    found = own.filter(F.col("level").isin(STRUCTURAL_LEVELS))
    return pick(own).limit(100) if found.isEmpty() else pick(found)


def laws(df: DataFrame) -> DataFrame:
    return df.select("law").distinct().orderBy("law")


def stats(df: DataFrame) -> DataFrame:
    """(law, n), and the total under a null law."""
    return df.rollup("law").agg(F.count(F.lit(1)).alias("n"))


def denormalised(stmt: str | Column = "stmt") -> dict[str, Column]:
    """Enum arrays and flags of a typed statement, for queries that never open it."""
    s = F.col(stmt) if isinstance(stmt, str) else stmt
    of = lambda rows, field: sorted_set(F.transform(rows, lambda r: r[field]))
    some = lambda rows: F.coalesce(F.size(rows) > 0, F.lit(False))
    return {
        "legal_basis_types": sorted_set(F.array(s["legalBasis"]["type"])),
        "right_types": of(s["rightImpacted"], "type"),
        "constraint_types": of(s["constraints"], "type"),
        "purpose_categories": of(s["purposes"], "category"),
        "processing_actions": sorted_set(F.array(s["processingActivity"]["action"])),
        "sensitivity_levels": of(s["processingActivity"]["dataProcessed"], "sensitivity"),
        "transfer_mechanisms": of(s["dataTransfers"], "mechanism"),
        "has_retention": some(s["retentionPolicies"]),
        "has_transfer": some(s["dataTransfers"]),
        "has_consent_withdrawal": some(s["consentWithdrawal"]),
        "has_dpia": F.coalesce(F.length(s["processingActivity"]["riskAssessmentReference"]) > 0, F.lit(False)),
    }


def statement_id(law: Column, ref: Column, given: Column, description: Column) -> Column:
    """The given id, or a hash of law, reference and the first 64 characters of the statement as Python would write its JSON."""
    escaped = F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), r"([\\\\\"])", r"\\\\$1"), "\n", r"\\\\n")
    prefix = F.concat(F.lit('{"statementId": "", "description": "'), escaped)
    return F.when(F.length(given) > 0, given).otherwise(short_hash(F.upper(law), F.lit("|"), ref, F.lit("|"), F.substring(prefix, 1, 64)))


def source_clause(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


def statements_for_law(statements: DataFrame, law: str) -> DataFrame:
    return statements.filter(F.col("law") == law.upper()).orderBy("article_ref")
