"""Coverage and gaps across laws. One aggregation gives a row a law; every question is asked of that small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DELTA, MANDATE, MATRIX
from lexloom.functions.text import percent, sorted_set

SETS = [c for _, c in MATRIX if not c.startswith("has_")]
FLAGS = [c for _, c in MATRIX if c.startswith("has_")]


def coverage(statements: DataFrame) -> DataFrame:
    """(law, total, a sorted set for each enum column, a count for each flag).

    Sets hold values of closed vocabularies, so both the distinct arrays collected and the result are small however many statements
    there are, and they are combined before the shuffle."""
    sets = [sorted_set(F.flatten(F.collect_set(c))).alias(c) for c in SETS]
    flags = [F.count_if(F.col(c)).alias(c) for c in FLAGS]
    return statements.groupBy("law").agg(F.count(F.lit(1)).alias("total"), *sets, *flags)


def rate(flag: str) -> Column:
    return F.coalesce(F.try_divide(F.col(flag), F.col("total")), F.lit(0.0))


def universe(cov: DataFrame, column: str) -> DataFrame:
    return cov.agg(sorted_set(F.flatten(F.collect_set(column))).alias("universe"))


def concept_coverage(cov: DataFrame, column: str) -> DataFrame:
    """(law, present, absent): values found, and values that only others have."""
    return cov.crossJoin(F.broadcast(universe(cov, column))).select("law", F.col(column).alias("present"), F.array_except("universe", column).alias("absent"))


def only_in(cov: DataFrame, column: str) -> DataFrame:
    """(law, only): values that no other law has."""
    values = cov.select("law", F.explode(column).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("law").alias("law")).filter("n = 1")
    own = values.groupBy("law").agg(F.array_sort(F.collect_list("v")).alias("only"))
    return cov.select("law").join(own, "law", "left").select("law", F.coalesce("only", F.expr("CAST(array() AS array<string>)")).alias("only"))


def flag_coverage(cov: DataFrame, flag: str, threshold: float = MANDATE) -> DataFrame:
    return cov.select("law", F.col(flag).alias("flagged"), "total", rate(flag).alias("rate"), (rate(flag) >= threshold).alias("mandates"))


def matrix(cov: DataFrame) -> DataFrame:
    """(ord, dimension, law, kind, vals, n, rate): a row for each dimension and law."""
    cells = []
    for i, (label, column) in enumerate(MATRIX):
        flag = column in FLAGS
        vals = F.expr("CAST(NULL AS array<string>)") if flag else F.col(column)
        cells.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("dimension"), F.lit("rate" if flag else "set").alias("kind"), vals.alias("vals"), (F.lit(None).cast("int") if flag else F.size(column)).alias("n"), (rate(column) if flag else F.lit(None).cast("double")).alias("rate")))
    return cov.select("law", F.explode(F.array(*cells)).alias("x")).select("x.ord", "x.dimension", "law", "x.kind", "x.vals", "x.n", "x.rate")


def matrix_wide(cov: DataFrame, laws: list[str] | None = None) -> DataFrame:
    """A column a law, of counts or rates."""
    cells = matrix(cov).groupBy("ord", "dimension")
    return (cells.pivot("law", laws) if laws else cells.pivot("law")).agg(F.first(F.coalesce("rate", F.col("n").cast("double"))))


def deltas(cov: DataFrame, threshold: float = MANDATE, both_ways: bool = True) -> DataFrame:
    """(law_a, law_b, ord, dimension, missing, note): what law_a has, or mandates, and law_b not. Laws are few: the join of the
    table with itself has a row for each pair of them."""
    a = cov.select(*[F.col(c).alias(f"a_{c}") for c in cov.columns])
    b = F.broadcast(cov.select(*[F.col(c).alias(f"b_{c}") for c in cov.columns]))
    pairs = a.join(b, F.col("a_law") != F.col("b_law") if both_ways else F.col("a_law") < F.col("b_law"))
    rows, none = [], F.expr("CAST(array() AS array<string>)")
    for i, (label, column, note) in enumerate(DELTA):
        if column in FLAGS:
            of = lambda side: F.coalesce(F.try_divide(F.col(f"{side}_{column}"), F.col(f"{side}_total")), F.lit(0.0))  # noqa: B023, E731
            gap, missing = (of("a") >= threshold) & (of("b") < threshold), none
            said = [F.col("a_law") if x == "a" else F.col("b_law") if x == "b" else F.lit(x) for x in note.replace("{a}", "\0a\0").replace("{b}", "\0b\0").split("\0")]
            text = F.concat(*said, F.lit(" ("), F.col("a_law"), F.lit(": "), percent(of("a")), F.lit(" of statements; "), F.col("b_law"), F.lit(": "), percent(of("b")), F.lit(" of statements)"))
        else:
            missing = F.array_except(f"a_{column}", f"b_{column}")
            gap, text = F.size(missing) > 0, F.lit(note)
        rows.append(F.when(gap, F.struct(F.lit(i).alias("ord"), F.lit(label).alias("dimension"), missing.alias("missing"), text.alias("note"))))
    return pairs.select(F.col("a_law").alias("law_a"), F.col("b_law").alias("law_b"), F.explode(F.array_compact(F.array(*rows))).alias("x")).select("law_a", "law_b", "x.ord", "x.dimension", "x.missing", "x.note")


def value_laws(cov: DataFrame, column: str) -> DataFrame:
    """(value, laws): who has what."""
    return cov.select("law", F.explode(column).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set("law")).alias("laws"))


def cell(cov: DataFrame, dimension: str, law: str) -> DataFrame:
    """The one row of the matrix for a dimension and a law, in either case; none where either is unknown."""
    return matrix(cov).filter((F.col("dimension") == dimension) & (F.col("law") == law.upper()))


def summaries(cov: DataFrame, threshold: float = MANDATE) -> DataFrame:
    """(law_a, law_b, summary) of each ordered pair of laws, in words."""
    pairs = cov.select(F.col("law").alias("law_a")).join(F.broadcast(cov.select(F.col("law").alias("law_b"))), F.col("law_a") != F.col("law_b"))  # few laws
    values = F.when(F.size("missing") > 0, F.array_join(F.array_sort("missing"), ", ")).otherwise(F.lit("(structural gap)"))
    line = F.concat(F.lit("  "), "dimension", F.lit(": "), values, F.when(F.col("note") != "", F.concat(F.lit("\n    → "), "note")).otherwise(F.lit("")))
    said = deltas(cov, threshold).groupBy("law_a", "law_b").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))).alias("lines"))
    head = F.concat(F.lit("Obligations in "), "law_a", F.lit(" not present in "), "law_b", F.lit(":\n\n"))
    none = F.concat(F.lit("No gaps found: "), "law_a", F.lit(" and "), "law_b", F.lit(" appear equivalent."))
    text = F.when(F.col("lines").isNull(), none).otherwise(F.concat(head, F.array_join(F.transform("lines", lambda x: x["t"]), "\n")))
    return pairs.join(said, ["law_a", "law_b"], "left").select("law_a", "law_b", text.alias("summary"))
