"""Concept tags by keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import KEYWORDS, LAW_KEYWORDS


def tags(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Concepts with a keyword in the lower-cased text, in the order of the table. The tables are literals of the plan, walked by
    two nested loops over one lower-cased text; a chain of 180 `contains` costs more to compile than to run."""
    table = F.array(*[F.struct(F.lit(concept).alias("c"), F.array(*[F.lit(w) for w in words]).alias("w")) for concept, words in keywords.items()])
    lowered = F.transform(F.array(F.lower(text)), lambda t: F.transform(F.filter(table, lambda x: F.exists(x["w"], lambda w: F.contains(t, w))), lambda x: x["c"]))
    return F.element_at(lowered, 1)


def law_tags(text: Column, law: Column) -> Column:
    """By the law's own keyword table, or else the general one."""
    out = tags(text, KEYWORDS)
    for name, words in LAW_KEYWORDS.items():
        out = F.when(F.upper(law) == name, tags(text, words)).otherwise(out)
    return out


def tag(df: DataFrame) -> DataFrame:
    """df (law, text) with concept_tags."""
    return df.withColumn("concept_tags", law_tags(F.col("text"), F.col("law")))


def tag_counts(df: DataFrame) -> DataFrame:
    """(law, concept, n) over tagged rows."""
    return df.select("law", F.explode("concept_tags").alias("concept")).groupBy("law", "concept").agg(F.count(F.lit(1)).alias("n"))
