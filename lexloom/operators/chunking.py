"""Hierarchical chunks of laws by structure patterns: expressions over one row a document, no shuffle, also not for the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import GENERIC_PATTERNS, LAW_PATTERNS, MAX_CHUNK, MIN_CHUNK, MIN_SEGMENT
from lexloom.functions.text import collapse, cut, let, running, short_hash, strip
from lexloom.operators.tagging import law_tags

SEGMENT = "array<struct<text:string,start:bigint>>"


def segments(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """From each match to the next, with its position; text before the first match is dropped, as are segments of fewer than 30
    characters after stripping."""
    def placed(x: Column) -> Column:
        at = running(F.transform(x["parts"], lambda t: F.length(t).cast("long")))
        return F.zip_with(x["parts"], at, lambda t, i: F.struct(t.alias("text"), (i + F.length(x["before"])).alias("start")))

    return F.filter(let(cut(text, pattern, ignore_case), placed), lambda s: F.length(strip(s["text"])) >= MIN_SEGMENT)


def reference(segment: Column) -> Column:
    """First line, white space collapsed, 80 characters."""
    return F.substring(collapse(strip(F.split(segment, "\n", 2)[0])), 1, 80)


def chunk_id(law: Column, ref: Column, text: Column) -> Column:
    """Hash over the text before it is stripped."""
    return short_hash(law, F.lit("|"), ref, F.lit("|"), F.substring(text, 1, 64))


def _below(pattern: tuple[str, str, bool], parent: Column) -> Column:
    """The segments of a chunk's text one level down, as chunks."""
    level, regex, ignore_case = pattern

    def placed(x: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), reference(x["text"]).alias("ref"), parent["ref"].alias("parent"), strip(x["text"]).alias("text"), F.substring(x["text"], 1, 64).alias("head"), (parent["start"] + x["start"]).alias("start")
        )

    return F.transform(segments(parent["text"], regex, ignore_case), placed)


def large_pieces(text: Column, max_chars: int = MAX_CHUNK, separator: str = "\n{2,}", joint: str = "\n\n") -> Column:
    """Paragraphs put together as long as they fit; a piece's start counts the characters of the pieces before it."""
    empty = F.expr(f"CAST(array() AS {SEGMENT})")
    zero = F.struct(empty.alias("out"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, p: Column) -> Column:
        flush = (F.length(a["cur"]) + F.length(p) > max_chars) & (a["cur"] != "")
        done = F.array_append(a["out"], F.struct(a["cur"].alias("text"), a["at"].alias("start")))
        grown = F.when(a["cur"] != "", F.concat(a["cur"], F.lit(joint), p)).otherwise(p)
        return F.struct(F.when(flush, done).otherwise(a["out"]).alias("out"), F.when(flush, p).otherwise(grown).alias("cur"), F.when(flush, a["at"] + F.length(a["cur"])).otherwise(a["at"]).alias("at"))

    last = lambda a: F.when(strip(a["cur"]) != "", F.array_append(a["out"], F.struct(a["cur"].alias("text"), a["at"].alias("start")))).otherwise(a["out"])
    return F.aggregate(F.split(text, separator, -1), zero, step, last)


def chunk(docs: DataFrame, min_chars: int = MIN_CHUNK, max_chars: int = MAX_CHUNK, laws: list[str] | None = None) -> DataFrame:
    """docs (law, text) as (law, chunk_id, article_ref, parent_ref, level, concept_tags, text, char_offset, seq).

    A top segment without inner segments stays itself, one with them gives way to them; three-level laws keep articles beside their
    clauses of min_chars or more; chunks over max_chars are split at blank lines. seq is the order in the document: its chunks are one
    array, of about the size of its text, so texts are not shuffled. With `laws`, docs holds no others, and the plan only the patterns of
    these.
    """
    base = docs.select(F.upper("law").alias("law"), "text")
    wanted = None if laws is None else {law.upper() for law in laws}
    groups: dict[int, tuple[list, list[str]]] = {}
    for law, patterns in LAW_PATTERNS.items():
        if wanted is None or law in wanted:
            groups.setdefault(id(patterns), (patterns, []))[1].append(law)
    parts = [_chunk_one(base.filter(F.col("law").isin(*own)), patterns, min_chars, max_chars) for patterns, own in groups.values()]
    if wanted is None or wanted - set(LAW_PATTERNS):
        parts.append(_chunk_one(base.filter(~F.col("law").isin(*LAW_PATTERNS)), GENERIC_PATTERNS, min_chars, max_chars))
    out = parts[0] if parts else _chunk_one(base, GENERIC_PATTERNS, min_chars, max_chars)
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("concept_tags", law_tags(F.col("text"), F.col("law")))
    return out.select("law", "chunk_id", "article_ref", "parent_ref", "level", "concept_tags", "text", "char_offset", "seq")


def _chunk_one(docs: DataFrame, patterns: list, min_chars: int, max_chars: int) -> DataFrame:
    start = F.lit(0).cast("long").alias("start")
    root = F.struct(F.lit("").alias("ref"), F.col("text").alias("text"), start)
    whole = F.struct(F.lit("document").alias("level"), F.col("law").alias("ref"), F.lit("").alias("parent"), strip(F.col("text")).alias("text"), F.substring("text", 1, 64).alias("head"), start)

    def clauses(article: Column) -> Column:
        return F.concat(F.array(article), F.filter(_below(patterns[2], article), lambda c: F.length(c["text"]) >= min_chars))

    def inner(top: Column) -> Column:
        kept = lambda b: F.flatten(F.transform(b, clauses)) if len(patterns) > 2 else b
        return let(_below(patterns[1], top), lambda b: F.when(F.size(b) > 0, kept(b)).otherwise(F.array(top)))

    def piece(x: Column, text: Column, head: Column, at: Column) -> Column:
        return F.struct(x["level"].alias("level"), x["ref"].alias("ref"), x["parent"].alias("parent"), text.alias("text"), head.alias("head"), at.alias("start"))

    def pieces(x: Column) -> Column:
        split = F.when(F.length(x["text"]) > max_chars, large_pieces(x["text"], max_chars))
        parts = lambda p: F.transform(p, lambda q: piece(x, strip(q["text"]), F.substring(q["text"], 1, 64), x["start"] + q["start"]))
        return let(split, lambda p: F.when(F.size(p) > 0, parts(p)).otherwise(F.array(piece(x, x["text"], x["head"], x["start"]))))

    top = let(_below(patterns[0], root), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(whole)))
    every = F.flatten(F.transform(F.flatten(F.transform(top, inner)), pieces))
    rows = docs.select("law", F.posexplode(every).alias("seq", "x"))
    return rows.select(
        "law", chunk_id(F.col("law"), F.col("x.ref"), F.col("x.head")).alias("chunk_id"), F.col("x.ref").alias("article_ref"), F.col("x.parent").alias("parent_ref"), F.col("x.level").alias("level"),
        F.col("x.text").alias("text"), F.col("x.start").alias("char_offset"), F.col("seq").cast("long").alias("seq"),
    )
