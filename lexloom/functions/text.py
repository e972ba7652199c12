"""Text expressions with the semantics of Python's str and re."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python takes for white space: that of Unicode and the four information separators.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(x: Column) -> Column:
    """White space off both ends, as Python's str has it. No regular expression: characters inside are not looked at."""
    return F.btrim(x, F.lit(WHITE))


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def universal_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat(*parts).cast("binary")), 1, length)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f names it: inside a lambda, a plain expression is computed anew each time."""
    return F.element_at(F.transform(F.array(x), f), 1)


def cut(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """(before, parts): the text before the first match, then from each match to the next: `^` and `$` at line feeds only, classes of
    all of Unicode. Together they are the text, whatever it holds."""
    regex = ("(?dmUiu)" if ignore_case else "(?dmU)") + f"(?:{pattern})"
    both = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"), F.split(text, regex, -1).alias("between"))

    def joined(x: Column) -> Column:
        # an empty match at the start of the text has nothing before it, not even an empty string
        first = F.size(x["between"]) > F.size(x["found"])
        after = F.when(first, F.slice(x["between"], F.lit(2), F.size(x["found"]))).otherwise(x["between"])
        return F.struct(F.when(first, F.get(x["between"], F.lit(0))).otherwise(F.lit("")).alias("before"), F.zip_with(x["found"], after, lambda m, t: F.concat(m, t)).alias("parts"))

    return let(both, joined)


def running(x: Column, block: int = 64) -> Column:
    """Of each number of an array the sum of those before it. Sums of blocks are added up first, so time goes with the length, nearly."""
    none = F.expr("CAST(array() AS array<bigint>)")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)

    def within(b: Column, base: Column) -> Column:
        return F.transform(b, lambda _, i: base + total(F.slice(b, F.lit(1), i)))

    def whole(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))

    def summed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        bases = F.aggregate(blocks, zero, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, bases, within))

    return let(x, lambda v: F.when(F.size(v) == 0, none).otherwise(let(whole(v), summed)))


def percent(x: Column) -> Column:
    """A rate as whole per cent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def sorted_set(x: Column) -> Column:
    """Distinct values in order, without nulls and empty strings."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(x, F.expr("CAST(array() AS array<string>)")), lambda v: v.isNotNull() & (v != ""))))
