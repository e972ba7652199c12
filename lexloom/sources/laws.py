"""Law files and the statement model as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import universal_newlines
from lexloom.sources.shared import filesystem


#: Of a law printed in two languages side by side, the left half of each page.
PDF_WIDTH = {"PIPEDA": 0.5}


def parse_specs(specs: list[str]) -> dict[str, str]:
    """["LAW=path", ...] split at the first "="; items without one are left out, later ones win."""
    return {law.strip().upper(): path.strip() for law, _, path in (s.partition("=") for s in specs if "=" in s)}


def read_laws(spark: SparkSession, laws: dict[str, str], pdf_reader=None) -> DataFrame:
    """(law, path, text), a row a file. Text and Markdown are read whole, bad UTF-8 is replaced; PDF needs `pdf_reader`, a function
    from the bytes of a file and the share of a page's width to read to the texts of its pages, which are joined by blank lines; other
    kinds are refused, as are files that don't exist."""
    out = None
    for law, path in laws.items():
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in ("txt", "md") and not (kind == "pdf" and pdf_reader):
            raise ValueError(f"unsupported file: {path}")
        fs, at = filesystem(spark, path)
        if not len(fs.globStatus(at) or []):
            raise FileNotFoundError(path)
        if kind in ("txt", "md"):
            df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), universal_newlines(F.col("value")).alias("text"))
        else:
            width = PDF_WIDTH.get(law.upper(), 1.0)
            read = F.udf(lambda content, width=width: "\n\n".join(p or "" for p in pdf_reader(bytes(content), width)), "string")
            df = spark.read.format("binaryFile").load(path).select("path", read("content").alias("text"))
        df = df.select(F.lit(law.upper()).alias("law"), "path", "text")
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "law string, path string, text string")


def laws_with_vocabulary(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored laws that a vocabulary was fitted for."""
    return chunks.select("law").distinct().join(vocabulary.select("law").distinct(), "law", "left_semi")
