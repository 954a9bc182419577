"""N-Triples, tab-separated triples and dictionaries, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.schemas import BLANK, IDS, LITERAL, PLAIN, RDFS, URI

#: subject, predicate, rest without the final point.
LINE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.?\s*$"
STRING = r'^"((?:[^"\\]|\\.)*)"'


def _plain(token: Column) -> Column:
    return F.regexp_replace(token, r"^<|>$", "")


def _unescaped(text: Column) -> Column:
    """Short escapes; the backslash itself goes through a stand-in so that it isn't read twice."""
    text = F.replace(text, F.lit("\\\\"), F.lit("\ue000"))
    for escape, sign in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        text = F.replace(text, F.lit(escape), F.lit(sign))
    return F.replace(text, F.lit("\ue000"), F.lit("\\"))


def _escaped(text: Column) -> Column:
    for sign, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escape))
    return text


def parse_lines(lines: DataFrame) -> DataFrame:
    """Triples of a DataFrame with a column ``value``; blank, comment and broken lines are left out."""
    x = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(*(F.regexp_extract("value", LINE, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o")))).where("s <> ''")
    literal, blank = F.startswith("o", F.lit('"')), F.startswith("o", F.lit("_:"))
    lang, dtype = F.regexp_extract("o", STRING + r"@([A-Za-z0-9-]+)$", 2), F.regexp_extract("o", STRING + r"\^\^<([^>]*)>$", 2)
    return x.select(
        _plain(F.col("s")).alias("s"),
        _plain(F.col("p")).alias("p"),
        F.when(literal, _unescaped(F.regexp_extract("o", STRING, 1))).otherwise(_plain(F.col("o"))).alias("o"),
        F.when(literal, LITERAL).when(blank, BLANK).otherwise(URI).alias("o_kind"),
        F.nullif(lang, F.lit("")).alias("o_lang"),
        F.nullif(dtype, F.lit("")).alias("o_dtype"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def to_lines(triples: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    o = F.col("o")
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dtype"), F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), _escaped(o), F.lit('"'), tail)
    return triples.select(F.concat_ws(" ", name(F.col("s")), name(F.col("p")), F.when(F.col("o_kind") == LITERAL, literal).otherwise(name(o)), F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    to_lines(triples).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """uri, label: English labels, several words included."""
    x = read(spark, path).where((F.col("p") == RDFS + "label") & (F.col("o_kind") == LITERAL) & (F.col("o_lang") == "en"))
    return x.select(F.col("s").alias("uri"), F.col("o").alias("label"))


def read_tsv(spark: SparkSession, path: str, schema: str = PLAIN) -> DataFrame:
    """Rows of exactly three fields; others are left out."""
    n = schema.count(",") + 1
    x = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where(F.size("f") == n)
    return x.select(*(F.col("f")[k].cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(schema.split(", "))))


def write_tsv(df: DataFrame, path: str, header: bool = False, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).option("header", header).option("sep", "\t").option("quote", "").csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, uri with a header line, gzip or plain."""
    return spark.read.schema(IDS).option("header", True).option("sep", "\t").option("quote", "").csv(path)
