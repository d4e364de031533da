"""Text formats, written and read by column expressions over text files.

Tab-separated text escapes with a backslash and writes NULL as \\N, so a quoted CSV reader can't stand for it. Every format
is a row to a line (line ends inside values are escaped), so files are split and read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A character and the letter behind a backslash that stands for it; the backslash comes first.
ESCAPES = {"\\": "\\", "\t": "t", "\n": "n", "\r": "r", "\0": "0", "\b": "b", "\f": "f"}
NULL = "\\N"


def _literal(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(c: Column) -> Column:
    for char, letter in ESCAPES.items():
        c = _literal(c, char, "\\" + letter)
    return c


def unescaped(c: Column) -> Column:
    """Parts between escaped backslashes hold only backslashes that stand before a letter."""

    def part(x: Column) -> Column:
        for char, letter in list(ESCAPES.items())[1:]:
            x = _literal(x, "\\" + letter, char)
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def write_tab_separated(df: DataFrame, path: str) -> None:
    cells = [F.coalesce(escaped(F.col(f"`{c}`").cast("string")), F.lit(NULL)) for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)


def read_tab_separated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Cells in the schema's order; a line with fewer cells has NULL in the rest."""
    cells = spark.read.text(path).select(F.split("value", "\t", -1).alias("cells"))

    def cell(i: int) -> Column:
        raw = F.get("cells", F.lit(i))
        return F.when(raw != NULL, unescaped(raw)).cast(schema[i].dataType).alias(schema[i].name)

    return cells.select(*(cell(i) for i in range(len(schema))))


def write_tab_separated_with_names(df: DataFrame, path: str) -> None:
    """Each file starts with a line of names; names and cells are escaped alike."""
    cells = [F.coalesce(escaped(F.col(f"`{c}`").cast("string")), F.lit(NULL)).alias(c) for c in df.columns]
    df.select(*cells).write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def read_tab_separated_with_names(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    raw = StructType([StructField(f.name, StringType()) for f in schema])
    read = spark.read.schema(raw).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("nullValue", NULL).option("emptyValue", "").csv(path)
    return read.select(*(unescaped(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))


def write_json_each_row(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def read_json_each_row(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object a row, NULL as null."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row"))


def json_compact_rows(df: DataFrame) -> DataFrame:
    """A JSON array a row."""
    cells = [F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("c")), {"ignoreNullFields": "false"}), r"(?s)^\{\"c\":(.*)\}$", 1) for c in df.columns]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("row"))


def values_rows(df: DataFrame) -> DataFrame:
    """A parenthesised tuple a row, as behind VALUES: text in single quotes, escaped by backslashes."""

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        text = c.cast("string")
        if df.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean"):
            text = F.concat(F.lit("'"), _literal(escaped(text), "'", "\\'"), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    return df.select(F.concat(F.lit("("), F.concat_ws(",", *(cell(c) for c in df.columns)), F.lit(")")).alias("row"))


def read_values(spark: SparkSession, text: str, names: list[str]) -> DataFrame:
    """The rows of a statement's VALUES text, which is as long as a statement may be."""
    return spark.sql(f"select * from values {text}").toDF(*names)


def discard(df: DataFrame) -> None:
    """Runs the whole plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
