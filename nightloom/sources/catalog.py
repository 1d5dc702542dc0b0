"""Star catalogues as text with fields separated by semicolons: id; RA "h m s"; Dec "+d m s"; magnitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LINES = 43


def degrees_of_ra(text: Column) -> Column:
    p = F.split(F.trim(text), " +")
    return (p[0].cast("double") + p[1].cast("double") / 60 + p[2].cast("double") / 3600) * 15


def degrees_of_dec(text: Column) -> Column:
    """Only a leading plus makes a declination positive; -00 keeps its sign."""
    p = F.split(F.trim(text), " +")
    size = F.abs(p[0].cast("double")) + p[1].cast("double") / 60 + p[2].cast("double") / 3600
    return F.when(F.startswith(F.trim(text), F.lit("+")), size).otherwise(-size)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """star_id, ra, dec, vmag; lines without four fields or without a magnitude are left out."""
    f = F.split(F.col(column), ";")
    return (
        lines.filter(F.size(f) == 4)
        .select(F.trim(f[0]).alias("star_id"), degrees_of_ra(f[1]).alias("ra"), degrees_of_dec(f[2]).alias("dec"), F.expr(f"try_cast(trim(split({column}, ';')[3]) AS double)").alias("vmag"))
        .filter(F.col("vmag").isNotNull())
    )


def read(spark: SparkSession, path: str, header: int = HEADER_LINES) -> DataFrame:
    """A catalogue file less its header lines and its last line. One file is one split here: catalogues are small and their lines are counted."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.explode(F.expr(f"slice(split(rtrim('\\n', value), '\\n'), {header + 1}, greatest(size(split(rtrim('\\n', value), '\\n')) - {header + 1}, 0))")).alias("value"))
    return parse(lines)
