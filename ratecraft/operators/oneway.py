"""One-way analysis: weighted mean and weight by row of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Model, Table
from .binding import bind


def one_way(df: DataFrame, table: Table, target: str, weight: str | None = None, encodings: dict[str, list[str]] | None = None) -> DataFrame:
    """(row, <target>_avg, weight) for every row of the table, 0 where there is no data.

    Null and NaN targets and weights count as 0; rows of data that match no table row are an error.
    """
    bound = bind(df, Model([table], encodings=encodings or {}))
    clean = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)
    y = clean(F.col(f"`{target}`").cast("double"))
    w = clean(F.col(f"`{weight}`").cast("double")) if weight else F.lit(1.0)
    row = F.coalesce(F.col("_row0"), F.raise_error(F.lit(f"an observation matches no row of {table.name}")).cast("int"))
    sums = bound.groupBy(row.alias("row")).agg(F.sum(y * w).alias("wy"), F.sum(w).alias("weight"))
    rows = df.sparkSession.range(table.n).select(F.col("id").cast("int").alias("row"))
    return rows.join(sums, "row", "left").select("row", F.coalesce(F.try_divide("wy", "weight"), F.lit(0.0)).alias(f"{target}_avg"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
