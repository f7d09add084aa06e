"""Column frames (field names plus parallel value arrays) to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(fields: Column) -> Column:
    return F.transform(fields, lambda name, i: F.coalesce(name, F.concat(F.lit("field_"), i)))


def frame_rows(
    frames: DataFrame, names: Sequence[str], fields: str = "fields", values: str = "values", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per position of the longest column, with the named fields as columns.

    A shorter column gives NULL beyond its end, as does a name the frame lacks; of
    columns with the same name the last counts.  Frames without values give no rows.
    """
    lengths = F.transform(F.col(values), lambda column: F.coalesce(F.array_size(column), F.lit(0)))
    rows = F.coalesce(F.array_max(lengths), F.lit(0))
    positions = F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>"))
    known = F.slice(_names(F.col(fields)), F.lit(1), F.array_size(values))
    columns = [
        F.coalesce(
            F.get(F.col(values), F.array_size(known) - F.nullif(F.array_position(F.reverse(known), name), F.lit(0))),
            F.array().cast("array<string>"),
        )
        for name in names
    ]
    zipped = F.arrays_zip(positions, *columns)
    return frames.select(*keep, F.inline(zipped)).toDF(*keep, "row_index", *names)


def frame_cells(
    frames: DataFrame, fields: str = "fields", values: str = "values", keep: Sequence[str] = ()
) -> DataFrame:
    """The long form, for frames whose fields are not known beforehand: one row per cell."""
    names = _names(F.col(fields))
    return (
        frames.select(*keep, names.alias("_names"), F.posexplode(values).alias("_column", "_cells"))
        .where(F.col("_column") < F.array_size("_names"))
        .select(
            *keep,
            F.get("_names", F.col("_column")).alias("field"),
            F.posexplode("_cells").alias("row_index", "value"),
        )
    )
