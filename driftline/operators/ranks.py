"""Ranks over whole tables and over steps, on two levels, so that no step and no table is sorted in one task.

Values are dealt to a few cells by cut points from a sample of the series; a cell is ranked by itself and
the counts of the cells below are added.  The cut points decide how even the cells are, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 32
#: One series in so many is read for the cut points.
SAMPLE = 64


def with_cells(df: DataFrame, values: dict[str, str], cells: int = CELLS) -> DataFrame:
    """Add one column per name in ``values`` (name -> value column), which rises with the value; equal values share a cell.

    The sample is picked by id, which Spark pushes below windows over series.  One row is broadcast.
    """
    some = df.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0) if "id" in df.columns else df
    at = [k / cells for k in range(1, cells)]
    cuts = some.agg(*[F.percentile_approx(F.col(v).cast("double"), at, 1000).alias(f"_cuts_{n}") for n, v in values.items()])
    none = F.array().cast("array<double>")

    def below(name: str, value: str) -> Column:
        return F.size(F.filter(F.coalesce(f"_cuts_{name}", none), lambda c: c < F.col(value)))

    cell = {n: below(n, v) for n, v in values.items()}
    return df.join(F.broadcast(cuts)).withColumns(cell).drop(*[f"_cuts_{n}" for n in values])


def with_cell(df: DataFrame, value: str) -> DataFrame:
    return with_cells(df, {"_cell": value})


def with_ranks(df: DataFrame, values: dict[str, str], ties: str = "average", order: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1 over the whole table, a column per name in ``values``: average ranks of equal values, or ``ties='ordinal'`` in order of ``order``.

    All columns share one table of cell sizes, a few rows each, which travels as one broadcast row.
    """
    cell = {n: f"_cell_{n}" for n in values}
    celled = with_cells(df, {cell[n]: v for n, v in values.items()})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("cell")) for n, c in cell.items()])).alias("e")
    sizes = celled.select(each).groupBy("e.name", "e.cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select(F.concat_ws("|", "name", "cell").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    row = below.agg(F.map_from_entries(F.collect_list(F.struct("k", "b"))).alias("_below"))
    out = celled.join(F.broadcast(row))
    for n, v in values.items():
        if ties == "ordinal":
            own: Column = F.row_number().over(Window.partitionBy(cell[n]).orderBy(v, *order))
        else:
            own = F.rank().over(Window.partitionBy(cell[n]).orderBy(v)) + (F.count("*").over(Window.partitionBy(cell[n], v)) - 1) / F.lit(2.0)
        out = out.withColumn(n, F.col("_below")[F.concat_ws("|", F.lit(n), F.col(cell[n]))] + own)
    return out.drop("_below", *cell.values())


def with_rank(df: DataFrame, value: str, name: str, ties: str = "average", order: tuple[str, ...] = ()) -> DataFrame:
    return with_ranks(df, {name: value}, ties, order)
