"""Joins of a large table with a per-group table of checked size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.functions.session import new_folder

MAX_BROADCAST_CELLS = 4_000_000


@dataclass(frozen=True)
class Sized:
    """A small table whose row count is known (and the maximum of one measure, if asked for)."""

    table: DataFrame
    rows: int
    largest: int = 0

    def derive(self, table: DataFrame) -> Sized:
        """A table with at most as many rows as this one."""
        return Sized(table, self.rows, self.largest)


def sized(table: DataFrame | Sized, measure: Column | None = None) -> Sized:
    """Compute a small table once and count its rows.

    The table is written to the shared folder, so what follows neither recomputes it nor
    carries its plan, and a lost executor loses nothing. A `Sized` is only measured.
    """
    if isinstance(table, Sized) and measure is None:
        return table
    if isinstance(table, Sized):
        stored = table.table
    else:
        folder = new_folder(table.sparkSession, "table")
        table.write.parquet(folder)
        stored = table.sparkSession.read.schema(table.schema).parquet(folder)
    rows, largest = stored.agg(F.count("*"), F.max(measure) if measure is not None else F.lit(0)).first()
    return Sized(stored, rows, largest or 0)


def lookup_join(
    df: DataFrame,
    table: DataFrame | Sized,
    on: list[str],
    how: str = "left",
    max_cells: int = MAX_BROADCAST_CELLS,
) -> DataFrame:
    """Join `df` with a small table, mostly one row per `on` key.

    A measured table of up to `max_cells` cells is broadcast, so `df` is not shuffled; a larger one is
    sort-merged, whatever its files seem to hold. A table that is not measured is joined plainly:
    adaptive execution broadcasts it if it turns out small, and splits the partition of a hot key.
    """
    if not isinstance(table, Sized):
        return df.join(table, on, how)
    fits = table.rows * len(table.table.columns) <= max_cells
    return df.join(F.broadcast(table.table) if fits else table.table.hint("merge"), on, how)
