"""Progress of a scan as events, and results of views that are kept until the data or the view changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Progress in percent where probing begins and the span that it covers; every so many items it is told.
BEGIN, SPAN, EVERY = 45, 50, 2


def progress_events(done: DataFrame, keys: list[str], order: str, total: str = "total") -> DataFrame:
    """(keys, done, total, progress): the progress that is told of the items of each job as they end.

    Items tell of themselves one by one; progress is told at every second of them and at the last.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = done.withColumn("done", place.cast("long"))
    told = rows.where((F.col("done") % EVERY == 0) | (F.col("done") == F.col(total)))
    share = F.col("done") / F.greatest(F.lit(1), F.col(total))
    return told.select(*keys, "done", F.col(total).alias("total"), (BEGIN + F.floor(share * SPAN + 0.5)).cast("int").alias("progress"))


class ViewCache:
    """Derived tables under a key of the data's version and the view's signature.

    The version covers changes of data and selection, the signature those of filter and sort. The tables of one key are
    held; another key releases them.
    """

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.tables: dict[str, DataFrame] = {}
        self.version = 0

    def changed(self) -> None:
        self.version += 1

    def get(self, signature: tuple, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        key = (self.version, *signature)
        if key != self.key:
            self.release()
            self.tables = {name: table.persist() for name, table in make().items()}
            self.key = key
        return self.tables

    def release(self) -> None:
        for table in self.tables.values():
            table.unpersist()
        self.key, self.tables = None, {}
