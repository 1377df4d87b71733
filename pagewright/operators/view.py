"""The interactive view over scanned items: filter, search, sort, select."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.export import placed

#: Columns that a search looks through.
SEARCHED = (
    "name", "url", "type", "host", "mime", "alt", "provenance", "format", "codec", "title", "creator", "album", "genre", "font_name", "family",
    "camera", "kind", "flavor", "doc_info", "playlist_info", "page_size",
)


def sort_columns(sort: str) -> list[Column]:
    size, pixels = F.coalesce("size", F.lit(0)), F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    return {"index": [F.asc("idx")], "size": [size.desc(), F.asc("idx")], "pixels": [pixels.desc(), F.asc("idx")], "type": [F.asc("type"), size.desc(), F.asc("idx")]}[sort]


@dataclass(frozen=True)
class View:
    """A lazily composed view of items; selections are DataFrames with the column idx."""

    items: DataFrame
    selection: DataFrame | None = None
    sort: str = "index"

    def of_type(self, kind: str) -> View:
        return self if kind == "all" else replace(self, items=self.items.where(F.col("type") == kind))

    def only_ok(self) -> View:
        return replace(self, items=self.items.where("status = 'ok'"))

    def only_originals(self) -> View:
        """Hides members of families that are not the best of them."""
        hidden = (F.coalesce("family_size", F.lit(0)) > 1) & ~F.coalesce("family_best", F.lit(False))
        return replace(self, items=self.items.where(~hidden))

    def only_selected(self) -> View:
        return replace(self, items=self.items.join(self.selection.select("idx").distinct(), "idx", "left_semi"))

    def search(self, text: str) -> View:
        text = text.strip().lower()
        if not text:
            return self
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in self.items.columns]
        return replace(self, items=self.items.where(F.lower(F.concat_ws(" ", *parts)).contains(text)))

    def sorted_by(self, sort: str) -> View:
        sort_columns(sort)
        return replace(self, sort=sort)

    def rows(self) -> DataFrame:
        return self.items.orderBy(*sort_columns(self.sort))

    def placed(self) -> DataFrame:
        """The rows with their ``position`` in the view, from 1."""
        return placed(self.items, *sort_columns(self.sort))

    def counts(self) -> DataFrame:
        ok = F.col("status") == "ok"
        size = F.sum(F.coalesce("size", F.lit(0)))
        return self.items.groupBy("type").agg(F.count("*").alias("n"), size.alias("bytes"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))

    def selected_bytes(self) -> DataFrame:
        chosen = self.items.where("status = 'ok'").join(self.selection.select("idx").distinct(), "idx", "left_semi")
        return chosen.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def search_text(blocks: DataFrame, text: str) -> DataFrame:
    return blocks.where(F.lower("text").contains(text.strip().lower()))


def select_range(items: DataFrame, sort: str, anchor: int, target: int) -> DataFrame:
    """Ids between anchor and target in the view's order, both included; the target alone if the anchor is not visible.

    Only the two ends are placed: a row is inside if its sort key lies between theirs, so no global numbering is needed.
    """
    size, pixels = F.coalesce("size", F.lit(0)), F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    key = {
        "index": F.struct(F.col("idx").alias("k")),
        "size": F.struct((-size).alias("k"), "idx"),
        "pixels": F.struct((-pixels).alias("k"), "idx"),
        "type": F.struct("type", (-size).alias("k"), "idx"),
    }[sort]
    keyed = items.select("idx", key.alias("key"))
    ends = keyed.where(F.col("idx").isin(anchor, target)).agg(
        F.max(F.when(F.col("idx") == anchor, F.col("key"))).alias("a"), F.max(F.when(F.col("idx") == target, F.col("key"))).alias("b")
    )
    lo, hi = F.least(F.coalesce("a", "b"), "b"), F.greatest(F.coalesce("a", "b"), "b")
    return keyed.join(F.broadcast(ends), (F.col("key") >= lo) & (F.col("key") <= hi)).select("idx")


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Symmetric difference of two sets of ids."""
    both = selection.select("idx").distinct().unionByName(ids.select("idx").distinct())
    return both.groupBy("idx").count().where("count = 1").select("idx")


def added(selection: DataFrame, ids: DataFrame) -> DataFrame:
    return selection.select("idx").unionByName(ids.select("idx")).distinct()


def subtracted(selection: DataFrame, ids: DataFrame) -> DataFrame:
    return selection.select("idx").distinct().join(ids.select("idx"), "idx", "left_anti")


def inverted(visible: DataFrame, selection: DataFrame) -> DataFrame:
    return subtracted(visible, selection)


def intersected(selection: DataFrame, visible: DataFrame) -> DataFrame:
    return selection.select("idx").distinct().join(visible.select("idx"), "idx", "left_semi")


def export_selection(items: DataFrame, ids: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Items to export: by id whatever their status, else by type or all, if they are ok."""
    if ids is not None:
        return items.join(ids.select("idx").distinct(), "idx", "left_semi")
    ok = items.where("status = 'ok'")
    return ok.where(F.col("type").isin(kinds)) if kinds else ok


def overflow(refs: DataFrame, most: int, group: str = "page_id", order: str = "idx") -> DataFrame:
    """References with ``overflow`` set beyond the first ``most`` of their group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return refs.withColumn("overflow", place > most)
