"""Joins between items and the elements of a page: by key, staged, by text and by place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import collapse_space
from pagewright.functions.weburl import normalize
from pagewright.operators.css import css_references, parse_srcset
from pagewright.operators.html import LAZY_ATTR

BOX_SHARE, BLOCK_KEY = 0.35, 220
#: Rows of one rectangle for which another copy is made, and the most copies.
WAY_ROWS, MOST_WAYS = 64, 64
#: Attributes of elements that name a resource, and values of data attributes that do.
URL_ATTRS = ("src", "href", "poster", "data", "background", "xlink:href", "movie", "codebase", "formaction")
SRCSET_ATTRS = ("srcset", "imagesrcset")
ASSET_VALUE = re.compile(r"\.(png|jpe?g|webp|avif|gif|svg|mp4|webm|mov|m4a|mp3|wav|pdf|zip|docx?|xlsx?|pptx?)($|[?#])", re.I)


def block_key(tag: Column, text: Column) -> Column:
    return F.concat(F.lower(F.coalesce(tag, F.lit(""))), F.lit("|"), F.substring(collapse_space(F.coalesce(text, F.lit(""))), 1, BLOCK_KEY))


def _element_keys(pairs: list[tuple[str, str]], base: str) -> list[str]:
    """The resolved URLs that an element's attributes name, in order; a bare anchor is the page itself and names none."""
    found: dict[str, None] = {}
    for name, value in pairs:
        name, value = (name or "").lower(), value or ""
        if name in SRCSET_ATTRS:
            raws = [url for url, _, _ in parse_srcset(value)]
        elif name in URL_ATTRS or re.fullmatch(LAZY_ATTR, name):
            raws = [value]
        elif name == "style":
            raws = [r["raw"] for r in css_references(value) if r["kind"] != "import"]
        elif name.startswith("data-") and ASSET_VALUE.search(value):
            raws = [value]
        else:
            continue
        for raw in raws:
            if raw.strip() and not raw.strip().startswith("#"):
                key = normalize(raw, base)
                if key:
                    found[key] = None
    return list(found)


def element_keys(attributes: Column, base: Column) -> Column:
    """The keys of an element from its attributes (an array of structs of name and value) and the page's base."""

    @F.udf("array<string>", useArrow=True)
    def keys(pairs, url):
        return [] if pairs is None else _element_keys([(p["name"], p["value"]) for p in pairs], url or "")

    return keys(attributes, base)


def with_excluded(items: DataFrame, excluded: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, el_id, excluded): elements (el_id, keys) of kept items (id, key), and of excluded ones where no kept item has the key."""
    probes = elements.select("el_id", F.explode("keys").alias("key")).distinct()
    kept = probes.join(items.select("id", "key").distinct(), "key").withColumn("excluded", F.lit(False))
    free = excluded.select("id", "key").distinct().join(items.select("key").distinct(), "key", "left_anti")
    out = kept.unionByName(probes.join(free, "key").withColumn("excluded", F.lit(True)))
    return out.groupBy("id", "el_id").agg(F.min("excluded").alias("excluded"))


def items_to_elements(items: DataFrame, elements: DataFrame) -> DataFrame:
    """(item_id, el_id) of items (item_id, key) and elements (el_id, keys) that share a key."""
    probes = elements.select("el_id", F.explode("keys").alias("key")).distinct()
    return probes.join(items.select("item_id", "key"), "key").select("item_id", "el_id").distinct()


def staged_match(items: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """(item_id, el_id, stage): each stage (el_id, key) is offered only the items that none before it matched."""
    left, out = items.select("item_id", "key"), None
    for k, stage in enumerate(stages):
        found = left.join(stage, "key").select("item_id", "el_id").distinct().withColumn("stage", F.lit(k))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("item_id"), "item_id", "left_anti")
    return out


def unmatched(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Items without an element, with the reason."""
    lost = items.join(matched.select("item_id").distinct(), "item_id", "left_anti")
    return lost.withColumn("reason", F.when(F.col("key").startswith("data::"), "inline").otherwise("no element"))


def blocks_to_elements(blocks: DataFrame, elements: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, block_id, el_id): elements (el_id, tag, text) of a page take its blocks (block_id, tag, text) of the same key, both in document order.

    The page is part of the key, so a text that all pages share stays in as many groups as there are pages.
    """
    key = block_key(F.col("tag"), F.col("text")).alias("key")
    place = lambda order: F.row_number().over(Window.partitionBy(page, "key").orderBy(order))
    left = blocks.select(page, "block_id", key).withColumn("n", place("block_id"))
    right = elements.select(page, "el_id", key).withColumn("n", place("el_id"))
    return left.join(right, [page, "key", "n"]).select(page, "block_id", "el_id")


def overlap(a: str, b: str) -> Column:
    """The share of rectangle ``a`` that lies in rectangle ``b``."""
    width = F.least(F.col(f"{a}.right"), F.col(f"{b}.right")) - F.greatest(F.col(f"{a}.left"), F.col(f"{b}.left"))
    height = F.least(F.col(f"{a}.bottom"), F.col(f"{b}.bottom")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top"))
    area = F.greatest(F.lit(0.0), F.col(f"{a}.right") - F.col(f"{a}.left")) * F.greatest(F.lit(0.0), F.col(f"{a}.bottom") - F.col(f"{a}.top"))
    return F.when((area > 0) & (width > 0) & (height > 0), width * height / area).otherwise(0.0)


def boxes_in_areas(boxes: DataFrame, areas: DataFrame, share: float = BOX_SHARE, cell: float = 512.0) -> DataFrame:
    """(item_id, area_id, share) of boxes (item_id, box) that lie in an area (area_id, box) by ``share`` or more.

    Only different rectangles are compared; the rows that have them follow by equi-joins. A grid turns the overlap into one too:
    rectangles are dealt to the cells they touch, and a pair is taken in the first cell that both touch. The boxes that lie in
    an area that many rows share are dealt over up to MOST_WAYS copies of those rows. The boxes are neither broadcast nor crossed.
    """

    def celled(df: DataFrame, name: str) -> DataFrame:
        def span(low: str, high: str) -> Column:
            first = F.floor(F.col(f"{name}.{low}") / cell)
            return F.sequence(first, F.greatest(first, F.ceil(F.col(f"{name}.{high}") / cell) - 1))

        return df.withColumn("cx", F.explode(span("left", "right"))).withColumn("cy", F.explode(span("top", "bottom")))

    items, places = boxes.select("item_id", F.col("box").alias("item_box")), areas.select("area_id", F.col("box").alias("area_box"))
    shared = places.groupBy("area_box").agg(F.least(F.lit(MOST_WAYS), F.ceil(F.count("*") / WAY_ROWS)).cast("int").alias("ways"))
    pairs = celled(items.select("item_box").distinct(), "item_box").join(celled(shared, "area_box"), ["cx", "cy"])
    first_x = F.floor(F.greatest("item_box.left", "area_box.left") / cell)
    first_y = F.floor(F.greatest("item_box.top", "area_box.top") / cell)
    pairs = pairs.where((F.col("cx") == first_x) & (F.col("cy") == first_y))
    pairs = pairs.select("item_box", "area_box", "ways", overlap("item_box", "area_box").alias("share")).where(F.col("share") >= share)
    found = items.join(pairs.hint("merge"), "item_box").withColumn("way", F.pmod(F.xxhash64("item_id"), "ways").cast("int"))
    copies = places.join(shared, "area_box").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    return found.join(copies.drop("ways"), ["area_box", "way"]).select("item_id", "area_id", "share")


def region_bands(elements: DataFrame, most_noise: int = 60, most_main: int = 12) -> DataFrame:
    """Elements (page_id, el_id, parent_id, zone) whose zone differs from their parent's, noise or main, the first of each."""
    parents = elements.select("page_id", F.col("el_id").alias("parent_id"), F.col("zone").alias("parent_zone"))
    changed = elements.join(parents, ["page_id", "parent_id"], "left")
    changed = changed.where(F.coalesce("parent_zone", F.lit("content")) != F.col("zone")).where("zone in ('noise', 'main')")
    changed = changed.where(~((F.col("zone") == "main") & (F.coalesce("parent_zone", F.lit("")) == "noise")))
    place = F.row_number().over(Window.partitionBy("page_id", "zone").orderBy("el_id"))
    most = F.when(F.col("zone") == "noise", most_noise).otherwise(most_main)
    return changed.withColumn("place", place).where(F.col("place") <= most).select("page_id", "el_id", "zone", "place")
