"""The scan of pages as one lazily composed plan: extract, merge, judge, cap, probe, judge again, summarise.

Each part of the result is a DataFrame that shares the plan up to where it branches. What several parts read is written
once: below ``workspace``, else below ``spark.checkpoint.dir``, else as a persisted table. Pages are parsed once in any case.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import policy, text
from pagewright.operators import html, probe, refs, stats, view
from pagewright.sources.documents import display_name, outcome

LEAST_RESOURCES, MOST_RESOURCES, MOST_PAGES, MOST_HEADINGS = 20, 900, 12, 300


@dataclass(frozen=True)
class ScanOptions:
    """Options of a scan; numbers are brought into their ranges."""

    deep: bool = True
    infer: bool = True
    include_icons: bool = False
    include_tech: bool = False
    main_only: bool = True
    crawl_pages: int = 0
    max_resources: int = MOST_RESOURCES

    @property
    def policy(self) -> policy.Options:
        return policy.Options(self.include_icons, self.include_tech, self.main_only)

    @property
    def resources(self) -> int:
        return min(max(self.max_resources, LEAST_RESOURCES), MOST_RESOURCES)

    @property
    def pages(self) -> int:
        return min(max(self.crawl_pages, 0), MOST_PAGES)


@dataclass(frozen=True)
class ScanResult:
    docs: DataFrame
    headings: DataFrame
    links: DataFrame
    blocks: DataFrame
    keywords: DataFrame
    refs: DataFrame
    kept: DataFrame
    filtered: DataFrame

    def regions(self) -> DataFrame:
        return stats.region_summary(self.refs, self.blocks)

    def filter_summary(self) -> DataFrame:
        return policy.filter_summary(self.filtered)

    def text_totals(self) -> DataFrame:
        return stats.text_totals(self.blocks)


def _stored(df: DataFrame, workspace: str | None, name: str) -> DataFrame:
    """Written below ``workspace`` and read again; without one, below ``spark.checkpoint.dir``; in memory and on disk if neither is set."""
    spark = df.sparkSession
    root = workspace or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root}/{name}" if workspace else f"{root}/scan-{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan(pages: DataFrame, options: ScanOptions = ScanOptions(), sheets: DataFrame | None = None, workspace: str | None = None) -> ScanResult:
    """Scans pages (page_id, url, html). ``sheets`` (page_id, url, css) adds references of their style sheets.

    As in the reference, the result lists the first MOST_HEADINGS headings of a page; ``html.extract_pages`` has all.
    """
    extracted = _stored(html.extract_pages(pages), workspace, "extracted")
    raw = html.exploded(extracted, "refs").drop("position")
    if sheets is not None and options.deep:
        last = F.lit(1_000_000)
        raw = raw.unionByName(html.extract_css(sheets).withColumn("seq", F.col("seq") + last))
    if not options.infer:
        raw = refs.without_inferred(raw)
    judged = policy.judge(refs.numbered(refs.merge_references(raw)), options.policy)
    judged = _stored(judged, workspace, "judged")
    candidates = view.overflow(judged.where("verdict is null"), options.resources)
    over = candidates.where("overflow").withColumn("verdict", F.struct(F.lit("overflow").alias("reason"), F.lit("").alias("detail")))
    excluded = judged.where("verdict is not null").unionByName(over.drop("overflow"))
    status = F.lit("unresolved")
    filtered = excluded.select(
        "page_id", "seq", "idx", "url", "type", "verdict.reason", F.substring("verdict.detail", 1, 140).alias("detail"), policy.reason_label(F.col("verdict.reason")).alias("label"),
        F.col("data_bytes").alias("size"), "zone", "zone_kind", status.alias("status"), F.lit(False).alias("probed"),
    )
    part = lambda name: html.exploded(extracted, name)
    headings = part("headings").where(F.col("position") <= MOST_HEADINGS)
    return ScanResult(
        extracted.select("page_id", "doc.*", "html_bytes", "tokens"), headings, part("links"), part("blocks"), part("keywords"), judged,
        candidates.where("not overflow").drop("overflow", "verdict"), filtered,
    )


def probed_items(kept: DataFrame, bodies: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Kept references with the facts of their bytes (url, status, body, and error if there is one) and the second verdict.

    References without bytes stay, with status ``pending``.
    """
    error = F.col("error") if "error" in bodies.columns else F.lit("")
    found = kept.join(bodies.select("url", F.col("status").alias("http"), "body", F.coalesce(error, F.lit("")).alias("error")), "url", "left")
    rows = probe.probed(found)
    image, media = F.col("image"), F.col("media")
    rows = rows.withColumns({
        "status": F.when(F.col("http").isNull(), "pending").otherwise(outcome(F.col("http"), F.col("error"))),
        "size": F.octet_length("body").cast("long"), "mime": F.col("sig.mime"), "width": F.coalesce(image["width"], media["width"]), "height": F.coalesce(image["height"], media["height"]),
        "duration": F.coalesce(media["duration"], image["duration"]), "frames": image["frames"], "symbols": image["symbols"], "glyph_like": image["glyph_like"], "shapes": image["shapes"],
        "view_box": image["view_box"], "icon_set": image["icon_set"], "sizes": image["sizes"], "entries": image["entries"], "sprite": F.coalesce(image["sprite"], F.lit(False)),
        "name": display_name(F.col("url"), F.col("ext")), "host": F.regexp_extract("url", "^https?://([^/?#]*)", 1),
    })
    return rows.withColumn("verdict", policy.post_filter(options.policy)).drop("body")


def reprobed(items: DataFrame, again: DataFrame) -> DataFrame:
    """``items`` with those of ``again`` (the same columns, probed once more) in the place of the older ones."""
    keys = ["page_id", "idx"]
    return items.join(again.select(*keys), keys, "left_anti").unionByName(again.select(*items.columns))


def reprobe(items: DataFrame, ids: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """Items to probe once more, by idx or by URL."""
    wanted = []
    if ids is not None:
        wanted.append(items.join(ids.select("idx").distinct(), "idx", "left_semi").select("page_id", "idx"))
    if urls is not None:
        wanted.append(items.join(urls.select("url").distinct(), "url", "left_semi").select("page_id", "idx"))
    if not wanted:
        return items.limit(0)
    keys = wanted[0] if len(wanted) == 1 else wanted[0].unionByName(wanted[1]).distinct()
    return items.join(keys, ["page_id", "idx"], "left_semi")


def describe(items: DataFrame) -> DataFrame:
    """Items with the labels that a view shows."""
    return items.select("idx", "name", "type", "status", text.format_bytes(F.col("size")).alias("size_label"), text.format_seconds(F.col("duration")).alias("duration_label"))
