"""Statistics of a scan, duplicates and asset families. Every aggregate combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import types
from pagewright.functions.region import kind_label

HOSTS, LARGEST = 14, 8
#: Types that form families, and how far aspects of a family may differ.
FAMILY_TYPES, FAMILY_ASPECT = ("image", "vector", "video", "audio"), 0.12


def _size() -> Column:
    return F.coalesce(F.col("size"), F.lit(0))


def by_type(items: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    known = F.when(F.col("type").isin(list(types.TYPES)), F.col("type")).otherwise("other")
    return items.groupBy(known.alias("type")).agg(
        F.count("*").alias("n"), F.sum(_size()).alias("bytes"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")
    )


def by_host(items: DataFrame, most: int = HOSTS) -> DataFrame:
    """The hosts with most bytes, then most items, then first by name."""
    found = items.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), F.sum(_size()).alias("bytes"))
    return found.orderBy(F.desc("bytes"), F.desc("n"), "host").limit(most)


def by_provenance(items: DataFrame) -> DataFrame:
    return items.groupBy("provenance").agg(F.count("*").alias("n"))


def largest(items: DataFrame, most: int = LARGEST) -> DataFrame:
    return items.where("size > 0").select("idx", "name", "size", "type").orderBy(F.desc("size"), "idx").limit(most)


def totals(items: DataFrame) -> DataFrame:
    pixels = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("long") * F.col("height")).otherwise(0)
    return items.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(_size()), F.lit(0)).alias("bytes"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("size") > 0).alias("with_size"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("media_seconds"), F.coalesce(F.sum(pixels), F.lit(0)).alias("pixels"),
        F.count_if(F.coalesce("dup", F.lit(False))).alias("duplicates"),
    )


def text_totals(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return blocks.groupBy(*(keys or [])).agg(
        F.count("*").alias("blocks"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum(F.octet_length("text")).alias("bytes"),
        F.count_if(F.col("level") > 0).alias("headings"), F.count_if(F.col("zone") == "noise").alias("noise"),
    )


def region_summary(refs: DataFrame, blocks: DataFrame, group: str = "page_id") -> DataFrame:
    """Per group the references and blocks of each zone."""
    tagged = refs.select(group, "zone", F.lit("refs").alias("what")).unionByName(blocks.select(group, "zone", F.lit("texts").alias("what")))
    counts = [
        F.count_if((F.col("what") == what) & (F.coalesce(F.when(F.col("zone").isin("main", "noise"), F.col("zone")), F.lit("content")) == zone)).alias(f"{what}_{zone}")
        for what in ("refs", "texts") for zone in ("main", "content", "noise")
    ]
    return tagged.groupBy(group).agg(*counts)


def region_summary_of(pages: DataFrame) -> DataFrame:
    """The same of pages with nested refs and blocks, counted inside their arrays; pages with neither are left out."""

    def held(part: str, zone: str) -> Column:
        own = lambda x: F.when(x["zone"].isin("main", "noise"), x["zone"]).otherwise("content")
        return F.sum(F.size(F.filter(part, lambda x: own(x) == zone)).cast("long"))

    counts = [held(part, z).alias(f"{what}_{z}") for part, what in (("refs", "refs"), ("blocks", "texts")) for z in ("main", "content", "noise")]
    return pages.where((F.size("refs") > 0) | (F.size("blocks") > 0)).groupBy("page_id").agg(*counts)


def region_kinds(refs: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("zone_kind", F.lit("")) == "", "other").otherwise(F.col("zone_kind"))
    found = refs.where("zone = 'noise'").groupBy(kind.alias("zone_kind")).agg(F.count("*").alias("n"))
    return found.withColumn("label", kind_label(F.col("zone_kind")))


def mark_duplicates(items: DataFrame) -> DataFrame:
    """``dup``: another item has the same hash. Counted by a pre-aggregated join, so one common hash stays spread."""
    seen = items.where(F.coalesce("hash", F.lit("")) != "").groupBy("hash").agg(F.count("*").alias("_n"))
    return items.join(seen.where("_n > 1"), "hash", "left").withColumn("dup", F.col("_n").isNotNull()).drop("_n")


def families(items: DataFrame) -> DataFrame:
    """Items of families of two or more with family, family_size, family_best and family_of.

    The best has most pixels, else bytes, and is first by idx on ties. Members are as wide for their height as the best, within 12 %;
    those without a known aspect belong too. The best of each family is a pre-aggregated join; no family is gathered.
    """
    usable = items.where((F.col("status") == "ok") & F.col("type").isin(*FAMILY_TYPES) & (F.coalesce("url", F.lit("")) != ""))
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    aspect = F.when((w > 0) & (h > 0), w / h).otherwise(0.0)
    score = F.when(w.cast("long") * h > 0, w.cast("long") * h).otherwise(_size())
    rows = usable.withColumns({"family": types.asset_family(F.col("url")), "aspect": aspect, "score": score})
    best = rows.groupBy("family").agg(F.max_by(F.struct("idx", "aspect"), F.struct("score", F.negative("idx").alias("i"))).alias("best"))
    near = (F.col("best.aspect") == 0) | (F.col("aspect") == 0) | (F.abs(F.col("aspect") - F.col("best.aspect")) / F.col("best.aspect") <= FAMILY_ASPECT)
    members = rows.join(best, "family").where(near)
    sizes = members.groupBy("family").agg(F.count("*").alias("family_size")).where("family_size > 1")
    out = members.join(sizes, "family").withColumn("family_best", F.col("idx") == F.col("best.idx"))
    out = out.withColumn("family_of", F.when(~F.col("family_best"), F.col("best.idx")))
    return out.withColumn("family", F.substring("family", 1, 120)).drop("best", "aspect", "score")


def family_totals(members: DataFrame) -> DataFrame:
    best = F.when(F.col("family_best"), F.col("family_size"))
    return members.agg(F.count_if("family_best").alias("groups"), F.coalesce(F.sum(best - 1), F.lit(0)).alias("collapsed"))


def policy_mode(include_icons: bool, include_tech: bool) -> str:
    names = {(True, True): "全部资源", (True, False): "含 UI 图标", (False, True): "含技术资源", (False, False): "仅内容资源"}
    return names[include_icons, include_tech]


def requests(items: DataFrame, filtered: DataFrame) -> DataFrame:
    """How many entries were probed, and how many were skipped without a request."""
    both = items.select(F.lit(True).alias("kept"), F.lit(True).alias("probed")).unionByName(filtered.select(F.lit(False).alias("kept"), "probed"))
    return both.agg(F.count_if("probed").alias("probed"), F.count_if(~F.col("kept")).alias("skipped"))
