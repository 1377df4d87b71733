"""Merging references: the same URL found in several places of a page, or in several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import region, types
from pagewright.functions.region import zone_rank

#: How far a provenance is trusted, and tags that carry content.
TRUST = {"attr": 5, "css": 4, "datauri": 3, "json": 2, "inferred": 1}
CONTENT_TAGS = "img source video audio picture input a image div figure body td li span".split()
FIRST_FILLED = (
    "width_hint", "height_hint", "density", "declared_width", "selector", "line", "alt", "cdn", "css_prop", "font_format", "meta_key", "via_proxy",
)
INLINE_KEY, CROSS_INLINE_KEY = 200, 60


def trust(provenance: Column) -> Column:
    out = F.lit(0)
    for name, rank in TRUST.items():
        out = F.when(provenance == name, rank).otherwise(out)
    return out


def merge_key(length: int = INLINE_KEY) -> Column:
    inline = F.concat(F.lit("data::"), F.col("data_mime"), F.lit("::"), F.substring("data", 1, length))
    return F.when(F.col("data_mime").isNotNull(), inline).otherwise(F.col("url"))


def inline_ext(mime: Column) -> Column:
    """The extension of inline data of a MIME type."""
    fixed = {m: e for e, m in reversed(types.MIME_OF_EXT.items())} | {
        "image/png": "png", "image/jpeg": "jpg", "audio/mp4": "m4a", "text/javascript": "js", "application/javascript": "js", "text/html": "html",
        "image/svg+xml": "svg", "model/gltf+json": "gltf", "audio/ogg": "ogg",
    }
    known = F.create_map(*(F.lit(x) for pair in fixed.items() for x in pair))
    named = F.substring(F.regexp_replace(F.substring_index(mime, "/", -1), "(?i)[^a-z0-9]", ""), 1, 5)
    return F.coalesce(known[mime], F.when(mime.contains("/"), named), F.lit("bin"))


def _filled(column: str) -> Column:
    kind = F.col(column)
    return kind.isNotNull() & (kind.cast("string") != "") & ~kind.cast("string").isin("0", "0.0")


def typed(refs: DataFrame) -> DataFrame:
    """Raw references with their key, ext and type."""
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    by_path = types.ext_col(path)
    ext = F.when(F.col("data_mime").isNotNull(), inline_ext(F.col("data_mime"))).when(by_path != "", by_path)
    ext = F.coalesce(ext, F.col("cdn.ext"), F.lit(""))
    hint = F.when(~F.col("hint").isin("media", "link"), F.col("hint"))
    context = F.coalesce("context", F.concat(F.lit("<"), F.coalesce("tag", F.lit(""))))
    rows = refs.withColumn("key", merge_key()).withColumn("ext", ext)
    return types.with_type(rows, F.coalesce("data_mime", "cdn.mime"), F.col("ext"), context, hint)


def merge_references(refs: DataFrame, group: str = "page_id") -> DataFrame:
    """One row per (group, key), first come first kept, as one shuffle on that key.

    The first place sets every field. A later place replaces provenance, tag, attribute and context only if it is
    trusted more than all before it; gaps are filled by the first that has a value; an icon that content uses
    elsewhere becomes content. Zones: a place outside noise wins.
    """
    rows = typed(refs).withColumn("trust", trust(F.col("provenance")))
    order = Window.partitionBy(group, "key").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("best_before", F.max("trust").over(before)).withColumn("first_type", F.first("type").over(order))
    rows = rows.withColumn("leads", F.col("best_before").isNull() | (F.col("trust") > F.col("best_before")))
    later = F.col("best_before").isNotNull()
    content = [t for t in types.TYPES if t not in types.CHROME_TYPES + types.TECH_TYPES]
    lifts = later & F.col("leads") & (F.col("first_type") == "icon") & F.col("tag").isin(CONTENT_TAGS) & F.col("hint").isin(content)
    noise = F.col("zone") == "noise"
    rows = rows.withColumn("seen_better", F.coalesce(F.max(zone_rank(F.col("zone"))).over(before), F.lit(0)) > 1)

    def newest(column: str) -> Column:
        return F.max_by(column, F.when(F.col("leads") & _filled(column), F.col("seq"))).alias(column)

    def first(column: str) -> Column:
        return F.min_by(column, F.when(_filled(column), F.col("seq"))).alias(column)

    def noise_kinds(holds: Column) -> Column:
        entry = F.when(holds & noise & (F.col("zone_kind") != ""), F.struct("seq", "zone_kind"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["zone_kind"])

    merged = rows.groupBy(group, "key").agg(
        F.min("seq").alias("seq"), F.count("*").cast("int").alias("count"), F.min_by("url", "seq").alias("url"), F.min_by("ext", "seq").alias("ext"),
        F.min_by("data_mime", "seq").alias("data_mime"), F.min_by("data_bytes", "seq").alias("data_bytes"), F.min_by("data", "seq").alias("data"),
        F.max_by("provenance", F.when(F.col("leads"), F.col("seq"))).alias("provenance"),
        F.min_by("type", "seq").alias("first_type"), F.min_by("hint", F.when(lifts, F.col("seq"))).alias("lifted"),
        newest("tag"), newest("attr"), newest("context"), first("hint"), *(first(c) for c in FIRST_FILLED),
        F.bool_or(F.coalesce("sprite", F.lit(False))).alias("sprite"), F.min_by("image_set", "seq").alias("image_set"),
        F.max(zone_rank(F.col("zone"))).alias("rank"), F.max_by("zone", F.struct(zone_rank(F.col("zone")), "seq")).alias("zone"),
        F.max_by("zone_kind", "seq").alias("last_kind"), F.max_by("zone_soft", "seq").alias("last_soft"),
        F.array_distinct(noise_kinds(~F.col("seen_better"))).alias("zone_kinds"), F.array_join(noise_kinds(F.col("seen_better")), " ").alias("zone_also"),
    )
    all_noise = F.col("rank") == 1
    return merged.select(
        group, "key", "seq", "url", "data_mime", "data_bytes", "data", "ext", F.coalesce("lifted", "first_type").alias("type"),
        F.coalesce("tag", F.lit("inferred")).alias("tag"), F.coalesce("attr", F.lit("")).alias("attr"), "provenance", F.coalesce("lifted", "hint").alias("hint"),
        "count", "context", *FIRST_FILLED, F.col("cdn.h").cast("double").alias("declared_height"), "sprite", "image_set", "zone",
        F.when(all_noise, F.col("last_kind")).otherwise("").alias("zone_kind"), (all_noise & F.col("last_soft")).alias("zone_soft"), "zone_kinds", "zone_also",
    )


def display_rank() -> Column:
    """References found in text or data last, technical tags before them."""
    return F.when(F.col("provenance").isin("inferred", "json"), 3).when(F.col("tag").isin("link", "script", "meta"), 2).otherwise(1)


def numbered(refs: DataFrame, group: str = "page_id", collation: str | None = "UNICODE") -> DataFrame:
    """``idx`` from 1 within each group by rank, type and URL. Without a collation the order is by bytes."""
    url = F.coalesce("url", F.lit(""))
    by = [F.collate("type", collation), F.collate(url, collation)] if collation else [F.col("type"), url]
    return refs.withColumn("idx", F.row_number().over(Window.partitionBy(group).orderBy(display_rank(), *by, "seq")))


def merge_sources(sources: DataFrame, group: str = "job_id", order: str = "source") -> DataFrame:
    """Already merged lists of several sources as one: the first source's row stands, others add one to its count.

    ``sources`` has the columns key, zone, zone_kind, zone_soft, count and (order, seq), which place a row. Places are merged in that
    order, as for one page; a key has at most one row a source, so few of them meet.
    """
    place = F.struct(order, "seq")
    zones = ("zone", "zone_kind", "zone_soft", "zone_kinds", "zone_also")
    kept = [c for c in sources.columns if c not in (group, "key", "count", *zones)]
    seen = F.array_sort(F.collect_list(F.struct(order, "seq", "zone", F.col("zone_kind").alias("kind"), F.col("zone_soft").alias("soft"))))
    merged = sources.groupBy(group, "key").agg(
        *(F.min_by(c, place).alias(c) for c in kept), (F.min_by("count", place) + F.count("*") - 1).cast("int").alias("count"), seen.alias("_places")
    )
    names = {"zone": "zone", "kind": "zone_kind", "soft": "zone_soft", "kinds": "zone_kinds"}
    merged = merged.withColumn("_zone", region.merge_zones(F.col("_places")))
    told = {to: F.col(f"_zone.{name}") for name, to in names.items()} | {"zone_also": F.array_join("_zone.also", " ")}
    return merged.withColumns(told).drop("_places", "_zone")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def without_inferred(refs: DataFrame) -> DataFrame:
    return refs.where(~F.col("provenance").isin("inferred", "json"))


def crawl_targets(links: DataFrame, most: int = 12) -> DataFrame:
    """Same-origin pages to read next: (page_id, base, url, position), one per path, no assets, logins or carts."""
    asset = r"(?i)\.(pdf|zips?|rar|7z|tar|gz|tgz|bz2|xz|docx?|xlsx?|pptx?|csv|tsv|log|mp4|mkv|mov|avi|webm|m4v|mp3|m4a|flac|wav|ogg|opus|aac|png|jpe?g|gif|webp|avif|apng|svg|bmp|ico|tiff?|heic|woff2?|ttf|otf|eot|js|mjs|cjs|css|json|jsonld|xml|txt|md|ya?ml|apk|dmg|exe|msi|bin|wasm|ics|vcf|torrent)($|[?#])"
    no_page = "(?i)(login|signin|logout|signup|register|cart|checkout|share|print)"
    origin = lambda c: F.regexp_extract(c, r"^(https?://[^/?#]*)", 1)
    path = lambda c: F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)
    rows = links.where(origin("url") == origin("base")).withColumn("path", path("url"))
    rows = rows.where((F.col("path") != path("base")) & ~F.col("path").rlike(asset) & ~F.col("path").rlike(no_page))
    first = keep_first(rows, ["page_id", "path"], ["position"])
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("path")


def import_closure(sheets: DataFrame, imports: DataFrame, most_depth: int = 4, most_files: int = 40) -> DataFrame:
    """Style sheets reachable over @import: (root, sheet, depth), level by level, at most ``most_files`` a root.

    ``sheets`` has (root, sheet), ``imports`` (parent, child). One join a level; a sheet is read once a root, and a
    level's sheets beyond the room left are not followed.
    """
    level = sheets.select("root", "sheet").distinct().withColumn("depth", F.lit(0))
    seen = level
    for depth in range(1, most_depth + 1):
        ranked = seen.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("depth", "sheet")))
        room = ranked.where((F.col("place") <= most_files) & (F.col("depth") == depth - 1)).drop("place")
        nxt = room.join(imports, room["sheet"] == imports["parent"]).select("root", F.col("child").alias("sheet")).distinct()
        nxt = nxt.join(seen.select("root", "sheet"), ["root", "sheet"], "left_anti")
        seen = seen.unionByName(nxt.withColumn("depth", F.lit(depth)))
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "sheet"))
    return seen.withColumn("place", place).where(F.col("place") <= most_files).drop("place")
