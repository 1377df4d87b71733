"""The bundle of a scan: its files by type, the manifest, the texts and a report, as entries (page_id, path, body) of archives.

All jobs are bundled at once. What one entry holds of a job (its manifest, its texts, its report) is gathered by job; files stay
rows of their own. ``page_id`` names the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import format_bytes
from pagewright.operators import export
from pagewright.plans.scan import ScanOptions

#: The wording of the report, and how many exclusions it lists.
SCOPES = {"all": "全部资源", "selected": "精选资源"}
MOST_LISTED = 240
NOTES = (
    "说明：ZIP 内每个文件都是目标站点返回的原始字节（未缩放、未二次编码）。",
    "     _manifest.json 与 _资源清单.csv 记录了每个文件的原始 URL、MIME、像素尺寸、",
    "     时长、页数、页面尺寸、文档标题 / 作者、音频标题 / 艺人 / 专辑 / 年份 / 流派、",
    "     采样率 / 声道 / 帧率 / 编解码、HLS·DASH 档位、字体家族与字形数、相机 EXIF、",
    "     声明尺寸及其来源，可用于溯源与校验。",
)
OUTSIDE_NOTE = "以下文字位于页眉 / 导航菜单 / 页脚 / 侧栏 / 表单 / 挂件，不属于主体内容区；仍保留以便核对识别结果。"
SWITCHES = {"icon": "「UI 图标」", "tech": "「技术资源」", "region": "「扫描页眉 / 导航 / 页脚」"}
TECHNICAL = ("font", "stylesheet", "script", "data", "page", "other")


def item_order(items: DataFrame, group: str = "page_id") -> DataFrame:
    """Items numbered anew: those that are ok first, then by idx."""
    place = Window.partitionBy(group).orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), "idx")
    return items.withColumn("idx", F.row_number().over(place))


def document_order(boxes: DataFrame, group: str = "page_id") -> DataFrame:
    """(group, id, place): entries by the first of their boxes (id, place, excluded, hidden) that is shown as kept."""
    shown = boxes.where(~F.coalesce("excluded", F.lit(False)) & ~F.coalesce("hidden", F.lit(False)))
    first = shown.groupBy(group, "id").agg(F.min("place").alias("first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("first", "id"))
    return first.select(group, "id", place.alias("place"))


def job_list(jobs: DataFrame, most: int = 20) -> DataFrame:
    """The newest jobs (id, url, status, created_at, resources, title)."""
    shown = jobs.select("id", "url", "status", "created_at", F.coalesce("resources", F.lit(0)).alias("resources"), F.coalesce("title", F.lit("")).alias("title"))
    return shown.orderBy(F.desc("created_at"), "id").limit(most)


def pruned_jobs(jobs: DataFrame, most: int = 24) -> DataFrame:
    """Jobs without the oldest ended ones that are beyond the limit; running ones stay whatever their number."""
    over = jobs.count() - most
    if over <= 0:
        return jobs
    oldest = jobs.where("status <> 'running'").orderBy("created_at", "id").limit(over).select("id")
    return jobs.join(oldest, "id", "left_anti")


def root_name(url: Column, label: str, stamp: str, prefix: str = "pagewright") -> Column:
    """The folder of a bundle: prefix, host, scope and time."""
    host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    plain = "".join(c for c in label if c == "_" or (c.isascii() and c.isalnum()) or "一" <= c <= "鿿")
    return export.safe_segment(F.concat(F.lit(f"{prefix}-"), F.when(host == "", "site").otherwise(host), F.lit(f"-{plain}-{stamp}")))


def file_entries(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Items (page_id, idx, name, type, ext, body, ...) with the ``path`` of their entry; empty where there are no bytes."""
    named = items.join(roots, "page_id").withColumn("ext", F.coalesce("ext", F.lit("")))
    folder = F.concat("root", F.lit("/"), F.coalesce(export.type_label(), F.lit("其他")), F.lit("/"))
    named = named.withColumn("path", F.concat(folder, export.safe_file(F.col("name"), F.col("ext"), F.col("idx"))))
    there = F.octet_length("body") > 0
    return export.unique_paths(named.where(there), "path", "idx").unionByName(named.where(~F.coalesce(there, F.lit(False))).withColumn("path", F.lit("")))


def _lines(rows: DataFrame, line: Column, order: str, key: str = "page_id") -> DataFrame:
    """(key, lines): one job's lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))


def manifest_files(entries: DataFrame) -> DataFrame:
    """(page_id, idx, json): what the manifest says of each file, failed ones included."""
    col = lambda c, kind="string": F.col(c) if c in entries.columns else F.lit(None).cast(kind)
    ok = F.col("path") != ""
    fields = [F.col("path"), F.col("name"), F.col("url"), F.col("type"), col("mime").alias("mime")]
    fields += [F.when(ok, F.octet_length("body")).alias("bytes"), col("size", "long").alias("reportedBytes"), F.when(ok, "ok").otherwise("failed").alias("status")]
    fields += [col(c).alias(c) for c in export.MANIFEST_COLUMNS if c not in ("name", "url", "mime", "size")]
    return entries.select("page_id", "idx", F.to_json(F.struct(*fields)).alias("json"))


def report(
    jobs: DataFrame, items: DataFrame, filtered: DataFrame, refs_by_zone: DataFrame | None = None, options: ScanOptions = ScanOptions(),
    scope: str = "all", made_at: str = "", tool: str = "pagewright",
) -> DataFrame:
    """(page_id, report): the text that goes with a bundle. ``jobs`` are (page_id, url, title), ``refs_by_zone`` a region summary."""
    label = SCOPES.get(scope, scope)
    totals = items.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    kinds = items.groupBy("page_id", F.coalesce(export.type_label(), F.lit("其他")).alias("label")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    kinds = _lines(kinds, F.concat(F.lit("  - "), "label", F.lit("  "), F.col("n").cast("string"), F.lit(" 个")), "first").withColumnRenamed("lines", "kinds")
    out = jobs.select("page_id", "url", F.coalesce("title", F.lit("")).alias("title")).join(totals, "page_id", "left").join(kinds, "page_id", "left")

    place = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    listed = filtered.withColumn("place", place)
    guess = F.when(F.col("size") > 0, F.concat(F.lit(" · "), format_bytes(F.col("size")))).otherwise("")
    line = F.concat(F.lit("  · ["), "label", F.lit("] "), F.coalesce("url", F.lit("内联")), guess, F.lit("  ← "), F.coalesce("detail", "reason"))
    some = _lines(listed.where(F.col("place") <= MOST_LISTED), line, "place").withColumnRenamed("lines", "listed")
    reasons = filtered.groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    reasons = _lines(reasons.withColumn("rank", F.struct(F.negative("n").alias("n"), "first")), F.concat(F.lit("  - "), "label", F.lit("  "), F.col("n").cast("string"), F.lit(" 项")), "rank").withColumnRenamed("lines", "reasons")
    flags = [F.max(F.col("reason") == "icon").alias("icon"), F.max(F.col("reason").isin(*TECHNICAL)).alias("tech"), F.max(F.col("reason") == "region").alias("region")]
    gone = filtered.groupBy("page_id").agg(F.count("*").alias("gone"), *flags)
    out = out.join(gone, "page_id", "left").join(reasons, "page_id", "left").join(some, "page_id", "left")
    if refs_by_zone is not None:
        out = out.join(refs_by_zone, "page_id", "left")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    say = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    none = F.array().cast("array<string>")
    lines = [
        say(f"{tool} · 资源导出包"), say("=" * 52), say("来源页面 : ", F.coalesce("url", F.lit(""))), say("页面标题 : ", F.when(F.col("title") != "", F.col("title")).otherwise("-")),
        say(f"导出范围 : {label}（", text("n"), " 个文件）"), say("合计体积 : ", format_bytes(F.coalesce("bytes", F.lit(0)))), say(f"生成时间 : {made_at}"), say(""),
        say("类型分布 :"), F.coalesce("kinds", none), say(""), *(say(n) for n in NOTES), say(""),
        say("扫描策略 : " + ("包含 UI 图标" if options.include_icons else "不含 UI 图标") + " · " + ("包含字体/样式表/脚本/数据" if options.include_tech else "不含字体 / 样式表 / 脚本 / 数据")),
        say("扫描区域 : " + ("主体内容区（页眉 / 导航菜单 / 页脚 / 侧栏 / 表单 / 挂件不扫描）" if options.main_only else "整个页面（含页眉 / 导航菜单 / 页脚 / 侧栏）")),
    ]
    if refs_by_zone is not None:
        skipped = F.lit("（未排除）") if not options.main_only else F.concat(F.lit("（已排除 "), text("gone"), F.lit(" 项）"))
        lines.append(say("区域统计 : 页面引用 正文 ", text("refs_main"), " · 未定性 ", text("refs_content"), " · 正文外 ", text("refs_noise"), skipped, " · 文案 正文 ", text("texts_main"), " / 正文外 ", text("texts_noise")))
    more = F.col("gone") - F.size("listed")
    hint = F.array_join(F.array_compact(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in SWITCHES.items()))), "")
    excluded = F.concat(
        say("被排除   : ", text("gone"), " 项（默认不扫描、不请求）"), F.coalesce("reasons", none), say(""), say("排除明细 :"), F.coalesce("listed", none),
        F.when(more > 0, say("  … 其余 ", more.cast("string"), " 项略")).otherwise(none), say(""),
        F.when(hint != "", say("     如需这些资源，回到扫描台打开", hint, "开关重新扫描。")).otherwise(none),
    )
    lines.append(F.when(F.coalesce("gone", F.lit(0)) > 0, excluded).otherwise(say("被排除   : 0 项")))
    return out.select("page_id", F.array_join(F.concat(*lines), "\n").alias("report"))


def text_entries(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, path, body) of a bundle's texts: Markdown of what is and of what is not main text, a table and JSON."""
    def entry(rows: DataFrame, name: str, text: Column) -> DataFrame:
        return rows.join(roots, "page_id").select("page_id", F.concat("root", F.lit(f"/_文案/{name}")).alias("path"), F.encode(text, "utf-8").alias("body"))

    inside, outside = export.export_text(blocks, "md", "main"), export.export_text(blocks, "md", "noise")
    level, line = F.when(F.col("level") > 0, F.col("level")), F.when(F.col("line") > 0, F.col("line"))
    ordered = export.placed(blocks.withColumn("at_line", line), "ord", group=["page_id"])
    table = _lines(ordered, export.csv_line("position", "tag", level, export.zone_label(), "chars", "words", "at_line", "text"), "position")
    head = export.BOM + ",".join(export.TEXT_HEAD)
    objects = _lines(blocks, export.text_json_line(), "ord")
    return (
        entry(inside, "正文.md", F.col("body"))
        .unionByName(entry(outside, "正文外.md", F.concat(F.lit(f"> {OUTSIDE_NOTE}\n\n"), "body")))
        .unionByName(entry(table, "文案.csv", F.array_join(F.concat(F.array(F.lit(head)), "lines"), export.CRLF)))
        .unionByName(entry(objects, "文案.json", F.concat(F.lit("["), F.array_join("lines", ",\n"), F.lit("]"))))
    )


def bundle(
    jobs: DataFrame, items: DataFrame, blocks: DataFrame, filtered: DataFrame, options: ScanOptions = ScanOptions(), scope: str = "all",
    stamp: str = "", with_text: bool = True, tool: str = "pagewright",
) -> DataFrame:
    """(page_id, path, body): all entries of the bundles of jobs (page_id, url, title).

    ``items`` are those to export, with their ``body``; one without bytes is only told of in the manifest. A job without items
    gives no bundle.
    """
    label = SCOPES.get(scope, scope)
    own = jobs.join(items.select("page_id").distinct(), "page_id", "left_semi")
    roots = own.select("page_id", root_name(F.col("url"), label, stamp, tool).alias("root"))
    files = file_entries(items, roots)
    at = lambda rows, name, text: rows.join(roots, "page_id").select("page_id", F.concat("root", F.lit(f"/{name}")).alias("path"), F.encode(text, "utf-8").alias("body"))
    told = _lines(manifest_files(files), F.col("json"), "idx").join(own, "page_id")
    facts = F.to_json(F.struct(F.lit(tool).alias("tool"), F.lit(stamp).alias("generatedAt"), F.col("url").alias("source"), F.col("title"), F.lit(scope).alias("scope"), F.size("lines").alias("entryCount")))
    manifest = F.concat(F.substring(facts, F.lit(1), F.char_length(facts) - 1), F.lit(',"files":[\n'), F.array_join("lines", ",\n"), F.lit("\n]}"))
    full = files.withColumns({c: F.lit(None).cast("string") for c in export.MANIFEST_COLUMNS if c not in files.columns})
    full = full.withColumn("zone_label", export.zone_label() if {"zone", "zone_kind", "zone_soft"} <= set(files.columns) else F.lit(""))
    table = export.placed(full, "idx", group=["page_id"])
    table = _lines(table, export.csv_line("position", export.type_label(), *export.MANIFEST_COLUMNS), "position")
    out = files.where("path <> ''").select("page_id", "path", "body")
    out = out.unionByName(at(report(own, items, filtered, options=options, scope=scope, made_at=stamp, tool=tool), "README.txt", F.col("report")))
    out = out.unionByName(at(told, "_manifest.json", manifest))
    out = out.unionByName(at(table, "_资源清单.csv", F.array_join(F.concat(F.array(F.lit(export.BOM + ",".join(export.MANIFEST_HEAD))), "lines"), export.CRLF)))
    return out.unionByName(text_entries(blocks.join(roots.select("page_id"), "page_id", "left_semi"), roots)) if with_text else out
