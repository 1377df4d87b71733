"""Which references are content: verdicts before and after bytes are known, as Catalyst expressions.

A verdict is a struct(reason, detail); null keeps the row. Rules are ordered and the first that holds
decides, so each verdict is one ``case when`` that a scan can push through and evaluate in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.region import kind_label
from pagewright.functions.types import CHROME_TYPES, TECH_TYPES, TYPES

#: Edges in pixels and sizes in bytes.
ICON_EDGE, ICON_CONTEXT_EDGE, PIXEL_EDGE, PIXEL_BYTES, INLINE_ICON_BYTES = 64, 128, 4, 512, 1400
SPRITE_FRAMES, SPRITE_EDGE, TRIM = 12, 256, 400
#: Name patterns.
ICON_NAME = r"(?i)(?:^|[/._\-\s])(?:favicons?|touch-?icons?|app-?icons?|ui-?icons?|icons?|iconfont|icon-?font|glyphicons?|glyphs?|sprites?|picto-?grams?|bullets?|chevrons?|carets?|spinners?|preloaders?|loaders?|stickers?|emojis?|emoticons?|smapies?)(?:[._\-@]|\b)"
ICON_PHRASE = r"(?i)(?:^|[/._\-])(?:arrow|caret|chevron|cross|tick|check-?mark|hamburger|menu-?(?:icon|button)?|search-?icon|expand|collapse|plus-?icon|minus-?icon|play-?btn|pause-?btn|btn-?(?:bg|icon)?|social-?icons?|star-?empty|dot-?(?:png|gif|svg)|marker-?icon|badge-?small|avatar-?(?:small|default|placeholder|mono)|no-?image|no-?photo|broken-?image|default-?(?:thumb|avatar|user)|placeholder|watermark|grain|noise-?texture|noise\.png)(?:[/._\-@]|\b)"
ICON_DIR = r"(?i)(?:^|/)(?:icons?|iconfont|glyphs?|sprites?|ui|widgets?|toolbar|navbar|topbar|sidebar|footer|buttons?|smilies?|emoji|emojis?|flags?|countries|social|sharing|share|follow|badges?|stars?|ratings?|pagination|avatars?|thumbnails?|tiny|mini|small|16|24|32|48|64)(?:/|$)"
PIXEL_NAME = r"(?i)(?:^|[/._\-])(?:spacer|blank|transparent|trans-?pixel|clear-?(?:gif|png|pixel)?|tracking-?pixel|track-?(?:pixel|.gif)|analytics?-?pixel|beacon|web-?bug|webbug|1x1|1x1\.gif|px\.gif|[bsmg]\.gif|__utm\.gif|ga\.gif|collect|log\.gif|event\.gif|notice\.gif|record_gif|rt_event|open\.php|b\.js|dot\.(?:gif|png)|empty-?(?:gif|png|image)|placeholder-?(?:gif|png)?|no-?cookie|noscript-?\.gif)(?:[/._\-?#]|\b)"
TRACKING_HOST = r"(?i)doubleclick|googlesyndication|googleadservices|google\.[a-z]{2,3}/(?:pagead|collect)|facebook\.com/tr|analytics\.google|google-analytics\.com|googletagmanager|/ga\.js|/gtag/js|scorecardresearch|quantserve|omtrdc|bat\.bing|crazyegg|hotjar|clarity\.ms|matomo|piwik|cnzz|umeng|hm\.baidu|google\.[a-z]{2,3}/rmi?/collect"
CHROME_SELECTOR = r"(?i)(?:^|[\s,>+~.#\[_-])(?:nav|navbar|menu|menubar|breadcrumb|crumb|tab|btn|button|icon|ico|logo|wordmark|brand|glyph|sprite|caret|chevron|close|toggle|switch|checkbox|radio|rating|social|share|follow|footer|header|topbar|toolbar|sidebar|cookie|banner|badge|chip|pill|pagination|pager|search|dropdown|accordion|tooltip|toast|modal|loader|spinner|bullet|avatar|thumb)(?:[\s,>+~.#\[_-]|\b|-)"
CONTENT_DIR = r"(?i)(?:^|/)(?:images?|img|imgres|media|uploads?|uploadfiles|files?|assets|photos?|pics?|pictures?|gallery|albums?|covers?|banners?|posters?|products?|blogs?|articles?|attachments?|resource|content|stream|video|audio)(?:/|$)"
LAZY_ATTR = r"(?i)^data[-_]?[a-z0-9_-]*?(?:src|srcset|url|uri|image|img|thumb|thumbnail|poster|background|bg|file|download|href|media|video|audio|movie|clip|sound|mp4|mp3|webm|original|orig|lazy|lazyload|echo|preview|cover|full|large|zoom|lightbox|gallery|source|path|attach)(?:[-_]?(?:set|s|2x|1x))?$"
CHROME_PROPERTIES = ["cursor", "border-image", "border-image-source", "mask", "mask-image", "-webkit-mask", "-webkit-mask-image"]
MEDIA_TAGS = "img image source video audio picture input embed object canvas iframe track".split()
#: Reasons and their labels; other reasons are types.
REASON_LABELS = {
    "region": "内容区之外", "icon": "UI 图标", "pixel": "占位像素", "font": "字体", "stylesheet": "样式表", "script": "脚本", "data": "数据",
    "page": "页面", "other": "无法归类", "overflow": "数量上限",
}


@dataclass(frozen=True)
class Options:
    """Switches of a scan."""

    include_icons: bool = False
    include_tech: bool = False
    main_only: bool = True


#: Columns that verdicts read; rows that lack one are treated as if it were null.
REF_COLUMNS = {
    "url": "string", "type": "string", "tag": "string", "attr": "string", "provenance": "string", "hint": "string", "meta_key": "string",
    "selector": "string", "css_prop": "string", "sprite": "boolean", "zone": "string", "zone_kind": "string", "zone_soft": "boolean",
    "width_hint": "string", "height_hint": "string", "declared_width": "double", "declared_height": "double", "width": "int", "height": "int",
    "data_mime": "string", "data_bytes": "long",
    "cdn": "struct<w:int,h:int,dpr:double,q:int,ext:string,mime:string,p:string,sq:int,inner:int,badge:int,emoji:int,avatar:int>",
}
ITEM_COLUMNS = {
    "type": "string", "mime": "string", "width": "int", "height": "int", "size": "long", "sprite": "boolean", "symbols": "int",
    "glyph_like": "boolean", "shapes": "int", "view_box": "string", "icon_set": "boolean", "sizes": "array<string>", "entries": "int", "frames": "int",
}


def with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with null columns for those that it lacks."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def path_and_query(url: Column) -> Column:
    return F.lower(F.when(url.rlike("^https?://"), F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1)).otherwise(F.coalesce(url, F.lit(""))))


def host_name(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def declared_edge() -> Column:
    """The largest edge that markup, CSS or the URL declare."""
    names = ("declared_width", "declared_height", "width_hint", "height_hint", "width", "height")
    cdn = (F.coalesce(F.col("cdn.w"), F.lit(0)), F.coalesce(F.col("cdn.h"), F.lit(0)))
    return F.greatest(*map(_number, names), *cdn)


def content_signal() -> Column:
    """The first cue that a reference is content, or empty."""
    tag = F.lower(_text("tag"))
    return (
        F.when(F.col("provenance") == "css", "样式表 url() 引用")
        .when(F.col("provenance") == "datauri", "内联数据")
        .when(tag.isin(MEDIA_TAGS), F.concat(F.lit("<"), F.col("tag"), F.lit("> 媒体标签")))
        .when(F.col("hint").isin("image", "video", "audio", "vector"), F.concat(F.lit("标签类型暗示为"), F.col("hint")))
        .when(F.col("attr") == "a[download]", "a[download] 附件")
        .when(_text("attr").rlike(LAZY_ATTR), "懒加载属性")
        .when(_text("meta_key").rlike("(?i)og:|twitter:|image|thumb|avatar|photo"), F.concat(F.lit("meta "), F.col("meta_key")))
        .when(
            F.greatest(*(F.coalesce(F.col(f"cdn.{f}"), F.lit(0)) for f in ("w", "h", "dpr", "q"))) > 0, "图片处理参数"
        )
        .when(path_and_query(F.col("url")).rlike(CONTENT_DIR), "内容目录")
        .otherwise("")
    )


def soft_region_escape() -> Column:
    """Downloads and media tags stay although their region is noise by name only."""
    named = _text("attr").rlike(r"(?i)^a\[download\]$|^download$") | F.lower(_text("tag")).isin(
        "video", "audio", "source", "picture", "track", "object", "embed", "iframe"
    )
    return F.coalesce(F.col("zone_soft"), F.lit(False)) & named


def _verdict(reason: str | Column, detail: str | Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(reason).alias("reason"), as_col(detail).alias("detail"))


def _first(*rules: tuple[Column, Column]) -> Column:
    out = F.lit(None).cast("struct<reason:string,detail:string>")
    for holds, verdict in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), verdict).otherwise(out)
    return out


def _pixels(edge: Column) -> Column:
    return F.concat(edge.cast("long").cast("string"), F.lit("px"))


def _read_once(refs: DataFrame) -> DataFrame:
    """What several rules look at, computed once a row: path, host, file name, declared edge."""
    inline, url = F.col("data_mime").isNotNull(), F.col("url")
    path = F.when(inline, F.concat(F.lit("data:"), F.lower("data_mime"))).otherwise(path_and_query(url))
    rows = refs.withColumns({"_path": path, "_host": F.when(inline, "").otherwise(host_name(url)), "_edge": declared_edge()})
    return rows.withColumn("_name", F.substring_index(F.substring_index("_path", "?", 1), "/", -1))


def pre_filter(options: Options = Options()) -> Column:
    """The verdict on a reference before anything is fetched, over rows of ``_read_once``."""
    none = F.lit(None).cast("struct<reason:string,detail:string>")
    kind = F.coalesce(F.col("type"), F.lit("other"))
    inline = F.col("data_mime").isNotNull()
    path, host, name, edge = (F.col(c) for c in ("_path", "_host", "_name", "_edge"))
    visual = kind.isin("image", "vector", "other")
    small = edge <= ICON_CONTEXT_EDGE
    declared = F.when(edge > 0, F.concat(F.lit(" · 声明 "), _pixels(edge))).otherwise("")
    size = F.coalesce(F.col("data_bytes"), F.lit(0))
    where = F.when(F.coalesce(F.col("zone_soft"), F.lit(False)), "（按命名推断）").otherwise("")
    outside = _verdict("region", F.concat(F.lit("位于"), kind_label(_text("zone_kind")), where, F.lit("，在主体内容区之外")))
    last = F.when((F.col("zone") == "noise") & ~soft_region_escape(), outside).otherwise(none) if options.main_only else none
    labels = F.create_map(*(F.lit(x) for t, (label, _) in TYPES.items() for x in (t, label)))
    always = [
        (path.rlike(PIXEL_NAME) | F.concat(host, path).rlike(TRACKING_HOST), _verdict("pixel", "占位图 / 统计打点")),
        (inline & (size > 0) & (size <= PIXEL_BYTES), _verdict("pixel", F.concat(F.lit("内联数据仅 "), size.cast("string"), F.lit(" 字节")))),
    ]
    tiny = inline & (size > 0) & (size <= INLINE_ICON_BYTES) & F.lower(F.col("data_mime")).rlike("svg|gif|bmp")
    mark = {f: F.coalesce(F.col(f"cdn.{f}"), F.lit(0)) > 0 for f in ("badge", "emoji", "avatar")}
    sort = F.when(mark["badge"], "徽章图片").when(mark["emoji"], "表情 / 国旗小图").otherwise("默认头像")
    tech = kind.isin(TECH_TYPES)
    rescued = (kind == "other") & (content_signal() != "")
    icons = [
        (tiny, _verdict("icon", F.concat(F.lit("内联小图（"), size.cast("string"), F.lit(" 字节）")))),
        (mark["badge"] | mark["emoji"] | mark["avatar"], _verdict("icon", sort)),
    ]
    technical = [(tech if options.include_tech else tech & rescued, last)]
    if not options.include_tech:
        technical.append((tech, _verdict(kind, labels[kind])))
    by_name = [
        (kind.isin(CHROME_TYPES), _verdict("icon", "类别为 UI 图标")),
        (visual & small & path.rlike(ICON_NAME), _verdict("icon", F.concat(F.lit("路径含图标关键字"), declared))),
        (visual & small & name.rlike(ICON_PHRASE), _verdict("icon", "文件名为界面装饰图")),
        (visual & small & path.rlike(ICON_DIR), _verdict("icon", F.concat(F.lit("图标目录"), declared))),
        (visual & (_text("selector") != "") & _text("selector").rlike(CHROME_SELECTOR), _verdict("icon", F.concat(F.lit("选择器 "), F.right(_text("selector"), F.lit(44))))),
        (visual & F.col("css_prop").isin(CHROME_PROPERTIES), _verdict("icon", F.concat(F.lit("CSS 属性 "), F.col("css_prop")))),
        (visual & F.col("sprite") & small, _verdict("icon", "雪碧图（background-position 偏移定位）")),
        (visual & (edge > 0) & (edge <= ICON_EDGE), _verdict("icon", F.concat(F.lit("声明尺寸 "), _pixels(edge)))),
    ]
    if options.include_icons:
        return _first(*always, *technical, (F.lit(True), last))
    return _first(*always, *icons, *technical, *by_name, (F.lit(True), last))


def post_filter(options: Options = Options()) -> Column:
    """The verdict on an item once its bytes are known."""
    kind = F.coalesce(F.col("type"), F.lit("other"))
    none = F.lit(None).cast("struct<reason:string,detail:string>")
    w, h = (F.coalesce(F.col(c), F.lit(0)) for c in ("width", "height"))
    edge, known = F.greatest(w, h), (w > 0) & (h > 0)
    real = F.concat(F.lit("真实尺寸 "), w.cast("string"), F.lit("×"), h.cast("string"))
    or_unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    rules: list[tuple[Column, Column]] = []
    if not options.include_tech:
        saved = (kind == "other") & F.col("mime").rlike("image|video|audio")
        rules += [(kind.isin(TECH_TYPES) & saved, none), (kind.isin(TECH_TYPES), _verdict(kind, "技术资源"))]
    if not options.include_icons:
        sizes = F.coalesce(F.array_join("sizes", " / "), F.concat(or_unknown("entries"), F.lit(" 项")))
        rules += [
            (kind.isin(CHROME_TYPES), _verdict("icon", "UI 图标")),
            (~kind.isin("image", "vector"), none),
            (known & (edge <= PIXEL_EDGE), _verdict("pixel", real)),
            (known & (edge <= ICON_EDGE), _verdict("icon", real)),
            (F.col("sprite"), _verdict("icon", F.concat(F.lit("SVG 精灵图（"), or_unknown("symbols"), F.lit(" 个 symbol）")))),
            (F.col("glyph_like"), _verdict("icon", F.concat(F.lit("图标字形（"), or_unknown("shapes"), F.lit(" 条路径 · viewBox "), or_unknown("view_box"), F.lit("）")))),
            (F.col("icon_set"), _verdict("icon", F.concat(F.lit("多尺寸图标集（"), sizes, F.lit("）")))),
            ((F.col("frames") >= SPRITE_FRAMES) & ((w == 0) | (edge <= SPRITE_EDGE)), _verdict("icon", F.concat(F.lit("逐帧动画精灵图（"), F.col("frames").cast("string"), F.lit(" 帧）")))),
            ((F.col("size") > 0) & (F.col("size") <= PIXEL_BYTES) & (w == 0) & (h == 0), _verdict("pixel", F.concat(F.lit("仅 "), F.col("size").cast("string"), F.lit(" 字节")))),
        ]
    return _first(*rules) if rules else none


def reason_label(reason: Column) -> Column:
    known = {**{t: label for t, (label, _) in TYPES.items()}, **REASON_LABELS}
    labels = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(labels[reason], reason, F.lit("其他"))


def judge(refs: DataFrame, options: Options = Options()) -> DataFrame:
    """``refs`` with verdict (null: kept) and rescued, the cue that saved an unclassified one."""
    full = _read_once(with_columns(refs, REF_COLUMNS))
    rescued = F.when((F.col("type") == "other") & F.lit(not options.include_tech) & F.col("verdict").isNull(), content_signal())
    own = [c for c in refs.columns if c not in ("verdict", "rescued")]
    return full.withColumn("verdict", pre_filter(options)).withColumn("rescued", F.coalesce(rescued, F.lit(""))).select(*own, "verdict", "rescued")


def filter_summary(filtered: DataFrame) -> DataFrame:
    """reason, label, n, bytes, probed of excluded entries (reason, size, status)."""
    probed = F.col("status").isNotNull() & ~F.col("status").isin("", "unresolved")
    found = filtered.groupBy(F.coalesce("reason", F.lit("other")).alias("reason")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(probed).alias("probed")
    )
    return found.select("reason", reason_label(F.col("reason")).alias("label"), "n", "bytes", "probed")


def trim_filtered(filtered: DataFrame, most: int = TRIM, order: str = "seq") -> DataFrame:
    """The first ``most`` entries of each reason in order of arrival."""
    place = F.row_number().over(Window.partitionBy(F.coalesce("reason", F.lit("other"))).orderBy(order))
    return filtered.withColumn("place", place).where(F.col("place") <= most).drop("place")


def dropped_by_trim(filtered: DataFrame, most: int = TRIM) -> DataFrame:
    """How many entries ``trim_filtered`` drops, in one row."""
    per_reason = filtered.groupBy(F.coalesce("reason", F.lit("other")).alias("reason")).count()
    return per_reason.agg(F.coalesce(F.sum(F.greatest(F.col("count") - most, F.lit(0))), F.lit(0)).alias("dropped"))
