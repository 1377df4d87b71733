"""The type system of resources: extension and MIME type to one of 15 types, and asset families.

Every rule exists once as data. Column functions below are built from it and stay inside the JVM; the
plain functions serve the page parser.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types in display order, their labels, and whether they are interface chrome or technical.
TYPES = {
    "image": ("图片", ""), "vector": ("矢量图", ""), "video": ("视频", ""), "audio": ("音频", ""), "document": ("文档", ""),
    "sheet": ("表格", ""), "archive": ("压缩包", ""), "model": ("三维模型", ""), "icon": ("UI 图标", "chrome"), "font": ("字体", "tech"),
    "stylesheet": ("样式表", "tech"), "script": ("脚本", "tech"), "data": ("数据", "tech"), "page": ("页面", "tech"), "other": ("其他", "tech"),
}
CHROME_TYPES = [t for t, (_, kind) in TYPES.items() if kind == "chrome"]
TECH_TYPES = [t for t, (_, kind) in TYPES.items() if kind == "tech"]

#: The extensions of each type.
EXTENSIONS = {
    "image": "png jpg jpeg jpe jfif webp avif apng gif bmp dib tif tiff heic heif jp2 jpf jpx jpm tga pcx pict pct qoi jxl cr2 cr3 nef raw arw dng orf rw2",
    "vector": "svg svgz",
    "video": "mp4 m4v mov webm mkv avi flv wmv 3gp 3g2 ogv ts m2ts mts mpg mpeg mxf f4v divx m3u8 mpd",
    "audio": "mp3 wav wave ogg oga opus m4a m4b aac flac wma aiff aif aifc caf amr mid midi mod mka",
    "document": "pdf doc docx rtf odt pages key ppt pptx odp epub mobi azw azw3 fb2 djvu xps txt md markdown log",
    "sheet": "xls xlsx xlsm csv tsv ods numbers",
    "archive": "zip rar 7z tar gz tgz bz2 xz zst lz4 gz.1 dmg iso cbz cbr exe msi apk deb rpm",
    "model": "gltf glb usdz usd usda obj stl fbx ply dae 3mf abc skp",
    "font": "woff woff2 ttf otf eot pfb fnt",
    "stylesheet": "css scss less",
    "script": "js mjs cjs jsx tsx wasm map",
    "data": "json jsonld ndjson xml yaml yml toml webmanifest manifest vtt srt ass ics vcf proto onnx pt safetensors",
    "page": "html htm xhtml php asp aspx jsp",
    "icon": "ico cur icns",
}
TYPE_OF_EXT = {ext: kind for kind, exts in EXTENSIONS.items() for ext in exts.split()}

#: Ordered MIME patterns; the first that is found decides.
MIME_RULES = (
    ("vector", r"^image/svg"),
    ("image", r"^image/"),
    ("video", r"^video/"),
    ("audio", r"^audio/"),
    ("font", r"^font/"),
    ("font", r"application/(x-)?font(icc)?$"),
    ("stylesheet", r"text/css"),
    ("script", r"javascript|ecmascript"),
    ("data", r"application/json|jsonl|xml|yaml"),
    ("document", r"application/pdf"),
    ("document", r"application/msword|officedocument\.word|rtf|epub\+zip|vnd\.oasis\.opendocument\.text|powerpoint"),
    ("sheet", r"excel|spreadsheet|vnd\.oasis\.opendocument\.spreadsheet"),
    ("archive", r"application/(x-)?(zip|rar|x-7z-compressed|tar|x-gtar|x-bzip2|x-x509-ca-cert|vnd\.android\.package-archive|x-iso9660-image)"),
    ("model", r"model/|vnd\.model\.|/(gltf|glb|usdz|vrml|x-directx)$|x-extented3d"),
    ("icon", r"(x-)?(win-)?icon|vnd\.microsoft\.icon"),
    ("font", r"/(x-)?(woff2?|ttf|otf|opentype|fontcollect|font-sfnt|font-woff)"),
    ("script", r"/x-shader|/(javascript|ecmascript)|x-typescript"),
    ("data", r"manifest\+json|/xml|/json|x-ndjson|yaml"),
    ("page", r"text/html"),
    ("document", r"^text/"),
)

#: The MIME type of an extension.
MIME_OF_EXT = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "avif": "image/avif", "apng": "image/apng", "svg": "image/svg+xml", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "ico": "image/vnd.microsoft.icon", "heic": "image/heic", "mp4": "video/mp4", "m4v": "video/x-m4v", "mov": "video/quicktime",
    "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "ogv": "video/ogg", "ts": "video/mp2t",
    "m3u8": "application/vnd.apple.mpegurl", "mpd": "application/dash+xml", "flv": "video/x-flv", "wmv": "video/x-ms-wmv",
    "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "oga": "audio/ogg", "m4a": "audio/mp4", "aac": "audio/aac",
    "flac": "audio/flac", "opus": "audio/opus", "aiff": "audio/aiff", "mid": "audio/midi", "pdf": "application/pdf",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "xml": "application/xml", "yaml": "text/yaml", "yml": "text/yaml", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript",
    "cjs": "text/javascript", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf",
    "eot": "application/vnd.ms-fontobject", "zip": "application/zip", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed",
    "tar": "application/x-tar", "gz": "application/gzip", "tgz": "application/gzip", "epub": "application/epub+zip", "html": "text/html",
    "htm": "text/html", "jp2": "image/jp2", "tga": "image/x-tga", "qoi": "image/qoi", "jxl": "image/jxl", "svgz": "image/svg+xml",
    "icns": "image/x-icns", "cur": "image/x-icon", "m4b": "audio/mp4", "caf": "audio/x-caf", "mka": "audio/x-matroska", "mod": "audio/mod",
    "mts": "video/mp2t", "m2ts": "video/mp2t", "mxf": "application/mxf", "f4v": "video/x-f4v", "gltf": "model/gltf+json",
    "glb": "model/gltf-binary", "usdz": "model/vnd.usdz+zip", "obj": "model/obj", "stl": "model/stl", "fbx": "application/octet-stream",
    "ply": "application/vnd.ply", "dae": "model/vnd.collada+xml", "vtt": "text/vtt", "srt": "application/x-subrip", "ics": "text/calendar",
    "vcf": "text/vcard", "webmanifest": "application/manifest+json", "zst": "application/zstd", "cbz": "application/vnd.comicbook+zip",
    "djvu": "image/vnd.djvu", "xps": "application/vnd.ms-xpsdocument", "wasm": "application/wasm",
    "exe": "application/vnd.microsoft.portable-executable", "apk": "application/vnd.android.package-archive",
}
#: The MIME type that stands for a whole type.
MIME_OF_TYPE = {
    "image": "image/png", "vector": "image/svg+xml", "video": "video/mp4", "audio": "audio/mpeg", "document": "application/octet-stream",
    "sheet": "text/csv", "archive": "application/zip", "model": "model/gltf+json", "icon": "image/x-icon", "font": "font/woff2",
    "stylesheet": "text/css", "script": "text/javascript", "data": "application/json", "page": "text/html", "other": "application/octet-stream",
}
#: What makes two file names one family, and query parameters that only size an asset.
FAMILY_MARKS = (
    r"@[0-9]+x(?=\.)",
    r"[-_.][0-9]{2,4}x[0-9]{2,4}(?=\.)",
    r"[-_.](?:thumb|thumbs|tny|small|medium|large|big|full|orig|original|res|sq|square|max|min|preview|cover|card|list|grid)(?=\.)",
    r"[-_.][0-9]{2,4}(?=\.)",
)
FAMILY_PARAMS = "w h width height size resize crop dpr density format fm q quality th thumb version v s tex scale".split()

_EXT_RE = re.compile(r"[A-Za-z0-9]{1,7}")
_MIMES = [(kind, re.compile(pattern, re.I)) for kind, pattern in MIME_RULES]
_MEDIA_CONTEXT = r"(?i)(^|[\s,>])<(video|audio|source|track|iframe)[\s/]"
_STYLE_CONTEXT = r"(?i)(^|[\s,>])<link[^>]+stylesheet"
_SCRIPT_CONTEXT = r"(?i)(^|[\s,>])<script"


# ------------------------------------------------------------------ plain functions


def ext_of_path(path: str) -> str:
    """The lower-cased extension: after the last dot of the last segment, not its first character, 1 to 7 letters or digits."""
    base = path.rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return ext.lower() if dot and stem and _EXT_RE.fullmatch(ext) else ""


def type_of_ext(ext: str | None) -> str | None:
    return TYPE_OF_EXT.get(ext.lower().removeprefix(".")) if ext else None


def type_of_mime(mime: str | None) -> str | None:
    if not mime:
        return None
    clean = mime.split(";")[0].strip().lower()
    return next((kind for kind, pattern in _MIMES if pattern.search(clean)), None)


def classify(mime: str, ext: str, context: str, hint: str | None) -> str:
    """One type from all evidence: a hint first, then audio and video, then extension over MIME, then the context."""
    by_mime, by_ext = type_of_mime(mime), type_of_ext(ext)
    if hint in TYPES:
        if by_ext == "vector" and hint == "image":
            return "vector"
        return "icon" if by_ext == "icon" else hint
    for found in (by_ext, by_mime):
        if found in ("video", "audio"):
            return found
    if re.search(_MEDIA_CONTEXT, context) and "image" in (by_ext, by_mime):
        return "video"
    if by_ext or by_mime:
        return by_ext or by_mime
    if re.search(_STYLE_CONTEXT, context):
        return "stylesheet"
    return "script" if re.search(_SCRIPT_CONTEXT, context) else "other"


def ext_of_mime(mime: str | None) -> str:
    """A fitting extension for a MIME type, or empty."""
    if not mime:
        return ""
    clean = mime.split(";")[0].strip().lower()
    fixed = {"text/plain": "txt", "text/markdown": "md"}
    if clean in fixed:
        return fixed[clean]
    for ext, known in MIME_OF_EXT.items():
        if known == clean:
            return ext
    m = re.match(r"[a-z0-9.+-]+", clean.partition("/")[2])
    if not m:
        return ""
    ext = re.sub(r"^vnd[.-].*", "", re.sub(r"^x-", "", m[0]))
    ext = {"x-icon": "ico", "javascript": "js", "quicktime": "mov", "matroska": "webm"}.get(ext, ext)
    return "" if ext == "octet-stream" or len(ext) > 6 else ext


# ------------------------------------------------------------------ columns


def ext_col(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+\.([A-Za-z0-9]{1,7})$", 1))


def type_of_ext_col(ext: Column) -> Column:
    """A chain of hash set tests, one per type."""
    low = F.regexp_replace(F.lower(ext), r"^\.", "")
    out = F.lit(None).cast("string")
    for kind, exts in reversed(EXTENSIONS.items()):
        out = F.when(low.isin(exts.split()), kind).otherwise(out)
    return out


def type_of_mime_col(mime: Column) -> Column:
    clean = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(MIME_RULES):
        out = F.when(clean.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def classify_col(mime: Column, ext: Column, context: Column, hint: Column) -> Column:
    return classified(type_of_mime_col(mime), type_of_ext_col(ext), context, hint)


def classified(by_mime: Column, by_ext: Column, context: Column, hint: Column) -> Column:
    """The type from evidence that is at hand as columns, so that each chain of tests is compiled once."""
    context = F.coalesce(context, F.lit(""))
    hinted = F.when((by_ext == "vector") & (hint == "image"), "vector").when(by_ext == "icon", "icon").otherwise(hint)
    moving = ["video", "audio"]
    image = F.coalesce(by_ext == "image", F.lit(False)) | F.coalesce(by_mime == "image", F.lit(False))
    return (
        F.when(hint.isin(list(TYPES)), hinted)
        .when(by_ext.isin(moving), by_ext)
        .when(by_mime.isin(moving), by_mime)
        .when(context.rlike(_MEDIA_CONTEXT) & image, "video")
        .when(by_ext.isNotNull(), by_ext)
        .when(by_mime.isNotNull(), by_mime)
        .when(context.rlike(_STYLE_CONTEXT), "stylesheet")
        .when(context.rlike(_SCRIPT_CONTEXT), "script")
        .otherwise("other")
    )


def with_type(df: DataFrame, mime: Column, ext: Column, context: Column, hint: Column) -> DataFrame:
    """``df`` with ``type``; the tests of MIME type and extension run once a row."""
    seen = {"_by_mime": type_of_mime_col(mime), "_by_ext": type_of_ext_col(ext)}
    return df.withColumns(seen).withColumn("type", classified(F.col("_by_mime"), F.col("_by_ext"), context, hint)).drop(*seen)


def mime_col(kind: Column, ext: Column) -> Column:
    """The MIME type of an extension, else of the type, else octet-stream."""
    by_ext = F.create_map(*(F.lit(x) for pair in MIME_OF_EXT.items() for x in pair))
    by_type = F.create_map(*(F.lit(x) for pair in MIME_OF_TYPE.items() for x in pair))
    return F.coalesce(by_ext[F.regexp_replace(F.lower(ext), r"^\.", "")], by_type[kind], F.lit("application/octet-stream"))


def asset_family(url: Column) -> Column:
    """The family of a normalised URL: host, path without size marks, and the sorted other parameters."""
    host = F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    path = F.lower(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))
    for mark in FAMILY_MARKS:
        path = F.regexp_replace(path, mark, "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(FAMILY_PARAMS))
    pairs = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    kept = F.array_join(F.array_sort(pairs), "&")
    return F.when(
        url.rlike("^https?://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    ).otherwise(F.coalesce(url, F.lit("")))


def previewable(kind: Column, mime: Column) -> Column:
    """Whether a browser can show the resource itself."""
    textual = F.coalesce(mime, F.lit("")).rlike("(?i)text|json|xml|yaml|csv|javascript|css|markdown|plain")
    return kind.isin("image", "vector", "video", "audio") | (kind.isin("stylesheet", "script", "data", "document") & textual)


def type_dimension(spark: SparkSession) -> DataFrame:
    """One row per type: type, label, is_chrome, is_tech, position."""
    rows = [(t, label, kind == "chrome", kind == "tech", k) for k, (t, (label, kind)) in enumerate(TYPES.items())]
    return spark.createDataFrame(rows, "type string, label string, is_chrome boolean, is_tech boolean, position int")


def ext_dimension(spark: SparkSession) -> DataFrame:
    """One row per known extension, for broadcast lookups; its size is fixed."""
    return spark.createDataFrame(list(TYPE_OF_EXT.items()), "ext string, type string")
