"""The package's functions under names for SQL: scalar functions on values, table functions on documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagewright.functions import region, text
from pagewright.functions.types import ext_of_path, type_of_ext, type_of_mime
from pagewright.functions.urlmeta import META_SCHEMA, url_meta
from pagewright.functions.weburl import normalize, path_of
from pagewright.operators import html, probe
from pagewright.operators.css import css_references, parse_srcset
from pagewright.operators.export import disposition


def _of_bytes(read: Callable[[bytes], dict], fields: dict[str, str]) -> Callable[[bytes | None], dict | None]:
    def facts(body):
        if body is None:
            return None
        found = probe.total(read, bytes(body))
        return {k: found.get(k) for k in fields}

    return facts


def _or_null(f: Callable) -> Callable:
    return lambda *args: None if args[0] is None else f(*args)


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


_META = [f.split(":")[0] for f in META_SCHEMA[7:-1].split(",")]

#: Name in SQL, function, type of the result.
SCALARS: dict[str, tuple[Callable, str]] = {
    "pw_normalize_url": (_or_null(lambda raw, base: normalize(raw, base or "")), "string"),
    "pw_url_meta": (_or_null(lambda url: {k: url_meta(url).get(k) for k in _META}), META_SCHEMA),
    "pw_type_of_url": (_or_null(lambda url: type_of_ext(ext_of_path(path_of(url)))), "string"),
    "pw_type_of_mime": (_or_null(type_of_mime), "string"),
    "pw_clean_text": (_or_null(text.clean_text), "string"),
    "pw_count_chars": (_or_null(text.count_chars), "int"),
    "pw_count_words": (_or_null(text.count_words), "int"),
    "pw_region_kind": (_or_null(region.hint_kind), "string"),
    "pw_disposition": (_or_null(disposition), "string"),
    "pw_signature": (_of_bytes(probe.detect, probe.SIGNATURE_FIELDS), _struct(probe.SIGNATURE_FIELDS)),
    "pw_image_meta": (_of_bytes(lambda b: probe.image_facts(b, ""), probe.IMAGE_FIELDS), _struct(probe.IMAGE_FIELDS)),
    "pw_media_meta": (_of_bytes(lambda b: probe.media_facts(b), probe.MEDIA_FIELDS), _struct(probe.MEDIA_FIELDS)),
    "pw_font_meta": (_of_bytes(probe.font_facts, probe.FONT_FIELDS), _struct(probe.FONT_FIELDS)),
    "pw_pdf_meta": (_of_bytes(probe.pdf_facts, probe.PDF_FIELDS), _struct(probe.PDF_FIELDS)),
    "pw_office_meta": (_of_bytes(probe.office_facts, probe.OFFICE_FIELDS), _struct(probe.OFFICE_FIELDS)),
    "pw_playlist_meta": (_of_bytes(lambda b: probe.playlist_facts(b.decode("utf-8", "replace")), probe.PLAYLIST_FIELDS), _struct(probe.PLAYLIST_FIELDS)),
}


@udtf(returnType="url string, density double, width double")
class SrcsetRows:
    def eval(self, value: str) -> Iterator[tuple]:
        yield from parse_srcset(value or "")


@udtf(returnType="url string, kind string, prop string, selector string, hint string")
class CssRows:
    def eval(self, css: str, base: str) -> Iterator[tuple]:
        for r in css_references(css or ""):
            if url := normalize(r["raw"], base or ""):
                yield url, r["kind"], r["prop"], r["selector"], r["hint"]


@udtf(returnType="position int, url string, text string, asset boolean")
class LinkRows:
    def eval(self, page: str, url: str) -> Iterator[tuple]:
        for k, link in enumerate(html.read_page(page or "", url or "", ("links",))["links"], 1):
            yield k, link["url"], link["text"], link["asset"]


@udtf(returnType="tag string, level int, text string, zone string, zone_kind string")
class BlockRows:
    def eval(self, page: str, url: str) -> Iterator[tuple]:
        for b in html.read_page(page or "", url or "", ("blocks",))["blocks"]:
            yield b["tag"], b["level"], b["text"], b["zone"], b["zone_kind"]


TABLES = {"pw_srcset": SrcsetRows, "pw_css_refs": CssRows, "pw_page_links": LinkRows, "pw_page_blocks": BlockRows}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names. Nulls give nulls, or no rows."""
    from pyspark.sql import functions as F

    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return [*SCALARS, *TABLES]
