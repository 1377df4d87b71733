"""Golden values of URLs, text, types and regions, and native expressions against their plain twins."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import region, text, types
from pagewright.functions.urlmeta import compact, url_meta, url_meta_col
from pagewright.functions.weburl import file_name, normalize, parse

BASE = "http://127.0.0.1:4620/samples/lab"


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("../a.png", "http://127.0.0.1:4620/a.png"), ("assets/x.png", "http://127.0.0.1:4620/samples/assets/x.png"), ("//cdn.x.com/a.png", "http://cdn.x.com/a.png"),
        ("javascript:void(0)", None), ("mailto:a@b.c", None), ("data:text/plain,x", None), ("a.png#frag", "http://127.0.0.1:4620/samples/a.png"), ("/für", "http://127.0.0.1:4620/f%C3%BCr"),
        ("\\x\\y", "http://127.0.0.1:4620/x/y"), ("?q=é", "http://127.0.0.1:4620/samples/lab?q=%C3%A9"), ("http://EX.com:80/a/../b/./c", "http://ex.com/b/c"), ("HTTPS://ex.com", "https://ex.com/"),
        ("http://ex.com/%zz|{}", "http://ex.com/%zz|%7B%7D"), (" 'x.png' ", "http://127.0.0.1:4620/samples/x.png"), ("ftp://x/y", None), ("http://a b/", None), ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://[::1]:8080/", "http://[::1]:8080/"), ("http:x", "http://127.0.0.1:4620/samples/x"), ("https:x.com/y", "https://x.com/y"), ("http://u:p@h/", "http://u:p@h/"), ("", None), ("http://h:99999/", None),
        ("a\tb\n", "http://127.0.0.1:4620/samples/ab"), ("http://h?x", "http://h/?x"), ("/a/%2e%2e/b", "http://127.0.0.1:4620/b"),
    ],
)
def test_normalize(raw, expected):
    assert normalize(raw, BASE) == expected


def test_file_names():
    assert file_name("http://x/a/b%20c.png?y") == "b c.png"
    assert file_name("http://x/?file=dir/q.pdf") == "q.pdf"
    assert file_name("http://x/") == "" and file_name("nonsense") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_normalizing_is_idempotent(raw):
    once = normalize(raw, BASE)
    assert once is None or normalize(once) == once
    assert once is None or parse(once) is not None


URLS = {
    "https://images.unsplash.com/photo-1?w=1600&q=80": {"width": 1600, "square": 1, "edge": 1600},
    "https://lh3.googleusercontent.com/x=s2000-c": {"width": 2000},
    "https://res.cloudinary.com/d/image/upload/w_800,h_600/x.jpg": {"width": 800, "height": 600},
    "https://cdn.example.com/a.jpg?x-oss-process=image/resize,w_900": {"width": 900},
    "https://cbu01.alicdn.com/img/x.jpg_400x400q90.jpg": {"width": 400},
    "https://example.com/cdn-cgi/image/width=1200/https://o.com/a.jpg": {"width": 1200},
    "https://p.com/x.jpg@900w_1e_1c": {"width": 900},
    "https://live.staticflickr.com/1/ab_cd_b.jpg": {"width": 1024},
    "https://i.ytimg.com/vi/abc/maxresdefault.jpg": {"width": 1280},
    "https://pbs.twimg.com/media/X.jpg:large": {"width": 1200},
    "https://upload.wikimedia.org/a/800px-B.png": {"width": 800},
    "https://cdn.shopify.com/x.jpg?v=1&width=1400": {"width": 1400},
    "https://cdn.shopify.com/s/files/1/2/x.jpg?v=1": {"width": None},
    "https://www.gravatar.com/avatar/x?s=80&d=mm": {"avatar": 1},
    "https://img.shields.io/badge/x.svg": {"badge": 1, "width": 120, "height": 20},
    "https://x.com/hero-1920x1080.jpg": {"width": 1920, "height": 1080},
    "https://x.com/p@2x.png": {"dpr": 2.0},
    "https://x.com/icon-24x24.svg": {"width": 24},
    "https://a.com/_next/image?url=%2Fhero%2Fphoto.jpg&w=1200": {"inner": "https://a.com/hero/photo.jpg", "width": 1200},
    "https://images.weserv.nl/?url=real.site.com/a.png": {"inner": "https://real.site.com/a.png"},
    "https://i0.wp.com/real.site.com/up/a.jpg": {"inner": "https://real.site.com/up/a.jpg"},
    "https://placehold.co/600x400": {"width": 600, "height": 400},
    "https://x.com/a/w/640/h/360/x.png": {"width": 640},
}


@pytest.mark.parametrize("url", URLS)
def test_url_meta(url):
    found = url_meta(url)
    assert {k: found.get(k) for k in URLS[url]} == URLS[url]
    assert compact(found) is None or all(compact(found).values())


def test_url_meta_column(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None, "no url"]], "url string")
    for r in df.select("url", url_meta_col(F.col("url")).alias("m")).collect():
        found = url_meta(r["url"])
        assert {k: v for k, v in (r["m"].asDict() if r["m"] else {}).items() if v} == {k: v for k, v in found.items() if v}


TEXTS = ["", "  a b  ", "Tom &amp; Jerry&#39;s &#x41; &copy=2 &frac12; &nope;", "日本 words-and 12 a", "x﻿　y", "&#38;lt;", "plain"]


def test_clean_text():
    assert text.clean_text(TEXTS[1]) == "a b"
    assert text.clean_text(TEXTS[2]) == "Tom & Jerry's A ©=2 &frac12; &nope;"
    assert text.clean_text("&#38;lt;") == "<"
    assert text.count_words("日本 words-and 12 a") == 4 and text.count_chars(" 日 a ") == 2
    assert text.units("🙂a") == 3


def test_native_text_equals_plain(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    c = F.col("t")
    rows = df.select("t", text.clean_text_col(c).alias("clean"), text.count_chars_col(c).alias("chars"), text.count_words_col(c).alias("words"), text.utf16_length(c).alias("units")).collect()
    for r in rows:
        assert (r["clean"], r["chars"], r["words"], r["units"]) == (text.clean_text(r["t"]), text.count_chars(r["t"]), text.count_words(r["t"]), text.units(r["t"]))


def test_keywords():
    assert text.top_keywords("alpha alpha beta. beta beta alphabet alphabet alphabet the the the") == [("alphabet", 3), ("beta", 3)]
    assert text.top_keywords("机器学习 机器学习")[0] == ("机器学习", 4)


def test_formats(spark):
    sizes = [None, 0, 512, 1536, 24_900_000, 124_000_000, 3 << 30]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(text.format_bytes(F.col("n"))).collect()] == ["未知", "0B", "512B", "1.50KB", "23.7MB", "118MB", "3.00GB"]
    names = spark.createDataFrame([("a/b:c",), ("x" * 100,), (None,)], "s string")
    assert [r[0] for r in names.select(text.clip(F.col("s"))).collect()] == ["a_b_c", "x" * 80 + "…xxx", "unnamed"]
    assert [r[0] for r in spark.createDataFrame([(65.2,), (3725.0,), (None,)], "d double").select(text.format_seconds(F.col("d"))).collect()] == ["1:05", "1:02:05", ""]


CLASSES = [
    ("", "webp", "", None, "image"), ("", "m4a", "<video x", None, "audio"), ("application/octet-stream", "woff2", "", None, "font"), ("", "svg", "<img ", "image", "vector"), ("image/png", "", "", None, "image"),
    ("", "ico", "", "image", "icon"), ("", "png", " <source x", None, "video"), ("text/html", "zzz", "", None, "page"), ("", "", " <link rel=stylesheet", None, "stylesheet"), ("", "", " <script ", None, "script"),
    ("", "", "", None, "other"), ("text/css", "pdf", "", None, "document"), ("", "png", "", "video", "video"),
]


def test_classify(spark):
    df = spark.createDataFrame(CLASSES, "mime string, ext string, context string, hint string, expected string")
    rows = df.select("*", types.classify_col(*(F.col(c) for c in ("mime", "ext", "context", "hint"))).alias("found")).collect()
    for r in rows:
        assert r["found"] == r["expected"] == types.classify(r["mime"], r["ext"], r["context"], r["hint"])


def test_extensions_and_families(spark):
    assert types.ext_of_path("/a/b.tar.gz") == "gz" and types.ext_of_path("/.htaccess") == "" and types.ext_of_path("/x.webmanifest") == "" and types.ext_of_path("/a.b/c") == ""
    urls = ["https://x.com/aurora-1920x1080.png", "https://x.com/aurora@2x.png?w=3", "https://x.com/aurora-thumb.png", "https://x.com/aurora.png?q=1&b=2&a=1", "nope", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(types.asset_family(F.col("u"))).collect()] == ["x.com/aurora.png"] * 3 + ["x.com/aurora.png?a=1&b=2", "nope", ""]
    paths = ["/a/b.PNG", "/x", "/a.b/c", "/.x", "a.jpeg"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(types.ext_col(F.col("p"))).collect()] == [types.ext_of_path(p) for p in paths]


CHAINS = [
    ([("body", "", ""), ("nav", "", "")], ("noise", "nav", False)), ([("main", "", ""), ("nav", "", "")], ("noise", "nav", False)), ([("article", "", ""), ("header", "", "")], ("main", "", False)),
    ([("main", "", ""), ("footer", "", "")], ("noise", "footer", False)), ([("div", "", "site-footer")], ("noise", "footer", True)), ([("div", "", "card-footer")], ("content", "", False)),
    ([("div", "", "main-content"), ("div", "", "promo")], ("main", "", False)), ([("div", "search", "")], ("noise", "form", False)), ([("div", "", "globalnav")], ("noise", "nav", True)),
    ([("footer", "", ""), ("div", "", "content")], ("noise", "footer", False)), ([("section", "", ""), ("header", "", "")], ("content", "", False)), ([("nav", "", ""), ("main", "", "")], ("main", "", False)),
    ([("div", "", "hero")], ("content", "", False)), ([("div", "main", "")], ("main", "", False)), ([("form", "", "")], ("content", "", False)), ([("div", "dialog", "x")], ("noise", "widget", False)),
]


def test_regions_plain_and_native(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CHAINS)], "k int, chain array<struct<tag:string,role:string,hint:string>>")
    native = {r["k"]: r for r in df.select("k", region.fold_col(F.col("chain")).alias("s")).select("k", "s.*").collect()}
    for k, (chain, expected) in enumerate(CHAINS):
        state = region.ROOT
        for tag, role, hint in chain:
            state = region.step(state, tag, role, hint)
        assert region.region_of(state) == expected
        assert (native[k]["zone"], native[k]["kind"], native[k]["section"], native[k]["core"], native[k]["soft"]) == tuple(state)


def test_hint_kinds_plain_and_native(spark):
    hints = ["", "navbar", "sitefooter x", "toolbars", "entry-header", "login-form", "cookie-banner", "localnav", "hero", "mainmenu big", "post-list", "article__meta", "rail", "headbar2"]
    df = spark.createDataFrame([(h,) for h in hints], "h string")
    assert [r[0] for r in df.select(region.hint_kind_col(F.col("h"))).collect()] == [region.hint_kind(h) for h in hints]


def test_zone_merging(spark):
    rows = [
        (1, [("noise", "nav", False), ("main", "", False), ("noise", "footer", True)]), (2, [("noise", "nav", False), ("noise", "footer", True)]), (3, [("noise", "nav", True), ("noise", "nav", False)]),
        (4, [("content", "", False), ("main", "", False)]), (5, [("main", "", False), ("noise", "aside", True), ("noise", "aside", False)]),
    ]
    df = spark.createDataFrame(rows, "k int, p array<struct<zone:string,kind:string,soft:boolean>>")
    found = {r["k"]: (r["zone"], r["kind"], r["soft"], r["kinds"], r["also"]) for r in df.select("k", region.merge_zones(F.col("p")).alias("z")).select("k", "z.*").collect()}
    assert found == {
        1: ("main", "", False, ["nav"], ["footer"]), 2: ("noise", "footer", True, ["nav", "footer"], []), 3: ("noise", "nav", False, ["nav"], []), 4: ("main", "", False, [], []),
        5: ("main", "", False, [], ["aside", "aside"]),
    }
    labels = spark.createDataFrame([(["nav", "footer", "nav"],), ([],)], "k array<string>").select(region.kinds_label(F.col("k")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["导航菜单 / 页脚", "界面框架区域"]
