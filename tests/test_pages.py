"""The page reader, style sheets, policy and merging on small pages."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import policy
from pagewright.operators import html, refs
from pagewright.operators.css import css_references, parse_data_uri, parse_srcset
from pagewright.plans.scan import ScanOptions, probed_items, reprobe, scan

URL = "https://site.example/dir/page.html"
PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title> A &amp; B </title><meta name=description content="About">
<meta property="og:image" content="/og.jpg"><link rel="icon" href="/f.ico"><link rel="stylesheet" href="s.css"><link rel=canonical href="/c">
<style>.hero{background:url(bg.png)} .x{cursor:url('c.cur')} @import "more.css"; /* url(no.png) */ .s{background:image-set("a.png" 1x, url(b.png) 2x)}</style>
<script>var t = "</p>"; load({"poster": "media\\/clip.mp4", "list": ["one.jpg", "two.txt"]}); var src = 'pic/three.png';</script></head>
<body><nav><ul><li><a href="/home">Home</a><li><a href="/file.pdf">File</a></ul></nav>
<main><h1>Head <b>line</b></h1><p>First<p>Second &copy; <img src=p.png srcset="p.png 1x, p2.png 2x" alt="pic"><img data-src="lazy.webp" style="width:24px">
<div class="ad">short</div><div>this container has more than fifty-six characters of plain text in it</div><noscript><img src="/ns.jpg"></noscript>
<a href="doc.zip" download="d.zip">get</a><video poster="poster.jpg"><source src="v.mp4" type="video/mp4"></video></main>
<footer><img src="logo.svg">https://site.example/loose/file.csv</footer></body></html>"""


@pytest.fixture(scope="module")
def page():
    return html.read_page(PAGE, URL)


def test_facts(page):
    doc = page["doc"]
    assert (doc["title"], doc["lang"], doc["charset"], doc["description"]) == ("A & B", "en", "utf-8", "About")
    assert (doc["og_image"], doc["favicon"], doc["canonical"]) == ("/og.jpg", "https://site.example/f.ico", "https://site.example/c")


def test_blocks(page):
    found = [(b["tag"], b["text"], b["zone"], b["zone_kind"]) for b in page["blocks"]]
    assert ("li", "Home", "noise", "nav") in found and ("li", "File", "noise", "nav") in found
    assert ("h1", "Head line", "main", "") in found and ("p", "First", "main", "") in found
    assert any(t == "div" and x.startswith("this container") for t, x, _, _ in found)
    assert not any(x == "short" for _, x, _, _ in found)
    assert [b["block_id"] for b in page["blocks"]] == [f"t{k + 1}" for k in range(len(page["blocks"]))]


def test_links_and_references(page):
    assert [x["url"] for x in page["links"]] == ["https://site.example/home", "https://site.example/file.pdf", "https://site.example/dir/doc.zip"]
    by_url = {}
    for r in page["refs"]:
        by_url.setdefault(r["url"].removeprefix("https://site.example/"), []).append(r)
    assert by_url["dir/p2.png"][0]["density"] == 2.0 and by_url["dir/p.png"][0]["alt"] == "pic"
    assert by_url["dir/lazy.webp"][0]["width_hint"] == "24" and by_url["dir/lazy.webp"][0]["zone"] == "main"
    assert by_url["ns.jpg"][0]["attr"] == "noscript:src"
    assert by_url["dir/bg.png"][0]["css_prop"] == "background" and by_url["dir/c.cur"][0]["hint"] == "icon"
    assert by_url["dir/more.css"][0]["attr"] == "@import" and "dir/no.png" not in by_url
    assert by_url["dir/media/clip.mp4"][0]["provenance"] in ("inferred", "json") and {"dir/one.jpg", "dir/pic/three.png"} <= set(by_url)
    assert by_url["dir/doc.zip"][0]["attr"] == "a[download]" and by_url["dir/v.mp4"][0]["hint"] == "video"
    assert by_url["dir/logo.svg"][0]["zone_kind"] == "footer" and "loose/file.csv" in by_url
    assert by_url["dir/a.png"][0]["image_set"] and by_url["og.jpg"][0]["meta_key"] == "og:image"


def test_broken_markup():
    assert html.read_page("", URL)["blocks"] == []
    assert [b["text"] for b in html.read_page("<p>a < 1 > b<p>c", URL)["blocks"]] == ["a b", "c"]
    assert html.read_page("<div " * 3000, URL)["tokens"] >= 0
    deep = html.read_page("<b>" * 400 + "<p>x", URL)
    assert [b["text"] for b in deep["blocks"]] == ["x"]
    assert html.read_page('<p title="unclosed>text', URL)["blocks"] == []


def test_css_and_srcset():
    assert [(c["raw"], c["kind"]) for c in css_references('@font-face{src:url(f.woff2) format("woff2")}')] == [("f.woff2", "url")]
    assert next(iter(css_references('@font-face{src:url(f.woff2) format("woff2")}')))["font_format"] == "woff2"
    assert parse_srcset("a.png 1x, b.png 2x, c.png 300w") == [("a.png", 1.0, 0.0), ("b.png", 2.0, 0.0), ("c.png", 0.0, 300.0)]
    assert parse_srcset("x.jpg?a=1,2 2x,data:image/png;base64,AAAABBBB 1x") == [("x.jpg?a=1,2", 2.0, 0.0), ("data:image/png;base64,AAAABBBB", 1.0, 0.0)]
    assert parse_data_uri("data:image/png;base64,AAAABBBBCCCC") == {"mime": "image/png", "base64": True, "data": "AAAABBBBCCCC", "bytes": 9}
    assert parse_data_uri("data:,x") is None
    assert [p for p in html.json_parts('x {"a": [1, 2, "}"]} y [1] z {"b": {"c": 123456}}')] == ['{"a": [1, 2, "}"]}', '{"b": {"c": 123456}}']


REF = {"url": "https://x.com/a/photo.jpg", "type": "image", "tag": "img", "attr": "src", "provenance": "attr", "zone": "content", "zone_kind": "", "zone_soft": False}
VERDICTS = [
    ({}, None), ({"type": "font"}, "font"), ({"type": "icon"}, "icon"), ({"url": "https://x.com/spacer.gif"}, "pixel"), ({"url": "https://www.google-analytics.com/x"}, "pixel"),
    ({"url": "https://x.com/icons/a.png"}, "icon"), ({"url": "https://x.com/icons/a.png", "width_hint": "1600"}, None), ({"width_hint": "24"}, "icon"), ({"width_hint": "65"}, None),
    ({"selector": ".toolbar a"}, "icon"), ({"css_prop": "mask-image"}, "icon"), ({"css_prop": "list-style"}, None), ({"sprite": True}, "icon"), ({"sprite": True, "declared_width": 1200.0}, None),
    ({"zone": "noise", "zone_kind": "nav"}, "region"), ({"zone": "noise", "zone_soft": True, "attr": "a[download]"}, None), ({"zone": "noise", "zone_soft": True, "tag": "video"}, None),
    ({"zone": "noise", "zone_soft": False, "tag": "video"}, "region"), ({"type": "other", "tag": "x", "attr": "y", "url": "https://x.com/zz", "provenance": "attr"}, "other"),
    ({"type": "other", "tag": "img", "url": "https://x.com/zz"}, None), ({"url": None, "data_mime": "image/gif", "data_bytes": 43}, "pixel"), ({"url": None, "data_mime": "image/svg+xml", "data_bytes": 900}, "icon"),
    ({"url": None, "data_mime": "image/png", "data_bytes": 90000}, None), ({"cdn": (120, 20, None, None, None, None, None, None, None, 1, None, None)}, "icon"), ({"url": "https://x.com/btn-bg.png"}, "icon"),
]


def test_verdicts(spark):
    schema = ", ".join(f"{c} {k}" for c, k in policy.REF_COLUMNS.items())
    rows = [tuple((REF | change).get(c) for c in policy.REF_COLUMNS) for change, _ in VERDICTS]
    df = spark.createDataFrame(rows, schema).withColumn("k", F.monotonically_increasing_id())
    found = [r["verdict"]["reason"] if r["verdict"] else None for r in policy.judge(df).orderBy("k").collect()]
    assert found == [v for _, v in VERDICTS]
    every = policy.Options(include_icons=True, include_tech=True, main_only=False)
    kept = [r["verdict"] for r in policy.judge(df, every).orderBy("k").collect()]
    assert [k for k, v in enumerate(kept) if v] == [3, 4, 20]


def test_second_verdicts(spark):
    rows = [("image", 2, 2, 100, None), ("image", 64, 64, 4000, None), ("image", 65, 10, 4000, None), ("image", None, None, 300, None), ("image", 200, 200, 9000, 12), ("image", 300, 200, 9000, 12), ("video", 1, 1, 10, None), ("font", None, None, 10, None)]
    df = policy.with_columns(spark.createDataFrame(rows, "type string, width int, height int, size long, frames int"), policy.ITEM_COLUMNS)
    found = [r[0]["reason"] if r[0] else None for r in df.select(policy.post_filter()).collect()]
    assert found == ["pixel", "icon", None, "pixel", "icon", None, None, "font"]


def test_merging(spark):
    base = {"page_id": 1, "tag": "", "attr": "", "zone": "content", "zone_kind": "", "zone_soft": False}
    rows = [
        {"seq": 0, "url": "https://x/a.png", "provenance": "inferred", "hint": "image", "tag": "inferred", "attr": "document"},
        {"seq": 1, "url": "https://x/a.png", "provenance": "css", "selector": ".h", "tag": "style", "attr": "css:url", "zone": "noise", "zone_kind": "nav"},
        {"seq": 2, "url": "https://x/a.png", "provenance": "attr", "tag": "img", "attr": "src", "alt": "first", "zone": "main"},
        {"seq": 3, "url": "https://x/a.png", "provenance": "attr", "tag": "source", "attr": "srcset", "alt": "second", "sprite": True},
        {"seq": 4, "url": "https://x/i.ico", "provenance": "css", "hint": "icon", "tag": "style"}, {"seq": 5, "url": "https://x/i.ico", "provenance": "attr", "hint": "image", "tag": "img"},
        {"seq": 6, "url": None, "data_mime": "image/png", "data": "A" * 300, "provenance": "datauri"}, {"seq": 7, "url": None, "data_mime": "image/png", "data": "A" * 250, "provenance": "datauri"},
    ]
    schema = "page_id long, " + ", ".join(f"{k} {v}" for k, v in html.REF_FIELDS.items())
    names = ["page_id", *html.REF_FIELDS]
    df = spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schema)
    found = {r["seq"]: r for r in refs.numbered(refs.merge_references(df)).collect()}
    a = found[0]
    assert (a["count"], a["provenance"], a["tag"], a["attr"], a["alt"], a["selector"], a["sprite"]) == (4, "attr", "img", "src", "first", ".h", True)
    assert (a["zone"], a["zone_kind"], a["type"]) == ("main", "", "image")
    assert (found[4]["type"], found[4]["count"]) == ("image", 2)
    assert found[6]["count"] == 2 and found[6]["ext"] == "png"
    assert sorted(r["idx"] for r in found.values()) == [1, 2, 3]


def test_a_scan_from_page_to_items(spark, tmp_path):
    pages = spark.createDataFrame([(1, URL, PAGE), (2, "https://e.example/", None)], "page_id long, url string, html string")
    sheets = spark.createDataFrame([(1, "https://site.example/dir/s.css", ".a{background:url(deep.png)}")], "page_id long, url string, css string")
    result = scan(pages, ScanOptions(max_resources=1), sheets, str(tmp_path))
    assert {r["page_id"] for r in result.docs.collect()} == {1, 2}
    reasons = {r["reason"]: r["n"] for r in result.filter_summary().collect()}
    assert reasons.get("stylesheet", 0) >= 1 and "icon" in reasons and "region" in reasons
    kept = {r["url"].rsplit("/", 1)[-1] for r in result.kept.collect()}
    assert {"p.png", "deep.png", "doc.zip", "v.mp4"} <= kept and "logo.svg" not in kept
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (1920).to_bytes(4, "big") + (1080).to_bytes(4, "big") + b"\x08\x06\x00\x00\x00" + bytes(400)
    bodies = spark.createDataFrame([("https://site.example/dir/p.png", 200, png), ("https://site.example/dir/p2.png", 200, png[:16] + (3).to_bytes(4, "big") * 2 + png[24:]), ("https://site.example/dir/v.mp4", 404, b"")], "url string, status int, body binary")
    items = {r["name"]: r for r in probed_items(result.kept, bodies).collect()}
    assert (items["p.png"]["width"], items["p.png"]["status"], items["p.png"]["verdict"]) == (1920, "ok", None)
    assert items["p2.png"]["verdict"]["reason"] == "pixel" and items["v.mp4"]["status"] == "missing" and items["doc.zip"]["status"] == "pending"
    again = reprobe(result.kept, urls=spark.createDataFrame([("https://site.example/dir/v.mp4",)], "url string"))
    assert again.count() == 1


def test_entities_without_semicolons():
    page = "<title>x&amp</title><p title='a&lt'>a&amp b&amp; c&#65 d&#65; e&#x41 f&#x41; &copyg &copy</p>"
    whole, closed = (html.read_page(page, URL, ("doc", "blocks"), bare=bare) for bare in (True, False))
    assert (whole["doc"]["title"], whole["blocks"][0]["text"]) == ("x&", "a& b& cA dA eA fA &copyg ©")
    assert (closed["doc"]["title"], closed["blocks"][0]["text"]) == ("x&amp", "a&amp b& c&#65 dA e&#x41 fA &copyg &copy")
    assert html.read_page(page, URL, ("doc", "blocks")) == whole


@pytest.mark.parametrize("more", [0, 200])
def test_regions_of_deep_pages(more):
    """Elements that are never closed pile up; the region holds beyond the limit only if asked for."""
    page = "<article>" + "".join(f"<p><b>text {k}<br>" for k in range(100 + more)) + "<p>last one</article><p>after it"
    plain, deep = (html.read_page(page, URL, ("blocks",), deep=deep)["blocks"] for deep in (False, True))
    assert {b["zone"] for b in deep if b["text"] != "after it"} == {"main"} and len(deep) == 102 + more
    assert [b["zone"] for b in deep if b["text"] == "after it"] == ["content"]
    assert (deep == plain) == (more == 0)


def test_deep_inline_elements_are_read_in_linear_time():
    began = time.process_time()
    blocks = html.read_page("<article><p>" + "<b>x " * 200_000 + "</article>", URL, ("blocks",), deep=True)["blocks"]
    assert [b["words"] + b["chars"] for b in blocks] == [200_000] and time.process_time() - began < 60


def test_all_headings_are_read_and_a_scan_lists_the_first(spark, tmp_path):
    """The reader has no limit; a scan lists 300 headings of a page, as the reference does."""
    pages = spark.createDataFrame([(1, URL, "".join(f"<h2>A {k}</h2>" for k in range(700)))], "page_id long, url string, html string")
    found = html.exploded(html.extract_pages(pages, parts=("headings",)), "headings").orderBy("position").collect()
    assert [(r["position"], r["level"], r["text"]) for r in found] == [(k + 1, 2, f"A {k}") for k in range(700)]
    listed = scan(pages, workspace=str(tmp_path)).headings.orderBy("position").collect()
    assert listed == found[:300]
