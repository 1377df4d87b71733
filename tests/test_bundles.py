"""Bundles, orders, snapshots, element keys, progress and archives against plain Python."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from pagewright.functions.types import TYPES
from pagewright.operators import bundle, export, joins
from pagewright.plans.scan import ScanOptions, reprobed
from pagewright.sources import documents as docs
from pagewright.streaming.progress import ViewCache, progress_events

ITEM = "page_id long, idx int, name string, type string, ext string, url string, size long, status string, mime string, body binary"
BLOCK = "page_id long, ord int, block_id string, tag string, level int, text string, chars int, words int, line int, href string, zone string, zone_kind string, zone_soft boolean"


def test_positions_over_all_rows_and_in_groups(spark):
    rows = [(k * 7 % 500, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, g int").repartition(5)
    found = {r["k"]: r["position"] for r in export.placed(df, "k").collect()}
    assert found == {k: k + 1 for k in range(500)}
    plan = export.placed(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    groups = {}
    for r in export.placed(df, F.desc("k"), group=["g"]).collect():
        groups.setdefault(r["g"], []).append((r["position"], -r["k"]))
    assert all(sorted(p) == [(k + 1, x) for k, x in enumerate(sorted(x for _, x in p))] for p in groups.values())
    assert export.placed(df.limit(0), "k").count() == 0


def test_archives_hold_all_files_and_are_bounded(spark):
    rows = [(f"d/{k:03}.txt", (f"{k} " * 200).encode()) for k in range(40)] + [("e", None), (None, b"x"), ("d/raw", bytes(range(256)))]
    files = spark.createDataFrame(rows, "path string, body binary")
    made = export.zip_archives(files, most_bytes=3000)
    parts = made.collect()
    assert len(parts) >= sum(len(b or b"") for p, b in rows if p) / 3000 and sum(r["entries"] for r in parts) == 42
    back = {r["path"]: (bytes(r["body"]), r["crc"]) for r in export.unzipped(made).collect()}
    assert {p: b for p, (b, _) in back.items()} == {p: b or b"" for p, b in rows if p}
    out = io.BytesIO()
    assert export.write_zip([("a", b"ab"), ("b", b"x" * 999)], out, "note") == 2
    with zipfile.ZipFile(out) as z:
        assert [i.compress_type for i in z.infolist()] == [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED] and z.comment == b"note"


def test_disposition(spark):
    assert export.disposition('a"b\\中 文.zip') == "attachment; filename=\"ab_ _.zip\"; filename*=UTF-8''ab%E4%B8%AD%20%E6%96%87.zip"
    assert export.disposition("").startswith('attachment; filename="download"')
    assert spark.range(1).select(export.disposition_col(F.lit("x.zip")).alias("d")).first()["d"] == "attachment; filename=\"x.zip\"; filename*=UTF-8''x.zip"


def entries(df):
    return {(r["page_id"], r["path"]): bytes(r["body"]) for r in df.collect()}


def test_bundle(spark):
    items = spark.createDataFrame([
        (1, 1, "a.png", "image", "png", "http://h.org/a.png", 3, "ok", "image/png", b"abc"), (1, 2, "A.png", "image", "png", "http://h.org/b/A.png", 2048, "ok", "image/png", b"x" * 2048),
        (1, 3, "gone", "video", "mp4", "http://h.org/v", None, "missing", None, None), (2, 1, "doc", "document", "pdf", "http://k.org/doc", 4, "ok", "application/pdf", b"%PDF"),
    ], ITEM)
    jobs = spark.createDataFrame([(1, "http://h.org/x", "Home"), (2, "http://k.org/", None), (3, "http://empty.org/", "none")], "page_id long, url string, title string")
    blocks = spark.createDataFrame([
        (1, 0, "t1", "h1", 1, "Title", 5, 1, 3, None, "main", "", False), (1, 1, "t2", "p", 0, "A, b", 3, 2, 0, None, "content", "", False),
        (1, 2, "t3", "li", 0, "menu", 4, 1, 1, None, "noise", "nav", False), (3, 0, "t1", "p", 0, "lost", 4, 1, 1, None, "main", "", False),
    ], BLOCK)
    filtered = spark.createDataFrame([(1, 5, "http://h.org/i.ico", "icon", "UI 图标", "UI 图标", 2048, "d"), (1, 9, None, "region", "非内容区域", "非内容区域", None, None)], "page_id long, seq int, url string, reason string, label string, other string, size long, detail string")
    found = entries(bundle.bundle(jobs, items, blocks, filtered, stamp="2024-01-01T00-00-00"))
    root = "pagewright-h.org-全部资源-2024-01-01T00-00-00"
    files = {p: b for (page, p), b in found.items() if page == 1}
    label = TYPES["image"][0]
    assert set(files) == {f"{root}/{n}" for n in (f"{label}/001-a.png", f"{label}/002-A.png", "README.txt", "_manifest.json", "_资源清单.csv", "_文案/正文.md", "_文案/正文外.md", "_文案/文案.csv", "_文案/文案.json")}
    assert sorted(len(b) for p, b in files.items() if p.endswith(".png")) == [3, 2048]
    manifest = json.loads(files[f"{root}/_manifest.json"])
    assert manifest["source"] == "http://h.org/x" and manifest["entryCount"] == 3
    assert [(f["status"], f.get("bytes")) for f in manifest["files"]] == [("ok", 3), ("ok", 2048), ("failed", None)] and manifest["files"][2]["path"] == ""
    assert files[f"{root}/_文案/正文.md"].decode() == "# Title\n\nA, b" and "- menu" in files[f"{root}/_文案/正文外.md"].decode()
    assert files[f"{root}/_文案/文案.csv"].decode().split("\r\n")[1:3] == ["1,h1,1,主体内容区,5,1,3,Title", '2,p,,未定性,3,2,,"A, b"']
    assert [b["text"] for b in json.loads(files[f"{root}/_文案/文案.json"])] == ["Title", "A, b", "menu"]
    assert len(files[f"{root}/_资源清单.csv"].decode().split("\r\n")) == 4
    report = files[f"{root}/README.txt"].decode().split("\n")
    assert "来源页面 : http://h.org/x" in report and "页面标题 : Home" in report and "导出范围 : 全部资源（3 个文件）" in report and "被排除   : 2 项（默认不扫描、不请求）" in report
    assert "  · [UI 图标] http://h.org/i.ico · 2.00KB  ← d" in report and "  · [非内容区域] 内联  ← region" in report
    assert any("「UI 图标」「扫描页眉 / 导航 / 页脚」" in x for x in report)
    other = next(b.decode() for (page, p), b in found.items() if page == 2 and p.endswith("README.txt"))
    assert "被排除   : 0 项" in other and "页面标题 : -" in other and not any(page == 3 for page, _ in found)
    plain = entries(bundle.bundle(jobs, items, blocks, filtered, options=ScanOptions(main_only=False), with_text=False))
    assert not any("_文案" in p for _, p in plain) and any("整个页面" in b.decode("utf-8", "replace") for (_, p), b in plain.items() if p.endswith("README.txt"))


def test_orders_and_job_lists(spark):
    items = spark.createDataFrame([(1, 1, "error"), (1, 2, "ok"), (1, 3, "ok"), (2, 1, "missing")], "page_id int, idx int, status string")
    assert sorted((r["page_id"], r["idx"], r["status"]) for r in bundle.item_order(items).collect()) == [(1, 1, "ok"), (1, 2, "ok"), (1, 3, "error"), (2, 1, "missing")]
    boxes = spark.createDataFrame([(1, "b", 4, False, False), (1, "a", 9, False, False), (1, "b", 1, True, False), (1, "c", 0, False, True), (1, "a", 2, None, None)], "page_id int, id string, place int, excluded boolean, hidden boolean")
    assert sorted((r["place"], r["id"]) for r in bundle.document_order(boxes).collect()) == [(1, "a"), (2, "b")]
    jobs = spark.createDataFrame([(k, f"u{k}", "running" if k in (0, 3) else "done", k, None, None) for k in range(30)], "id int, url string, status string, created_at int, resources int, title string")
    assert [r["id"] for r in bundle.job_list(jobs).collect()] == list(range(29, 9, -1))
    assert sorted(r["id"] for r in bundle.pruned_jobs(jobs).collect()) == [0, 3, *range(8, 30)]
    again = spark.createDataFrame([(1, 1, "ok")], items.schema)
    assert sorted(map(tuple, reprobed(items, again).collect()))[0] == (1, 1, "ok") and reprobed(items, again).count() == 4


def test_element_keys_and_excluded_entries(spark):
    pairs = [("src", "a.png"), ("SRCSET", "b.png 1x, a.png 2x"), ("href", "#top"), ("style", "background:url(c.png) url('#x')"), ("data-bg", "d"), ("data-file", "e.mp4"), ("data-note", "f"), ("title", "g.png"), ("src", None)]
    df = spark.createDataFrame([(1, pairs), (2, None)], "el int, attrs array<struct<name:string,value:string>>")
    found = {r["el"]: r["k"] for r in df.select("el", joins.element_keys(F.col("attrs"), F.lit("http://h.org/x/")).alias("k")).collect()}
    assert found == {1: [f"http://h.org/x/{n}" for n in ("a.png", "b.png", "c.png", "d", "e.mp4")], 2: []}
    items = spark.createDataFrame([(1, "k1"), (2, "k2")], "id int, key string")
    gone = spark.createDataFrame([(8, "k1"), (9, "k3")], "id int, key string")
    elements = spark.createDataFrame([(10, ["k1", "k3"]), (11, ["k2", "k2"]), (12, ["k4"])], "el_id int, keys array<string>")
    assert sorted((r["id"], r["el_id"], r["excluded"]) for r in joins.with_excluded(items, gone, elements).collect()) == [(1, 10, False), (2, 11, False), (9, 10, True)]


def test_snapshots_of_pages(spark, tmp_path):
    pages = {"http://a/": docs.Response(200, "text/html; charset=gbk", "中文".encode("gbk")), "http://b/": docs.Response(404), "http://c/": docs.Response(0, error="timed out")}
    fetch = lambda url, most, seconds: pages[url]
    urls = spark.createDataFrame([(u,) for u in pages], "url string")
    first = docs.fetched(urls, fetch)
    docs.write_cache(first, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    kept = docs.snapshots(first, cache)
    assert [r["url"] for r in kept.collect()] == ["http://a/#doc"]
    kept.write.mode("append").partitionBy("shard").parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert docs.snapshots(first, cache).count() == 0
    found, new = docs.stored_pages(urls, cache, fetch)
    rows = {r["url"]: r for r in found.collect()}
    assert rows["http://a/"]["cached"] and rows["http://a/"]["text"] == "中文" and rows["http://a/"]["error"] is None
    assert not rows["http://b/"]["cached"] and rows["http://b/"]["error"] == "站点返回 404" and rows["http://c/"]["error"] == "无法取得页面原文"
    assert new.count() == 2


def test_a_budget_ends_fetching(spark):
    urls = spark.createDataFrame([(f"http://x/{k}",) for k in range(6)], "url string").coalesce(1)
    found = docs.fetched(urls, lambda url, most, seconds: docs.Response(200, "t", b"x"), budget=-1.0).collect()
    assert len(found) == 6 and {r["error"] for r in found} == {"时间预算耗尽"} and {r["status"] for r in found} == {0}


def test_progress_and_view_cache(spark):
    done = spark.createDataFrame([(j, k, 5 if j else 1) for j in (0, 1) for k in range(5 if j else 1)], "job int, at int, total int")
    told = sorted((r["job"], r["done"], r["progress"]) for r in progress_events(done, ["job"], "at").collect())
    assert told == [(0, 1, 95), (1, 2, 65), (1, 4, 85), (1, 5, 95)]
    cache, made = ViewCache(), []
    make = lambda: made.append(1) or {"rows": spark.range(3)}
    first = cache.get(("all", "index"), make)["rows"]
    assert first.is_cached and cache.get(("all", "index"), make)["rows"] is first and len(made) == 1
    cache.get(("all", "size"), make)
    assert not first.is_cached and len(made) == 2
    cache.changed()
    cache.get(("all", "size"), make)
    assert len(made) == 3
    cache.release()
