"""Registered queries against their DuckDB SQL on the smallest tables, and the package without its training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]
#: Queries on pages whose titles are cut within an entity.
CUT_NAMES = [
    "page_blocks_merged",
    "page_doc_meta",
    "page_headings",
    "page_text_blocks",
    "page_text_totals",
    "page_zone_text_stats",
    "text_csv",
    "text_html",
    "text_markdown",
]
CUT_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A &amp;&amp; {cut}</title><style>p{{margin:0}}</style></head><body><nav><ul>
<li><a href="/To">To{cut}</a></li></ul></nav><article><h1>A &amp;&amp; {cut}</h1><p><b>A &amp;&amp; &amp;&quot; tail.<br><p>B&lt;.{cut}</p></article><footer>&copy; x &middot; y.</footer></body></html>"""
DEEP_PAGE = "<article><h1>A</h1>" + "".join(f"<p><b>text {k}<br>" for k in range(300)) + "</article>"
CUTS = ("and&amp", "and&am", "and&", "&quot", "&lt", "&copy", "&copy x", "&ampx", "&amp;amp", "and&amp;")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, str(SF))
    columns = sorted(found.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr) == expected


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    rows = [(n, f"https://a.example/{n}", CUT_PAGE.format(cut=cut)) for n, cut in enumerate(CUTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return folder


@pytest.mark.parametrize("name", CUT_NAMES)
def test_entities_without_semicolons_stay_as_in_sql(spark, cut_pages, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{cut_pages}/pages.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(cut_pages))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    assert expected and sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["page_text_blocks", "page_zone_text_stats", "text_csv"])
def test_regions_hold_at_any_depth_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://a.example/1", DEEP_PAGE)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    assert expected and sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_all_headings_as_in_sql(spark, tmp_path):
    rows = [(n, f"https://a.example/{n}", "<article>" + "".join(f"<h1>A {k % 450}</h1><p>b</p>" for k in range(n)) + "</article>") for n in (0, 299, 300, 301, 5000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = entry.queries()["page_headings"](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"select {columns} from ({entry.oracle_sql()['page_headings']})").fetchall()
    assert len(expected) == 5900 and sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_import_without_the_training_data_part():
    code = "import sys; sys.modules['pagewright.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr[-500:]


def test_entry_runs(spark):
    if SF.exists():
        assert entry.entry(spark).count() > 0
