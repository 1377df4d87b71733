"""Views over the driver's tables that stand for scanned resources.

The pages of the test tables reference no images, so references and items are derived from orders and parts by plain
arithmetic. The SQL is common to Spark and DuckDB: both engines start from the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.tables import read_spread

_EXT = "case p_partkey % 9 when 0 then 'png' when 1 then 'jpg' when 2 then 'webp' when 3 then 'svg' when 4 then 'mp4' when 5 then 'mp3' when 6 then 'pdf' when 7 then 'css' else 'ico' end"
_DIR = "case p_partkey % 4 when 0 then 'images' when 1 then 'icons' when 2 then 'ui' else 'media' end"

URLS = f"""
select p_partkey, p_size,
    concat('https://img', cast(p_partkey % 7 as string), '.example.com/', {_DIR}, '/', cast(p_partkey as string), '-',
        cast(p_size * 20 as string), 'x', cast(p_size * 10 as string), '.', {_EXT},
        case p_partkey % 3 when 0 then concat('?w=', cast(p_size * 20 as string), '&q=75') when 1 then '?v=2&ref=a' else '' end) as url,
    {_EXT} as ext, {_DIR} as dir
from part"""

REFS = f"""
select l_orderkey * 10 + l_linenumber as seq, l_suppkey as page_id, u.url as url, u.ext as ext, p_size,
    case (l_partkey + l_linenumber) % 5 when 0 then 'img' when 1 then 'a' when 2 then 'source' when 3 then 'link' else 'div' end as tag,
    case l_linenumber % 4 when 0 then 'src' when 1 then 'href' when 2 then 'data-src' else 'a[download]' end as attr,
    case (l_orderkey + l_linenumber) % 5 when 0 then 'attr' when 1 then 'css' when 2 then 'json' when 3 then 'inferred' else 'attr' end as provenance,
    case when l_linenumber % 3 = 0 then 'image' when l_linenumber % 3 = 1 and l_partkey % 5 = 0 then 'icon' else null end as hint,
    case when l_orderkey % 4 = 0 then cast(p_size as string) else '' end as width_hint,
    case when l_orderkey % 6 = 0 then '.toolbar .icon' when l_orderkey % 6 = 1 then '.hero' else '' end as selector,
    case when l_orderkey % 11 = 0 then 'mask-image' when l_orderkey % 11 = 1 then 'background' else '' end as css_prop,
    l_orderkey % 13 = 0 as sprite,
    case when l_linenumber % 2 = 0 then concat('alt ', cast(l_partkey % 10 as string)) else '' end as alt,
    case (l_partkey + l_orderkey) % 6 when 0 then 'main' when 1 then 'content' else 'noise' end as zone,
    case (l_partkey + l_orderkey) % 6 when 2 then 'nav' when 3 then 'footer' when 4 then 'aside' when 5 then 'header' else '' end as zone_kind,
    (l_partkey + l_orderkey) % 6 >= 4 as zone_soft
from lineitem join ({URLS}) u on u.p_partkey = l_partkey"""

_TYPE = "case when ext in ('png', 'jpg', 'webp') then 'image' when ext = 'svg' then 'vector' when ext = 'mp4' then 'video' when ext = 'mp3' then 'audio' when ext = 'pdf' then 'document' when ext = 'css' then 'stylesheet' else 'icon' end"

ITEMS = f"""
select p_partkey as idx, url, {_TYPE} as type, concat('file-', cast(p_partkey as string), '.', ext) as name, ext,
    case when p_partkey % 8 = 0 then 'missing' when p_partkey % 17 = 0 then 'error' else 'ok' end as status,
    cast(floor(p_retailprice) as bigint) as size, case when p_partkey % 5 = 0 then null else p_size * 20 end as width,
    case when p_partkey % 5 = 0 then null else p_size * 10 end as height, case when ext in ('mp4', 'mp3') then p_size * 1.5 else null end as duration,
    concat('img', cast(p_partkey % 7 as string), '.example.com') as host, md5(cast(p_partkey % 1500 as string)) as hash,
    case p_partkey % 3 when 0 then 'attr' when 1 then 'css' else 'json' end as provenance, lower(p_type) as alt, lower(p_name) as title
from (select u.*, p.p_retailprice, p.p_type, p.p_name from ({URLS}) u join part p on p.p_partkey = u.p_partkey) x"""

FILTERED = """
select l_orderkey * 10 + l_linenumber as seq,
    case l_partkey % 7 when 0 then 'icon' when 1 then 'pixel' when 2 then 'font' when 3 then 'region' when 4 then 'script' when 5 then 'stylesheet' else null end as reason,
    case when l_linenumber % 2 = 0 then cast(l_quantity as bigint) * 100 else null end as size,
    case when l_linenumber % 3 = 0 then 'unresolved' else 'ok' end as status, l_linenumber % 3 <> 0 as probed
from lineitem"""

BOXES = """
select p_partkey as item_id, cast(p_partkey % 50 * 40 as double) as l, cast(p_partkey % 37 * 55 as double) as t,
    cast(p_partkey % 50 * 40 + p_size * 8 as double) as r, cast(p_partkey % 37 * 55 + p_size * 6 as double) as b from part"""

AREAS = """
select s_suppkey as area_id, cast(s_suppkey % 20 * 90 as double) as l, cast(s_suppkey % 15 * 120 as double) as t,
    cast(s_suppkey % 20 * 90 + 260 as double) as r, cast(s_suppkey % 15 * 120 + 240 as double) as b from supplier"""

ELEMENTS = "select l_orderkey * 10 + l_linenumber as el_id, l_partkey as k1, l_suppkey * 3 as k2 from lineitem"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references; what follows is heavy by the row, so small tables are spread."""
    return view(spark, sf_dir, REFS, spread=("lineitem",))


def view(spark: SparkSession, sf_dir: str, sql: str, spread: tuple[str, ...] = ()) -> DataFrame:
    """A view's rows; tables are passed by name, so that nothing is registered in the session."""
    names = ("part", "lineitem", "supplier", "events", "nation", "orders", "documents", "pages")
    path = lambda n: f"{sf_dir}/{n}.parquet"
    used = {n: read_spread(spark, path(n)) if n in spread else spark.read.parquet(path(n)) for n in names if _uses(sql, n)}
    for n in used:
        sql = _placed(sql, n)
    return spark.sql(sql, **used)


def _uses(sql: str, name: str) -> bool:
    return f"from {name}" in sql or f"join {name}" in sql


def _placed(sql: str, name: str) -> str:
    for word in ("from", "join"):
        sql = sql.replace(f"{word} {name}\n", f"{word} {{{name}}}\n").replace(f"{word} {name} ", f"{word} {{{name}}} ")
        sql = sql.replace(f"{word} {name})", f"{word} {{{name}}})")
        if sql.endswith(f"{word} {name}"):
            sql = sql[: -len(name)] + f"{{{name}}}"
    return sql
