"""Where pages and bytes come from: fetched documents, stored snapshots, files, data URIs, and the byte cache.

The fetch stage takes any function from a request to a response, so that tests and offline runs serve it from a table.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one document, of the cache, and of a fetch.
SNIFF_BYTES, CACHE_BYTES, CACHE_HOURS, HOPS, WORKERS, FAST_SECONDS, SLOW_SECONDS = 4096, 64 << 20, 24, 5, 12, 8.0, 20.0
PAGE_BYTES, BUDGET_SECONDS = 8 << 20, 75.0
DOCUMENT = "url string, status int, content_type string, body binary, total_bytes long, truncated boolean, whole boolean, final_url string, error string"


@dataclass(frozen=True)
class Response:
    """What a fetch returns; ``status`` 0 stands for no answer."""

    status: int
    content_type: str = ""
    body: bytes = b""
    total_bytes: int | None = None
    final_url: str = ""
    error: str = ""


Fetcher = Callable[[str, int, float], Response]


def http_fetch(url: str, most_bytes: int, seconds: float) -> Response:
    """One GET with at most HOPS redirects and a byte cap."""
    request = urllib.request.Request(url, headers={"accept": "*/*", "accept-encoding": "identity"})
    opener = urllib.request.build_opener(_Redirects())
    try:
        with opener.open(request, timeout=seconds) as r:
            length = r.headers.get("content-length")
            return Response(r.status, r.headers.get("content-type", ""), r.read(most_bytes + 1), int(length) if length else None, r.url)
    except urllib.error.HTTPError as e:
        return Response(e.code, e.headers.get("content-type", "") if e.headers else "", b"", None, url)
    except (OSError, ValueError) as e:
        return Response(0, error=str(e)[:140])


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = HOPS


def fetched(
    urls: DataFrame, fetch: Fetcher = http_fetch, most_bytes: int = CACHE_BYTES, workers: int = WORKERS, budget: float | None = None
) -> DataFrame:
    """A row for each URL, fetched by a thread pool in each partition: quickly first, once more with patience.

    A status of 0 with an error stands for no answer. Bodies are cut at ``most_bytes``. With a ``budget`` of seconds, which begins
    with the task, URLs whose turn comes later are not asked for any more and say so.
    """

    def one(url: str, until: float) -> tuple:
        if time.monotonic() > until:
            return url, 0, "", b"", 0, False, False, url, "时间预算耗尽"
        for seconds in (FAST_SECONDS, SLOW_SECONDS):
            r = fetch(url, most_bytes, seconds)
            if r.status:
                break
        cut = len(r.body) > most_bytes
        body = r.body[:most_bytes]
        whole = r.status == 200 and not cut and (r.total_bytes is None or r.total_bytes == len(body))
        return url, r.status, r.content_type, body, r.total_bytes or len(r.body), cut, whole, r.final_url or url, r.error

    names = [c.split()[0] for c in DOCUMENT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = time.monotonic() + (float("inf") if budget is None else budget)
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    some = batch.column(0).slice(at, 64).to_pylist()
                    rows = [dict(zip(names, r, strict=True)) for r in pool.map(one, some, repeat(until))]
                    yield pa.RecordBatch.from_pylist(rows, shape)

    shape = urls.sparkSession.createDataFrame([], DOCUMENT).toArrow().schema
    return urls.select("url").where("url is not null").distinct().mapInArrow(read, DOCUMENT)


def outcome(status: Column, error: Column) -> Column:
    """What became of a request."""
    return (
        F.when((status >= 200) & (status < 300), "ok").when(status.isin(404, 410), "missing").when(status.isin(401, 403), "blocked")
        .when(error.rlike("(?i)timed? ?out"), "timeout").when(error.rlike("(?i)name or service|getaddrinfo|nodename"), "dns").otherwise("error")
    )


# ------------------------------------------------------------------ text


def header_charset(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i)charset=["']?([A-Za-z0-9_-]+)""", 1))


def sniffed_charset(body: Column) -> Column:
    """A charset named in the first bytes: in a meta tag, else anywhere."""
    head = F.decode(F.substring(body, 1, SNIFF_BYTES), "ISO-8859-1")
    in_meta = F.regexp_extract(head, r"""(?i)<meta[^>]+charset=["']?([A-Za-z0-9_-]+)""", 1)
    return F.lower(F.when(in_meta != "", in_meta).otherwise(F.regexp_extract(head, r"(?i)charset=([A-Za-z0-9_-]+)", 1)))


def decode_bytes(body: bytes, charset: str) -> str:
    """Text by the named charset, GB 18030 for any gb charset, UTF-8 at last; a reading with replacements is not taken before that."""
    for name in [charset] * bool(charset) + ["gb18030"] * charset.startswith("gb"):
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace").removeprefix(chr(0xFEFF))


def decoded_text(body: Column, content_type: Column) -> Column:
    """Text of a document: charset by header, else sniffed. UTF-8 stays in the JVM."""

    @F.udf("string", useArrow=True)
    def other(data, charset):
        return None if data is None else decode_bytes(bytes(data), charset or "")

    named = header_charset(content_type)
    charset = F.when(named != "", named).otherwise(sniffed_charset(body))
    plain = charset.isin("", "utf-8", "utf8") & F.is_valid_utf8(body.cast("string"))
    return F.when(plain, F.regexp_replace(body.cast("string"), "^" + chr(0xFEFF), "")).otherwise(other(body, charset))


def data_uri_bytes(data: Column, base64: Column) -> Column:
    """Bytes of a data URI; null where they are not valid."""
    plain = F.coalesce(F.try_url_decode(F.replace(data, F.lit("+"), F.lit("%2B"))), data)
    return F.when(base64, F.try_to_binary(data, F.lit("base64"))).otherwise(plain.cast("binary"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as (path, length, body)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("content").alias("body"))


# ------------------------------------------------------------------ byte cache


def cache_rows(documents: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """Documents as cache rows: keyed by the SHA-1 of the URL, with a content hash; bodies over the limit are not cached."""
    rows = documents.where((F.col("status") == 200) & (F.octet_length("body") <= CACHE_BYTES))
    return rows.select(
        F.sha1(F.col("url").cast("binary")).alias("url_sha1"), "url", "final_url", "status", "content_type", "truncated", "body",
        F.octet_length("body").cast("long").alias("bytes"), F.substring(F.sha1("body"), 1, 16).alias("hash"),
        (saved_at if saved_at is not None else F.current_timestamp()).alias("saved_at"),
    ).withColumn("shard", F.substring("url_sha1", 1, 2))


def write_cache(documents: DataFrame, path: str) -> None:
    cache_rows(documents).write.mode("append").partitionBy("shard").parquet(path)


def fresh(cache: DataFrame, now: Column | None = None, hours: int = CACHE_HOURS) -> DataFrame:
    """The newest row of each URL that has not outlived its time."""
    alive = cache.where(F.col("saved_at") > (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {hours} HOURS"))
    others = [c for c in cache.columns if c not in ("url_sha1", "saved_at")]
    return alive.groupBy("url_sha1").agg(F.max_by(F.struct("saved_at", *others), "saved_at").alias("r")).select("url_sha1", "r.*")


def read_through(urls: DataFrame, cache: DataFrame, fetch: Fetcher = http_fetch, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of all URLs, those of them that were fetched because the cache lacked them)."""
    keyed = urls.select("url").distinct().withColumn("url_sha1", F.sha1(F.col("url").cast("binary")))
    known = fresh(cache, now)
    hits = keyed.join(known.drop("url"), "url_sha1").select("url", "status", "content_type", "body", "truncated", "final_url")
    lacking = keyed.join(known, "url_sha1", "left_anti").select("url")
    new = fetched(lacking, fetch)
    return hits.unionByName(new.select(*hits.columns)), new


#: Fixed value: what a stored page's address ends with, so that its bytes as a resource stay apart.
SNAPSHOT = "#doc"


def snapshots(documents: DataFrame, cache: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """Cache rows of the pages among ``documents`` that the cache has no living snapshot of."""
    pages = documents.where(F.octet_length("body") > 0).withColumn("url", F.concat(F.col("url"), F.lit(SNAPSHOT)))
    rows = cache_rows(pages.withColumn("content_type", F.when(F.coalesce("content_type", F.lit("")) == "", "text/html; charset=utf-8").otherwise(F.col("content_type"))), saved_at)
    return rows.join(fresh(cache, saved_at).select("url_sha1"), "url_sha1", "left_anti")


def stored_pages(urls: DataFrame, cache: DataFrame, fetch: Fetcher = http_fetch, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages as url, text, content_type, truncated, cached, error; documents that had to be fetched, to be stored).

    The snapshot is read where there is one, else the page is fetched once.
    """
    keyed = urls.select("url").where("url is not null").distinct().withColumn("url_sha1", F.sha1(F.concat("url", F.lit(SNAPSHOT)).cast("binary")))
    known = fresh(cache, now).drop("url")
    hits = keyed.join(known, "url_sha1").select("url", "status", "content_type", "body", "truncated", F.lit(True).alias("cached"))
    new = fetched(keyed.join(known, "url_sha1", "left_anti").select("url"), fetch, PAGE_BYTES)
    rows = hits.unionByName(new.select("url", "status", "content_type", "body", "truncated", F.lit(False).alias("cached")))
    ok = F.col("status") == 200
    error = F.when(ok, None).when(F.col("status") > 0, F.concat(F.lit("站点返回 "), F.col("status").cast("string"))).otherwise("无法取得页面原文")
    text = F.when(ok, decoded_text(F.col("body"), F.col("content_type")))
    return rows.select("url", text.alias("text"), "content_type", "truncated", "cached", error.alias("error")), new


def cached_head(cache: DataFrame, most: int) -> DataFrame:
    """The first bytes of each cached body."""
    return cache.withColumn("body", F.substring("body", 1, most))


def purge_cache(spark: SparkSession, path: str) -> int:
    """Empties a cache folder; returns how many rows it held."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return 0
    n = spark.read.parquet(path).count()
    fs.delete(p, True)
    return n


def is_self_address(url: Column, own_host: str) -> Column:
    """Whether a URL is one of the service's own."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)) == own_host.lower()


def file_name_col(url: Column) -> Column:
    """The decoded last path segment of a normalised URL, or empty."""
    last = F.regexp_extract(url, r"^https?://[^/?#]*(?:/[^?#]*)?/([^/?#]+)/?(?:[?#]|$)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.when((F.char_length(plain) <= 160) & ~plain.rlike(r"^[.:]+$"), plain).otherwise("")




def display_name(url: Column, ext: Column) -> Column:
    """A name to show: the file's, else host and a short hash, with the extension that is known."""
    from pagewright.functions.text import clip

    named = file_name_col(url)
    host = F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), "(?i)[^a-z0-9]", "_")
    base = F.when(named != "", named).otherwise(F.concat(host, F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 6)))
    dotted = F.when(F.coalesce(ext, F.lit("")) != "", F.concat(F.lit("."), ext)).otherwise("")
    return clip(F.when(named.rlike(r"(?i)\.[a-z0-9]{1,6}$"), named).otherwise(F.concat(base, dotted)))
