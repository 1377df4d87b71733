"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. The ledger has one row per scanned
(blob, rules version) with its spans, empty ones included, so that only pairs that it does not
hold are scanned; findings are then joined back to every path that holds the blob. DataFrame functions only.

Matches are found by one pass of the regular expression engine per rule: each match is put
between two marker characters, the text is split there, and running lengths of the pieces give the
places. A marker that a text itself holds is first replaced by another noncharacter, which no
rule matches; lengths stay the same. Places are code points, ends exclusive.

Null texts count as empty. Repeated ids and rows are paths of their own; a null id is a path
like any other. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import keep

MARK, SPARE = "\ufdd0", "\ufdd1"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``secret`` is the regex group whose length must be ``least`` or more."""

    kind: str
    pattern: str
    gate: str
    secret: int = 0
    least: int = 1


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i:password|passwd|secret|token|api_?key)",
        1,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 0, 32),
)
_KEY = r"[A-Z0-9 ]*+(?<=PRIVATE KEY|PRIVATE KEY BLOCK)-----"
#: Between the lines of a key: white space, marks of quoting and escaped line ends.
_GAP = r"(?:[\s>#*|\"',;]|\\[nrt])*+"
_LINE = r"[A-Za-z0-9+/=]{16,}+"
_LAST = r"[A-Za-z0-9+/=]++(?=[ \t\"',;]*+(?:[\r\n]|\\[nr]|$))"
_BODY = rf"(?:(?:{_GAP}{_LINE})++(?:{_GAP}{_LAST})?+|{_GAP}{_LAST})"
#: A key up to its END; without one, the base64 lines that follow, with header lines before them.
_PEM = rf"-----BEGIN {_KEY}(?:(?:(?!-----)[\s\S])*+-----END {_KEY}|(?:{_GAP}[A-Z][A-Za-z-]*+:\x20[^\r\n\\]*+)*+{_BODY})?+"
#: What this version of the rules finds beside the base kinds.
MORE_RULES = (
    Rule("pem", _PEM, rf"-----BEGIN {_KEY}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ", 0, 32),
    Rule("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", r"gh[pousr]_|glpat-|xox[abprs]-|sk_live_", 0, 20),
    Rule("login", r"://[A-Za-z0-9._%+-]+:([^\x00-\x20@/:]+)@", r"://[A-Za-z0-9._%+-]+:[^\x00-\x20@/:]+@", 1, 3),
)
RULES = BASE_RULES + MORE_RULES
#: Raised with every change of the rules, so that ledgers of older ones are not used. Version 1 ended keys with their BEGIN line.
RULES_VERSION = 3

LEDGER_SCHEMA = "blob binary, rules_version int, spans array<struct<start:long,kind_no:int,kind:string,end:long>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _pieces(text: Column, rule: Rule) -> Column:
    marked = F.regexp_replace(text, F.lit(f"({rule.pattern})"), F.lit(f"{MARK}$1{MARK}"))
    return F.when(text.rlike(rule.gate), F.split(marked, MARK))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text), one for each distinct blob."""
    text = F.replace("text", F.lit(MARK), F.lit(SPARE))
    tries = [
        F.struct(F.lit(k).alias("kind_no"), F.lit(r.kind).alias("kind"), _pieces(F.col("text"), r).alias("pieces"))
        for k, r in enumerate(rules)
    ]
    per_rule = blobs.where(F.col("text").rlike("|".join(f"(?:{r.gate})" for r in rules)))
    per_rule = per_rule.select("blob", text.alias("text")).select("blob", F.inline(F.array(*tries)))
    pieces = per_rule.where("pieces is not null").select("blob", "kind_no", "kind", F.posexplode("pieces").alias("at", "piece"))
    pieces = pieces.select("blob", "kind_no", "kind", "at", F.length("piece").alias("size"), F.when(F.col("at") % 2 == 1, F.col("piece")).alias("match"))
    order = Window.partitionBy("blob", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.distinct().withColumn("end", F.sum("size").over(order).cast("long")).where("match is not null")
    passes = F.lit(False)
    for k, r in enumerate(rules):
        secret = F.regexp_extract("match", r.pattern, r.secret)
        passes = F.when(F.col("kind_no") == k, F.length(secret) >= r.least).otherwise(passes)
    spans = placed.where(passes).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind_no", "kind", "end"))).alias("spans")
    )
    scanned = blobs.select("blob").distinct().join(spans, "blob", "left")
    empty = F.array().cast("array<struct<start:long,kind_no:int,kind:string,end:long>>")
    return scanned.select("blob", F.lit(version).alias("rules_version"), F.coalesce("spans", empty).alias("spans"))


def update_ledger(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    version: int = RULES_VERSION,
) -> DataFrame:
    """New ledger rows: of the distinct blobs of ``docs`` that the ledger lacks at this version.

    One path per blob is chosen before any text moves, so copies are neither moved nor scanned again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"), text.alias("text"))
    unseen = versions.groupBy("blob").agg(F.min("id").alias("any_id"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules_version") == version).select("blob"), "blob", "left_anti")
    chosen = (versions["blob"] == unseen["blob"]) & versions["id"].eqNullSafe(unseen["any_id"])
    todo = versions.join(unseen, chosen, "left_semi").select("blob", "text")
    return keep(scan(todo, rules, version), "ledger")


def findings(
    docs: DataFrame, ledger: DataFrame, columns: list[str], text_col: str = "text", version: int = RULES_VERSION, spans: str = "found_spans"
) -> DataFrame:
    """Every row's given columns with the spans of its blob (an empty array if none), in a column whose name must not be one of them."""
    if spans in columns:
        raise ValueError(f"{spans} is a column of the table; give the spans another name")
    held = ledger.where(F.col("rules_version") == version).where(F.size("spans") > 0)
    held = held.select(F.col("blob").alias("found_blob"), F.col("spans").alias("found"))
    names = [f"c{k}" for k in range(len(columns))]
    paths = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), blob_of(F.col(text_col)).alias("own_blob"))
    empty = F.array().cast("array<struct<start:long,kind_no:int,kind:string,end:long>>")
    out = paths.join(held, F.col("own_blob") == F.col("found_blob"), "left")
    return out.select(*names, F.coalesce("found", empty).alias("found")).toDF(*columns, spans)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then rule order, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mask; overlapping spans give one mask."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= state["at"]
        before = F.substring(text, state["at"].cast("int"), (s["start"] + 1 - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"] + 1).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(before, F.lit(mask)))).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"].cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
