"""Text scalars: cleaning, counting, entities and keywords."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.weburl import JS_SPACE

#: White space as web pages know it, as a character class for Java and Python.
SPACE = f"[{JS_SPACE}]"
#: Han, Kana and Hangul letters count as words of their own.
CJK = "[一-鿿぀-ヿ가-힯]"
LATIN_WORD = "[A-Za-z0-9_'-]{2,}"

#: Entities that are decoded by name, with or without a semicolon.
ENTITIES = {
    "amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 32, "ensp": 32, "emsp": 32, "thinsp": 32, "shy": None, "ldquo": 8220,
    "rdquo": 8221, "lsquo": 8216, "rsquo": 8217, "hellip": 8230, "mdash": 8212, "ndash": 8211, "middot": 183, "bull": 8226, "copy": 169,
    "reg": 174, "trade": 8482, "rarr": 8594, "larr": 8592, "darr": 8595, "uarr": 8593, "times": 215, "deg": 176, "para": 182, "sect": 167,
    "euro": 8364, "pound": 163, "yen": 165,
}
#: Latin words and Han characters that are no keywords.
STOP_WORDS = (
    "the and for with you that this from are was will have has not but our your can who how why what when where which their there here "
    "they them then than into onto over under about after before also more most much many said says one two new old via per com www http "
    "https js css img src url null true false function return var let const class style width height type name data attr item node list "
    "view page all some any just been does done"
).split()
STOP_HAN = (
    "的了是在和等有与也不就都为我你他她它这那之并且或者而没可以什么怎么如果因为所以但是虽然已经正在将要其相他进行通过基于以下如更多解详情查点注发版所司站页个要家品务术用网络信数时间新代对能情况项目"
)

_KEYWORD = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{3,}")
_RUN = re.compile(f"{SPACE}+")
_LATIN = re.compile(LATIN_WORD)
_SEPARATOR = re.compile("[\x1c-\x1f]")
_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(SPACE, c))


# ------------------------------------------------------------------ plain functions


def _character(code: int) -> str:
    return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""


def decode_entities(text: str, bare: bool = True) -> str:
    """Hexadecimal, then decimal, then named entities; unknown names stay, and unless ``bare`` those that no semicolon ends."""
    if "&" not in text:
        return text
    end = ";?" if bare else ";"
    text = re.sub(rf"(?i)&#x([0-9a-f]{{1,6}}){end}", lambda m: _character(int(m[1], 16)), text)
    text = re.sub(rf"&#([0-9]{{1,7}}){end}", lambda m: _character(int(m[1])), text)

    def named(m: re.Match) -> str:
        name = m[1].lower()
        if name not in ENTITIES:
            return m[0]
        return "" if ENTITIES[name] is None else chr(ENTITIES[name])

    return re.sub(rf"(?i)&([a-z]+){end}", named, text)


def trimmed(text: str) -> str:
    return text.strip(_SPACES)


def _words(text: str) -> list[str] | None:
    """The pieces between white space where Python's own notion of it serves: ASCII without its four separators."""
    return text.split() if text.isascii() and not _SEPARATOR.search(text) else None


def clean_text(text: str, bare: bool = True) -> str:
    text = decode_entities(text, bare)
    words = _words(text)
    return trimmed(_RUN.sub(" ", text)) if words is None else " ".join(words)


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def count_chars(text: str) -> int:
    words = _words(text)
    return len(_RUN.sub("", text)) if words is None else sum(map(len, words))


def count_words(text: str) -> int:
    if text.isascii():
        return len(_LATIN.findall(text))
    han = re.findall(CJK, text)
    return len(han) + len(re.findall(LATIN_WORD, re.sub(CJK, " ", text)))


def _latin(text: str) -> Iterator[str]:
    terms = (w.lower().rstrip(".") for w in _KEYWORD.findall(text))
    return (t for t in terms if len(t) <= 24 and t not in _STOP)


def term_scores(text: str) -> Counter:
    """Latin terms count 1, Han n-grams (2 to 4 characters) half their length."""
    scores = Counter(_latin(text))
    for size, pattern in _HAN_GRAMS.items() if not text.isascii() else ():
        for gram, n in Counter(pattern.findall(text)).items():
            if _STOP_HAN.isdisjoint(gram):
                scores[gram] += n * size / 2
    return scores


#: Every run of as many Han characters, overlapping ones too.
_HAN_GRAMS = {size: re.compile(f"(?=([一-鿿]{{{size}}}))") for size in (2, 3, 4)}
_STOP, _STOP_HAN = set(STOP_WORDS), set(STOP_HAN)


def top_keywords(text: str, most: int = 26) -> list[tuple[str, int]]:
    """The best terms of a score of 2 or more, by score, then term; those inside a longer picked term go."""
    ranked = sorted((-score, term) for term, score in term_scores(text).items() if score >= 2)
    picked: dict[str, int] = {}
    for negative, term in ranked:
        inside = any(term in p and term != p for p in picked)
        if len(picked) < most and not inside:
            picked[term] = int(0.5 - negative)
    return list(picked.items())


# ------------------------------------------------------------------ columns


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def count_chars_col(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"{SPACE}+", ""))


def count_words_col(text: Column) -> Column:
    """Native: Han, Kana and Hangul characters plus Latin tokens of two or more characters."""
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit(LATIN_WORD))


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def decode_entities_col(text: Column) -> Column:
    """Named and numeric entities of the fixed list; Arrow batches, as replacements depend on the match."""

    @F.arrow_udf("string")
    def decoded(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else decode_entities(v) for v in values.to_pylist()], pa.string())

    return F.when(text.contains("&"), decoded(text)).otherwise(text)


def clean_text_col(text: Column) -> Column:
    return collapse_space(decode_entities_col(text))


def latin_terms(text: Column) -> Column:
    """Keyword candidates of a text, lower-cased, without trailing dots, stop words and long ones."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9+.-]{3,}"), 0), lambda w: F.regexp_replace(F.lower(w), r"\.+$", "")
    )
    return F.filter(found, lambda w: (F.char_length(w) <= 24) & ~w.isin(STOP_WORDS))


def term_frequency(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, term, n): counted map-side before the shuffle."""
    return docs.select(*keys, F.explode(latin_terms(F.col(text_col))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def keywords_by(docs: DataFrame, key: str, text_col: str, most: int = 26) -> DataFrame:
    """(key, position, term, score) of each row's text; picking is greedy, hence Python over Arrow batches."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, i + 1, term, score)
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, (term, score) in enumerate(top_keywords(text or "", most))
            ]
            names = ("key", "position", "term", "score")
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, r, strict=True)) for r in rows],
                pa.schema([("key", pa.int64()), ("position", pa.int32()), ("term", pa.string()), ("score", pa.int64())]),
            )

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    return found.mapInArrow(picked, "key long, position int, term string, score long").withColumnRenamed("key", key)


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1, that a character offset is on; 0 for offset 0."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.when(offset == 0, 0).otherwise(F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def clip(text: Column, most: int = 84) -> Column:
    """A file name: line breaks and reserved characters replaced, shortened around an ellipsis, never empty."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n\t]", " "), r'[\\/:*?"<>|]', "_")
    clean = F.trim(clean)
    short = F.concat(F.substring(clean, 1, most - 4), F.lit("…"), F.right(clean, F.lit(3)))
    return F.when(F.char_length(clean) > most, short).when(clean == "", "unnamed").otherwise(clean)


def format_bytes(size: Column) -> Column:
    """Bytes with a unit of 1024s and three digits or so: 512B, 1.50KB, 24.3MB, 118MB."""
    value = F.greatest(size.cast("double"), F.lit(0.0))
    out = F.concat(F.round(value).cast("long").cast("string"), F.lit("B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = value / float(1024**k)
        digits = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        out = F.when(value >= 1024**k, F.concat(digits, F.lit(unit))).otherwise(out)
    return F.when(size.isNull(), "未知").otherwise(out)


def format_seconds(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour."""
    whole = F.floor(seconds + 0.5)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(seconds.isNull() | (seconds <= 0), "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def _fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, from its binary value; ties go up."""
    return F.format_string(f"%.{digits}f", half_up(value, digits))


def format_ms(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with two digits, one from ten."""
    seconds = ms / 1000.0
    text = F.when(ms < 10000, _fixed(seconds, 2)).otherwise(_fixed(seconds, 1))
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).otherwise(F.concat(text, F.lit("s")))


def format_duration(seconds: Column) -> Column:
    """A length of time in words: milliseconds, seconds, minutes and seconds, hours and minutes."""
    s = seconds.cast("double")
    m, rest = F.floor(s / 60), F.floor(s % 60 + 0.5)
    short = F.concat(F.when(s < 10, _fixed(s, 2)).otherwise(_fixed(s, 1)), F.lit(" 秒"))
    return (
        F.when(s.isNull(), "—").when(s < 1, F.concat(F.floor(s * 1000 + 0.5).cast("string"), F.lit(" 毫秒"))).when(s < 60, short)
        .when(m < 60, F.format_string("%d 分 %02d 秒", m, rest)).otherwise(F.format_string("%d 时 %d 分", F.floor(m / 60), m % 60))
    )


def pixels_label(width: Column, height: Column) -> Column:
    """Width by height, with megapixels from one on; empty if either is unknown."""
    area = width.cast("double") * height / 1e6
    many = F.when(area >= 1, F.concat(F.lit(" · "), _fixed(area, 1), F.lit("MP"))).otherwise("")
    label = F.concat(width.cast("string"), F.lit("×"), height.cast("string"), many)
    return F.when((F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0), label).otherwise("")


def format_hint(ext: Column, kind: Column, mime: Column) -> Column:
    """The format to show: the extension, else the second half of the MIME type, else the type; in capitals."""
    by_mime = F.regexp_extract(F.coalesce(mime, F.lit("")), r"(?i)/([a-z0-9.+-]+)", 1)
    return F.upper(F.when((F.coalesce(ext, F.lit("")) != "") & kind.isNotNull(), ext).when(by_mime != "", by_mime).otherwise(kind))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding half towards plus infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def csv_cell(value: Column) -> Column:
    """RFC 4180: quoted when it holds a quote, comma or line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
