"""Facts of text formats: HLS playlists, DASH manifests, SVG drawings, and the XML parts of office files.

XML is read as a flat run of start tags, whatever their prefixes, as files may be cut off or not well formed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

Facts = dict[str, object]

#: How much of a manifest is read, and how many variants and languages are told.
MOST_CHARS, MOST_VARIANTS, MOST_LANGUAGES = 400 * 1024, 24, 12
#: Drawing elements, and the area up to which a simple drawing is like a glyph.
SHAPES, EFFECTS, MOVES = ("path", "circle", "rect", "ellipse", "polygon", "polyline", "line"), ("lineargradient", "radialgradient", "filter"), ("animate", "animatetransform", "set")
GLYPH_SHAPES, GLYPH_AREA = 6, 96 * 96
_ATTRIBUTE = re.compile(r'([A-Z0-9-]+)=(?:"([^"]*)"|([^",\s]*))', re.I)
_ELEMENT = re.compile(r"""<(?:[\w.-]+:)?([A-Za-z][\w.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*/?>""")
_NAMED = re.compile(r"""([\w.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_LEAF = re.compile(r"<(?:[\w.-]+:)?([A-Za-z][\w.-]*)(?:\s[^>]*)?>([^<]+)</")
_START = re.compile(r"<([A-Za-z]+)(?=[\s>/])")


def _told(facts: Facts) -> Facts:
    return {k: v for k, v in facts.items() if v}


def _best(variants: list[Facts]) -> Facts:
    """The widest variant's size, and the highest bit rate and all codecs of any."""
    widest = max(variants, key=lambda v: int(v.get("width", 0)), default={})
    codecs = dict.fromkeys(c for v in variants for c in str(v.get("codecs", "")).split(",") if c)
    return {
        "width": widest.get("width", 0), "height": widest.get("height", 0), "bitrate": max((int(v.get("bandwidth", 0)) for v in variants), default=0),
        "codec": " + ".join(codecs)[:80], "variants": len(variants), "variant_list": [_variant(v) for v in variants[:MOST_VARIANTS]],
    }


def _variant(v: Facts) -> str:
    """A variant as one line: size, bits a second, codecs, frames a second, address."""
    size = f"{v['width']}x{v['height']}" if v.get("width") else ""
    rate = f"{v['bandwidth']} bit/s" if v.get("bandwidth") else ""
    frames = f"{v['frame_rate']:g} fps" if v.get("frame_rate") else ""
    return " · ".join(x for x in (size, rate, str(v.get("codecs", "")), frames, str(v.get("url", ""))) if x)


def hls_facts(text: str) -> Facts:
    """Facts of a master or media playlist: its tags, each with its attributes and the address on the line after it."""
    lines = [x.strip() for x in text[:MOST_CHARS].splitlines()]
    tags: dict[str, list[tuple[dict[str, str], str, str]]] = {}
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        name, _, value = line.partition(":")
        if name.startswith("#EXT"):
            attributes = {k.upper(): a or b for k, a, b in _ATTRIBUTE.findall(value)}
            tags.setdefault(name.upper(), []).append((attributes, value, after if not after.startswith("#") else ""))
    variants = []
    for attributes, _, url in tags.get("#EXT-X-STREAM-INF", []):
        w, _, h = attributes.get("RESOLUTION", "").lower().partition("x")
        size = {"width": int(w), "height": int(h)} if w.isdigit() and h.isdigit() else {}
        rate = attributes.get("BANDWIDTH", "")
        variants.append(size | {"bandwidth": int(rate) if rate.isdigit() else 0, "codecs": attributes.get("CODECS", ""), "frame_rate": _real(attributes.get("FRAME-RATE", "")), "url": url[:200]})
    media = [a for a, _, _ in tags.get("#EXT-X-MEDIA", [])]
    parts = tags.get("#EXTINF", [])
    first = lambda name: next((_real(v) for _, v, _ in tags.get(name, [])), 0.0)
    return _told(_best(variants) | {
        "kind": "HLS", "audio": sum(a.get("TYPE", "").upper() == "AUDIO" for a in media), "subtitles": sum(a.get("TYPE", "").upper() == "SUBTITLES" for a in media),
        "languages": list(dict.fromkeys(a["LANGUAGE"] for a in media if a.get("LANGUAGE")))[:MOST_LANGUAGES], "segments": len(parts),
        "duration": round(sum(_real(v) for _, v, _ in parts), 3), "segment_duration": first("#EXT-X-TARGETDURATION"), "first_segment": int(first("#EXT-X-MEDIA-SEQUENCE")),
        "first_url": next((u[:200] for _, _, u in parts if u), ""), "fmp4": "#EXT-X-MAP" in tags, "live": not variants and "#EXT-X-ENDLIST" not in tags,
        "encrypted": any(a.get("METHOD", "NONE").upper() != "NONE" for a, _, _ in tags.get("#EXT-X-KEY", [])),
    })


def _real(text: str) -> float:
    m = re.match(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)", text)
    return float(m[1]) if m else 0.0


def _elements(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(local name, attributes) of the start tags."""
    for name, attributes in _ELEMENT.findall(text):
        yield name, {k: x or y for k, x, y in _NAMED.findall(attributes)}


def dash_facts(text: str) -> Facts:
    """Facts of a DASH manifest."""
    count: Counter = Counter()
    variants: list[Facts] = []
    languages: dict[str, None] = {}
    out: Facts = {"kind": "DASH"}
    held: dict[str, str] = {}
    for name, a in _elements(text[:MOST_CHARS]):
        count[name] += 1
        if name == "MPD":
            out["live"] = a.get("type") == "dynamic"
            out["duration"] = iso_seconds(a.get("mediaPresentationDuration", ""))
        elif name == "AdaptationSet":
            held = a
            languages |= {a["lang"]: None} if a.get("lang") else {}
        elif name == "Representation":
            a = held | a
            number = lambda key: int(a[key]) if a.get(key, "").isdigit() else 0  # noqa: B023, E731
            top, _, low = a.get("frameRate", "").partition("/")
            rate = _real(top) / (_real(low) or 1)
            variants.append({"width": number("width"), "height": number("height"), "bandwidth": number("bandwidth"), "codecs": a.get("codecs", ""), "frame_rate": rate})
    templates = count["SegmentTemplate"] + count["SegmentList"] + count["SegmentBase"]
    return _told(out | _best(variants) | {
        "adaptive": count["AdaptationSet"] > 0, "encrypted": count["ContentProtection"] > 0, "templates": templates, "periods": count["Period"], "languages": list(languages)[:MOST_LANGUAGES],
    })


def iso_seconds(text: str) -> float:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds."""
    m = re.fullmatch(r"P(?:([0-9.]+)D)?(?:T(?:([0-9.]+)H)?(?:([0-9.]+)M)?(?:([0-9.]+)S)?)?", text.strip())
    return round(sum(_real(x or "") * f for x, f in zip(m.groups(), (86400, 3600, 60, 1), strict=True)), 3) if m else 0.0


def playlist_facts(text: str) -> Facts:
    """Facts of an HLS playlist or a DASH manifest."""
    if re.search(r"(?i)<MPD[\s>]", text[:4000]):
        return dash_facts(text)
    return hls_facts(text) if "#EXTM3U" in text[:64] else {}


# ------------------------------------------------------------------ SVG


def _plain(text: str, most: int) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>|&[a-zA-Z]+;|&#[0-9]+;", " ", text)).strip()[:most]


def svg_facts(text: str) -> Facts:
    """Size, parts and texts of a drawing, and whether it is a sprite or like a single glyph."""
    root = re.search(r"(?i)<svg[^>]*>", text)
    if not root:
        return {}
    names = Counter(n.lower() for n in _START.findall(text))
    total = lambda wanted: sum(names[n] for n in wanted)
    own = {k.lower(): v for k, v in re.findall(r"""\s([A-Za-z]+)=["']([^"']+)["']""", root[0])}
    said = {k: re.search(rf"(?i)<{k}[^>]*>([\s\S]{{1,200}}?)</{k}>", text) for k in ("title", "desc")}
    stroke = re.search(r"""(?i)stroke\s*=\s*["']([^"'n][^"']*)["']""", text)
    sides = [_real(own.get(k, "")) for k in ("width", "height")]
    view = re.split(r"[\s,]+", own.get("viewbox", "").strip())
    if not all(sides) and len(view) == 4 and all(re.fullmatch(r"-?[0-9.]+(?:e-?[0-9]+)?", v) for v in view):
        sides = [float(view[2]), float(view[3])]
    else:
        view = []
    w, h = (int(s + 0.5) for s in sides) if all(s > 0 for s in sides) else (0, 0)
    primitives, parts = total(SHAPES) + names["use"], names["symbol"] + names["image"] + names["text"] + total(EFFECTS) + total(MOVES)
    return _told({
        "vector": True, "width": w, "height": h, "view_box": own["viewbox"] if view and w else "", "shapes": total(SHAPES), "uses": names["use"], "symbols": names["symbol"],
        "embedded_images": names["image"], "text_nodes": names["text"], "effects": total(EFFECTS), "primitives": primitives, "animated": total(MOVES) > 0, "sprite": names["symbol"] >= 2,
        "svg_title": _plain(said["title"][1], 160) if said["title"] else "", "svg_desc": _plain(said["desc"][1], 160) if said["desc"] else "",
        "stroke": _plain(stroke[1], 24) if stroke else "", "glyph_like": not parts and primitives <= GLYPH_SHAPES and w * h <= GLYPH_AREA,
    })


# ------------------------------------------------------------------ office files


def properties(xml: str) -> dict[str, str]:
    """The first text of each element, by local name."""
    out: dict[str, str] = {}
    for name, text in _LEAF.findall(xml):
        if text.strip():
            out.setdefault(name, html.unescape(re.sub(r"\s+", " ", text.strip()))[:160])
    return out


def element_counts(xml: str) -> Counter:
    """How many elements of each prefixed name start."""
    return Counter(re.findall(r"<([A-Za-z0-9]+(?::[A-Za-z0-9]+)?)(?=[\s>/])", xml))
