"""References in style sheets: url(), image-set() strings and @import, with what the rule around them says."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagewright.functions.weburl import JS_SPACE

MOST_URLS, MOST_SETS, MOST_IMPORTS = 4000, 200, 240
_S = f"[{JS_SPACE}]"
_URL = re.compile(rf"url\({_S}*(['\"]?)", re.I)
_URL_END, _URL_CLOSE = re.compile("['\")]"), re.compile(rf"{_S}*\)")
_SET = re.compile(r"(?:-[a-z]+-)?image-set\(((?:[^()]|\([^()]*\))*)\)", re.I)
_SET_ITEM = re.compile(rf"{_S}*(['\"])([^'\"]+)\1{_S}*(?:([0-9]*\.?[0-9]+)x|([0-9]+)w)?{_S}*")
_IMPORT = re.compile(rf"@import{_S}+(?:url\({_S}*)?(['\"]?)([^'\"{JS_SPACE});,]+)\1{_S}*\)?", re.I)
_NO_URL = ("#", "blob:", "about:", "local(")


def is_data_uri(text: str) -> bool:
    return text[:5].lower() == "data:"


def without_comments(css: str) -> str:
    """Comments as blanks of the same length, so that places stay."""
    return re.sub(r"/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), css)


def rule_around(css: str, at: int) -> dict:
    """Selector, property, and what the block around a place tells."""
    opened = css.rfind("{", 0, at + 1)
    if opened < 0:
        return {"selector": "", "prop": "", "face": False, "sprite": False, "font_format": ""}
    since = max(css.rfind("}", 0, opened + 1), css.rfind(";", 0, opened + 1), 0)
    selector = css[since:opened].rpartition("{")[2]
    selector = re.sub(f"{_S}+", " ", re.sub(rf"[;{{}}]+{_S}*", " ", selector)).strip()[-140:]
    face = bool(re.search(r"@font-face\b", selector, re.I) or re.search(r"@font-face\b[^{}]*$", css[max(0, opened - 220) : opened], re.I))
    declared = re.sub(rf"^[;{{}}]+{_S}*", "", css[max(css.rfind(";", 0, at + 1), opened) : at])
    prop = re.match(rf"{_S}*(-{{0,2}}[a-zA-Z][-A-Za-z0-9_]*){_S}*:", declared)
    closed = css.find("}", at)
    block = css[opened : closed if closed >= 0 else min(len(css), at + 400)]
    named = re.search(rf"format\({_S}*['\"]?([a-z0-9.+-]+)", css[at : at + 200], re.I)
    return {
        "selector": selector,
        "prop": prop[1].lower() if prop else "",
        "face": face,
        "sprite": bool(re.search(r"background-position[^;]*?-?[0-9.]+(?:px|rem)\b", block, re.I)),
        "font_format": named[1].lower() if face and named else "",
    }


def _urls(css: str) -> Iterator[tuple[int, str, int]]:
    """(start, value, end) of each url(). The next mark that ends a value is looked for once, so runs without one stay linear."""
    at, stop = 0, -1
    for m in _URL.finditer(css):
        begin = m.end()
        if m.start() < at:
            continue
        if stop < begin:
            found = _URL_END.search(css, begin)
            if not found:
                return
            stop = found.start()
        closed = _URL_CLOSE.match(css, stop + len(m[1])) if css[stop] == (m[1] or ")") and stop > begin else None
        if closed:
            at = closed.end()
            yield m.start(), css[begin:stop], at


def css_references(css: str) -> Iterator[dict]:
    """Raw references in the order url(), image-set(), @import; data URIs included."""
    css = without_comments(css)
    for n, (begin, value, end) in enumerate(_urls(css)):
        if n == MOST_URLS:
            break
        raw = value.strip()
        if not raw or raw.startswith(_NO_URL) or re.search(rf"@import{_S}+\(?{_S}*['\"]?$", css[max(0, begin - 48) : begin], re.I):
            continue
        rule = rule_around(css, begin)
        times = re.search(rf"{_S}([0-9](?:\.[0-9]+)?)x", css[end : end + 14])
        in_set = bool(re.search(r"image-set\([^)]*$", css[max(0, begin - 260) : begin], re.I))
        hint = None
        if rule["face"] or (rule["prop"] == "src" and "font" in rule["selector"].lower() and not is_data_uri(raw)):
            hint = "font"
        elif not is_data_uri(raw) and re.search(r"cursor|\.cur\b", f"{rule['prop']} {raw}", re.I):
            hint = "icon"
        yield {"raw": raw, "kind": "url", "hint": hint, "density": float(times[1]) if times else 0.0, "image_set": in_set, **rule}
    for n, m in enumerate(_SET.finditer(css)):
        if n == MOST_SETS:
            break
        rule = rule_around(css, m.start())
        for piece in m[1].split(",") if "'" in m[1] or '"' in m[1] else ():
            item = _SET_ITEM.fullmatch(piece)
            raw = item[2].strip() if item else ""
            if raw and not raw.startswith(_NO_URL[:2]) and not raw.lower().startswith("local(") and not is_data_uri(raw):
                yield {"raw": raw, "kind": "image-set", "hint": "font" if rule["face"] else None, "density": float(item[3] or 0), "image_set": True, **rule}
    for n, m in enumerate(_IMPORT.finditer(css)):
        if n == MOST_IMPORTS:
            break
        raw = m[2].strip()
        if raw and not is_data_uri(raw) and re.fullmatch(r"[\x21-\x7e]+", raw) and raw not in ("all", "screen", "print"):
            yield {"raw": raw, "kind": "import", "hint": "stylesheet", "density": 0.0, "image_set": False, "selector": "", "prop": "", "face": False, "sprite": False, "font_format": ""}


def parse_srcset(value: str, most: int = 200) -> list[tuple[str, float, float]]:
    """(url, density, width) candidates; commas of data URIs and of queries belong to the URL."""
    out: list[tuple[str, float, float]] = []
    at, rounds = 0, 0
    while rounds < most:
        rounds += 1
        at += len(value[at:]) - len(value[at:].lstrip(" \t\n\r\f,"))
        if at >= len(value):
            break
        begin = at
        while at < len(value) and value[at] not in " \t\n\r\f":
            so_far = value[begin:at]
            if value[at] == "," and not (is_data_uri(so_far) or (re.search("[?&;]", so_far) and not re.search("[(),]", so_far))):
                break
            at += 1
        url = value[begin:at].rstrip(",")
        rest = re.match(r"""(?:[^,()"']|"[^"]*"?|'[^']*'?|\((?:[^()"']|"[^"]*"?|'[^']*'?|\([^()]*\))*\)?|\))*""", value[at:])
        words = rest[0].split()
        at += rest.end()
        if not url:
            continue
        density = width = 0.0
        for word in words:
            if m := re.fullmatch(r"([0-9]*\.?[0-9]+)([wx])", word, re.I):
                density, width = (float(m[1]), width) if m[2] in "xX" else (density, float(m[1]))
        out.append((url, density, width))
        if at >= len(value):
            break
    return out


def parse_data_uri(raw: str) -> dict | None:
    """mime, base64, data and approximate bytes of a data URI."""
    head, comma, data = raw[5:].partition(",")
    data = re.sub(f"{_S}+", "", data)
    mime, base64 = head.split(";")[0].strip().lower(), ";base64" in head.lower()
    if not comma or len(head) > 220 or (not base64 and not mime) or len(data) < 8:
        return None
    return {"mime": mime or "application/octet-stream", "base64": base64, "data": data, "bytes": len(data) * 3 // 4 if base64 else len(data)}
