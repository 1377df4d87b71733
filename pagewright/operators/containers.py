"""Facts of MP4, AVI and FLV files and of ID3 tags, from a file's first bytes and, where they are at hand, its last.

A file's boxes or chunks are first read as a flat list of (path, start, end); facts are then looked up by path. What is cut off
or broken gives no facts.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

Facts = dict[str, object]

#: Boxes that hold boxes, with the bytes before the first of them.
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"udta": 0, b"meta": 4, b"ilst": 0, b"mvex": 0, b"moof": 0}
#: Names of codecs by their four characters.
CODECS = {
    "avc1": "H.264", "avc3": "H.264", "hev1": "H.265", "hvc1": "H.265", "vvc1": "H.266", "mp4v": "MPEG-4 Part 2", "h263": "H.263", "vp08": "VP8", "vp09": "VP9",
    "av01": "AV1", "mp4a": "AAC", ".mp3": "MP3", "ac-3": "AC-3", "ec-3": "E-AC-3", "alac": "ALAC", "samr": "AMR-NB", "sawb": "AMR-WB", "Opus": "Opus",
    "fLaC": "FLAC", "sowt": "PCM", "twos": "PCM", "lpcm": "PCM",
}
AVI_CODECS = {
    "CVID": "Cinepak", "IV50": "Intel Indeo 5", "MJPG": "Motion JPEG", "DIVX": "DivX", "DX50": "DivX 5", "XVID": "Xvid", "H264": "H.264", "x264": "H.264",
    "avc1": "H.264", "mp4s": "MPEG-4", "WMV2": "WMV 2", "HFYU": "Huffyuv",
}
#: The facts that tags are.
ILST = {
    b"\xa9nam": "title", b"\xa9ART": "creator", b"\xa9alb": "album", b"\xa9day": "year", b"\xa9gen": "genre", b"\xa9cmt": "comment", b"\xa9too": "software",
    b"aART": "album_artist", b"cprt": "copyright", b"covr": "cover",
}
ID3_FRAMES = {
    "TIT2": "title", "TT2": "title", "TPE1": "creator", "TP1": "creator", "TPE2": "album_artist", "TP2": "album_artist", "TALB": "album", "TAL": "album",
    "TYER": "year", "TYE": "year", "TDRC": "year", "TCON": "genre", "TCO": "genre", "TPOS": "disc", "TPA": "disc", "TRCK": "track", "TRK": "track",
    "APIC": "cover", "PIC": "cover", "COMM": "comment", "COM": "comment", "TCOP": "copyright", "TPUB": "publisher", "TSSE": "software", "TENC": "encoded_by",
    "TLEN": "milliseconds", "TPE3": "conductor", "WOAR": "link", "WXXX": "link",
}
AVI_INFO = {b"INAM": "title", b"IART": "creator", b"ISFT": "software", b"ICOP": "copyright"}
#: The genres of ID3v1 in their order.
GENRES = (
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae",
    "Rock", "Techno", "Industrial", "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion",
    "Trance", "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise", "Alternative Rock", "Bass", "Soul", "Punk", "Space", "Meditative",
    "Instrumental Pop", "Instrumental Rock", "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic", "Pop-Folk", "Eurodance", "Dream", "Southern Rock",
    "Comedy", "Cult", "Gangsta", "Top 40", "Christian Rap", "Pop/Funk", "Jungle", "Native American", "Cabaret", "New Wave", "Psychedelic", "Rave", "Showtunes",
    "Trailer", "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock",
)
#: Seconds from 1904, where QuickTime begins, to 1970.
MAC_EPOCH = 2082844800
_TAG_TEXT = 160


def _number(fmt: str, b: bytes, at: int) -> int | float:
    return struct.unpack_from(fmt, b, at)[0] if 0 <= at <= len(b) - struct.calcsize(fmt) else 0


def _u32(b: bytes, at: int) -> int:
    return int(_number(">I", b, at))


def _text(raw: bytes, encoding: str = "utf-8") -> str:
    return re.sub(r"[\x00-\x1f]+", " ", raw.decode(encoding, "replace")).strip()[:_TAG_TEXT]


def when(seconds: int) -> str:
    """A QuickTime time as ISO date and time; empty before 1970 and for none."""
    from datetime import UTC, datetime

    if seconds <= MAC_EPOCH:
        return ""
    try:
        return datetime.fromtimestamp(seconds - MAC_EPOCH, UTC).strftime("%Y-%m-%d %H:%M:%S")
    except (ValueError, OverflowError, OSError):
        return ""


# ------------------------------------------------------------------ ISO media


def boxes(b: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body, end) of all boxes, in file order, holders before what they hold."""
    end = len(b) if end is None else end
    while at + 8 <= end and len(path) < 9:
        size, body = _u32(b, at), at + 8
        if size == 1:
            size, body = int(_number(">Q", b, at + 8)), at + 16
        stop = end if size == 0 else min(end, at + size)
        if stop < body:
            return
        own = (*path, b[at + 4 : at + 8])
        yield own, body, stop
        if own[-1] in HOLDERS:
            yield from boxes(b, body + HOLDERS[own[-1]], stop, own)
        elif path and path[-1] == b"ilst":
            yield from boxes(b, body, stop, own)
        at = stop


def _track(b: bytes, parts: list[tuple[bytes, int, int]]) -> Facts:
    """Facts of one track from its boxes (name, body, end)."""
    out: Facts = {}
    at = {name: (body, stop) for name, body, stop in reversed(parts)}
    if b"hdlr" in at:
        out["kind"] = b[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]
    if b"tkhd" in at:
        body, stop = at[b"tkhd"]
        matrix = body + (52 if b[body] == 1 else 40)
        across, down = int(_number(">i", b, matrix)), int(_number(">i", b, matrix + 4))
        w, h = _u32(b, stop - 8) / 65536, _u32(b, stop - 4) / 65536
        turn = round(math.degrees(math.atan2(down, across))) if across or down else 0
        if 0 < w < 20000 and 0 < h < 20000:
            out["width"], out["height"] = (int(x + 0.5) for x in ((h, w) if abs(abs(turn) - 90) < 20 else (w, h)))
        out["rotation"] = 90 * round(turn / 90) % 360
    if b"mdhd" in at:
        body, _ = at[b"mdhd"]
        wide = b[body] == 1
        out["scale"] = _u32(b, body + (20 if wide else 12))
        length = int(_number(">Q", b, body + 24)) if wide else _u32(b, body + 16)
        out["seconds"] = length / out["scale"] if out["scale"] else 0.0
    if b"stts" in at and out.get("scale"):
        step = _u32(b, at[b"stts"][0] + 12)
        out["rate"] = out["scale"] / step if step else 0.0
    if b"stsd" in at:
        entry = at[b"stsd"][0] + 8
        code = b[entry + 4 : entry + 8].decode("latin-1")
        out["codec"] = CODECS.get(code, code.strip())
        out["encrypted"] = b.find(b"sinf", entry, min(len(b), entry + 400)) >= 0
        if out.get("kind") == b"soun":
            out |= {"channels": int(_number(">H", b, entry + 24)), "bit_depth": int(_number(">H", b, entry + 26)), "sample_rate": _u32(b, entry + 32) >> 16}
        elif out.get("kind") == b"vide" and not out.get("width"):
            out |= {"width": int(_number(">H", b, entry + 32)), "height": int(_number(">H", b, entry + 34))}
    return out


def _movie(b: bytes, found: list[tuple[tuple[bytes, ...], int, int]]) -> Facts:
    out: Facts = {}
    tracks: list[list[tuple[bytes, int, int]]] = []
    tag = b""
    for path, body, stop in found:
        name = path[-1]
        if name == b"trak":
            tracks.append([])
        elif b"trak" in path and tracks:
            tracks[-1].append((name, body, stop))
        elif name == b"mvhd":
            wide = b[body] == 1
            made, changed = (int(_number(">Q" if wide else ">I", b, body + 4 + (8 if wide else 4) * k)) for k in (0, 1))
            scale = _u32(b, body + (20 if wide else 12))
            length = int(_number(">Q", b, body + 24)) if wide else _u32(b, body + 16)
            out |= {"created": when(made), "modified": when(changed), "duration": round(length / scale, 2) if scale else 0}
        elif name in (b"mvex", b"moof"):
            out["fragmented"] = True
        elif len(path) > 1 and path[-2] == b"ilst":
            tag = name
        elif name == b"data" and tag in ILST:
            fact = ILST[tag]
            value = True if fact == "cover" else _text(b[body + 8 : stop])
            if value:
                out.setdefault(fact, value)
        elif len(path) > 1 and path[-2] == b"udta" and name in ILST and name != b"covr":
            out.setdefault(ILST[name], _text(b[body + 4 : stop]))
    known = [_track(b, t) for t in tracks]
    video = max((t for t in known if t.get("kind", b"vide") == b"vide"), key=lambda t: int(t.get("width", 0)) * int(t.get("height", 0)), default={})
    audio = next((t for t in known if t.get("kind") == b"soun"), {})
    out |= {k: video[k] for k in ("width", "height", "rotation") if video.get(k)}
    out |= {k: audio[k] for k in ("channels", "bit_depth", "sample_rate") if audio.get(k)}
    if 0.5 < float(video.get("rate", 0)) < 1000:
        out["frame_rate"] = round(float(video["rate"]), 3)
    out["duration"] = out.get("duration") or round(float(video.get("seconds") or audio.get("seconds") or 0), 2)
    out["tracks"] = len(known)
    out["encrypted"] = any(t.get("encrypted") for t in known)
    out["codec"] = " + ".join(dict.fromkeys(str(t["codec"]) for t in (video, audio, *known) if t.get("codec")))
    return out


def mp4_facts(b: bytes, tail: bytes = b"") -> Facts:
    """Facts of MP4, M4A and QuickTime files; ``tail`` is where the movie box of files that were not made for streaming is."""
    found = list(boxes(b))
    out: Facts = {}
    tops = {path[0]: body for path, body, _ in reversed(found) if len(path) == 1}
    if b"ftyp" in tops:
        at = tops[b"ftyp"]
        out["brand"] = _text(b[at : at + 4])
    if b"moov" in tops and b"mdat" in tops:
        out["fast_start"] = tops[b"moov"] < tops[b"mdat"]
    movie = _movie(b, found)
    at = tail.find(b"moov")
    while not movie.get("tracks") and at >= 4:
        movie |= {k: v for k, v in _movie(tail, list(boxes(tail, at - 4))).items() if v}
        at = tail.find(b"moov", at + 4)
    return {k: v for k, v in (out | movie).items() if v or k == "fast_start"}


# ------------------------------------------------------------------ AVI, FLV


def avi_facts(b: bytes) -> Facts:
    """Facts of the main header, of the stream headers and formats, and of the INFO list."""
    number = lambda at: int(_number("<I", b, at))
    out: Facts = {}
    at = b.find(b"avih", 0, 8192)
    if at >= 0:
        step, frames = number(at + 8), number(at + 24)
        out |= {"width": number(at + 40), "height": number(at + 44), "tracks": number(at + 32), "frames": frames}
        if step:
            out |= {"frame_rate": round(1e6 / step, 3), "duration": round(frames * step / 1e6, 2)}
    for m in re.finditer(rb"strh.{4}(vids|auds)(.{4})", b[:16384], re.S):
        scale, rate = number(m.start() + 28), number(m.start() + 32)
        if m[1] == b"vids":
            code = m[2].decode("latin-1").strip("\0 ")
            out["codec"] = AVI_CODECS.get(code, code)
            if scale and rate:
                out.setdefault("frame_rate", round(rate / scale, 3))
        elif scale and rate:
            out["sample_rate"] = round(rate / scale)
    at = b.find(b"strf", 0, 16384)
    if at >= 0 and number(at + 8) >= 40:
        out["bit_depth"] = int(_number("<H", b, at + 22))
    for name, fact in AVI_INFO.items():
        at = b.find(name, 0, 262144)
        if at >= 0:
            out[fact] = _text(b[at + 8 : at + 8 + min(_TAG_TEXT, number(at + 4))])
    return {k: v for k, v in out.items() if v}


def _amf(b: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """An AMF0 value and where it ends."""
    kind, at = b[at], at + 1
    if kind == 0:
        return _number(">d", b, at), at + 8
    if kind == 1:
        return bool(b[at]), at + 1
    if kind in (2, 12):
        wide = 4 if kind == 12 else 2
        size = int.from_bytes(b[at : at + wide], "big")
        return b[at + wide : at + wide + size].decode("utf-8", "replace"), at + wide + size
    if kind in (3, 8) and depth < 5:
        found: dict[str, object] = {}
        at += 4 if kind == 8 else 0
        while b[at : at + 3] != b"\0\0\x09":
            size = int.from_bytes(b[at : at + 2], "big")
            name = b[at + 2 : at + 2 + size].decode("utf-8", "replace")
            found[name], at = _amf(b, at + 2 + size, depth + 1)
        return found, at + 3
    if kind == 10 and depth < 5:
        items, n, at = [], int.from_bytes(b[at : at + 4], "big"), at + 4
        for _ in range(min(n, 100_000)):
            item, at = _amf(b, at, depth + 1)
            items.append(item)
        return items, at
    if kind == 11:
        return _number(">d", b, at), at + 10
    return None, at


def flv_facts(b: bytes) -> Facts:
    """The metadata that the first script tag holds, and which streams the header names."""
    out: Facts = {"has_audio": bool(b[4] & 4), "has_video": bool(b[4] & 1)}
    at = int.from_bytes(b[5:9], "big") + 4
    for _ in range(12):
        size = int.from_bytes(b[at + 1 : at + 4], "big")
        if at + 11 + size > len(b):
            break
        if b[at] & 31 == 18:
            _, begin = _amf(b, at + 11)
            told, _ = _amf(b, begin)
            told = told if isinstance(told, dict) else {}
            names = {"width": "width", "height": "height", "audiosamplerate": "sample_rate"}
            out |= {fact: int(told[name]) for name, fact in names.items() if isinstance(told.get(name), float)}
            out |= {fact: round(told[name], 2) for name, fact in (("duration", "duration"), ("framerate", "frame_rate")) if isinstance(told.get(name), float)}
            out |= {fact: str(told[name])[:_TAG_TEXT] for name, fact in (("encoder", "software"), ("title", "title")) if told.get(name)}
            break
        at += 15 + size
    return {k: v for k, v in out.items() if v}


# ------------------------------------------------------------------ ID3


def genre(value: str) -> str:
    """A genre given by number, by number in brackets with a refinement, or by name."""
    m = re.fullmatch(r"\((\d+)\)\s*(.*)|(\d{1,3})", value.strip(), re.S)
    if not m:
        return value.strip()[:60]
    number = int(m[1] or m[3])
    name = GENRES[number] if number < len(GENRES) else ("" if m[1] else m[3])
    return (name + (f" / {m[2]}" if m[2] else ""))[:60]


def _seven(raw: bytes) -> int:
    """A size of seven bits a byte."""
    return sum((c & 0x7F) << 7 * (len(raw) - 1 - k) for k, c in enumerate(raw))


def id3_facts(head: bytes, tail: bytes = b"") -> Facts:
    """Frames of ID3v2.2 to 2.4 at the head, and what they lack from an ID3v1 tag at the end."""
    out: Facts = {}
    if head[:3] == b"ID3" and len(head) > 10:
        version = head[3]
        name_size = 3 if version == 2 else 4
        at, end = 10, min(len(head), 10 + _seven(head[6:10]))
        if version > 2 and head[5] & 0x40:
            at += _seven(head[10:14]) if version == 4 else 4 + _u32(head, 10)
        while at + 2 * name_size <= end and re.fullmatch(rb"[A-Z0-9]{3,4}", head[at : at + name_size]):
            raw = head[at + name_size : at + 2 * name_size]
            size = _seven(raw) if version == 4 else int.from_bytes(raw, "big")
            body = at + (6 if version == 2 else 10)
            fact = ID3_FRAMES.get(head[at : at + name_size].decode("latin-1"))
            data = head[body : body + size]
            at = body + size
            if size <= 0 or at > len(head):
                break
            if fact == "cover":
                out["cover"] = True
            elif fact == "link":
                out.setdefault("link", _text(data.split(b"\0")[-1], "latin-1"))
            elif fact:
                text = data[4:] if fact == "comment" else data[1:]
                encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
                value = _text(text, encoding)
                if value:
                    out.setdefault(fact, value)
    last = tail or head
    if last[-128:-125] == b"TAG":
        tag = last[-128:]
        plain = {"title": tag[3:33], "creator": tag[33:63], "album": tag[63:93], "year": tag[93:97], "comment": tag[97:125]}
        for fact, raw in plain.items():
            if value := _text(raw, "latin-1")[:60]:
                out.setdefault(fact, value)
        if tag[125] == 0 and tag[126]:
            out.setdefault("track", str(tag[126]))
        if tag[127] < len(GENRES):
            out.setdefault("genre", GENRES[tag[127]])
    if ms := str(out.pop("milliseconds", "")):
        digits = re.sub(r"\D", "", ms)
        out |= {"duration": round(int(digits) / 1000, 3)} if digits and int(digits) else {}
    if "genre" in out:
        out["genre"] = genre(str(out["genre"]))
    if "year" in out:
        out["year"] = str(out["year"])[:4]
    return {k: v for k, v in out.items() if v}
