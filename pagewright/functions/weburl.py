"""URL resolution after the WHATWG URL standard, for http and https.

``urllib.parse.urljoin`` follows RFC 3986 and differs in back-slashes, tabs, hosts, dot segments and
percent-encoding, hence this state-free reader. Only what the package needs is here: parsing against a base,
the serialised parts, and query pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

_DEFAULT_PORTS = {"http": "80", "https": "443"}
_SPECIAL = {"http", "https", "ws", "wss", "ftp", "file"}
_ENDS = "".join(map(chr, range(0x21)))
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_PATH_KEEP = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in '"#<>?`{}')
_QUERY_KEEP = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "\"#<>'")
_USER_KEEP = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "\"#<>?`{}/:;=@[\\]^|")
_DOTS = {".", "%2e"}
_DOUBLE_DOTS = {"..", ".%2e", "%2e.", "%2e%2e"}


@dataclass(frozen=True)
class WebUrl:
    scheme: str
    user: str
    hostname: str
    port: str
    path: str
    query: str | None
    fragment: str | None = None

    @property
    def host(self) -> str:
        return f"{self.hostname}:{self.port}" if self.port else self.hostname

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}"

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def href(self) -> str:
        user = f"{self.user}@" if self.user else ""
        query = "" if self.query is None else f"?{self.query}"
        fragment = "" if self.fragment is None else f"#{self.fragment}"
        return f"{self.scheme}://{user}{self.host}{self.path}{query}{fragment}"

    def pairs(self) -> list[tuple[str, str]]:
        """Query pairs, decoded like form fields."""
        parts = [p.partition("=") for p in (self.query or "").split("&") if p]
        return [(_form(k), _form(v)) for k, _, v in parts]

    def get(self, key: str) -> str | None:
        return next((v for k, v in self.pairs() if k == key), None)


def _form(text: str) -> str:
    return percent_decoded(text.replace("+", " ").encode("utf-8", "surrogatepass")).decode("utf-8", "replace")


def percent_decoded(data: bytes) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data)


def decoded(text: str) -> str:
    """Percent-decoded text, or the text itself where that is not valid (a lone % or bad UTF-8)."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return text
    try:
        return percent_decoded(text.encode()).decode()
    except UnicodeError:
        return text


def _encoded(text: str, keep: str) -> str:
    if text.isascii() and not set(text).difference(keep):
        return text
    return "".join(
        c if c in keep else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text
    )


def _ipv4(host: str) -> str | None:
    """A host whose last label is a number as dotted decimal; None if it is not valid."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    numbers = []
    for label in labels:
        try:
            if re.fullmatch(r"0[xX][0-9a-fA-F]*", label):
                numbers.append(int(label[2:] or "0", 16))
            elif re.fullmatch(r"0[0-7]+", label):
                numbers.append(int(label, 8))
            elif re.fullmatch(r"[0-9]+", label) and not re.fullmatch(r"0[0-9]+", label):
                numbers.append(int(label))
            else:
                return None
        except ValueError:
            return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(text: str) -> str | None:
    if text.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    try:
        name = percent_decoded(text.encode("utf-8", "replace")).decode()
        name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
    except UnicodeError:
        return None
    if not name or _BAD_HOST.search(name):
        return None
    labels = name.split(".")
    last = labels[-2] if labels[-1] == "" and len(labels) > 1 else labels[-1]
    if re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", last):
        return _ipv4(name)
    return name


def _path(segments: list[str], path: str) -> str:
    """``path`` appended to already encoded segments, without dot segments."""
    out = list(segments)
    parts = re.split(r"[/\\]", path)
    for k, part in enumerate(parts):
        final = k == len(parts) - 1
        low = part.lower()
        if low in _DOUBLE_DOTS:
            if out:
                out.pop()
            if final:
                out.append("")
        elif low in _DOTS:
            if final:
                out.append("")
        else:
            out.append(_encoded(part, _PATH_KEEP))
    return "/" + "/".join(out)


def parse(text: str, base: WebUrl | None = None) -> WebUrl | None:
    """The URL, resolved against ``base``; None if it is no valid http or https URL."""
    text = re.sub(r"[\t\n\r]", "", text.strip(_ENDS))
    rest, hash_, fragment = text.partition("#")
    fragment = _encoded(fragment, _PATH_KEEP + "?{}") if hash_ else None
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", rest)
    if scheme:
        name = scheme[1].lower()
        if name not in _DEFAULT_PORTS:
            return None
        rest = rest[scheme.end() :]
        if not (base and base.scheme == name and not re.match(r"[/\\]{2}", rest)):
            return _with_authority(name, re.sub(r"^[/\\]*", "", rest), fragment)
    if base is None:
        return None
    if re.match(r"[/\\]{2}", rest):
        return _with_authority(base.scheme, re.sub(r"^[/\\]*", "", rest), fragment)
    path, mark, query = rest.partition("?")
    found = _encoded(query, _QUERY_KEEP) if mark else None
    if not path:
        return WebUrl(base.scheme, base.user, base.hostname, base.port, base.path, found if mark else base.query, fragment)
    before = [] if path[0] in "/\\" else base.path.split("/")[1:-1]
    joined = _path(before, path[1:] if path[0] in "/\\" else path)
    return WebUrl(base.scheme, base.user, base.hostname, base.port, joined, found, fragment)


def _with_authority(scheme: str, rest: str, fragment: str | None) -> WebUrl | None:
    end = re.search(r"[/\\?]", rest)
    authority, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user, at, host_port = authority.rpartition("@")
    name, password = user.partition(":")[::2]
    user = _encoded(name, _USER_KEEP) + (f":{_encoded(password, _USER_KEEP)}" if password else "")
    port = ""
    if m := re.fullmatch(r"(.*?):([0-9]*)", host_port) if not host_port.endswith("]") else None:
        host_port, port = m[1], m[2].lstrip("0") or ("0" if m[2] else "")
        if port and int(port) > 65535:
            return None
    host = _host(host_port)
    if host is None:
        return None
    path, mark, query = tail.partition("?")
    return WebUrl(
        scheme, user if at else "", host, "" if port == _DEFAULT_PORTS[scheme] else port,
        _path([], path[1:]) if path else "/", _encoded(query, _QUERY_KEEP) if mark else None, fragment,
    )


@lru_cache(maxsize=4096)
def parsed(text: str) -> WebUrl | None:
    return parse(text)


_NOT_WEB = re.compile(r"(?:javascript|vbscript|mailto|tel|callto|sms|blob|about|data):", re.I)
#: White space of web pages, as the inside of a character class.
JS_SPACE = r"\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_QUOTED = re.compile(rf"^[{JS_SPACE}\"']+|[{JS_SPACE}\"']+$")


def normalize(raw: str | None, base: str | None = None) -> str | None:
    """An absolute http or https URL without fragment, or None. Surrounding quotes and space go."""
    if not raw:
        return None
    text = _QUOTED.sub("", raw)
    if not text or _NOT_WEB.match(text):
        return None
    against = parsed(base) if base else None
    if base and against is None:
        return None
    found = parse(text, against)
    if found is None:
        return None
    return WebUrl(found.scheme, found.user, found.hostname, found.port, found.path, found.query).href


def path_of(url: str) -> str:
    """The path of a URL, or the text itself if it is none."""
    found = parsed(url)
    return found.path if found else url


def file_name(url: str) -> str:
    """The decoded last path segment (160 characters at most), else a name from the query, else empty."""
    found = parsed(url)
    if found is None:
        return ""
    parts = [p for p in found.path.split("/") if p]
    last = parts[-1] if parts else ""
    if re.search(r"%(?![0-9A-Fa-f]{2})", last):
        return ""
    last = decoded(last)
    if last and len(last) <= 160 and not re.fullmatch(r"[.:]+", last):
        return last
    named = found.get("filename") or found.get("file") or found.get("name")
    return decoded(named.split("/")[-1]) if named else ""
