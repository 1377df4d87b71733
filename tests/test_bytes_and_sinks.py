"""Byte probing on generated files, sources with a fake network, exports, streams and selections."""

import gzip
import io
import struct
import threading
import zipfile

from pyspark.sql import functions as F

from pagewright.functions.types import mime_col
from pagewright.operators import export, joins, probe, stats, view
from pagewright.sources import documents as docs
from pagewright.streaming import events, pages


def png(w, h, extra=b""):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + extra + chunk(b"IEND", b"")


def wav(seconds=5.5, rate=44100):
    data = bytes(int(seconds * rate) * 4)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(data)) + data


def webp():
    anim = b"ANIM" + struct.pack("<IIH", 6, 0, 3)
    frame = b"ANMF" + struct.pack("<I", 16) + bytes(12) + (100).to_bytes(3, "little") + b"\0"
    body = b"VP8X" + struct.pack("<I", 10) + bytes([2, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + anim + frame * 3
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def mp4():
    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 12500) + bytes(80))
    tkhd = box(b"tkhd", bytes(40) + struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30) + struct.pack(">II", 640 << 16, 360 << 16))
    stsd = box(b"stsd", bytes(8) + struct.pack(">I", 16) + b"avc1" + bytes(60))
    return box(b"ftyp", b"isom" + bytes(8)) + box(b"moov", mvhd + box(b"trak", tkhd + box(b"mdia", box(b"minf", box(b"stbl", stsd)))))


def mkv():
    def element(ident, data):
        return bytes.fromhex(ident) + bytes([0x40 | len(data) >> 8, len(data) & 255]) + data

    info = element("1549a966", element("2ad7b1", struct.pack(">I", 1_000_000)) + element("4489", struct.pack(">d", 4000.0)) + element("7ba9", b"Name"))
    video = element("e0", element("b0", struct.pack(">H", 320)) + element("ba", struct.pack(">H", 240)))
    return element("1a45dfa3", b"") + element("18538067", info + element("1654ae6b", element("ae", element("86", b"V_VP9") + video)))


def mp3():
    frames = b"TIT2" + struct.pack(">IH", 5, 0) + b"\0Song" + b"TPE1" + struct.pack(">IH", 6, 0) + b"\0Maker"
    size = len(frames)
    head = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127])
    return head + frames + b"\xff\xfb\x90\x00" + bytes(16000 - 4)


def test_signatures():
    cases = {
        png(1, 1): "png", b"\xff\xd8\xff\xe0": "jpg", b"GIF89a": "gif", webp(): "webp", wav(0.1): "wav", mp4(): "mp4", mkv(): "webm", mp3(): "mp3", b"%PDF-1.7": "pdf", b"PK\x03\x04": "zip", b"7z\xbc\xaf\x27\x1c": "7z",
        b"\x1f\x8b\x08": "gz", b"wOF2": "woff2", b"<?xml version": "xml", b"<svg >": "svg", b"#EXTM3U\n": "m3u8", b' {"a"': "json", b"WEBVTT": "vtt", b"1\n00:00:01,000 --> 00": "srt", bytes(257) + b"ustar": "tar",
        b"<MPD >": "mpd", b"": None, b"zzz": None, b"\0\0\1\0" + bytes(20): "ico",
    }
    assert {k: probe.detect(k).get("ext") for k in cases} == cases
    assert probe.looks_textual(b"plain\n") and not probe.looks_textual(b"a\0b") and not probe.looks_textual(b"\x01\x02")


def test_images():
    anim = struct.pack(">I", 8) + b"acTL" + struct.pack(">II", 2, 0) + b"\0\0\0\0" + (struct.pack(">I", 26) + b"fcTL" + bytes(20) + struct.pack(">HH", 1, 10) + b"\0\0" + b"\0\0\0\0") * 2
    assert {k: probe.image_facts(png(1920, 1080))[k] for k in ("width", "height", "alpha", "channels")} == {"width": 1920, "height": 1080, "alpha": True, "channels": 4}
    assert probe.image_facts(png(4, 4, anim))["frames"] == 2 and probe.image_facts(png(4, 4, anim))["duration"] == 0.2
    assert probe.total(probe.image_facts, png(1920, 1080)[:64])["width"] == 1920
    found = probe.image_facts(webp())
    assert (found["width"], found["height"], found["frames"], found["loops"], found["duration"]) == (100, 50, 3, 3, 0.3)
    svg = b'<svg width="320" height="120"><text>x</text></svg>'
    assert probe.image_facts(svg)["width"] == 320 and "glyph_like" not in probe.image_facts(svg)
    assert probe.image_facts(b'<svg viewBox="0 0 16 16"><path d="M1 1"/></svg>')["glyph_like"]
    assert probe.image_facts(gzip.compress(svg))["transport"] == "gzip"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + bytes(20)
    assert {k: probe.image_facts(jpeg)[k] for k in ("width", "height", "progressive", "channels")} == {"width": 40, "height": 30, "progressive": True, "channels": 3}
    ico = struct.pack("<HHH", 0, 1, 2) + bytes([16, 16]) + bytes(14) + bytes([0, 0]) + bytes(14)
    assert probe.image_facts(ico)["width"] == 256 and probe.image_facts(ico)["sizes"] == ["16×16", "256×256"]
    assert probe.image_facts(b"8BPS" + bytes([0, 1]) + bytes(6) + struct.pack(">HIIH", 3, 20, 10, 8))["height"] == 20
    assert probe.image_facts(b"P6 # c\n7 9\n255\n")["height"] == 9


def test_media():
    found = probe.media_facts(wav())
    assert (found["duration"], found["channels"], found["sample_rate"]) == (5.5, 2, 44100)
    found = probe.media_facts(mp4())
    assert (found["width"], found["height"], found["duration"], found["codec"]) == (640, 360, 12.5, "H.264")
    found = probe.media_facts(mkv())
    assert (found["width"], found["duration"], found["codec"], found["title"]) == (320, 4.0, "VP9", "Name")
    found = probe.media_facts(mp3())
    assert (found["title"], found["creator"], found["bitrate"], found["duration"]) == ("Song", "Maker", 128000, 1.0)
    flac = b"fLaC\0\0\0\x22" + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 441000).to_bytes(8, "big") + bytes(16)
    assert probe.media_facts(flac)["duration"] == 10.0 and probe.media_facts(flac)["channels"] == 2
    for whole in (wav(0.1), mp4(), mkv(), mp3(), flac):
        for cut in (0, 1, 5, 13, 20, 40, len(whole) // 2):
            probe.total(probe.media_facts, whole[:cut])


def test_documents_and_playlists():
    pdf = b"%PDF-1.4\n1 0 obj<</Type /Pages /Count 2>> /MediaBox [0 0 595 842] /Title <FEFF00540069> /Author (Me) /CreationDate (D:20240501120000)"
    found = probe.pdf_facts(pdf)
    assert (found["pages"], found["page_size"], found["title"], found["creator"], found["created"]) == (2, "A4", "Ti", "Me", "2024-05-01")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w/>")
        z.writestr("docProps/core.xml", "<dc:title>Doc</dc:title><dc:creator>Me</dc:creator>")
        z.writestr("docProps/app.xml", "<Pages>3</Pages><Words>99</Words>")
    found = probe.office_facts(out.getvalue())
    assert (found["flavor"], found["title"], found["pages"], found["words"]) == ("docx", "Doc", 3, 99)
    assert probe.detect(out.getvalue())["label"].startswith("Word") and len(probe.zip_listing(out.getvalue())) == 3
    master = "#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,LANGUAGE=\"zh\"\n#EXT-X-STREAM-INF:BANDWIDTH=100,RESOLUTION=640x360\na\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=1920x1080\nb"
    listed = ["640x360 · 100 bit/s · a", "1920x1080 · 900 bit/s · b"]
    assert probe.playlist_facts(master) == {"kind": "HLS", "variants": 2, "variant_list": listed, "bitrate": 900, "width": 1920, "height": 1080, "audio": 1, "languages": ["zh"]}
    media = "#EXTM3U\n#EXT-X-TARGETDURATION:10\n#EXT-X-MEDIA-SEQUENCE:10482\n#EXT-X-MAP:URI=\"i.mp4\"\n#EXT-X-KEY:METHOD=AES-128\n#EXTINF:5,\nx.ts\n#EXTINF:10.0,\ny\n#EXT-X-ENDLIST"
    assert probe.playlist_facts(media) == {"kind": "HLS", "segments": 2, "duration": 15.0, "first_segment": 10482, "first_url": "x.ts", "segment_duration": 10.0, "fmp4": True, "encrypted": True}
    assert probe.playlist_facts("#EXTM3U\n#EXT-X-STREAM-INF:CODECS=\"avc1,mp4a\",FRAME-RATE=25.0,BANDWIDTH=7\nq")["codec"] == "avc1 + mp4a"
    mpd = '<MPD mediaPresentationDuration="PT1M36.5S"><Period><Representation bandwidth="5" width="640"/><Representation bandwidth="9" width="1280"/></Period></MPD>'
    assert probe.playlist_facts(mpd) == {"kind": "DASH", "variants": 2, "variant_list": ["640x0 · 5 bit/s", "1280x0 · 9 bit/s"], "duration": 96.5, "width": 1280, "bitrate": 9, "periods": 1}
    mpd = '<MPD type="dynamic"><Period><AdaptationSet lang="zh" codecs="vp9"><SegmentTemplate/><ContentProtection/><Representation frameRate="50/2" bandwidth="5"/>'
    assert probe.playlist_facts(mpd) == {"kind": "DASH", "live": True, "variants": 1, "variant_list": ["5 bit/s · vp9 · 25 fps"], "bitrate": 5, "codec": "vp9", "adaptive": True, "encrypted": True, "templates": 1, "periods": 1, "languages": ["zh"]}


def test_office_properties():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='a'/><sheet name='b'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>x</t></si><si/></sst>")
        z.writestr("xl/media/pic.png", "x")
        z.writestr("docProps/core.xml", '<cp:core xmlns:dc="d"><dc:title>A &amp; B</dc:title><dc:subject>S</dc:subject><cp:lastModifiedBy>Me</cp:lastModifiedBy><dcterms:created a="b">2024</dcterms:created>')
    found = probe.office_facts(out.getvalue())
    assert (found["flavor"], found["sheets"], found["text_cells"], found["media_files"]) == ("xlsx", 2, 2, 1)
    assert (found["title"], found["subject"], found["modified_by"], found["created"]) == ("A & B", "S", "Me", "2024")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p>a b</w:p><w:p/><w:drawing></w:drawing>")
    found = probe.office_facts(out.getvalue())
    assert (found["paragraphs"], found["images"], found["text_chars"]) == (2, 1, 2)


def test_movie_details():
    box = lambda name, *data: struct.pack(">I", 8 + sum(map(len, data))) + name + b"".join(data)
    mvhd = box(b"mvhd", bytes(4), struct.pack(">4I", 2082844800 + 86400, 0, 600, 6000), bytes(80))
    turned = struct.pack(">9i", 0, 65536, 0, -65536, 0, 0, 0, 0, 1 << 30)
    tkhd = box(b"tkhd", bytes(40), turned, struct.pack(">II", 640 << 16, 360 << 16))
    hdlr = lambda kind: box(b"hdlr", bytes(8), kind, bytes(12))
    mdhd = box(b"mdhd", bytes(12), struct.pack(">II", 30000, 300000), bytes(4))
    video = box(b"stbl", box(b"stsd", bytes(8), struct.pack(">I", 16), b"avc1", bytes(60)), box(b"stts", bytes(4), struct.pack(">3I", 1, 300, 1001)))
    sound = box(b"stbl", box(b"stsd", bytes(8), struct.pack(">I", 36), b"mp4a", bytes(16), struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16)))
    trak = lambda kind, table: box(b"trak", tkhd, box(b"mdia", mdhd, hdlr(kind), box(b"minf", table)))
    tag = lambda name, value: box(name, box(b"data", bytes(8), value))
    tags = box(b"udta", box(b"meta", bytes(4), box(b"ilst", tag(b"\xa9nam", "Nämé".encode()), tag(b"\xa9gen", b"Jazz"), tag(b"covr", b"png"))))
    moov = box(b"moov", mvhd, trak(b"vide", video), trak(b"soun", sound), tags, box(b"mvex"))
    start, data = box(b"ftyp", b"isom", bytes(4)), box(b"mdat", bytes(50))
    found = probe.media_facts(start + moov + data)
    assert (found["width"], found["height"], found["rotation"], found["frame_rate"], found["duration"]) == (360, 640, 90, 29.97, 10.0)
    assert (found["codec"], found["channels"], found["sample_rate"], found["tracks"]) == ("H.264 + AAC", 2, 44100, 2)
    assert (found["title"], found["genre"], found["cover"], found["created"], found["fast_start"], found["fragmented"]) == ("Nämé", "Jazz", True, "1970-01-02 00:00:00", True, True)
    assert not probe.media_facts(start + data + moov)["fast_start"]
    late = probe.media_facts(start + data, tail=b"xx" + moov)
    assert late["frame_rate"] == 29.97 and late["title"] == "Nämé"
    whole = start + moov + data
    for cut in range(0, len(whole), 7):
        probe.total(probe.media_facts, whole[:cut])


def test_tags():
    from pagewright.operators.containers import avi_facts, flv_facts, genre, id3_facts

    old = b"TAG" + b"Name".ljust(30, b"\0") + b"By".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\x07\x08"
    assert id3_facts(b"", old) == {"title": "Name", "creator": "By", "album": "Album", "year": "1999", "comment": "c", "track": "7", "genre": "Jazz"}
    assert (genre("(17)"), genre("(8)Bebop"), genre("13"), genre("Own"), genre("250")) == ("Rock", "Jazz / Bebop", "Pop", "Own", "250")
    frame = lambda name, body: name + struct.pack(">IH", len(body), 0) + body
    frames = frame(b"TCON", b"\0(17)") + frame(b"TLEN", b"\0" + b"678") + frame(b"COMM", b"\0engnote") + frame(b"APIC", b"x") + frame(b"TRCK", b"\x03" + "3/9".encode())
    head = b"ID3\x03\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames
    assert id3_facts(head) == {"genre": "Rock", "duration": 0.678, "comment": "note", "cover": True, "track": "3/9"}
    amf = b"\x02\0\x0aonMetaData\x08\0\0\0\2\0\x08duration\0" + struct.pack(">d", 2.5) + b"\0\x07encoder\x02\0\x02me\0\0\x09"
    flv = b"FLV\x01\x05" + struct.pack(">I", 9) + bytes(4) + b"\x12" + len(amf).to_bytes(3, "big") + bytes(7) + amf
    assert flv_facts(flv) == {"has_audio": True, "has_video": True, "duration": 2.5, "software": "me"}
    strh = b"strh" + bytes(4) + b"vidsXVID" + bytes(12) + struct.pack("<II", 1, 25) + b"INAM" + struct.pack("<I", 4) + b"Film"
    assert avi_facts(b"RIFF" + bytes(4) + b"AVI " + strh) == {"codec": "Xvid", "frame_rate": 25.0, "title": "Film"}


def test_drawings():
    found = probe.svg_facts('<svg width="32" height="20px"><title>A <b>mark</b></title><desc>d</desc><path stroke="red"/><use/><linearGradient/></svg>')
    assert found == {"vector": True, "width": 32, "height": 20, "shapes": 1, "uses": 1, "effects": 1, "primitives": 2, "svg_title": "A mark", "svg_desc": "d", "stroke": "red"}
    assert probe.svg_facts('<svg viewBox="0 0 16 16"><path/></svg>') == {"vector": True, "width": 16, "height": 16, "view_box": "0 0 16 16", "shapes": 1, "primitives": 1, "glyph_like": True}
    assert probe.svg_facts("none") == {}


def test_fonts():
    name = "Lab Icon Glyphs".encode("utf-16-be")
    names = struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0x409, 1, len(name), 0) + name
    tables = {b"maxp": bytes(4) + struct.pack(">H", 64), b"head": bytes(18) + struct.pack(">H", 1000), b"OS/2": bytes(4) + struct.pack(">H", 600), b"name": names}
    at, head, body = 12 + 16 * len(tables), b"", b""
    for tag, data in tables.items():
        head += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    found = probe.font_facts(b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0) + head + body)
    assert (found["glyphs"], found["units_per_em"], found["weight"], found["font_name"], found["icon_font"]) == (64, 1000, 600, "Lab Icon Glyphs", True)


def test_probe_columns(spark):
    df = spark.createDataFrame([(1, png(30, 20), "image"), (2, wav(0.5), "audio"), (3, None, "image"), (4, b"zz", "other")], "id int, body binary, type string").withColumn("ext", F.lit("gif"))
    rows = {r["id"]: r for r in probe.probed(df).collect()}
    assert rows[1]["image"]["width"] == 30 and rows[1]["ext_corrected"] == "gif" and rows[2]["media"]["duration"] == 0.5
    assert rows[3]["sig"] is None and rows[4]["type"] == "other"
    assert probe.zip_entries(spark.createDataFrame([(1, b"no")], "id int, body binary"), "id", "body").count() == 0
    assert spark.range(1).select(mime_col(F.lit("image"), F.lit(".jpg")).alias("m")).first()["m"] == "image/jpeg"


def test_sources(spark, tmp_path):
    table = {"http://a/": docs.Response(200, "text/html; charset=gbk", "中文".encode("gbk"), 4, "http://a/x"), "http://b/": docs.Response(404), "http://c/": docs.Response(200, "text/plain", b"x" * 50, 50)}
    fetch = lambda url, most, seconds: table.get(url, docs.Response(0, error="timed out"))
    urls = spark.createDataFrame([(u,) for u in [*table, "http://d/", None, "http://a/"]], "url string")
    found = {r["url"]: r for r in docs.fetched(urls, fetch, most_bytes=40).collect()}
    assert len(found) == 4 and found["http://a/"]["whole"] and found["http://c/"]["truncated"] and len(found["http://c/"]["body"]) == 40
    fetched = docs.fetched(urls, fetch)
    states = {r["url"]: r["o"] for r in fetched.select("url", docs.outcome(F.col("status"), F.col("error")).alias("o")).collect()}
    assert states == {"http://a/": "ok", "http://b/": "missing", "http://c/": "ok", "http://d/": "timeout"}
    texts = {r["url"]: r["t"] for r in fetched.select("url", docs.decoded_text(F.col("body"), F.col("content_type")).alias("t")).collect()}
    assert texts["http://a/"] == "中文" and texts["http://c/"] == "x" * 50
    path = str(tmp_path / "cache")
    docs.write_cache(fetched, path)
    both, new = docs.read_through(urls.where("url is not null"), spark.read.parquet(path), fetch)
    assert {r["url"] for r in new.collect()} == {"http://b/", "http://d/"} and both.count() == 4
    late = F.current_timestamp() + F.expr("INTERVAL 25 HOURS")
    assert docs.fresh(spark.read.parquet(path), late).count() == 0
    assert docs.purge_cache(spark, path) == 2 and docs.purge_cache(spark, path) == 0
    named = spark.createDataFrame([("https://x.com/a/b%20c.png?q", "png"), ("https://x.com/", "jpg"), ("https://x.com/plain", "pdf")], "u string, e string")
    names = [r[0] for r in named.select(docs.display_name(F.col("u"), F.col("e"))).collect()]
    assert names[0] == "b c.png" and names[1].startswith("x_com-") and names[1].endswith(".jpg") and names[2] == "plain.pdf"
    raw = spark.createDataFrame([("aGk=", True), ("a%20b+c", False), ("***", True)], "d string, b boolean")
    assert [None if r[0] is None else bytes(r[0]) for r in raw.select(docs.data_uri_bytes(F.col("d"), F.col("b"))).collect()] == [b"hi", b"a b+c", None]
    sniffed = spark.createDataFrame([(bytearray(b'<meta charset="GBK">'),), (bytearray(b"charset=x-y"),)], "b binary").select(docs.sniffed_charset(F.col("b"))).collect()
    assert [r[0] for r in sniffed] == ["gbk", "x-y"]


def test_exports(spark):
    items = spark.createDataFrame([(1, "image", 'a"b,c.png', 10, "u1"), (2, "pdf", "x", None, "u2")], "idx int, type string, name string, size long, url string")
    out = io.BytesIO()
    export.write_csv(export.manifest_lines(items), out)
    lines = out.getvalue().decode("utf-8-sig").split("\r\n")
    assert len(lines) == 3 and lines[0].split(",")[0] == "序号" and lines[1].startswith('1,图片,"a""b,c.png",10,') and lines[1].count(",") == 30
    blocks = spark.createDataFrame(
        [(1, "t1", 0, "h1", 1, "Top <x>", 0, 1, "main", "", False, None, 3), (1, "t2", 1, "li", 0, "item", 4, 1, "noise", "nav", True, None, 4), (1, "t3", 2, "a", 0, "go", 2, 1, "content", "", False, "/u", 5)],
        "page_id int, block_id string, ord int, tag string, level int, text string, chars int, words int, zone string, zone_kind string, zone_soft boolean, href string, line int",
    )
    body = lambda *a, **k: export.export_text(blocks, *a, **k).first()["body"]
    assert body("md") == "# Top <x>\n\n- item\n\n[go](/u)" and body("md", scope="main") == "# Top <x>\n\n[go](/u)"
    assert body("html") == "<h1>Top &lt;x&gt;</h1>\n<li>item</li>\n<p>go</p>" and body("txt", ids=["t2"]) == "item" and body("nope").startswith("# Top")
    out = io.BytesIO()
    export.write_csv(export.text_lines(blocks), out)
    assert out.getvalue().decode("utf-8-sig").split("\r\n")[2] == "2,li,,导航菜单（按命名推断）,4,1,4,item"
    page = "<html><head><title>t</title><base href=x></head><script>bad()</script><iframe src=a></iframe>ok"
    pages_df = spark.createDataFrame([(page, "https://x/?a&b"), ("plain", "https://y/"), ("<html>only", "https://z/")], "h string, u string")
    found = [r[0] for r in pages_df.select(export.preview_html(F.col("h"), F.col("u"))).collect()]
    assert "bad()" not in found[0] and "<iframe" not in found[0] and '<base href="https://x/?a&amp;b">' in found[0] and found[0].count("<base") == 1 and found[0].startswith("<!doctype html><html><head><meta")
    assert found[1].endswith("<body>plain</body></html>") and found[2].startswith("<!doctype html><html><head>")
    names = spark.createDataFrame([("a/b?.png", "png", 7), ("..x", "jpg", 0)], "n string, e string, i int")
    assert [r[0] for r in names.select(export.safe_file(F.col("n"), F.col("e"), F.col("i"))).collect()] == ["007-a_b_.png", "_x.jpg"]
    archive = export.zip_bytes(spark.createDataFrame([("b.txt", b"x" * 100), ("a.txt", b"y")], "path string, body binary"), "note")
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"x" * 100 and z.comment == b"note" and z.testzip() is None
    kinds = spark.createDataFrame([(None,), ("text/html",), ("image/png; x",), ("application/zip",)], "c string").select(export.passthrough_type(F.col("c"))).collect()
    assert [r[0] for r in kinds] == ["text/html", "text/html", "image/png", ""]


def test_views_and_selections(spark):
    rows = [(k, "image" if k % 2 else "audio", 100 - k, "ok" if k % 3 else "missing", f"n{k}") for k in range(1, 11)]
    items = spark.createDataFrame(rows, "idx int, type string, size long, status string, name string").withColumns({"width": F.lit(2), "height": F.col("idx")})
    ids = lambda df: [r["idx"] for r in df.orderBy("idx").collect()]
    assert [r["idx"] for r in view.View(items).of_type("image").sorted_by("size").rows().collect()] == [1, 3, 5, 7, 9]
    assert [r["idx"] for r in view.View(items).sorted_by("pixels").rows().limit(2).collect()] == [10, 9]
    assert ids(view.select_range(items, "size", 7, 3)) == [3, 4, 5, 6, 7] and ids(view.select_range(items, "index", 99, 3)) == [3]
    chosen = spark.createDataFrame([(1,), (2,), (2,)], "idx int")
    assert ids(view.inverted(items, chosen)) == list(range(3, 11)) and ids(view.toggled(chosen, items.where("idx in (2, 3)"))) == [1, 3]
    assert ids(view.View(items, chosen).only_selected().items) == [1, 2] and view.View(items, chosen).selected_bytes().first()["bytes"] == 197
    assert ids(view.added(chosen, items.where("idx = 5"))) == [1, 2, 5] and ids(view.intersected(chosen, items.where("idx > 1"))) == [2]
    assert view.export_selection(items, kinds=["image"]).count() == 3 and view.View(items).search(" N1 ").items.count() == 2
    assert view.View(items).counts().count() == 2 and stats.by_type(items).count() == 2


def test_element_joins(spark):
    blocks = spark.createDataFrame([(1, 1, "p", "a  b"), (1, 2, "p", "a b"), (1, 3, "h1", "x"), (2, 4, "p", "a b")], "page_id int, block_id int, tag string, text string")
    elements = spark.createDataFrame([(1, 10, "P", "a b"), (1, 11, "p", " a b "), (1, 12, "p", "a b"), (1, 13, "h2", "x")], "page_id int, el_id int, tag string, text string")
    assert sorted(map(tuple, joins.blocks_to_elements(blocks, elements).collect())) == [(1, 1, 10), (1, 2, 11)]
    tree = spark.createDataFrame([(1, 1, None, "content"), (1, 2, 1, "noise"), (1, 3, 2, "noise"), (1, 4, 2, "main"), (1, 5, 1, "main")], "page_id int, el_id int, parent_id int, zone string")
    assert sorted((r["el_id"], r["zone"]) for r in joins.region_bands(tree).collect()) == [(2, "noise"), (5, "main")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "event_id long, user_id int, kind string")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    events.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["user_id"], "event_id").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "version=0")).collect()
    assert sorted((r["user_id"], r["kind"]) for r in found) == [(1, "b"), (2, "c")]
    html = spark.createDataFrame([(1, "http://x/", "<p>a<p>b"), (2, "http://y/", "<p>c")], "page_id long, url string, html string")
    html.repartition(2).write.parquet(str(tmp_path / "pages"))
    assert {r["page_id"]: r["blocks"] for r in pages.blocks_per_page(spark, str(tmp_path / "pages")).collect()} == {1: 2, 2: 1}


def rectangles(df, name, left, top, width, height):
    """Rows (name, box) of a table of ids."""
    sides = [F.expr(f"cast({e} as double)").alias(n) for n, e in (("left", left), ("top", top), ("right", f"{left} + {width}"), ("bottom", f"{top} + {height}"))]
    return df.select(F.col("id").alias(name), F.struct(*sides).alias("box"))


def test_boxes_in_areas_that_many_rows_share(spark):
    boxes = rectangles(spark.range(300), "item_id", "id % 7 * 200", "id % 3 * 300", "100 + id % 2 * 700", "200")
    areas = rectangles(spark.range(400), "area_id", "id % 4 * id % 2 * 350", "0", "600", "500")
    whole = boxes.crossJoin(areas.withColumnRenamed("box", "other")).withColumn("share", joins.overlap("box", "other")).where("share >= 0.35")
    expected = sorted(tuple(r) for r in whole.select("item_id", "area_id", "share").collect())
    assert len(expected) > 10000 and sorted(tuple(r) for r in joins.boxes_in_areas(boxes, areas).collect()) == expected


def test_equal_rectangles_are_compared_once(spark):
    """300,000 boxes of two sizes beside 300,000 equal areas of the same cell: nothing is found, and not by 90 billion comparisons."""
    boxes = rectangles(spark.range(300_000), "item_id", "id % 2", "0", "100", "100")
    areas = rectangles(spark.range(300_000), "area_id", "80 + id % 1", "80", "100", "100")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert joins.boxes_in_areas(boxes, areas).count() == 0
    finally:
        stop.cancel()
