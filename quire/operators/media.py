"""Media header fields from a file's first bytes (PNG, GIF, BMP, WebP, WAV, GZIP).

Input ``media(path, head binary)`` — only the first 64 bytes are needed, so a
``binaryFile`` scan projects ``substring(content, 1, 64)`` right away.  Every
field is a fixed-offset read written with built-in binary functions (no UDF);
a wrong signature yields nulls, never an error.
"""

from __future__ import annotations

import os
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.corpus import extname, media_type

HEAD_BYTES = 64


def u8(b: Column, i: int) -> Column:
    """Unsigned byte at 0-based offset ``i``; 0 past the end (zero-filled buffer)."""
    return F.coalesce(F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("long"), F.lit(0).cast("long"))


def u16le(b, i):
    return u8(b, i) + u8(b, i + 1) * 256


def u32le(b, i):
    return u8(b, i) + u8(b, i + 1) * 256 + u8(b, i + 2) * 65536 + u8(b, i + 3) * 16777216


def u32be(b, i):
    return u8(b, i) * 16777216 + u8(b, i + 1) * 65536 + u8(b, i + 2) * 256 + u8(b, i + 3)


def ascii_at(b: Column, i: int, n: int) -> Column:
    return F.decode(F.substring(b, i + 1, n), "ISO-8859-1")


def media_headers(media: DataFrame) -> DataFrame:
    """(path, format, width, height, bit_depth, has_alpha, channels, sample_rate,
    bitrate_kbps, compression).  Reads by extension; GIF colour flags from byte
    10; WebP extended files have no dimensions."""
    b = F.col("head")
    ext = F.lower(extname(F.col("path")))
    png = (u8(b, 0) == 0x89) & (u8(b, 1) == 0x50) & (u8(b, 2) == 0x4E) & (u8(b, 3) == 0x47)
    gif = ascii_at(b, 0, 3) == "GIF"
    bmp = (u8(b, 0) == 0x42) & (u8(b, 1) == 0x4D)
    riff = ascii_at(b, 0, 4) == "RIFF"
    webp = riff & (ascii_at(b, 8, 4) == "WEBP")
    wav = riff & (ascii_at(b, 8, 4) == "WAVE")
    gz = (u8(b, 0) == 0x1F) & (u8(b, 1) == 0x8B)
    chunk = ascii_at(b, 12, 4)
    vp8l_bits = u32le(b, 21)
    packed = u8(b, 10)
    bmp_h = u32le(b, 22)
    bmp_h = F.abs(F.when(bmp_h >= 2147483648, bmp_h - 4294967296).otherwise(bmp_h))
    is_png, is_gif, is_bmp = (ext == ".png") & png, (ext == ".gif") & gif, (ext == ".bmp") & bmp
    is_webp, is_wav, is_gz = (ext == ".webp") & webp, (ext == ".wav") & wav, (ext == ".gz") & gz
    width = (F.when(is_png, u32be(b, 16)).when(is_gif, u16le(b, 6)).when(is_bmp, u32le(b, 18))
             .when(is_webp & (chunk == "VP8 "), u16le(b, 26).bitwiseAND(0x3FFF))
             .when(is_webp & (chunk == "VP8L"), vp8l_bits.bitwiseAND(0x3FFF) + 1))
    height = (F.when(is_png, u32be(b, 20)).when(is_gif, u16le(b, 8)).when(is_bmp, bmp_h)
              .when(is_webp & (chunk == "VP8 "), u16le(b, 28).bitwiseAND(0x3FFF))
              .when(is_webp & (chunk == "VP8L"), F.shiftright(vp8l_bits, 14).bitwiseAND(0x3FFF) + 1))
    depth = (F.when(is_png, u8(b, 24))
             .when(is_gif, F.when(packed.bitwiseAND(0x80) != 0, (packed.bitwiseAND(7) + 1) * 3).otherwise(F.lit(8)))
             .when(is_bmp, u16le(b, 28)).when(is_wav, u16le(b, 34)))
    alpha = (F.when(is_png, u8(b, 25).isin(4, 6)).when(is_gif, F.lit(False)).when(is_bmp, u16le(b, 28) == 32)
             .when(is_webp, chunk == "VP8L"))
    comp = F.when(is_gz, F.when(u8(b, 2) == 8, F.lit("DEFLATE")).otherwise(F.concat(F.lit("method-"), u8(b, 2).cast("string"))))
    return media.select(
        "path", F.upper(F.substring(ext, 2, 16)).alias("format"),
        width.cast("long").alias("width"), height.cast("long").alias("height"), depth.cast("long").alias("bit_depth"),
        alpha.alias("has_alpha"), F.when(is_wav, u16le(b, 22)).alias("channels"),
        F.when(is_wav, u32le(b, 24)).alias("sample_rate"),
        F.when(is_wav, F.round(u32le(b, 28) * 8 / 1000.0, 0).cast("long")).alias("bitrate_kbps"),
        comp.alias("compression"))


def media_inventory(media: DataFrame) -> DataFrame:
    """(type, mime, format, files, bytes, min_w, max_w, min_h, max_h) of ``media(path, size,
    head)`` with subtotals: by type, type and MIME type, and format (nulls mark what a row
    sums over)."""
    kind, _, mime = media_type(F.col("path"))
    typed = media.select("path", "size", F.coalesce(kind, F.lit("binary")).alias("type"), F.coalesce(mime, F.lit("application/octet-stream")).alias("mime"))
    return media_headers(media).join(typed, "path").rollup("type", "mime", "format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("width").alias("min_w"), F.max("width").alias("max_w"),
        F.min("height").alias("min_h"), F.max("height").alias("max_h"))


# --- fixed values: MPEG audio header tables ---
MPEG_VERSIONS = ("MPEG2.5", "reserved", "MPEG2", "MPEG1")
MPEG_LAYERS = ("reserved", "III", "II", "I")
MPEG1_LAYER3_KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
MPEG1_SAMPLE_RATES = (44100, 48000, 32000, 0)
AUDIO_HEAD = 1024
# -----------------------------------------------------------------------------


def _u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at:at + 2], "big")


def _scan_jpeg(head: bytes) -> dict:
    at = min((k for k in (head.find(b"\xff\xc0"), head.find(b"\xff\xc2")) if k >= 0), default=len(head))
    return {"height": _u16(head, at + 5), "width": _u16(head, at + 7), "bit_depth": head[at + 4]} if at < len(head) - 10 else {}


def _scan_zip(tail: bytes) -> dict:
    # the end-of-central-directory record begins with 50 4B 05 06
    at = tail.rfind(b"PK\x05\x06")
    return {"entries": int.from_bytes(tail[at + 8:at + 10], "little")} if 0 <= at <= len(tail) - 10 else {}


def _scan_font(head: bytes) -> dict:
    """Number of tables, and the Windows family or full name if the name table lies in the head."""
    if len(head) < 12 or head[:4] not in (b"\x00\x01\x00\x00", b"true", b"OTTO"):
        return {}
    tables = _u16(head, 4)
    name = next((int.from_bytes(head[at + 8:at + 12], "big") for at in range(12, 12 + 16 * tables, 16) if head[at:at + 4] == b"name"), 0)
    for at in range(name + 6, name + 6 + 12 * _u16(head, name + 2), 12) if name else ():
        length, text = _u16(head, at + 8), name + _u16(head, name + 4) + _u16(head, at + 10)
        if _u16(head, at) == 3 and _u16(head, at + 6) in (1, 4) and 0 < length < 200 and text + length <= len(head):
            return {"tables": tables, "family": head[text:text + length].decode("utf-16-be", "replace").replace("\0", "")}
    return {"tables": tables}


def _scan_mpeg(head: bytes) -> dict:
    head = head[:AUDIO_HEAD]
    if head[:3] == b"ID3" and len(head) >= 10:
        return {"compression": "ID3v2"}
    at = head.find(b"\xff")
    while 0 <= at < len(head) - 4:
        one, two, three = head[at + 1:at + 4]
        if one & 0xE0 == 0xE0:
            version, layer, rate, sample = one >> 3 & 3, one >> 1 & 3, two >> 4, two >> 2 & 3
            out = {"compression": f"{MPEG_VERSIONS[version]} Layer {MPEG_LAYERS[layer]}", "channels": 1 if three >> 6 == 3 else 2}
            if version == 3 and layer == 1 and 0 < rate < 15:
                out["bitrate_kbps"] = MPEG1_LAYER3_KBPS[rate]
            if version == 3 and sample < 3:
                out["sample_rate"] = MPEG1_SAMPLE_RATES[sample]
            return out
        at = head.find(b"\xff", at + 1)
    return {}


#: Rows that are scanned at once.
SCANNED_AT_ONCE = 256
SCANNED = ("width", "height", "bit_depth", "entries", "tables", "channels", "sample_rate", "bitrate_kbps", "family", "compression")


def _scan_one(ext: str, head: bytes, tail: bytes) -> dict:
    if ext in (".jpg", ".jpeg"):
        return _scan_jpeg(head)
    if ext == ".zip":
        return _scan_zip(tail)
    if ext in (".ttf", ".otf"):
        return _scan_font(head)
    return _scan_mpeg(head) if ext == ".mp3" else {}


def media_scan_headers(head_tail: DataFrame) -> DataFrame:
    """(path, width, height, bit_depth, entries, tables, channels, sample_rate, bitrate_kbps,
    family, compression) for formats whose fields need a scan: JPEG start of frame in the first
    64 KiB, ZIP directory count in the last 64 KiB, font tables and family name, MPEG audio
frame or ID3 tag in the first 1 KiB.  A row brings its task only the bytes that its kind is read
    from, and they are scanned ``SCANNED_AT_ONCE`` rows at a time."""
    low = F.lower("path")
    kinds = {kind: reduce(or_, (low.endswith(e) for e in ends)) for kind, ends in (("head", (".jpg", ".jpeg", ".ttf", ".otf")), ("tail", (".zip",)), ("audio", (".mp3",)))}
    head = F.when(kinds["head"], F.col("head")).when(kinds["audio"], F.substring("head", 1, AUDIO_HEAD))
    types = {n: pa.string() if n in SCANNED[8:] else pa.int64() for n in SCANNED}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCANNED_AT_ONCE):
                part = batch.slice(at, SCANNED_AT_ONCE)
                found = [_scan_one(os.path.splitext(p.as_py())[1].lower(), h.as_py() or b"", t.as_py() or b"") for p, h, t in zip(*part.columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f.get(n) for f in found], of) for n, of in types.items())], names=["path", *types])

    return head_tail.select("path", head.alias("head"), F.when(kinds["tail"], F.col("tail")).alias("tail")).mapInArrow(
        run, "path string, " + ", ".join(f"{n} {'string' if n in SCANNED[8:] else 'long'}" for n in SCANNED))
