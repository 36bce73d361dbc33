"""§ media header fields over ``v_media`` (header bytes derived from ``part``)."""

from pyspark.sql import functions as F

from quire.operators import media as M
from quire.plans.common import finish
from quire.plans.registry import query
from quire.sources.fixtures import derived, duck_with


def u8(i: int) -> str:
    d = "'0123456789ABCDEF'"
    return (f"(CASE WHEN length(h) >= {2 * i + 2} THEN (instr({d}, substring(h, {2 * i + 1}, 1)) - 1) * 16 "
            f"+ instr({d}, substring(h, {2 * i + 2}, 1)) - 1 ELSE 0 END)")


def u16le(i):
    return f"({u8(i)} + {u8(i + 1)} * 256)"


def u32le(i):
    return f"({u8(i)} + {u8(i + 1)} * 256 + {u8(i + 2)} * 65536 + {u8(i + 3)} * 16777216)"


def u32be(i):
    return f"({u8(i)} * 16777216 + {u8(i + 1)} * 65536 + {u8(i + 2)} * 256 + {u8(i + 3)})"


def asc(i, s):
    return f"(substring(h, {2 * i + 1}, {2 * len(s)}) = '{s.encode('latin-1').hex().upper()}')"


EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+(\\.[^.]*)$', 1))"
HDR = duck_with("v_media") + f"""
, m AS (SELECT path, hex(head) AS h, {EXT} AS ext FROM v_media),
f AS (SELECT path, ext,
  ext = '.png' AND {u8(0)} = 137 AND {u8(1)} = 80 AND {u8(2)} = 78 AND {u8(3)} = 71 AS is_png,
  ext = '.gif' AND {asc(0, 'GIF')} AS is_gif,
  ext = '.bmp' AND {u8(0)} = 66 AND {u8(1)} = 77 AS is_bmp,
  ext = '.webp' AND {asc(0, 'RIFF')} AND {asc(8, 'WEBP')} AS is_webp,
  ext = '.wav' AND {asc(0, 'RIFF')} AND {asc(8, 'WAVE')} AS is_wav,
  ext = '.gz' AND {u8(0)} = 31 AND {u8(1)} = 139 AS is_gz,
  {asc(12, 'VP8 ')} AS vp8, {asc(12, 'VP8L')} AS vp8l, {u32le(21)} AS lbits, {u8(10)} AS packed,
  {u32le(22)} AS bh, h FROM m),
hdr AS (SELECT path, upper(substring(ext, 2)) AS format,
  CAST(CASE WHEN is_png THEN {u32be(16)} WHEN is_gif THEN {u16le(6)} WHEN is_bmp THEN {u32le(18)}
       WHEN is_webp AND vp8 THEN {u16le(26)} & 16383 WHEN is_webp AND vp8l THEN (lbits & 16383) + 1 END AS BIGINT) AS width,
  CAST(CASE WHEN is_png THEN {u32be(20)} WHEN is_gif THEN {u16le(8)}
       WHEN is_bmp THEN abs(CASE WHEN bh >= 2147483648 THEN bh - 4294967296 ELSE bh END)
       WHEN is_webp AND vp8 THEN {u16le(28)} & 16383 WHEN is_webp AND vp8l THEN ((lbits >> 14) & 16383) + 1 END AS BIGINT) AS height,
  CAST(CASE WHEN is_png THEN {u8(24)} WHEN is_gif THEN (CASE WHEN packed & 128 <> 0 THEN ((packed & 7) + 1) * 3 ELSE 8 END)
       WHEN is_bmp THEN {u16le(28)} WHEN is_wav THEN {u16le(34)} END AS BIGINT) AS bit_depth,
  CASE WHEN is_png THEN {u8(25)} IN (4, 6) WHEN is_gif THEN false WHEN is_bmp THEN {u16le(28)} = 32
       WHEN is_webp THEN vp8l END AS has_alpha,
  CAST(CASE WHEN is_wav THEN {u16le(22)} END AS BIGINT) AS channels,
  CAST(CASE WHEN is_wav THEN {u32le(24)} END AS BIGINT) AS sample_rate,
  CAST(CASE WHEN is_wav THEN round({u32le(28)} * 8 / CAST(1000 AS DOUBLE), 0) END AS BIGINT) AS bitrate_kbps,
  CASE WHEN is_gz THEN (CASE WHEN {u8(2)} = 8 THEN 'DEFLATE' ELSE 'method-' || CAST({u8(2)} AS VARCHAR) END) END AS compression
 FROM f)
"""


def _headers(spark, sf):
    return M.media_headers(derived(spark, sf, "v_media"))


@query("media_headers", HDR + "SELECT * FROM hdr")
def media_headers(spark, sf):
    return finish(_headers(spark, sf))


@query("media_inventory", HDR + """
, t AS (SELECT hdr.*, octet_length(v.head) AS size, kinds.type, kinds.mime FROM hdr JOIN v_media v ON v.path = hdr.path
        JOIN (VALUES ('PNG', 'image', 'image/png'), ('GIF', 'image', 'image/gif'), ('BMP', 'image', 'image/bmp'), ('WAV', 'audio', 'audio/wav'),
                     ('WEBP', 'image', 'image/webp'), ('GZ', 'archive', 'application/gzip')) AS kinds(f, type, mime) ON kinds.f = hdr.format)
SELECT type, mime, format, count(*) AS files, sum(size) AS bytes, min(width) AS min_w, max(width) AS max_w, min(height) AS min_h, max(height) AS max_h
FROM t GROUP BY ROLLUP (type, mime, format)
""")
def media_inventory(spark, sf):
    return finish(M.media_inventory(derived(spark, sf, "v_media").withColumn("size", F.octet_length("head").cast("long"))))
