"""Content types from leading bytes, as one CASE over the signatures in their order.

Signatures that are weak or shared by several types are settled by a look at more bytes;
where that look says no, the next signature is tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.registry import FAR, HEAD, ORDERED
from assay.functions.values import big, latin, little, part

# Brands of the ISO base media format.
BRANDS = {
    "MP4": "isom iso2 iso3 iso4 iso5 iso6 mp41 mp42 avc1 dash MSNV M4V_ M4VH M4VP XAVC mmp4 NDSC",
    "M4A": "M4A_ M4B_ M4P_ mp71",
    "MOV": "qt__",
    "HEIC": "heic heix hevc hevx heim heis hevm hevs mif1 msf1",
    "AVIF": "avif avis",
    "THREEGP": "3gp4 3gp5 3gp6 3gp7 3ge6 3ge7 3gg6 3g2a 3g2b",
    "CR3": "crx_",
}
# Sizes of bitmap headers.
DIB_SIZES = (12, 16, 40, 52, 56, 64, 108, 124)


def riff(head: Column) -> Column:
    form = latin(part(head, 8, 4))
    return F.when(form == "WAVE", "WAV").when(form == "AVI ", "AVI").when(form == "WEBP", "WEBP").otherwise("RIFF_GENERIC")


def iff(head: Column) -> Column:
    return F.when(latin(part(head, 8, 4)).isin("AIFF", "AIFC"), "AIFF").otherwise("IFF_GENERIC")


def _brand_kind(brand: Column) -> Column:
    out = None
    for kind, brands in BRANDS.items():
        hit = brand.isin(*[b.replace("_", " ") for b in brands.split()])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def ftyp(head: Column) -> Column:
    """The main brand, else the first known one of the compatible brands, else MP4."""
    brand, size, box = latin(part(head, 8, 4)), F.octet_length(head), big(head, 0, 4)
    end = F.when(F.coalesce(box, F.lit(0)) == 0, F.least(size, F.lit(64))).otherwise(F.least(box, size.cast("long"), F.lit(256)))
    at = F.filter(F.sequence(F.lit(16), F.lit(252), F.lit(4)), lambda i: i < end - 3)
    kinds = F.filter(F.transform(at, lambda i: _brand_kind(latin(F.substring(head, i + 1, F.lit(4))))), lambda k: k.isNotNull())
    return F.coalesce(_brand_kind(brand), F.when(F.substring(brand, 1, 3).isin("3gp", "3g2"), "THREEGP"), F.try_element_at(kinds, F.lit(1)), F.lit("MP4"))


def ebml(head: Column) -> Column:
    window = latin(part(head, 0, 128))
    at = F.instr(window, "\x42\x82")
    size = F.coalesce(F.ascii(F.substring(window, at + 2, F.lit(1))), F.lit(0)).bitwiseAND(0x7F)
    kind = F.substring(window, at + 3, size)
    return F.when((at > 0) & kind.startswith("webm"), "WEBM").when((at > 0) & kind.startswith("matroska"), "MKV").when(window.contains("webm"), "WEBM").otherwise("MKV")


def bmp_fits(head: Column) -> Column:
    return (F.octet_length(head) >= 26) & (big(head, 6, 4) == 0) & little(head, 10, 4).between(26, 16 << 20) & little(head, 14, 4).isin(*DIB_SIZES)


def icon_fits(head: Column) -> Column:
    count = little(head, 4, 2)
    return (F.octet_length(head) >= 22) & count.between(1, 256) & (big(head, 9, 1) == 0) & (little(head, 18, 4) >= 6 + 16 * count) & (little(head, 14, 4) != 0)


def ttf_fits(head: Column) -> Column:
    return (F.octet_length(head) >= 12) & big(head, 4, 2).between(1, 64)


def mpeg_ts_fits(head: Column) -> Column:
    return (F.octet_length(head) >= 377) & (big(head, 188, 1) == 0x47) & (big(head, 376, 1) == 0x47)


def mp3_fits(head: Column) -> Column:
    flags = big(head, 2, 1)
    rate = F.shiftright(flags, 4)
    return (F.octet_length(head) >= 4) & ~rate.isin(0, 15) & (F.shiftright(flags, 2).bitwiseAND(3) != 3)


def arj_fits(head: Column) -> Column:
    return (F.octet_length(head) >= 34) & little(head, 2, 2).between(30, 2600) & (big(head, 10, 1) == 2) & (big(head, 11, 1) == 0)


def eot_fits(head: Column) -> Column:
    whole, font = little(head, 0, 4), little(head, 4, 4)
    return (F.octet_length(head) >= 36) & (whole != 0) & (font != 0) & (font < whole)


def cafebabe(head: Column) -> Column:
    return F.when((F.octet_length(head) >= 8) & (big(head, 4, 4) < 45), "MACHO_FAT").otherwise("JAVA_CLASS")


_FITS = {"BMP": bmp_fits, "ICO": icon_fits, "CUR": icon_fits, "TTF": ttf_fits, "MPEG_TS": mpeg_ts_fits, "MP3": mp3_fits, "ARJ": arj_fits, "EOT": eot_fits}
_BECOMES = {"WAV": riff, "AIFF": iff, "MP4": ftyp, "MKV": ebml, "JAVA_CLASS": cafebabe}


def binary_kind(content: Column, zip_kind: Column | None = None, ole_kind: Column | None = None, gzip_kind: Column | None = None) -> Column:
    """The key of the type that content's bytes announce, or null.

    zip_kind, ole_kind and gzip_kind say what the containers hold, where that is known.
    """
    head = F.substring(content, 1, HEAD)
    inside = {"ZIP": zip_kind, "OLE2": ole_kind, "GZIP": gzip_kind}
    out = None
    for s in ORDERED:
        hit = part(head, s.offset, len(s.magic)) == F.lit(s.magic)
        plain = s.magic in (b"ID3", b"true")
        if s.kind in _FITS and not plain:
            hit = hit & _FITS[s.kind](head)
        kind = F.lit(s.kind) if plain or s.kind not in _BECOMES else _BECOMES[s.kind](head)
        if inside.get(s.kind) is not None:
            kind = F.coalesce(inside[s.kind], F.lit(s.kind))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    far = (F.octet_length(content) >= HEAD) & (part(content, FAR.offset, len(FAR.magic)) == F.lit(FAR.magic))
    return out.when(far, FAR.kind)
