"""Signatures of other formats inside a payload, and data after its end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.values import CRITICAL, HIGH, INFO, LOW, MEDIUM, any_of, finding, findings, latin, let, no_findings


class Marker(NamedTuple):
    """pattern: a regular expression over bytes read as ISO-8859-1; first: the first offset that counts."""

    name: str
    pattern: str
    severity: int
    first: int = 1

    @property
    def body(self) -> str:
        """The pattern as a part of a larger one."""
        return f"(?i:{self.pattern[4:]})" if self.pattern.startswith("(?i)") else f"(?:{self.pattern})"

    @property
    def lead(self) -> str:
        """The characters that a match may begin with, for a character class."""
        plain = self.pattern.removeprefix("(?i)")
        sign = chr(int(plain[2:4], 16)) if plain.startswith("\\x") else plain[1] if plain[0] == "\\" else plain[0]
        both = {sign, sign.lower(), sign.upper()} if plain != self.pattern else {sign}
        return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(both) if ord(c) < 256)


def byte_marker(name: str, content: bytes, severity: int, first: int = 0) -> Marker:
    """A marker of one's own: these bytes, from the offset `first` on."""
    if not content:
        raise ValueError("a marker needs bytes")
    return Marker(name, "".join(f"\\x{b:02x}" for b in content), severity, first)


# Markers (two share the name html in the source of these values, where the second counts), and those for each category.
MARKERS = {
    m.name: m
    for m in (
        Marker("pdf", "%PDF-", HIGH),
        Marker("zip", "PK\\x03\\x04", MEDIUM),
        Marker("elf", "\\x7fELF", HIGH),
        Marker("pe", "This program cannot be run in DOS mode", HIGH),
        Marker("ole2", "\\xd0\\xcf\\x11\\xe0\\xa1\\xb1\\x1a\\xe1", MEDIUM),
        Marker("rar", "Rar!\\x1a\\x07", MEDIUM),
        Marker("7z", "7z\\xbc\\xaf\\x27\\x1c", MEDIUM),
        Marker("php", "(?i)<\\?php", CRITICAL, 0),
        Marker("asp", "<%", LOW, 0),
        Marker("html_script", "(?i)<script[\\s>/]", HIGH, 0),
        Marker("html_iframe", "(?i)<iframe[\\s>/]", HIGH, 0),
        Marker("html", "(?i)<!doctype html[\\s>/]", MEDIUM, 0),
        Marker("svg", "(?i)<svg[\\s>/]", MEDIUM, 0),
        Marker("javascript_uri", "(?i)javascript:", LOW, 0),
        Marker("shebang", "#!/", MEDIUM, 0),
        Marker("java_class", "\\xca\\xfe\\xba\\xbe", MEDIUM),
    )
}
_MEDIA = "pdf zip elf pe php html_script html_iframe shebang".split()
CATEGORY_MARKERS = {
    "image": "pdf zip elf pe ole2 rar 7z php asp html_script html_iframe html svg shebang java_class".split(),
    "font": _MEDIA,
    "audio": _MEDIA,
    "video": _MEDIA,
    "document": "elf pe php zip html_script html_iframe shebang".split(),
    "data": "elf pe php html_script".split(),
    "unknown": "php html_script html_iframe pe elf".split(),
}
PNG_END, JPEG_END, PDF_END = "IEND\xae\x42\x60\x82", "\xff\xd9", "%%EOF"
TAIL = 64 * 1024


def offsets(text: Column, markers: list[Marker]) -> Column:
    """array<int>: of each marker the 0-based offset of its first match that counts, or null; text has characters up to U+00FF only.

    One pass finds the places where any marker begins and puts a sign there that text
    cannot have; what stands between these places is then gone through from the end, and
    what stands at each, up to the longest marker, is held against the markers.  Texts
    without a marker, nearly all, are not looked at again.
    """
    sign, longest = chr(0x100), max(len(m.pattern) for m in markers)  # no match is longer than its pattern
    anywhere = f"(?=[{''.join(m.lead for m in markers)}])(?={'|'.join(m.body for m in markers)})"
    pieces = F.split(F.regexp_replace(text, F.lit(anywhere), F.lit(sign)), sign, -1)
    none = F.array(*[F.lit(None).cast("int") for _ in markers])

    def back(state: Column, piece: Column) -> Column:
        here = F.struct((state["at"] - F.length(piece)).alias("at"), F.substring(F.concat(piece, state["tail"]), 1, longest).alias("tail"), state["found"].alias("found"))
        hit = lambda h, i, m: F.when(h["tail"].rlike(f"^{m.body}") & (h["at"] >= m.first), h["at"]).otherwise(h["found"][i])
        return let(here, lambda h: F.struct(h["at"].alias("at"), h["tail"].alias("tail"), F.array(*[hit(h, i, m) for i, m in enumerate(markers)]).alias("found")))

    start = F.struct(F.length(text).alias("at"), F.lit("").alias("tail"), none.alias("found"))
    walked = lambda p: F.aggregate(F.reverse(F.slice(p, 2, F.size(p) - 1)), start, back, lambda s: s["found"])
    return let(pieces, lambda p: F.when(F.size(p) > 1, walked(p)).otherwise(none))


def scanned(detected: Column) -> Column:
    """Whether a type is searched for other formats at all."""
    mime = detected["mime"]
    skipped = detected["category"].isin("archive", "text", "script", "executable") | mime.isin("application/rtf", "image/svg+xml", "application/epub+zip")
    return ~(skipped | mime.startswith("application/vnd.openxmlformats") | mime.startswith("application/vnd.oasis"))


def embedded(content: Column, detected: Column, limit: int = 1 << 20, markers: list[str | Marker] | None = None) -> Column:
    """array<finding> of markers in the first `limit` bytes; markers: names, or markers of one's own, to look for in place of the category's."""
    mime, description = detected["mime"], detected["description"]
    sought = list(MARKERS.values()) if markers is None else [MARKERS[m] if isinstance(m, str) else m for m in markers]

    def one(found: Column, number: int, marker: Marker) -> Column:
        name = marker.name
        own = {"pdf": "application/pdf", "svg": "image/svg+xml"}.get(name, "text/html" if name.startswith("html") else "")
        told = lambda at: finding(at.isNotNull(), f"polyglot.embedded_{name}", marker.severity, F.format_string(f"{name.upper().replace('_', ' ')} inside %s at offset %d", description, at), {"offset": at, "marker": F.lit(name)})
        return let(F.when(mime != own, found[number]), told)

    def in_order(found: Column) -> Column:
        each = [one(found, i, m) for i, m in enumerate(sought)]
        if markers is not None:
            return findings(*each)
        made = dict(zip(MARKERS, each, strict=True))
        groups: dict[tuple, list[str]] = {}
        for category, names in CATEGORY_MARKERS.items():
            groups.setdefault(tuple(names), []).append(category)
        out = None
        for names, categories in groups.items():
            listed = findings(*[made[n] for n in names])
            if "unknown" in categories:  # and any category that has no list
                return out.otherwise(listed)
            here = detected["category"].isin(*categories)
            out = F.when(here, listed) if out is None else out.when(here, listed)
        return out

    if not sought:
        return no_findings()
    places = let(latin(F.substring(content, 1, limit)), lambda text: offsets(text, sought))
    return F.when(scanned(detected), let(places, in_order)).otherwise(no_findings())


def _after_last(tail: Column, mark: str) -> Column:
    """How many characters follow the last mark, or null."""
    at = F.instr(F.reverse(tail), mark[::-1])
    return F.when(at > 0, at - 1)


def trailing(content: Column, detected: Column, size: Column | None = None, tail_size: int = TAIL, end: Column | None = None) -> Column:
    """array<finding> about bytes after the end of a PNG, JPEG, GIF or PDF; end: the last bytes, where they stand in a column of their own."""
    size = F.octet_length(content) if size is None else size
    mime = detected["mime"]
    png, jpeg, gif, pdf = (mime == m for m in ("image/png", "image/jpeg", "image/gif", "application/pdf"))
    tail = latin(F.substring(content, F.greatest(F.lit(1), size - (tail_size - 1)).cast("int"), F.lit(tail_size)) if end is None else end)

    def about(tail: Column) -> Column:
        n = F.length(tail)
        padding = F.length(tail) - F.length(F.rtrim(tail, F.lit("\x00\xff\n\r\t ")))
        clean = (png & tail.endswith(PNG_END)) | (jpeg & F.rtrim(tail, F.lit("\x00\xff\n\r\t ")).endswith(JPEG_END) & (padding <= 64)) | (gif & tail.endswith(";")) | (pdf & F.rtrim(tail, F.lit("\r\n\t \x00")).endswith(PDF_END))
        after = F.when(png, _after_last(tail, PNG_END)).when(jpeg, _after_last(tail, JPEG_END)).when(gif, _after_last(tail, "\x00;")).when(pdf, _after_last(tail, PDF_END))
        return let(F.struct(after.alias("after"), clean.alias("clean")), lambda x: told(tail, n, x["after"], ~x["clean"]))

    def told(tail: Column, n: Column, after: Column, here: Column) -> Column:
        rest = F.substring(tail, n - after + 1, after)
        readable = F.substring(rest, 1, 256).rlike("^[\\x20-\\x7e\\t\\n\\r]*\\z") & (after > 8)
        small_pdf = pdf & (after < 1024)
        return findings(
            finding(here & pdf & after.isNull(), "polyglot.no_eof_marker", LOW, "the PDF has no end mark"),
            finding(here & ~pdf & after.isNull(), "polyglot.missing_eof", LOW, F.format_string("%s without an end mark in its last %d bytes", detected["description"], n), {"tail_scanned": n}),
            finding(here & small_pdf, "polyglot.trailing_data", INFO, F.format_string("%d bytes after the last end mark", after), {"trailing_bytes": after}),
            finding(here & ~small_pdf & (after > 0), "polyglot.trailing_data", F.when(readable, HIGH).otherwise(MEDIUM), F.format_string("%d bytes after the end of the %s", after, detected["description"]), {"trailing_bytes": after, "preview": F.substring(rest, 1, 32)}),
        )

    return F.when(any_of([png, jpeg, gif, pdf]) & (size > 0), let(tail, about)).otherwise(no_findings())
