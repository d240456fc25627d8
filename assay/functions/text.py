"""Content types of text: what a browser or a server would take it for.

A head of bytes is read as text unless it has NUL or too many control bytes; then, in
order, come scripts, structured text, markup after its prolog, hidden markup, JSON, and
plain text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.registry import HEAD
from assay.functions.values import SPACE, latin, part

# Element names that make a text HTML.
HTML_TAGS = ("html", "head", "body", "script", "iframe", "frameset", "object", "embed", "title", "meta", "link", "style", "div", "span", "p", "a", "img", "table", "form", "input", "br", "h1", "h2", "h3", "font", "base", "svg:script")
#: Bytes that text almost never has; tab, line feed, carriage return and escape are fine.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]"
_BOMS = {"utf8": b"\xef\xbb\xbf", "le": b"\xff\xfe", "be": b"\xfe\xff"}
_PROLOGS = 32  # parts of a prolog that are skipped at most


def left_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+", "")


def _wide(body: Column, little_endian: bool) -> Column:
    """UTF-16 as text; surrogates become U+FFFD, an odd last byte goes."""
    digits = F.hex(body)
    order = (2, 0) if little_endian else (0, 2)
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(digits) / 4) - 1, F.lit(0)).cast("int")), lambda i: F.concat(F.substring(digits, i * 4 + order[0] + 1, F.lit(2)), F.substring(digits, i * 4 + order[1] + 1, F.lit(2))))
    sound = F.array_join(F.transform(F.filter(units, lambda u: F.length(u) == 4), lambda u: F.when(F.substring(u, 1, 1).isin("D") & (F.substring(u, 2, 1) >= "8"), "FFFD").otherwise(u)), "")
    return F.decode(F.unhex(sound), "UTF-16BE")


def head_text(content: Column) -> Column:
    """The head as text, or null where it does not look like text."""
    head = F.substring(content, 1, HEAD)
    plain = F.when(part(head, 0, 3) == F.lit(_BOMS["utf8"]), F.substring(head, 4, HEAD)).otherwise(head)
    sample = latin(part(plain, 0, 1024))
    controls = F.length(F.regexp_replace(sample, f"(?s)[^{_CONTROL[1:-1]}]", ""))
    binary = latin(plain).contains("\x00") | (controls > F.greatest(F.lit(2), F.floor(F.length(sample) / 20)))
    return (
        F.when(part(head, 0, 2) == F.lit(_BOMS["le"]), _wide(F.substring(head, 3, HEAD), True))
        .when(part(head, 0, 2) == F.lit(_BOMS["be"]), _wide(F.substring(head, 3, HEAD), False))
        .when(binary, None)
        .otherwise(F.make_valid_utf8(plain.cast("string")))
    )


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark, trimmed; nothing if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, left_trimmed(F.substring(text, at + len(mark), F.length(text)))).otherwise("")


def markup_prolog(text: Column) -> Column:
    """struct<rest, doctype, declared>: text after XML declarations, instructions, comments and DOCTYPEs."""
    start = F.struct(left_trimmed(text).alias("rest"), F.lit(None).cast("string").alias("doctype"), F.lit(False).alias("declared"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        xml, instruction, comment = rest.startswith("<?xml"), rest.startswith("<?"), rest.startswith("<!--")
        doctype = F.upper(F.substring(rest, 1, 9)) == "<!DOCTYPE"
        name = F.regexp_extract(rest, rf"(?iU)^<!DOCTYPE{SPACE}+([A-Za-z_][\w.\-:]*)", 1)
        bracket, close = F.instr(rest, "["), F.instr(rest, ">")
        after_xml = F.when(rest.rlike(r"(?i)^<\?xml[^>]*\?>"), left_trimmed(F.regexp_replace(rest, r"(?i)^<\?xml[^>]*\?>", ""))).otherwise("")
        after_doctype = F.when((bracket > 0) & ((close == 0) | (bracket < close)), _after(rest, "]>")).otherwise(_after(rest, ">"))
        rest_now = F.when(xml, after_xml).when(instruction, _after(rest, "?>")).when(comment, _after(rest, "-->")).when(doctype, after_doctype).otherwise(rest)
        doctype_now = F.when(~xml & ~instruction & ~comment & doctype & (name != ""), F.lower(name)).otherwise(acc["doctype"])
        return F.struct(rest_now.alias("rest"), doctype_now.alias("doctype"), (acc["declared"] | xml).alias("declared"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_PROLOGS)), start, step)


def markup_kind(prolog: Column) -> Column:
    """The type of text that starts with a tag, from its prolog; null if it is no markup after all."""
    rest, doctype, declared = prolog["rest"], prolog["doctype"], prolog["declared"]
    tag = r"(?U)^<([A-Za-z_][\w.\-]*)(?::([A-Za-z_][\w.\-]*))?"
    whole, local = F.regexp_extract(rest, tag, 0), F.regexp_extract(rest, tag, 2)
    name = F.lower(F.when(local != "", local).otherwise(F.regexp_extract(rest, tag, 1)))
    begin = F.lower(F.substring(rest, 1, 2048))
    near = F.substring(rest, F.lit(1), F.length(whole) + 256)
    xml_like = declared | doctype.isNotNull()
    return (
        F.when(doctype == "html", "HTML")
        .when(doctype == "svg", "SVG")
        .when(whole == "", F.when(xml_like, "XML"))
        .when(name == "svg", "SVG")
        .when(name == "html", F.when(begin.contains("<hta:application"), "HTA").otherwise("HTML"))
        .when(name.isin("rss", "rdf"), "RSS")
        .when(name == "feed", "ATOM")
        .when(name.isin("job", "package") & begin.contains("<script"), "WINDOWS_SCRIPT")
        .when(name.isin(*HTML_TAGS), "HTML")
        .when(xml_like | (local != "") | near.contains("xmlns") | F.substring(rest, 1, 512).contains(">"), "XML")
    )


def text_kind(text: Column, prolog: Column | None = None) -> Column:
    """The type of a text from head_text(); null for null.  prolog: markup_prolog(text), if it is at hand."""
    stripped = left_trimmed(text)
    begin = F.substring(stripped, 1, 1024)
    low = F.lower(begin)
    first_line = F.lower(F.regexp_extract(stripped, r"^#![^\n]*", 0))
    tags = "|".join(HTML_TAGS)
    return (
        F.when(text.isNull(), None)
        .when(stripped == "", "PLAIN")
        .when(low.contains("<?php") | low.startswith("<?="), "PHP")
        .when(stripped.startswith("#!"), F.when(first_line.rlike(r"(?U)\b(ba|z|k|da|c|tc)?sh\b"), "SHELL").otherwise("SCRIPT"))
        .when(low.startswith("windows registry editor") | low.startswith("regedit4"), "REG")
        .when(stripped.startswith("-----BEGIN "), "PEM")
        .when(low.startswith("begin:vcard"), "VCARD")
        .when(low.startswith("begin:vcalendar"), "ICAL")
        .when(low.rlike("^(from|return-path|received|mime-version|delivered-to|x-mailer):"), "EMAIL")
        .otherwise(
            F.coalesce(
                F.when(stripped.startswith("<"), markup_kind(markup_prolog(text) if prolog is None else prolog)),
                F.when(begin.rlike(rf"(?iU)<(?:!doctype{SPACE}+html|(?:{tags})(?:{SPACE}|[>/]))"), "HTML"),
                F.when(low.rlike(rf"(?U)<svg(?:{SPACE}|>)"), "SVG"),
                F.when(stripped.rlike(rf'(?U)^[\[{{]{SPACE}*(?:["\]}}]|-?\d|true|false|null|\[|\{{)'), "JSON"),
                F.lit("PLAIN"),
            )
        )
    )
