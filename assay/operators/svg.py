"""SVG files as a relation of nodes, rules over it, and sanitising by the rules' verdicts.

A small reader turns each file into rows, one per element, in the order in which a walk
meets them.  What is wrong with an element or an attribute is an expression; files are
put right by a small writer that takes out or replaces what the verdicts name.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assay.functions.durable import durable
from assay.functions.ship import ship
from assay.functions.urls import CSS_URL, classify_url, css_cleaned, css_reaches_out, css_scripts
from assay.functions.values import CRITICAL, FINDING, HIGH, LOW, MEDIUM, any_of, finding, findings, latin, no_findings

SVG_NS = "http://www.w3.org/2000/svg"
XLINK_NS = "http://www.w3.org/1999/xlink"
XML_NS = "http://www.w3.org/XML/1998/namespace"
XHTML_NS = "http://www.w3.org/1999/xhtml"
# Namespaces, elements and attributes.
NAMESPACES = {
    "": SVG_NS,
    "xlink": XLINK_NS,
    "inkscape": "http://www.inkscape.org/namespaces/inkscape",
    "sodipodi": "http://sodipodi.sourceforge.net/DTD/sodipodi-0.dtd",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "cc": "http://creativecommons.org/ns#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "xml": XML_NS,
}
DANGEROUS_ELEMENTS = """
    iframe embed object applet frame frameset html body head meta base
    link form input button textarea select option audio video source track
    handler listener annotation-xml math canvas template slot portal noscript
    prefetch discard
""".split()
ANIMATIONS = "animate animatetransform animatemotion animatecolor set".split()
ANIMATED_VALUES = "to from values by".split()
REMOVED_ATTRIBUTES = """
    src data action formaction poster codebase background dynsrc lowsrc srcset
    ping manifest profile archive code classid usemap longdesc contenteditable
""".split()
PAINTS = "fill stroke filter clip-path mask marker-start marker-mid marker-end marker cursor".split()

_ATTRIBUTE = "struct<raw:string,name:string,value:string>"
NODE = f"payload_id string, node int, parent int, visit int, depth int, last int, ns string, local string, attributes array<{_ATTRIBUTE}>, style string, too_deep boolean, elements int, error string"
COLUMNS = tuple(f.split(" ", 1)[0] for f in NODE.replace(_ATTRIBUTE, "").split(", "))


@dataclass(frozen=True)
class SvgPolicy:
    allow_external_references: bool = False
    allow_data_images: bool = True
    allow_style: bool = True
    allow_animation: bool = True
    allow_links: bool = True
    blocked_elements: frozenset[str] = frozenset()
    blocked_attributes: frozenset[str] = frozenset()
    max_bytes: int = 10 << 20
    max_elements: int = 100_000
    max_depth: int = 512


# ---------------------------------------------------------------- before parsing


def before_parsing(content: Column, policy: SvgPolicy, modify: bool) -> tuple[Column, Column]:
    """(findings, bytes to parse): bytes are null where the file is refused before it is parsed."""
    doctype, instruction = r"(?i)<!DOCTYPE[^>\[]*(\[[\s\S]*?\]\s*)?>", r"(?i)<\?(?!xml[\s?])[\s\S]*?\?>"
    entity = "(?i)<!ENTITY"
    text, size = latin(content), F.octet_length(content)
    fits = size <= policy.max_bytes
    has_entity = text.rlike(entity)
    goes_on = fits & (F.lit(modify) | ~has_entity)
    without = F.regexp_replace(text, f"(?s)\\A(.*?){doctype}(.*)\\z", "$1$3")
    has_doctype, subset = text.rlike(doctype), F.regexp_extract(text, doctype, 1) != ""
    has_instruction = without.rlike(instruction)
    bare = F.regexp_replace(without, instruction, "")
    found = findings(
        finding(~fits, "svg.too_large", HIGH, f"SVG of over {policy.max_bytes} bytes", {"size": size}),
        finding(fits & has_entity, "svg.entity_declaration", CRITICAL, "the SVG declares XML entities"),
        finding(goes_on & has_doctype, "svg.doctype", F.when(subset, MEDIUM).otherwise(LOW), F.when(subset, "DOCTYPE with an internal subset").otherwise("DOCTYPE"), remediated=F.lit(modify)),
        finding(goes_on & has_instruction, "svg.processing_instruction", MEDIUM, "processing instructions", remediated=F.lit(modify)),
    )
    return found, F.when(goes_on & ~bare.rlike(entity), F.encode(bare, "ISO-8859-1"))


# ---------------------------------------------------------------- files to nodes


def _split(tag: str) -> tuple[str, str]:
    ns, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return ns, local.lower()


def _attribute(raw: str, value: str) -> dict:
    ns, local = _split(raw)
    return {"raw": raw, "name": {XLINK_NS: "xlink:", XML_NS: "xml:"}.get(ns, "") + local, "value": value}


def list_nodes(payload: str, content: bytes, max_depth: int) -> list[dict]:
    """A row per element, numbered in document order.

    visit: the order of a walk that takes up the last child first; last: the largest number
    inside the element, so that what stands inside it is known by numbers alone.
    """
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return [{"payload_id": payload, "node": -1, "visit": 0, "error": str(e)}]
    every = list(root.iter())
    number = {id(e): i for i, e in enumerate(every)}
    last = list(range(len(every)))
    for i in range(len(every) - 1, -1, -1):
        if len(every[i]):
            last[i] = last[number[id(every[i][-1])]]
    rows: list[dict] = []

    def add(e: ET.Element, parent: int | None, depth: int) -> dict:
        ns, local = _split(e.tag)
        style = "".join(e.itertext()) if local == "style" else None
        rows.append({"payload_id": payload, "node": number[id(e)], "parent": parent, "visit": len(rows), "depth": depth, "last": last[number[id(e)]], "ns": ns, "local": local, "attributes": [_attribute(k, v) for k, v in e.attrib.items()], "style": style, "too_deep": False})
        return rows[-1]

    stack = [(root, add(root, None, 1))]
    while stack:
        e, row = stack.pop()
        if row["depth"] > max_depth:
            row["too_deep"] = True
            continue
        stack += [(c, add(c, row["node"], row["depth"] + 1)) for c in e]
    return rows


def nodes(files: DataFrame, policy: SvgPolicy = SvgPolicy(), key: str = "payload_id", content: str = "content") -> DataFrame:  # noqa: B008
    """svg_nodes of files that can be parsed; one row with an error (node -1) of those that cannot."""
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    special = {"attributes": pa.list_(pa.struct([(n, pa.string()) for n in ("raw", "name", "value")]))}
    schema = pa.schema([(n, special.get(n) or kinds[t]) for n, t in (f.split(" ", 1) for f in NODE.replace(f"array<{_ATTRIBUTE}>", "attributes").split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload, data = (c[i].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_pylist(list_nodes(payload, data, policy.max_depth), schema=schema)

    return files.where(F.col(content).isNotNull()).select(F.col(key).cast("string"), content).mapInArrow(run, NODE)


# ---------------------------------------------------------------- rules


def element_verdict(policy: SvgPolicy) -> Column:
    """A finding where an element of svg_nodes has to go, else null."""
    ns, local, style, attributes = (F.col(c) for c in ("ns", "local", "style", "attributes"))
    value = lambda name: F.try_element_at(F.filter(attributes, lambda a: a["raw"] == name), F.lit(1))["value"]
    named = lambda text: F.concat(F.lit("<"), local, F.lit(text))
    foreign = (ns != "") & ~ns.isin(*NAMESPACES.values())
    animation = local.isin(*ANIMATIONS)
    target = F.lower(F.trim(F.coalesce(value("attributeName"), F.lit(""))))
    scripted = any_of([F.exists(F.split(F.coalesce(value(v), F.lit("")), ";", -1), lambda u: classify_url(u).isin("script", "data_other")) for v in ANIMATED_VALUES])
    each = [
        finding(foreign, "svg.foreign_element", F.when(ns == XHTML_NS, HIGH).otherwise(MEDIUM), F.concat(named("> of the namespace "), ns)),
        finding(local == "script", "svg.script", CRITICAL, "<script>"),
        finding(local == "foreignobject", "svg.foreign_object", HIGH, "<foreignObject>"),
        finding(local.isin(*DANGEROUS_ELEMENTS, *policy.blocked_elements), "svg.dangerous_element", HIGH, named("> has no place in SVG")),
        finding(animation & F.lit(not policy.allow_animation), "svg.animation", LOW, named("> is not allowed")),
        finding(animation & (target.isin("href", "xlink:href", "style", "onload") | target.endswith(":href")), "svg.animated_href", HIGH, F.concat(named("> animates "), target)),
        finding(animation & scripted, "svg.javascript_uri", CRITICAL, named("> sets a script URL")),
        finding((local == "style") & F.lit(not policy.allow_style), "svg.style", LOW, "<style> is not allowed"),
        finding((local == "style") & css_scripts(F.coalesce(style, F.lit(""))), "svg.css_script", CRITICAL, "<style> can run script"),
        finding((local == "a") & F.lit(not policy.allow_links), "svg.link", LOW, "<a> is not allowed"),
    ]
    return F.coalesce(*each)


def _css_finding(css: Column, where: str, policy: SvgPolicy) -> Column:
    return F.coalesce(
        finding(css_scripts(css), "svg.css_script", CRITICAL, f"CSS in {where} can run script"),
        finding(css_reaches_out(css, policy.allow_data_images, policy.allow_external_references), "svg.external_reference", MEDIUM, f"url() in {where} reaches out"),
    )


def attribute_verdict(element: Column, name: Column, value: Column, policy: SvgPolicy) -> tuple[Column, Column]:
    """(finding or null, replacement or null): without a replacement the attribute goes."""
    kind, href = classify_url(value), name.isin("href", "xlink:href")
    of = F.concat(F.lit("<"), element, F.lit(" "), name, F.lit(">"))
    plain = href & (element != "a")
    image = element.isin("image", "feimage") & F.lit(policy.allow_data_images)
    style = name == "style"
    paint_url = F.regexp_extract(value, CSS_URL, 2)
    paints = name.isin(*PAINTS) & value.rlike(CSS_URL) & (classify_url(paint_url) != "fragment")
    odd_target = (name == "target") & ~F.lower(F.trim(value)).isin("", "_self", "_blank", "_parent", "_top")
    event, removed = name.startswith("on") & (F.length(name) > 2), name.isin(*REMOVED_ATTRIBUTES, *policy.blocked_attributes)
    found = F.coalesce(
        finding(event, "svg.event_handler", CRITICAL, F.concat(F.lit("event handler "), name)),
        finding(removed, "svg.dangerous_attribute", HIGH, F.concat(F.lit("attribute "), name)),
        finding(href & (kind == "script"), "svg.javascript_uri", CRITICAL, F.concat(F.lit("script URL in "), of)),
        finding(href & (kind == "data_other"), "svg.data_uri", HIGH, F.concat(F.lit("data: URL that is no image in "), of)),
        finding(href & (kind == "unknown_scheme"), "svg.unknown_scheme", MEDIUM, F.concat(F.lit("unknown scheme in "), of)),
        finding(plain & (kind == "data_image") & ~image, "svg.data_uri", MEDIUM, F.concat(F.lit("data: URL in "), of)),
        finding(plain & kind.isin("external", "relative") & F.lit(not policy.allow_external_references), "svg.external_reference", F.when(element == "use", HIGH).otherwise(MEDIUM), F.concat(F.lit("external reference in "), of)),
        finding(style & F.lit(not policy.allow_style), "svg.style", LOW, "style attributes are not allowed"),
        F.when(style, _css_finding(value, "a style attribute", policy)),
        finding(paints, "svg.external_reference", F.when(classify_url(paint_url) == "script", CRITICAL).otherwise(MEDIUM), F.concat(F.lit("url() is not local in "), of)),
        finding(odd_target, "svg.dangerous_attribute", LOW, "unusual target"),
    )
    replacement = F.when(style & (found["code"] == "svg.external_reference"), css_cleaned(value)).when(odd_target & ~event & ~removed & (found["severity"] == LOW), "_blank")
    return found, replacement


_VERDICT = f"struct<finding:{FINDING},node:int,raw:string,replacement:string,style:string,gone:boolean>"


def _remediated(f: Column, modify: bool) -> Column:
    return F.when(f.isNotNull(), F.struct(f["code"].alias("code"), f["severity"].alias("severity"), f["message"].alias("message"), f["detail"].alias("detail"), F.lit(modify).alias("remediated")).cast(FINDING))


def _outside(svg_nodes: DataFrame, which: Column) -> DataFrame:
    """The nodes that stand inside none of those that `which` picks."""
    before = Window.partitionBy("payload_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return svg_nodes.withColumn("_end", F.max(F.when(which, F.col("last"))).over(before)).where(F.coalesce(F.col("_end") < F.col("node"), F.lit(True))).drop("_end")


def verdicts(svg_nodes: DataFrame, policy: SvgPolicy, modify: bool) -> DataFrame:
    """(payload_id, visit, verdicts): per visited element what is wrong with it and what is to be done.

    When files are put right, elements inside removed ones are not visited; when they are
    only scanned, they are.
    """
    rooted = svg_nodes.withColumn("_gone", F.when(F.col("visit") > 0, element_verdict(policy)))
    if modify:
        rooted = _outside(rooted, F.col("_gone").isNotNull())
    counted = rooted.withColumn("_rank", F.row_number().over(Window.partitionBy("payload_id").orderBy("visit")))
    excess = F.col("_rank") > policy.max_elements
    counted = _outside(counted, excess)  # an element beyond the limit is told of only if the one around it is within
    none = lambda t: F.lit(None).cast(t)

    def verdict(f: Column, raw=None, replacement=None, style=None, gone: bool = False) -> Column:
        fields = (_remediated(f, modify).alias("finding"), F.col("node").alias("node"), (none("string") if raw is None else raw).alias("raw"), (none("string") if replacement is None else replacement).alias("replacement"), (none("string") if style is None else style).alias("style"), F.lit(gone).alias("gone"))
        return F.when(f.isNotNull(), F.struct(*fields).cast(_VERDICT))

    def of_attribute(a: Column) -> Column:
        f, replacement = attribute_verdict(F.col("local"), a["name"], a["value"], policy)
        return verdict(f, a["raw"], replacement)

    too_many = verdict(finding(excess, "svg.too_many_elements", HIGH, f"over {policy.max_elements} elements"), gone=True)
    whole = verdict(F.col("_gone"), gone=True)
    css = F.coalesce(F.col("style"), F.lit(""))
    css_found = F.when((F.col("local") == "style") & (F.col("visit") > 0), _css_finding(css, "<style>", policy))
    style = verdict(css_found, style=F.when(css_found["code"] == "svg.external_reference", F.regexp_replace(css_cleaned(css), "(?i)@import[^;]*;?", "")).otherwise(""))
    followed = ~excess & (F.lit(not modify) | F.col("_gone").isNull())
    deep = verdict(finding(F.col("too_deep") & followed, "svg.too_deep", HIGH, f"elements nested deeper than {policy.max_depth}"), raw=F.lit("*"))
    fine = F.concat(F.transform("attributes", of_attribute), F.array(style))
    each = F.when(excess, F.array(too_many)).when(F.col("_gone").isNotNull(), F.array(whole)).otherwise(fine)
    # elements that go are still looked into when files are only scanned, and so may be too deep
    return counted.select("payload_id", "visit", F.filter(F.concat(each, F.array(deep)), lambda v: v.isNotNull()).alias("verdicts")).where(F.size("verdicts") > 0)


@F.pandas_udf(T.BinaryType())
def _rewritten(contents: pd.Series, edits: pd.Series) -> pd.Series:
    """Each file with its edits made, as XML with a declaration."""
    for prefix, uri in NAMESPACES.items():
        if prefix != "xml":
            ET.register_namespace(prefix, uri)

    def rewrite(content: bytes | None, todo) -> bytes | None:
        if content is None:
            return None
        root = ET.fromstring(content)
        every, gone = list(root.iter()), set()
        for edit in todo if todo is not None else ():
            e = every[edit["node"]]
            if edit["gone"]:
                gone.add(id(e))
            elif edit["raw"] == "*":
                e[:] = []
            elif edit["style"] is not None:
                e[:] = []
                e.text = edit["style"]
            elif edit["replacement"] is None:
                e.attrib.pop(edit["raw"], None)
            else:
                e.attrib[edit["raw"]] = edit["replacement"]
        for e in every if gone else ():
            if any(id(c) in gone for c in e):
                _take_out(e, gone)
        if not root.tag.startswith("{"):
            root.set("xmlns", SVG_NS)
        return ET.tostring(root, encoding="utf-8", xml_declaration=True)

    return pd.Series([rewrite(c, e) for c, e in zip(contents, edits, strict=True)], dtype=object)


def _take_out(parent: ET.Element, gone: set[int]) -> None:
    """Remove the children that are in gone; the text after each stays."""
    kept, text = [], [parent.text or ""]

    def settle() -> None:
        if len(text) > 1:
            if kept:
                kept[-1].tail = "".join(text)
            else:
                parent.text = "".join(text)

    for child in parent:
        if id(child) in gone:
            text.append(child.tail or "")
        else:
            settle()
            kept.append(child)
            text = [child.tail or ""]
    settle()
    parent[:] = kept


def _inspect(files: DataFrame, policy: SvgPolicy, modify: bool, key: str, content: str) -> DataFrame:
    ship(files.sparkSession)
    found, cleaned = before_parsing(F.col(content), policy, modify)
    ready = files.select(F.col(key).cast("string").alias("payload_id"), found.alias("_before"), cleaned.alias("content"))
    ready = durable(ready)
    listed = durable(nodes(ready, policy))
    root_local, root_ns = F.col("local"), F.col("ns")
    tops = listed.where("visit = 0").select(
        "payload_id",
        findings(
            finding(F.col("error").isNotNull(), "svg.parse_error", HIGH, F.concat(F.lit("not well-formed: "), F.col("error"))),
            finding(root_local != "svg", "svg.not_svg", HIGH, F.concat(F.lit("the root is <"), root_local, F.lit(">"))),
            finding((root_local == "svg") & ~root_ns.isin("", SVG_NS), "svg.not_svg", HIGH, F.concat(F.lit("the root is in the namespace "), root_ns)),
        ).alias("_root"),
    )
    sound = listed.join(tops.where(F.size("_root") == 0).select("payload_id"), "payload_id", "left_semi")
    told = verdicts(sound, policy, modify)
    by_visit = F.array_sort(F.collect_list(F.struct("visit", "verdicts")), lambda a, b: F.when(a["visit"] < b["visit"], -1).when(a["visit"] > b["visit"], 1).otherwise(0))
    gathered = told.groupBy("payload_id").agg(F.flatten(F.transform(by_visit, lambda s: s["verdicts"])).alias("_told"))
    joined = ready.join(tops, "payload_id", "left").join(gathered, "payload_id", "left")
    every = F.concat("_before", F.coalesce("_root", no_findings()), F.transform(F.coalesce("_told", F.array().cast(f"array<{_VERDICT}>")), lambda v: v["finding"]))
    edits = F.transform("_told", lambda v: F.struct(v["node"].alias("node"), v["raw"].alias("raw"), v["replacement"].alias("replacement"), v["style"].alias("style"), v["gone"].alias("gone")))
    sanitized = _rewritten(F.when(F.size("_root") == 0, F.col("content")), edits) if modify else F.lit(None).cast("binary")
    return joined.select("payload_id", every.alias("svg_findings"), sanitized.alias("sanitized"))


def scan_svg(files: DataFrame, policy: SvgPolicy = SvgPolicy(), key: str = "payload_id", content: str = "content") -> DataFrame:  # noqa: B008
    """(payload_id, svg_findings, sanitized = null): what is wrong, nothing changed."""
    return _inspect(files, policy, False, key, content)


def sanitize_svg(files: DataFrame, policy: SvgPolicy = SvgPolicy(), key: str = "payload_id", content: str = "content") -> DataFrame:  # noqa: B008
    """(payload_id, svg_findings, sanitized): what was wrong, and the file without it; null where it is refused."""
    return _inspect(files, policy, True, key, content)


def is_clean(found: Column) -> Column:
    return ~F.exists(found, lambda f: (f["severity"] >= MEDIUM) & ~f["remediated"])
