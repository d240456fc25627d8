"""SVG files: each rule has a file of its own, made here from the rule, which states what is found and what is left."""

from __future__ import annotations

import time
from typing import NamedTuple

import pytest

from assay.operators import svg
from assay.operators.svg import SvgPolicy

OPEN = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="7">'
#: Content that no rule is about, and that stands in every file.
PLAIN = '<title>chart</title><path d="M0 0h7"/>'


class Case(NamedTuple):
    """inner: what stands in the file besides; found: codes without `svg.`; gone, left: what a file put right has not and has."""

    inner: str
    found: list[str]
    gone: str = ""
    left: str = ""


CASES = {
    "nothing": Case('<g id="q"><ellipse rx="2" stroke="url(#q)"/></g>', [], left="ellipse"),
    "script element": Case("<g><script>n = 1</script><line y1='3'/></g>", ["script"], "n = 1", "<line"),
    "handler": Case('<polygon onfocusin="n()" points="1,2"/>', ["event_handler"], "onfocusin", "points"),
    "script address": Case('<a href="javascript:n()"><tspan>go</tspan></a>', ["javascript_uri"], "n()", "tspan"),
    "script address with a tab inside": Case('<a href="java&#9;script:n()"><tspan>go</tspan></a>', ["javascript_uri"], "n()", "tspan"),
    "data that is no image": Case('<use href="data:application/xml,q"/>', ["data_uri"], "application/xml"),
    "data that is an image": Case('<image href="data:image/webp;base64,UklG"/>', [], left="data:image/webp"),
    "other document in it": Case("<foreignObject><p>q</p></foreignObject>", ["foreign_object"], "foreignObject"),
    "embedding element": Case('<embed src="q.swf"/>', ["dangerous_element"], "q.swf"),
    "element of another language": Case('<m:math xmlns:m="http://www.w3.org/1998/Math/MathML"/>', ["foreign_element"], "math"),
    "file of another host": Case('<image href="http://pictures.test/q.gif"/>', ["external_reference"], "pictures.test"),
    "link to another host": Case('<a href="http://pictures.test/page"><tspan>go</tspan></a>', [], left="pictures.test/page"),
    "style that runs": Case('<style>g { behavior: url(q.htc) }</style>', ["css_script"], "behavior"),
    "style that loads": Case("<style>@import '//fonts.test/q.css';</style>", ["css_script"], "fonts.test"),
    "attribute that loads": Case('<rect filter="url(//fonts.test/f.svg#f)"/>', ["external_reference"], "fonts.test", "<rect"),
    "animation of an address": Case('<a href="#q"><set attributeName="href" to="#r"/></a>', ["animated_href"], "attributeName"),
    "animation to a script": Case('<animate attributeName="fill" values="red;javascript:n()"/>', ["javascript_uri"], "n()"),
}
WHOLE = {
    "processing instruction": ("<?q-tool r?>" + OPEN + PLAIN + "</svg>", ["processing_instruction"], "q-tool"),
    "document type": ("<!DOCTYPE svg>" + OPEN + PLAIN + "</svg>", ["doctype"], "DOCTYPE"),
    "entity": ('<!DOCTYPE svg [<!ENTITY q "r">]>' + OPEN + PLAIN + "</svg>", ["entity_declaration"], "ENTITY"),
    "another root": ("<note>" + PLAIN + "</note>", ["not_svg"], None),
    "no end": (OPEN + PLAIN, ["parse_error"], None),
}
WORDS = [f"w{i}" for i in range(6)]
MORE = {
    "words": f"{OPEN}<desc>{WORDS[0]}" + "".join(f"<script>{i}</script>{p}" if i % 2 else f"<tspan/>{p}" for i, p in enumerate(WORDS[1:])) + "</desc></svg>",
    "removed": f"{OPEN}<embed><script>1</script><g><script>2</script></g></embed><script>3</script></svg>",
    "bare": "<svg><circle r='4'/></svg>",
}
FILES = MORE | {n: OPEN + PLAIN + c.inner + "</svg>" for n, c in CASES.items()} | {n: f for n, (f, _, _) in WHOLE.items()}


def look(spark, modify: bool, policy: SvgPolicy = SvgPolicy(), files: dict[str, str] = FILES) -> dict:
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in files.items()], "payload_id string, content binary")
    return {r["payload_id"]: r for r in (svg.sanitize_svg if modify else svg.scan_svg)(rows, policy).collect()}


@pytest.fixture(scope="module")
def scanned(spark):
    return look(spark, False)


@pytest.fixture(scope="module")
def cleaned(spark):
    return look(spark, True)


def codes(r) -> list[str]:
    return sorted(f["code"].removeprefix("svg.") for f in r["svg_findings"])


def text(r) -> str:
    return bytes(r["sanitized"]).decode()


def test_what_is_found(scanned):
    want = {n: c.found for n, c in CASES.items()} | {n: found for n, (_, found, _) in WHOLE.items()}
    assert {n: [c for c in codes(r) if c in set(sum(want.values(), []))] for n, r in scanned.items() if n not in MORE} == want
    assert not any(f["remediated"] for r in scanned.values() for f in r["svg_findings"])


@pytest.mark.parametrize("name", [n for n, c in CASES.items()])
def test_what_is_left(cleaned, name):
    case, out = CASES[name], text(cleaned[name])
    assert "chart" in out and 'd="M0 0h7"' in out and 'width="7"' in out
    assert not case.gone or case.gone not in out
    assert case.left in out
    assert all(f["remediated"] for f in cleaned[name]["svg_findings"] if f["severity"] >= 20)


def test_whole_files(cleaned):
    for name, (_, _, gone) in WHOLE.items():
        r = cleaned[name]
        assert r["sanitized"] is None if gone is None else r["sanitized"] is None or gone not in text(r), name


def test_what_was_put_right_is_clean(spark, cleaned):
    again = look(spark, False, files={n: text(r) for n, r in cleaned.items() if r["sanitized"]})
    assert {n: [f["code"] for f in r["svg_findings"] if f["severity"] >= 20] for n, r in again.items()} == {n: [] for n in again}


def test_text_around_removed_elements_stays(cleaned):
    out = text(cleaned["words"])
    assert [p for p in WORDS if p in out] == WORDS and out.count("tspan") == 3 and "script" not in out


def test_a_removed_element_takes_what_it_holds_along(scanned, cleaned):
    assert codes(cleaned["removed"]) == ["dangerous_element", "script"]
    assert codes(scanned["removed"]) == ["dangerous_element", "script", "script", "script"]


def test_a_file_without_namespace_gets_one(cleaned):
    out = text(cleaned["bare"])
    assert 'xmlns="http://www.w3.org/2000/svg"' in out and "circle" in out


#: file, what a strict policy takes out of it, what it leaves
STRICT = [
    ('<image href="data:image/webp;base64,UklG"/>', "data:image", "path"),
    ("<style>g{}</style><g style='a:b'/>", "style", "<g"),
    ("<set attributeName='x' to='2'/>", "<set", "path"),
    ('<a href="http://pictures.test/page"/>', "pictures.test", "path"),
    ("<ellipse rx='2'/><line/>", "ellipse", "<line"),
    ("<line lang='q' y1='3'/>", "lang", "y1"),
]


def test_policies(spark):
    strict = SvgPolicy(allow_data_images=False, allow_style=False, allow_animation=False, allow_links=False, blocked_elements=frozenset({"ellipse"}), blocked_attributes=frozenset({"lang"}))
    found = look(spark, True, strict, {str(i): OPEN + PLAIN + inner + "</svg>" for i, (inner, _, _) in enumerate(STRICT)})
    for i, (_, gone, left) in enumerate(STRICT):
        assert gone not in text(found[str(i)]) and left in text(found[str(i)])
    reaching = CASES["file of another host"].inner
    assert "pictures.test" in text(look(spark, True, SvgPolicy(allow_external_references=True), {"x": OPEN + reaching + "</svg>"})["x"])


def test_limits(spark):
    files = {"wide": OPEN + "<g/>" * 30 + "</svg>", "deep": OPEN + "<g>" * 9 + "</g>" * 9 + "</svg>", "long": OPEN + " " * 500 + "</svg>"}
    policy = SvgPolicy(max_elements=11, max_depth=5, max_bytes=400)
    got, out = look(spark, False, policy, files), look(spark, True, policy, files)
    assert {n: {c for c in codes(r) if c.startswith("too_")} for n, r in got.items()} == {"wide": {"too_many_elements"}, "deep": {"too_deep"}, "long": {"too_large"}}
    assert all(out[n]["sanitized"] is None or text(out[n]).count("<g") <= most for n, most in (("wide", 11), ("deep", 5)))


def test_time_follows_the_size_of_a_file(spark):
    n = 20_000
    start = time.monotonic()
    got = look(spark, True, files={"x": OPEN + "<g><script>1</script><line/></g>w" * n + "</svg>"})["x"]
    assert codes(got) == ["script"] * n and text(got).count("<line") == n
    assert time.monotonic() - start < 120
