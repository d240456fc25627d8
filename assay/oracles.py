"""DuckDB SQL for the triage queries, written from the rules and not from the Spark expressions."""

from __future__ import annotations

from assay import derived, wrapped
from assay.functions import names, paths, polyglot, registry, urls
from assay.functions.binary import BRANDS, DIB_SIZES
from assay.functions.text import HTML_TAGS
from assay.queries import OWN_MARKERS, RULES


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + ")"


def _aliased(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in registry.EXTENSION_ALIASES.items()) + f" ELSE {x} END"


_EXT = "'^[A-Za-z0-9][A-Za-z0-9_\\-+~]{0,15}\\n?$'"
_PARTED = f"""
    b AS (SELECT *, replace(filename, '\\', '/') AS normal, string_split(replace(filename, '\\', '/'), '/')[-1] AS base FROM u),
    n AS (SELECT *, rtrim(base, '. ') AS name FROM b),
    p AS (SELECT *, lower(string_split(name, '.')[-1]) AS last FROM n),
    q AS (SELECT *, contains(name, '.') AND length(name) > length(last) + 1 AND regexp_matches(last, {_EXT}) AS has FROM p),
    c AS (SELECT *, CASE WHEN has THEN last END AS extension, CASE WHEN has THEN substr(name, 1, length(name) - length(last) - 1) ELSE name END AS stem,
                 list_transform(list_filter(string_split(ltrim(name, '.'), '.')[2:], lambda x: regexp_matches(x, {_EXT})), lambda x: lower(x)) AS suffixes FROM q),
    d AS (SELECT *, {_aliased("extension")} AS usual, list_transform(suffixes[:len(suffixes) - 1], lambda x: {_aliased("x")}) AS inner_ones FROM c)"""
_CUT = f"u AS ({derived.UPLOADS_SQL}), {_PARTED}"
_DANGEROUS = _list({registry.canonical(e) for e in names.DANGEROUS_EXTENSIONS})
_KNOWN = _list(registry.known_extensions())
_CODES = f"""concat_ws(',',
    CASE WHEN contains(filename, chr(0)) THEN 'filename.null_byte:40' END,
    CASE WHEN regexp_matches(replace(filename, chr(0), ''), '[{names.CONTROL}]') THEN 'filename.control_chars:30' END,
    CASE WHEN regexp_matches(filename, '[{names.BIDI}]') THEN 'filename.bidi_override:40' END,
    CASE WHEN regexp_matches(filename, '[{names.INVISIBLE}]') THEN 'filename.invisible_chars:20' END,
    CASE WHEN list_contains(string_split(normal, '/'), '..') OR normal = '.' THEN 'filename.path_traversal:40' END,
    CASE WHEN contains(normal, '/') THEN 'filename.path_separator:30' END,
    CASE WHEN regexp_matches(filename, '^([A-Za-z]:|/|\\\\)') AND (regexp_matches(filename, '^[A-Za-z]:') OR starts_with(normal, '/')) THEN 'filename.absolute_path:30' END,
    CASE WHEN lower(base) IN {_list(names.SERVER_CONFIG_FILES)} THEN 'filename.server_config:30' WHEN starts_with(base, '.') THEN 'filename.hidden:10' END,
    CASE WHEN string_split(lower(base), '.')[1] IN {_list(names.RESERVED_NAMES)} THEN 'filename.reserved_name:20' END,
    CASE WHEN base <> name AND trim(base) <> '' THEN 'filename.trailing_dot_space:10' END,
    CASE WHEN length(filename) > 255 THEN 'filename.too_long:20' END,
    CASE WHEN extension IS NULL THEN 'filename.no_extension:0' END,
    CASE WHEN usual IN {_DANGEROUS} THEN 'filename.dangerous_extension:30' WHEN usual IN {_list(names.BROWSER_ACTIVE_EXTENSIONS)} THEN 'filename.browser_active:20' END,
    CASE WHEN extension IS NOT NULL AND len(suffixes) > 1 THEN
         CASE WHEN len(list_filter(inner_ones, lambda x: x IN {_DANGEROUS})) > 0 THEN 'filename.double_extension:20'
              WHEN len(list_filter(inner_ones, lambda x: x IN {_KNOWN})) > 0 THEN 'filename.double_extension:0' END END)"""


def _first_mimes() -> dict[str, str]:
    found: dict[str, str] = {}
    for kind in registry.known_kinds():
        for e in kind.extensions:
            found.setdefault(registry.canonical(e), kind.mime)
    return found


def _case(x: str, pairs: dict, default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {default} END"


def _compatible() -> str:
    rows = []
    for key in derived.KINDS:
        kind = registry.KINDS[key]
        mimes = {kind.mime} | {m for e in kind.extensions for m in names.mimes_of_extension().get(registry.canonical(e), [])}
        mimes = {m.lower() for m in mimes}
        text = " OR starts_with(declared, 'text/')" if kind.category == "text" else ""
        rows.append(f"WHEN '{key}' THEN declared IN {_list(mimes)} OR alias IN {_list(mimes)}{text}")
    return f"CASE kind {' '.join(rows)} END"


def _rule(raw: str) -> str:
    hit = []
    for key in derived.KINDS:
        k = registry.KINDS[key]
        if raw.startswith("category:"):
            ok = k.category == raw[9:]
        elif raw.endswith("/*"):
            ok = k.mime.startswith(raw[:-1])
        elif "/" in raw:
            ok = k.mime == raw
        else:
            ok = raw.lstrip(".") in k.extensions
        hit += [key] * ok
    return f"kind IN {_list(hit)}"


def _at(i: int, n: int = 1) -> str:
    return f"substr(h, {2 * i + 1}, {2 * n})"


def _big(i: int, n: int) -> str:
    return f"TRY_CAST('0x' || {_at(i, n)} AS BIGINT)"


def _little(i: int, n: int) -> str:
    return "TRY_CAST('0x' || " + " || ".join(_at(i + j) for j in reversed(range(n))) + " AS BIGINT)"


def _signature(s) -> str:
    return f"{_at(s.offset, len(s.magic))} = '{s.magic.hex().upper()}'"


def _brand(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{b.replace('_', ' ').encode().hex().upper()}' THEN '{k}'" for k, v in BRANDS.items() for b in v.split()) + " END"


def _hex(s: str) -> str:
    return s.encode("latin-1").hex().upper()


def _binary() -> str:
    size = "octets"
    icon = f"{size} >= 22 AND {_little(4, 2)} BETWEEN 1 AND 256 AND {_at(9)} = '00' AND {_little(18, 4)} >= 6 + 16 * {_little(4, 2)} AND {_little(14, 4)} <> 0"
    fits = {
        "BMP": f"{size} >= 26 AND {_at(6, 4)} = '00000000' AND {_little(10, 4)} BETWEEN 26 AND 16777216 AND {_little(14, 4)} IN {DIB_SIZES}",
        "ICO": icon,
        "CUR": icon,
        "TTF": f"{size} >= 12 AND {_big(4, 2)} BETWEEN 1 AND 64",
        "MPEG_TS": f"{size} >= 377 AND {_at(188)} = '47' AND {_at(376)} = '47'",
        "MP3": f"{size} >= 4 AND {_big(2, 1)} // 16 NOT IN (0, 15) AND ({_big(2, 1)} // 4) % 4 <> 3",
        "ARJ": f"{size} >= 34 AND {_little(2, 2)} BETWEEN 30 AND 2600 AND {_at(10, 2)} = '0200'",
        "EOT": f"{size} >= 36 AND {_little(0, 4)} <> 0 AND {_little(4, 4)} <> 0 AND {_little(4, 4)} < {_little(0, 4)}",
    }
    compat = f"list_filter(list_transform(range(16, 253, 4), lambda i: CASE WHEN i < (CASE WHEN {_big(0, 4)} = 0 THEN least({size}, 64) ELSE least({_big(0, 4)}, {size}, 256) END) - 3 THEN {_brand('substr(h, 2 * i::INT + 1, 8)')} END), lambda x: x IS NOT NULL)[1]"
    doc = "regexp_extract(substr(h, 1, 256), '^((?:..)*?)4282', 1)"
    becomes = {
        "WAV": f"CASE {_at(8, 4)} WHEN '{_hex('WAVE')}' THEN 'WAV' WHEN '{_hex('AVI ')}' THEN 'AVI' WHEN '{_hex('WEBP')}' THEN 'WEBP' ELSE 'RIFF_GENERIC' END",
        "AIFF": f"CASE WHEN {_at(8, 4)} IN ('{_hex('AIFF')}', '{_hex('AIFC')}') THEN 'AIFF' ELSE 'IFF_GENERIC' END",
        "MP4": f"coalesce({_brand(_at(8, 4))}, CASE WHEN {_at(8, 3)} IN ('{_hex('3gp')}', '{_hex('3g2')}') THEN 'THREEGP' END, {compat}, 'MP4')",
        "MKV": f"CASE WHEN regexp_matches(substr(h, 1, 256), '^(?:..)*?4282') AND substr(h, length({doc}) + 7, 8) = '{_hex('webm')}' THEN 'WEBM' WHEN regexp_matches(substr(h, 1, 256), '^(?:..)*?4282') AND substr(h, length({doc}) + 7, 16) = '{_hex('matroska')}' THEN 'MKV' WHEN contains(substr(h, 1, 256), '{_hex('webm')}') THEN 'WEBM' ELSE 'MKV' END",
        "JAVA_CLASS": f"CASE WHEN {size} >= 8 AND {_big(4, 4)} < 45 THEN 'MACHO_FAT' ELSE 'JAVA_CLASS' END",
    }
    rows = []
    for s in registry.ORDERED:
        plain = s.magic in (b"ID3", b"true")
        if s.kind in fits and not plain:
            rows.append(f"WHEN {_signature(s)} THEN CASE WHEN {fits[s.kind]} THEN '{s.kind}' END")
        elif s.kind in becomes and not plain:
            rows.append(f"WHEN {_signature(s)} THEN {becomes[s.kind]}")
        else:
            rows.append(f"WHEN {_signature(s)} THEN '{s.kind}'")
    return "coalesce(" + ", ".join(f"CASE {r} END" for r in rows) + ")"


_HEAD = f"WITH raw AS ({derived.BLOBS_SQL}), b AS (SELECT k, substr(hex(content), 1, 4096) AS h, least(octet_length(content), 2048) AS octets FROM raw)"

_PROLOG = r"(?is)^\s*(?:<\?xml[^>]*\?>\s*|<!--.*?-->\s*|<!doctype[^>]*>\s*)*"
_TAG = "^<([A-Za-z_][A-Za-z0-9_.\\-]*)(?::([A-Za-z_][A-Za-z0-9_.\\-]*))?"


def _text_kinds(source: str) -> str:
    """Kinds of texts(k, body); starts that binary signatures would take are not among them."""
    return f"""
    WITH t AS ({source}), s AS (SELECT k, body, regexp_replace(body, '^\\s+', '') AS s FROM t),
    l AS (SELECT *, lower(substr(s, 1, 1024)) AS low, regexp_replace(s, '{_PROLOG}', '') AS rest, lower(regexp_extract(s, '{_PROLOG}', 0)) AS prolog FROM s),
    g AS (SELECT *, lower(CASE WHEN regexp_extract(rest, '{_TAG}', 2) <> '' THEN regexp_extract(rest, '{_TAG}', 2) ELSE regexp_extract(rest, '{_TAG}', 1) END) AS tag, regexp_extract(rest, '{_TAG}', 2) <> '' AS spaced,
                 contains(prolog, '<?xml') OR contains(prolog, '<!doctype') AS declared FROM l),
    m AS (SELECT *, CASE
        WHEN NOT starts_with(s, '<') THEN NULL
        WHEN contains(prolog, '<!doctype html') THEN 'HTML' WHEN contains(prolog, '<!doctype svg') THEN 'SVG'
        WHEN tag = '' THEN CASE WHEN declared THEN 'XML' END
        WHEN tag = 'svg' THEN 'SVG' WHEN tag = 'html' THEN CASE WHEN contains(lower(substr(rest, 1, 2048)), '<hta:application') THEN 'HTA' ELSE 'HTML' END
        WHEN tag IN ('rss', 'rdf') THEN 'RSS' WHEN tag = 'feed' THEN 'ATOM'
        WHEN tag IN ('job', 'package') AND contains(lower(substr(rest, 1, 2048)), '<script') THEN 'WINDOWS_SCRIPT'
        WHEN tag IN {_list(HTML_TAGS)} THEN 'HTML'
        WHEN declared OR spaced OR contains(substr(rest, 1, length(regexp_extract(rest, '{_TAG}', 0)) + 256), 'xmlns') OR contains(substr(rest, 1, 512), '>') THEN 'XML' END AS markup FROM g)
    SELECT k, CASE
        WHEN s = '' THEN CASE WHEN body <> '' THEN 'PLAIN' END
        WHEN contains(low, '<?php') OR starts_with(low, '<?=') THEN 'PHP'
        WHEN starts_with(s, '#!') THEN CASE WHEN regexp_matches(lower(regexp_extract(s, '^#![^\\n]*', 0)), '\\b(ba|z|k|da|c|tc)?sh\\b') THEN 'SHELL' ELSE 'SCRIPT' END
        WHEN starts_with(low, 'windows registry editor') OR starts_with(low, 'regedit4') THEN 'REG'
        WHEN starts_with(s, '-----BEGIN ') THEN 'PEM' WHEN starts_with(low, 'begin:vcard') THEN 'VCARD' WHEN starts_with(low, 'begin:vcalendar') THEN 'ICAL'
        WHEN regexp_matches(low, '^(from|return-path|received|mime-version|delivered-to|x-mailer):') THEN 'EMAIL'
        WHEN markup IS NOT NULL THEN markup
        WHEN regexp_matches(substr(s, 1, 1024), '(?i)<(!doctype\\s+html|({"|".join(HTML_TAGS)})[\\s>/])') THEN 'HTML'
        WHEN regexp_matches(low, '<svg[\\s>]') THEN 'SVG'
        WHEN regexp_matches(s, '^[\\[{{]\\s*(["\\]}}]|-?\\d|true|false|null|\\[|\\{{)') THEN 'JSON'
        ELSE 'PLAIN' END AS kind
    FROM m"""


def _marker_hex(pattern: str) -> str:
    """A marker as a pattern over hex digits."""
    insensitive = pattern.startswith("(?i)")
    body, out, i = pattern.removeprefix("(?i)"), "", 0
    one = lambda c: f"(?:{_hex(c.lower())}|{_hex(c.upper())})" if insensitive and c.isalpha() else _hex(c)
    while i < len(body):
        if body.startswith("[\\s>/]", i):
            out, i = out + "(?:09|0A|0B|0C|0D|20|3E|2F)", i + 6
        elif body[i] == "\\" and body[i + 1] == "x":
            out, i = out + body[i + 2 : i + 4].upper(), i + 4
        elif body[i] == "\\":
            out, i = out + one(body[i + 1]), i + 2
        else:
            out, i = out + one(body[i]), i + 1
    return out


def _markers() -> str:
    """Offsets of each marker, then the category's in order."""
    offsets = []
    for m in polyglot.MARKERS.values():
        pattern = f"^({'..' if m.first else ''}(?:..)*?){_marker_hex(m.pattern)}"
        offsets.append(f"CASE WHEN regexp_matches(h, '{pattern}') THEN length(regexp_extract(h, '{pattern}', 1)) // 2 END AS \"m_{m.name}\"")
    rows = []
    for key in dict.fromkeys(b[3] for b in derived.BODIES):
        kind = registry.KINDS[key]
        if kind.category in ("archive", "text", "script", "executable") or kind.mime == "application/rtf":
            rows.append(f"WHEN '{key}' THEN ''")
            continue
        own = "pdf" if kind.mime == "application/pdf" else ""
        each = [f"CASE WHEN \"m_{n}\" IS NOT NULL THEN 'polyglot.embedded_{n}:{polyglot.MARKERS[n].severity}:' || \"m_{n}\" END" for n in polyglot.CATEGORY_MARKERS[kind.category] if n != own]
        rows.append(f"WHEN '{key}' THEN concat_ws(',', {', '.join(each)})")
    return f"WITH b AS ({derived.BODIES_SQL}), x AS (SELECT k, kind, hex(content) AS h FROM b), o AS (SELECT k, kind, {', '.join(offsets)} FROM x) SELECT k, CASE kind {' '.join(rows)} END AS codes FROM o"


def _trailing() -> str:
    marks = {"PNG": _hex(polyglot.PNG_END), "JPEG": "FFD9", "GIF": "003B", "PDF": _hex("%%EOF")}
    clean = """CASE kind WHEN 'PNG' THEN ends_with(h, '49454E44AE426082') WHEN 'GIF' THEN ends_with(h, '3B')
        WHEN 'JPEG' THEN regexp_matches(h, '^(?:..)*?FFD9(?:00|FF|0A|0D|09|20){0,64}$') WHEN 'PDF' THEN regexp_matches(h, '^(?:..)*?2525454F46(?:0D|0A|09|20|00)*$') END"""
    after = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE WHEN regexp_matches(h, '^(?:..)*{m}') THEN (length(h) - length(regexp_extract(h, '^(?:..)*{m}', 0))) // 2 END" for k, m in marks.items()) + " END"
    readable = "regexp_matches(substr(h, length(h) - 2 * after + 1, 512), '^(?:[2-6].|7[0-9A-E]|09|0A|0D)*$') AND after > 8"
    return f"""
    WITH b AS ({derived.BODIES_SQL}), x AS (SELECT k, kind, hex(content) AS h FROM b), y AS (SELECT *, {clean} AS clean, {after} AS after FROM x)
    SELECT k, CASE WHEN kind NOT IN ('PNG', 'JPEG', 'GIF', 'PDF') OR clean THEN ''
        WHEN after IS NULL THEN CASE kind WHEN 'PDF' THEN 'polyglot.no_eof_marker:10:' ELSE 'polyglot.missing_eof:10:' END
        WHEN kind = 'PDF' AND after < 1024 THEN 'polyglot.trailing_data:0:' || after
        WHEN after = 0 THEN '' WHEN {readable} THEN 'polyglot.trailing_data:30:' || after ELSE 'polyglot.trailing_data:20:' || after END AS codes
    FROM y"""


def _url_class(x: str) -> str:
    """The class of a URL from which ignored characters are gone and which is in lower case."""
    return f"""CASE WHEN {x} = '' THEN 'empty' WHEN starts_with({x}, '#') THEN 'fragment'
        WHEN NOT regexp_matches({x}, '^[a-z][a-z0-9+.\\-]*:') THEN CASE WHEN starts_with({x}, '//') THEN 'external' ELSE 'relative' END
        WHEN string_split({x}, ':')[1] IN {_list(urls.SCRIPT_SCHEMES)} THEN 'script'
        WHEN string_split({x}, ':')[1] = 'data' THEN CASE WHEN regexp_extract({x}, '^data:([a-z0-9!#$&^_.+\\-]+/[a-z0-9!#$&^_.+\\-]+)', 1) IN {_list(urls.IMAGE_TYPES)} THEN 'data_image' ELSE 'data_other' END
        WHEN string_split({x}, ':')[1] IN {_list(urls.LINK_SCHEMES)} THEN 'external' ELSE 'unknown_scheme' END"""


def _plain_url(x: str) -> str:
    return f"lower(regexp_replace({x}, '{urls.IGNORED}', '', 'g'))"


_CSS_URL = "(?i)url\\(\\s*[''\"]?([^''\")]*)[''\"]?\\s*\\)"
_CSS = f"""
    WITH s AS ({derived.STYLES_SQL}), c AS (SELECT k, regexp_replace(css, '(?s)/\\*.*?\\*/', '', 'g') AS css FROM s),
    u AS (SELECT *, list_transform(list_transform(regexp_extract_all(css, '{_CSS_URL}', 1), lambda x: {_plain_url("x")}), lambda x: {_url_class("x")}) AS classes FROM c)
    SELECT k, regexp_matches(css, '(?i)expression\\s*\\(|javascript\\s*:|vbscript\\s*:|-moz-binding|behaviou?r\\s*:|-o-link|@import|data\\s*:\\s*text') AS scripts,
           len(list_filter(classes, lambda x: x NOT IN ('fragment', 'data_image'))) > 0 AS reaches_out,
           regexp_replace(regexp_replace(regexp_replace(css, '(?i)url\\(\\s*([''"]?)(\\s*#[^''")]*)([''"]?)\\s*\\)', chr(1) || '\\0' || chr(2), 'g'), '(^|[^' || chr(1) || '])' || '(?i:url)\\([^)]*\\)', '\\1none', 'g'), '[' || chr(1) || chr(2) || ']', '', 'g') AS cleaned
    FROM u"""

_UNSAFE = """CASE WHEN name = '' THEN false ELSE contains(name, chr(0)) OR starts_with(slashed, '/') OR regexp_matches(slashed, '^[A-Za-z]:')
    OR coalesce(list_min(list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: CASE WHEN p = '..' THEN -1 ELSE 1 END)))) < 0, false) END"""
_PARTS = f"WITH m AS ({derived.MEMBERS_SQL}), s AS (SELECT *, replace(name, '\\', '/') AS slashed, replace(target, '\\', '/') AS towards FROM m), p AS (SELECT *, list_filter(string_split(slashed, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM s)"


def _links() -> str:
    """Whether the folder of the member and the target, resolved, begin with `..`: each name cancels with the `..` after it, over and over."""
    resolved = "joined"
    for _ in range(8):
        resolved = f"regexp_replace({resolved}, '(^|/)(?:[^/.][^/]*|\\.[^/.][^/]*)/\\.\\.(/|$)', '\\1')"
    return f"""{_PARTS}, f AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(slashed, '[^/]*$', '') || towards, '/'), lambda x: x NOT IN ('', '.')), '/') AS joined FROM p)
    SELECT k, CASE WHEN target = '' THEN false ELSE starts_with(towards, '/') OR regexp_matches(towards, '^[A-Za-z]:') OR (NOT starts_with(slashed, '/') AND regexp_matches({resolved}, '^\\.\\.(/|$)')) END AS unsafe FROM f"""


_SAFE = f"""
    WITH u AS ({derived.UPLOADS_SQL}),
    a AS (SELECT k, regexp_replace(regexp_replace(string_split(replace(filename, '\\', '/'), '/')[-1], '[{names.CONTROL}{names.BIDI}{names.INVISIBLE}]', '', 'g'), '[^\\x00-\\x7f]', '', 'g') AS n FROM u),
    b AS (SELECT k, regexp_replace(trim(trim(regexp_replace(regexp_replace(n, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')), '. '), '_{{2,}}', '_', 'g') AS n FROM a),
    c AS (SELECT *, lower(string_split(rtrim(n, '. '), '.')[-1]) AS last FROM b),
    d AS (SELECT *, contains(n, '.') AND length(n) > length(last) + 1 AND regexp_matches(last, {_EXT}) AS has FROM c),
    e AS (SELECT *, CASE WHEN trim(CASE WHEN has THEN substr(n, 1, length(n) - length(last) - 1) ELSE n END, '. ') = '' THEN 'upload' ELSE trim(CASE WHEN has THEN substr(n, 1, length(n) - length(last) - 1) ELSE n END, '. ') END AS stem, CASE WHEN has THEN '.' || right(n, length(last)) ELSE '' END AS suffix FROM d),
    f AS (SELECT *, CASE WHEN string_split(lower(stem), '.')[1] IN {_list(names.RESERVED_NAMES)} THEN '_' || stem ELSE stem END AS safe FROM e)
    SELECT k, CASE WHEN n = '' THEN 'upload' ELSE (CASE WHEN length(safe) > 255 - length(suffix) THEN rtrim(left(safe, 255 - length(suffix)), '. ') ELSE safe END) || suffix END AS safe FROM f"""

_PAGES = f"""
    WITH u AS (SELECT page_id AS k, html, regexp_extract(url, '([^/?]*)(\\?.*)?$', 1) || {derived.sql_case("page_id", ["'.html'", "'.htm'", "'.png'", "''", "'.php.html'", "'.txt'"])} AS filename, {derived.sql_case("page_id", ["'text/html'", "'text/plain'", "'image/png'", "''"])} AS declared FROM pages),
    {_PARTED},
    named AS (SELECT *, CASE WHEN filename = '' THEN 'filename.empty:30' ELSE replace({_CODES}, 'filename.no_extension:0', 'extension.missing:30') END AS found FROM d),
    -- every page is HTML
    f AS (SELECT k, concat_ws(',', CASE WHEN octet_length(encode(html)) = 0 THEN 'size.empty:30' END, found, CASE WHEN usual NOT IN {_list({registry.canonical(e) for e in registry.KINDS["HTML"].extensions})} THEN 'extension.mismatch:30' END,
                CASE WHEN declared = 'image/png' THEN 'content_type.mismatch:10' END) AS codes FROM named),
    l AS (SELECT k, list_filter(string_split(codes, ','), lambda x: x <> '' AND x <> 'filename.browser_active:20') AS each FROM f),
    v AS (SELECT *, array_to_string(each, ',') AS codes, list_filter(each, lambda x: string_split(x, ':')[2]::INT >= 20) AS errors FROM l)"""


def _first_at(name: str, content: bytes, first: int) -> str:
    """The byte offset of the first place of a text, from its first character or from the one after."""
    sought = " || ".join(f"chr({b})" for b in content)
    return f"CASE WHEN strpos(substr(t, {first + 1}), {sought}) > 0 THEN octet_length(encode(substr(t, 1, strpos(substr(t, {first + 1}), {sought}) - 1 + {first}))) END::BIGINT AS at_{name}"


ORACLES: dict[str, str] = {
    "filename_findings": f"WITH {_CUT} SELECT k, {_CODES} AS codes FROM d",
    "filename_rollup": f"WITH {_CUT}, x AS (SELECT unnest(string_split({_CODES}, ',')) AS c FROM d) SELECT string_split(c, ':')[1] AS code, string_split(c, ':')[2]::INT AS severity, count(*) AS n FROM x WHERE c <> '' GROUP BY ALL",
    "split_extension": f"WITH {_CUT} SELECT k, stem, extension FROM d",
    "all_suffixes": f"WITH {_CUT} SELECT k, array_to_string(suffixes, '|') AS suffixes FROM d",
    "filename_safe_ascii": _SAFE,
    "extension_lookup": f"WITH {_CUT} SELECT k, coalesce(usual, '') AS usual, {_case('usual', _first_mimes())} AS mime FROM d",
    "extension_join": f"WITH {_CUT} SELECT k, usual AS canonical, ({_case('usual', {e: str(len(m)) for e, m in names.mimes_of_extension().items()})})::BIGINT AS types FROM d WHERE usual IN {_KNOWN}",
    "extension_match": f"WITH {_CUT} SELECT k, coalesce(CASE kind " + " ".join(f"WHEN '{k}' THEN usual IN {_list({registry.canonical(e) for e in registry.KINDS[k].extensions})}" for k in derived.KINDS) + " END, false) AS matches FROM d",
    "content_type_compat": f"WITH u AS ({derived.UPLOADS_SQL}), n AS (SELECT k, kind, CASE WHEN content_type <> '' THEN lower(trim(string_split(content_type, ';')[1])) END AS declared FROM u), a AS (SELECT *, {_case('declared', names.CONTENT_TYPE_ALIASES)} AS alias FROM n) SELECT k, declared, coalesce({_compatible()}, false) AS compatible FROM a",
    "type_rules": f"WITH u AS ({derived.UPLOADS_SQL}) SELECT k, {', '.join(f'{_rule(r)} AS rule_{i}' for i, r in enumerate(RULES))}, {' OR '.join(_rule(r) for r in RULES)} AS any_rule FROM u",
    "type_rules_join": f"WITH u AS ({derived.UPLOADS_SQL}) SELECT k, {', '.join(f'{_rule(r)} AS rule_{i}' for i, r in enumerate(RULES))}, {' OR '.join(_rule(r) for r in RULES)} AS any_rule FROM u",
    "size_findings": f"WITH u AS ({derived.UPLOADS_SQL}) SELECT k, CASE WHEN k % 7 = 0 OR size > 5000 THEN 'size.too_large:30' WHEN size = 0 THEN 'size.empty:30' WHEN size < 5 THEN 'size.too_small:30' ELSE '' END AS codes FROM u",
    "signature_first": f"{_HEAD} SELECT k, (CASE {' '.join(f'WHEN {_signature(s)} THEN {i}' for i, s in enumerate(registry.ORDERED))} END)::INT AS rank FROM b",
    "signature_join": f"{_HEAD}, s AS (SELECT k, (CASE {' '.join(f'WHEN {_signature(s)} THEN {i}' for i, s in enumerate(registry.ORDERED))} END)::INT AS rank FROM b) SELECT k, rank FROM s WHERE rank IS NOT NULL",
    "binary_kinds": f"{_HEAD} SELECT k, {_binary()} AS kind FROM b",
    "control_ratio": f"""{_HEAD}, plain AS (SELECT k, CASE WHEN starts_with(h, 'EFBBBF') THEN substr(h, 7) ELSE h END AS h, h AS whole, starts_with(h, 'FFFE') OR starts_with(h, 'FEFF') AS wide FROM b),
        c AS (SELECT k, h, wide, len(regexp_extract_all(substr(whole, 1, 2048), '0[0-8BCEF]|1[0-9AC-F]|7F|..')) AS n, len(list_filter(regexp_extract_all(substr(whole, 1, 2048), '..'), lambda x: regexp_matches(x, '0[0-8BCEF]|1[0-9AC-F]|7F'))) AS controls, regexp_matches(h, '^(?:..)*?00') AS nul FROM plain)
        SELECT k, controls::INT AS controls, NOT wide AND (nul OR controls > greatest(2, n // 20)) AS "binary" FROM c""",
    "text_kinds": _text_kinds(derived.TEXTS_SQL),
    "page_kinds": _text_kinds("SELECT page_id AS k, html AS body FROM pages"),
    "json_kinds": f"SELECT kind, count(*) AS n FROM ({_text_kinds('SELECT event_id AS k, props AS body FROM events')}) GROUP BY kind",
    "markup_prologs": f"WITH t AS ({derived.TEXTS_SQL}), x AS (SELECT k, regexp_extract(body, '{_PROLOG}', 0) AS p FROM t) SELECT k, nullif(lower(regexp_extract(p, '(?i)<!doctype\\s+([A-Za-z_][A-Za-z0-9_.\\-:]*)', 1)), '') AS doctype, contains(p, '<?xml') AS declared FROM x",
    "polyglot_markers": _markers(),
    "trailing_data": _trailing(),
    "own_markers": "WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents) SELECT k, " + ", ".join(_first_at(name, content, first) for name, (content, first) in OWN_MARKERS.items()) + " FROM d",
    "url_classes": f"WITH u AS ({derived.URLS_SQL}), v AS (SELECT k, {_plain_url('url')} AS v FROM u) SELECT k, {_url_class('v')} AS class FROM v",
    "page_link_classes": f"WITH u AS (SELECT unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS url FROM pages), v AS (SELECT {_plain_url('url')} AS v FROM u) SELECT {_url_class('v')} AS class, count(*) AS n FROM v GROUP BY 1",
    "css_verdicts": _CSS,
    "svg_attribute_rules": f"""WITH u AS ({derived.URLS_SQL}), v AS (SELECT k, {_plain_url("url")} AS v FROM u), c AS (SELECT k, {_url_class("v")} AS class, {derived.sql_case("k", ["'a'", "'use'", "'image'", "'rect'"])} AS element FROM v)
        SELECT k, CASE WHEN class = 'script' THEN 'svg.javascript_uri:40' WHEN class = 'data_other' THEN 'svg.data_uri:30' WHEN class = 'unknown_scheme' THEN 'svg.unknown_scheme:20'
            WHEN element = 'a' THEN '' WHEN class = 'data_image' AND element <> 'image' THEN 'svg.data_uri:20' WHEN class IN ('external', 'relative') THEN 'svg.external_reference:' || CASE WHEN element = 'use' THEN '30' ELSE '20' END ELSE '' END AS verdict FROM c""",
    "unsafe_member_paths": f"{_PARTS} SELECT k, {_UNSAFE} AS unsafe FROM p",
    "unsafe_link_targets": _links(),
    "nested_names": f"WITH m AS ({derived.MEMBERS_SQL}) SELECT k, regexp_matches(name, '(?i)\\.({'|'.join(paths.ARCHIVE_SUFFIXES)})$') AS nested FROM m",
    "zip_overlaps": f"WITH l AS ({derived.LISTING_SQL}), o AS (SELECT archive, lead(header_offset) OVER (PARTITION BY archive ORDER BY header_offset, idx) AS n, header_offset + 30 + name_bytes + packed AS e FROM l) SELECT DISTINCT archive FROM o WHERE n < e",
    "archive_running_budget": f"WITH l AS ({derived.LISTING_SQL}), r AS (SELECT archive, size, sum(size) OVER (PARTITION BY archive ORDER BY idx) AS t FROM l) SELECT archive, count(*) AS entries, max(t)::BIGINT AS total, bool_or(t > 100000) AS truncated FROM r WHERE t - size <= 100000 GROUP BY archive",
    "archive_first_entries": f"SELECT archive, sum(size)::BIGINT AS size FROM ({derived.LISTING_SQL}) WHERE idx < 3 GROUP BY archive",
    "archive_ratios": f"SELECT archive, CASE WHEN sum(packed) <= 0 THEN CASE WHEN sum(size) > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END ELSE sum(size)::DOUBLE / sum(packed) END AS ratio, coalesce(sum(size)::DOUBLE / nullif(sum(packed), 0), 'Infinity'::DOUBLE) > 15 AS bomb FROM ({derived.LISTING_SQL}) GROUP BY archive",
    "archive_rollup": f"SELECT archive, count(*) AS entry_count, sum(size)::BIGINT AS total_uncompressed, sum(packed)::BIGINT AS total_compressed, count(*) FILTER (packed % 2 = 1) AS encrypted FROM ({derived.LISTING_SQL}) GROUP BY archive",
    "page_verdicts": f"{_PAGES} SELECT k, len(errors) = 0 AS ok, codes, list_max(list_transform(each, lambda x: string_split(x, ':')[2]::INT)) AS highest, array_to_string(errors, ',') AS errors, (len(each) - len(errors))::INT AS warnings FROM v",
    "http_statuses": f"{_PAGES} SELECT CASE WHEN len(list_filter(errors, lambda x: starts_with(x, 'size.'))) > 0 THEN 413 WHEN len(list_filter(errors, lambda x: regexp_matches(x, '^(type|extension|content_type)\\.'))) > 0 THEN 415 ELSE 422 END AS status, count(*) AS n FROM v WHERE len(errors) > 0 GROUP BY 1",
    "findings_rollup": f"{_PAGES}, x AS (SELECT k, unnest(each) AS c FROM v) SELECT 'text/html' AS mime, string_split(c, ':')[1] AS code, string_split(c, ':')[2]::INT AS severity, count(*) AS findings, count(DISTINCT k) AS payloads FROM x GROUP BY ALL",
    "accepted_split": f"{_PAGES} SELECT 'accepted' AS side, count(*) FILTER (len(errors) = 0) AS n FROM v UNION ALL SELECT 'rejected', count(*) FILTER (len(errors) > 0) FROM v",
    "exit_codes": f"{_PAGES} SELECT (CASE WHEN max(len(errors)) > 0 THEN 1 ELSE 0 END)::INT AS exit_code FROM v",
    "stream_scan": f"{_PAGES} SELECT k, len(errors) = 0 AS ok, codes FROM v",
    "container_kinds": wrapped.KINDS_SQL,
    "archive_reports": wrapped.REPORTS_SQL,
    "archive_limits": wrapped.LIMITS_SQL,
    "located_archives": wrapped.LIMITS_SQL,
    "located_kinds": wrapped.KINDS_SQL,
    "file_stream": wrapped.FILES_SQL,
    "sql_types": wrapped.TYPES_SQL,
    "observed_counts": f"{_PAGES} SELECT count(*) AS payloads, count(*) FILTER (len(errors) > 0) AS rejected, CASE WHEN count(*) FILTER (len(errors) > 0) > 0 THEN 1 ELSE 0 END::INT AS exit_code, (SELECT string_agg(DISTINCT split_part(c, ':', 1), ',' ORDER BY split_part(c, ':', 1)) FROM (SELECT unnest(string_split(codes, ',')) AS c FROM v WHERE codes <> '')) AS codes FROM v",
    "svg_scan": wrapped.DRAWINGS_SQL,
}
