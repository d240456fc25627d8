"""URL classes and CSS verdicts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes, media types and patterns.
SCRIPT_SCHEMES = ("javascript", "vbscript", "livescript", "mocha", "jscript", "ecmascript", "data-javascript")
LINK_SCHEMES = ("http", "https", "mailto", "tel", "ftp", "ftps", "sms", "xmpp", "irc", "news", "nntp")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/gif", "image/webp", "image/bmp", "image/x-icon", "image/vnd.microsoft.icon", "image/avif", "image/heic", "image/tiff")
IGNORED = "[\\x{00}-\\x{20}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}\\x{2029}\\x{202a}-\\x{202e}\\x{feff}]"
CSS_DANGEROUS = r"(?iu)expression\s*\(|javascript\s*:|vbscript\s*:|-moz-binding|behaviou?r\s*:|-o-link|@import|data\s*:\s*text"
CSS_URL = r"""(?i)url\(\s*(['"]?)([^'")]*)\1\s*\)"""
CSS_COMMENT = r"(?s)/\*.*?\*/"


def classify_url(value: Column) -> Column:
    """empty, fragment, external, relative, script, data_image, data_other or unknown_scheme."""
    v = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), IGNORED, ""))
    scheme = F.regexp_extract(v, r"^([a-z][a-z0-9+.\-]*):", 1)
    media = F.regexp_extract(v, r"^data:([a-z0-9!#$&^_.+\-]+/[a-z0-9!#$&^_.+\-]+)", 1)
    return (
        F.when(v == "", "empty")
        .when(v.startswith("#"), "fragment")
        .when(scheme == "", F.when(v.startswith("//"), "external").otherwise("relative"))
        .when(scheme.isin(*SCRIPT_SCHEMES), "script")
        .when(scheme == "data", F.when(media.isin(*IMAGE_TYPES), "data_image").otherwise("data_other"))
        .when(scheme.isin(*LINK_SCHEMES), "external")
        .otherwise("unknown_scheme")
    )


def without_comments(css: Column) -> Column:
    return F.regexp_replace(css, CSS_COMMENT, "")


def css_scripts(css: Column) -> Column:
    """Whether a style can run script."""
    return without_comments(css).rlike(CSS_DANGEROUS)


def css_urls(css: Column) -> Column:
    return F.regexp_extract_all(without_comments(css), F.lit(CSS_URL), 2)


def css_reaches_out(css: Column, data_images: bool = True, external: bool = False) -> Column:
    """Whether a style has a url() that is neither a fragment nor allowed."""
    fine = ["fragment", *(["data_image"] if data_images else []), *(["external", "relative"] if external else [])]
    return F.exists(css_urls(css), lambda u: ~classify_url(u).isin(*fine))


def css_cleaned(css: Column) -> Column:
    """The style without comments, every url() but fragments replaced by none.

    Spark has no replacement by a function, so the text is cut at the matches and joined again.
    """
    plain = without_comments(css)
    fenced = F.split(F.regexp_replace(F.translate(plain, "\x01", ""), CSS_URL, "\x01$0\x01"), "\x01")
    kept = F.transform(fenced, lambda piece, i: F.when((i % 2 == 1) & (classify_url(F.regexp_extract(piece, CSS_URL, 2)) != "fragment"), "none").otherwise(piece))
    return F.array_join(kept, "")
