"""References in HTML and CSS text. Repeated groups are possessive, so long tags cannot recurse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A reference with a scheme is not a file.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# The attribute that refers to a file, by tag.
ASSET_ATTRIBUTES = {"script": "src", "link": "href", "img": "src"}

COMMENT = r"<!--(?:[^-]|-(?!->))*+(?:-->|\z)"
OPENED = r"""<(?!!--)(?:[^>"']|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
BODY = r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?is)([a-z0-9:_-]++)(?:\s*+=\s*+("[^"]*+"?+|'[^']*+'?+|[^\s>]*+))?+"""
CSS_STRING = r""""(?:\\.|[^"\\])*+"?+|'(?:\\.|[^'\\])*+'?+"""
CSS_COMMENT = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
CSS_IMPORT = r"""@import\s++(?:"[^"]++"|'[^']++')"""
CSS_URL = r"""url\(\s*+(?:"[^"]*+"|'[^']*+'|[^)"'\s]++)\s*+\)"""


def relative_ref(value: Column) -> Column:
    """Whether a reference points to a file next to its document."""
    text = F.trim(value)
    return (text != "") & ~text.rlike(r"^[/#]") & ~text.rlike(SCHEME)


def raw_element(name: str) -> str:
    """An element whose text up to its end tag is not markup."""
    return rf"<{name}\b{BODY}(?:[^<]|<(?!/{name}\s*+>))*+(?:</{name}\s*+>)?+"


def html_tags(text: Column, names: list[str]) -> Column:
    """The named start tags, outside comments and outside raw script or style text.

    First the comments go: any sign that opens a tag, also one in plain text, runs to its end, and
    no comment begins inside. Then one scan consumes raw elements with their text and the named
    tags whole, so nothing inside them is taken for a tag.
    """
    text = F.regexp_replace(text, f"(?s)({OPENED})|{COMMENT}", "$1 ")
    named = rf"<(?:{'|'.join(names)})\b"
    scan = rf"(?is)({raw_element('script')}|{raw_element('style')}|{named}{BODY})"
    wanted = rf"(?is)^{named}"
    found = F.filter(F.regexp_extract_all(text, F.lit(scan), F.lit(1)), lambda p: p.rlike(wanted))
    return F.transform(found, lambda piece: F.regexp_extract(piece, f"(?is)^(<{BODY})", 1))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([A-Za-z0-9:_-]+)", 1))


def attribute(tag: Column, name: Column) -> Column:
    """Value of the first attribute of that name which has one, '' when there is none."""
    inner = F.regexp_replace(tag, r"^<[A-Za-z0-9:_-]+", "")
    names = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v")))
    hits = F.filter(pairs, lambda p: (p["n"] == name) & (p["v"] != ""))
    value = F.coalesce(F.try_element_at(hits, F.lit(1))["v"], F.lit(""))
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def html_refs(text: Column, attributes: dict[str, str] | None = None) -> Column:
    """Relative references of the mapped tags, in document order."""
    attributes = attributes or ASSET_ATTRIBUTES
    mapping = F.create_map(*[F.lit(x) for pair in attributes.items() for x in pair])
    tags = html_tags(text, list(attributes))
    values = F.transform(tags, lambda tag: attribute(tag, mapping[tag_name(tag)]))
    return F.filter(values, relative_ref)


def css_refs(text: Column) -> Column:
    """Relative targets of ``@import`` and ``url()``, outside comments and strings."""
    clean = F.regexp_replace(text, f"(?is)({CSS_STRING})|{CSS_COMMENT}", "$1 ")
    scan = f"(?is)({CSS_IMPORT}|{CSS_URL}|{CSS_STRING})"
    pieces = F.filter(
        F.regexp_extract_all(clean, F.lit(scan), F.lit(1)), lambda p: p.rlike(r"(?i)^(?:@import|url\()")
    )
    values = F.transform(
        pieces,
        lambda p: F.concat(
            F.regexp_extract(p, r"""^[^"']*"([^"]*)""", 1),
            F.regexp_extract(p, r"""^[^"']*'([^']*)""", 1),
            F.regexp_extract(p, r"""(?i)^url\(\s*([^)"'\s]+)""", 1),
        ),
    )
    return F.filter(values, relative_ref)
