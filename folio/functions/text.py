"""Text normalisation, entities, HTML, ligatures and the joining of tokens and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js

# Ligatures and their letters, characters dropped from extracted text, and named entities in the order
# in which they are decoded.
LIGATURES = {"\uFB00": "ff", "\uFB01": "fi", "\uFB02": "fl", "\uFB03": "ffi", "\uFB04": "ffl"}
ITEM_LIGATURES = {**LIGATURES, "\uFB05": "ft", "\uFB06": "st"}
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
# Characters that take no space before them, or after them.
CLOSING = ",.;:!?%，。！？、；：％）》」』”’"
CLOSING_BRACKETS = ")]}"
OPENING = "([{【《「『“‘"


def _replace_all(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def _plain(c: Column, marks: str = "") -> Column:
    """Whether a text has letters, digits, marks and single spaces within alone, and none of marks (|-alternatives).

    Most texts are such. No rule on white space, controls or ligatures changes them, and one pass over a few ranges of
    characters costs far less than a pass per rule over the many kinds of white space. What can be asked without a
    pattern is: an alternative more makes a pattern slower at each character.
    """
    known = js.test(c, r"\A[\x20-\x7E\xA1-\xAC\xAE-\u02FF\u4E00-\u9FFF]*+\z")
    plain = known & ~(c.contains("  ") | c.startswith(" ") | c.endswith(" "))
    return plain & ~js.test(c, marks.removeprefix("|")) if marks else plain


def normalize(c: Column) -> Column:
    """No NUL, LF line ends, no blanks before them, trimmed. Null as empty."""
    c = F.regexp_replace(js.text(c), r"\x00", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return js.trim(F.regexp_replace(c, r"[ \t]+\n", "\n"))


def _character(code: Column) -> Column:
    """The UTF-16 unit of a number modulo 65536; U+FFFD for surrogates."""
    n = F.pmod(F.coalesce(code.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.lit(65536)).cast("int")
    return js.bind(n, lambda v: F.when(v.between(0xD800, 0xDFFF), F.lit("\uFFFD")).otherwise(F.decode(F.unhex(F.lpad(F.hex(v), 4, "0")), "UTF-16BE")))


def decode_entities(c: Column) -> Column:
    """Named entities one after another (so what &amp; yields is decoded again by later ones), then decimal ones."""
    for name, char in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i){name}", char)
    parts = F.regexp_extract_all(c, F.lit(r"&#[0-9]+;|[^&]+|&"), F.lit(0))
    whole = F.transform(parts, lambda t: F.when(t.rlike(r"\A&#[0-9]+;\z"), _character(F.regexp_extract(t, "[0-9]+", 0))).otherwise(t))
    return F.when(c.contains("&#"), F.array_join(whole, "")).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text of a page: scripts and styles dropped, each other tag a line end, entities decoded, normalised."""
    c = F.regexp_replace(js.text(c), r"(?is)<script.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", "")
    return normalize(decode_entities(F.regexp_replace(c, r"<[^>]+>", "\n")))


def normalize_extracted(c: Column) -> Column:
    """Text of a layout document: controls and soft hyphens dropped, ligatures, broken words and spacing mended."""
    own = js.text(c)
    c = _replace_all(F.regexp_replace(own, CONTROLS, ""), {**LIGATURES, "\u00AD": ""})
    c = F.regexp_replace(c, rf"([A-Za-z]{{2,}})-[{js.WS}]+([a-z]{{2,}})(?![A-Za-z0-9_])", "$1$2")
    c = F.regexp_replace(c, r"[ \t\xA0]+", " ")
    mended = js.trim(F.regexp_replace(c, rf"[{js.WS}]+([,.;:!?%)])|(\()[{js.WS}]+", "$1$2"))
    spaced = reduce(lambda a, b: a | b, (own.contains(m) for m in ("- ", "( ", *(f" {m}" for m in ",.;:!?%)"))))
    return F.when(_plain(own) & ~spaced, own).otherwise(mended)


def squeeze(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    c = js.text(c)
    return F.when(_plain(c), c).otherwise(js.trim(F.regexp_replace(c, f"[{js.WS}]+", " ")))


def normalize_item(c: Column) -> Column:
    """Text of a positioned item, or null if nothing is left."""
    c = js.text(c)
    return js.truthy(F.when(_plain(c), c).otherwise(squeeze(_replace_all(F.regexp_replace(c, CONTROLS, ""), ITEM_LIGATURES))))


def _seamed(parts: Column, tight) -> Column:
    """Parts joined by a space, but for neighbours that are tight."""

    def joined(p: Column) -> Column:
        return F.array_join(F.transform(p, lambda t, i: F.when((i == 0) | tight(F.get(p, i - 1), t), t).otherwise(F.concat(F.lit(" "), t))), "")

    return js.trim(js.bind(F.filter(parts, lambda t: t != ""), joined))


def _one_of(c: Column, marks: str) -> Column:
    """Whether a character is one of some marks or CJK: as a pattern's class, without a pattern's cost."""
    return F.lit(marks).contains(c) | c.between("\u3400", "\u9FFF")


def join_tokens(tokens: Column) -> Column:
    """Tokens of a line as text: no space before closing or after opening marks, nor beside CJK."""
    return join_squeezed(F.transform(tokens, squeeze))


def join_squeezed(tokens: Column) -> Column:
    """join_tokens() of tokens as squeeze() leaves them."""
    return _seamed(tokens, lambda a, b: _one_of(F.substring(b, 1, 1), CLOSING + CLOSING_BRACKETS) | _one_of(F.substring(a, -1, 1), OPENING))


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as text: no space beside CJK nor after a hyphen or slash, which stay."""
    return _seamed(F.transform(lines, lambda x: js.trim(js.text(x))), lambda a, b: _one_of(F.substring(a, -1, 1), "-/") | _one_of(F.substring(b, 1, 1), ""))


def join_text(left: Column, right: Column) -> Column:
    """Two pieces of a paragraph."""
    tight = (left == "") | (right == "") | left.rlike(rf"[{js.CJK}]\z") | right.rlike(rf"\A[{js.CJK}]")
    return F.when(tight, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def export_name(c: Column, default: str = "export") -> Column:
    """A name for a file: no separators or controls, 120 characters."""
    name = F.substring(js.trim(F.regexp_replace(F.coalesce(js.truthy(c), F.lit(default)), r'[\\/:*?"<>|\x00-\x1F]', "_")), 1, 120)
    return F.coalesce(js.truthy(name), F.lit(default))


def extension(c: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name if it has none."""
    return F.lower(F.substring_index(js.text(c), ".", -1))


def cut(c: Column, limit: int) -> Column:
    """The first `limit` characters of a trimmed text: 40 for a provider's name, 160 for a model's, 120 for a preview."""
    return F.substring(js.trim(js.text(c)), 1, limit)
