"""Paragraph blocks from the raw paragraphs of a layout document.

classify() is a projection; fold() is one aggregate over the ordered paragraphs of a document or table cell, because a
merge looks at the text merged so far. Its input is gathered per document (or cell), never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js, text

VISUAL = "struct<asset_id:string,width:int,height:int,alt:string>"
#: Metadata of a raw paragraph and what stands for it where a source has none.
DEFAULTS = {"style": "''", "left": "0D", "first_line": "0D", "hanging": "0D", "spacing_before": "0D", "line_height": "0D", "exact_line": "false", "max_font_size": "0D", "justification": "''", "list": "false", "drawing": "false", "drawing_width": "0D", "drawing_height": "0D", "latex": "''", "visuals": f"cast(array() as array<{VISUAL}>)"}
BLOCK = "struct<type:string,text:string,kind:string,asset_id:string,latex:string,width:int,height:int,alt:string>"
STATE = f"struct<out:array<{BLOCK}>,text:string,kind:string,formulas:long,furniture:long,duplicates:long,merged:long>"
MERGE_LIMIT = 4200
FORMULA_ALT = "公式"  # fixed value

# Sentence ends, words that continue a sentence, running heads of pages, headings' numbers, captions,
# signs of formulas and bullets.
TERMINAL = r"""[.!?。！？]["'’”》」』】)\]]*\z"""
CONTINUATION = r"(?i)\A(?:and|or|but|because|which|that|where|whose|while|when|with|without|within|by|for|from|in|into|of|on|than|to|under|using|via|as|is|are|was|were|has|have|had|can|could|may|might|must|should|would|thus|therefore|however|respectively|i\.e\.|e\.g\.)"
FURNITURE = [
    r"(?i)\AarXiv:.*[0-9]{4}\.[0-9]+",
    rf"(?i)\A\[[a-z-]+\.[a-z]+\][{js.WS}]+[0-9]{{1,2}}[{js.WS}]+[A-Z][a-z]+[{js.WS}]+[0-9]{{4}}\z",
    rf"(?i)\AJ\.[{js.WS}]*Risk[{js.WS}]+Financial[{js.WS}]+Manag\..*https?://",
    r"\A[0-9]{1,3}\z",
]
NUMBERED = rf"\A(?:[IVXLCDM]+\.|[A-Z]\.|[0-9]+(?:\.[0-9]+)*\.?)[{js.WS}]+\p{{Lu}}"
CAPTION = rf"(?i)\A(?:fig(?:ure)?\.?|table)[{js.WS}]*[0-9]+[{js.WS}]*[:.]"
FORMULA_SIGNS = "=<>≤≥≈∑∏∫√∞∈"
BULLET = "\\A[•▪◦\uf0b7]"


def furniture(c: Column) -> Column:
    """Running heads and page numbers."""
    return js.test(c, rf"\A(?:{'|'.join(f'(?:{p})' for p in FURNITURE)})")  # the common \A keeps it to the first character


def heading(p: DataFrame | None = None) -> Column:
    t, n = F.col("text"), js.units(F.col("text"))
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    ended = js.test(t, TERMINAL)
    return (
        F.when(js.test(F.col("style"), "(?i)title|heading"), True)
        .when(n > 140, False)
        .when((F.col("max_font_size") >= 26) & (n < 120), True)
        .when(js.test(t, NUMBERED), True)
        .when((F.length(letters) >= 5) & (letters == F.upper(letters)) & ~ended, True)
        .otherwise((F.col("justification") == "center") & (n < 95) & ~ended)
    )


def caption(c: Column) -> Column:
    return js.test(c, CAPTION)


def equation() -> Column:
    t = F.col("text")
    picture = F.col("drawing") & (F.col("drawing_width") > 0) & (F.col("drawing_height") > 0) & (F.col("drawing_width") >= 2.4 * F.col("drawing_height")) & (F.col("drawing_height") <= 1300000)
    operator = js.test(t, f"[{FORMULA_SIGNS}∂Θβε]")
    fixed = F.col("exact_line") & (F.col("line_height") >= 600) & js.test(t, "[=<>_{}≤≥∑∫√∞∈Θβε]")
    placed = js.test(t, rf"\([0-9]{{1,3}}\)[{js.WS}]*\z") | F.col("justification").isin("center", "right")
    sparse = (F.regexp_count(t, F.lit("[A-Za-z]{3,}")) <= 9) | (F.regexp_count(t, F.lit(rf"[{FORMULA_SIGNS}+\-*/]")) >= 2)
    return F.when(t == "", picture).when(js.units(t) > 240, False).otherwise(picture | fixed | operator & placed & sparse)


def classify(raw: DataFrame) -> DataFrame:
    """raw (text and any of DEFAULTS) with all of those and heading, caption, equation, bullet, furniture."""
    full = raw.withColumns({n: F.coalesce(F.col(n), F.expr(v)) if n in raw.columns else F.expr(v) for n, v in DEFAULTS.items()} | {"text": js.text(F.col("text"))})
    some = F.col("text") != ""
    return full.withColumns(
        {
            "heading": some & heading(),
            "caption": some & caption(F.col("text")),
            "equation": (F.col("latex") != "") | equation(),
            "bullet": F.col("list") | js.test(F.col("text"), BULLET),
            "furniture": furniture(F.col("text")),
        }
    )


def _mergeable(before: Column, kind: Column, it: Column) -> Column:
    """Whether a paragraph goes on what is pending (its text so far, and the kind of its first paragraph)."""
    ended = js.test(before, TERMINAL)
    goes_on = js.test(it["text"], CONTINUATION + r"(?![A-Za-z0-9_])|" + CONTINUATION + r"(?<=\.)(?=[A-Za-z0-9_])") | js.test(it["text"], r"\A\p{Ll}")
    indented = (it["hanging"] == 0) & ((it["first_line"] >= 120) | (it["spacing_before"] >= 220))
    return (
        F.when(kind.isin("heading", "caption") | it["heading"] | it["caption"] | it["bullet"], False)
        .when(js.units(before) + js.units(it["text"]) > MERGE_LIMIT, False)
        .when(indented, False)
        .when(goes_on, True)
        .otherwise(~ended)
    )


def _block(block_type: str, **fields: Column) -> Column:
    names = {"text": "string", "kind": "string", "asset_id": "string", "latex": "string", "width": "int", "height": "int", "alt": "string"}
    return F.struct(F.lit(block_type).alias("type"), *(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()))


def _step(acc: Column, it: Column) -> Column:
    """One paragraph: what comes out, what is pending, what is counted.

    Branches, in order: visuals or LaTeX; a formula; nothing; page furniture; a repeat of what is pending; a
    continuation of it; a paragraph of its own. Only the first two and the last end what is pending.
    """
    some, pending = it["text"] != "", acc["text"].isNotNull()
    shown = (F.size(it["visuals"]) > 0) | (it["latex"] != "")
    branch = (
        F.when(shown, F.lit("shown"))
        .when(it["equation"], F.lit("formula"))
        .when(~some, F.lit("empty"))
        .when(it["furniture"], F.lit("furniture"))
        .when(pending & (acc["text"] == it["text"]), F.lit("repeat"))
        .when(pending & _mergeable(acc["text"], acc["kind"], it), F.lit("merge"))
        .otherwise(F.lit("own"))
    )

    def result(b: Column) -> Column:
        none = F.array().cast(f"array<{BLOCK}>")
        flushed = F.when(pending, F.array(_block("paragraph", text=acc["text"], kind=acc["kind"]))).otherwise(none)
        beside = F.when(some & ~it["equation"] & ~it["furniture"], F.array(_block("paragraph", text=it["text"], kind=F.when(it["caption"], F.lit("caption")).otherwise(F.lit("paragraph"))))).otherwise(none)
        kind = F.when(it["equation"], F.lit("formula")).otherwise(F.lit("image"))
        pictures = F.transform(it["visuals"], lambda v: F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("kind"), v["asset_id"].alias("asset_id"), it["latex"].alias("latex"), v["width"].alias("width"), v["height"].alias("height"), v["alt"].alias("alt")))
        formula = lambda tex: F.array(_block("formula", asset_id=F.lit(""), latex=tex, width=F.lit(640), height=F.lit(96), alt=F.lit(FORMULA_ALT)))
        bare = F.when((F.size(it["visuals"]) == 0) & (it["latex"] != ""), formula(it["latex"])).otherwise(none)
        typed = F.when(some, formula(it["text"])).otherwise(none)
        out = F.when(b == "shown", F.concat(acc["out"], flushed, beside, pictures, bare)).when(b == "formula", F.concat(acc["out"], flushed, typed)).when(b == "own", F.concat(acc["out"], flushed)).otherwise(acc["out"])
        own_kind = F.when(it["heading"], F.lit("heading")).when(it["caption"], F.lit("caption")).when(it["bullet"], F.lit("list-item")).otherwise(F.lit("paragraph"))
        ends = b.isin("shown", "formula")
        held = F.when(ends, F.lit(None)).when(b == "merge", text.join_text(acc["text"], it["text"])).when(b == "own", it["text"]).otherwise(acc["text"])
        one = lambda name, when: (acc[name] + F.when(when, 1).otherwise(0)).alias(name)
        return F.struct(
            out.alias("out"),
            held.cast("string").alias("text"),
            F.when(ends, F.lit(None)).when(b == "own", own_kind).otherwise(acc["kind"]).cast("string").alias("kind"),
            one("formulas", ends & it["equation"]),
            one("furniture", b == "furniture"),
            one("duplicates", b == "repeat"),
            one("merged", b == "merge"),
        ).cast(STATE)

    return js.bind(branch, result)


def fold(raw: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, blocks, formulas, furniture, duplicates, merged) of classified paragraphs (keys, order, text ...)."""
    fields = ["text", "first_line", "hanging", "spacing_before", "latex", "visuals", "heading", "caption", "equation", "bullet", "furniture"]
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))), lambda x: x)
    rows = raw.groupBy(*keys).agg(items.alias("_items"))
    zero = F.expr(f"cast(named_struct('out', array(), 'text', null, 'kind', null, 'formulas', 0, 'furniture', 0, 'duplicates', 0, 'merged', 0) as {STATE})")
    last = lambda a: F.struct(F.when(a["text"].isNotNull(), F.concat(a["out"], F.array(_block("paragraph", text=a["text"], kind=a["kind"])))).otherwise(a["out"]).alias("blocks"), *(a[n].alias(n) for n in ("formulas", "furniture", "duplicates", "merged")))
    return rows.select(*keys, F.aggregate("_items", zero, _step, last).alias("_f")).select(*keys, "_f.*")


def blocks(folded: DataFrame, keys: list[str]) -> DataFrame:
    """A row (keys, ord, type, text, kind ...) per block of fold()'s rows."""
    return folded.select(*keys, F.posexplode("blocks").alias("ord", "_b")).select(*keys, (F.col("ord") + 1).cast("long").alias("ord"), "_b.*")


def body_paragraphs(blocks: DataFrame, key: str, limit: int = 2800) -> DataFrame:
    """(key, para_id, ord, text, kind): the paragraph blocks cut to the limit and numbered per document."""
    from .segment import long_text

    parts = blocks.where("type = 'paragraph'").select(key, F.col("ord").alias("_b"), "kind", F.posexplode(long_text(F.col("text"), limit)).alias("_p", "text"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", "_p", "text", "kind"))).alias("_all"))
    return rows.select(key, F.posexplode("_all").alias("ord", "_x")).select(key, F.concat(F.lit("p-"), (F.col("ord") + 1).cast("string")).alias("para_id"), (F.col("ord") + 1).cast("long").alias("ord"), "_x.text", "_x.kind")
