"""Paragraph splitting, numbering, request units and the cutting of long paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js, text

PARAGRAPH = "id string, ord int, text string"
#: A blank line, or two or more white-space characters after the end of a sentence.
BREAK = rf"\n[{js.WS}]*\n|(?<=[。！？.!?])[{js.WS}]{{2,}}"


def split_paragraphs(c: Column) -> Column:
    """Array of the paragraphs of a text, each on one line, none empty."""
    parts = F.split(text.normalize(c), BREAK, -1)
    return F.filter(F.transform(parts, lambda p: js.trim(F.regexp_replace(p, r"\n+", " "))), lambda p: p != "")


def paragraphs(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, para_id, ord, text) of each paragraph; ids p-1, p-2 ... in the order of the text. No shuffle."""
    return docs.select(key, F.posexplode(split_paragraphs(content)).alias("ord", "text")).select(
        key, F.concat(F.lit("p-"), (F.col("ord") + 1).cast("string")).alias("para_id"), (F.col("ord") + 1).cast("long").alias("ord"), "text"
    )


def request_units(paragraphs: DataFrame, ident: str = "id", content: str = "text") -> DataFrame:
    """The paragraphs with a normalised text that isn't empty."""
    return paragraphs.withColumns({ident: F.col(ident).cast("string"), content: text.normalize(F.col(content))}).where(F.col(content) != "")


def _sentences(c: Column) -> Column:
    """Runs without a sentence mark, each with the marks and closing quotes that follow it; the text if there is none."""
    found = F.regexp_extract_all(c, F.lit("[^.!?。！？]+(?:[.!?。！？]+[\"'’”)\\]]*|\\z)"), F.lit(0))
    return js.bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(c)))


def _hard_pieces(c: Column, limit: int) -> Column:
    """(done array, rest) of an over-long sentence: cut at the last space up to the limit, or at it if that comes
    before 65 % of it. The number of cuts is bounded by the length, so the loop is a fold over a sequence."""
    least = int(limit * 0.65)

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, limit + 1)
        at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1  # place of the last space, -1 if none
        cut = F.when(at < least, F.lit(limit)).otherwise(at)
        more = F.length(rest) > limit
        done = F.when(more, F.concat(acc["done"], F.array(js.trim(F.substring(rest, F.lit(1), cut))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(more, js.trim(F.substring(rest, cut + 1, F.length(rest)))).otherwise(rest).alias("rest"))

    zero = F.struct(F.array().cast("array<string>").alias("done"), c.alias("rest"))
    rounds = F.sequence(F.lit(0), F.floor(F.length(c) / F.lit(max(1, least))).cast("int"))
    return F.aggregate(rounds, zero, step)


def long_text(c: Column, limit: int = 2800) -> Column:
    """Array of pieces of a paragraph of at most `limit` characters: whole if it fits, else sentences packed in order.

    Marks that follow no text are dropped once a text is over the limit. Lengths are in code points.
    """

    def step(acc: Column, raw: Column) -> Column:
        s = js.trim(raw)
        cur = acc["cur"]
        full = (cur != "") & (F.length(cur) + F.length(s) + 1 > limit)
        out = F.when(full, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"])
        held = F.when(full, F.lit("")).otherwise(cur)
        hard = F.length(s) > limit

        def cut(h: Column) -> Column:
            return F.struct(F.concat(out, h["done"]).alias("out"), h["rest"].alias("cur"))

        joined = F.struct(out.alias("out"), text.join_text(held, s).alias("cur"))
        whole = F.when(hard, js.bind(_hard_pieces(s, limit), cut)).otherwise(joined)
        return F.when(s == "", acc).otherwise(whole)

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(_sentences(c), zero, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    pieces = F.filter(F.transform(packed, js.trim), lambda p: p != "")
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(pieces)


def translatable(c: Column) -> Column:
    """Whether a table cell holds language: CJK, or four Latin letters in a row."""
    return js.test(c, rf"[{js.CJK}]|[A-Za-z]{{4,}}")
