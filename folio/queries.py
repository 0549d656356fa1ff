"""Registered queries of the document engine, each over whole tables, and their DuckDB SQL.

Tables that hold no input of a rule's kind are turned into some by literal changes that both sides make alike. The SQL is
written from the rules by itself: lookbehinds become marks, folds become recursive queries.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fonts, numbers, replies, text
from .operators import blocks, dispatch, exports, layout, progress, providers, runlog, segment, wire
from .operators.spread import spread
from .plans import documents
from .sources import docx_export, files, ooxml, pdf, pdf_export, sinks
from .streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- parts of SQL -------------------------------------------------------------------------------------------------

WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"\x{3400}-\x{9FFF}"


def q_re(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"


def q_trim(x: str) -> str:
    return q_re(x, f"^{WS}+|{WS}+$", "''")


def q_normalize(x: str) -> str:
    x = q_re(f"replace(coalesce({x}, ''), chr(0), '')", r"\r\n?", "chr(10)")
    return q_trim(q_re(x, r"[ \t]+\n", "chr(10)"))


def q_named(x: str) -> str:
    for name, to in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)")):
        x = q_re(x, name, to, "gi")
    return x


def q_html(x: str) -> str:
    x = q_re(q_re(x, "<script.*?</script>", "''", "gis"), "<style.*?</style>", "''", "gis")
    return q_normalize(q_named(q_re(x, "<[^>]+>", "chr(10)")))


def q_split(x: str) -> str:
    marked = q_re(q_re(q_normalize(x), f"([。！？.!?]){WS}{{2,}}", r"'\1' || chr(1)"), rf"\n{WS}*\n", "chr(1)")
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {q_trim(q_re('p', chr(92) + 'n+', chr(39) + ' ' + chr(39)))}), lambda p: p <> '')"


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT page_id, {q_split(q_html("html"))} AS ps FROM pages)
SELECT page_id, 'p-' || i AS para_id, i AS ord, ps[i] AS text FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)
""")
def html_paragraphs(spark, sf_dir):
    """Pages to numbered paragraphs."""
    return segment.paragraphs(table(spark, sf_dir, "pages"), "page_id", text.strip_html(F.col("html")))


@query(f"SELECT page_id, {q_html('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


_CODED = "html || '&AMP;lt;&amp;nbsp;&#' || (page_id % 40000 + 33) || ';&#x27;&#65601;&#39'"


@query(f"""
WITH d AS (SELECT page_id, regexp_extract_all({q_named(_CODED)}, '&#[0-9]+;|[^&]+|&') AS parts FROM pages)
SELECT page_id, list_aggregate(list_transform(parts, lambda t: CASE WHEN regexp_full_match(t, '&#[0-9]+;')
  THEN chr((regexp_extract(t, '[0-9]+')::BIGINT % 65536)::INTEGER) ELSE t END), 'string_agg', '') AS text FROM d
""")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.decode_entities(F.expr(_CODED)).alias("text"))


_DIRTY = r"'  ' || replace(replace(text, '. ', ' ' || chr(9) || chr(13) || chr(10)), 'e ', chr(13) || chr(0)) || chr(160) || chr(13)"


@query(f"SELECT doc_id, {q_normalize(_DIRTY)} AS text FROM documents")
def normalize_text(spark, sf_dir):
    dirty = _DIRTY.replace("chr(160)", "decode(unhex('C2A0'), 'UTF-8')")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.expr(dirty)).alias("text"))


_BROKEN = "replace(replace(text, ', ', ' , ( co- operate ) '), ' of ', ' e' || lig || 'ort hy-   phen Anglo- Saxon ')"


@query(f"""
WITH d AS (SELECT doc_id, chr(64256) AS lig, text FROM documents),
a AS (SELECT doc_id, {q_re(_BROKEN, r"[\x00-\x08\x0B\x0C\x0E-\x1F\xAD]", "''")} AS t FROM d),
b AS (SELECT doc_id, {q_re("replace(t, chr(64256), 'ff')", f"([A-Za-z]{{2,}})-{WS}+([a-z]{{2,}})" + r"\b", r"'\1\2'")} AS t FROM a),
c AS (SELECT doc_id, {q_re("t", r"[ \t\x{A0}]+", "' '")} AS t FROM b)
SELECT doc_id, {q_trim(q_re(q_re("t", f"{WS}+([,.;:!?%)])", r"'\1'"), rf"(\(){WS}+", r"'\1'"))} AS text FROM c
""")
def extracted_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("lig", F.lit("ﬀ"))
    return d.select("doc_id", text.normalize_extracted(F.expr(_BROKEN)).alias("text"))


@query(f"""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || ' ' || chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, {q_split("replace(t, '. ', '.   ')")} AS ps FROM c)
SELECT conv_id, 'p-' || i AS para_id, i AS ord, ps[i] AS text FROM (SELECT conv_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)
""")
def paragraph_split(spark, sf_dir):
    """Turns of a conversation, joined by blank lines, back to paragraphs."""
    turns = table(spark, sf_dir, "conversations").withColumn("_o", F.struct("turn", "role"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_o", "text"))).alias("_t"))
    joined = F.replace(F.array_join(F.col("_t.text"), "\n \n"), F.lit(". "), F.lit(".   "))
    return segment.paragraphs(held, "conv_id", joined)


_SENTENCE = "[^.!?。！？]+(?:[.!?。！？]+[\"''’”)\\]]*|$)"


#: r (doc_id, n, piece or null): the pieces of the long texts of l (doc_id, text), in order of n.
LONG = f"""
s AS (SELECT doc_id, unnest(f) AS s, generate_subscripts(f, 1) AS k FROM
      (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{_SENTENCE}')) > 0 THEN regexp_extract_all(text, '{_SENTENCE}') ELSE [text] END AS f FROM l)),
t AS (SELECT doc_id, x AS s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM (SELECT doc_id, k, {q_trim("s")} AS x FROM s) WHERE x <> ''),
r(doc_id, k, n, cur, rest, piece) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, '', '', NULL::VARCHAR FROM l
  UNION ALL
  SELECT r.doc_id, CASE WHEN rest = '' AND NOT flush THEN r.k + 1 ELSE r.k END, r.n + 1,
         CASE WHEN rest <> '' THEN CASE WHEN length(rest) > 2800 THEN '' ELSE rest END
              WHEN flush THEN '' WHEN t.s IS NULL THEN '' WHEN length(t.s) > 2800 THEN ''
              WHEN cur = '' THEN t.s WHEN regexp_matches(cur, '[{CJK}]$') OR regexp_matches(t.s, '^[{CJK}]') THEN cur || t.s ELSE cur || ' ' || t.s END,
         CASE WHEN rest <> '' THEN CASE WHEN length(rest) > 2800 THEN {q_trim("substr(rest, cut + 1)")} ELSE '' END
              WHEN NOT flush AND length(t.s) > 2800 THEN t.s ELSE '' END,
         CASE WHEN rest <> '' THEN CASE WHEN length(rest) > 2800 THEN {q_trim("substr(rest, 1, cut)")} END WHEN flush OR t.s IS NULL THEN nullif({q_trim("cur")}, '') END
  FROM (SELECT r0.*, CASE WHEN sp < 1820 THEN 2800 ELSE sp END AS cut FROM (SELECT *, length(regexp_extract(substr(rest, 1, 2801), '(?s)^(.*) ', 1)) AS sp FROM r) r0) r
  LEFT JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1
  CROSS JOIN LATERAL (SELECT rest = '' AND cur <> '' AND t.s IS NOT NULL AND length(cur) + length(t.s) + 1 > 2800 AS flush)
  WHERE NOT (t.s IS NULL AND cur = '' AND rest = ''))"""


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, text FROM documents WHERE length(text) > 2800),{LONG}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS ord, piece AS text FROM r WHERE piece IS NOT NULL
UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= 2800
""")
def long_text_chunks(spark, sf_dir):
    """Documents as pieces of at most 2800 characters."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.long_text(F.col("text"))).alias("ord", "text"))
    return parts.select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), "text")


# --- blocks -------------------------------------------------------------------------------------------------------


def _raw_lines(spark, sf_dir):
    """One raw paragraph per line of a document; every 7th is a list item, every 11th indented."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    indent = F.when(F.col("seq") % 11 == 5, 240.0).otherwise(0.0)
    return blocks.classify(d.withColumns({"text": text.normalize_extracted(F.col("text")), "list": F.col("seq") % 7 == 3, "first_line": indent}))


_X = q_re(q_re("x", r"[\x00-\x08\x0B\x0C\x0E-\x1F\xAD]", "''"), f"([A-Za-z]{{2,}})-{WS}+([a-z]{{2,}})" + r"\b", r"'\1\2'")
EXTRACTED = q_re(q_re(q_re(_X, r"[ \t\x{A0}]+", "' '"), f"{WS}+([,.;:!?%)])", r"'\1'"), rf"(\(){WS}+", r"'\1'")
_TERMINAL = r"""[.!?。！？]["''’”》」』】)\]]*$"""
_LINES = f"""
lines AS (SELECT doc_id, i - 1 AS seq, {q_trim(EXTRACTED)} AS t FROM (SELECT doc_id, ls[i] AS x, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))),
ended AS (SELECT *, regexp_matches(t, '{_TERMINAL}') AS ended, regexp_replace(t, '[^A-Za-z]', '', 'g') AS letters FROM lines),
cls AS (
  SELECT doc_id, seq, t, ended, t <> '' AND length(t) <= 140 AND (regexp_matches(t, '^(?:[IVXLCDM]+\\.|[A-Z]\\.|[0-9]+(?:\\.[0-9]+)*\\.?){WS}+\\p{{Lu}}') OR length(letters) >= 5 AND letters = upper(letters) AND NOT ended) AS heading,
         regexp_matches(t, '(?i)^(?:fig(?:ure)?\\.?|table){WS}*[0-9]+{WS}*[:.]') AS caption,
         length(t) <= 240 AND regexp_matches(t, '[=<>≤≥≈∑∏∫√∞∈∂Θβε]') AND regexp_matches(t, '\\([0-9]{{1,3}}\\){WS}*$')
           AND (len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) <= 9 OR len(regexp_extract_all(t, '[=<>≤≥≈∑∏∫√∞∈+*/-]')) >= 2) AS equation,
         regexp_matches(t, '(?i)^arXiv:.*[0-9]{{4}}\\.[0-9]+') OR regexp_matches(t, '^[0-9]{{1,3}}$') AS furniture, seq % 7 = 3 AS bullet,
         regexp_matches(t, '(?i)^(?:and|or|but|because|which|that|where|whose|while|when|with|without|within|by|for|from|in|into|of|on|than|to|under|using|via|as|is|are|was|were|has|have|had|can|could|may|might|must|should|would|thus|therefore|however|respectively)(?:[^A-Za-z0-9_]|$)') OR regexp_matches(t, '^\\p{{Ll}}') AS goes_on
  FROM ended)"""


@query(f"WITH {_LINES} SELECT doc_id, seq, t AS text, heading, caption, equation, furniture, bullet, regexp_matches(t, '[{CJK}]|[A-Za-z]{{4,}}') AS translatable FROM cls")
def line_classify(spark, sf_dir):
    c = _raw_lines(spark, sf_dir)
    return c.select("doc_id", F.col("seq").cast("long").alias("seq"), "text", "heading", "caption", "equation", "furniture", "bullet", segment.translatable(F.col("text")).alias("translatable"))


_FOLD = f"""
WITH RECURSIVE {_LINES},
item AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM cls),
f(doc_id, k, pend, kind, n, ended, typ, otext, okind, furn, dup, mrg, form) AS (
  SELECT doc_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 0, 0, 0, 0 FROM documents
  UNION ALL
  SELECT f.doc_id, i.k, CASE b WHEN 'f' THEN NULL WHEN 'm' THEN CASE WHEN regexp_matches(pend, '[{CJK}]$') OR regexp_matches(t, '^[{CJK}]') THEN pend || t ELSE pend || ' ' || t END WHEN 'o' THEN t ELSE pend END,
         CASE b WHEN 'f' THEN NULL WHEN 'o' THEN CASE WHEN i.heading THEN 'heading' WHEN i.caption THEN 'caption' WHEN i.bullet THEN 'list-item' ELSE 'paragraph' END ELSE kind END,
         f.n + 1, CASE b WHEN 'm' THEN i.ended WHEN 'o' THEN i.ended ELSE f.ended END,
         CASE WHEN b IN ('f', 'o') THEN CASE WHEN pend IS NOT NULL THEN 'p' ELSE '' END || CASE WHEN b = 'f' AND t <> '' THEN 'f' ELSE '' END END, pend || '', CASE WHEN b = 'f' THEN t ELSE '' END || chr(1) || coalesce(kind, ''),
         (b = 'u')::INT, (b = 'd')::INT, (b = 'm')::INT, (b = 'f')::INT
  FROM f JOIN item i ON i.doc_id = f.doc_id AND i.k = f.k + 1
  CROSS JOIN LATERAL (SELECT CASE WHEN i.equation THEN 'f' WHEN i.t = '' THEN 'e' WHEN i.furniture THEN 'u' WHEN pend = i.t THEN 'd'
    WHEN pend IS NOT NULL AND NOT (kind IN ('heading', 'caption') OR i.heading OR i.caption OR i.bullet) AND length(pend) + length(i.t) <= 4200 AND i.seq % 11 <> 5 AND (i.goes_on OR NOT f.ended) THEN 'm' ELSE 'o' END AS b)),
ends AS (SELECT doc_id, max(k) AS k FROM f GROUP BY doc_id),
outs AS (
  SELECT doc_id, n * 2 AS o, 'paragraph' AS type, otext AS text, string_split(okind, chr(1))[-1] AS kind FROM f WHERE contains(typ, 'p')
  UNION ALL SELECT doc_id, n * 2 + 1, 'formula', string_split(okind, chr(1))[1], NULL FROM f WHERE contains(typ, 'f')
  UNION ALL SELECT f.doc_id, f.n * 2 + 2, 'paragraph', pend, kind FROM f JOIN ends ON f.doc_id = ends.doc_id AND f.k = ends.k WHERE pend IS NOT NULL)
"""


@query(_FOLD + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord, type, text, kind FROM outs")
def block_fold(spark, sf_dir):
    """Lines of documents merged into blocks."""
    b = blocks.blocks(blocks.fold(_raw_lines(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return b.select("doc_id", "ord", "type", F.coalesce("text", "latex").alias("text"), "kind")


@query(_FOLD + "SELECT doc_id, sum(form)::BIGINT AS formulas, sum(furn)::BIGINT AS furniture, sum(dup)::BIGINT AS duplicates, sum(mrg)::BIGINT AS merged FROM f GROUP BY doc_id")
def block_counters(spark, sf_dir):
    return blocks.fold(_raw_lines(spark, sf_dir), ["doc_id"]).select("doc_id", "formulas", "furniture", "duplicates", "merged")


# --- layout -------------------------------------------------------------------------------------------------------

_CLOSE = r"[,.;:!?%，。！？、；：％）》」』”’)\]}]"
_OPEN = r"[(\[{【《「『“‘]"


@query(f"""
WITH l AS (SELECT doc_id, i - 1 AS seq, list_filter(list_transform(string_split_regex(replace(replace(ls[i], ', ', ' , ( '), '. ', ' ) 中 '), '[ ]'), lambda t: {q_trim(q_re("t", WS + "+", "' '"))}), lambda t: t <> '') AS ts
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
SELECT doc_id, seq, coalesce({q_trim(f"list_reduce(ts, lambda a, b: a || CASE WHEN regexp_matches(b, '^{_CLOSE}') OR regexp_matches(a, '{_OPEN}$') OR regexp_matches(right(a, 1), '[{CJK}]') OR regexp_matches(b, '^[{CJK}]') THEN '' ELSE ' ' END || b)").replace("list_reduce(ts", "list_reduce(CASE WHEN len(ts) = 0 THEN [''] ELSE ts END")}, '') AS text FROM l
""")
def token_join(spark, sf_dir):
    """Words of each line joined as the tokens of a positioned line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "x"))
    x = F.replace(F.replace(F.col("x"), F.lit(", "), F.lit(" , ( ")), F.lit(". "), F.lit(" ) 中 "))
    return d.select("doc_id", F.col("seq").cast("long").alias("seq"), text.join_tokens(F.split(x, " ")).alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, '.' || chr(10), '-' || chr(10)), 'the' || chr(10), '中' || chr(10)), chr(10)), lambda t: {q_trim("t")}), lambda t: t <> '') AS ts FROM documents)
SELECT doc_id, {q_trim(f"list_reduce(CASE WHEN len(ts) = 0 THEN [''] ELSE ts END, lambda a, b: a || CASE WHEN regexp_matches(right(a, 1), '[{CJK}/-]') OR regexp_matches(b, '^[{CJK}]') THEN '' ELSE ' ' END || b)")} AS text FROM l
""")
def pdf_line_join(spark, sf_dir):
    """Lines of each document joined as those of a paragraph."""
    x = F.replace(F.replace(F.col("text"), F.lit(".\n"), F.lit("-\n")), F.lit("the\n"), F.lit("中\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.join_lines(F.split(x, "\n")).alias("text"))


_LINE = "l_orderkey, l_linenumber AS line, 800 - 14 * l_linenumber - CASE WHEN l_quantity > 40 THEN 30 ELSE 0 END * (l_linenumber % 2) AS y, 8 + l_linenumber % 5 AS font, l_returnflag || l_linenumber AS text"


@query(f"""
WITH l AS (SELECT {_LINE} FROM lineitem),
g AS (SELECT *, lag(y) OVER w - y > greatest(16, 2.1 * greatest(lag(font) OVER w, font)) AS far FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY line, text, y)),
h AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY line, text, y ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT l_orderkey, grp::BIGINT AS grp, string_agg(text, ' ' ORDER BY line, text) AS text, count(*) AS n_lines FROM h GROUP BY l_orderkey, grp
""")
def paragraph_gap_groups(spark, sf_dir):
    """Order lines placed as the lines of a page, grouped by their gaps."""
    li = table(spark, sf_dir, "lineitem").selectExpr(*_split_select(_LINE))
    w = Window.partitionBy("l_orderkey").orderBy("line", "text", "y")
    li = li.withColumn("line", F.row_number().over(w)).withColumns({"y": F.col("y").cast("double"), "font": F.col("font").cast("double")})
    return layout.paragraph_groups(li, ["l_orderkey"])


def _split_select(s: str) -> list[str]:
    return [x.strip() for x in s.split(",")] if "(" not in s else _balanced(s)


def _balanced(s: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in s:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


@query("""
WITH a(i, x) AS (VALUES (0, 5.0), (1, 16.0), (2, 27.0), (3, 44.0)),
n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, i, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount ORDER BY abs(x - l_quantity), i) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem) CROSS JOIN a)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, i AS anchor FROM n WHERE k = 1
""")
def nearest_anchor_cells(spark, sf_dir):
    """Quantities as positions, each to its column."""
    at = F.array(*(F.lit(x) for x in (5.0, 16.0, 27.0, 44.0)))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount").distinct()
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", layout.nearest(F.col("l_quantity"), at).alias("anchor"))


def _items(spark, sf_dir):
    """Each order as a page of items: a caption, a row of four numbers per line, prose below."""
    li = table(spark, sf_dir, "lineitem")
    y = 700.0 - 15 * F.col("l_linenumber")
    cell = lambda k, x, t: F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("x"), t.cast("string").alias("s"))
    cells = F.array(cell(0, 50, F.col("l_linenumber")), cell(1, 150, F.col("l_quantity")), cell(2, 252, F.col("l_extendedprice")), cell(3, 348, F.col("l_discount")))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), y.alias("y"), F.explode(cells).alias("c")).select("doc_id", "n", "y", "c.*")
    heads = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").alias("m"), F.min("l_returnflag").alias("f"))
    top = heads.select("doc_id", F.lit(0).alias("n"), F.lit(700.0).alias("y"), F.lit(0).alias("k"), F.lit(50.0).alias("x"), F.concat(F.lit("Table "), F.col("doc_id").cast("string"), F.lit(". Lines")).alias("s"))
    below = heads.select("doc_id", (F.col("m") + 1).alias("n"), (640.0 - 15 * F.col("m")).alias("y"), F.lit(0).alias("k"), F.lit(50.0).alias("x"), F.concat(F.lit("Flag "), "f").alias("s"))
    all_ = rows.unionByName(top).unionByName(below)
    zero = F.lit(0.0)
    return all_.select("doc_id", F.lit(1).alias("page"), (F.col("n") * 10 + F.col("k")).alias("seq"), F.col("s").alias("str"), F.array(F.lit(10.0), zero, zero, F.lit(10.0), F.col("x"), F.col("y")).alias("transform"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"))


@query("""
WITH li AS (SELECT l_orderkey AS d, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, l_discount AS c FROM lineitem),
cell AS (SELECT d, n, 0 AS k, n::VARCHAR AS t FROM li UNION ALL SELECT d, n, 1, q::VARCHAR FROM li UNION ALL SELECT d, n, 2, p::VARCHAR FROM li UNION ALL SELECT d, n, 3, c::VARCHAR FROM li),
cells AS (SELECT d, n, k, string_agg(t, ' ' ORDER BY t) AS t FROM cell GROUP BY ALL),
heads AS (SELECT d, max(n) AS m, count(DISTINCT n) AS rows, min(l_returnflag) AS f FROM (SELECT d, n FROM li) JOIN (SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) ON d = l_orderkey GROUP BY d),
line AS (
  SELECT d, n, 700 - 15 * n AS y, string_agg(t, chr(9) ORDER BY k) AS row_text, string_agg(t, ' ' ORDER BY k) AS text, 'row' AS kind FROM cells GROUP BY d, n
  UNION ALL SELECT d, 0, 700, NULL, 'Table ' || d || '. Lines', 'text' FROM heads UNION ALL SELECT d, m + 1, 640 - 15 * m, NULL, 'Flag ' || f, 'text' FROM heads),
kinds AS (SELECT line.*, kind = 'row' AND rows >= 3 AS in_table FROM line JOIN heads USING (d)),
cut AS (SELECT *, coalesce(lag(y) OVER w - y > 21 OR lag(in_table) OVER w, true) AS far FROM kinds WINDOW w AS (PARTITION BY d ORDER BY n)),
grp AS (SELECT *, sum(CASE WHEN far OR in_table THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM cut),
b AS (SELECT d, g, in_table, CASE WHEN in_table THEN min(row_text) ELSE string_agg(text, ' ' ORDER BY n) END AS text FROM grp GROUP BY d, g, in_table)
SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY g) AS ord, 1 AS page, CASE WHEN in_table THEN 'row' ELSE 'paragraph' END AS type, text, CASE WHEN in_table THEN 1 END::BIGINT AS "table",
       CASE WHEN in_table THEN row_number() OVER (PARTITION BY d, in_table ORDER BY g) END AS row
FROM b
""")
def table_detect(spark, sf_dir):
    """Orders laid out as pages: tables found again, and their rows."""
    return layout.document(_items(spark, sf_dir)).select("doc_id", "ord", "page", "type", "text", "table", "row")


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n, l_linenumber % 3 AS k, l_returnflag || l_linenumber || 'q' || l_quantity::INTEGER AS t FROM lineitem),
j AS (SELECT d, coalesce(string_agg(t, ' ' ORDER BY n, t) FILTER (k = 0), '') AS a, coalesce(string_agg(t, ' ' ORDER BY n, t) FILTER (k = 1), '') AS b, coalesce(string_agg(t, ' ' ORDER BY n, t) FILTER (k = 2), '') AS c FROM t GROUP BY d)
SELECT d AS doc_id, 1::BIGINT AS row, chr(9) || 'Market cap weighting' || chr(9) || 'Liquidity weighting' AS text FROM j UNION ALL SELECT d, 2, a || chr(9) || b || chr(9) || c FROM j
""")
def weighting_table(spark, sf_dir):
    """Orders as pages of the one known table whose cells are whole columns: two rows, whatever lines it has."""
    li = table(spark, sf_dir, "lineitem")
    cell = lambda k, x, t: F.struct(F.lit(k).alias("k"), x.cast("double").alias("x"), t.alias("s"))
    n = F.col("l_linenumber")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), n.alias("n"), (700.0 - 15 * n).alias("y"), (n % 3).alias("k"), (100.0 + 120 * (n % 3)).alias("x"), F.concat("l_returnflag", n.cast("string"), F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("s")).distinct()
    rows = rows.groupBy("doc_id", "n", "y", "x").agg(F.array_join(F.array_sort(F.collect_list("s")), " ").alias("s")).select("doc_id", "n", "y", F.lit(0).alias("k"), "x", "s")
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max(n).alias("m"))
    head = [cell(3, F.lit(215.0), F.lit("Market cap weighting")), cell(4, F.lit(340.0), F.lit("Liquidity weighting"))]
    top = docs.select("doc_id", F.lit(0).alias("n"), F.lit(700.0).alias("y"), F.explode(F.array(*head)).alias("c")).select("doc_id", "n", "y", "c.*")
    below = docs.select("doc_id", (F.col("m") + 1).alias("n"), (660.0 - 15 * F.col("m")).alias("y"), F.lit(0).alias("k"), F.lit(60.0).alias("x"), F.lit("Table 1: Weighting schemes").alias("s"))
    zero = F.lit(0.0)
    items = rows.unionByName(top).unionByName(below).select("doc_id", F.lit(1).alias("page"), (F.col("n") * 10 + F.col("k")).alias("seq"), F.col("s").alias("str"), F.array(F.lit(10.0), zero, zero, F.lit(10.0), F.col("x"), F.col("y")).alias("transform"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"))
    return layout.document(items).where("type = 'row'").select("doc_id", "row", "text")


# --- pages written and read ---------------------------------------------------------------------------------------

_HELVETICA = "[" + ", ".join(map(str, fonts.HELVETICA)) + "]"


def q_width(x: str, latin: str) -> str:
    """Width of a string in thousandths of the size."""
    return f"coalesce(list_sum(list_transform(string_split({x}, ''), lambda c: CASE WHEN {latin} THEN CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN ({_HELVETICA})[unicode(c) - 31] ELSE {fonts.OTHER} END WHEN unicode(c) < 256 THEN {fonts.NARROW} ELSE {fonts.WIDE} END)), 0)"


def q_wrap(parts: str) -> str:
    """CTEs of w (id, k, text, units): the lines of parts (id, t, lim), words that fit joined by spaces; n (id, n): their number."""
    return f"""
wp AS (SELECT id, lim, toks, CASE WHEN latin THEN {fonts.HELVETICA[0]} ELSE {fonts.NARROW} END AS sp, list_transform(toks, lambda x: {q_width("x", "latin")}) AS ws
       FROM (SELECT id, lim, string_split(t, ' ') AS toks, regexp_full_match(t, '[\\x20-\\x7E\\x{{A0}}-\\x{{FF}}]*') AS latin FROM {parts})),
wd AS (SELECT *, list_transform(range(0, len(ws) + 1), lambda k: coalesce(list_sum(ws[1:k]), 0) + k * sp) AS d FROM wp),
wl(id, k, a, b) AS (
  SELECT id, 0, 0, 0 FROM wd
  UNION ALL SELECT id, k + 1, wl.b + 1, (len(list_filter(d, lambda x: x <= lim + d[wl.b + 1] + sp)) - 1)::INTEGER FROM wl JOIN wd USING (id) WHERE wl.b < len(toks)),
w AS (SELECT id, k, array_to_string(toks[a:b], ' ') AS text, d[b + 1] - d[a] - sp AS units FROM wl JOIN wd USING (id) WHERE k > 0),
n AS (SELECT id, max(k) AS n FROM w GROUP BY id)"""


_PDF_PAGES = f"""
WITH RECURSIVE ps AS (SELECT page_id, {q_split(q_html("html"))} AS ps FROM pages),
para AS (SELECT page_id, i AS ord, ps[i] AS t, CASE WHEN i = 1 THEN 'heading' WHEN i % 7 = 0 THEN 'caption' ELSE 'paragraph' END AS kind FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM ps)),
part AS (
  SELECT page_id, 0 AS ord, 0 AS half, 'Page ' || page_id AS t, 18.0::DOUBLE AS size, 5.0::DOUBLE AS gap, 0.0::DOUBLE AS after, true AS mid FROM para GROUP BY page_id
  UNION ALL SELECT page_id, ord, half, CASE WHEN half = 2 THEN 'T: ' ELSE '' END || t, CASE kind WHEN 'heading' THEN 13.5 WHEN 'caption' THEN 9.5 ELSE 10.5 END, CASE kind WHEN 'heading' THEN 5 ELSE 4 END, CASE half WHEN 1 THEN 6 ELSE 11 END, kind = 'caption'
  FROM para JOIN range(1, 3) AS h(half) ON half = 1 OR ord % 4 = 0),
ids AS (SELECT *, row_number() OVER (ORDER BY page_id, ord, half) AS id, floor({pdf_export.CONTENT} * 1000 / size + 1e-9) AS lim FROM part),
{q_wrap("ids")},
el AS (SELECT page_id, ids.ord, text, units, size, gap, mid, size * {fonts.LINE} AS high, k = 1 AS first, k = n AS last, ids.ord = 0 AS title, n * (size * {fonts.LINE} + gap) + after AS whole, after + CASE WHEN ids.ord = 0 THEN {pdf_export.TITLE_DOWN * 18 * fonts.LINE} ELSE 0 END AS after,
              row_number() OVER (PARTITION BY page_id ORDER BY ids.ord, half, k) AS e FROM w JOIN n USING (id) JOIN ids USING (id)),
fl(page_id, e, page, y, yy) AS (
  SELECT DISTINCT page_id, 0::BIGINT, 1, 0.0::DOUBLE, {pdf_export.TOP}::DOUBLE FROM part
  UNION ALL
  SELECT page_id, el.e, CASE WHEN turns THEN page + 1 ELSE page END, CASE WHEN turns THEN {pdf_export.TOP} ELSE yy END, CASE WHEN turns THEN {pdf_export.TOP} ELSE yy END + high + gap + CASE WHEN last THEN after ELSE 0 END
  FROM fl JOIN el USING (page_id) CROSS JOIN LATERAL (SELECT first AND NOT title AND yy + whole + {pdf_export.KEEP} > {pdf_export.FLOOR} OR yy + high > {pdf_export.FLOOR} AS turns) WHERE el.e = fl.e + 1)
"""


def _export_rows(spark, sf_dir):
    """Paragraphs of pages with a title, headings, captions and some translations."""
    p = html_paragraphs(spark, sf_dir)
    kind = F.when(F.col("ord") == 1, "heading").when(F.col("ord") % 7 == 0, "caption").otherwise("paragraph")
    return p.select("page_id", "ord", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), kind.alias("kind"), F.col("text").alias("source"), F.when(F.col("ord") % 4 == 0, F.concat(F.lit("T: "), "text")).alias("translation"))


def _parts_of(c, by: int):
    """A measure in whole parts, which both sides round alike."""
    return F.floor(c * by + 0.5).cast("long")


@query(_PDF_PAGES + f"""
SELECT page_id, page::BIGINT AS page, el.e AS seq, text, floor(y * 1000 + 0.5)::BIGINT AS y, floor(units * size / 1000 * 10000 + 0.5)::BIGINT AS width,
       floor((CASE WHEN title OR mid THEN {pdf_export.LEFT} + ({pdf_export.CONTENT} - units * size / 1000) / 2 ELSE {pdf_export.LEFT} END) * 100000 + 0.5)::BIGINT AS x
FROM fl JOIN el USING (page_id, e)
""")
def pdf_layout(spark, sf_dir):
    """Paragraphs of pages flowed over A4 pages: each line's page and place."""
    laid = pdf_export.layout(_export_rows(spark, sf_dir), "page_id", "ord")
    return laid.select("page_id", F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), "text", _parts_of(F.col("y"), 1000).alias("y"), _parts_of(F.col("width"), 10000).alias("width"), _parts_of(F.col("x"), 100000).alias("x"))


@query(_PDF_PAGES + f"""
SELECT page_id, page::BIGINT AS page, row_number() OVER (PARTITION BY page_id, page ORDER BY el.e) - 1 AS seq, text, floor(({pdf_export.PAGE_HEIGHT} - y - {fonts.ASCENT / 1000} * size) * 1000 + 0.5)::BIGINT AS y, floor(size * 10)::BIGINT AS size
FROM fl JOIN el USING (page_id, e)
UNION ALL SELECT page_id, page, count(*), page::VARCHAR, floor(({pdf_export.FOOTER} - {fonts.ASCENT / 1000} * {pdf_export.FOOTER_SIZE}) * 1000 + 0.5)::BIGINT, 80 FROM fl WHERE e > 0 GROUP BY page_id, page
""")
def pdf_items(spark, sf_dir):
    """The same pages written as PDF files and read back: every line and page number where it was put."""
    f = pdf_export.pdf(_export_rows(spark, sf_dir), "page_id", "ord").select(F.col("page_id").cast("string").alias("path"), "content")
    at = lambda i: F.get("transform", i)
    return pdf.items(f).select(F.col("doc_id").cast("long").alias("page_id"), F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), F.col("str").alias("text"), _parts_of(at(5), 1000).alias("y"), _parts_of(at(0), 10).alias("size"))


@query(f"""
WITH RECURSIVE r AS (SELECT l_suppkey AS s, l_linenumber AS n, trim(repeat('item ' || l_partkey || ' ', floor(1 + l_quantity / 4)::INTEGER)) AS t, l_returnflag AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem),
d AS (SELECT *, (k - 1) // 50 AS tab, (k - 1) % 50 AS row FROM r),
ids AS (SELECT row_number() OVER (ORDER BY t) AS id, t, floor(({pdf_export.CONTENT} / 3 - 12) * 1000 / 8.3 + 1e-9) AS lim FROM (SELECT DISTINCT t FROM r)),
{q_wrap("ids")},
h AS (SELECT s, k, tab, row, greatest(28, n.n * (8.3 * {fonts.LINE} + 2) + 12) AS high FROM d JOIN ids USING (t) JOIN n USING (id)),
fl(s, k, page, y, yy, tab) AS (
  SELECT DISTINCT s, 0::BIGINT, 1, 0.0::DOUBLE, {pdf_export.TOP}::DOUBLE, 0::BIGINT FROM r
  UNION ALL SELECT s, h.k, CASE WHEN turns THEN page + 1 ELSE page END, CASE WHEN turns THEN {pdf_export.TOP} ELSE yb END, CASE WHEN turns THEN {pdf_export.TOP} ELSE yb END + high, h.tab
  FROM fl JOIN h USING (s) CROSS JOIN LATERAL (SELECT yy + CASE WHEN h.tab > fl.tab THEN 16 ELSE 0 END AS yb) CROSS JOIN LATERAL (SELECT yb + high + 2 > {pdf_export.FLOOR} AS turns) WHERE h.k = fl.k + 1)
SELECT s AS l_suppkey, page::BIGINT AS page, h.tab AS tab, h.row AS row, c AS col, floor(y * 10000 + 0.5)::BIGINT AS y, floor(high * 10000 + 0.5)::BIGINT AS height FROM fl JOIN h USING (s, k) JOIN range(0, 3) AS x(c) ON true
""")
def pdf_table_layout(spark, sf_dir):
    """Lines of each supplier as tables of 50 rows: the box of every cell, as high as the highest of its row."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w) - 1)
    words = F.trim(F.repeat(F.concat(F.lit("item "), F.col("l_partkey").cast("string"), F.lit(" ")), F.floor(1 + F.col("l_quantity") / 4).cast("int")))
    cells = F.array(F.col("l_linenumber").cast("string"), words, F.col("l_returnflag"))
    rows = li.select("l_suppkey", F.floor(F.col("k") / 50).alias("table"), (F.col("k") % 50 + 1).alias("row"), F.posexplode(cells).alias("col", "source"))
    rows = rows.withColumns({"title": F.lit(None).cast("string"), "kind": F.lit("table-cell"), "translation": F.lit(None).cast("string"), "columns": F.lit(3)})
    rows = rows.withColumn("ord", F.col("table") * 1000 + F.col("row") * 10 + F.col("col"))
    laid = pdf_export.layout(rows, "l_suppkey", "ord", ops=frozenset({"box"}))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("seq")) - 1
    laid = laid.withColumn("i", place).withColumn("k", F.floor(F.col("i") / 3))
    return laid.select("l_suppkey", F.col("page").cast("long").alias("page"), F.floor(F.col("k") / 50).alias("tab"), (F.col("k") % 50).cast("long").alias("row"), (F.col("i") % 3).cast("long").alias("col"), _parts_of(F.col("y"), 10000).alias("y"), _parts_of(F.col("height"), 10000).alias("height"))


@query("""
WITH li AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
i AS (
  SELECT l_orderkey, l_linenumber, 0 AS k, 50.0 AS x, 30.0 AS width FROM li UNION ALL
  SELECT l_orderkey, l_linenumber, 1, 50.0 + l_quantity, 30.0 FROM li UNION ALL
  SELECT l_orderkey, l_linenumber, 2, 130.0, l_quantity FROM li),
g AS (SELECT *, x - lag(x + width) OVER w > greatest(7, 1.1 * 10) AS far FROM i WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY x, k)),
s AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY x, k ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT l_orderkey, l_linenumber, segment::BIGINT AS segment, min(x) AS x, string_agg('t' || k, ' ' ORDER BY x, k) AS text FROM s GROUP BY ALL
""")
def line_segments(spark, sf_dir):
    """Three items per order line, split where the gap is wide."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    item = lambda k, x, w: F.struct(x.alias("x"), F.lit(k).alias("seq"), F.lit(f"t{k}").alias("text"), (x + w).alias("right"), F.lit(10.0).alias("font"))
    items = F.array(item(0, F.lit(50.0), F.lit(30.0)), item(1, 50.0 + F.col("l_quantity"), F.lit(30.0)), item(2, F.lit(130.0), F.col("l_quantity")))
    return li.select("l_orderkey", "l_linenumber", F.explode(layout.segments_of(items)).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


# --- requests and replies -----------------------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, 'u' || turn AS id, {q_normalize('text')} AS text FROM conversations WHERE {q_normalize('text')} <> ''")
def request_units(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("u"), F.col("turn").cast("string")).alias("id"), "text")
    return segment.request_units(c)


_HEAD, _MID, _TAIL = replies.INSTRUCTION.split("{}")


@query(f"""
SELECT conv_id, turn, 'be brief' || chr(10) || chr(10) || '{_HEAD}' || '{replies.SOURCE}' || '{_MID}' || role || '{_TAIL}' || to_json([{{'id': 'u' || turn, 'text': text}}])::VARCHAR AS prompt FROM conversations
""")
def prompt_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    units = F.array(F.struct(F.concat(F.lit("u"), F.col("turn").cast("string")).alias("id"), "text"))
    return c.select("conv_id", "turn", replies.prompt(F.lit("be brief"), F.lit(""), F.col("role"), units).alias("prompt"))


_REPLY = "CASE turn % 3 WHEN 0 THEN '```JSON' || chr(10) || {json} || chr(10) || '```' WHEN 1 THEN 'p-1: ' || replace(text, '. ', chr(13) || chr(10) || 'k : ') ELSE text || chr(10) || ' x：' || role || chr(10) || 'y:' END"


@query(f"""
WITH r AS (SELECT conv_id, turn, text, turn % 3 = 0 AS js, {q_trim(q_re(q_re(_REPLY.format(json="'-'"), "^```(?:json)?", "''", "i"), "```$", "''"))} AS c FROM conversations),
l AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(c, '\\r?\\n'), lambda x: {q_trim("x")}), lambda x: x <> '') AS ls FROM r WHERE NOT js),
m AS (SELECT conv_id, turn, i AS n, ls[i] AS x FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
p AS (SELECT *, regexp_matches(x, '^[^\\t:：]+[\\t:：]') AS s, {q_trim("regexp_extract(x, '(?s)^[^\\t:：]+[\\t:：](.*)$', 1)")} AS rhs FROM m)
SELECT conv_id, turn, n, CASE WHEN s THEN {q_trim("regexp_extract(x, '^([^\\t:：]+)', 1)")} ELSE '' END AS id, CASE WHEN s AND rhs <> '' THEN rhs ELSE x END AS translation FROM p
UNION ALL SELECT conv_id, turn, 1, 'u' || turn, text FROM r WHERE js UNION ALL SELECT conv_id, turn, 2, '7', '' FROM r WHERE js
""")
def parse_items(spark, sf_dir):
    """Replies made from turns: fenced JSON, lines with ids, plain lines."""
    c = table(spark, sf_dir, "conversations")
    js_text = "to_json(array(named_struct('id', concat('u', turn), 'translation', text), named_struct('id', '7', 'translation', '')))"
    raw = F.expr(_REPLY.format(json=js_text))
    parts = c.select("conv_id", "turn", F.posexplode(replies.items(raw)).alias("n", "i"))
    return parts.select("conv_id", "turn", (F.col("n") + 1).cast("long").alias("n"), "i.id", "i.translation")


# --- progress -----------------------------------------------------------------------------------------------------


def _units(spark, sf_dir):
    """Lines of documents as units; those of labelled documents of quality 1, but each third, are done."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    done = (F.col("quality") == 1) & ((F.col("n") % 3 != 2) | (F.col("toxic") == 1))
    return d.select("doc_id", F.concat(F.lit("p-"), F.col("n") + 1).alias("id"), F.when(done, F.col("text")).alias("translation"), F.when(F.col("quality").isNotNull(), "done").otherwise("waiting").alias("status"))


_UNITS = """u AS (
  SELECT d.doc_id, 'p-' || i AS id, CASE WHEN quality = 1 AND ((i - 1) % 3 <> 2 OR toxic = 1) THEN ls[i] END AS translation, CASE WHEN quality IS NOT NULL THEN 'done' ELSE 'waiting' END AS status
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT doc_id, count(*) FILTER (translation <> '' AND status = 'done') AS completed, count(*) AS total FROM u GROUP BY doc_id),
g AS (SELECT doc_id, completed, total, floor(100 * completed / total + 0.5)::BIGINT AS percent, completed = total AS complete FROM p)"""


@query(f"WITH {_UNITS} SELECT * FROM g")
def progress_by_doc(spark, sf_dir):
    return progress.document_progress(_units(spark, sf_dir))


@query(f"WITH {_UNITS} SELECT * FROM g WHERE NOT complete")
def pending_docs(spark, sf_dir):
    return progress.pending(progress.document_progress(_units(spark, sf_dir)))


@query(f"WITH {_UNITS} SELECT doc_id, id, status FROM u WHERE translation IS NULL")
def resume_units(spark, sf_dir):
    u = _units(spark, sf_dir)
    return progress.unfinished(u, u.where("translation is not null"), ["doc_id", "id"]).select("doc_id", "id", "status")


def _events(spark, sf_dir):
    """Events as requests, time compressed a hundredfold so that limits bind."""
    return table(spark, sf_dir, "events").withColumn("ms", F.expr("unix_micros(cast(ts as timestamp)) div 100000"))


@query("""
SELECT event_id, event_type, ms, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS in_window
FROM (SELECT event_id, event_type, epoch_us(ts) // 100000 AS ms FROM events)
""")
def rpm_window(spark, sf_dir):
    return progress.recent_requests(_events(spark, sf_dir).select("event_id", "event_type", "ms"), "event_type").select("event_id", "event_type", "ms", "in_window")


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) AS k FROM (SELECT event_id, event_type, epoch_us(ts) // 100000 AS ms FROM events)),
a(event_type, k, event_id, ms, start, s1, s2) AS (
  SELECT DISTINCT event_type, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, -1000000000::BIGINT, -1000000000::BIGINT FROM e
  UNION ALL
  SELECT e.event_type, e.k, e.event_id, e.ms, st, a.s2, st FROM a JOIN e ON e.event_type = a.event_type AND e.k = a.k + 1
  CROSS JOIN LATERAL (SELECT CASE WHEN a.s1 > greatest(e.ms, a.s2) - 60000 THEN a.s1 + 60030 ELSE greatest(e.ms, a.s2) END AS st))
SELECT event_type, event_id, ms, start FROM a WHERE k > 0
""")
def rpm_admission(spark, sf_dir):
    """When a limiter of two requests a minute lets each event begin."""
    return progress.admissions(_events(spark, sf_dir), "event_type", 2).select("event_type", "event_id", "ms", "start")


@query("""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ms, run_id, unit) AS k FROM (SELECT event_type AS provider, 'r' || user_id % 2 AS run_id, lpad(event_id::VARCHAR, 9, '0') AS unit, epoch_us(ts) // 100000 AS ms, 2 + user_id % 2 AS rpm FROM events)),
a(provider, k, run_id, unit, ms, start_ms, s1, s2, s3) AS (
  SELECT DISTINCT provider, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, -1000000000::BIGINT, -1000000000::BIGINT, -1000000000::BIGINT FROM e
  UNION ALL
  SELECT e.provider, e.k, e.run_id, e.unit, e.ms, st, a.s2, a.s3, st FROM a JOIN e ON e.provider = a.provider AND e.k = a.k + 1
  CROSS JOIN LATERAL (SELECT CASE WHEN e.rpm = 2 THEN a.s2 ELSE a.s1 END AS held, greatest(e.ms, a.s3) AS now) CROSS JOIN LATERAL (SELECT CASE WHEN held > now - 60000 THEN held + 60030 ELSE now END AS st))
SELECT provider, run_id, unit, ms, start_ms FROM a WHERE k > 0
""")
def shared_limit(spark, sf_dir):
    """Requests of two runs of different limits on the same providers, in four parts; the stream is started anew for each."""
    e = _events(spark, sf_dir)
    asked = e.select(F.col("event_type").alias("provider"), F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("run_id"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("unit"), F.col("ms").cast("long").alias("ms"), (2 + F.col("user_id") % 2).cast("int").alias("rpm"))
    bounds = e.agg(F.percentile_approx("ms", [0.25, 0.5, 0.75]).alias("q")).first()["q"] or [0, 0, 0]
    part = F.lit(0)
    for q in bounds:
        part = part + (F.col("ms") > q).cast("int")
    folder = files.new_folder(spark, "limits")
    for k in range(4):
        asked.where(part == k).write.mode("append").parquet(f"{folder}/asked")
        limits.serve(spark, f"{folder}/asked", f"{folder}/granted", f"{folder}/mark").awaitTermination()
    return spark.read.schema(limits.GRANT).parquet(f"{folder}/granted")


@query("""
WITH r AS (SELECT user_id % 50 AS run_id, event_id AS seq, coalesce(value > 20, false) AS ok FROM events),
c AS (SELECT *, count(*) FILTER (ok) OVER w AS completed, count(*) FILTER (NOT ok) OVER w AS failed, count(*) OVER (PARTITION BY run_id) AS units FROM r
      WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT run_id, seq, completed, failed, completed + failed AS settled, units, floor(100 * (completed + failed) / units + 0.5)::BIGINT AS percent FROM c
""")
def run_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("seq"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("ok"))
    return progress.run_progress(e).select("run_id", "seq", "completed", "failed", "settled", "units", "percent")


@query("SELECT user_id % 50 AS run_id, count(*) FILTER (coalesce(value > 20, false)) AS completed, count(*) FILTER (NOT coalesce(value > 20, false)) AS failed, count(*) AS settled FROM events GROUP BY ALL")
def run_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("ok"))
    return progress.run_totals(e)


@query("SELECT r AS retries, a AS attempt, least(8000, 1500 * 2 ** a)::BIGINT AS delay_ms FROM range(0, 6) AS x(r), range(0, 5) AS y(a) WHERE a < r")
def retry_schedule(spark, sf_dir):
    r = spark.range(0, 6).withColumnRenamed("id", "retries")
    a = r.where("retries > 0").select("retries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("retries") - 1)).alias("attempt"))
    return a.select("retries", "attempt", progress.retry_delay(F.col("attempt")).alias("delay_ms"))


# --- export -------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    side = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return c.groupBy("conv_id").agg(side("user").alias("source"), side("assistant").alias("translation"))


_PAIRS = "pairs AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS source, max(CASE WHEN role = 'assistant' THEN text END) AS translation FROM conversations GROUP BY conv_id)"


@query(f"""
WITH {_PAIRS}, n AS (SELECT conv_id, coalesce(source, '') AS s, coalesce(translation, '') AS t FROM pairs)
SELECT conv_id, 'source' AS mode, s AS text, false AS translated FROM n WHERE s <> ''
UNION ALL SELECT conv_id, 'translation', CASE WHEN t <> '' THEN t ELSE s END, t <> '' FROM n WHERE s <> '' OR t <> ''
UNION ALL SELECT conv_id, 'parallel', s, false FROM n WHERE s <> '' UNION ALL SELECT conv_id, 'parallel', t, true FROM n WHERE t <> ''
""")
def export_parts(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), exports.text_parts(F.col("source"), F.col("translation"), m).alias("parts")) for m in exports.MODES))
    return p.select("conv_id", F.explode(modes).alias("m")).select("conv_id", "m.mode", F.explode("m.parts").alias("p")).select("conv_id", "mode", "p.*")


@query("""
WITH f AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 10000),
r AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'system' THEN 'table-cell' ELSE 'paragraph' END AS type, CASE WHEN role = 'user' THEN substr(text, 1, 100000) ELSE '' END AS source, CASE WHEN role = 'assistant' THEN substr(text, 1, 100000) ELSE '' END AS translation FROM f)
SELECT conv_id, turn, type, source, translation, '' AS content FROM r WHERE source <> '' OR translation <> ''
""")
def export_rows(spark, sf_dir):
    """Each conversation as an export; the first 10 000 rows are the engine's limit on one."""
    c = table(spark, sf_dir, "conversations")
    when = lambda r: F.when(F.col("role") == r, F.col("text"))
    rows = c.select("conv_id", "turn", F.col("role").alias("_r"), F.col("text").alias("_t"), F.when(F.col("role") == "system", "table-cell").otherwise("other").alias("type"), when("user").alias("source"), when("assistant").alias("translation"), F.lit(None).cast("string").alias("content"))
    return exports.export_rows(rows, ["conv_id"], ["turn", "_r", "_t"]).drop("_r", "_t")


@query(f"""
WITH p AS (SELECT page_id, {q_split(q_html("html"))} AS ps FROM pages),
b AS (SELECT page_id, i, ps[i] AS text FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
d AS (SELECT page_id, i // 2 + 1 AS i, CASE WHEN i % 5 = 0 THEN '' ELSE text END AS source, '[' || text AS translation, row_number() OVER (PARTITION BY page_id, i // 2 + 1 ORDER BY i DESC) AS k FROM b)
SELECT b.page_id, 'p-' || b.i AS para_id, coalesce(nullif(d.source, ''), b.text) AS source, coalesce(d.translation, '') AS translation, CASE WHEN d.i IS NULL THEN 'paragraph' ELSE 'heading' END AS kind
FROM b LEFT JOIN d ON b.page_id = d.page_id AND b.i = d.i AND d.k = 1
""")
def block_paragraph_join(spark, sf_dir):
    """Blocks with the last of the paragraphs that carry their id."""
    b = html_paragraphs(spark, sf_dir)
    half = F.floor(F.col("ord") / 2) + 1
    p = b.select("page_id", F.concat(F.lit("p-"), half.cast("string")).alias("para_id"), F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("text")).alias("source"), F.concat(F.lit("["), "text").alias("translation"), F.lit("heading").alias("kind"), "ord")
    return exports.with_paragraphs(b.select("page_id", "para_id", "text"), p, ["page_id", "para_id"], "ord").drop("text")


@query(f"""
WITH {_PAIRS}, c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id)
SELECT conv_id, text FROM c
""")
def document_text(spark, sf_dir):
    """Turns of each conversation as one text, in order."""
    return exports.document_text(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
SELECT p_partkey, CASE WHEN n = '' THEN 'export' ELSE n END AS name FROM (SELECT p_partkey, substr(trim(regexp_replace('a/' || p_name || ':*?' || chr(9) || p_brand || '<' || p_type || '>', '[\\\\/:*?"<>|\\x00-\\x1F]', '_', 'g')), 1, 120) AS n FROM part)
""")
def export_names(spark, sf_dir):
    raw = F.concat(F.lit("a/"), "p_name", F.lit(":*?\t"), "p_brand", F.lit("<"), "p_type", F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", text.export_name(raw).alias("name"))


@query("""
WITH s AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size * 40.0 END AS w, p_retailprice AS h FROM part),
d AS (SELECT p_partkey, greatest(1, coalesce(nullif(w, 0), 640)) AS w, greatest(1, coalesce(nullif(h, 0), 360)) AS h FROM s),
f AS (SELECT *, least(1, 620.0::DOUBLE / w, 690.0::DOUBLE / h) AS k FROM d)
SELECT p_partkey, greatest(1, floor(w * k + 0.5))::BIGINT AS width, greatest(1, floor(h * k + 0.5))::BIGINT AS height FROM f
""")
def image_fit(spark, sf_dir):
    w = F.when(F.col("p_size") % 9 == 0, F.lit(None)).otherwise(F.col("p_size") * 40.0)
    width, height = numbers.image_size(w, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", width.cast("long").alias("width"), height.cast("long").alias("height"))


# --- settings and providers ---------------------------------------------------------------------------------------

_RAW = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN event_type ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(40)) END"


@query(f"""
WITH e AS (SELECT event_id, {_RAW.replace("VARCHAR(40)", "VARCHAR")} AS raw, event_id % 7 <> 0 AS present, event_type, value FROM events),
n AS (SELECT *, CASE WHEN NOT present THEN NULL WHEN raw IS NULL OR raw = '' THEN 0 ELSE try_cast(raw AS DOUBLE) END AS v FROM e)
SELECT event_id, CASE WHEN v IS NULL THEN 18.0 ELSE greatest(14.0, least(24.0, v)) END::DOUBLE AS size, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS kind,
       greatest(1.0, least(600.0, coalesce(nullif(value, 0), 10.0)))::DOUBLE AS rpm, greatest(1.0, least(20.0, coalesce(nullif(value, 0), 1.0)))::DOUBLE AS concurrency, greatest(0.0, least(5.0, coalesce(value, 0.0)))::DOUBLE AS retries
FROM n
""")
def clamp_settings(spark, sf_dir):
    """Event values as settings: bounded numbers, an allow-list, the limits of a run."""
    e = table(spark, sf_dir, "events").withColumns({"raw": F.expr(_RAW), "present": F.col("event_id") % 7 != 0})
    size = numbers.bounded(F.col("raw"), F.col("present"), 18, 14, 24)
    return e.select("event_id", size.alias("size"), numbers.allowed(F.col("event_type"), ["click", "view"], "view").alias("kind"), *numbers.run_limits(F.col("value"), F.col("value"), F.col("value")))


def _providers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("id"), "n_name", "n_nationkey")
    made = lambda df, tag: df.select("id", F.concat(F.lit(tag), "n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 3, F.concat(F.lit("https://"), "id")).alias("base_url"), F.col("n_nationkey").cast("string").alias("model"))
    return providers.listed(made(n.where("n_nationkey < 12"), "b-"), made(n.where("n_nationkey >= 8"), "c-"))


_PROVIDERS = """n AS (SELECT lower(n_name) AS id, n_name, n_nationkey FROM nation),
pr AS (
  SELECT id, 'b-' || n_name AS name, CASE WHEN n_nationkey % 4 <> 3 THEN 'https://' || id END AS base_url, n_nationkey::VARCHAR AS model, false AS custom FROM n WHERE n_nationkey < 12
  UNION ALL SELECT id, 'c-' || n_name, 'https://' || id, n_nationkey::VARCHAR, true FROM n WHERE n_nationkey >= 8 AND n_nationkey % 4 <> 3)"""


@query(f"WITH {_PROVIDERS} SELECT * FROM pr")
def provider_union(spark, sf_dir):
    return _providers(spark, sf_dir)


@query(f"""
WITH {_PROVIDERS},
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY custom DESC) AS k FROM pr),
r AS (SELECT c_custkey AS request_id, lower(n_name) AS provider_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT lower(n_name) AS id FROM nation WHERE n_nationkey = 2)
SELECT request_id, coalesce(b.id, d.id) AS provider_id, coalesce(b.name, f.name) AS name, CASE WHEN b.id IS NULL THEN f.base_url ELSE b.base_url END AS base_url, coalesce(b.model, f.model) AS model, coalesce(b.custom, f.custom) AS custom
FROM r CROSS JOIN d LEFT JOIN best b ON b.id = r.provider_id AND b.k = 1 LEFT JOIN best f ON f.id = d.id AND f.k = 1
""")
def provider_resolve(spark, sf_dir):
    """Customers' nations as providers asked for; nation 2 is the default."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("request_id"), F.lower("n_name").alias("provider_id"))
    default = n.where("n_nationkey = 2").select(F.lower("n_name")).first()[0]
    return providers.resolve(r, _providers(spark, sf_dir), default)


@query("SELECT conv_id, turn, 'u' || turn AS id, '[' || text AS translation, true AS ok, 1 AS attempts FROM conversations WHERE text <> ''")
def translate_units(spark, sf_dir):
    """All turns through the dispatcher with a translator that marks them."""
    c = table(spark, sf_dir, "conversations").where("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("id"), "text")
    r = dispatch.translate(c, _marked, concurrency=8)
    key = F.col("doc_id")
    return r.select(F.floor(key / 1000).cast("long").alias("conv_id"), (key % 1000).alias("turn"), "id", "translation", "ok", "attempts")


def _marked(ident: str, text: str) -> str:
    return f"[{text}"


# --- files --------------------------------------------------------------------------------------------------------


def _file(df: DataFrame, key: str, ext: str, content) -> DataFrame:
    """Rows as files (path, name, ext, length, content) that are named by their key."""
    name = F.concat(F.col(key).cast("string"), F.lit(f".{ext}"))
    f = df.select(F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), F.lit(ext).alias("ext"), content.alias("content"))
    return f.select("path", "name", "ext", F.octet_length("content").cast("long").alias("length"), "content")


def _packed(df: DataFrame, key: str, rows: str, make: Callable[[list], dict[str, str]]) -> DataFrame:
    """(key, content): a zip of the parts that make() gives for each row's array."""

    def one(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(name, data)
        return out.getvalue()

    def run(batches):
        for b in batches:
            content = pa.array([one(make(r)) for r in b.column(rows).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(key), content], [key, "content"])

    return df.select(key, rows).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


_EXTS = ["txt", "md", "CSV", "html", "htm", "exe", "tar.json"]


@query(f"""
WITH d AS (SELECT page_id, ['{"', '".join(_EXTS)}'][page_id % {len(_EXTS)} + 1] AS e, html FROM pages)
SELECT 'in/' || page_id || '.' || e AS path, lower(string_split(e, '.')[-1]) AS ext, CASE WHEN e = 'exe' OR strlen(html) > 20000 THEN NULL WHEN e IN ('html', 'htm') THEN {q_html("html")} ELSE {q_normalize("html")} END AS text,
       CASE WHEN e = 'exe' THEN 'no reader for exe' WHEN strlen(html) > 20000 THEN 'larger than the limit: ' || strlen(html) END AS error FROM d WHERE strlen(html) <= 20000 OR e <> 'exe'
UNION ALL SELECT 'in/' || page_id || '.exe', 'exe', NULL, 'larger than the limit: ' || strlen(html) FROM d WHERE e = 'exe' AND strlen(html) > 20000
""")
def file_dispatch(spark, sf_dir):
    """Pages as files of several kinds, read by extension; those over 20 000 bytes and unknown kinds say why they aren't."""
    p = table(spark, sf_dir, "pages")
    ext = F.get(F.array(*(F.lit(e) for e in _EXTS)), (F.col("page_id") % len(_EXTS)).cast("int"))
    name = F.concat(F.col("page_id").cast("string"), F.lit("."), ext)
    size = F.octet_length("html")
    f = p.select(F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), text.extension(name).alias("ext"), size.cast("long").alias("length"), F.when(size <= 20000, F.encode("html", "UTF-8")).alias("content"))
    return files.extract_text(f).select("path", "ext", "text", "error")


def _sheet(rows: list) -> dict[str, str]:
    """Flags as shared strings, line numbers and quantities as numbers, one of them as an inline string; an empty row."""
    shared = sorted({r["flag"] for r in rows})
    cells = lambda r: f'<c t="s"><v>{shared.index(r["flag"])}</v></c><c><v>{r["n"]}</v></c><c t="inlineStr"><is><t>q &amp; {r["q"]}</t></is></c>'
    body = "".join(f"<row>{cells(r)}</row><row><c><v></v></c></row>" for r in rows)
    return {
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>",
        "xl/worksheets/sheet10.xml": "<worksheet><row><c><v>last</v></c></row></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet>{body}</worksheet>",
    }


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS flag, l_quantity::INT AS q FROM lineitem)
SELECT l_orderkey, '【Sheet 1】' || chr(10) || string_agg(flag || chr(9) || n || chr(9) || 'q & ' || q, chr(10) ORDER BY n, flag, q) || chr(10) || chr(10) || '【Sheet 2】' || chr(10) || 'last' AS text FROM l GROUP BY l_orderkey
""")
def xlsx_text(spark, sf_dir):
    """Orders as workbooks, read back: shared strings, numbers, sheets in the order of their numbers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("q"))
    li = spread(li, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "flag", "q"))).alias("rows"))
    f = _file(_packed(li, "l_orderkey", "rows", _sheet), "l_orderkey", "xlsx", F.col("content"))
    return files.extract_text(f).select(F.substring_index("name", ".", 1).cast("long").alias("l_orderkey"), "text")


def _slides(rows: list) -> dict[str, str]:
    texts = [f"<a:t>{escape(r['role'])}</a:t><a:t>{escape(escape(r['text']))}</a:t>" for r in rows]
    return {f"ppt/slides/slide{i}.xml": f"<p:sld>{t}</p:sld>" for i, t in reversed(list(enumerate(texts, 1)))}


_DECODED = q_named("replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


@query(f"""
WITH c AS (SELECT conv_id, {q_trim(f"(role || ' ' || {_DECODED})")} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
SELECT conv_id, {q_normalize("string_agg(t, chr(10) || chr(10) ORDER BY k)")} AS text FROM c GROUP BY conv_id
""")
def pptx_text(spark, sf_dir):
    """Conversations as slides, a turn each (stored last to first), read back in the order of their numbers."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    f = _file(_packed(c, "conv_id", "rows", _slides), "conv_id", "pptx", F.col("content"))
    return files.extract_text(f).select(F.substring_index("name", ".", 1).cast("long").alias("conv_id"), "text")


def _docx(spark, sf_dir):
    """Documents as DOCX files, a paragraph per line, by the exporter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "source"))
    d = d.withColumns({"source": F.regexp_replace("source", text.CONTROLS, ""), "title": F.lit(""), "kind": F.lit("paragraph"), "translation": F.lit("")})
    return _file(docx_export.docx(d, "doc_id", "ord", "title", "source", first_line=0), "doc_id", "docx", F.col("content"))


_PLAIN = _FOLD.replace("seq % 7 = 3 AS bullet", "regexp_matches(t, '^(?:[•●▪◦\u2013\u2014-])') AND false AS bullet").replace("AND i.seq % 11 <> 5 ", "")


@query(_PLAIN + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord, type, text, kind, CASE WHEN type = 'formula' THEN '公式' END AS alt FROM outs")
def docx_blocks(spark, sf_dir):
    """Documents written as DOCX and rebuilt from it."""
    body, _ = documents.docx_blocks(_docx(spark, sf_dir))
    return body.select(_docx_key(), F.row_number().over(Window.partitionBy("path").orderBy("ord")).cast("long").alias("ord"), "type", F.coalesce("text", "latex").alias("text"), "kind", "alt")


def _docx_key(name: str = "doc_id"):
    return F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias(name)


@query(_PLAIN + "SELECT doc_id, sum(form)::BIGINT AS formulas, sum(furn)::BIGINT AS furniture, sum(dup)::BIGINT AS duplicates, sum(mrg)::BIGINT AS merged, 0::BIGINT AS images FROM f GROUP BY doc_id")
def docx_counters(spark, sf_dir):
    return documents.docx_counters(_docx(spark, sf_dir)).withColumn("doc_id", _docx_key()).drop("path")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, min(l_returnflag) AS f, min(l_shipdate)::DATE AS s FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS row, n, CASE WHEN n % 3 = 0 THEN ['', ''] WHEN n % 3 = 1 THEN ['line ' || n, f] ELSE ['line ' || n, '', 'on ' || s] END AS cells FROM l),
k AS (SELECT * FROM r WHERE n % 3 <> 0),
w AS (SELECT l_orderkey, max(len(cells))::INT AS columns FROM k GROUP BY ALL)
SELECT k.l_orderkey AS doc_id, 1 AS table_no, columns, row::INT AS row, row = 1 AS header, array_to_string(cells, '|') AS cells FROM k JOIN w USING (l_orderkey)
""")
def docx_tables(spark, sf_dir):
    """Orders as tables of DOCX files, read back: empty rows gone, the width of what is left, the header row."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_returnflag", "l_shipdate"), "l_orderkey").groupBy("l_orderkey", "n").agg(F.min("l_returnflag").alias("f"), F.min("l_shipdate").cast("date").alias("s"))
    line = F.concat(F.lit("line "), F.col("n").cast("string"))
    cells = F.when(F.col("n") % 3 == 0, F.lit("\t")).when(F.col("n") % 3 == 1, F.concat(line, F.lit("\t"), "f")).otherwise(F.concat(line, F.lit("\t\ton "), F.col("s").cast("string")))
    t = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", cells.alias("c")))).alias("r")).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("ord"), F.lit("").alias("title"), F.lit("table").alias("kind"), F.array_join("r.c", "\n").alias("source"), F.lit("").alias("translation"))
    _, found = documents.docx_blocks(_file(docx_export.docx(t, "doc_id", "ord", "title", "source"), "doc_id", "docx", F.col("content")))
    rows = documents.docx_tables(found).select(_docx_key(), "table_no", "columns", F.explode("rows").alias("r"))
    return rows.select("doc_id", "table_no", "columns", "r.row", "r.header", F.array_join("r.cells", "|").alias("cells"))


_PICTURES = f"""
ps AS (SELECT page_id, html, {q_split(q_html("html"))} AS ps FROM pages),
rows AS (
  SELECT page_id, i AS ord, i % 5 AS m, CASE WHEN i % 5 = 2 THEN ['png', 'gif', 'tiff', 'jpeg', 'none'][i % 9 % 5 + 1] END AS pic, CASE WHEN i % 15 >= 7 THEN 'x_' || i END AS latex, 100.0 * (i % 9) AS w, 90.0 * (i % 4) AS h, html, ps[i] AS t
  FROM (SELECT page_id, html, ps, unnest(range(1, len(ps) + 1)) AS i FROM ps))"""


def _illustrated(spark, sf_dir):
    """Pages as DOCX files with every fifth paragraph a picture; pictures of a page share their bytes in twos, one kind
    can't be stored and one is not there."""
    p = html_paragraphs(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    names = F.array(*(F.lit(x) for x in ("png", "gif", "tiff", "jpeg", "none")))
    pic = F.when(F.col("ord") % 5 == 2, F.get(names, (F.col("ord") % 9 % 5).cast("int")))
    rows = p.select("page_id", "ord", F.lit("").alias("title"), F.when(pic.isNotNull(), "image").otherwise("paragraph").alias("kind"), F.concat(F.lit("P "), "text").alias("source"), F.lit("").alias("translation"), F.concat(F.lit("a-"), pic).alias("asset_id"), F.when(F.col("ord") % 15 >= 7, F.concat(F.lit("x_"), F.col("ord").cast("string"))).alias("latex"), (100.0 * (F.col("ord") % 9)).alias("width"), (90.0 * (F.col("ord") % 4)).alias("height"), F.concat(F.lit("alt <"), F.col("ord").cast("string")).alias("alt"))
    kinds = F.array(*(F.struct(F.lit(f"a-{n}").alias("asset_id"), F.lit(f"image/{n}").alias("mime_type"), F.lit(k).alias("k")) for n, k in (("png", 0), ("gif", 1), ("tiff", 2), ("jpeg", 1))))
    held = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(kinds).alias("a")).select("page_id", "a.asset_id", "a.mime_type", F.encode(F.concat(F.substring("html", 1, 300), F.col("a.k").cast("string")), "UTF-8").alias("data"))
    return _file(docx_export.docx(rows, "page_id", "ord", "title", "source", held), "page_id", "docx", F.col("content"))


@query(f"""
WITH {_PICTURES},
v AS (SELECT *, pic IN ('png', 'gif', 'jpeg') AS stored, CASE WHEN w = 0 THEN 640 ELSE w END AS bw, CASE WHEN h = 0 THEN 360 ELSE h END AS bh FROM rows WHERE pic IS NOT NULL),
s AS (SELECT *, least(1, 620 / bw, 690 / bh) AS k FROM v)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n, CASE WHEN stored THEN sha256(substr(html, 1, 300) || CASE pic WHEN 'png' THEN 0 ELSE 1 END) END AS digest,
       CASE WHEN stored THEN floor(bw * k + 0.5)::INTEGER END AS width, CASE WHEN stored THEN floor(bh * k + 0.5)::INTEGER END AS height, CASE WHEN stored THEN 'alt <' || ord ELSE latex END AS shown
FROM s WHERE stored OR latex IS NOT NULL
""")
def docx_pictures(spark, sf_dir):
    """Pictures of written files: bytes found by their relation, sizes and descriptions; LaTeX where there is no picture."""
    found = ooxml.docx_contents(_illustrated(spark, sf_dir)).where("asset_id is not null or size(visuals) > 0 or style = 'Caption'")
    found = found.select("path", "seq", "text", "asset_id", F.sha2("data", 256).alias("digest"), F.explode_outer("visuals").alias("v"))
    own = Window.partitionBy("path", F.coalesce("asset_id", "v.asset_id"))  # a picture and the places that show it
    both = found.repartition("path").withColumn("digest", F.max("digest").over(own)).where("seq is not null").select("path", "seq", "text", "digest", "v.width", "v.height", "v.alt")
    n = F.row_number().over(Window.partitionBy("path").orderBy("seq")).cast("long")
    return both.select(_docx_key("page_id"), n.alias("n"), "digest", "width", "height", F.coalesce("alt", "text").alias("shown"))


@query(f"""
WITH {_PICTURES}
SELECT page_id, count(DISTINCT CASE WHEN pic = 'png' THEN 0 WHEN pic IN ('gif', 'jpeg') THEN 1 END) AS assets, count(*) FILTER (pic IN ('png', 'gif', 'jpeg')) AS images, count(*) FILTER (pic IS NULL) AS paragraphs FROM rows GROUP BY page_id
""")
def docx_assets(spark, sf_dir):
    """How many pictures a written file holds, equal ones once, shows, and how many paragraphs stand beside them."""
    images, paragraphs = F.expr("size(visuals) > 0"), F.expr("first_line > 0 and style = '' and justification = 'both'")
    found = ooxml.docx_contents(_illustrated(spark, sf_dir)).groupBy("path").agg(F.count("asset_id").alias("assets"), F.count_if(images).alias("images"), F.count_if(paragraphs).alias("paragraphs"))
    return found.select(_docx_key("page_id"), "assets", "images", "paragraphs")


# --- rendering and the store --------------------------------------------------------------------------------------


def _numbered_pages(spark, sf_dir):
    p = html_paragraphs(spark, sf_dir)
    kind = F.when(F.col("ord") % 4 == 0, "heading").when(F.col("ord") % 4 == 1, "list-item").otherwise("paragraph")
    return p.select("page_id", "ord", kind.alias("kind"), F.col("text").alias("source"), F.when(F.col("ord") % 3 == 0, F.concat(F.lit("["), "text")).alias("translation"))


_NUMBERED = f"""p AS (SELECT page_id, {q_split(q_html("html"))} AS ps FROM pages),
b AS (SELECT page_id, i, ps[i] AS s, CASE WHEN i % 3 = 0 THEN '[' || ps[i] END AS t, i % 4 AS m FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
parts AS (SELECT page_id, i, 0 AS k, s AS x, m FROM b UNION ALL SELECT page_id, i, 1, t, m FROM b WHERE t IS NOT NULL)"""


@query(f"WITH {_NUMBERED} SELECT page_id, string_agg(CASE m WHEN 0 THEN '## ' WHEN 1 THEN '- ' ELSE '' END || x, chr(10) || chr(10) ORDER BY i, k) AS content FROM parts GROUP BY page_id")
def export_markdown(spark, sf_dir):
    return sinks.rendered(_numbered_pages(spark, sf_dir), "page_id", "ord", "parallel", "md")


@query(f"""
WITH {_NUMBERED}, h AS (SELECT page_id, i, k, CASE m WHEN 0 THEN 'h2' WHEN 1 THEN 'li' ELSE 'p' END AS tag, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM parts)
SELECT page_id, string_agg('<' || tag || '>' || x || '</' || tag || '>', chr(10) ORDER BY i, k) AS content FROM h GROUP BY page_id
""")
def export_html(spark, sf_dir):
    return sinks.rendered(_numbered_pages(spark, sf_dir), "page_id", "ord", "parallel", "html")


@query("""
WITH r AS (SELECT user_id AS id, event_id AS v, event_id % 5 = 0 AS gone, event_type, value FROM events),
l AS (SELECT id, arg_max({'gone': gone, 'event_type': event_type, 'value': value}, v) AS x FROM r GROUP BY id)
SELECT id, x.event_type, x.value FROM l WHERE NOT x.gone
""")
def store_latest(spark, sf_dir):
    """Events as versions of their users, every fifth a deletion; what a store then holds."""
    e = table(spark, sf_dir, "events")
    return sinks.latest(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("_version"), (F.col("event_id") % 5 == 0).alias("_deleted"), "event_type", "value"))


@query("""
WITH b AS (SELECT page_id, 'asset-' || page_id % 30 AS asset_id, CASE WHEN page_id % 3 = 0 THEN 'x^2' ELSE '' END AS latex FROM pages),
a AS (SELECT 'asset-' || n_nationkey AS asset_id, n_nationkey::VARCHAR AS mime_type, n_name AS data FROM nation WHERE n_nationkey % 7 <> 6)
SELECT page_id, b.asset_id, latex, mime_type, data FROM b LEFT JOIN a ON a.asset_id = b.asset_id WHERE data IS NOT NULL OR latex <> ''
""")
def asset_join(spark, sf_dir):
    """Pages as blocks with the picture of their id; those with neither picture nor LaTeX are left out."""
    b = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("asset-"), (F.col("page_id") % 30).cast("string")).alias("asset_id"), F.when(F.col("page_id") % 3 == 0, "x^2").otherwise("").alias("latex"))
    n = table(spark, sf_dir, "nation")
    a = n.select(F.concat(F.lit("asset-"), F.col("n_nationkey").cast("string")).alias("asset_id"), F.col("n_nationkey").cast("string").alias("mime_type"), F.when(F.col("n_nationkey") % 7 != 6, F.encode("n_name", "UTF-8")).alias("data"))
    return exports.with_assets(b, a, ["asset_id"]).withColumn("data", F.decode("data", "UTF-8"))


# --- model calls --------------------------------------------------------------------------------------------------

_WIRE = f"""w AS (SELECT *, turn % 2 = 0 AS own, '{_HEAD}' || '{replies.SOURCE}' || '{_MID}' || role || '{_TAIL}' || to_json([{{'id': 'u' || turn, 'text': text}}])::VARCHAR AS prompt FROM conversations)"""


@query(f"""
WITH {_WIRE},
v AS (SELECT *, CASE WHEN conv_id % 4 = 1 THEN '' ELSE 'be brief' END AS sys, CASE WHEN conv_id % 5 = 2 THEN NULL ELSE 'm-' || conv_id END AS model, turn % 7 = 3 AS no FROM w),
b AS (
  SELECT conv_id, turn, no, own, CASE WHEN own THEN '{{"model":"' || coalesce(model, '{wire.MESSAGES_MODEL}') || '","max_tokens":8192,"system":' || to_json(coalesce(nullif(sys, ''), '{replies.SYSTEM}'))::VARCHAR
         || ',"messages":[{{"role":"user","content":' || to_json('{replies.SYSTEM}' || chr(10) || chr(10) || prompt)::VARCHAR || '}}]}}'
       ELSE '{{"model":"' || coalesce(model, '{wire.CHAT_MODEL}') || '",' || CASE conv_id % 3 WHEN 0 THEN '"reasoning_effort":"xhigh"' ELSE '"temperature":0.2' END
         || ',"messages":[{{"role":"user","content":' || to_json(coalesce(nullif(sys, ''), '{replies.SYSTEM}') || chr(10) || chr(10) || prompt)::VARCHAR || '}}]}}' END AS body FROM v)
SELECT conv_id, turn, CASE WHEN NOT no THEN 'https://model' || CASE WHEN own THEN '/messages' ELSE '/chat/completions' END END AS url, CASE WHEN NOT no THEN body END AS body,
       CASE WHEN no THEN '{wire.NO_INTERFACE}{wire.NO_INTERFACE_HINT}' END AS error FROM b
""")
def wire_requests(spark, sf_dir):
    """Turns as requests in the two wire styles, or refused in a third; some name no model or system text."""
    c = table(spark, sf_dir, "conversations")
    style = F.when(F.col("turn") % 7 == 3, "unsupported").when(F.col("turn") % 2 == 0, "anthropic").otherwise("openai")
    effort = F.when(F.col("conv_id") % 3 == 0, " XHigh ").when(F.col("conv_id") % 3 == 1, "most")
    model = F.when(F.col("conv_id") % 5 != 2, F.concat(F.lit("m-"), F.col("conv_id").cast("string")))
    system = F.when(F.col("conv_id") % 4 == 1, "").otherwise("be brief")
    units = F.array(F.struct(F.concat(F.lit("u"), F.col("turn").cast("string")).alias("id"), "text"))
    r = wire.request(style, F.lit("https://model"), model, effort, system, F.lit(""), F.col("role"), units)
    return c.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


@query("""
WITH r AS (SELECT conv_id, turn, text, conv_id % 6 AS m, turn % 2 = 0 AS own FROM conversations)
SELECT conv_id, turn, CASE WHEN own THEN '{"model":"m","max_tokens":8,"messages":[{"role":"user","content":"Reply with OK."}]}' ELSE '{"model":"m",' || CASE WHEN m = 1 THEN '"reasoning_effort":"low",' ELSE '' END || '"messages":[{"role":"user","content":"Reply with OK."}]}' END AS request,
       m IN (0, 1, 2) AS ok, CASE WHEN m IN (0, 1) THEN substr(trim(text), 1, 120) WHEN m = 2 THEN '' END AS preview,
       CASE m WHEN 3 THEN '请求失败 (429)：slow down' WHEN 4 THEN '模型返回了无法解析的响应' WHEN 5 THEN '请求成功，但模型没有返回内容' END AS error
FROM r
""")
def model_tests(spark, sf_dir):
    """Test requests, and what six kinds of replies to them say."""
    c = table(spark, sf_dir, "conversations")
    m = F.col("conv_id") % 6
    message = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("  "), "text").alias("content")).alias("message"))).alias("choices")))
    parts = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    raw = F.when(m == 0, message).when(m == 1, parts).when(m == 2, F.lit('{"choices":[{"message":{"content":""},"finish_reason":"stop"}]}')).when(m == 3, F.lit('{"error":{"message":"slow down"}}')).when(m == 4, F.lit("<html>")).otherwise(F.lit("{}"))
    style = F.when(F.col("turn") % 2 == 0, "anthropic").otherwise("openai")
    result = wire.test_result(F.when(m == 3, 429).otherwise(200), raw)
    return c.select("conv_id", "turn", wire.test_body(style, F.lit("m"), F.when(m == 1, "LOW")).alias("request"), result.alias("r")).select("conv_id", "turn", "request", "r.*")


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '[' || text WHEN 2 THEN NULL ELSE text END AS translation FROM conversations
""")
def matched_replies(spark, sf_dir):
    """Replies with the unit's id among others, with one item of another id, with several others, and with a plain line."""
    c = table(spark, sf_dir, "conversations")
    item = lambda i, t: F.struct(i.alias("id"), t.alias("translation"))
    ident, other = F.concat(F.lit("u"), F.col("turn").cast("string")), F.lit("other")
    items = F.when(F.col("turn") % 4 == 0, F.array(item(other, F.lit("x")), item(ident, F.col("text")))).when(F.col("turn") % 4 == 1, F.array(item(other, F.concat(F.lit("["), "text")))).when(F.col("turn") % 4 == 2, F.array(item(other, F.lit("x")), item(other, F.lit("y")))).otherwise(F.array(item(F.lit(""), F.col("text"))))
    return c.select("conv_id", "turn", replies.matched(items, ident).alias("translation"))


@query("""
SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN substr('plain ' || text, 1, 700) ELSE substr(text, 1, 700) END AS detail FROM conversations
""")
def error_details(spark, sf_dir):
    """What error replies of four JSON forms, and a plain one, say."""
    c = table(spark, sf_dir, "conversations")
    k, s = F.col("turn") % 5, F.struct
    t = F.col("text")
    raw = F.when(k == 0, F.to_json(s(s(t.alias("message")).alias("error")))).when(k == 1, F.to_json(s(t.alias("message")))).when(k == 2, F.to_json(s(t.alias("detail")))).when(k == 3, F.to_json(s(F.lit("").alias("message"), t.alias("detail")))).otherwise(F.concat(F.lit("plain "), t))
    return c.select("conv_id", "turn", replies.error_detail(raw).alias("detail"))


@query(f"""
WITH u AS (SELECT conv_id, turn, role, {q_normalize("CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END")} AS t FROM conversations),
f AS (SELECT conv_id, arg_min({{'id': 'u' || turn, 'text': t}}, (turn, role, t)) AS x FROM u WHERE t <> '' GROUP BY conv_id),
p AS (SELECT c.conv_id, '{_HEAD}{replies.SOURCE}{_MID}{replies.TARGET}{_TAIL}' || to_json([coalesce(x, {{'id': 'p-1', 'text': '{replies.PLACEHOLDER}'}})])::VARCHAR AS prompt,
             CASE WHEN c.conv_id % 3 = 1 THEN '{replies.SYSTEM}' ELSE 'be brief' END AS sys FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id = c.conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN sys ELSE '' END AS system_prompt, CASE WHEN conv_id % 2 = 0 THEN '{replies.SYSTEM}' ELSE sys END || chr(10) || chr(10) || prompt AS user_prompt FROM p
""")
def prompt_previews(spark, sf_dir):
    """The prompt for the first unit of each conversation that isn't blank (every third turn is made so), or for a placeholder."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("u"), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("text"))
    units = segment.request_units(c).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "id"))).alias("u"))
    held = c.select("conv_id").distinct().join(units, "conv_id", "left")
    first = F.coalesce(F.transform("u", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))), F.array().cast("array<struct<id:string,text:string>>"))
    shown = replies.preview(F.when(F.col("conv_id") % 2 == 0, "anthropic").otherwise("openai"), F.when(F.col("conv_id") % 3 == 1, "").otherwise("be brief"), F.lit(""), F.lit(""), first)
    return held.select("conv_id", shown.alias("p")).select("conv_id", "p.*")


@query("""
WITH c AS (SELECT c_custkey AS id, substr(trim('  ' || repeat(c_name || ' ', 1 + c_custkey % 3)), 1, 40) AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS model, CASE c_custkey % 4 WHEN 0 THEN 'https://x/v' || c_custkey WHEN 1 THEN 'HTTP://x' WHEN 2 THEN 'ftp://x' ELSE 'x' END AS base_url FROM customer)
SELECT id, name, model, base_url, model <> '' AND id % 4 < 2 AS valid FROM c
""")
def custom_providers(spark, sf_dir):
    """Customers as provider records: names cut, addresses without a last slash, what is missing."""
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit(" https://x/v"), k.cast("string"), F.lit("/"))).when(k % 4 == 1, "HTTP://x/").when(k % 4 == 2, "ftp://x").otherwise("x")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("  "), F.repeat(F.concat("c_name", F.lit(" ")), (1 + k % 3).cast("int"))).alias("name"), F.when(k % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("model"), url.alias("base_url"))
    return providers.normalized(c)


@query("""
WITH b AS (SELECT lower(n_name) AS id, n_nationkey AS k FROM nation WHERE n_nationkey < 15), n AS (SELECT lower(n_name) AS id, n_nationkey + 100 AS k FROM nation WHERE n_nationkey >= 10), gone AS (SELECT lower(n_name) AS id FROM nation WHERE n_nationkey % 6 = 0)
SELECT id, k FROM (SELECT * FROM n UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM n)) WHERE id NOT IN (SELECT id FROM gone)
""")
def provider_changes(spark, sf_dir):
    """Records put in the place of those of the same id, then some removed."""
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("id"), F.col("n_nationkey").alias("k"))
    new = n.where("k >= 10").withColumn("k", F.col("k") + 100)
    return providers.remove(providers.upsert(n.where("k < 15"), new), n.where("k % 6 = 0"))


# --- run events ---------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT event_type, ms, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_type, epoch_us(ts) // 100000 AS ms FROM events WHERE event_id % 2 = 0)),
m AS (SELECT event_id, event_type, epoch_us(ts) // 100000 AS ms FROM events WHERE event_id % 2 = 1),
d AS (SELECT event_type, ms, max(n) AS n FROM s GROUP BY ALL)
SELECT event_id, m.event_type, m.ms, coalesce(d.n, 0) AS listed FROM m ASOF LEFT JOIN d ON m.event_type = d.event_type AND m.ms >= d.ms
""")
def limiter_list(spark, sf_dir):
    """Even events as starts, odd ones as looks at the limiter's list."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "ms")
    return progress.listed_starts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type").select("event_id", "event_type", "ms", "listed")


@query("""
WITH r AS (SELECT user_id % 50 AS run_id, event_id AS seq, 'p-' || event_id AS id, coalesce(value > 20, false) AS ok, event_id % 3 AS again FROM events WHERE user_id % 50 < 46),
t AS (SELECT run_id, count(*) AS n FROM r GROUP BY run_id),
runs AS (SELECT a.run_id, a.k + 2 AS paragraphs, coalesce(n, 0) + CASE WHEN a.run_id % 10 = 3 THEN 5 ELSE 0 END AS units, CASE WHEN a.run_id % 10 = 3 THEN 'closed at ' || a.k END AS error
         FROM (SELECT user_id % 50 AS run_id, count(*) AS k FROM events GROUP BY ALL) a LEFT JOIN t ON t.run_id = a.run_id),
u AS (SELECT r.*, units, row_number() OVER w AS unit, count(*) FILTER (ok) OVER w AS done, count(*) FILTER (NOT ok) OVER w AS lost FROM r JOIN runs USING (run_id) WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
e AS (
  SELECT run_id, unit, 0 AS k, 'unit-start' AS event, '{"id":"' || id || '","unit":' || unit || ',"units":' || units || ',"inFlight":1}' AS payload FROM u
  UNION ALL SELECT run_id, unit, a + 1, 'unit-retry', '{"id":"' || id || '","unit":' || unit || ',"units":' || units || ',"attempt":' || a + 2 || ',"attempts":4,"delayMs":' || least(8000, 1500 * 2 ** a)::BIGINT || ',"message":"busy"}' FROM u JOIN range(0, 3) AS x(a) ON a < CASE WHEN ok THEN again ELSE 3 END
  UNION ALL SELECT run_id, unit, 100, CASE WHEN ok THEN 'paragraph' ELSE 'unit-error' END, CASE WHEN ok THEN '{"id":"' || id || '","translation":"t ' || seq || '"}' ELSE '{"id":"' || id || '","unit":' || unit || ',"units":' || units || ',"attempts":4,"message":"busy"}' END FROM u
  UNION ALL SELECT run_id, unit, 101, 'progress', '{"unit":' || done + lost || ',"sourceUnit":' || unit || ',"units":' || units || ',"completedUnits":' || done || ',"failedUnits":' || lost || ',"percent":' || floor(100 * (done + lost) / units + 0.5)::BIGINT || ',"rpmUsed":' || seq % 11 || '}' FROM u
  UNION ALL SELECT run_id, 0, 0, 'meta', '{"units":' || units || ',"maxRpm":10,"maxConcurrency":1,"model":"m","provider":"p' || run_id || '"}' FROM runs
  UNION ALL SELECT run_id, 1000000000, 0, 'error', '{"message":"' || error || '"}' FROM runs WHERE error IS NOT NULL
  UNION ALL SELECT run_id, 1000000000, 0, 'done', '{"units":' || max(units) || ',"paragraphs":' || max(paragraphs) || ',"completedUnits":' || count(*) FILTER (ok) || ',"failedUnits":' || count(*) FILTER (NOT ok) || ',"failedIds":[' || coalesce(string_agg('"' || id || '"', ',' ORDER BY seq) FILTER (NOT ok), '') || ']}'
    FROM runs LEFT JOIN r USING (run_id) WHERE error IS NULL GROUP BY run_id)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY unit, k) - 1 AS n, event, payload FROM e
""")
def run_events(spark, sf_dir):
    """All events of runs made of the event table: four have no units, five broke off before their last five."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("id"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("ok"))
    r = e.where("run_id < 46").withColumns({"attempts": F.when(F.col("ok"), F.col("seq") % 3 + 1).otherwise(F.lit(4)).cast("int"), "retries": F.lit(3), "message": F.lit("busy"), "translation": F.concat(F.lit("t "), F.col("seq").cast("string")), "rpm_used": F.col("seq") % 11})
    broken = F.col("run_id") % 10 == 3
    runs = e.groupBy("run_id").agg(F.count("*").alias("k")).withColumns({"max_rpm": F.lit(10), "max_concurrency": F.lit(1), "model": F.lit("m"), "provider": F.concat(F.lit("p"), F.col("run_id").cast("string"))})
    runs = runs.withColumns({"paragraphs": F.col("k") + 2, "units": F.when(F.col("run_id") < 46, F.col("k")).otherwise(0) + F.when(broken, 5).otherwise(0), "error": F.when(broken, F.concat(F.lit("closed at "), F.col("k").cast("string")))})
    return runlog.run_events(r, runs)
