"""Quality rules with thresholds from mergeable quantile sketches per language and source, in DataFrame functions only.

Counts per text (all of it): words, their code points, symbols, repeated lines, words in repeated 3-word windows. Two
base rules are fixed; the others are fences on four shares x / n (SHARES), each from the quantiles of the documents of
one language and source that pass the base rules:

    high = top + spread * (top - median)            top: the quantile at the share's level
    low  = quarter - spread * (median - quarter)    word length only; quarter: the lower quartile

A document is out if its x is more than SURE deviations above what `high` gives for its own n, x > high * n +
SURE * sqrt(high * n), or as many below `low`. Nothing is granted for free: all that a count is held against scales with
the group's quantiles and the text's own length. Where over half of a group has the same value (no symbol, no repeat),
median and top fall together and say nothing of what is far from them; so `high` is at least a share (`least`) of the way
from the median to the 99th percentile of the language, which the sketch of the language's tail gives. The level of a
share says which part of a group is taken to be sound: three quarters where junk passes the base rules, 0.99 where the
base rules have taken the worst already. Quantiles come from percentile_approx, whose summaries are built per task and
merged. The quantiles of a group of n documents are blended with those of its language, n : prior, so that a small group
with much junk can't raise its own fence; the prior is small for word lengths, which sources may well have of their own.
The fences join the documents on (language, source); they are broadcast only
after their rows are counted.

Defined cases: a null or blank text has zero counts and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged each and all count in the sketches; further columns are kept by filter_documents()
and ignored by judge(); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, only

SHARES = {  # count, what it is a share of, level, prior, spread, least
    "symbol_share": ("n_symbols", "word_chars", 0.75, 100, 8.0, 1 / 16),
    "word_length": ("word_chars", "n_words", 0.75, 4, 4.0, 1 / 16),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.99, 100, 1.0, 1.0),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, 100, 1.0, 1.0),
}
TAIL = 0.99
SURE = 4.0
ACCURACY = 10_000
BROADCAST_ROWS = 50_000  # about 200 bytes each

_SPACE = r"[\x20\x09-\x0D]+"
_LOW = (1 << 24) - 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """docs with the columns COUNTS; its own columns of these names would be replaced.

    Repeated windows are found without leaving the row: each window's hash, cut to 40 bits, and its position share a
    long; a sort brings equal ones together, and neighbours count only if their whole hashes are equal. Where two
    different windows share the 40 bits, or there are over 2**24 windows, structs of whole hash and position are
    sorted instead.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*own, F.array_remove(F.split(text, _SPACE), "").alias("_words"), lines.alias("_lines"), (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    size = lambda c: F.size(c).cast("long")
    d = d.select(
        *own,
        "n_symbols",
        size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, windows).alias("_h"),
    )
    kept = [*own, *(c for c in COUNTS if c != "n_repeat_words")]
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    packed = F.transform("_h", lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
    d = d.select(*kept, F.when(repeats, F.col("_h")).alias("_h"), F.when(repeats, F.sort_array(packed)).alias("_s"))
    high = lambda x: x.bitwiseAND(F.lit(~_LOW))
    whole = lambda x: F.get("_h", x.bitwiseAND(F.lit(_LOW)).cast("int"))
    near = lambda x, y: _same(high(x), high(y)) & _same(whole(x), whole(y))
    clash = (F.size("_h") > _LOW) | F.exists(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: _same(high(F.get("_s", i)), high(F.get("_s", i - 1))) & ~_same(whole(F.get("_s", i)), whole(F.get("_s", i - 1))))
    found = F.filter("_s", lambda x, i: near(x, F.get("_s", i - 1)) | near(x, F.get("_s", i + 1)))
    fast = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit(_LOW))))
    d = d.select(*kept, "_h", F.when(F.col("_s").isNull(), F.lit(None)).when(clash, F.lit(None)).otherwise(fast).alias("_at"), F.when(F.col("_s").isNotNull(), clash).alias("_clash"))
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    d = d.select(*kept, "_at", F.when(F.col("_clash"), pairs).alias("_p"))
    slow = F.transform(F.filter("_p", lambda x, i: _same(x["h"], F.get("_p", i - 1)["h"]) | _same(x["h"], F.get("_p", i + 1)["h"])), lambda x: x["i"])
    at = F.coalesce("_at", F.sort_array(slow))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return d.select(*kept, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, <share>_high of each share, word_length_low): a row for each group that has documents."""
    shares = [(F.col(x) / F.greatest(F.col(n), F.lit(1))).alias(m) for m, (x, n, *_) in SHARES.items()]
    rows = counts.where(~base_failed()).select("lang", "source", *shares)
    quantiles = [F.percentile_approx(m, [0.25, 0.5, level, TAIL], ACCURACY).alias(m) for m, (_, _, level, *_) in SHARES.items()]
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *quantiles)
    tongues = rows.groupBy("lang").agg(*quantiles)
    tongues = tongues.select(F.col("lang").alias("_lang"), *(F.col(m).alias(f"_{m}") for m in SHARES))
    both = groups.join(tongues, groups["lang"].eqNullSafe(tongues["_lang"]))
    out = []
    for m, (_, _, _, prior, spread, least) in SHARES.items():
        quarter, median, top = ((F.col("n") * F.col(m)[i] + prior * F.col(f"_{m}")[i]) / (F.col("n") + prior) for i in range(3))
        floor = median + least * (F.col(f"_{m}")[3] - F.col(f"_{m}")[1])
        out.append(F.greatest(top + spread * (top - median), floor).alias(f"{m}_high"))
        if m == "word_length":
            out.append(F.greatest(F.lit(0.0), quarter - spread * (median - quarter)).alias(f"{m}_low"))
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *out)


def outside() -> dict[str, Column]:
    """Whether the counts of a row lie beyond a fence, by the fence's name."""
    out = {}
    for m, (x, n, *_) in SHARES.items():
        high = F.col(f"{m}_high") * F.col(n)
        out[f"{m}_high"] = F.col(x) > high + SURE * F.sqrt(high)
    low = F.col("word_length_low") * F.col("n_words")
    return out | {"word_length_low": F.col("word_chars") < low - SURE * F.sqrt(low)}


def _fenced(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with the fences of their group; null where it has none."""
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    return counts.join(limits, counts["lang"].eqNullSafe(limits["_lang"]) & counts["source"].eqNullSafe(limits["_source"]), "left")


def _judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with base_failed and kept."""
    both = _fenced(counts, limits)
    inside = ~base_failed()
    for beyond in outside().values():
        inside &= ~beyond
    return both.select(*counts.columns, base_failed().alias("base_failed"), F.coalesce(inside, F.lit(False)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept) for each row."""
    counts = materialise(counted(only(docs, "doc_id", "text", "lang", "source")).drop("text"), "counts")
    return _judged(counts, materialise(fences(counts), "fences"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each text is counted once and never shuffled."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "lang", "source")
    counts = materialise(counted(rows).drop("text"), "counted", codec="zstd")
    return _judged(counts, materialise(fences(counts), "fences")).where("kept").select("_row.*")


# The quantiles of DuckDB are those of percentile_approx as long as a group has fewer rows than ACCURACY.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(0, 3) AS r(j) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS ss, word_chars / greatest(n_words, 1) AS wl,
         n_dup_lines / greatest(n_lines, 1) AS dl, n_repeat_words / greatest(n_words, 1) AS rs FROM c),
g AS (SELECT lang, source, count(*) AS n, quantile_disc(ss, [0.25, 0.5, 0.75]) AS ss, quantile_disc(wl, [0.25, 0.5, 0.75]) AS wl, quantile_disc(dl, [0.25, 0.5, 0.99]) AS dl, quantile_disc(rs, [0.25, 0.5, 0.99]) AS rs
      FROM s WHERE NOT base_failed GROUP BY ALL),
l AS (SELECT lang, quantile_disc(ss, [0.25, 0.5, 0.75, 0.99]) AS ss, quantile_disc(wl, [0.25, 0.5, 0.75, 0.99]) AS wl, quantile_disc(dl, [0.25, 0.5, 0.99, 0.99]) AS dl, quantile_disc(rs, [0.25, 0.5, 0.99, 0.99]) AS rs
      FROM s WHERE NOT base_failed GROUP BY ALL),
q AS (
  SELECT g.lang, source, list_transform(range(1, 4), lambda i: (n * g.ss[i] + 100 * l.ss[i]) / (n + 100)) AS ss, list_transform(range(1, 4), lambda i: (n * g.wl[i] + 4 * l.wl[i]) / (n + 4)) AS wl,
         list_transform(range(1, 4), lambda i: (n * g.dl[i] + 100 * l.dl[i]) / (n + 100)) AS dl, list_transform(range(1, 4), lambda i: (n * g.rs[i] + 100 * l.rs[i]) / (n + 100)) AS rs,
         l.ss[4] - l.ss[2] AS ts, l.wl[4] - l.wl[2] AS tw, l.dl[4] - l.dl[2] AS td, l.rs[4] - l.rs[2] AS tr
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang),
f AS (
  SELECT lang, source, greatest(ss[3] + 8 * (ss[3] - ss[2]), ss[2] + ts / 16) AS ss, greatest(wl[3] + 4 * (wl[3] - wl[2]), wl[2] + tw / 16) AS wl, greatest(0, wl[1] - 4 * (wl[2] - wl[1])) AS low,
         greatest(dl[3] + (dl[3] - dl[2]), dl[2] + td) AS dl, greatest(rs[3] + (rs[3] - rs[2]), rs[2] + tr) AS rs FROM q),
e AS (
  SELECT s.* EXCLUDE (ss, wl, dl, rs), f.ss * word_chars AS ss, f.wl * n_words AS wl, f.low * n_words AS low, f.dl * n_lines AS dl, f.rs * n_words AS rs
  FROM s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND n_symbols <= ss + 4 * sqrt(ss) AND word_chars <= wl + 4 * sqrt(wl) AND word_chars >= low - 4 * sqrt(low)
                AND n_dup_lines <= dl + 4 * sqrt(dl) AND n_repeat_words <= rs + 4 * sqrt(rs), false) AS kept
FROM e
"""
