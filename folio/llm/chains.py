"""Passages that repeat across documents, found by collinear chaining.

0. Rows: each different row (doc_id, text) has a number, in the order of doc_id; a number and the position of a word
   share a long, so that all joins and aggregates below are on longs. Where doc_id is a whole number that never
   repeats, it is the number; else numbers come from a range sort.
1. Seeds: of the 4-word grams of each text, those that are least in some window of 6 (minimizers). Texts that share a
   run of 9 words share a seed of it, and one seed is enough for a pair to be compared. The same pass writes 32-bit
   hashes of the words, which are what later steps compare; texts are not moved.
2. Matches: each occurrence of a seed is joined with the seed's first occurrence (least row, then position), never
   with all others, so a passage that a third of the corpus holds costs a row per copy. The first occurrence comes
   from an aggregate that combines before the shuffle; Spark can split the join's hot seeds. The n-th occurrence of a
   seed in a text is also joined with the first n-th one of another, which lines up texts that repeat themselves.
   Where the seeds of a stretch do not lead to one place (stock phrases that stood singly in several documents), each
   PHRASES seeds in a row are joined with their first occurrence in the same way.
3. Chains: per pair of rows, matches in order in both are chained, score 16 words per match less GAP per word
   skipped, with prefix maxima in a Fenwick tree (n log n).
4. Leaders: per row, the chains that no union of chains with more seeds covers. The others are looked at only where the
   passages of the leaders don't cover them: for a stretch of a row one earlier holder is enough.
5. Sieve: a passage has `min_words` words in a row of which a share of s / (2 - s) occurs in the other text nearby (s is
   the similarity). Short chains around which no stretch of words has that, by halves of the hashes, are dropped.
6. Alignment: the words that a chain spans in both rows are fetched by joins and compared: runs of equal words, gaps
   aligned by edit distance, ends extended. The longest segment of runs of over `min_words` - 1 words with at least 0.8
   of the words equal is a passage, and so again on either side of it. Where equal words come so near the edge of a
   slice that more could follow, longer slices are fetched.

Defined cases: null and blank texts have no passage; words compare with A-Z lower-cased; the first occurrence of a
passage in the order of rows is never reported, nor are repeats inside one row (a single match of a place that is in a
better chain of the same two rows is taken for such a repeat). Rows that repeat a doc_id with another text are rows of
their own, in an order that depends on the text alone; rows that repeat both count once; rows without an id come after
all others. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise, only, ranked, runs, small_batches
from ._words import grams, mix, split_words

K, WINDOW = 4, 6
PHRASES = (2, 4, 8)  # seeds in a row that are matched as one
WEIGHT = 16.0  # score of a match
GAP = 0.1  # score lost for each word skipped in either text
NEAR, REACH = 4, 24  # words of a run without a seed, and how many words beyond a known run it may start
LCS_CELLS = 1 << 20  # words of one gap times those of the other; longer gaps, in which no seed is shared, count as unequal
MARGIN = 64  # words fetched on either side of a chain at first; more where what agrees comes near an edge
INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# --- rows ---------------------------------------------------------------------------------------------------------


class Rows(NamedTuple):
    texts: DataFrame  # (row, text)
    names: DataFrame | None  # (row, doc_id, h1, h2), or None where row is doc_id
    kind: str  # type of doc_id
    bits: int  # of a position, below the row in a long


def _hashes() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def numbered(docs: DataFrame) -> Rows:
    """Numbers for the rows of docs that have a text, rising with doc_id; equal rows share one."""
    d = only(docs, "doc_id", "text").where("text is not null")
    kind = d.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("size")
    whole = kind in INTEGRAL
    ids = [F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")] if whole else []
    found = d.agg(size, *ids).first()
    bits = (found["size"] // 2 + 1).bit_length()
    if whole and found["n"] == found["ids"] and (not found["n"] or found["least"] >= 0 and found["most"] < 1 << 63 - bits):
        return Rows(d.select(F.col("doc_id").cast("long").alias("row"), "text"), None, kind, bits)
    each = d.select("*", *_hashes()).groupBy("doc_id", "h1", "h2").agg(F.min("text").alias("text"))
    each = ranked(each, [F.asc_nulls_last("doc_id"), "h1", "h2"], "rows").withColumnRenamed("_rank", "row")
    if (each.agg(F.max("row")).first()[0] or 0) >= 1 << 63 - bits:
        raise ValueError("more rows, or longer texts, than can be numbered")
    return Rows(each.select("row", "text"), each.drop("text"), kind, bits)


# --- seeds --------------------------------------------------------------------------------------------------------


def minimizers(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the least value of some window; all of a shorter array count as one window."""
    n = len(g)
    if n <= window:
        return np.flatnonzero(g == g.min()) if n else np.zeros(0, np.int64)
    low, width = g, 1
    while width < window:  # least of the window from each position on, by doubling
        step = min(width, window - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    top, width = np.concatenate([np.zeros(window - 1, g.dtype), low, np.zeros(window - 1, g.dtype)]), 1
    while width < window:  # greatest of those windows that hold the position
        step = min(width, window - width)
        top = np.maximum(top[: len(top) - step], top[step:])
        width += step
    return np.flatnonzero(top == g)


def repeats(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    start = np.maximum.accumulate(np.where(np.append(True, v[1:] != v[:-1]), np.arange(len(v)), 0)) if len(v) else v
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - start
    return out


def seeds(texts: DataFrame, bits: int) -> DataFrame:
    """(seed, at, row, n, low, high): the seeds of each text, and one row for its words, where seed is null.

    at: row and word position. A seed that stood in the text before comes twice: as it is (even), and with its number
    (odd). low, high: the lower and upper 16 bits of the hash of each of the n words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            w = split_words(b.column("text").to_pylist())
            rows, n = b.column("row").to_numpy(), np.diff(w.first)
            seed, at = [], []
            for i, row in enumerate(rows.tolist()):
                g = grams(w.hash[w.first[i] : w.first[i + 1]], K)
                pos = minimizers(g)
                before = repeats(g[pos])
                again = before > 0
                seed.append(g[pos] & ~np.uint64(1))
                at.append(pos | (row << bits))
                if again.any():
                    seed.append(np.uint64(1) | mix(g[pos[again]] + before[again].astype(np.uint64) * _GOLD))
                    at.append(at[-1][again])
            own = np.flatnonzero(n >= K)
            low, high = w.hash.astype("<u2"), (w.hash >> np.uint64(16)).astype("<u2")
            halves = [pa.array([x[w.first[i] : w.first[i + 1]].tobytes() for i in own.tolist()], pa.binary()) for x in (low, high)]
            seed, at = np.concatenate(seed).view(np.int64), np.concatenate(at).astype(np.int64)
            k = len(own)
            nulls = lambda m, kind: pa.nulls(m, kind)
            long, raw = pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(seed), nulls(k, long)]),
                    pa.concat_arrays([pa.array(at), nulls(k, long)]),
                    pa.concat_arrays([nulls(len(seed), long), pa.array(rows[own])]),
                    pa.concat_arrays([nulls(len(seed), long), pa.array(n[own].astype(np.int64))]),
                    *(pa.concat_arrays([nulls(len(seed), raw), x]) for x in halves),
                ],
                ["seed", "at", "row", "n", "low", "high"],
            )

    return texts.mapInArrow(run, "seed long, at long, row long, n long, low binary, high binary")


def phrases(held: DataFrame, bits: int, min_words: int) -> DataFrame:
    """(seed, at) of each PHRASES seeds in a row that repeat, unless all of them are settled.

    held: (seed, at, ref_at), the seeds of each text that another holds too, with their first occurrence. Seeds are
    settled where a stretch of min_words leads to one place, as the text is then compared with it.
    """
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in runs(batches, ["row"]):
            at, seed = t.column("at").to_numpy(), t.column("seed").to_numpy().view(np.uint64)
            ref_at = t.column("ref_at").to_numpy()
            word, ref = at & mask, ref_at >> bits
            shift, n = word - (ref_at & mask), len(word)
            first = np.zeros(n, bool)
            first[ends[:-1]] = True
            broken = first.copy()
            broken[1:] |= np.diff(word) > WINDOW  # seeds of one run of words are never further apart
            turn = broken.copy()
            turn[1:] |= (ref[1:] != ref[:-1]) | (np.diff(shift) != 0)
            starts = np.flatnonzero(turn)
            size = np.diff(np.append(starts, n))
            span = word[starts + size - 1] + K - word[starts]
            loose = np.append(0, np.cumsum(np.repeat(span < min_words, size)))
            piece = np.cumsum(broken)
            keys, rows = [], []
            for k in PHRASES:
                i = np.arange(max(0, n - k + 1))
                i = i[(piece[i] == piece[i + k - 1]) & (loose[i + k] > loose[i])]
                h = np.full(len(i), k, np.uint64)
                for j in range(k):
                    h = h * _GOLD + seed[i + j]
                keys.append(mix(h))
                rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(at[np.concatenate(rows)])], ["seed", "at"])

    n = max(12, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = held.where("seed % 2 = 0").withColumn("row", F.shiftright("at", bits)).repartition(n, "row").sortWithinPartitions("row", "at", "seed")
    return held.mapInArrow(run, "seed long, at long")


def first_places(found: DataFrame, bits: int) -> DataFrame:
    """(seed, ref_at): the first occurrence of each seed that several rows hold.

    A table, so that a join with it is between exchanges and Spark can split hot seeds.
    """
    first = found.groupBy("seed").agg(F.min("at").alias("ref_at"), F.max("at").alias("last"))
    return materialise(first.where(F.shiftright("ref_at", bits) != F.shiftright("last", bits)).select("seed", "ref_at"), "first")


# --- chains -------------------------------------------------------------------------------------------------------


def chain(x: np.ndarray, y: np.ndarray, weight: float = WEIGHT, gap: float = GAP) -> list[np.ndarray]:
    """Disjoint chains of matches (x[i], y[i]), each strictly rising in both, best first.

    f(j) = weight + max(0, max over i before j of f(i) - gap * (distance in x + distance in y)). The distance splits
    into f(i) + gap * (x_i + y_i), of which a Fenwick tree over y holds prefix maxima, and a part of j alone.
    """
    order = np.lexsort((-y, x))  # equal x: falling y, so that none follows another
    rank = np.searchsorted(np.unique(y), y) + 1
    n = int(rank.max()) if len(rank) else 0
    best, who = [-np.inf] * (n + 1), [-1] * (n + 1)
    score, prev = np.zeros(len(x)), np.full(len(x), -1)
    xs, ys, rs = x.tolist(), y.tolist(), rank.tolist()
    for j in order.tolist():
        top, i, r = -np.inf, -1, rs[j] - 1
        while r > 0:
            if best[r] > top:
                top, i = best[r], who[r]
            r -= r & -r
        reach = gap * (xs[j] + ys[j])
        f = weight
        if top - reach > 0:
            f, prev[j] = weight + top - reach, i
        score[j] = f
        r = rs[j]
        while r <= n:
            if f + reach > best[r]:
                best[r], who[r] = f + reach, j
            r += r & -r
    used = np.zeros(len(x), bool)
    out = []
    for j in np.argsort(-score, kind="stable").tolist():
        got = []
        while j >= 0 and not used[j]:
            used[j] = True
            got.append(j)
            j = prev[j]
        if got:
            out.append(np.array(got[::-1]))
    return out


CHAIN = "row long, ref long, lo long, hi long, ref_lo long, ref_hi long, at array<int>, ref_at array<int>"


def _chains(bits: int):
    """CHAIN rows of sorted matches (row, ref, at, ref_at); lo, hi: word positions of the first and last seed of each."""
    mask = (1 << bits) - 1
    names = [x.split()[0] for x in CHAIN.split(", ")]

    def batch(row, ref, x, y, ends) -> pa.RecordBatch:
        s, e = ends[:-1], ends[1:] - 1
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (x, y)]
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in (row[s], ref[s], x[s], x[e], y[s], y[e])), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in runs(batches, ["row", "ref"]):
            row, ref, x, y = (t.column(c).to_numpy() for c in ("row", "ref", "at", "ref_at"))
            x, y = x & mask, y & mask
            new = np.append(True, (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]))
            twice = ~new
            twice[1:] &= (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            row, ref, x, y, new = (v[~twice] for v in (row, ref, x, y, new))
            starts = np.flatnonzero(new)
            dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
            torn = ~new & ((dx <= 0) | (dy <= 0) | (GAP * (dx + dy) >= WEIGHT))  # else the chain takes all in order
            plain = ~np.logical_or.reduceat(torn, starts)
            sizes = np.diff(np.append(starts, len(x)))
            keep = np.repeat(plain, sizes)
            yield batch(row[keep], ref[keep], x[keep], y[keep], np.append(0, np.cumsum(sizes[plain])))
            for s, n in zip(starts[~plain].tolist(), sizes[~plain].tolist(), strict=True):
                p, q, order, ends = x[s : s + n], y[s : s + n], [], [0]
                seen: set[int] = set()  # places of the earlier row in better chains
                for c in chain(q, p):
                    places = q[c].tolist()
                    if len(c) == 1 and places[0] in seen:
                        continue  # a line said again
                    seen.update(places)
                    order.append(c)
                    ends.append(ends[-1] + len(c))
                c = np.concatenate(order)
                yield batch(row[s : s + n][c], ref[s : s + n][c], p[c], q[c], np.array(ends))

    return run, CHAIN


def with_leaders(chains: DataFrame) -> DataFrame:
    """chains with leads: whether some of its words in row lie in no chain of that row that has more seeds."""
    n = max(12, int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in runs(batches, ["row"]):
            lo, stop = t.column("lo").to_numpy(), t.column("hi").to_numpy() + K
            size = np.diff(t.column("at").combine_chunks().offsets.to_numpy())
            leads = np.ones(len(lo), bool)
            for i in np.flatnonzero(np.diff(ends) > 1).tolist():
                s, e = int(ends[i]), int(ends[i + 1])
                base = int(lo[s:e].min())
                covered = np.zeros(int(stop[s:e].max()) - base, bool)
                for j in (np.argsort(-size[s:e], kind="stable") + s).tolist():
                    own = covered[lo[j] - base : stop[j] - base]
                    if own.all():
                        leads[j] = False
                    own[:] = True
            yield from t.append_column("leads", pa.array(leads)).to_batches()

    dealt = chains.repartition(n, "row").sortWithinPartitions("row", "ref", "lo", "ref_lo")
    return dealt.mapInArrow(run, CHAIN + ", leads boolean")


def uncovered(chains: DataFrame, passages: DataFrame) -> DataFrame:
    """chains whose words in row are not all in one of the passages found."""
    spans = passages.groupBy("row").agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    inside = F.exists("spans", lambda p: (p["start_word"] <= F.col("lo")) & (p["start_word"] + p["n_words"] >= F.col("hi") + K))
    return chains.join(spans, "row", "left").where(~F.coalesce(inside, F.lit(False))).select(*chains.columns)


# --- sieve --------------------------------------------------------------------------------------------------------


def hopeful(a: list[bytes], b: list[bytes], min_words: int, similarity: float) -> np.ndarray:
    """Whether some min_words words in a row of a[i] hold enough words of b[i], both as 16-bit hashes.

    A passage of n words has a stretch of min_words with at least a share of s / (2 - s) of them equal: where n is up to
    2 * min_words / (2 - s) the words beyond the stretch are too few to hold the rest, and where n is larger the first or
    the last stretch has half of the equal words.
    """
    size = np.array([len(x) // 2 for x in a], np.int64)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(a), dtype=np.uint32), size) << np.uint32(16)
    keys = of | np.frombuffer(b"".join(a), "<u2")
    other = np.repeat(np.arange(len(b), dtype=np.uint32), [len(x) // 2 for x in b]) << np.uint32(16) | np.frombuffer(b"".join(b), "<u2")
    found = np.append(0, np.cumsum(np.isin(keys, other)))
    start = np.arange(max(0, len(keys) - min_words + 1))
    pair = np.repeat(np.arange(len(a)), size)[: len(start)]
    good = (start + min_words <= ends[pair]) & (found[start + min_words] - found[start] >= similarity / (2 - similarity) * min_words - 1e-9)
    out = np.zeros(len(a), bool)
    out[pair[good]] = True
    return out


def sieved(chains: DataFrame, words: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """chains without those that can't be part of a passage; longer ones are kept without a look."""
    around = int(-(-2 * min_words // (2 - similarity)))
    both = lambda x, y: (F.col(x) - F.col(y) + K >= min_words)
    long = both("hi", "lo") & both("ref_hi", "ref_lo")

    def window(lo: str, hi: str):
        start = F.greatest(F.lit(0), F.col(lo) - around)
        return F.substring(F.col("low"), (2 * start + 1).cast("int"), (2 * (F.col(hi) + K + around - start)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keep = hopeful(part.column("a").to_pylist(), part.column("b").to_pylist(), min_words, similarity)
                yield part.drop_columns(["a", "b"]).filter(pa.array(keep))

    low = words.select("row", "low")
    near = chains.where(~long).hint("merge").join(low, "row").select(*chains.columns, window("lo", "hi").alias("a"))
    near = near.hint("merge").join(low.withColumnRenamed("row", "ref"), "ref").select(*chains.columns, "a", window("ref_lo", "ref_hi").alias("b"))
    return chains.where(long).unionByName(near.mapInArrow(run, CHAIN))


# --- alignment ----------------------------------------------------------------------------------------------------


def _equal_in_gap(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        take = np.append(0, row[:-1] + (b == w))
        row = np.maximum.accumulate(np.maximum(row, take))
    return int(row[-1])


def _onward(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """The nearest run of at least NEAR equal words that starts within the first REACH words: start in a, in b, length."""
    u, v = grams(a[: REACH + NEAR - 1], NEAR), grams(b[: REACH + NEAR - 1], NEAR)
    i, j = np.nonzero(u[:, None] == v[None, :])
    if not len(i):
        return None
    k = np.lexsort((i + j, np.maximum(i, j)))[0]
    x, y = int(i[k]), int(j[k])
    return x, y, _run(a[x:], b[y:])


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words are equal from the start on."""
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    return int(d[0]) if len(d) else n


def _widened(a: np.ndarray, b: np.ndarray, matched: list[list[int]]) -> list[list[int]]:
    """The runs with those added that follow or precede one nearby, in gaps and at the ends."""
    out: list[list[int]] = []
    for k in range(len(matched) + 1):
        lo = [matched[k - 1][0] + matched[k - 1][2], matched[k - 1][1] + matched[k - 1][2]] if k else [0, 0]
        hi = matched[k][:2] if k < len(matched) else [len(a), len(b)]
        after: list[list[int]] = []
        while k and (got := _onward(a[lo[0] : hi[0]], b[lo[1] : hi[1]])):
            after.append([lo[0] + got[0], lo[1] + got[1], got[2]])
            lo = [after[-1][0] + got[2], after[-1][1] + got[2]]
        before: list[list[int]] = []
        while k < len(matched) and (got := _onward(a[lo[0] : hi[0]][::-1], b[lo[1] : hi[1]][::-1])):
            hi = [hi[0] - got[0] - got[2], hi[1] - got[1] - got[2]]
            before.append([*hi, got[2]])
        out += after + before[::-1] + matched[k : k + 1]
    return out


def longest(at: np.ndarray, ref_at: np.ndarray, n: np.ndarray, same: np.ndarray, least: float, min_words: int) -> list[tuple[int, int]]:
    """Disjoint segments (first run, last run), each the longest left that has the share and the words.

    at, ref_at, n: start and length of each run; same: equal words in the gap before it. A segment is as long as the
    shorter of its two sides. Ends that hold more unequal words than equal ones are left out, as far as min_words are kept.
    """
    ends, ref_ends = at + n, ref_at + n
    equal = np.cumsum(n + same)  # words equal up to and with each run
    before = equal - n
    out, todo = [], [(0, len(n))]
    while todo:
        lo, hi = todo.pop()
        best, found = min_words - 1, None
        for k in range(lo, hi):
            words, ref_words = ends[k:hi] - at[k], ref_ends[k:hi] - ref_at[k]
            size = np.minimum(words, ref_words)  # rises
            f = int(np.searchsorted(size, best, side="right"))
            if f == len(size):
                if min(ends[hi - 1] - at[k], ref_ends[hi - 1] - ref_at[k]) <= best:
                    break
                continue
            good = np.flatnonzero(equal[k:hi][f:] - before[k] >= least * np.maximum(words, ref_words)[f:] - 1e-9)
            if len(good):
                best, found = int(size[f + good[-1]]), (k, k + f + int(good[-1]))
        if found is None:
            continue
        s, e = found
        cut = True
        while cut:
            cut = False
            inner = np.arange(s, e)  # the end after each of these runs, and the start up to it
            tail = equal[e] - equal[inner], np.maximum(ends[e] - ends[inner], ref_ends[e] - ref_ends[inner])
            head = before[inner + 1] - before[s], np.maximum(at[inner + 1] - at[s], ref_at[inner + 1] - ref_at[s])
            left = np.minimum(ends[inner] - at[s], ref_ends[inner] - ref_at[s]), np.minimum(ends[e] - at[inner + 1], ref_ends[e] - ref_at[inner + 1])
            for side, (same_words, words) in enumerate((tail, head)):
                loss = np.where(left[side] >= min_words, words - 2 * same_words, 0)
                if len(loss) and loss.max() > 0 and not cut:
                    w = int(loss.argmax())
                    s, e = (s, s + w) if side == 0 else (s + w + 1, e)
                    cut = True
        out.append((s, e))
        todo += [(lo, s), (e + 1, hi)]
    return sorted(out)


def equal_runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, ref_at: np.ndarray) -> list[list[int]]:
    """Runs of equal words (start in a, start in b, length) along the seeds at / ref_at of a chain, in order."""
    matched: list[list[int]] = []
    for x, y in zip(at.tolist(), ref_at.tolist(), strict=True):
        if matched and (x < matched[-1][0] + matched[-1][2] or y < matched[-1][1] + matched[-1][2]):
            if x - y == matched[-1][0] - matched[-1][1]:
                continue
        floor_a, floor_b = (matched[-1][0] + matched[-1][2], matched[-1][1] + matched[-1][2]) if matched else (0, 0)
        if x < floor_a or y < floor_b:
            cut = max(floor_a - x, floor_b - y)
            x, y = x + cut, y + cut
        if x >= len(a) or y >= len(b) or a[x] != b[y]:
            continue
        back = min(x - floor_a, y - floor_b)
        d = np.flatnonzero((a[x - back : x] != b[y - back : y])[::-1]) if back else []
        back = int(d[0]) if len(d) else back
        matched.append([x - back, y - back, back + _run(a[x:], b[y:])])
    return _widened(a, b, matched) if matched else []


def ends_at_edge(words: int, ref_words: int, goes_on: bool, ref_goes_on: bool) -> bool:
    """Whether a run could follow beyond the slices, with so many words seen between the outermost run and their edges."""
    if words < NEAR and not goes_on or ref_words < NEAR and not ref_goes_on:
        return False
    return goes_on and words < REACH + NEAR or ref_goes_on and ref_words < REACH + NEAR


def align(a: np.ndarray, b: np.ndarray, at: np.ndarray, ref_at: np.ndarray, least: float = 0.8, min_words: int = 50) -> list[tuple[int, int, int, int, float]]:
    """The passages() along the seeds at / ref_at of a chain."""
    return passages(a, b, equal_runs(a, b, at, ref_at), least, min_words)


def passages(a: np.ndarray, b: np.ndarray, matched: list[list[int]], least: float, min_words: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (start in a, end, start in b, end, share of equal words) over runs of equal words.

    The longest stretch of which a share of `least` is equal is taken, then the longest of what is left on either side
    of it, as long as they have min_words.
    """
    if not matched:
        return []
    same = [0]
    for p, q in zip(matched, matched[1:], strict=False):
        ga, gb = q[0] - p[0] - p[2], q[1] - p[1] - p[2]
        same.append(_equal_in_gap(a[q[0] - ga : q[0]], b[q[1] - gb : q[1]]) if 0 < min(ga, gb) and ga * gb <= LCS_CELLS else 0)
    xs, ys, n = np.array(matched, np.int64).T
    sames = np.array(same, np.int64)
    out = []
    for k, m in longest(xs, ys, n, sames, least, min_words):
        na, nb = int(xs[m] + n[m] - xs[k]), int(ys[m] + n[m] - ys[k])
        equal = int(n[k : m + 1].sum() + sames[k + 1 : m + 1].sum())
        out.append((int(xs[k]), int(xs[k]) + na, int(ys[k]), int(ys[k]) + nb, equal / max(na, nb)))
    return out


ALIGNED = "row long, ref long, start_word int, n_words int, ref_start_word int, ref_n_words int, similarity double, id long"


def _aligned(min_words: int, least: float):
    """A row per passage; or one without a span for a chain whose slices are too short."""

    def words(low: bytes, high: bytes) -> np.ndarray:
        return np.frombuffer(low, "<u2").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "a_low"):
            r = b.to_pydict()
            rows, vals = [], []
            for i in range(b.num_rows):
                base, ref_base = r["a_from"][i], r["b_from"][i]
                a, c = words(r["a_low"][i], r["a_high"][i]), words(r["b_low"][i], r["b_high"][i])
                found = equal_runs(a, c, np.asarray(r["at"][i], np.int64) - base, np.asarray(r["ref_at"][i], np.int64) - ref_base)
                if found:
                    x, y, _ = found[0]
                    u, v, m = found[-1]
                    more, ref_more = base + len(a) < r["a_n"][i], ref_base + len(c) < r["b_n"][i]
                    if ends_at_edge(x, y, base > 0, ref_base > 0) or ends_at_edge(len(a) - u - m, len(c) - v - m, more, ref_more):
                        rows.append(i)
                        vals.append((None,) * 5)
                        continue
                for s, e, rs, re, share in passages(a, c, found, least, min_words):
                    rows.append(i)
                    vals.append((s + base, e - s, rs + ref_base, re - rs, share))
            take = pa.array(rows, pa.int64())
            cols = list(zip(*vals, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(take), b.column("ref").take(take), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.float64()), b.column("id").take(take)],
                [x.split()[0] for x in ALIGNED.split(", ")],
            )

    return run, ALIGNED


def _compared(words: DataFrame, chains: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The rows of _aligned() for chains (id, margin, ...), with `margin` words fetched on either side of them.

    One join with the words cuts the slices of both sides; a second one brings the two slices of a chain together.
    """
    side = lambda c, row, lo, hi: F.struct(F.lit(c).alias("side"), F.col(row).alias("row"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    wanted = chains.select("id", "margin", F.explode(F.array(side("a", "row", "lo", "hi"), side("b", "ref", "ref_lo", "ref_hi"))).alias("w")).select("id", "margin", "w.*")
    start = F.greatest(F.lit(0), F.col("lo") - F.col("margin"))
    size = F.least(F.col("n"), F.col("hi") + K + F.col("margin")) - start
    part = lambda c: F.substring(F.col(c), (2 * start + 1).cast("int"), (2 * size).cast("int"))
    slices = wanted.hint("merge").join(words, "row").select("id", "side", start.alias("from"), "n", part("low").alias("low"), part("high").alias("high"))
    slices = materialise(slices, "slices")
    of = lambda c: slices.where(F.col("side") == c).select("id", *(F.col(x).alias(f"{c}_{x}") for x in ("from", "n", "low", "high")))
    both = chains.join(of("a"), "id").join(of("b"), "id")
    out = materialise(both.mapInArrow(*_aligned(min_words, similarity)), "aligned")
    drop_scratch(slices)
    return out


def _compare_all(words: DataFrame, led: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Passages of chains with leads: those of the leaders, then of what these leave uncovered.

    Chains whose slices were too short come again, with a larger margin, beside the chains of the next round. Joins with
    the words are merge joins at any size, so that a small run is like a large one.
    """

    def todo(chains: DataFrame) -> DataFrame:
        near = sieved(chains.drop("leads"), words, min_words, similarity)
        return near.withColumns({"id": F.monotonically_increasing_id(), "margin": F.lit(MARGIN)})

    chains, out, rest = materialise(todo(led.where("leads")), "leaders"), None, led.where("not leads")
    while True:
        got = _compared(words, chains, min_words, similarity)
        part = got.where("start_word is not null").drop("id")
        out = part if out is None else out.unionByName(part)
        short = chains.join(got.where("start_word is null").select("id"), "id", "left_semi").withColumn("margin", F.col("margin") * 8)
        first = rest is not None
        if first:
            fresh = todo(materialise(uncovered(rest, part), "uncovered")).withColumn("id", -1 - F.col("id"))
            short, rest = short.unionByName(fresh.select(short.columns)), None
        left = materialise(short, "again")
        drop_scratch(chains)
        chains = left
        if chains.isEmpty():
            return materialise(out.distinct(), "passages")
        if first:  # few rows are left: those alone are shuffled from here on
            rows = chains.select("row").unionByName(chains.select(F.col("ref").alias("row"))).distinct()
            words = materialise(words.join(rows.hint("merge"), "row", "left_semi"), "words")


# --- the operator -------------------------------------------------------------------------------------------------


def _passages(rows: Rows, min_words: int, similarity: float) -> DataFrame:
    """(row, ref, start_word, n_words, ref_start_word, ref_n_words, similarity) of each passage."""
    bits = rows.bits
    made = seeds(rows.texts, bits).withColumn("part", F.when(F.col("row").isNull(), "seeds").otherwise("words"))
    made = materialise(made, "seeds", "part")
    found, words = made.where("part = 'seeds'").select("seed", "at"), made.where("part = 'words'").select("row", "n", "low", "high")
    first = first_places(found, bits)
    held = materialise(found.join(first, "seed").select("seed", "at", "ref_at"), "held")
    drop_scratch(made, of="part=seeds")
    drop_scratch(first)
    spoken = materialise(phrases(held, bits, min_words), "phrases")
    first = first_places(spoken, bits)
    links = held.select("at", "ref_at").unionByName(spoken.join(first, "seed").select("at", "ref_at"))
    row, ref = F.shiftright("at", bits), F.shiftright("ref_at", bits)  # taken from the places, so that only these are shuffled
    n = max(12, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = links.where(row != ref).repartition(n, row, ref).sortWithinPartitions(row, ref, "at", "ref_at")
    links = links.select("at", "ref_at", row.alias("row"), ref.alias("ref"))
    chains = materialise(links.mapInArrow(*_chains(bits)), "chains")
    drop_scratch(held, spoken, first)
    led = materialise(with_leaders(chains), "led")
    drop_scratch(chains)
    out = _compare_all(words, led, min_words, similarity)
    drop_scratch(made, led)
    return out


def _in_characters(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (row, start_word, n_words, ...) and start_char, n_chars."""
    more = [c for c in found.columns if c != "row"]
    schema = f"row long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema if f.name != 'row')}, start_char int, n_chars int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            w = split_words(b.column("text").to_pylist())
            spans = b.column("spans")
            flat, sizes = spans.flatten(), np.diff(spans.offsets.to_numpy())
            base = np.repeat(w.first[:-1], sizes)
            start = flat.field("start_word").to_numpy() + base
            last = start + flat.field("n_words").to_numpy() - 1
            chars = w.start[start]
            cols = [b.column("row").take(pa.array(np.repeat(np.arange(b.num_rows), sizes))), *(flat.field(c) for c in more)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(chars, pa.int32()), pa.array(w.end[last] - chars, pa.int32())], ["row", *more, "start_char", "n_chars"])

    spans = found.groupBy("row").agg(F.collect_list(F.struct(*more)).alias("spans"))
    return spans.hint("merge").join(texts, "row").select("row", "text", "spans").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """A row for each passage of a row of docs that an earlier row (smaller doc_id) holds as well.

    Spans are given in words and in characters; ref_* is the earlier row and its words. Spans of one row may overlap
    where several rows hold parts of them.
    """
    rows = numbered(docs)
    out = _in_characters(_passages(rows, min_words, similarity), rows.texts)
    if rows.names is None:
        out = out.withColumns({"doc_id": F.col("row").cast(rows.kind), "ref_doc_id": F.col("ref").cast(rows.kind)})
    else:
        own = rows.names.select("row", "doc_id")
        out = out.join(own, "row").join(own.select(F.col("row").alias("ref"), F.col("doc_id").alias("ref_doc_id")), "ref")
    return out.select("doc_id", "start_word", "n_words", "start_char", "n_chars", "ref_doc_id", "ref_start_word", "ref_n_words", "similarity")


def cut_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """docs without the passages that earlier rows hold; each passage stays where it occurs first.

    What lies before, between and after passages stays as it is, white space included; a row of which nothing is left
    stays with an empty text. n_chars, where there is such a column, is brought up to date; all other columns, and texts
    without such a passage, are kept as they are. Equal rows are all cut alike.
    """
    numbers = numbered(docs)
    spans = _passages(numbers, min_words, similarity).select("row", "start_word", "n_words").distinct()
    spans = _in_characters(spans, numbers.texts).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start_char", "n_chars"))).alias("_cuts"))
    # the row in one column, so that no name of the input can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    if numbers.names is None:
        spans = materialise(spans.withColumnRenamed("row", "_cut_id"), "spans")
        rows = rows.join(spans, F.col("_row.doc_id").cast("long") == F.col("_cut_id"), "left")
    else:
        named = numbers.names.join(spans, "row").select(F.col("doc_id").alias("_cut_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_cuts")
        spans = materialise(named, "spans")
        rows = rows.select("_row", *(h.alias(f"_own{i}") for i, h in enumerate(_hashes())))
        same = F.col("_row.doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("_own0") == F.col("_h1")) & (F.col("_own1") == F.col("_h2"))
        rows = rows.join(spans, same, "left")
    text = F.col("_row.text")
    # each span in order: what lies between the end so far and its start stays
    kept = F.aggregate(
        "_cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c["start_char"] > acc["at"], F.substring(text, acc["at"] + 1, c["start_char"] - acc["at"])).otherwise(F.lit(""))).alias("out"),
            F.greatest(acc["at"], c["start_char"] + c["n_chars"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.col("_cuts").isNull() | text.isNull()
    rows = rows.select("_row", clean.alias("_clean"), F.when(~clean, kept).alias("_left"))
    out = []
    for c in docs.columns:
        old, new = F.col(f"_row.`{c}`"), None
        if c == "text":
            new = F.col("_left")
        elif c == "n_chars":
            new = F.length("_left").cast(docs.schema[c].dataType)
        out.append((old if new is None else F.when(F.col("_clean"), old).otherwise(new)).alias(c))
    return rows.select(*out)
