"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block are stored as bit planes: plane b holds bit b of 64 fingerprints in one machine word. The
distances of a query to a whole block grow in carry-save counters (one word per counter bit and 64 fingerprints);
every eight planes, blocks in which every distance is over the radius are abandoned.

near_groups() links fingerprints at a fixed Hamming radius and is exact. Fingerprints within radius r agree on
r' = parts - r of any `parts` parts of the word, so each choice of parts is a blocking key. A block over BLOCK
fingerprints is dealt again by the same rule on the bits its key leaves open, down to blocks of at most 2**11.

similar_groups() is for a word-shingle similarity, at which 64-bit distances spread too widely for a radius alone:
MinHash bands give the blocks, the bit-sliced pass abandons what is far, and bottom-k sketches of the shingles decide;
where a sketch leaves it in doubt, the whole sets of shingles do.

Defined cases: null or blank texts have fingerprint 0 and are linked with one another; a text of fewer words than a
shingle is one shingle; equal rows each get a result row; null ids are carried and never become a component's id
unless the component has no other; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import drop_scratch, materialise, only, runs, scratch, small_batches
from ._words import grams, mix, split_words

BLOCK = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.arange(64, dtype=np.uint64)


# --- fingerprints -------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted, each by XXH64."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n, digest = len(words) - k + 1, xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        s, e = starts[at : min(n, at + (1 << 16))].tolist(), ends[at + k - 1 : min(n, at + (1 << 16)) + k - 1].tolist()
        h = np.array([digest(joined[a:b], seed) for a, b in zip(s, e, strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# --- bit-sliced comparison ----------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(..., 64 lanes) fingerprints as (..., 64 planes) words."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(*fps.shape, 8), axis=-1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.swapaxes(bits, -1, -2), axis=-1, bitorder="little")).view("<u8")[..., 0]


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """A word for each row, with a bit for each lane whose distance to the row's query is at most the radius.

    planes: (rows, 64) words; queries: (rows,) fingerprints.
    """
    rows = np.arange(len(planes))
    out = np.zeros(len(planes), np.uint64)
    counter = [np.zeros(len(planes), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(planes), np.uint64)
    p, q = planes, queries
    for b in range(64):
        x = p[:, b] ^ (-((q >> np.uint64(b)) & np.uint64(1)).view(np.int64)).view(np.uint64)
        for i, c in enumerate(counter):
            x, counter[i] = c & x, c ^ x
        over |= x
        if b % 8 == 7 and b < 63:
            far, same = over.copy(), ~over  # counters above the radius so far
            for i in reversed(range(len(counter))):
                if radius >> i & 1:
                    same &= counter[i]
                else:
                    far |= same & counter[i]
                    same &= ~counter[i]
            live = far != ALL
            if not live.all():
                rows, p, q, over, counter = rows[live], p[live], q[live], over[live], [c[live] for c in counter]
                if not len(rows):
                    return out
    far, same = over.copy(), ~over
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            far |= same & counter[i]
            same &= ~counter[i]
    out[rows] = ~far
    return out


def forest(groups: list[np.ndarray], fps: np.ndarray, radius: int, agree=None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what lies within the radius in each group, no more than a spanning forest of it.

    groups: row numbers into fps, no row in two of them; agree(i, rows): which rows are truly alike; root: takes, for
    each row, the row that stands for its tree. Pairs of one tree are not asked for again, and a group of one tree is done.
    """
    words: list[tuple[int, int]] = []  # group, first row of its 64 lanes
    for g, at in enumerate(groups):
        words += [(g, i) for i in range(0, len(at), 64)]
    if not words:
        return []
    lanes = np.zeros((len(words), 64), np.uint64)
    for w, (g, i) in enumerate(words):
        part = groups[g][i : i + 64]
        lanes[w, : len(part)] = fps[part]
    planes = planes_of(lanes)
    sizes = np.array([len(g) for g in groups])
    base = np.cumsum((sizes + 63) // 64) - (sizes + 63) // 64
    root = np.arange(len(fps)) if root is None else root
    edges: list[tuple[int, int]] = []
    gw, iw = np.array([w[0] for w in words]), np.array([w[1] for w in words])
    many = max(1, 2048 // len(words))  # queries of each group at a time
    for start in range(0, int(sizes.max()) - 1, many):
        w, q = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(start, start + many)))
        live = (sizes[gw[w]] > q + 1) & (iw[w] + 64 > q + 1)
        w, q = w[live], q[live]
        if not len(w):
            break
        hit = within(planes[w], lanes[base[gw[w]] + q // 64, q % 64], radius)
        hit &= ALL << np.clip(q + 1 - iw[w], 0, 63).astype(np.uint64)
        left = sizes[gw[w]] - iw[w]
        hit &= np.where(left >= 64, ALL, (np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1))
        some = np.flatnonzero(hit)
        r, lane = np.nonzero((hit[some][:, None] >> _LANES) & np.uint64(1))
        if not len(r):
            continue
        g, row, place = gw[w[some[r]]], q[some[r]], iw[w[some[r]]] + lane
        cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(row) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
            at = groups[g[a]]
            i, found = at[row[a]], at[place[a:b]]
            found = found[root[found] != root[i]]
            if agree is not None and len(found):
                found = found[agree(i, found)]
            if not len(found):
                continue
            trees, one = np.unique(root[found], return_index=True)
            edges += [(int(i), int(j)) for j in found[one]]
            own = root[at]
            own[np.isin(own, trees)] = root[i]
            root[at] = own
            if (own == own[0]).all():
                sizes[g[a]] = 0
    return edges


def _alike(sig: pa.Array, similarity: float):
    """agree() for forest() from sketches, and the list to which it adds the pairs that they leave in doubt."""
    margin = margin_of(similarity)
    raw = sig.to_pylist()
    size = np.array([len(x) // 4 for x in raw], np.int64)
    ends = np.cumsum(size)
    values, ids = np.unique(np.frombuffer(b"".join(raw), np.uint32), return_inverse=True)
    mark = np.zeros(len(values), bool)
    doubt: list[tuple[int, int]] = []

    def agree(i: int, rows: np.ndarray) -> np.ndarray:
        n = size[rows]
        first = np.cumsum(n) - n
        own = ids[ends[i] - size[i] : ends[i]]
        mark[own] = True
        common = np.add.reduceat(mark[ids[np.repeat(ends[rows] - n - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        mark[own] = False
        exact = (n < SKETCH) & (size[i] < SKETCH)
        out = exact & (common / (size[i] + n - common) >= similarity)
        for k in np.flatnonzero(~exact & (common / SKETCH >= similarity - margin)).tolist():  # no estimate is above that
            share, _ = jaccard(np.frombuffer(raw[i], np.uint32), np.frombuffer(raw[rows[k]], np.uint32))
            if abs(share - similarity) > margin:
                out[k] = share >= similarity
            else:
                doubt.append((int(i), int(rows[k])))
        return out

    return agree, doubt


def _compare(radius: int, signature: bool = False, similarity: float = 0.0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["k1", "k2"]):
            fps = t.column("fp").to_numpy().view(np.uint64)
            node = t.column("node").combine_chunks()
            agree, doubt = _alike(t.column("sig"), similarity) if signature else (None, [])
            root = np.arange(len(fps))
            groups = [np.arange(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a + 1]
            groups.sort(key=len)  # batches of blocks of about one size
            edges: list[tuple[int, int]] = []
            step = 0
            while step < len(groups):
                many = max(1, 8192 // (len(groups[step]) + 64))
                edges += forest(groups[step : step + many], fps, radius, agree, root)
                step += many
            doubt = [(i, j) for i, j in doubt if root[i] != root[j]]
            e = np.array(edges + doubt, np.int64).reshape(-1, 2)
            columns = [node.take(pa.array(e[:, 0])), node.take(pa.array(e[:, 1]))]
            if signature:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(e)) < len(edges))], ["u", "v", "sure"])
            else:
                yield pa.RecordBatch.from_arrays(columns, ["u", "v"])

    return run


# --- blocks -------------------------------------------------------------------------------------------------------


def _masks(bits: list[int], radius: int) -> list[tuple[int, int]]:
    """(mask, bits left open) of every choice of parts on which two words within the radius can agree."""
    parts = np.array_split(np.array(bits), radius + 3)
    out = []
    for keep in combinations(range(len(parts)), len(parts) - radius):
        mask = sum(1 << int(b) for i in keep for b in parts[i])
        out.append((mask - (1 << 64) if mask >> 63 else mask, [int(b) for i, p in enumerate(parts) if i not in keep for b in p]))
    return out


def _keyed(nodes: DataFrame, masks: list[int], first: int = 0) -> DataFrame:
    """Each row once per mask: k1 numbers the mask, k2 is the fingerprint under it."""
    keys = F.array(*(F.struct(F.lit(first + i).alias("k1"), F.col("fp").bitwiseAND(F.lit(m)).alias("k2")) for i, m in enumerate(masks)))
    return nodes.select("*", F.explode(keys).alias("k")).select(*nodes.columns, "k.k1", "k.k2")


def _blocks_to_edges(blocks: DataFrame, run, schema: str = "u long, v long") -> DataFrame:
    n = max(12, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, schema)


def link(nodes: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all distinct (node, fp) within the Hamming radius; a forest per block, nothing lost."""
    masks = _masks(list(range(64)), radius)
    keyed = _keyed(nodes, [m for m, _ in masks])
    hot = materialise(keyed.groupBy("k1", "k2").count().where(F.col("count") > block).select("k1", "k2"), "hot")
    if hot.isEmpty():
        return _blocks_to_edges(keyed, _compare(radius))
    edges = _blocks_to_edges(keyed.join(hot, ["k1", "k2"], "left_anti"), _compare(radius))
    over = keyed.join(hot, ["k1", "k2"], "left_semi")
    for i, (mask, free) in enumerate(masks):
        deeper = [(mask | m) for m, _ in _masks(free, radius)]
        again = _keyed(over.where(F.col("k1") == i).select("node", "fp"), deeper, len(masks) * (i + 1))
        edges = edges.unionByName(_blocks_to_edges(again, _compare(radius)))
    return edges


def _with_components(rows: DataFrame, edges: DataFrame, more: list[str]) -> DataFrame:
    """rows: (doc_id, node, ...); adds the least doc_id of the component of each node."""
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    comp = reps.join(connected_components(edges), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    comp = materialise(comp, "components")
    # tables, so that each join is between exchanges and Spark can split its hot keys
    ids = materialise(comp.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = materialise(comp.join(ids, "component").select("node", "component_id"), "named")
    return rows.join(named, "node").select("doc_id", *more, "component_id")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; see the module for what each case gives."""
    rows = materialise(fingerprints(docs, shingle).withColumn("node", F.col("fp")), "fingerprints")
    nodes = rows.select("node", "fp").distinct()
    out = _with_components(rows, link(nodes, radius, block), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of word shingles ----------------------------------------------------------------------------------

SLOTS = 120  # hash functions of the bands, at most
MISSED = 0.000075  # chance that a pair just at the threshold shares no band, at most
SKETCH = 1024
DOUBT = 4.8  # estimates within so many deviations of the threshold are settled by the whole sets
_MULT = np.random.default_rng(7).integers(1, 1 << 32, SLOTS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(8).integers(0, 1 << 32, SLOTS, dtype=np.uint64).astype(np.uint32)


def bands_of(similarity: float) -> tuple[int, int]:
    """(bands, rows): the longest bands by which SLOTS hash functions miss a pair at the similarity as MISSED allows."""
    for rows in range(SLOTS, 0, -1):
        hit = similarity**rows
        bands = 1 if hit == 1 else math.ceil(math.log(MISSED) / math.log1p(-hit)) if hit > 1e-9 else SLOTS + 1
        if bands * rows <= SLOTS:
            return bands, rows
    raise ValueError(f"similarity {similarity} is too low for {SLOTS} hash functions")


def radius_of(similarity: float) -> int:
    """The least radius beyond which lie under three in 10^11 fingerprints of sets that are as similar.

    A bit differs with the angle of the two sets as vectors, which at one similarity is widest for sets of one size.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    beyond = 0.0
    for r in range(64, 0, -1):
        beyond += math.comb(64, r) * p**r * (1 - p) ** (64 - r)
        if beyond >= 3e-11:
            return r
    return 0


def margin_of(similarity: float) -> float:
    """How near the similarity the estimate of a sketch leaves a pair in doubt."""
    return DOUBT * math.sqrt(similarity * (1 - similarity) / SKETCH)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
    """Similarity from two bottom-k sketches (sorted, distinct), and whether it is exact.

    It is exact if neither set has more than SKETCH values; else from the least SKETCH values of the union.
    """
    exact = len(a) < SKETCH and len(b) < SKETCH
    both = np.union1d(a, b)
    if not exact:
        both = both[:SKETCH]
    if not len(both):
        return 1.0, exact
    common = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(common, both[-1], side="right") / len(both), exact


def _shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    return grams(h, shingle) if len(h) >= shingle else mix(grams(h, len(h))) if len(h) else np.zeros(1, np.uint64)


def _node(text: str | None) -> bytes:
    """128 bits that stand for the word sequence of a text; so many that no two sequences ever share them."""
    return xxhash.xxh128_digest(b" ".join(text.encode().translate(_LOWER).split())) if text else xxhash.xxh128_digest(b"")


def whole_sets(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, whole): all distinct shingles, sorted, of each text that can be alike to one of SKETCH shingles or more."""
    least = math.ceil(similarity * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            texts = b.column("text").to_pylist()
            w = split_words(texts)
            sets = [(t, np.unique(_shingles(w.hash[w.first[i] : w.first[i + 1]], shingle))) for i, t in enumerate(texts)]
            sets = [(_node(t), g.tobytes()) for t, g in sets if len(g) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.binary()), pa.array([x[1] for x in sets], pa.binary())], ["node", "whole"])

    return only(docs, "text").where(F.length("text") >= 2 * least - 1).mapInArrow(run, "node binary, whole binary")


def settle(doubt: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose whole sets of shingles are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "a"):
            keep = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common / (len(x) + len(y) - common) >= similarity)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    wanted = doubt.select(F.col("u").alias("node")).unionByName(doubt.select(F.col("v").alias("node"))).distinct()
    sets = whole_sets(docs, shingle, similarity).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("whole").alias("whole"))
    sets = materialise(sets, "sets")
    both = doubt.join(sets.select(F.col("node").alias("u"), F.col("whole").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("whole").alias("b")), "v")
    return materialise(both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary"), "settled")


def signatures(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, fp, sig, bands): 128 bits for the word sequence, SimHash, sketch of the shingles and band keys."""
    bands, rows = bands_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            texts = b.column("text").to_pylist()
            w = split_words(texts)
            n = b.num_rows
            gram, at = [], np.zeros(n + 1, np.int64)
            for i in range(n):
                g = _shingles(w.hash[w.first[i] : w.first[i + 1]], shingle)
                gram.append(g)
                at[i + 1] = at[i] + len(g)
            g = np.concatenate(gram)
            low = (g >> np.uint64(32)).astype(np.uint32)
            least = np.empty((n, bands * rows), np.uint32)
            for j in range(bands * rows):
                least[:, j] = np.minimum.reduceat(low * _MULT[j] + _ADD[j], at[:-1])
            sig = [np.unique(low[at[i] : at[i + 1]])[:SKETCH] for i in range(n)]
            band = least.reshape(n, bands, rows).astype(np.uint64)
            key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
            for r in range(rows):
                key = mix((key ^ band[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
            fp = np.zeros(n, np.uint64)
            for i in range(n):
                bits, own = np.zeros(64, np.int64), np.unique(g[at[i] : at[i + 1]])  # distinct, as the similarity is
                for s in range(0, len(own), 1 << 16):
                    part = own[s : s + (1 << 16)]
                    bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fp[i] = np.packbits(2 * bits > len(own), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([_node(t) for t in texts], pa.binary()),
                    pa.array(fp.view(np.int64)),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel())),
                ],
                ["doc_id", "node", "fp", "sig", "bands"],
            )

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, node binary, fp long, sig binary, bands array<long>")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row: components of texts whose word shingles are alike.

    Bands, radius and doubt follow the similarity, so that any of them finds its pairs; the lower it is, the shorter are
    the bands and the less does the radius drop. The fingerprints are of distinct shingles: a pair just at the threshold
    lies over the radius three times in 10^11, and shares no band with probability MISSED. Sketches hold all
    shingles of texts of up to SKETCH; beyond, the estimate has a standard deviation of 0.0125 at 0.8, and pairs within
    DOUBT deviations of the threshold are compared by their whole sets. A block of
    over `block` distinct texts is dealt as pairs of tiles, so that none is held whole by one task.
    """
    radius = radius_of(similarity) if radius is None else radius
    rows = materialise(signatures(docs, shingle, similarity), "signatures")
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    named = materialise(rows.select("doc_id", "node"), "named")
    drop_scratch(rows)
    keyed = nodes.select("node", F.posexplode("bands").alias("k1", "k2"))
    counts = materialise(keyed.groupBy("k1", "k2").count().where("count > 1"), "counts")
    tiles = F.ceil(F.col("count") / block).cast("int")
    members = keyed.join(counts, ["k1", "k2"]).withColumn("tiles", tiles)
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(own, o) * F.col("tiles") + F.greatest(own, o))
    members = members.select("node", F.col("k1"), F.explode(pair).alias("tile"), "k2")
    blocks = members.join(nodes.select("node", "fp", "sig"), "node").select("node", "fp", "sig", F.xxhash64("k1", "tile").alias("k1"), "k2")
    found = materialise(_blocks_to_edges(blocks, _compare(radius, True, similarity), "u binary, v binary, sure boolean"), "found")
    edges = found.where("sure").select("u", "v")
    doubt = materialise(found.where("not sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "doubt")
    if not doubt.isEmpty():
        edges = edges.unionByName(settle(doubt, docs, shingle, similarity))
    return _with_components(named, edges, [])


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of smaller doc_id in their group.

    Of rows that repeat a doc_id all stay or go together; a row with a null doc_id stays only where no other row of
    its group has an id. All columns are kept as they are.
    """
    with scratch(docs.sparkSession):
        groups = similar_groups(docs, similarity=similarity)
        gone = groups.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id")) | F.col("doc_id").isNull() & F.col("component_id").isNotNull())
        gone = materialise(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone", outlives=True)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # no name of the input can clash
    return rows.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")


__all__ = ["drop_near_duplicates", "drop_scratch", "fingerprint", "fingerprints", "forest", "link", "near_groups", "signatures", "similar_groups", "within"]
