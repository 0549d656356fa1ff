"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text of over CHUNK characters is split into chunks at fixed places. A boundary state is a piece of the vocabulary that
matches the text across (or up to) the boundary. For each chunk a transfer matrix holds the best score of a path from
each entry state to each exit state, -inf where there is none; matrices combine associatively by max-plus products,
first within groups of GROUP chunks, then along the document. The best state of every boundary follows, and each chunk
is traced back by itself between its two states.

The score of a path depends on the model. Unigram: the sum of the pieces' log-probabilities. BPE, as the public model
file is: a max-plus sum of piece scores would not give BPE's result, so the weights are 0 for a piece that BPE leaves
beside the piece before it (their joint text is split into these two again) and -inf for any other; one path of
score 0 exists, and it is BPE's. Between two characters that stand together in no piece every path has a boundary, so
runs between such cuts, inside a chunk, are solved once and kept by their text (words of a BPE model by the library).

Shorter texts are encoded by the library, which gives the same ids: word by word through a bounded cache where the
model has a cut before every space and adds one in front, else whole.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each; characters without a piece
become byte pieces, or the unknown id where a model has none; U+2581 decodes to a space, as in the library; further
columns are ignored; an empty table gives no rows; models with normalisation rules raise ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import part_name
from ._shared import materialise, only, runs, small_batches
from .tokens import vocabulary

CHUNK = 1 << 13
GROUP = 64
SPACE = "▁"
NONE = -np.inf
_WORD = re.compile(f"{SPACE}+")
State = tuple[int, int]  # length of the piece, characters of it after the boundary; (0, 0) at the ends of a text


class Model:
    """Pieces, scores and merge rules of a model file."""

    def __init__(self, content: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(content)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises its text")
        self.bpe = m.trainer_spec.model_type == 2
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("neither a unigram nor a BPE model")
        self.prefix = norm.add_dummy_prefix
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (1, 4)}
        self.unknown = min(self.score.values()) - 10
        self.unk_id = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.bytes = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
        self.longest = max(map(len, self.id))
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.kept: dict[str, tuple[float, bytes]] = {}
        self.by_word = self.prefix and not any(p[1] == SPACE != p[0] for p in self.pairs)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.shown: pa.Array | None = None
        self.beside = functools.lru_cache(50_000)(self._beside)

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the adjacent pair whose joint piece scores best is merged, the leftmost first."""
        s = list(text)
        while True:
            best = None
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best[0]):
                    best = (v, i)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    def _beside(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def weight(self, left: str, right: str) -> float:
        """Of the piece right after left ("" at a cut or the start); -inf if they can't stand so."""
        if self.bpe:
            return 0.0 if self.beside(left, right) else NONE
        return self.score.get(right, self.unknown)

    def nodes(self, x: str, start: int, left: str, stop: int) -> tuple[list[float], list[str]]:
        """Best score of a path from start (after the piece left) to each place up to stop, and its last piece.

        One node a place is enough: unigram weights don't look back, and BPE has one path to a place. Of equal paths
        the one with the longest last piece is taken.
        """
        n = stop - start
        score, last = [NONE] * (n + 1), [""] * (n + 1)
        score[0], last[0] = 0.0, left
        for j in range(1, n + 1):
            for k in range(min(self.longest, j), 0, -1):
                if score[j - k] == NONE:
                    continue
                p = x[start + j - k : start + j]
                if p in self.id or k == 1:
                    v = score[j - k] + self.weight(last[j - k], p)
                    if v > score[j]:
                        score[j], last[j] = v, p
                        if self.bpe:
                            break
        return score, last

    def trace(self, last: list[str], j: int) -> list[str]:
        out = []
        while j > 0:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            elif self.bytes:
                out += [self.bytes[f"<0x{b:02X}>"] for b in p.encode()]
            else:
                out.append(self.unk_id)
        return out

    def whole(self, texts: pa.Array, limit: int = 50_000) -> pa.Array:
        """Ids of whole texts (none of them null) as little-endian unsigned 32-bit bytes.

        Arrow finds the distinct words and puts the ids of each place together. Words are kept in two generations of `limit`.
        """
        out = [b""] * len(texts)
        odd = pa.array([True] * len(texts))
        if self.by_word:  # runs of spaces make pieces of their own
            odd = functools.reduce(pc.or_, (pc.equal(texts, ""), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(at):
            found = self.library.encode(texts.take(pa.array(at)).to_pylist(), out_type=int, num_threads=1)
            for i, x in zip(at.tolist(), found, strict=True):
                out[i] = array("I", x).tobytes()
        if len(at) == len(texts):
            return pa.array(out, pa.binary())
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._words(words.dictionary.to_pylist(), limit), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2])
        if not len(at):
            return pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        for i, a, b in zip(plain.tolist(), ends, ends[1:], strict=False):
            out[i] = bytes(raw[a:b])
        return pa.array(out, pa.binary())

    def _words(self, distinct: list[str], limit: int) -> list[bytes]:
        words, older = self.words, self.older
        out = [words.get(w) for w in distinct]
        new = []
        for i, x in enumerate(out):
            if x is None:
                if (x := older.get(distinct[i])) is not None:
                    out[i] = words[distinct[i]] = x
                else:
                    new.append(i)
        for i, x in zip(new, self.library.encode([distinct[i] for i in new], out_type=int, num_threads=1) if new else [], strict=True):
            out[i] = array("I", x).tobytes()
            if len(distinct[i]) <= 64:
                words[distinct[i]] = out[i]
        if len(words) > limit:
            self.older, self.words = words, {}
        return out

    def texts(self, ids: list[bytes], parts: list[int]) -> list[bytes]:
        """UTF-8 of id lists, each piece's bytes one after another. A text's first space, the model's own, is taken off;
        lists with ids that have no text of their own, or bytes that are no UTF-8, go to the library."""
        if self.shown is None:
            back = {i: p for p, i in self.id.items()}
            raw = {i: bytes([int(p[3:5], 16)]) for p, i in self.bytes.items()}
            size = self.library.get_piece_size()
            self.odd = np.array([i not in back and i not in raw for i in range(size)])
            self.shown = pa.array([raw[i] if i in raw else back.get(i, "").replace(SPACE, " ").encode() for i in range(size)], pa.large_binary())
        flat = np.frombuffer(b"".join(ids), "<u4")
        got = self.shown.take(pa.array(flat))
        ends = np.frombuffer(got.buffers()[1], np.int64)
        ends = ends[np.append(0, np.cumsum([len(x) // 4 for x in ids]))].tolist() if len(flat) else [0] * (len(ids) + 1)
        data = got.buffers()[2].to_pybytes() if len(flat) and got.buffers()[2] else b""
        strange = np.append(0, np.cumsum(self.odd[flat]))
        out, at = [], 0
        for x, p, a, b in zip(ids, parts, ends, ends[1:], strict=False):
            n = len(x) // 4
            text = data[a + (not p and self.prefix and data[a : a + 1] == b" " and b > a) : b]
            if strange[at + n] > strange[at] or not _is_utf8(text):
                more = [self.id[SPACE]] if p and self.prefix and SPACE in self.id else []  # the library takes a leading space off
                text = self.library.decode(more + np.frombuffer(x, "<u4").tolist()).encode()
            out.append(text)
            at += n
        return out

    def runs(self, texts: list[str]) -> list[tuple[float, bytes]]:
        """Score and ids (as in whole()) of texts that lie between two cuts; short ones are kept."""
        new = list({t for t in texts if t not in self.kept})
        words = [t for t in new if t[0] == SPACE and len(t) > 1 and SPACE not in t[1:]] if self.bpe and self.prefix else []
        got = {t: (0.0, array("I", x).tobytes()) for t, x in zip(words, self.library.encode([t[1:] for t in words], out_type=int, num_threads=1) if words else [], strict=True)}
        for t in new:
            if t not in got:
                score, last = self.nodes(t, 0, "", len(t))
                got[t] = (score[-1], np.array(self.ids(self.trace(last, len(t))), "<u4").tobytes())
        out = [got[t] if t in got else self.kept[t] for t in texts]
        if len(self.kept) > 100_000:
            self.kept.clear()
        self.kept.update((t, v) for t, v in got.items() if len(t) <= 64)
        return out

    def cuts(self, x: str, start: int, stop: int) -> list[int]:
        """Places strictly between start and stop at which every path has a boundary: before words where there are
        some, else between any two characters that stand together in no piece."""
        if self.by_word:
            found = [i for i in (w.start() for w in _WORD.finditer(x, start + 1, stop)) if x[i - 1] != SPACE]
            if len(found) > 1:
                return found
        pairs = self.pairs
        return [i for i in range(start + 1, stop) if x[i - 1 : i + 1] not in pairs]

    def states(self, x: str, at: int) -> list[State]:
        """Pieces that match the text around a place inside it: from before it to it or beyond."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(x), start + self.longest) + 1):
                if x[start:end] in self.id or end == start + 1:
                    out.append((end - start, end - at))
        return out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def model(name: str) -> Model:
    with open(vocabulary(name), "rb") as f:
        return Model(f.read())


class Chunk:
    """One chunk: x holds context, body and context; the body is x[lo:hi]."""

    def __init__(self, m: Model, x: str, lo: int, hi: int, first: bool, last: bool):
        self.m, self.x, self.lo, self.hi = m, x, lo, hi
        self.entry = [(0, 0)] if first else m.states(x, lo)
        self.exit = [(0, 0)] if last else m.states(x, hi)
        inner = m.cuts(x, lo + m.longest, hi)
        self.inner = inner if len(inner) > 1 else []

    def _after(self, s: State) -> tuple[int, str]:
        """Where the entry state's piece ends, and the piece."""
        end = self.lo + s[1]
        return end, self.x[end - s[0] : end]

    def _exits(self, start: int, left: str) -> np.ndarray:
        score, last = self.m.nodes(self.x, start, left, self.hi)
        out = np.full(len(self.exit), NONE)
        for j, (size, over) in enumerate(self.exit):
            at = self.hi + over - size - start
            if size == 0:
                out[j] = score[self.hi - start]
            elif at >= 0 and score[at] > NONE:
                out[j] = score[at] + self.m.weight(last[at], self.x[start + at : start + at + size])
        return out

    def _inner_texts(self) -> list[str]:
        return [self.x[i:j] for i, j in zip(self.inner, self.inner[1:], strict=False)]

    def matrix(self) -> np.ndarray:
        if not self.inner:
            return np.array([self._exits(*self._after(s)) for s in self.entry])
        a, z = self.inner[0], self.inner[-1]
        into = np.array([self.m.nodes(self.x, *self._after(s), a)[0][-1] for s in self.entry])
        middle = 0.0 if self.m.bpe else sum(score for score, _ in self.m.runs(self._inner_texts()))
        return into[:, None] + (middle + self._exits(z, ""))[None, :]

    def ids(self, entry: int, exit: int) -> bytes:
        """Ids (as in Model.whole()) of the pieces after the entry state up to and with the exit state."""
        m, x = self.m, self.x
        start, left = self._after(self.entry[entry])
        size, over = self.exit[exit]
        end = self.hi + over - size
        raw = lambda pieces: np.array(m.ids(pieces), "<u4").tobytes()
        out = b""
        if self.inner:
            a, z = self.inner[0], self.inner[-1]
            out = raw(m.trace(m.nodes(x, start, left, a)[1], a - start)) + b"".join([ids for _, ids in m.runs(self._inner_texts())])
            start, left = z, ""
        out += raw(m.trace(m.nodes(x, start, left, end)[1], end - start))
        return out + (raw([x[end : end + size]]) if size else b"")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundaries(matrices: list[np.ndarray], entry: int, exit: int) -> list[int]:
    """The best state at each boundary, both ends included, between given states at the ends."""
    ahead = [np.where(np.arange(matrices[0].shape[0]) == entry, 0.0, NONE)]
    for t in matrices:
        ahead.append((ahead[-1][:, None] + t).max(axis=0))
    if ahead[-1][exit] == NONE:
        raise ValueError("no path between these states")
    out = [exit]
    for t, f in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        out.append(int(np.argmax(f + t[:, out[-1]])))
    return out[::-1]


# --- in Spark -----------------------------------------------------------------------------------------------------


def _whole(name: str, kind: str, chunk: int):
    """A row (doc_id, key, 0, 1, ids) per text of at most chunk characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, n = model(name), part_name(), 0
        for b in small_batches(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            at = np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) <= chunk)
            take = pa.array(at, pa.int64())
            k = len(at)
            cols = [pa.array([f"w-{task}-{n + i}" for i in at.tolist()], pa.string()), pa.array([0] * k, pa.int64()), pa.array([1] * k, pa.int64()), m.whole(texts.take(take))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), *cols], ["doc_id", "key", "part", "parts", "ids"])

    return run, f"doc_id {kind}, key string, part long, parts long, ids binary"


def _split(name: str, kind: str, chunk: int):
    """A row (doc_id, key, part, parts, x, lo, hi) per chunk of each text of over chunk characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, n = model(name), part_name(), 0
        for b in small_batches(batches, "text"):
            rows, at = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if len(t or "") <= chunk:
                    continue
                key, x = f"l-{task}-{n + i}", m.normal(t)
                parts = -(-len(x) // chunk)
                for p in range(parts):
                    lo, hi = p * chunk, min(len(x), (p + 1) * chunk)
                    a, z = max(0, lo - m.longest), min(len(x), hi + m.longest)
                    rows.append((key, p, parts, x[a:z], lo - a, hi - a))
                    at.append(i)
            n += b.num_rows
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cols], ["doc_id", "key", "part", "parts", "x", "lo", "hi"])

    return run, f"doc_id {kind}, key string, part long, parts long, x string, lo long, hi long"


def _chunk(m: Model, r: dict) -> Chunk:
    return Chunk(m, r["x"], r["lo"], r["hi"], r["part"] == 0, r["part"] == r["parts"] - 1)


def _matrices(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in batches:
            for r in b.to_pylist():
                t = _chunk(m, r).matrix()
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["part"]]), pa.array([len(t)]), pa.array([t.astype("<f8").tobytes()])], ["key", "part", "rows", "matrix"])

    return run, "key string, part long, rows long, matrix binary"


def _load(t: pa.Table, s: int, e: int) -> list[np.ndarray]:
    rows = t.column("rows").slice(s, e - s).to_pylist()
    return [np.frombuffer(x, "<f8").reshape(n, -1) for n, x in zip(rows, t.column("matrix").slice(s, e - s).to_pylist(), strict=True)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix per (key, grp), from those of its parts in order."""
    for t, at in runs(batches, ["key", "grp"]):
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            p = functools.reduce(times, _load(t, s, e))
            yield pa.RecordBatch.from_arrays([t.column("key").slice(s, 1).combine_chunks(), t.column("grp").slice(s, 1).combine_chunks(), pa.array([len(p)]), pa.array([p.tobytes()])], ["key", "grp", "rows", "matrix"])


def _along(keys: list[str], number: str):
    """(key, number, entry, exit) of each matrix of a run; the run's ends are the columns entry and exit, or state 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, keys):
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ends = [t.column(c)[s].as_py() if c in t.column_names else 0 for c in ("entry", "exit")]
                states = boundaries(_load(t, s, e), *ends)
                yield pa.RecordBatch.from_arrays([t.column("key").slice(s, e - s).combine_chunks(), t.column(number).slice(s, e - s).combine_chunks(), pa.array(states[:-1]), pa.array(states[1:])], ["key", number, "entry", "exit"])

    return run, f"key string, {number} long, entry long, exit long"


def _traced(name: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                ids = _chunk(m, r).ids(r["entry"], r["exit"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([r["key"]]), pa.array([r["part"]]), pa.array([r["parts"]]), pa.array([ids], pa.binary())], ["doc_id", "key", "part", "parts", "ids"])

    return run, f"doc_id {kind}, key string, part long, parts long, ids binary"


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(doc_id, key, part, parts, ids): little-endian unsigned 32-bit ids; key names the row, parts are in order.

    Longer texts have a row per chunk, so no task holds more than a chunk, and no id list grows with a document.
    """
    if chunk < 64:
        raise ValueError("chunks have to be longer than pieces")
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = docs.mapInArrow(*_whole(name, kind, chunk))  # a pass of its own: only chunks of long texts are written
    long = materialise(docs.where(F.length("text") > chunk).mapInArrow(*_split(name, kind, chunk)), "chunks")
    dealt = long.repartition(n, "key", "part")
    matrices = materialise(dealt.mapInArrow(*_matrices(name)).withColumn("grp", F.floor(F.col("part") / group)), "matrices")
    in_order = lambda df, keys, last: df.repartition(n, *keys).sortWithinPartitions(*keys, last)
    products = in_order(matrices, ["key", "grp"], "part").mapInArrow(_products, "key string, grp long, rows long, matrix binary")
    outer = in_order(products, ["key"], "grp").mapInArrow(*_along(["key"], "grp"))
    inner = in_order(matrices.join(outer, ["key", "grp"]), ["key", "grp"], "part").mapInArrow(*_along(["key", "grp"], "part"))
    states = materialise(inner, "states")
    traced = long.join(states, ["key", "part"]).select(*long.columns, "entry", "exit").mapInArrow(*_traced(name, kind))
    return whole.unionByName(traced)


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, key, part, text) of encode()'s rows; the texts of a key's parts, in order, make up its text.

    Parts may end inside a character's byte pieces in no case: a chunk's pieces are whole characters.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in small_batches(batches, "ids"):
            texts = m.texts(b.column("ids").to_pylist(), b.column("part").to_pylist())
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("part"), texts], ["doc_id", "key", "part", "text"])

    return encoded.select("doc_id", "key", "part", "ids").mapInArrow(run, f"doc_id {kind}, key string, part long, text string")


def digest(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, key, part, parts, n_ids, ids_crc32, text_sha256): of each part, with the SHA-256 of what it decodes to.

    key names the row, so that the parts of rows that share a doc_id, or have none, can be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in small_batches(batches, "ids"):
            raw = b.column("ids").to_pylist()
            shas = [hashlib.sha256(t).hexdigest() for t in m.texts(raw, b.column("part").to_pylist())]
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("part"), b.column("parts"), pa.array([len(x) // 4 for x in raw], long), pa.array([zlib.crc32(x) for x in raw], long), pa.array(shas, pa.string())], ["doc_id", "key", "part", "parts", "n_ids", "ids_crc32", "text_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, key string, part long, parts long, n_ids long, ids_crc32 long, text_sha256 string")
