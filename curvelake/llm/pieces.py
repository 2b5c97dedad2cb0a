"""SentencePiece encoding with a BPE model as a max-plus parallel scan over chunks, and decoding.

The model merges, of all neighbouring symbols whose concatenation is a piece, those with the highest score, the leftmost
at equal scores, until none are left; a character without a piece becomes its bytes. Pieces are the merges' result if and
only if that holds for each two neighbours by themselves: merges inside a piece don't depend on what lies around it, and
the first merge across a boundary would happen between the two neighbours alone as well. So a text's encoding is the one
path without a penalty in a lattice of pieces, where two neighbours that don't stand together cost minus infinity.

A long text is cut into chunks of PART characters, wherever that is, which are rows of their own. The states of a
boundary are the pieces that may cover or end at it. A chunk's transfer matrix has, for each state at its front and each
at its end, the score of the best path between them. Matrices are made in parallel and multiplied (max, +) in groups of
FAN, round by round, up to one for the text; the same groups then hand each chunk the states at which the text's path
enters and leaves it, and each chunk is traced by itself. A place that no merge can cross (no piece has its two characters as
neighbours) splits a chunk: what lies between its first and its last such place doesn't depend on the states and is
encoded along with the matrix, word by word with a memo. A text of one chunk has no boundary and is encoded at once.

Nulls are the empty text. Rows are encoded one by one, so repeated rows and ids don't matter. An empty table gives an
empty table. Extra columns are ignored. Very long texts, words without any blank among them, are dealt out like others.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common, tokens

BLANK = "▁"
#: Characters of a chunk, matrices multiplied in one group, symbols from which on a heap finds the next merge, and chunks
#: of one text that a task hands on at a time.
PART, FAN, MANY, ROWS = 1 << 14, 16, 32, 64
#: Characters of long texts in one task, and bytes of the words that a worker remembers.
TASK, MEMO = 4 << 20, 64 << 20
NEVER = -np.inf
COLUMNS = "doc_id long, n_tokens long, ids_crc32 long, n_chunks long, text_crc32 long"
CHUNKS = "row long, doc_id long, n long, matrix binary, wide int, enter array<int>, leave array<int>, head string, middle binary, tail string, size int"


class Pieces:
    """Pieces and scores of a BPE model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        spec = (norm.add_dummy_prefix, norm.escape_whitespaces, norm.remove_extra_whitespaces, norm.precompiled_charsmap, model.trainer_spec.treat_whitespace_as_suffix)
        if model.trainer_spec.model_type != 2 or kinds & {4, 5} or 6 not in kinds or spec != (True, True, False, b"", False):
            raise ValueError("only BPE models with byte pieces, without user-defined or unused pieces and without normalisation")
        self.text = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {t: model.pieces[i].score for t, i in self.id.items()}
        self.as_byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = {b: i for i, b in self.as_byte.items()}
        self.longest = max(map(len, self.id))
        self.inside = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        self.across = any(BLANK in t.lstrip(BLANK) for t in self.id)  # pieces with a blank sign after another character
        self.high = np.zeros(len(self.text), bool)
        self.high[[i for i, b in self.as_byte.items() if b >= 128]] = True
        self.shown = [chr(self.as_byte[i]) if self.as_byte.get(i, 128) < 128 else t.replace(BLANK, " ") for i, t in enumerate(self.text)]
        self.word = tokens.Memo(lambda w: self.ids(BLANK + w), MEMO)
        self.stretch = tokens.Memo(self.ids, MEMO // 4)
        self.pair = tokens.Memo(lambda k: b"1" if self.merged(k.replace("\n", "", 1)) == k.split("\n", 1) else b"", MEMO // 4)
        self.single = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when no merge is."""
        if len(text) >= MANY:
            return self.heap_merged(text)
        s, score = list(text), self.score.get
        values = [score(a + b, NEVER) for a, b in zip(s, s[1:], strict=False)]
        while values and (best := max(values)) != NEVER:
            i = values.index(best)
            s[i] += s.pop(i + 1)
            values.pop(i)
            if i:
                values[i - 1] = score(s[i - 1] + s[i], NEVER)
            if i < len(values):
                values[i] = score(s[i] + s[i + 1], NEVER)
        return s

    def heap_merged(self, text: str) -> list[str]:
        s, n, score = list(text), len(text), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-v, i, i + 1, s[i] + s[i + 1]) for i in range(n - 1) if (v := score(s[i] + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not s[i] or not s[j] or after[i] != j or s[i] + s[j] != both:  # one of them has merged meanwhile
                continue
            s[i], s[j], after[i] = both, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (v := score(s[a] + s[b])) is not None:
                    heapq.heappush(heap, (-v, a, b, s[a] + s[b]))
        return [x for x in s if x]

    def ids(self, text: str) -> bytes:
        symbols, number = self.merged(text), self.id.get
        out = [number(x, -1) for x in symbols]
        if min(out, default=0) < 0:
            out = [i for x, n in zip(symbols, out, strict=True) for i in ([n] if n >= 0 else [self.byte[b] for b in x.encode()])]
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a stretch of prepared text, word by word unless pieces may cross blank signs."""
        if self.across:
            return self.ids(text)
        if 2 * BLANK in text or text[:1] != BLANK or text[-1:] == BLANK:
            return b"".join(map(self.stretch.__getitem__, re.split(f"(?<=[^{BLANK}])(?={BLANK})", text)))
        return b"".join(map(self.word.__getitem__, text[1:].split(BLANK)))

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text as it is. Where single blanks are all that lies between words, the words are its parts already."""
        if not text:
            return b""
        if self.across or "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
            return self.encode(prepared(text))
        return b"".join(map(self.word.__getitem__, text.split(" ")))

    def stands(self, t: str) -> bool:
        """Whether a stretch can be a piece of an encoding (a single character always can)."""
        if len(t) == 1:
            return True
        if t not in self.id:
            return False
        if t not in self.single:
            self.single[t] = self.merged(t) == [t]
        return self.single[t]

    def follows(self, t: str, u: str) -> bool:
        """Whether two pieces stand together; after nothing (or a place that no merge crosses), any piece does."""
        return not t or t[-1] + u[0] not in self.inside or bool(self.pair[f"{t}\n{u}"])

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Begin and end of each piece that may cover the place ``at`` or end there; one state at the text's front and end."""
        if at in (0, len(text)):
            return [(0, at)]
        begins = range(max(0, at - self.longest), at)
        return [(s, e) for s in begins for e in range(at, min(len(text), s + self.longest) + 1) if self.stands(text[s:e])]

    def free(self, text: str, p: int, q: int) -> tuple[int, int] | None:
        """The first and the last place in p..q-1 that no merge crosses, if there is one."""
        first = next((j for j in range(max(p, 1), q) if text[j - 1 : j + 1] not in self.inside), None)
        return None if first is None else (first, next(j for j in range(q - 1, first - 1, -1) if text[j - 1 : j + 1] not in self.inside))

    def matrix(self, text: str, p: int, q: int) -> np.ndarray:
        """The transfer matrix of the chunk text[p:q]: states at p x states at q. ``text`` has its surroundings, of the
        longest piece's length. Paths from all states run together, each as a bit; they soon meet."""
        enter, leave = self.states(text, p), self.states(text, q)
        ways: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))  # place: last piece: states that lead there
        out: dict[tuple[int, int], int] = defaultdict(int)
        for i, (s, e) in enumerate(enter):
            if e >= q:
                out[(0, q) if q == len(text) else (s, e)] |= 1 << i
            else:
                ways[e][text[s:e]] |= 1 << i
        cut, j = self.free(text, p, q), p
        while j < q:
            if cut and j == cut[0] < cut[1]:
                alive = 0
                for mask in ways[j].values():
                    alive |= mask
                j = cut[1]
                ways[j][""] = alive
            if here := ways.pop(j, None):
                for k in range(j + 1, min(len(text), j + self.longest) + 1):
                    piece = text[j:k]
                    if self.stands(piece):
                        mask = 0
                        for t, m in here.items():
                            if self.follows(t, piece):
                                mask |= m
                        if mask and k >= q:
                            out[(0, q) if q == len(text) else (j, k)] |= mask
                        elif mask:
                            ways[k][piece] |= mask
            j += 1
        reached = np.array([[out.get(x, 0) >> i & 1 for x in leave] for i in range(len(enter))], bool)
        return np.where(reached, 0.0, NEVER).astype(np.float32)

    def chunk(self, text: str, p: int, q: int) -> tuple:
        """The columns of CHUNKS from ``matrix`` on: the states' ends as seen from the chunk's ends, the stretches whose
        encoding depends on the states (``size``: where the chunk ends in the last of them), and the ids between them."""
        m = self.matrix(text, p, q)
        enter, leave = [e - p for _, e in self.states(text, p)], [e - q for _, e in self.states(text, q)]
        cut = self.free(text, p, q)
        parts = (text[p : cut[0]], self.encode(text[cut[0] : cut[1]]), text[cut[1] :], q - cut[1]) if cut else (text[p:], b"", None, q - p)
        return m.astype("<f4").tobytes(), m.shape[1], enter, leave, *parts

    def traced(self, head: str, tail: str | None, size: int, enter: int, leave: int) -> tuple[bytes, bytes]:
        """Ids of a chunk before and after its middle, from the place where the path enters it to where it leaves it."""
        if tail is None:
            return self.encode(head[enter : max(enter, size + leave)]), b""
        return self.encode(head[enter:]), self.encode(tail[: size + leave])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined to characters, blank signs as blanks, without the first."""
        if not self.high[ids].any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))[1:]
        out, held = [], bytearray()
        for i in ids.tolist():
            if i in self.as_byte:
                held.append(self.as_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ")[1:]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def doors(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states at the boundaries of consecutive chunks on the best path from state ``enter`` to state ``leave``."""
    ahead = [matrices[0][enter]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out = [leave]
    for i in range(len(matrices) - 1, 0, -1):
        out.append(int(np.argmax(ahead[i - 1] + matrices[i][:, out[-1]])))
    return [enter, *out[::-1]]


def pieces(path: str) -> Pieces:
    return common.held(("pieces", path), lambda: Pieces(path))


def prepared(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def digest(m: Pieces, doc_ids: pa.Array, ids: list[bytes], n_chunks: pa.Array) -> pa.RecordBatch:
    rows = [np.frombuffer(x, "<u4") for x in ids]
    text = [zlib.crc32(m.decode(x).encode()) for x in rows]
    cols = [doc_ids, pa.array([len(x) for x in rows], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), n_chunks, pa.array(text, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in COLUMNS.split(", ")])


def unpacked(matrix: list[bytes], wide: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(m, "<f4").reshape(-1, w) for m, w in zip(matrix, wide, strict=True)]


def scan(matrices: DataFrame, most: int) -> DataFrame:
    """row, n, enter, leave: the states at which each text's path enters and leaves its chunks. ``matrices``: row, n,
    matrix, wide; ``most``: chunks of the longest text. Groups of FAN are multiplied until each text has one matrix."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for group in b.column("own").to_pylist():
                own = unpacked([x["matrix"] for x in group], [x["wide"] for x in group])
                while len(own) > 1:
                    own = [multiply(*own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
                made.append(own[0])
            cols = [pa.array([m.tobytes() for m in made], pa.binary()), pa.array([m.shape[1] for m in made], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), *cols], ["row", "n", "matrix", "wide"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, group, enter, leave in zip(*(b.column(c).to_pylist() for c in ("row", "own", "enter", "leave")), strict=True):
                path = doors(unpacked([x["matrix"] for x in group], [x["wide"] for x in group]), enter, leave)
                rows += [(row, x["n"], i, j) for x, i, j in zip(group, path, path[1:], strict=False)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "n", "enter", "leave"])

    levels, height = [], most
    while height > 1:
        group = F.floor(F.col("n") / FAN).alias("g")
        own = F.array_sort(F.collect_list(F.struct("n", "matrix", "wide"))).alias("own")  # FAN at most
        levels.append(matrices.groupBy("row", group).agg(own))
        up = levels[-1].select("row", F.col("g").alias("n"), "own").mapInArrow(product, "row long, n long, matrix binary, wide int")
        matrices, height = common.materialize(up, "products"), -(-height // FAN)
    path = matrices.select("row", "n", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for level in levels[::-1]:
        above = path.select(F.col("row").alias("row_"), F.col("n").alias("g_"), "enter", "leave")
        both = level.join(above, (F.col("row") == F.col("row_")) & (F.col("g") == F.col("g_"))).select("row", "own", "enter", "leave")
        path = common.materialize(both.mapInArrow(down, "row long, n long, enter int, leave int"), "doors")
    return path


def sentencepiece(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), n_chunks (rows that the text was cut into),
    text_crc32 (of the text that the ids decode to: the document's, but that blank signs have become blanks)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for b in batches:
            for b in common.pieces(b, "text"):
                yield digest(m, b.column("doc_id"), [m.encode_whole(t) for t in b.column("text").to_pylist()], pa.array([1] * b.num_rows, pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(path).longest
        for b in batches:
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                text = prepared(text)
                begins = range(0, len(text), part)
                for i in range(0, len(begins), ROWS):
                    own = begins[i : i + ROWS]
                    from_ = [max(0, p - reach) for p in own]
                    cols = [pa.array([row] * len(own), pa.int64()), pa.array([doc] * len(own), pa.int64()), pa.array(range(i, i + len(own)), pa.int64())]
                    cols += [pa.array([p - f for p, f in zip(own, from_, strict=True)], pa.int32()), pa.array([min(p + part, len(text)) - f for p, f in zip(own, from_, strict=True)], pa.int32())]
                    cols += [pa.array([text[f : p + part + reach] for p, f in zip(own, from_, strict=True)], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "p", "q", "text"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary(), pa.string(), pa.int32()]
        for b in batches:
            for b in common.pieces(b, "text"):
                made = [m.chunk(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "p", "q")), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n"), *cols], [c.split()[0] for c in CHUNKS.split(", ")])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for b in batches:
            made = [m.traced(*x) for x in zip(*(b.column(c).to_pylist() for c in ("head", "tail", "size", "enter", "leave")), strict=True)]
            for place in (0, 1):
                cols = [pa.array([2 * place] * b.num_rows, pa.int32()), pa.array([x[place] for x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n"), *cols], ["row", "doc_id", "n", "place", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for b in batches:
            yield digest(m, b.column("doc_id"), [b"".join(x) for x in b.column("ids").to_pylist()], b.column("n_chunks"))

    short = F.char_length("text") < part  # with the blank sign before it, one chunk
    total = base.where(~short).agg(F.sum(F.char_length("text"))).first()[0]
    at_once = base.where(short).mapInArrow(whole, COLUMNS)
    if not total:
        return at_once
    tasks = total // TASK + 1
    long = base.where(~short).withColumn("row", F.monotonically_increasing_id())
    dealt = long.mapInArrow(cut, "row long, doc_id long, n long, p int, q int, text string").repartition(tasks, "row", "n")
    chunks = common.materialize(dealt.mapInArrow(matrices, CHUNKS), "chunks")
    found = scan(chunks.select("row", "n", "matrix", "wide"), chunks.agg(F.max("n")).first()[0] + 1)
    found = found.select(F.col("row").alias("row_"), F.col("n").alias("n_"), F.col("enter").alias("i"), F.col("leave").alias("j"))
    ends = chunks.select("row", "doc_id", "n", "enter", "leave", "head", "tail", "size").join(found, (F.col("row") == F.col("row_")) & (F.col("n") == F.col("n_")))
    ends = ends.select("row", "doc_id", "n", "head", "tail", "size", F.get("enter", F.col("i")).alias("enter"), F.get("leave", F.col("j")).alias("leave"))
    middles = chunks.select("row", "doc_id", "n", F.lit(1).alias("place"), F.col("middle").alias("ids"))
    rows = ends.mapInArrow(trace, "row long, doc_id long, n long, place int, ids binary").union(middles).repartition(tasks, "row", "doc_id")
    joined = rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "place", "ids"))).alias("x"), (F.max("n") + 1).alias("n_chunks"))
    joined = joined.select("doc_id", F.col("x.ids").alias("ids"), "n_chunks")
    return at_once.union(joined.mapInArrow(join, COLUMNS))
