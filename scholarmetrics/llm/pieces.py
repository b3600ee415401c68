"""SentencePiece encoding and decoding by suffix-array matching (operator 6).

Spaces become the word mark, with one in front. No piece of the model holds a word mark
after another character, so a text falls apart into chunks (word marks, then other
characters) that are encoded on their own; each distinct chunk of a batch is encoded once.
The distinct chunks are concatenated; their suffixes are sorted; every piece of the model
is binary-searched in the suffix array, which gives the range of its occurrences; the
occurrences become edges (start, end, piece) sorted by end position, and the edges are
relaxed from left to right.

The model is a BPE model, for which a best-score path is not the right segmentation. The
relaxation therefore keeps, for every position, the one edge that BPE itself would end
there: an edge is taken if the piece before its start and its own piece form a pair that
BPE leaves unmerged. That is decided by undoing the merges of the two pieces from the last
to the first: if a merge across the border would have had priority over the merge undone
next, the pair cannot stand (equal priority: the left-most merge goes first). Results equal
the SentencePiece library's, which the tests check.

The model file is read on the driver (its path is a parameter) and its tables, bounded by
the vocabulary, are broadcast. Characters outside the vocabulary become byte pieces.

Defined results: null and empty texts have no ids and decode to the empty text. A word mark
character in a text decodes to a space, as in the library; all else round-trips exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbered, releasing, table

MARK = "▁"
BLOCK_CHARS = 120_000  # characters of distinct chunks that are indexed at a time
KNOWN_CHUNKS = 200_000  # distinct chunks whose ids a task remembers; then it starts anew
STEP = 1000  # texts encoded at a time
MEMO_BITS = 20  # entries of the table of pairs already decided: 2 ** MEMO_BITS
NEVER = np.int64(2**40)

_CHUNK = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _bpe_split(symbols: list[int], pair: dict[tuple[int, int], int], rank: np.ndarray, whole: int) -> tuple[int, int] | None:
    """The last merge by which BPE builds the piece ``whole`` from its characters, if it does."""
    symbols = list(symbols)
    while len(symbols) > 2:
        best = min(((rank[p], i, p) for i in range(len(symbols) - 1)
                    if (p := pair.get((symbols[i], symbols[i + 1]))) is not None and p != whole), default=None)
        if best is None:
            return None
        _, i, p = best
        symbols[i : i + 2] = [p]
    if len(symbols) == 2 and pair.get((symbols[0], symbols[1])) == whole:
        return symbols[0], symbols[1]
    return None


def model_tables(path: str) -> dict:
    """What the executors need of a SentencePiece BPE model with byte pieces, as plain arrays."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in plain}
    ident = {t: i for i, t in text.items()}
    if any(MARK in t.lstrip(MARK) for t in ident):
        raise ValueError("a piece holds a word mark after another character: chunks would not be independent")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    letters = sorted({c for t in ident for c in t})
    # every character is an atom: its own piece, or an id past the vocabulary
    atom = np.array([ident.get(c, size + k) for k, c in enumerate(letters)], np.int64)
    atom_of = dict(zip(letters, atom.tolist(), strict=True))
    rank = np.full(size + len(letters), -1, np.int64)  # -1: an atom, never merged
    order = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in plain if len(text[i]) > 1}))}
    for i in plain:
        if len(text[i]) > 1:
            rank[i] = order[-sp.get_score(i)]
    pair: dict[tuple[int, int], int] = {}
    for i in plain:
        t = text[i]
        for cut in range(1, len(t)):
            a, b = t[:cut], t[cut:]
            left = atom_of[a] if len(a) == 1 else ident.get(a)
            right = atom_of[b] if len(b) == 1 else ident.get(b)
            if left is not None and right is not None:
                pair[(left, right)] = i
    left, right = np.full(len(rank), -1, np.int64), np.full(len(rank), -1, np.int64)
    usable = []
    for i in plain:
        if len(text[i]) == 1:
            usable.append(i)
        elif (split := _bpe_split([atom_of[c] for c in text[i]], pair, rank, i)) is not None:
            left[i], right[i] = split
            usable.append(i)
    longest = max(map(len, ident), default=1)
    spelled = np.full((len(usable), longest), -1, np.int32)
    at = {c: k for k, c in enumerate(letters)}
    for row, i in enumerate(usable):
        spelled[row, : len(text[i])] = [at[c] for c in text[i]]
    keys = np.array([a * len(rank) + b for a, b in pair], np.int64)
    by = np.argsort(keys)
    bigrams = {at[a] * len(letters) + at[b] for t in ident for a, b in zip(t, t[1:])}
    out_bytes = [b""] * size
    for i in plain:
        out_bytes[i] = text[i].replace(MARK, " ").encode()
    for b in range(256):
        out_bytes[byte_ids[b]] = bytes([b])
    return {
        "letters": np.array([ord(c) for c in letters], np.uint32), "atom": atom, "rank": rank, "left": left, "right": right,
        "pairs": keys[by], "merged": np.array(list(pair.values()), np.int64)[by], "size": size, "byte_ids": byte_ids,
        "bigrams": np.array(sorted(bigrams), np.int64), "bytes": out_bytes, "usable": np.array(usable, np.int64),
        "spelled": spelled, "lengths": (spelled >= 0).sum(1),
    }


class _Encoder:
    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.memo_key = np.full(1 << MEMO_BITS, -1, np.int64)
        self.memo_ok = np.zeros(1 << MEMO_BITS, bool)
        self.forget()

    # -- which neighbouring pieces BPE leaves side by side ---------------------
    def _cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Priority of the merge of a and b, NEVER if they don't merge."""
        key = a * len(self.rank) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[self.merged[at]], NEVER)

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit, after_right = np.full(len(a), NEVER), np.zeros(len(a), bool)
        while len(live):
            c = self._cross(a, b)
            bad = (c < limit) | ((c == limit) & after_right & (c < NEVER))
            ok[live[bad]] = False
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            after_right = self.rank[b] >= self.rank[a]
            limit = np.where(after_right, self.rank[b], self.rank[a])
            a, b = np.where(after_right, a, self.right[a]), np.where(after_right, self.left[b], b)
        return ok

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair (a, b) stands; a < 0: nothing before b."""
        key = a * np.int64(len(self.rank)) + b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
        ok = self.memo_ok[slot]
        new = (self.memo_key[slot] != key) & (a >= 0)
        if new.any():
            u, back = np.unique(key[new], return_inverse=True)
            got = self._decide(u // len(self.rank), u % len(self.rank))
            ok[new] = got[back]
            s = ((u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
            self.memo_key[s] = u
            # two keys of one slot: the last one written holds it
            holds = self.memo_key[s] == u
            self.memo_ok[s[holds]] = got[holds]
        return ok | (a < 0)

    # -- one block of distinct chunks ---------------------------------------------
    def _edges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of a piece in ``x`` (letter indexes, -1 elsewhere)."""
        used = np.unique(x[x >= 0])
        local = np.zeros(len(self.letters) + 1, np.int64)
        local[used] = np.arange(1, len(used) + 1)
        y = local[x]  # 0 for anything that is in no piece (index -1 is the last entry)
        bits = max(int(len(used)).bit_length(), 1)
        depth = 63 // bits
        padded = np.concatenate([y, np.zeros(max(depth, self.spelled.shape[1]), np.int64)])
        key = np.zeros(len(y), np.int64)
        for d in range(depth):
            key = (key << bits) | padded[d : d + len(y)]
        order = np.argsort(key)
        ranked = key[order]
        here = (local[self.spelled] > 0) | (self.spelled < 0)
        here = here.all(1)
        spelled, lengths, ids = local[self.spelled[here]], self.lengths[here], self.usable[here]
        spelled[self.spelled[here] < 0] = 0
        low = np.zeros(len(ids), np.int64)
        for d in range(depth):
            low = (low << bits) | (spelled[:, d] if d < spelled.shape[1] else 0)
        free = np.maximum(depth - lengths, 0) * bits
        high = low | ((np.int64(1) << free) - 1)
        lo, hi = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(ids)), n)
        start = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.empty(0, np.int64)
        length = lengths[which]
        # pieces longer than the sorted depth: the rest is compared
        fits = np.ones(len(which), bool)
        for d in range(depth, spelled.shape[1]):
            far = np.flatnonzero(length > d)
            if not len(far):
                break
            fits[far] &= padded[start[far] + d] == spelled[which[far], d]
        return start[fits], length[fits], ids[which[fits]]

    def block(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks one after the other, and the number of ids of each."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.where(codes == 32, np.uint32(ord(MARK)), codes)
        n = len(codes)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        x = np.where(self.letters[at] == codes, at, -1)
        # segments: no piece crosses the border of a chunk, or two letters that no piece has side by side
        first = np.zeros(n, bool)
        first[np.cumsum(sizes)[:-1]] = True
        first[0] = True
        chunk = np.cumsum(first, dtype=np.int32) - 1
        big = x[:-1] * np.int64(len(self.letters)) + x[1:]
        spot = np.minimum(np.searchsorted(self.bigrams, big), len(self.bigrams) - 1)
        first[1:] |= (self.bigrams[spot] != big) | (x[:-1] < 0) | (x[1:] < 0)
        seg = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # start of each position's segment
        # separators between segments keep pieces from matching across
        gap = np.cumsum(first) - 1
        spaced = np.full(n + int(gap[-1]) + 1, -1, np.int64)
        spaced[np.arange(n) + gap] = x
        back = np.full(len(spaced), -1, np.int64)
        back[np.arange(n) + gap] = np.arange(n)
        start, length, piece = self._edges(spaced)
        start = back[start]
        end = start + length
        # atoms that are no piece themselves (edges to an id past the vocabulary)
        lone = np.flatnonzero((x >= 0) & (self.atom[np.maximum(x, 0)] >= self.size))
        if len(lone):
            start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
            piece = np.concatenate([piece, self.atom[x[lone]]])
        offset = end - seg[start]  # where in its segment an edge ends
        narrow = offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset
        by = np.argsort(narrow, kind="stable")  # by position in the segment (a radix sort for 16 bits)
        start, end, piece, offset = start[by], end[by], piece[by], offset[by]
        last, origin = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(offset)) + 1, [len(offset)]]) if len(offset) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = np.where(s == seg[s], -1, last[s])
            reached = (s == seg[s]) | (before >= 0)
            good = reached & self._stand(before, p)
            last[e[good]], origin[e[good]] = p[good], s[good]
        unknown = np.flatnonzero(x < 0)
        last[unknown + 1], origin[unknown + 1] = -2, unknown
        # walk all segments back at once and mark the ends of the edges on their paths
        mark = np.zeros(n + 1, bool)
        ends = np.concatenate([np.flatnonzero(first)[1:], [n]])
        begin = seg[ends - 1]
        while len(ends):
            mark[ends] = True
            ends = origin[ends]
            go = ends > begin
            ends, begin = ends[go], begin[go]
        path = np.flatnonzero(mark)
        ids, chunk_of = last[path], chunk[path - 1]
        raw = (ids == -2) | (ids >= self.size)
        if raw.any():  # characters without a piece: their UTF-8 bytes
            spell = [list(chr(c).encode("utf-8", "surrogatepass")) for c in codes[path[raw] - 1].tolist()]
            width = np.ones(len(ids), np.int64)
            width[raw] = [len(v) for v in spell]
            out = np.repeat(ids, width)
            out[np.repeat(raw, width)] = self.byte_ids[np.array([b for v in spell for b in v])]
            ids, chunk_of = out, np.repeat(chunk_of, width)
        return ids.astype(np.int32), np.bincount(chunk_of, minlength=len(chunks))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text. Chunks met before are not encoded again."""
        if len(self.number) > KNOWN_CHUNKS:
            self.forget()
        known, find = len(self.number), self.number.__getitem__
        uses = [
            np.fromiter(map(find, _CHUNK.findall(" " + t.replace(MARK, " "))), np.int32) if t else np.empty(0, np.int32)
            for t in texts
        ]
        chunks, size = [], 0
        for c in islice(self.number, known, None):
            chunks.append(c)
            size += len(c)
            if size >= BLOCK_CHARS:
                self._remember(*self.block(chunks))
                chunks, size = [], 0
        if chunks:
            self._remember(*self.block(chunks))
        use = np.concatenate([np.empty(0, np.int32), *uses])
        width = self.counts[use]
        done = np.concatenate([[0], np.cumsum(width)])
        gather = np.repeat(self.starts[use] - done[:-1], width) + np.arange(done[-1])
        edge = np.concatenate([[0], np.cumsum([len(u) for u in uses], dtype=np.int64)]).astype(np.int64)
        return self.flat[gather], np.diff(done[edge])

    def forget(self) -> None:
        self.number = Numbered()
        self.flat, self.counts, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _remember(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids, n = enc.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n.astype(np.int64))],
                                                 names=["_row", "ids", "n_tokens"])

    return run


def _decoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(model.value["bytes"], pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                lists = part.column(0).field("ids")
                flat = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32)),
                    pieces.take(pc.list_flatten(lists)))
                joined = pc.binary_join(flat, b"")
                texts = [v[1:].decode("utf-8", "replace") if v else "" for v in joined.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_row", "decoded"])

    return run


def _kept(df: DataFrame, keep: list[str]):
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")


def encode(docs: DataFrame, keep: list[str] | None = None, model_path: str | None = None) -> DataFrame:
    """(_row: struct of the ``keep`` columns, all by default; ids: array<int>; n_tokens)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model_tables(model_path or default_model()))
    rows = docs.select(_kept(docs, docs.columns if keep is None else keep), F.col("text").alias("_text"))
    return rows.mapInArrow(releasing(_encoder(model)), f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>, n_tokens long")


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """(_row: struct of all columns; decoded) of a table with ``ids``."""
    spark = tokens.sparkSession
    model = spark.sparkContext.broadcast(model_tables(model_path or default_model()))
    rows = tokens.select(_kept(tokens, tokens.columns))
    return rows.mapInArrow(releasing(_decoder(model)), f"_row {rows.schema['_row'].dataType.simpleString()}, decoded string")


def encoded(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the ids decode to the text, compared by hash) of every document."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(" "))
    rows = docs.select("doc_id", "text", F.xxhash64(text).alias("check"))
    e = encode(rows, keep=["doc_id", "check"], model_path=model_path)
    d = decode(e.select("_row.*", "ids", "n_tokens"), model_path=model_path)
    return d.select("_row.doc_id", "_row.ids", "_row.n_tokens", (F.xxhash64("decoded") == F.col("_row.check")).alias("round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
