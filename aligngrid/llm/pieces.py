"""SentencePiece encoding and decoding by matching the vocabulary against a suffix array.

A block of texts is normalised (spaces become the mark, one mark in front), cut before each mark, and every distinct
chunk that the worker has not met yet is laid into one array of characters: no piece reaches over a mark, so equal chunks have equal pieces. The
suffixes of that array are sorted as deep as the longest piece, each piece is searched by bisection (all at once), and the
occurrence ranges are the edges of the lattice. Edges are sorted by the place where they end and relaxed from left to right:

A place keeps the last piece of the encoding of the chunk up to there. With byte-pair models exactly one edge that ends
there follows the kept piece of its start: merging the two in the order of the vocabulary must not cross their
border. So the result equals that of repeated merging, for every place in one pass.

The model file is read on the driver and sent to the tasks (half a megabyte); nothing is shuffled.
"""

from __future__ import annotations

import pathlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from aligngrid.llm.common import blocks, python_map, table, texts_of

#: Default place of the model; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text in a block, and characters of new chunks that are indexed at once (a longer chunk is indexed alone).
BLOCK, INDEXED = 2 << 20, 250_000
#: So many chunks of earlier blocks are kept by a worker with their ids, then it starts anew.
KNOWN = 300_000
_MEMO_BITS = 21


class Pieces:
    """Tables of a byte-pair model with byte fallback. Pieces are numbered characters first, then by merge order."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        norm, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (
                norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only byte-pair models that keep the text as it is are supported")
        self.n_ids = len(model.pieces)
        normal = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        runs = {p for p in normal if p == MARK * len(p)}
        if any(MARK in p[1:] for p in normal if p not in runs) or any(
                normal[p][0] >= min(s for q, (s, _) in normal.items() if q not in runs and len(q) > 1)
                for p in runs if len(p) > 1):
            raise ValueError("a piece reaches over a mark")
        self.run_pieces = {len(p): normal[p][1] for p in runs}
        chars = sorted(p for p in normal if len(p) == 1)
        longer = sorted((p for p in normal if len(p) > 1 and p not in runs), key=lambda p: -normal[p][0])
        if any(c not in normal for p in longer for c in p):
            raise ValueError("a character of a piece is not a piece")
        number = {p: k for k, p in enumerate(chars)}
        left, right, kept = list(range(len(chars))), list(range(len(chars))), list(chars)
        merged = {}  # (left, right) -> number, as merging a piece alone arrives at it
        for p in longer:
            parts = self._merge([number[c] for c in p], merged)
            if len(parts) == 2 and tuple(parts) not in merged:
                number[p] = len(kept)
                merged[tuple(parts)] = len(kept)
                left.append(parts[0])
                right.append(parts[1])
                kept.append(p)
        self.size = len(kept)  # this number stands for a character without a piece
        self.left, self.right = np.array(left + [self.size], np.int64), np.array(right + [self.size], np.int64)
        keys = np.array([a * (self.size + 1) + b for a, b in merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(merged.values()), np.int64)[order]
        self.ids = np.array([normal[p][1] for p in kept], np.int32)
        self.length = np.array([len(p) for p in kept] + [1], np.int64)
        self.depth = int(self.length.max())
        self.byte_ids = np.array([next((i for i, p in enumerate(model.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>"),
                                       next(i for i, p in enumerate(model.pieces) if p.type == 2)) for b in range(256)],
                                 np.int32)
        self.symbol = np.full(0x110000, 0xFFFF, np.uint16)  # of a code point; 0 is the end of a chunk
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.spelled = np.zeros((self.size, self.depth), np.uint16)
        for k, p in enumerate(kept):
            self.spelled[k, :len(p)] = [number[c] + 1 for c in p]
        filled = np.where(np.arange(4) < self.length[:-1, None], self.spelled[:, :4], 0xFFFF)
        self.head_low, self.head_high = _packed(*self.spelled[:, :4].T), _packed(*filled.T)
        raw = [b""] * self.n_ids
        for i, p in enumerate(model.pieces):
            raw[i] = (bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else
                      " ⁇ ".encode() if p.type == 2 else p.piece.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo_ok = np.zeros(1 << _MEMO_BITS, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # chunks of earlier blocks (without their mark)
        self.known_ids, self.known_counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @staticmethod
    def _merge(parts: list[int], merged: dict) -> list[int]:
        """Merges `parts` in the order of the numbers, leftmost first, as far as it goes."""
        while True:
            best = min(((merged[x], k) for k, x in enumerate(zip(parts, parts[1:])) if x in merged), default=None)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [best[0]]

    @lru_cache(maxsize=4096)  # noqa: B019
    def run(self, n: int) -> np.ndarray:
        """Ids of n marks in a row: adjacent parts merge while a longer run is a piece, leftmost first."""
        parts = [1] * n
        while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.run_pieces), None)) is not None:
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return np.array([self.run_pieces[x] for x in parts], np.int32)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b."""
        key = a * (self.size + 1) + b
        slot = (key * np.int64(-7046029254386353131) >> (64 - _MEMO_BITS)) & ((1 << _MEMO_BITS) - 1)
        ok = self.memo_ok[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            todo, back = np.unique(key[miss], return_inverse=True)
            found = self._follows(todo // (self.size + 1), todo % (self.size + 1))
            ok[miss] = found[back]
            self.memo_key[slot[miss]], self.memo_ok[slot[miss]] = key[miss], ok[miss]
            # Two new keys of one slot: the last write of the key wins, and so must its answer.
            self.memo_ok[slot[miss]] = self._answer(todo, found, self.memo_key[slot[miss]])
        return ok

    @staticmethod
    def _answer(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return values[np.searchsorted(keys, wanted)]

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges next to the border, latest first; a pair that would have merged earlier crosses it."""
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        free = (a == self.size) | (b == self.size)
        out[free] = True
        at, a, b, limit = at[~free], a[~free], b[~free], limit[~free]
        while len(at):
            key = a * (self.size + 1) + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[k] == key) & (self.pair_to[k] < limit)
            at, a, b, limit = at[~crossed], a[~crossed], b[~crossed], limit[~crossed]
            down_a = a > b
            new_a, new_b = self.right[a], self.left[b]
            a_moves, b_moves = new_a != a, new_b != b
            use_a = np.where(down_a, a_moves, ~b_moves & a_moves)
            use_b = np.where(down_a, ~a_moves & b_moves, b_moves)
            out[at[~use_a & ~use_b]] = True
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, new_a, a), np.where(use_b, new_b, b)
            go = use_a | use_b
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out


_loaded: dict[int, Pieces] = {}


def _pieces(data: bytes) -> Pieces:
    """One per Python worker and model."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Pieces(data)
    return _loaded[key]


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Four 16-bit symbols as one number of the same order."""
    return (a.astype(np.uint64) << np.uint64(48) | b.astype(np.uint64) << np.uint64(32)
            | c.astype(np.uint64) << np.uint64(16) | d.astype(np.uint64))


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of 16-bit `symbols` (with `depth` zeros behind them) in the order of `depth` symbols, and the
    first four symbols of each as a number."""
    n = len(symbols) - depth
    key = _packed(*(symbols[i:n + i] for i in range(4)))
    sa = np.argsort(key, kind="stable")
    heads = key = key[sa]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(first, append=n)
    rank = np.zeros(n + 2 * depth, np.int64)
    rank[sa] = 1 + np.repeat(first, size)
    open_at, h = np.flatnonzero(np.repeat(size > 1, size)), 4
    while h < depth and len(open_at):
        at = sa[open_at]
        key = rank[at] * (n + 2) + rank[at + h]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_at] = at
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(first, append=len(at))
        rank[at] = 1 + np.repeat(open_at[first], size)
        open_at = open_at[np.repeat(size > 1, size)]
        h *= 2
    return sa, heads


def occurrences(pieces: Pieces, symbols: np.ndarray, sa: np.ndarray,
                heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that occur, and their ranges in the suffix array, by bisection of all pieces at once: by four symbols first, then
    symbol by symbol inside the range."""
    present = np.zeros(1 << 16, bool)
    present[symbols] = True
    ask = np.flatnonzero(present[pieces.spelled].all(axis=1))  # the filler 0 is always there
    low = np.searchsorted(heads, pieces.head_low[ask], side="left")
    high = np.searchsorted(heads, pieces.head_high[ask], side="right")
    some = high > low
    ask, low, high = ask[some], low[some], high[some]
    deep = np.flatnonzero(pieces.length[ask] > 4)
    spelled, length = pieces.spelled[ask[deep]].astype(np.int32), pieces.length[ask[deep]]
    places = np.arange(pieces.depth)
    inside = places < length[:, None]

    def bound(after: bool) -> np.ndarray:
        a, b = low[deep], high[deep]
        while (go := np.flatnonzero(a < b)).size:
            mid = (a[go] + b[go]) // 2
            gap = np.where(inside[go], symbols[sa[mid][:, None] + places].astype(np.int32) - spelled[go], 0)
            gap = gap[np.arange(len(go)), (gap != 0).argmax(axis=1)]
            right = gap <= 0 if after else gap < 0
            a[go[right]], b[go[~right]] = mid[right] + 1, mid[~right]
        return a

    low[deep], high[deep] = bound(False), bound(True)
    some = high > low
    return ask[some], low[some], high[some]


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_chunks(pieces: Pieces, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks (each begins with the mark) and how many each has."""
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
    points = np.frombuffer(("\x00".join(chunks) + "\x00").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    ends = starts + lengths - 1
    symbols = np.zeros(len(points) + pieces.depth + 4, np.uint16)
    symbols[:len(points)] = pieces.symbol[points]
    symbols[ends] = 0
    n = len(points)
    which, low, high = occurrences(pieces, symbols, *(found := sorted_suffixes(symbols[:n + pieces.depth], pieces.depth)))
    sa = found[0]
    count = high - low
    small = np.int32 if n < 1 << 30 else np.int64
    strange = np.flatnonzero(symbols[:n] == 0xFFFF)
    edge_piece = np.append(np.repeat(which.astype(np.int32), count), np.full(len(strange), pieces.size, np.int32))
    edge_start = np.append(sa.astype(small)[np.repeat(low, count) + _ramp(count)], strange.astype(small))
    chunk_start = np.repeat(starts.astype(small), lengths)
    size = pieces.length.astype(np.int32)[edge_piece]
    # Edges by the place in the chunk where they end, longer ones first.
    wave = (edge_start + size - chunk_start[edge_start]).astype(np.int64) * (pieces.depth + 1) + pieces.depth - size
    order = np.argsort(wave.astype(np.uint16) if wave.max(initial=0) < 1 << 16 else wave, kind="stable")
    edge_piece, edge_start, size, wave = (x[order] for x in (edge_piece, edge_start, size, wave))
    last = np.full(n + 1, -1, np.int64)  # the last piece of the encoding of the chunk up to a place
    step = np.flatnonzero(np.diff(wave, prepend=-1))
    for a, b in zip(step, [*step[1:], len(wave)]):
        s, t = edge_start[a:b].astype(np.int64), edge_piece[a:b].astype(np.int64)
        e = s + size[a:b]
        open_ = last[e] < 0  # a longer edge may have settled the place
        s, t, e = s[open_], t[open_], e[open_]
        at_start = s == chunk_start[s]
        ok = at_start.copy()
        inner = np.flatnonzero(~at_start)
        ok[inner] = pieces.follows(last[s[inner]], t[inner])
        last[e[ok]] = t[ok]
    # From the ends back: one piece of every unfinished chunk a round.
    number, place, piece, back = np.arange(len(chunks)), ends.copy(), [], []
    while len(number):
        t = last[place]
        place = place - pieces.length[t]
        piece.append((number, place.copy(), t))
        go = place > starts[number]
        number, place = number[go], place[go]
    number, place, t = (np.concatenate(x) for x in zip(*piece)) if piece else (np.zeros(0, np.int64),) * 3
    order = np.argsort(place, kind="stable")
    number, place, t = number[order], place[order], t[order]
    out = pieces.ids[np.minimum(t, pieces.size - 1)]
    times = np.ones(len(t), np.int64)
    odd = np.flatnonzero(t == pieces.size)
    if len(odd):  # characters without a piece are spelled in bytes
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[place[odd]]]
        times[odd] = [len(x) for x in raw]
        out = np.repeat(out, times)
        spell = np.repeat(t == pieces.size, times)
        out[spell] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.bincount(number, weights=times, minlength=len(chunks)).astype(np.int64)


def encode(pieces: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and how many each has. An empty text has none."""
    split = [t.decode("utf-8", "replace").replace(" ", MARK).split(MARK) if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    if len(pieces.known) > KNOWN:
        pieces.forget()
    number = pieces.known
    if new := [w for w in dict.fromkeys(flat) if w not in number]:
        number.update(zip(new, range(len(number), len(number) + len(new))))
        part = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 2) // INDEXED
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        made = [encode_chunks(pieces, [MARK + w for w in new[a:b]]) for a, b in zip(begin, [*begin[1:], len(new)])]
        pieces.known_ids = np.concatenate([pieces.known_ids, *(ids for ids, _ in made)])
        pieces.known_counts = np.concatenate([pieces.known_counts, *(n for _, n in made)])
    code = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    ids, n_ids = pieces.known_ids, pieces.known_counts
    first = np.cumsum(n_ids) - n_ids
    text_of = np.repeat(np.arange(len(texts)), counts)
    skip = np.zeros(len(code), np.int64)
    empty = number.get("", -1)
    alone = code == empty if empty >= 0 else np.zeros(len(code), bool)
    spaces: list[tuple[int, np.ndarray]] = []
    if alone.any():
        # Marks in a row: the empty chunks before a chunk, and its own mark if that stays alone.
        begin = np.flatnonzero(alone & ~np.concatenate([[False], alone[:-1] & (text_of[1:] == text_of[:-1])]))
        bound = np.flatnonzero(~alone | np.concatenate([text_of[1:] != text_of[:-1], [True]]))
        stop = bound[np.searchsorted(bound, begin)]
        mark = pieces.run_pieces[1]
        for a, b in zip(begin, stop):
            n = b - a
            if alone[b]:
                n += 1
            elif ids[first[code[b]]] == mark:
                n, skip[b] = n + 1, 1
            spaces.append((a, pieces.run(int(n))))
    take = n_ids[code] - skip
    take[alone] = 0
    pool = ids
    begin_at = first[code] + skip
    if spaces:
        at = np.array([a for a, _ in spaces])
        extra = [x for _, x in spaces]
        size = np.array([len(x) for x in extra])
        begin_at[at] = len(ids) + np.cumsum(size) - size
        take[at] = size
        pool = np.concatenate([ids, *extra])
    out = pool[np.repeat(begin_at, take) + _ramp(take)]
    return out, np.bincount(text_of, weights=take, minlength=len(texts)).astype(np.int64)


def _spelled(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """The bytes of each text."""
    size = pieces.raw_size[ids]
    raw = pieces.raw[np.repeat(pieces.raw_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
    a = 0
    for b in np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)].tolist():
        yield raw[a + (raw[a:a + 1] == b" "):b]
        a = b


def decode(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of ids; bytes that are no UTF-8 become the replacement character."""
    return [x.decode("utf-8", "replace") for x in _spelled(pieces, ids, counts)]


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [extra])


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", *, model: str = MODEL,
                 keep: list[str] | None = None, round_trip: str | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with `ids` (array of int), the pieces of the whole text.

    round_trip: names a further column, whether decoding the ids gives the text back (U+2581 comes back as a space).

    Null and empty texts have an empty array; equal rows get equal ids; a column already named `ids` is replaced; an
    empty table gives an empty result. A text is decoded and searched as a whole, however long it is.
    """
    stay = [c for c in (df.columns if keep is None else keep) if c not in (ids, round_trip)]
    own = df.select(*dict.fromkeys([*stay, text]))
    data = pathlib.Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(data)
        mark, space = MARK.encode(), b" "
        for block in blocks(batches, text, BLOCK):
            texts = texts_of(block, text)
            flat, counts = encode(pieces, texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [block.column(block.schema.get_field_index(c)) for c in stay]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
            if round_trip:
                columns.append(pa.array([x == t.replace(mark, space) for x, t in zip(_spelled(pieces, flat, counts), texts)]))
            yield pa.RecordBatch.from_arrays(columns, names=[*stay, ids, *([round_trip] if round_trip else [])])

    return python_map(own, run, _schema(own.select(*stay), f"`{ids}` array<int>" + (
        f", `{round_trip}` boolean" if round_trip else "")))


def decode_ids(df: DataFrame, ids: str = "ids", text: str = "decoded", *, model: str = MODEL) -> DataFrame:
    """`df` with the text of `ids`; null ids give an empty text. U+2581 in a text comes back as a space."""
    own = df.drop(text)
    data = pathlib.Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(data)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                block = batch.slice(a, 500)
                lists = block.column(block.schema.get_field_index(ids))
                counts = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
                flat = np.asarray(lists.flatten(), np.int64)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(decode(pieces, flat, counts), pa.string())],
                                                 names=[*block.schema.names, text])

    return python_map(own, run, _schema(own, f"`{text}` string"))


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding gives the text back."""
    out = encode_texts(docs, model=model, keep=["doc_id"], round_trip="round_trip")
    return out.selectExpr("doc_id", "size(ids) AS n_pieces", "ids", "round_trip")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pieces": op6_pieces}
