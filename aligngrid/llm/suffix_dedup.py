"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier, over all documents.

Shards are made by content, so that equal strings of WINDOW bytes always meet. Of the k-byte grams in a window the one with the
least hash is its anchor; consecutive windows with one anchor form a run, and the bytes of the run's windows are its record.
Equal windows have equal anchors, so only runs whose anchor occurs twice matter. Equal records (same anchor, same bytes by a
64-bit digest) are pre-aggregated: inside a block of documents first, then over all; every copy but the first is
removed whole. Where an anchor has several records, their bytes go to the shard of the anchor.

A shard builds the suffix array of its records by induced sorting: suffixes are classified, the leftmost-smaller (LMS) substrings
are sorted and named, equal names are resolved by recursion on the string of names, and the array is induced from them
bucket by bucket. Permuted common prefixes with the suffix before give the groups of equal windows; all but the first of
a group are removed. Each shard works through its records in batches of whole anchors.

An anchor with more than `hot` records (the edge of a passage that very many documents share) would be a large batch: its
windows are sent one by one to the shards of their own digests instead, copies inside a block left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm.common import blocks, python_map, store, table, texts_of
from aligngrid.llm.toolcalls import positions

#: Bytes of a string that counts, and of the grams that anchor it.
WINDOW, GRAM = 100, 32
GRAMS = WINDOW - GRAM + 1
#: Bytes of documents that are read as a block, and of records that are sorted at once.
BLOCK, BATCH = 4 << 20, 768 << 10
#: Windows that are looked at together.
TILE = 1 << 16
#: An anchor with more records than this is split by window.
HOT = 20_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


# --- runs of windows with one anchor -------------------------------------------------------------------------------


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place (but the last 7), as numbers of their lexicographic order."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for s in range(min(8, max(n, 0))):
        count = (len(data) - s) // 8
        out[s::8] = np.frombuffer(data, ">u8", count=count, offset=s)[:len(out[s::8])]
    return out


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each window in `data`, and the hash of the gram at each place."""
    x = eights(data)
    n = len(data) - GRAM + 1
    gram = x[:n] * _M1
    for k in range(8, GRAM, 8):
        gram ^= gram >> np.uint64(29)
        gram += x[k:k + n]
        gram *= _M2
    gram ^= gram >> np.uint64(32)
    gram *= _M3
    # The place in the low half makes the leftmost of equal grams the least.
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), gram


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows of the runs in `data` (documents side by side), their numbers of windows, and anchor numbers of 40 bits."""
    none = np.zeros(0, np.int64)
    windows = len(data) - WINDOW + 1
    if windows < 1:
        return none, none, none
    begins = np.zeros(windows + 1, np.int8)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= WINDOW
    np.add.at(begins, starts[long], 1)
    np.add.at(begins, np.minimum(ends[long] - WINDOW + 1, windows), -1)
    firsts, lasts, hashes = [], [], []
    open_anchor = -1  # of the run that reaches into the next tile
    inside = 0
    for a in range(0, windows, TILE):  # a tile fits the cache
        part = data[a:a + TILE + WINDOW - 1]
        anchor, gram = _anchors(part)
        valid = np.cumsum(begins[a:a + len(anchor)]) + inside > 0
        inside = int(valid[-1])
        at_first = valid.copy()
        at_first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        if open_anchor >= 0:
            goes_on = bool(valid[0]) and begins[a] <= 0 and anchor[0] + a == open_anchor
            at_first[0] &= not goes_on
            if not goes_on:
                lasts.append(np.array([a - 1]))
        at_last = valid.copy()
        at_last[:-1] &= ~valid[1:] | at_first[1:]
        first, last = np.flatnonzero(at_first), np.flatnonzero(at_last)
        open_anchor = int(anchor[-1]) + a if valid[-1] else -1
        if open_anchor >= 0:
            last = last[:-1]
        firsts.append(first + a)
        lasts.append(last + a)
        hashes.append((gram[anchor[first]] >> np.uint64(24)).astype(np.int64))
    if open_anchor >= 0:
        lasts.append(np.array([windows - 1]))
    at = np.concatenate(firsts)
    return at, np.concatenate(lasts) - at + 1, np.concatenate(hashes)


def _joined(block: pa.RecordBatch, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    texts = texts_of(block, text)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return b"".join(texts), ends, np.asarray(block.column("id"), np.int64)


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k) for each anchor of a block: 2 if it occurs more than once there."""
    for block in blocks(batches, "text", BLOCK):
        raw, ends, _ = _joined(block, "text")
        h, k = np.unique(runs(np.frombuffer(raw, np.uint8), ends)[2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(k, 2).astype(np.int8))], names=["h", "k"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, id, at, n) of each run: its anchor, digest, first window and number of windows.

    Runs that have an earlier copy in the block are joined with their neighbours; they have no c, and an h of their own that spreads
    them.
    """
    for block in blocks(batches, "text", BLOCK):
        raw, ends, ids = _joined(block, "text")
        at, n, h = runs(np.frombuffer(raw, np.uint8), ends)
        doc = np.searchsorted(ends, at, side="right")
        begin = np.concatenate([[0], ends[:-1]])[doc]
        digest = xxhash.xxh3_64_intdigest
        c = np.fromiter((digest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + WINDOW - 1).tolist())), np.uint64,
                        len(at)).view(np.int64)
        place, ident = at - begin, ids[doc]
        order = np.lexsort((place, ident, h, c))
        new = np.ones(len(at), bool)
        new[1:] = (c[order[1:]] != c[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        first = np.zeros(len(at), bool)
        first[order[new]] = True
        dup = np.zeros(len(at), bool)  # a repeat of the very row is neither
        dup[order] = ~new & ((ident[order] != ident[lead]) | (place[order] != place[lead]))
        joined = dup[1:] & dup[:-1] & (at[1:] == at[:-1] + n[:-1])
        head = np.flatnonzero(dup & ~np.append(False, joined))
        tail = np.flatnonzero(dup & ~np.append(joined, False))
        spread = ((ident[head] * 31 + place[head]) & 0xFFFFFFFF) - (1 << 40)  # no anchor is below 0
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([h[first], spread])),
            pa.array(np.concatenate([c[first], np.zeros(len(head), np.int64)]), mask=np.arange(first.sum() + len(head)) >= first.sum()),
            pa.array(np.concatenate([ident[first], ident[head]])), pa.array(np.concatenate([place[first], place[head]])),
            pa.array(np.concatenate([n[first], at[tail] + n[tail] - at[head]]))], names=["h", "c", "id", "at", "n"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, at, record) of the asked runs of each document; of hot ones window by window, a null record for a copy."""
    for block in blocks(batches, "text", BLOCK):
        seen: dict[int, tuple[int, int]] = {}
        key, ident, at, record = [], [], [], []
        order = np.argsort(np.asarray(block.column("id"), np.int64), kind="stable")
        asked = block.column("asked").to_pylist()
        texts, ids = texts_of(block, "text"), block.column("id").to_pylist()
        for i in order.tolist():
            for r in sorted(asked[i] or [], key=lambda r: r["at"]):
                p, n = r["at"], r["n"]
                whole = texts[i][p:p + n + WINDOW - 1]
                for q, size in [(0, n)] if not r["hot"] else [(q, 1) for q in range(n)]:
                    part = whole[q:q + size + WINDOW - 1]
                    name, again = r["h"], False
                    if r["hot"]:
                        name = xxhash.xxh3_64_intdigest(part) >> 1
                        here = (ids[i], p + q)
                        again = seen.setdefault(name, here) != here
                    key.append(name)
                    ident.append(ids[i])
                    at.append(p + q)
                    record.append(None if again else part)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ident, pa.int64()), pa.array(at, pa.int64()),
                                          pa.array(record, pa.binary())], names=["key", "id", "at", "record"])


# --- induced sorting ------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next); the last symbol is the unique least one."""
    rises = np.append(t[:-1] < t[1:], True)
    decided = np.append(t[:-1] != t[1:], True)
    at = np.where(decided, np.arange(len(t)), len(t) - 1)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _segment_ranks(code: np.ndarray, bits: int, starts: np.ndarray, ends: np.ndarray, tie: np.ndarray | None) -> np.ndarray:
    """Dense ranks of the code segments [start, end], none of which begins another; equal ones by `tie`, if given."""
    per = 64 // bits
    m = len(starts)
    wide = np.append(code, np.zeros(per, code.dtype)).astype(np.uint64)
    packed = wide[:len(code)].copy()  # of each place and the next ones
    for k in range(1, per):
        packed <<= np.uint64(bits)
        packed |= wide[k:k + len(code)]
    rank = np.zeros(m, np.int64)
    open_, offset = np.arange(m), 0
    while len(open_):
        left = ends[open_] - starts[open_] + 1 - offset
        beyond = (bits * np.maximum(per - left, 0)).astype(np.uint64)  # bits of what lies behind the segment
        key = packed[starts[open_] + offset] >> beyond << beyond
        order = np.argsort(key, kind="stable") if not offset else np.lexsort((key, rank[open_]))
        offset += per
        r, k_ = rank[open_][order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (k_[1:] != k_[:-1])
        # Ranks are places: the first of a group of equals stands for it.
        group = np.ones(len(order), bool)
        group[1:] = r[1:] != r[:-1]
        place = np.arange(len(order))
        base = np.maximum.accumulate(np.where(group, place, 0))
        lead = np.maximum.accumulate(np.where(new, place, 0))
        rank[open_[order]] = r + lead - base
        size = np.diff(np.flatnonzero(new), append=len(order))
        more = np.repeat(size > 1, size) & (left[order] > per)
        open_ = open_[order[more]]
    if tie is not None:
        order = np.lexsort((tie, rank))
        rank[order] = np.arange(m)
        return rank
    order = np.argsort(rank, kind="stable")
    dense = np.empty(m, np.int64)
    dense[order] = np.cumsum(np.diff(rank[order], prepend=rank[order[0]]) != 0)
    return dense


def _induced(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of `t` from its sorted LMS suffixes: L-type suffixes bucket by bucket upwards, S-type ones downwards.

    A bucket is worked through in waves: what its entries put into it themselves is the next wave.
    """
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    stop = np.cumsum(count)
    start = stop - count
    sa = np.full(n, -1, np.int64)

    def put(items: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends items, in their order, to the buckets of their symbols."""
        symbol = t[items]
        order = np.argsort(symbol.astype(np.uint16), kind="stable")
        symbol, items = symbol[order], items[order]
        head = np.flatnonzero(np.diff(symbol, prepend=-1))
        size = np.diff(head, append=len(items))
        inside = np.arange(len(items)) - np.repeat(head, size)
        sa[at[symbol] + step * inside] = items
        at[symbol[head]] += step * size

    lms_symbol = t[lms]
    lms_start = np.searchsorted(lms_symbol, np.arange(sigma + 1))
    used = np.flatnonzero(count)
    head = start.copy()
    for c in used:
        done = start[c]
        while done < head[c]:
            items = sa[done:head[c]]
            done = head[c]
            before = items[items > 0] - 1
            before = before[~s_type[before]]
            if len(before):
                put(before, head, 1)
        items = lms[lms_start[c]:lms_start[c + 1]]
        before = items[items > 0] - 1
        if len(before):  # what precedes an LMS suffix is of type L
            put(before, head, 1)
    tail = stop - 1
    for c in used[::-1]:
        done = stop[c] - 1
        while done > tail[c]:
            items = sa[tail[c] + 1:done + 1][::-1]
            done = tail[c]
            before = items[items > 0] - 1
            before = before[s_type[before]]
            if len(before):
                put(before, tail, -1)
        items = sa[start[c]:head[c]][::-1]
        before = items[items > 0] - 1
        before = before[s_type[before]]
        if len(before):
            put(before, tail, -1)
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of the symbols `t` below `sigma`; the last one must be 0 and occur nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    bits = max(int(2 * sigma).bit_length(), 1)
    code = 2 * t + s_type
    ends = np.append(lms[1:], n - 1)
    name = _segment_ranks(code, bits, lms, ends, None)
    if name.max() + 1 < len(lms):
        order = suffix_array(name, int(name.max()) + 1)
    else:
        order = np.empty(len(lms), np.int64)
        order[name] = np.arange(len(lms))
    if sigma <= 1 << 10:
        return _induced(t, s_type, lms[order], sigma)
    # A large alphabet has no buckets worth a loop: a suffix is its symbols up to the next LMS suffix and the rank of that.
    rank = np.empty(len(lms), np.int64)
    rank[order] = np.arange(len(lms))
    after = np.minimum(np.searchsorted(lms, np.arange(n), side="right"), len(lms) - 1)
    place = _segment_ranks(code, bits, np.arange(n), lms[after] + (np.arange(n) == n - 1) * (n - 1 - lms[after]), rank[after])
    sa = np.empty(n, np.int64)
    sa[place] = np.arange(n)
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, wanted: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: of the suffix at each wanted place with the one before it in `sa`, up to `limit`; 0 elsewhere.

    data: bytes with at least `limit` + 8 bytes behind the last suffix that can match.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    x = eights(data)
    plcp = np.zeros(n, np.int64)
    open_ = np.flatnonzero((phi >= 0) & wanted)
    at = 0
    while len(open_) and at < limit:
        here, there = open_ + at, phi[open_] + at
        gap = x[here] ^ x[there]
        same = gap == 0
        # Numbers are big-endian: the bytes before the first difference are leading zeros.
        odd = open_[~same]
        g = gap[~same]
        lead = np.zeros(len(g), np.int64)
        for k in range(1, 8):
            lead += g < (np.uint64(1) << np.uint64(64 - 8 * k))
        plcp[odd] = np.minimum(at + lead, limit)
        open_ = open_[same]
        at += 8
    plcp[open_] = limit
    return plcp


def repeated_windows(records: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of the windows whose string also starts in an earlier record (by `order`) or earlier in this one."""
    size = np.fromiter(map(len, records), np.int64, len(records))
    raw = np.frombuffer(b"\x00".join(records) + b"\x00" * (WINDOW + 24), np.uint8)
    n = int(size.sum()) + len(records)
    starts = np.cumsum(size + 1) - size - 1
    t = raw[:n].astype(np.int64) + 2
    t[starts + size] = 1
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    record = np.repeat(np.arange(len(records)), size + 1)
    offset = np.arange(n) - starts[record]
    # A separator is a zero byte in `raw`, so only strings that end inside their record may count.
    whole = offset <= size[record] - WINDOW
    sa = sa[1:]  # the sentinel alone is before all
    plcp = common_prefixes(raw, sa, WINDOW, whole)
    joined = plcp[sa] >= WINDOW
    joined[1:] &= whole[sa[:-1]]
    joined[0] = False
    group = np.cumsum(~joined)
    member = joined | np.append(joined[1:], False)
    at = sa[member]
    group = group[member]
    priority = order[record[at]] * 128 + offset[at]
    head = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(priority, head) if len(head) else priority
    gone = priority != np.repeat(least, np.diff(head, append=len(group)))
    return record[at[gone]], offset[at[gone]]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, n) of removed windows, from records sorted by key; whole keys are sorted together."""
    held: list[tuple[int, int, int, bytes]] = []
    held_bytes = 0
    known: list[tuple[int, int]] = []  # single windows that have an earlier copy in their block

    def flush():
        ids = np.array([x[1] for x in held], np.int64)
        at = np.array([x[2] for x in held], np.int64)
        place = np.lexsort((at, ids))
        order = np.empty(len(held), np.int64)
        # Rows of one place (repeated documents) share their order, so none precedes the other.
        order[place] = np.cumsum((np.diff(ids[place], prepend=ids[place[0]] - 1) != 0) | (np.diff(at[place], prepend=-1) != 0))
        record, offset = repeated_windows([x[3] for x in held], order)
        where = np.lexsort((offset, record))
        record, offset = record[where], offset[where]
        first = np.ones(len(record), bool)
        first[1:] = (record[1:] != record[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(first)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[record[head]]), pa.array(at[record[head]] + offset[head]),
             pa.array(np.diff(head, append=len(record)))], names=["id", "at", "n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "at", "record"))):
            if row[3] is None:
                known.append(row[1:3])
                continue
            if held_bytes > BATCH and row[0] != held[-1][0]:
                yield flush()
                held, held_bytes = [], 0
            held.append(row)
            held_bytes += len(row[3])
        if known:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*known)),
                                              pa.array([1] * len(known), pa.int64())], names=["id", "at", "n"])
            known = []
    if held:
        yield flush()


# --- the operator ---------------------------------------------------------------------------------------------------


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kept, n_bytes, n_removed, n_spans) of each document and its marks (struct<at, n>: first windows and their number)."""
    for block in blocks(batches, "text", BLOCK):
        texts, marks = texts_of(block, "text"), block.column("marks").to_pylist()
        kept, removed, spans = [], [], []
        for t, ms in zip(texts, marks):
            out, end, gone, n_spans = [], 0, 0, 0
            for m in sorted((m["at"], m["at"] + m["n"] + WINDOW - 1) for m in ms or []):
                if m[0] > end or not n_spans:
                    out.append(t[end:m[0]])
                    n_spans += 1
                    gone += m[1] - m[0]
                    end = m[1]
                elif m[1] > end:
                    gone += m[1] - end
                    end = m[1]
            out.append(t[end:])
            kept.append(b"".join(out))
            removed.append(gone)
            spans.append(n_spans)
        columns = [block.column(i) for i, f in enumerate(block.schema.names) if f not in ("text", "marks")]
        names = [f for f in block.schema.names if f not in ("text", "marks")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(kept, pa.binary()), pa.array(list(map(len, texts)), pa.int64()),
             pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
            names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, hot: int = HOT) -> DataFrame:
    """(id_col, kept binary, n_bytes, n_removed, n_spans) of every row: its bytes that no earlier string of WINDOW covers.

    Earlier is a smaller id, or an earlier start in one document. Null is an empty text. Rows that share id and text are one
    document and get one result each; texts of one id follow in the order of their hash, null ids come first. An empty
    table gives an empty result; further columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = docs.select("doc_id", F.xxhash64("text").alias("th"))
    odd = names.groupBy("doc_id").agg((F.min("th") != F.max("th")).alias("many")).where("many or doc_id is null")
    if odd.isEmpty():
        docs = docs.select("doc_id", F.col("doc_id").alias("id"), "text")
    else:  # numbers of the distinct documents in their order take the place of ids
        ranked = positions(names.distinct().withColumn("all", F.lit(0)), ["all"], [F.col("doc_id").asc_nulls_first(), F.col("th")],
                           "id")
        ranked = store(ranked.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "id"), "numbers")
        docs = docs.join(ranked, docs.doc_id.eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")))
        docs = docs.select("doc_id", "id", "text")
    bodies = docs.select("id", "text")
    counts = python_map(bodies, _anchor_counts, "h bigint, k tinyint").groupBy("h").agg(F.sum("k").alias("k"))
    rows = python_map(bodies, _anchor_rows, "h bigint, c bigint, id bigint, at bigint, n bigint")
    often = counts.where("k > 1").select("h", F.lit(True).alias("often"))
    found = store(rows.join(often, "h", "left").where("often or c is null").drop("often"), "anchors")
    # At most one row of a record for each block of documents: a hot record is a row a block.
    this = F.struct("id", "at")
    near = found.where("c is not null").withColumn("first", F.min(this).over(Window.partitionBy("h", "c")))
    near = store(near.select("h", "id", "at", "n", (this == F.col("first")).alias("is_first")), "runs")
    firsts = near.where("is_first").select("h", "id", "at", "n").distinct()
    mixed = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("records")).where("records > 1")
    asked = firsts.join(mixed, "h").groupBy("id").agg(F.collect_list(F.struct("h", "at", "n", (F.col("records") > hot).alias(
        "hot"))).alias("asked"))
    # Both joins below read one shuffle of the texts; a left join keeps it free of filters.
    with_asked = docs.join(asked.hint("shuffle_hash"), "id", "left").select("doc_id", "id", "text", "asked")
    made = python_map(with_asked, _records, "key bigint, id bigint, at bigint, record binary")
    fresh = python_map(made.repartition("key").sortWithinPartitions("key"), _shard, "id bigint, at bigint, n bigint")
    marks = (found.where("c is null").select("id", "at", "n").union(near.where("not is_first").select("id", "at", "n"))
             .union(fresh))
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    return python_map(docs.join(marks.hint("shuffle_hash"), "id", "left").select(
        F.col("doc_id").alias(id_col), "text", "marks"), _cleaned,
        f"`{id_col}` bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, by its digest."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
