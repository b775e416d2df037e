"""Near-duplicates by DartMinHash: sparse weighted signatures, banded joining, checked links, classes.

Every element of a weighted set spans a region: its weight wide and as high as ranks go. Darts are thrown into it by
hashing (a Poisson number of them in each unit of weight and each span of ranks), so equal elements get equal darts.
A dart that lies under the element's weight belongs to one of `k` coordinates; each coordinate keeps its earliest dart.
Two sets agree on a coordinate with the probability of their weighted Jaccard similarity. About k ln k darts serve a set
of any size: ranks are opened span by span until every coordinate has one.

Joining: texts that are equal are one node first. The nodes of a bucket (equal in a band) are compared by their signatures inside
tasks, a byte a coordinate; a bucket above `members` members is dealt over parts, and every two parts of it meet in a block of
their own, so all pairs of a bucket are compared. Pairs are never listed, a block gives out a spanning forest of its links:

1. Clear links. Members are visited from neighbour to neighbour, each compared with those that are not visited yet. These links
   make components.
2. Blocks that still hold several components name the members of pairs within `margin` of the threshold. The elements of
   their texts are sent to the block, which decides every such pair exactly unless the links found so far join it already. A pair
   of several buckets is decided in the first one only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm.common import blocks, bounded, components, cut, fresh, python_map, store, table, texts_of
from aligngrid.llm.shingles import mix, shingles

#: Five words a shingle and a Jaccard similarity of 0.8 make near-duplicates.
WIDTH, SIMILARITY = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Coordinates of a signature; the first BANDS * ROWS make the bands. An estimate at the threshold is off by more than the margin
#: with probability 4e-6.
COORDINATES, MARGIN = 320, 0.1
#: Members of a part of a bucket, and the elements of all of them (a longer text is a part of its own); a block compares one part, or two
#: parts with each other, so many members at once.
MEMBERS, ELEMENTS, ROWS_AT_ONCE = 2048, 1 << 22, 32
#: Bytes of text, and elements, that are worked on at once.
TEXT, BLOCK = 1 << 20, 1 << 18


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number, as far as a 53-bit uniform can reach."""
    p, total, k, out = np.exp(-mean), 0.0, 0, []
    while total < 1 - 2**-53 and k < 20 * mean + 60:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, set_of: np.ndarray, n_sets: int,
                    k: int) -> np.ndarray:
    """(n_sets, k) ranks of the earliest darts; infinite for sets without weight.

    weights: None counts every distinct element once (repeats throw the same darts).
    """
    signature = np.full(n_sets * k, np.inf)
    unit = lambda h: (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
    if weights is None:
        cell, room = np.zeros(len(elements), np.uint64), None
    else:
        some = weights > 0
        elements, weights, set_of = elements[some], weights[some], set_of[some]
        cells = np.ceil(weights).astype(np.int64)
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        elements, set_of = np.repeat(elements, cells), np.repeat(set_of, cells)
        room = np.repeat(weights, cells) - cell  # how much of the unit the element fills
        cell = cell.astype(np.uint64)
    seed = mix(elements ^ mix(cell))
    low, high, level = 0.0, 1.0, 0
    while len(seed):
        at = mix(seed + np.uint64(level))
        n = np.searchsorted(_poisson_steps(high - low), unit(mix(at ^ np.uint64(0x5851F42D4C957F2D))), side="right")
        total = np.cumsum(n)
        for a in range(0, len(seed), BLOCK):  # bounded memory when a few elements get many darts
            b = min(a + BLOCK, len(seed))
            count = n[a:b]
            number = np.arange(count.sum()) - np.repeat(total[a:b] - count - (total[a] - count[0]), count)
            dart = mix(np.repeat(at[a:b], count) + mix(number.astype(np.uint64)))
            rank = low + (high - low) * unit(dart)
            slot = np.repeat(set_of[a:b], count) * k + (mix(dart) % np.uint64(k)).astype(np.int64)
            if room is not None:
                hit = unit(mix(dart ^ np.uint64(0x2545F4914F6CDD1D))) < np.repeat(room[a:b], count)
                rank, slot = rank[hit], slot[hit]
            np.minimum.at(signature, slot, rank)
        short = np.isinf(signature.reshape(n_sets, k)).any(axis=1)[set_of]
        seed, set_of = seed[short], set_of[short]
        room = room[short] if room is not None else None
        low, high, level = high, high + min(high, 256.0), level + 1
    return signature.reshape(n_sets, k)


def elements(texts: list[bytes], width: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs (or 1) and the text of each."""
    ids, of = shingles(texts, width)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    times = np.diff(at, append=len(ids)) if weights == "count" else np.ones(len(at), np.int64)
    return ids[at], times, of[at]


def text_key(text: str) -> Column:
    """16 bytes that tell texts apart; null is an empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def signatures(df: DataFrame, id_col: str, text: str, *, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS,
               coordinates: int = COORDINATES, weights: str = "set") -> DataFrame:
    """(id, copy_key, n_elements, signature) of each row.

    signature: a byte of each coordinate's dart, null without words; the first bands * rows make the bands.
    weights: "set" counts each distinct shingle once, "count" as often as it occurs.
    """
    k = max(bands * rows, coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TEXT):
            texts = texts_of(block, "text")
            ids, times, of = elements(texts, width, weights)
            size = np.bincount(of, weights=times, minlength=len(texts)).astype(np.int64)
            sig = dart_signatures(ids, times.astype(np.float64) if weights == "count" else None, of, len(texts), k)
            short = (mix(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                block.column(0).cast(pa.int64()), block.column(1), pa.array(size),
                pa.array([s.tobytes() if n else None for s, n in zip(short, size)], pa.binary())],
                names=["id", "copy_key", "n_elements", "signature"])

    own = df.select(F.col(id_col).alias("id"), text_key(text).alias("copy_key"), F.col(text).alias("text"))
    return python_map(own, run, "id bigint, copy_key binary, n_elements bigint, signature binary")


def _alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of every signature of `one` with every one of `other`."""
    return (one[:, None, :] == other[None, :, :]).mean(axis=2, dtype=np.float32)


def clear_links(sig: np.ndarray, part: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the members that agree by more than `least`; part: members of one part are not compared here."""
    left, out = np.arange(len(sig)), [(np.zeros(0, np.int64),) * 2]
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            one, frontier = frontier[:ROWS_AT_ONCE], frontier[ROWS_AT_ONCE:]
            near = _alike(sig[one], sig[left]) > least
            if part is not None:
                near &= part[one][:, None] != part[left][None, :]
            hit = near.any(axis=0)
            out.append((one[near[:, hit].argmax(axis=0)], left[hit]))
            frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
    return tuple(np.concatenate(x) for x in zip(*out))


def open_pairs(sig: np.ndarray, part: np.ndarray | None, label: np.ndarray, band: int, bands: int, rows: int,
               least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of unlike labels that agree by `least` or more and share no band before `band`, some members at a time.

    Labels may change between two steps.
    """
    own = np.ascontiguousarray(sig[:, :bands * rows])
    for a in range(0, len(sig), ROWS_AT_ONCE):
        b = min(a + ROWS_AT_ONCE, len(sig))
        good = (label[a:b, None] != label[None, a:]) & (_alike(sig[a:b], sig[a:]) >= least)
        if part is not None:
            good &= part[a:b, None] != part[None, a:]
        i, j = np.nonzero(np.triu(good, 1))
        i, j = i + a, j + a
        first = (own[i] == own[j]).reshape(len(i), bands, rows).all(axis=2).argmax(axis=1) == band
        yield i[first], j[first]


def exact_links(sig, part, label, band, bands, rows, least, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of unlike labels among open pairs, decided on the sets of elements; label is changed as links join them."""
    size = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark, out = np.zeros(len(code) + 1, bool), []
    for i, j in open_pairs(sig, part, label, band, bands, rows, least):
        for k in np.unique(i):
            others = j[i == k]
            others = others[label[others] != label[k]]
            if not len(others):
                continue
            mine = code[start[k]:start[k] + size[k]]
            mark[mine] = True
            n = size[others]
            before = np.cumsum(n) - n
            both = np.add.reduceat(mark[code[np.repeat(start[others] - before, n) + np.arange(n.sum())]].astype(np.int64), before)
            mark[mine] = False
            for x in others[both / (size[k] + n - both) >= similarity]:
                if label[x] != label[k]:
                    out.append((k, x))
                    label[label == label[x]] = label[k]
    return out


def _each_block(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """What `work` makes of whole blocks, rows sorted by key, low and high: it gets a table and where its blocks begin and end."""
    held: list[pa.RecordBatch] = []

    def begins(rows: pa.Table) -> np.ndarray:
        at = [np.asarray(rows.column(c), np.int64) for c in ("key", "low", "high")]
        return np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        first = begins(rows)
        if len(first):  # the last block may go on in the next batch
            whole = rows.slice(0, int(first[-1]))
            yield work(whole, list(zip([0, *first[:-1]], first)))
            held = rows.slice(int(first[-1])).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield work(rows, [(0, rows.num_rows)])


def _signatures_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _parts(low: np.ndarray, high: np.ndarray, part: np.ndarray, a: int, b: int) -> np.ndarray | None:
    return None if low[a] == high[a] else part[a:b]


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(rows.column(n), np.int64) for n in names]


def _clear(least: float):
    """Rows of blocks -> (a, b): clear links."""
    def work(rows: pa.Table, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
        low, high, part, node = _numbers(rows, "low", "high", "part", "node")
        sig, out = _signatures_of(rows), [np.zeros((0, 2), np.int64)]
        for a, b in blocks:
            one, other = clear_links(sig[a:b], _parts(low, high, part, a, b), least)
            out.append(np.stack([node[a + one], node[a + other]], axis=1))
        links = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)  # what many buckets say is said once
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return lambda batches: _each_block(batches, work)


def _open(bands: int, rows_: int, least: float):
    """Rows of blocks -> those of members of open pairs."""
    def work(rows: pa.Table, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
        low, high, part, band, root = _numbers(rows, "low", "high", "part", "band", "root")
        sig, stay = _signatures_of(rows), np.zeros(rows.num_rows, bool)
        for a, b in blocks:
            if (root[a:b] != root[a]).any():
                for i, j in open_pairs(sig[a:b], _parts(low, high, part, a, b), root[a:b], band[a], bands, rows_, least):
                    stay[a + i] = stay[a + j] = True
        return rows.filter(pa.array(stay)).combine_chunks().to_batches(max_chunksize=rows.num_rows or 1)[0] if stay.any() else (
            pa.RecordBatch.from_arrays([pa.array([], f.type) for f in rows.schema], schema=rows.schema))

    return lambda batches: _each_block(batches, work)


def _exact(bands: int, rows_: int, least: float, similarity: float):
    """Rows of blocks with the elements of their texts -> (a, b): components that a link joins."""
    def work(rows: pa.Table, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
        low, high, part, band, root = _numbers(rows, "low", "high", "part", "band", "root")
        sig, out = _signatures_of(rows), [np.zeros((0, 2), np.int64)]
        lists = rows.column("elements")
        for a, b in blocks:
            sets = [np.asarray(x.values) for x in lists.slice(a, b - a)]
            found = exact_links(sig[a:b], _parts(low, high, part, a, b), root[a:b].copy(), band[a], bands, rows_, least, sets, similarity)
            if found:
                out.append(root[a + np.array(found)])
        links = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return lambda batches: _each_block(batches, work)


def _sets(docs: DataFrame, width: int, weights: str) -> DataFrame:
    """(node, elements) of (node, text) rows; with counts an element is a shingle and the number of its occurrence, so that the
    likeness of the sets is the weighted one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TEXT):
            ids, times, of = elements(texts_of(block, "text"), width, weights)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            flat = mix(np.repeat(ids, times) ^ mix(nth.astype(np.uint64)))
            ends = np.cumsum(np.bincount(of, weights=times, minlength=block.num_rows).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0), lists], names=["node", "elements"])

    return python_map(docs.select("node", "text"), run, "node bigint, elements array<bigint>")


def _dealt(buckets: DataFrame, *more: str) -> DataFrame:
    """Members in blocks: each goes to the block of its part with each part of its bucket."""
    other = buckets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    out = other.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node",
                       "signature", *more)
    return out.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")


def _classes(docs: DataFrame, width: int, similarity: float, bands: int, rows: int, coordinates: int, margin: float, members: int,
             weights: str) -> DataFrame:
    """(id, copy_key, copy_of, root, class_id) of every row of `docs` (id, text); root tells classes apart."""
    signed = store(signatures(docs, "id", "text", width=width, bands=bands, rows=rows, coordinates=coordinates, weights=weights),
                   "signatures")
    texts = signed.where("id is not null").groupBy("copy_key").agg(
        F.min("id").alias("copy_of"), F.first("n_elements").alias("n_elements"), F.first("signature").alias("signature"))
    texts = store(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    keys = F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(signature, b * {rows} + 1, {rows})))")
    banded = texts.where("signature is not null").select("node", "n_elements", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_elements").alias("e")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / members, F.col("e") / ELEMENTS)).cast("long")
    buckets = banded.join(shared.select("key", parts.alias("parts")), "key").select(
        "key", "band", "parts", F.pmod(F.xxhash64("node", "key"), "parts").alias("part"), "node")
    buckets = store(buckets.join(texts.select("node", "signature"), "node"), "buckets")
    clear = python_map(_dealt(buckets), _clear(similarity + margin), "a bigint, b bigint")
    clear = cut(clear.distinct())
    roots = cut(components(clear)) if not clear.isEmpty() else clear.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = buckets.select("key", "node").join(bounded(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    several = buckets.join(mixed, "key", "left_semi").join(bounded(roots), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    kept = "key bigint, low bigint, high bigint, part bigint, node bigint, signature binary, band int, root bigint"
    asked = store(python_map(_dealt(several, "band", "root"), _open(bands, rows, similarity - margin), kept), "asked")
    if not asked.isEmpty():
        which = cut(asked.select("node").distinct().join(texts.select("node", "copy_key", "copy_of"), "node"))
        found = docs.withColumn("copy_key", text_key("text")).join(
            bounded(which.withColumnRenamed("copy_of", "id")), ["copy_key", "id"])
        sets = _sets(found.dropDuplicates(["node"]), width, weights)
        ready = asked.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
        joins = python_map(ready, _exact(bands, rows, similarity - margin, similarity), "a bigint, b bigint")
        joins = cut(joins.distinct())
        if not joins.isEmpty():
            above = cut(components(joins))
            moved = bounded(above.select(F.col("node").alias("root"), F.col("root").alias("top")))
            higher = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = cut(higher.union(above.join(roots.select("node"), "node", "left_anti")))
    of = texts.select("copy_key", "copy_of", "node").join(bounded(roots), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    of = of.join(least, "root").select("copy_key", "copy_of", "root", "class_id")
    found = signed.select("id", "copy_key").join(of, "copy_key", "left")
    some = lambda c: F.when(F.col("id").isNotNull(), F.col(c)).alias(c)
    return found.select("id", "copy_key", some("copy_of"), some("root"), some("class_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, width: int = WIDTH,
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, coordinates: int = COORDINATES,
                    margin: float = MARGIN, members: int = MEMBERS, weights: str = "set") -> DataFrame:
    """(id_col, copy_of, class_id) of every row: the least id with an equal text, the least id of its class.

    Classes are the connected components of links: equal texts, and texts whose sets of `width`-word shingles have a
    Jaccard similarity of at least `similarity` (weights "count": whose shingles counted as often as they occur have it). Null is an
    empty text. Equal texts without words are copies of each other and have no other link. Rows of one id with other texts
    are documents of their own. Rows without an id keep null classes. A text is compared as a whole, however long it is. An
    empty table gives an empty result; further columns play no part.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = _classes(docs, width, similarity, bands, rows, coordinates, margin, members, weights)
    return found.select(F.col("id").alias(id_col), "copy_of", "class_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, width: int = WIDTH, similarity: float = SIMILARITY,
             bands: int = BANDS, rows: int = ROWS, coordinates: int = COORDINATES, margin: float = MARGIN, members: int = MEMBERS,
             weights: str = "set") -> DataFrame:
    """`df` with one row of each class of `near_duplicates`: the one of the least id, of its texts in the class the one of the least
    digest, and of rows that share both the one of the least digest of all columns. Rows without an id stay."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = store(_classes(docs, width, similarity, bands, rows, coordinates, margin, members, weights)
                    .where("id is not null").groupBy("root", "id", "copy_key").agg(F.count(F.lit(1)).alias("n")), "classes")
    best = classes.groupBy("root").agg(F.min(F.struct("id", "copy_key")).alias("best"))
    marked = classes.join(best, "root").withColumn("stays", F.struct("id", "copy_key") == F.col("best"))
    marked = cut(marked.where("not stays or n > 1").select("id", "copy_key", "stays"))
    name, one = fresh("_text", df), fresh("_one", df)
    own = df.withColumn(name, text_key(text))
    gone = marked.select(F.col("id").alias("_id"), F.col("copy_key").alias("_key"))
    same = (F.col(id_col) == F.col("_id")) & (F.col(name) == F.col("_key"))
    out = own.join(bounded(gone), same, "left_anti").select(*df.columns)
    repeated = marked.where("stays").select(F.col("id").alias("_id"), F.col("copy_key").alias("_key"))
    if repeated.isEmpty():
        return out
    again = own.join(bounded(repeated), same, "left_semi").groupBy(F.col(id_col).alias("_id"), name).agg(
        F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias(one))
    return out.union(again.select(*[F.col(one)[c].alias(c) for c in df.columns]))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_minhash": op10_minhash}
