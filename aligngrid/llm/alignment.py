"""Alignment of the tokens of two tokenizers over the same bytes.

Each block of texts is encoded by both tokenizers. Tokens are rows (document, first byte), and two as-of joins by document find,
for the start of each token, the token of the other side that covers it: the last one that starts there or before. Two tokens
overlap exactly if one of them covers the start of the other, so the union of both directions is all overlapping pairs. Bytes
where tokens of both sides end cut a text into groups.

How many documents of the whole corpus hold a pair of ids is counted from the distinct pairs of each document. These counts
grow with the vocabularies, not with the corpus; up to `sent` of them go to every task, more are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm import tokens
from aligngrid.llm.common import blocks, bounded, python_map, store, table
from aligngrid.session import cut

SIDE_A, SIDE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at once; rows (two numbers and a mark) of the counts of pairs that are sent to every task.
TEXT, SENT = 1 << 20, 4_000_000


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs (places of a, of b). Starts ascend over all documents, and both sides of a document fill the same
    bytes."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a})
    b = pd.DataFrame({"at": start_b, "doc": doc_b})
    over_a = pd.merge_asof(a, b.assign(other=np.arange(len(b)), other_at=start_b), on="at", by="doc")
    over_b = pd.merge_asof(b, a.assign(other=np.arange(len(a)), other_at=start_a), on="at", by="doc")
    new = (over_b["other_at"] != over_b["at"]).to_numpy()  # equal starts are met in both directions
    return (np.concatenate([np.arange(len(a)), over_b["other"].to_numpy(np.int64)[new]]),
            np.concatenate([over_a["other"].to_numpy(np.int64), np.flatnonzero(new)]))


@lru_cache(maxsize=8)
def _numerals(size: int, sign: str) -> np.ndarray:
    """Each id below `size` in decimal and the sign after it, filled up with zero bytes."""
    return np.array([f"{i}{sign}".encode() for i in range(size)])


def _group_texts(ids: tuple[np.ndarray, ...], groups: tuple[np.ndarray, ...], sizes: tuple[int, ...], n_groups: int,
                 upto: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;...` of each document; the groups of both sides, and how many there are up to the end of each document."""
    count = [np.bincount(g, minlength=n_groups) for g in groups]
    before = (np.cumsum(count[1]) - count[1], np.cumsum(count[0]))  # of the other side
    out = np.zeros(sum(map(len, ids)), f"S{max(len(str(n)) for n in sizes) + 1}")
    for side, sign in ((0, "|"), (1, ";")):
        text = _numerals(sizes[side], ",")[ids[side]]
        last = np.cumsum(count[side]) - 1
        text[last] = _numerals(sizes[side], sign)[ids[side][last]]
        out[np.arange(len(text)) + before[side][groups[side]]] = text
    cuts = np.concatenate([[0], np.cumsum(count[0] + count[1])])[np.concatenate([[0], upto])]
    return [out[a:b].tobytes().translate(None, b"\0")[:-1] for a, b in zip(cuts, cuts[1:])]


def align_block(texts: list[str], encoder: tokens.Encoder) -> dict:
    """Tokens, links and groups of each text, with a space in front; a text that a side doesn't give back has none."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    sides = []
    for side, (ids, counts) in zip(encoder.sides, encoder.encode(texts, " ")):
        ends = np.cumsum(counts)
        size = np.cumsum(np.concatenate([[0], side.size[ids]]))[np.concatenate([[0], ends])]
        spelled = side.spelled(ids)
        same = np.array([spelled[a:b] == t for a, b, t in zip(size, size[1:], raw)], bool)
        sides.append((side, ids, counts, same))
    whole = sides[0][3] & sides[1][3]
    out = {}
    for name, (side, ids, counts, _) in zip("ab", sides):
        stay = np.repeat(whole, counts)
        ids, counts = ids[stay].astype(np.int64), np.where(whole, counts, 0)
        end = np.cumsum(side.size[ids])
        out[name] = (ids, counts, np.repeat(np.arange(len(texts)), counts), end - side.size[ids], end)
    (ids_a, n_a, doc_a, start_a, end_a), (ids_b, n_b, doc_b, start_b, end_b) = out["a"], out["b"]
    link_a, link_b = overlaps(doc_a, start_a, doc_b, start_b)
    common_a, common_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    if len(end_a):
        other = np.searchsorted(end_b, end_a)  # ends ascend over all documents, and both sides end together
        common_a = end_b[other] == end_a
        common_b[other[common_a]] = True
    groups = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    n_groups = np.bincount(doc_a[common_a], minlength=len(texts))
    return {"ids_a": ids_a, "ids_b": ids_b, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "doc": doc_a[link_a], "link_a": link_a,
            "link_b": link_b, "groups": _group_texts((ids_a, ids_b), groups, tuple(len(x.size) for x in encoder.sides), int(common_a.sum()),
                                                    np.cumsum(n_groups))}


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def aligned(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """(row, id_col, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row, stored.

    groups: `a1,a2|b1;a3|b2,b3` as SHA-256 (lowercase hex, '' without tokens); pairs: distinct linked ids, a * 2^32 + b, ascending;
    times: how often each occurs. row tells rows apart. Null and empty texts, and texts that a tokenizer doesn't give back,
    have no tokens. Rows are aligned one by one, so repeated rows and ids have rows of their own; further columns play no part.
    """
    data = tokens.read(side_a), tokens.read(side_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(data)
        for block in blocks(batches, "text", TEXT):
            got = align_block(block.column(1).to_pylist(), encoder)
            n = block.num_rows
            code = got["ids_a"][got["link_a"]] << 32 | got["ids_b"][got["link_b"]]
            order = np.lexsort((code, got["doc"]))
            code, doc = code[order], got["doc"][order]
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            times = np.diff(first, append=len(code))
            links = np.bincount(doc, minlength=n)
            yield pa.RecordBatch.from_arrays([
                block.column(0), pa.array(got["n_a"]), pa.array(got["n_b"]), pa.array(got["n_groups"]), pa.array(links),
                pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]], pa.string()),
                _lists(code[first], np.bincount(doc[first], minlength=n)),
                _lists(times.astype(np.int32), np.bincount(doc[first], minlength=n))], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    made = python_map(own, run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                                "pairs array<bigint>, times array<int>")
    return store(made.withColumn("row", F.monotonically_increasing_id()), "aligned", codec="zstd")


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of `aligned` hold each pair of ids, and whether no pair of its first id has more."""
    counts = cut(docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return cut(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(docs: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """(row, n_best, count_sum) of rows of `aligned` with links: links whose pair has the highest count of its first id, and
    the sum of the counts of all links."""
    links = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    return links.join(bounded(counts, sent), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def alignment(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, side_a: str = SIDE_A, side_b: str = SIDE_B,
              sent: int = SENT) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, see `aligned` and `scored`.

    An empty table gives an empty result.
    """
    docs = aligned(df, id_col, text, side_a=side_a, side_b=side_b)
    score = scored(docs, pair_counts(docs), sent)
    return docs.join(score, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), F.col("groups").alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide counts of the tokens of every document."""
    return alignment(table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
