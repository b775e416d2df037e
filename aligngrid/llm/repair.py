"""Repair of the order of roles in conversations: the cheapest edits that leave `(s?(ua)+)?`.

Rows are kept, given another role, deleted or inserted. What has been written so far is in one of four states (nothing, a system
row, ends with a user's, ends with an assistant's row), and a Viterbi search keeps the cheapest edits into each state.

Survivor coalescence: the edits of the survivors form a tree of back-pointers, each node counting the nodes and survivors that
hang on it. A node that loses its last one goes, and so do its forebears. As soon as the oldest node is left with a single
child and no survivor, all survivors share it: its edits are final and are given out. So memory holds what is still open, not the
conversation. Equally cheap ways into a state are told apart by their open edits as a whole, from the oldest node on.
Survivors that can't win any more (another state is cheaper by more than it could ever cost to stand in for them) are dropped,
so a conversation that begins well is not kept open by the possibility to delete all of it.

Conversations are sorted by range over all tasks, so that one of any size lies in several tasks' blocks. The blocks of such a
conversation are searched apart: the costs from each state to each one first; from these, the least cost to the end from each
block's end (a few numbers a block); then the state in which each block ends for each one in which it may begin; and last the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm.common import python_map, store, table

#: Costs of the edits; an undeleted truncated row costs more. Least costs decide, then the least letters.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_CHAR = r"[^\x20\x09-\x0D]"
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_LETTER = {USER: "u", ASSISTANT: "a"}
ENDS = (NONE, ASSISTANT)
_FAR = 1 << 60


class Node:
    """Edits of one row (inserts before it, then its own), the node of the row before, and what hangs on it."""

    __slots__ = ("edits", "parent", "held")

    def __init__(self, edits: str, parent: Node | None):
        self.edits, self.parent, self.held = edits, parent, 0
        if parent is not None:
            parent.held += 1


class Search:
    """Cheapest edits of one conversation, or of a block of it from the state `begin` on."""

    def __init__(self, begin: int = NONE, give: Callable[[str], None] | None = None):
        self.give = give or (lambda edits: None)
        self.root = Node("", None)
        self.root.held = 1
        self.best: dict[int, tuple[int, Node]] = {begin: (0, self.root)}
        self.open = 1  # nodes of the tree

    def _path(self, node: Node, more: str) -> str:
        out = [more]
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return "".join(reversed(out))

    def _let_go(self, node: Node) -> None:
        node.held -= 1
        while node.held == 0 and node is not self.root:
            self.open -= 1
            node = node.parent
            node.held -= 1

    def _better(self, one: tuple[int, Node, str], other: tuple[int, Node, str]) -> bool:
        if one[0] != other[0]:
            return one[0] < other[0]
        return self._path(*one[1:]) < self._path(*other[1:])

    def _inserted(self) -> dict[int, tuple[int, Node, str]]:
        """The survivors, and those that an insert more makes cheaper than what is there."""
        found = {state: (cost, node, "") for state, (cost, node) in self.best.items()}
        for _ in _LETTER:
            for state, (cost, node, edits) in list(found.items()):
                for to in _NEXT[state].values():
                    if to in _LETTER:
                        way = (cost + INSERT, node, edits + "I")
                        if to not in found or self._better(way, found[to]):
                            found[to] = way
        return found

    def _take(self, found: dict[int, tuple[int, Node, str]]) -> None:
        """The new survivors, each with a node of its own."""
        if ASSISTANT in found:  # it may end, and does all that the others do but for keeping a first system row
            least = found[ASSISTANT][0]
            for state, more in ((NONE, DELETE), (SYSTEM, 0)):
                if state in found and found[state][0] > least + more:
                    del found[state]
        old, self.best = self.best, {}
        for state, (cost, node, edits) in found.items():
            new = Node(edits, node)
            new.held = 1
            self.best[state] = (cost, new)
        self.open += len(found)
        for _, node in old.values():
            self._let_go(node)
        self._settle()

    def _settle(self) -> None:
        """Gives out the edits that all survivors share; they begin at a node, which is left as the root without edits."""
        node = next(iter(self.best.values()))[1]
        if self.root.held != 1:
            return
        chain = []  # from a survivor back to the root; the oldest nodes with one child each are shared
        while node is not self.root:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            if self.root.held != 1:
                break
            self.give(node.edits)
            self.root, node.parent, node.edits = node, None, ""
            self.open -= 1

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        """The next row: the first letter of its role, whether it has to be deleted, whether its text is cut off."""
        found: dict[int, tuple[int, Node, str]] = {}

        def offer(state, cost, node, edits):
            if state not in found or self._better((cost, node, edits), found[state]):
                found[state] = (cost, node, edits)

        stay = TRUNCATED if truncated else 0
        for state, (cost, node, edits) in self._inserted().items():
            offer(state, cost + DELETE, node, edits + "D")
            if must_go:
                continue
            for letter, to in _NEXT[state].items():
                if initial == letter:
                    offer(to, cost + stay, node, edits + "K")
                if to in _LETTER:
                    offer(to, cost + stay + RELABEL, node, edits + "R")
        self._take(found)

    def costs(self) -> list[int]:
        """Of each state, without further inserts."""
        return [self.best[s][0] if s in self.best else _FAR for s in range(4)]

    def end(self, to_end: list[int] | None = None) -> tuple[int, int]:
        """The state in which the cheapest edits end, and their cost; the rest of the edits is given out.

        to_end: least costs from each state on, where rows follow; else inserts are allowed and the last row must be an assistant's.
        """
        if to_end is None:
            ways = {s: w for s, w in self._inserted().items() if s in ENDS}
        else:
            ways = {s: (cost + to_end[s], node, "") for s, (cost, node) in self.best.items() if to_end[s] < _FAR}
        last = None
        for state, way in ways.items():
            if last is None or self._better(way, ways[last]):
                last = state
        self.give(self._path(*ways[last][1:]))
        return last, ways[last][0]


def end_costs() -> list[int]:
    """Least cost from each state to an end without further rows."""
    out = []
    for state in range(4):
        n, at = 0, state
        while at not in ENDS:
            at, n = _NEXT[at].get("a", USER), n + 1
        out.append(n * INSERT)
    return out


# Damage, faults, order


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with made faults; which ones is decided by crc32 of `conv_id:turn`, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls of role and text, and in
    the checksum, are a space. A row's damage depends on it alone, so equal rows stay equal. Further columns play no part.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    out = df.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                    F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    kind.alias("kind"))
    return out.where("kind <> 0").withColumn(
        "copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text, times, fault` of each different row, `times` how often it is there.

    fault: blank (no character but white space), duplicate (an earlier turn has the same role and text), truncated (the last
    character but white space is no `[.!?]`), or null. Of equal rows of one turn all but the first are duplicates, too.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    same = [F.col("conv_id"), F.col("role"), F.md5(F.col("text").cast("binary")).alias("digest")]
    # min() skips nulls but not structs of a null, which come first as null turns do.
    seen = one.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "first")
    later = one.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.md5(F.col("text").cast("binary")) == F.col("digest")), "left")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (F.when(~F.col("text").rlike(BLANK_CHAR), "blank")
             .when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    return later.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in order (by conversation, turn, nulls first, role, text), with the number of their range as `block`; stored."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "turn", "role", F.substring("text", 1, 64)]  # the sample that finds the ranges holds no whole texts
    return store(rows.repartitionByRange(parts, *key).withColumn("block", F.spark_partition_id()), "turns")


# Search over blocks

_INPUT = ["conv", "block", "begin", "to_end", "initial", "role", "turn", "text", "times", "fault"]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(conversation, block) and its rows; each run has to be read before the next one."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        key, first = row[:2], row

        def run():
            nonlocal row
            row = first
            while row is not None and row[:2] == key:
                yield row
                row = next(rows, None)
        yield key, run()


def _feed(search: list[Search], row: tuple) -> None:
    _, _, _, _, initial, _, _, _, times, fault = row
    for s in search:
        s.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        for _ in range(times - 1):
            s.row(initial, True, False)


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, costs): 16 least costs from each state to each one."""
    out = []
    for key, rows in _runs(batches):
        search = [Search(s) for s in range(4)]
        for row in rows:
            _feed(search, row)
        out.append((*key, [c for s in search for c in s.costs()]))
    yield _batch(out, ("conv", "block", "costs"), (None, pa.int32(), pa.list_(pa.int64())))


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, ends): the state in which the block ends for each one in which it may begin."""
    out = []
    for key, rows in _runs(batches):
        search, to_end = [Search(s) for s in range(4)], None
        for row in rows:
            to_end = row[3]
            _feed(search, row)
        out.append((*key, [s.end(to_end)[0] for s in search]))
    yield _batch(out, ("conv", "block", "ends"), (None, pa.int32(), pa.list_(pa.int64())))


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t or pa.string()) for c, t in zip(columns, types)], names=list(names))


def _later_costs(rows: Iterable[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Least costs to the end of the conversation from the end of each block, none for the last; rows: (block, its 16 costs).

    An insert between two blocks belongs to the later one, whose search begins with inserts.
    """
    out, later = [], None
    for block, costs in sorted(rows, reverse=True):
        out.append((block, later))
        on = later or end_costs()
        later = [min(min(costs[4 * a + b] + on[b], _FAR) for b in range(4)) for a in range(4)]
    return out


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit of each block, as soon as it is final."""
    out: list[tuple] = []
    types = (None, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ("conv", "block", "place", "edit", "turn", "old_role", "role", "text", "fault")
    for key, rows in _runs(batches):
        waiting: list[tuple] = []  # rows whose edits are open
        ready: list[str] = []
        search = state = to_end = None
        place = taken = 0

        def written(letters: str):
            nonlocal place, taken, state
            for letter in letters:
                row = None
                if letter != "I":
                    row, copy = waiting[taken]
                    taken += 1
                role = text = turn = fault = old = None
                if row is not None:
                    old, turn, text = row[5:8]
                    fault = "duplicate" if copy and row[9] != "blank" else row[9]
                    role = old
                if letter == "K":
                    state = _NEXT[state][row[4]]
                elif letter in "RI":
                    state = next(s for s in _NEXT[state].values() if s in _LETTER)
                    role, text = {USER: "user", ASSISTANT: "assistant"}[state], text or ""
                out.append((key[0], key[1], place, letter, turn, old, role if letter != "D" else None, text, fault))
                place += 1

        for row in rows:
            if search is None:
                state, to_end = row[2], row[3]
                search = Search(state, ready.append)
            for copy in range(row[8]):
                waiting.append((row, copy))
                search.row(row[4], copy > 0 or row[9] in ("blank", "duplicate"), copy == 0 and row[9] == "truncated")
            if ready:
                written("".join(ready))
                ready.clear()
                del waiting[:taken]
                taken = 0
            if len(out) >= 2000:
                yield _batch(out, names, types)
                out = []
        search.end(to_end)
        written("".join(ready))
    yield _batch(out, names, types)


def _texts(df: DataFrame) -> DataFrame:
    """The conversation as text, null as null; conversations of any type are told apart by it."""
    return df.withColumn("conv", F.col("conv_id").cast("string"))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, block, place, edit, turn, old_role, role, text, fault): a row for each edit, in the order of block and place.

    rows: conv_id, turn (long), role, text; nulls of role and text are a space. edit: K keeps a row, R gives it the role the
    order needs, D deletes it (role is null then, old_role not), I inserts one (old_role and turn are null, the text is empty). conv is
    conv_id as text. Rows are ordered by turn (nulls first), then role and text. Blank rows and repeats of role and text
    are always deleted. Rows of a null conv_id are one conversation. An empty table gives an empty result.
    """
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    turns = _blocks(faults(filled))
    sorted_ = ["conv", "block", F.col("turn").asc_nulls_first(), "role", "text"]
    ready = _texts(turns).select("conv", "block", F.lit(NONE).cast("long").alias("begin"),
                                 F.lit(None).cast("array<bigint>").alias("to_end"), F.substring("role", 1, 1).alias("initial"),
                                 "role", "turn", "text", "times", "fault")
    spread = (ready.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
              .select(F.col("conv").alias("c")))
    spread = store(spread, "spread")  # at most one for each two neighbouring ranges
    alone = ready.join(F.broadcast(spread), F.col("conv").eqNullSafe(F.col("c")), "left_anti")
    split = ready.join(F.broadcast(spread), F.col("conv").eqNullSafe(F.col("c")), "left_semi")

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(*_INPUT).repartition("conv", "block").sortWithinPartitions(*sorted_)

    def chained(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """A few numbers a block, as many blocks as there are ranges: one row a conversation."""
        lists = df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "conv"]))).alias("x"))
        return lists.select("conv", F.explode(F.udf(fn, schema)("x")).alias("y")).select("conv", "y.*")

    costs = python_map(dealt(split), _block_costs, "conv string, block int, costs array<bigint>")
    later = store(chained(costs, lambda x: _later_costs([(r.block, r.costs) for r in x]),
                          "array<struct<block:int,later:array<bigint>>>"), "later")
    bound = split.join(F.broadcast(later), split.conv.eqNullSafe(later.conv) & (split.block == later.block)).select(
        split.conv, split.block, "begin", F.col("later").alias("to_end"), *[split[c] for c in _INPUT[4:]])
    ends = python_map(dealt(bound), _block_ends, "conv string, block int, ends array<bigint>")

    def walked(x):
        out, state = [], NONE
        for r in x:
            out.append((r.block, state))
            state = r.ends[state]
        return out
    begins = store(chained(ends, walked, "array<struct<block:int,first:bigint>>"), "begins")
    bound = bound.join(F.broadcast(begins), bound.conv.eqNullSafe(begins.conv) & (bound.block == begins.block)).select(
        bound.conv, bound.block, F.col("first").alias("begin"), *[bound[c] for c in _INPUT[3:]])
    kept = "conv string, block int, place bigint, edit string, turn bigint, old_role string, role string, text string, fault string"
    return python_map(dealt(alone.union(bound)), _edits, kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edits in order -> (conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    names = ("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    types = (None, *[pa.int64()] * 5, None, None)
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    out, now, hasher = [], None, None
    for conv, edit, old, role, text, fault in rows:
        if now is None or conv != now["conv"]:
            if now is not None:
                out.append((*now.values(), hasher.hexdigest()))
                if len(out) == 2000:
                    yield _batch([(*x[:6], "".join(x[6]), x[9]) for x in out], names, types)
                    out = []
            now = {"conv": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "last": None,
                   "written": False}
            hasher = hashlib.sha256()
        now["audit"].append(edit)
        now["cost"] += {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            now["illegal"] += now["last"] is not None and now["last"] + old[:1] not in ("su", "ua", "au")
            now["last"] = old[:1]
            if fault is not None:
                now[fault] += 1
            now["cost"] += TRUNCATED * (edit != "D" and fault == "truncated")
        if edit != "D":
            hasher.update((("\n" if now["written"] else "") + f"{role}:{text}").encode())
            now["written"] = True
    if now is not None:
        out.append((*now.values(), hasher.hexdigest()))
    yield _batch([(*x[:6], "".join(x[6]), x[9]) for x in out], names, types)


def audited(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `repaired`'s input.

    A checksum of a conversation needs its texts one after the other: they pass through one task, which holds the letters of the
    edits only.
    """
    edits = repaired(rows).repartition("conv").sortWithinPartitions("conv", "block", "place")
    return python_map(edits.select("conv", "edit", "old_role", "role", "text", "fault"), _digests,
                      "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
                      "repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns between the least and the greatest that no row has; null if the span is more than a long."""
    span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long"))
    return rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        F.when(F.count("turn") == 0, 0).otherwise(F.try_subtract(span, F.count("turn"))).alias("gaps")).select(
        F.col("conv_id").cast("string").alias("conv"), "gaps")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after made damage."""
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    broken = damaged(given)
    all_ = _texts(given.select("conv_id").distinct())
    audit, gap = audited(broken), gaps(broken).withColumnRenamed("conv", "c")
    made = audit.join(gap, F.col("conv").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv", "c")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_.join(made, F.col("conv").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col(n)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias(
            "repaired_sha256"))


QUERIES = {"op13_repair": op13_repair}
