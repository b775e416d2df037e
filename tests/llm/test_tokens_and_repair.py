"""Token alignment, token files and conversation repair against brute force."""

import collections
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from aligngrid.llm import alignment, repair, token_files, tokens
from aligngrid.session import new_path
from tests.llm.helpers import DOCS, documents, full

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "x", " lead", "trail ", "a  b ", " \n a b\n\n c d ", "it's we'll  <|endoftext|> x", "▁ a▁b c", "\x00 a",
             "é　 b c", "a\t b  c", "😀 🇩🇪 naïve", "<0x41> <unk> <s>", "0 0 0", "0 00 0", "a b \u0085", "\x1c \x1d x"]


def oracle_a(texts, special=False):
    tk = Tokenizer.from_file(alignment.SIDE_A)
    tk.encode_special_tokens = not special
    return [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("known", [0, 7, 800_000])
def test_chunks_give_the_library_ids(monkeypatch, known):
    monkeypatch.setattr(tokens, "KNOWN", known)
    monkeypatch.setattr(tokens, "CALL", 500)
    texts = [t or "" for t in ODD_TEXTS] + [t or "" for _, t in documents(3, 80)]
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.SIDE_B)
    for special, lead in ((False, " "), (True, ""), (False, "")):
        encoder = tokens.Encoder([tokens.Side(tokens.ByteLevel(tokens.read(alignment.SIDE_A), special)),
                                  tokens.Side(tokens.PieceModel(tokens.read(alignment.SIDE_B)))])
        for _ in range(2):
            got = [encoder.encode(texts[a:a + 9], lead) for a in range(0, len(texts), 9)]
            for side, want in ((0, oracle_a([lead + t if t else "" for t in texts], special)), (1, [sp.encode(t) for t in texts])):
                if side and not lead:
                    continue
                flat, counts = (np.concatenate([g[side][k] for g in got]) for k in (0, 1))
                assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [w if t else [] for w, t in zip(want, texts)]


def oracle_alignment(rows):
    byte_of = {chr(c): b for b, c in enumerate(tokens._byte_letters())}
    tk = Tokenizer.from_file(alignment.SIDE_A)
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.SIDE_B)
    docs, counts = [], collections.Counter()
    for i, text in rows:
        a = b = []
        if text:
            ids_a, ids_b = tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw_a = [bytes(byte_of[c] for c in tk.id_to_token(x)) for x in ids_a]
            raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode()
                     for x in ids_b for p in [sp.id_to_piece(x)]]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = list(zip(ids_a, map(len, raw_a))), list(zip(ids_b, map(len, raw_b)))
        spans = []
        for side in (a, b):
            at, out = 0, []
            for number, size in side:
                out.append((number, at, at + size))
                at += size
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [[",".join(str(n) for n, s, e in side if lo <= s and e <= hi) for side in spans] for lo, hi in zip([0, *ends], ends)]
        docs.append((i, len(a), len(b), groups, links))
        counts.update(set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if n_a else "")
                   for i, n_a, n_b, groups, links in docs), key=repr)


@pytest.mark.parametrize("sent", [0, alignment.SENT])
def test_alignment_brute_force(spark, sent):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(i + 100, (t or "")[:300]) for i, t in documents(4, 25)] + [(None, "no id"), (0, "x y")]
    df = spark.createDataFrame(full(rows), DOCS).select("*", *[F.lit(7).alias(c) for c in ("id", "row", "pairs", "n_a", "n")])
    got = alignment.alignment(df.repartition(3), sent=sent).collect()
    assert sorted(map(tuple, got), key=repr) == oracle_alignment(rows)
    assert alignment.alignment(spark.createDataFrame([], DOCS)).collect() == []


def test_alignment_of_one_very_long_text(spark):
    text = "some words and numbers 12345 of one text; " * 60_000
    got = alignment.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    (ids,) = oracle_a([" " + text])
    assert got.n_a == len(ids) and got.n_links >= got.n_a and got.n_best > 0


def test_alignment_query(spark):
    got = entry.queries()["op11_alignment"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = [tuple(r) for r in rows if len(r.text or "") < 700]
    want = {x[0]: x for x in oracle_alignment(small)}
    assert len(got) == len(rows)
    for g in got:  # counts over the corpus are not those of the small texts
        if g.doc_id in want:
            assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.groups_sha256) == tuple(want[g.doc_id][k] for k in (1, 2, 3, 4, 7))


@pytest.mark.parametrize("width", [0, 1, 5, 13, 16, 31, 32])
def test_blocks_round_trip(width):
    r = np.random.default_rng(width)
    for n in (1, 2, 7, 8, 1000):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64, endpoint=False).astype(np.uint32) if width else np.full(n, 9, np.uint32)
        ids[r.integers(0, n, n // 50)] = (1 << 32) - 1
        for percentile in (0.0, 0.5, 0.9, 1.0):
            data = token_files.packed_block(ids, percentile)
            assert (token_files.unpacked_block(data) == ids).all()
    skewed = np.where(np.arange(10_000) % 100 == 0, 1 << 30, np.arange(10_000) % 16).astype(np.uint32)
    assert len(token_files.packed_block(skewed, 0.98)) < 10_000 * 0.6


def test_file_parts():
    class Kept(io.BytesIO):
        def close(self):
            pass

    r = np.random.default_rng(1)
    out, docs, all_ = Kept(), [], []
    writer = token_files.Writer(out, block=64)
    for k in range(40):
        counts = r.integers(0, 90, 5).tolist()
        ids = r.integers(0, 50_000, sum(counts))
        writer.add(ids, counts, [None if k == 0 else 5 * k + i for i in range(5)])
        docs += counts
        all_.append(ids)
    writer.close()
    flat, ends = np.concatenate(all_), np.cumsum(docs)
    reader = token_files.Reader(pa.BufferReader(out.getvalue()))
    assert reader.docs[:6] == [None] * 5 + [5] and (reader.ends == ends).all() and reader.n == len(flat)
    for a, b in [(0, 0), (0, 1), (63, 65), (100, 100), (10, 3000), (0, len(flat))]:
        assert (reader.ids(a, b) == flat[a:b]).all()
    for few in (1, 100, 1 << 20):
        got = [x for _, _, ids in reader.documents(few) for x in ids]
        assert len(got) == len(docs) and all((x == y).all() for x, y in zip(got, np.split(flat, ends[:-1])))
    data = bytearray(out.getvalue())
    data[-60] ^= 1
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(bytes(data)))


def oracle_files(rows, special=True):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    out, at = [], 0
    for (i, _), ids in zip(rows, oracle_a([t or "" for _, t in rows], special)):
        ids = [*ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1, 200, 1 << 23])
def test_files_brute_force(spark, file_ids):
    rows = [(i - 4, t) for i, t in enumerate(ODD_TEXTS)] + [(i + 100, t) for i, t in documents(6, 40)] + [(None, "no id"), (500, "x " * 70_000)]
    df = spark.createDataFrame(full(rows), DOCS).select("*", *[F.lit(7).alias(c) for c in ("id", "task", "start", "path", "n_ids")])
    files = token_files.write_files(df.repartition(3), new_path(spark, "ids"), file_ids=file_ids, block=128)
    got = token_files.read_files(files).collect()
    assert sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in got if x.doc_id is not None) == oracle_files(rows)[1:]
    (x,) = [x for x in got if x.doc_id is None]
    assert x.start == 0 and x.ids == [*oracle_a(["no id"])[0], 0]
    assert files.agg(F.sum("n_docs")).first()[0] == len(rows)
    empty = token_files.write_files(df.limit(0), new_path(spark, "ids"))
    assert token_files.read_files(empty).collect() == []


def test_files_of_repeated_rows(spark):
    rows = [(3, "b c"), (3, "a"), (3, "b c"), (1, None), (1, None)]
    files = token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "ids"))
    got = sorted(token_files.read_files(files).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [1, 1, 3, 3, 3] and sorted(x.n_tokens for x in got) == [1, 1, 2, 3, 3]
    assert [x.start for x in got] == list(itertools.accumulate([0] + [x.n_tokens for x in got]))[:-1]


def test_files_query(spark):
    got = entry.queries()["op12_token_files"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == oracle_files(rows)


# Conversations

ORDER = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit) by keeping the cheapest edits of every state, rows: (initial, must go, truncated)."""
    def closed(best):
        for _ in range(3):
            for s, (c, e) in list(best.items()):
                for x in "ua":
                    if (t := step(s, x)) is not None and (t not in best or (c + 5, e + "I") < best[t]):
                        best[t] = (c + 5, e + "I")
        return best

    def step(s, x):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))

    best = {"": (0, "")}
    for x, go, cut in rows:
        new = {}
        for s, (c, e) in closed(best).items():
            ways = [(s, c + 2, "D")]
            if not go:
                ways += [(step(s, y), c + 5 * cut + (y != x or k == "R"), k) for y in "sua" for k in "KR"
                         if (k == "K") == (y == x) and not (k == "R" and y == "s")]
            for t, d, k in ways:
                if t is not None and (t not in new or (d, e + k) < new[t]):
                    new[t] = (d, e + k)
        best = new
    return min(closed(best)[s] for s in ("", "a") if s in closed(best))


def listed(rows):
    """The same by listing all edits of a few rows with up to two inserts at a place."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(go and k != "D" for (_, go, _), k in zip(rows, edits)):
            continue
        for inserts in itertools.product(["", "I"], repeat=len(rows) + 1):
            audit = "".join(i + k for i, k in zip(inserts, [*edits, ""]))
            at, state, ok = 0, "", True
            for k in audit:
                if k != "I":
                    x, _, _ = rows[at]
                    at += 1
                if k == "D":
                    continue
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                x = x if k == "K" else nxt
                if not (x == nxt or (state == "" and x == "s")):
                    ok = False
                    break
                state = x
            if ok and state in ("", "a"):
                cost = sum({"D": 2, "K": 0, "R": 1}[k] + 5 * (k != "D" and cut) for k, (_, _, cut) in zip(edits, rows)) + 5 * audit.count("I")
                found.append((cost, audit))
    return min(found)


def searched(rows):
    out = []
    search = repair.Search(give=out.append)
    most = 0
    for row in rows:
        search.row(*row)
        most = max(most, search.open)
    return search.end()[1], "".join(out), most


def made_rows(r, n):
    return [(r.choice("sssuuuaaaux"), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]


def test_search_brute_force():
    r = random.Random(2)
    for k in range(500):
        rows = made_rows(r, r.randint(0, 5))
        assert cheapest(rows) == listed(rows) == searched(rows)[:2], rows
    for _ in range(300):
        rows = made_rows(r, r.randint(5, 60))
        assert cheapest(rows) == searched(rows)[:2], rows


def test_search_memory_is_bounded_and_gives_early():
    rows = [("u", False, False), ("a", False, False)] * 20_000
    cost, audit, most = searched(rows)
    assert (cost, audit) == (0, "K" * 40_000) and most < 20
    r = random.Random(3)
    _, audit, most = searched(made_rows(r, 20_000))
    assert most < 400 and len(audit.replace("I", "")) == 20_000


def faulty(rows):
    """Blank, duplicate, truncated or None of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        some = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not some else "duplicate" if (role, text) in seen else "truncated" if some[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def oracle_repair(given):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in given:
        kept = convs[conv]
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        marks = faulty([x[1:] for x in rows])
        cost, audit = cheapest([(x[1][:1], m in ("blank", "duplicate"), m == "truncated") for x, m in zip(rows, marks)])
        turns = {x[0] for x in rows} - {None}
        state, left, written = "", list(rows), []
        for k in audit:
            role, text = left.pop(0)[1:] if k != "I" else (None, "")
            if k == "D":
                continue
            if k in "RI":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            written.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=300):
    r = random.Random(seed)
    out = []
    for conv in [None, *range(n // 6)]:
        for turn in range(r.randint(0, 9)):
            text = r.choice(["hello.", "yes!", "no", "why?  \n", "", " \t", None, "a. b", "é…", "x." * 50])
            out.append((conv, r.choice([turn, turn, turn, turn * 3, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    return out + r.choices(out, k=20)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_brute_force(spark, tmp_path):
    rows = conversations(9)
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("conv", "block", "place", "edit", "fault", "kind", "c")]
                                               ).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == oracle_repair(rows)


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op13_repair(spark, str(tmp_path)).collect() == []
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_one_conversation_over_many_blocks(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(5, t, r.choice(["system", "user", "user", "assistant", "assistant"]) if 100 < t % 400 else ["user", "assistant"][t % 2],
             r.choice(["yes.", "no", "", f"text {t}.", f"text {t}", f"text {r.randint(0, t)}!"])) for t in range(3000)] + conversations(seed, 60)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == oracle_repair(rows)
    blocks = repair.repaired(spark.createDataFrame(rows, SCHEMA)).where("conv = '5'").select("block").distinct().count()
    assert blocks > 3


def test_repair_query(spark):
    got = entry.queries()["op13_repair"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == oracle_repair(rows)
