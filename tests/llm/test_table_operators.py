"""Mixing, fingerprints, personal data, tool calls, hosts and revisits against brute force."""

import collections
import hashlib
import json
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aligngrid.llm import fingerprint, hosts, mixing, pii, toolcalls
from tests.compare import compare, connect
from tests.llm.helpers import documents, full, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_hosts", "op9_revisits"])
def test_same_as_sql(spark, name):
    rows, message = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert message == "ok" and rows > 0


def filled(sizes, weights, cap):
    """Targets by sharing again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = cap * sizes[i]
        open_ -= over
    return target


def test_targets_and_takes(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5)), r.choice("AABBBCDEEEEEEEEEEEEEé") if i % 9 else None)
            for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pareto_mix(df, mixing.n_words(), preference=F.sqrt(mixing.n_words())).collect()
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(words(t)) for _, t, s in rows if s == n) for n in names]
    want = filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    by = collections.defaultdict(list)
    for x in got:
        by[x.source].append(x)
    for n, size, target in zip(names, sizes, want):
        mine = by[n]
        assert {x.mix_source_size for x in mine} == {size}
        assert all(abs(x.mix_target - target) < 1e-6 * target for x in mine)
        assert all(0 <= x.mix_copies <= 3 for x in mine)
        assert abs(sum(x.mix_size * x.mix_copies for x in mine) - target) <= max(x.mix_size for x in mine)
    again = mixing.pareto_mix(df.repartition(7), mixing.n_words(), preference=F.sqrt(mixing.n_words())).collect()
    assert sorted((x.doc_id, x.mix_copies) for x in got) == sorted((x.doc_id, x.mix_copies) for x in again)


def test_inclusion_follows_the_preference(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "10 AS size", "1.0 + id % 4 AS p").union(
        spark.range(4000, 4400).selectExpr("id", "'t'", "30", "1.0D"))
    got = mixing.pareto_mix(df, F.col("size"), preference=F.col("p"), weights=(1.0, 1.0), max_copies=3).where("source = 's'")
    rate = {r.p: r.m for r in got.groupBy("p").agg(F.avg("mix_copies").alias("m")).collect()}
    total = got.agg(F.sum("mix_copies")).first()[0]
    assert abs(total * 10 - 26_000) <= 10
    for p, m in rate.items():
        assert abs(m - 0.65 * p / 2.5) < 0.08


def test_fingerprint_layout_and_algebra(spark):
    texts = ["one two three four five six seven\nmore", "more\none two three four five six seven", "", "a\n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.own for r in fingerprint.fingerprints(df, ["doc_id"], {"own": "text"}).collect()}
    assert got[0] == got[1] and got[0] != got[3]

    lines = texts[0].split("\n")
    parts = [m.group(0) for m in re.finditer(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,6}", texts[0])]
    assert got[0][-2:] == [len(lines), len(parts)]
    assert all(0 <= x < 2**32 for x in got[0][:8])
    bits = [x >> (20 * i) & (2**20 - 1) for x in got[0][8:-2] for i in range(3)]
    assert len(bits) == 120 and all(0 <= b <= len(parts) for b in bits)
    # Adding and removing: the text joined to another by a line break, and back.
    both = spark.createDataFrame([(0, texts[0] + "\n" + texts[3], texts[0], texts[3])], "k long, w string, a string, b string")
    v = fingerprint.fingerprints(both, ["k"], {"w": "w", "a": "a", "b": "b"})
    row = v.select("w", "a", fingerprint.combined(F.col("a"), F.col("b")).alias("sum"),
                   fingerprint.combined(F.col("w"), F.col("b"), -1).alias("left")).first()
    assert row.w == row.sum and row.a == row.left


def brute_vector(text):
    """The vector of a text, element by element."""
    def hashed(seed, value):
        return xxhash.xxh64_intdigest(value.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42))

    paragraphs = text.split("\n")
    parts = [m.group(0) for m in re.finditer(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,6}", text)]
    out = []
    for seed in fingerprint.EQUAL_SEEDS:
        for shift in (0, 32):
            out.append(sum(hashed(seed, p) >> shift & 0xFFFFFFFF for p in paragraphs) & 0xFFFFFFFF)
    for seed in fingerprint.LIKE_SEEDS:
        bits = [hashed(seed, p) for p in parts]
        for i in range(20):
            out.append(sum((sum(h >> (i + 20 * lane) & 1 for h in bits) & 0xFFFFF) << 20 * lane for lane in range(3)))
    return [*out, len(paragraphs), len(parts)]


def test_vectors_like_brute_force(spark):
    rows = [(i, t or "") for i, t in documents(12, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.own for r in fingerprint.fingerprints(df, ["doc_id"], {"own": "text"}).collect()}
    for i, t in rows:
        assert got[i] == brute_vector(t)


def test_edits_and_likeness(spark):
    rows = documents(9, 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r for r in fingerprint.with_edits(df).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        assert got[i].edited == t[:len(t) - q] + after[:q] and got[i].n == len(t)
    made = fingerprint.fingerprints(spark.createDataFrame(
        [(i, got[i].text, got[i].edited) for i in got], "id long, a string, b string"), ["id"], {"x": "a", "y": "b"})
    near = {r.id: r.s for r in made.select("id", fingerprint.likeness(F.col("x"), F.col("y")).alias("s")).collect()}
    long = [near[i] for i in got if len(got[i].text) > 600]
    assert sum(long) / len(long) > 0.6 and all(0 <= s <= 1 for s in near.values())


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group(0))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group(0).split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_like_brute_force(spark):
    r = random.Random(3)
    bits = ["a@b.c", "x_d@e.f", "1.2.3.4", "300.1.1.1", "001.002.3.4.5", "4539 1488 0343 6467", "+1 (017) 555-7713", "é😀 ", "12-34",
            "4539148803436467", "a@b", ".", "@", "+", "99999999999999", " ", "-", "._%", "\n", "token = \"0123456789abcdef0\""]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)]
    texts += ["", "1" * 5000, "1 " * 5000, "a" * 50_000, "a." * 20_000 + "@b.c", "+1" + " " * 5000, "1.2.3." * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.s for x in df.selectExpr("doc_id", f"{pii.base_spans('text')} AS b").selectExpr(
        "doc_id", "transform(array_sort(transform(b, x -> named_struct('s', x.s, 'o', array_position(array('email', 'ip', 'card', "
        "'phone'), x.k), 'e', x.e, 'k', x.k))), x -> x) AS b").selectExpr("doc_id", f"{pii.digest('b')} AS s").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_spans(t), t[:200]


def test_added_spans_and_redaction(spark):
    rows = [(1, 'Set the token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and go.'), (2, "A clean text with internationalisation only."),
            (3, "pay 4539148803436467 to a@b.org from 10.0.0.1"), (4, None), (5, "user password=b7db7aa4a5fcc78305 ends"),
            (6, "é😀 +1 (017) 555-7713, bye")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got == {1: 'Set the token = "[SECRET]" and go.', 2: rows[1][1], 3: "pay [CARD] to [EMAIL] from [IP]", 4: None,
                   5: "user password=[SECRET] ends", 6: "é😀 [PHONE], bye"}
    counted = {r.doc_id: r for r in pii.counted(pii.personal_spans(df)).collect()}
    assert counted[3].spans == "card:4:20,email:24:31,ip:37:45"
    assert counted[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_held_out_accuracy(spark):
    """Trees fitted to some seeds, judged on the made texts of others."""
    score, limits = pii.fitted(spark, 6000)
    other = pii.training_texts(spark, 9000).where("cast(seed AS int) >= 6000")
    x = other.selectExpr("text", "truth", f"explode({pii.candidates('text')}) AS x")
    limit = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in limits.items()) + " END"
    said = x.selectExpr(f"{score} >= {limit} AS said", "coalesce(substring(text, x.s + 1, x.e - x.s) = truth, false) AS good")
    n = {(r.said, r.good): r["count"] for r in said.groupBy("said", "good").count().collect()}
    right, wrong, lost = n[(True, True)], n.get((True, False), 0), n.get((False, True), 0)
    assert right / (right + wrong) > 0.95 and right / (right + lost) > 0.85


def test_cards_beside_other_digits(spark):
    number = "4111111111111111"
    rows = ["card 4111 1111 1111 1111 12/27", "card 4111-1111-1111-1111 123 ok", f"x 98765{number}432 y"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: {(x.k, x.v) for x in r.c} for r in df.selectExpr(
        "doc_id", f"transform({pii.candidates('text')}, x -> named_struct('k', x.k, 'v', substring(text, x.s + 1, x.e - x.s))) AS c").collect()}
    assert ("subcard", "4111 1111 1111 1111") in got[0] and ("subcard", "4111-1111-1111-1111") in got[1]
    assert ("window", number) in got[2]
    # Recall on the true spans of seeds that were not fitted.
    other = pii.training_texts(spark, 9000).where("cast(seed AS int) >= 6000")
    every = df.selectExpr("cast(-1 - doc_id AS string) AS seed", "text", "cast(null AS string) AS truth").union(other)
    found = pii.personal_spans(every, rows=6000).selectExpr(
        "seed", "text", "truth", "transform(pii, x -> substring(text, x.s + 1, x.e - x.s)) AS said").collect()
    made = {r.seed: r.said for r in found}
    grouped = [r for r in found if r.truth and re.fullmatch("[0-9]{4}[ -][0-9 -]{10,}", r.truth)]
    true = [r for r in found if r.truth]
    share = lambda rs: sum(r.truth in r.said for r in rs) / len(rs)
    print("recall", share(true), share(grouped), len(true), len(grouped))
    assert "4111 1111 1111 1111" in made["-1"] and "4111-1111-1111-1111" in made["-2"]
    assert share(grouped) > 0.9 and share(true) > 0.85


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}
    calls = [(1, 1, "x", "f", '{"b": 1, "a": 2}', None), (1, 3, "y", "f", '{"a": 1.5}', ["x"]), (1, 5, "z", "f", "{", ["y", "x", "none"]),
             (1, 7, "p", "f", '{"a": 1}', ["q"]), (1, 8, "q", "f", '{"a": 1}', ["p"]), (1, 9, "x", "g", "{}", None),
             (2, 1, None, "f", '{"a": NaN}', None), (2, 1, "x", "f", None, ["x2"]), (1, 1, "x", "f", '{"b": 1, "a": 2}', None)]
    results = [(1, 4, "x", "second"), (1, 2, "x", "first é"), (1, 6, "lost", "r"), (None, 1, "x", "r"), (2, 2, "x", None)]
    got = toolcalls.linked_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schema).collect()
    rows = {(r.conv_id, r.call_id, r.status, r.turn): r for r in got}
    assert len(got) == len(calls) + 2
    x = rows[(1, "x", "linked", 1)]
    assert x.json == '{"arguments":{"a":2,"b":1},"errors":[],"id":"x","name":"f","result":"first é","status":"linked","turn":1}'
    assert (x.level, x.position, x.n_results) == (0, 0, 2)
    assert rows[(1, "y", "unanswered", 3)].errors == ["$.a: not integer"] and rows[(1, "y", "unanswered", 3)].level == 1
    assert rows[(1, "z", "unanswered", 5)].level == 2 and rows[(1, "z", "unanswered", 5)].errors == ["$: no JSON"]
    assert rows[(1, "p", "unanswered", 7)].level is None and "needs form a cycle" in rows[(1, "p", "unanswered", 7)].errors
    assert rows[(1, "x", "repeated", 9)].errors == ["unknown tool"] and rows[(1, "x", "repeated", 1)].n_results == 0
    assert rows[(1, "lost", "orphan", 6)].level is None and rows[(2, "x", "linked", 1)].level == 0
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(8))
    first = [r.call_id for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)]
    assert first.index("x") < first.index("y") < first.index("z") and first[-1] == "lost"
    for r in got:
        assert toolcalls.canonical(json.loads(r.json)) == r.json


def test_levels_of_a_long_chain(spark):
    chain = [(7, f"c{k}", [f"c{k - 1}"] if k else None) for k in range(1000)]
    other = [(8, "a", ["b"]), (8, "b", ["a"]), (8, "c", ["a"]), (8, "d", ["d"]), (8, "e", []), (None, "x", ["y"]), (9, None, ["e"])]
    df = spark.createDataFrame(chain + other, "conv_id long, call_id string, needs array<string>")
    got = {(x.conv_id, x.call_id): x.level for x in toolcalls.levels(df.where("conv_id is not null and call_id is not null")).collect()}
    assert all(got[(7, f"c{k}")] == k for k in range(1000))
    assert [got[(8, c)] for c in "abcde"] == [None, None, None, None, 0] and len(got) == 1005
    conversations = spark.createDataFrame(
        [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(600)], "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.derived(conversations)
    each = F.when(F.col("turn") > 1, F.array(F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string"))))
    made = toolcalls.linked_calls(calls.withColumn("needs", each), results).where("status <> 'orphan'").collect()
    assert sorted((r.level, r.turn) for r in made) == [(k, 2 * k + 1) for k in range(300)]


@pytest.mark.parametrize("held", [toolcalls.HELD, 3])
def test_levels_of_a_random_graph(spark, held):
    r = random.Random(5)
    calls = [(k % 3, f"c{k}", [f"c{j}" for j in range(k % 3, k, 3) if r.random() < 0.2]) for k in range(60)]
    want = {}
    for conv, c, needs in calls:
        want[(conv, c)] = 1 + max([want[(conv, d)] for d in needs], default=-1)
    df = spark.createDataFrame(calls, "conv_id long, call_id string, needs array<string>")
    assert {(x.conv_id, x.call_id): x.level for x in toolcalls.levels(df, held).collect()} == want


def test_positions_of_a_large_group(spark):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, null, id % 2) AS g", "hash(id) AS v", "id")
    got = toolcalls.positions(df.repartition(6), ["g"], [F.col("v"), F.col("id")]).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.g].append((x.v, x.id, x.position))
    assert sum(map(len, by.values())) == 3000
    for rows in by.values():
        assert [p for *_, p in sorted(rows)] == list(range(len(rows)))


@pytest.mark.parametrize("ids", [[7], [7, None]])
def test_rows_of_one_id_are_drawn_one_by_one(spark, ids):
    rows = [(ids[i % len(ids)], f"w {i % 3}", "A") for i in range(1000)] + [(i + 10, "x y", "A") for i in range(1000)]
    rows += [(i + 5000, "z z", "B") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.pareto_mix(df, mixing.n_words()).where("source = 'A'").collect()
    assert abs(sum(r.mix_size * r.mix_copies for r in got) - got[0].mix_target) <= 2
    of_one = [r.mix_copies for r in got if r.doc_id in ids]
    assert len(of_one) == 1000 and len(set(of_one)) == 2
    again = mixing.pareto_mix(df.repartition(3), mixing.n_words()).where("source = 'A'").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_rules_and_reputation(spark):
    urls = ["http://EXAMPLE.com/en/x?a", "https://www.example.com/en/", "x://b.net/es/1#2", "http://net/fr/", "http://com", "nothing", None,
            "a://b://c.com/x", "http://example.com/de", "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in hosts.judged(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("b.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c.com/x", None, "allow"),
        ("example.com", "/de", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow")]
    rows = [(f"s{i}.bad.org", 1) for i in range(4) for _ in range(40)] + [(f"h{i}.good.org", int(k == 0)) for i in range(40) for k in range(10)]
    rows += [("tiny.bad.org", 1), ("tiny.good.org", 1)]
    got = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["s1.bad.org"].bound > 0.8 and got["h1.good.org"].bound < 0.2
    assert got["tiny.bad.org"].rate > got["tiny.good.org"].rate and got["tiny.good.org"].bound < 0.5
    names = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.com:80",), ("1.2.3.4",), ("local",)], "host string")
    assert {r.host: (r.suffix, r.domain) for r in hosts.levels(names).collect()} == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:80": ("com", "x.com"),
        "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "local": ("local", "local")}


def test_hosts_without_labels_take_their_nearest_labelled_level(spark):
    urls = [f"http://h{i % 5}.bad.org/" for i in range(200)] + [f"http://h{i % 5}.good.org/" for i in range(200)]
    urls += [f"http://h{i % 5}.worse.net/" for i in range(200)]
    labels = [(i, int(i < 200 or i >= 400)) for i in range(600)]
    urls += ["http://new.bad.org/", "http://new.good.org/", "http://new.net/", "http://new.info/", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame(labels, "page_id long, bad int")
    got = {r.host: r for r in hosts.judged(pages, outcomes, rules=[]).collect()}
    top, (suffix, domain, host) = hosts.level_rates(
        pages.join(outcomes, "page_id").select(hosts.url_parts(F.col("url"))[0].alias("host"), "bad"))
    by = {r.domain: r.bound for r in domain.collect()} | {r.suffix: r.bound for r in suffix.collect()}
    assert got["new.bad.org"].bound == by["bad.org"] > 0.9 and got["new.good.org"].bound == by["good.org"] < 0.1
    assert got["new.net"].bound == by["net"] > 0.9 and got["new.info"].bound == top[1] > 0.6
    assert [got[x].verdict for x in ("new.bad.org", "new.good.org", "new.net", "new.info", "")] == [
        "block", "allow", "block", "block", "allow"]
    assert got["new.bad.org"].labelled == 0 and got["h1.bad.org"].labelled == 40 and got[""].bound == 0


def test_documents_have_the_columns_that_stages_need():
    assert len(full(documents(1, 3))[0]) == 5
