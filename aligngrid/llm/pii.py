"""PII: candidates from high-recall generators, boosted trees over format and context, calibrated thresholds.

Only DataFrame and SQL functions work here. Base patterns find emails, addresses, cards and phones and stay as they are. Generators
propose more: digit runs inside longer ones (at borders of groups and, in long unbroken runs, anywhere), phones without a country, emails in words, long tokens. Every candidate gets
features of its format (lengths, shares of characters, check digit) and context (the characters and cue words around it).
Gradient-boosted trees (MLlib) are fitted to labelled texts made by rules from a bounded number of seeds; on held-out rows the
lowest threshold that reaches the wanted precision is taken for each kind. The trees become one SQL expression, so
candidates are found, scored and chosen inside the row of their document: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm.common import cut, fresh, table

#: The base patterns (possessive where that can't change a match, so long runs cost linear time), the kinds in
#: their order, and the generators. `\G` lets a match begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])[0-9]{12,19}+(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+",
}
#: Cards inside a longer run of digits have thresholds of their own: from border to border of its groups, and in one long group.
INNER = ["subcard", "window"]
CARD_DIGITS = range(12, 20)
KINDS = ["email", "ip", "card", "phone", "secret"]
#: A text without any of these has no candidate.
HINT = r"[0-9@]|[\[(]at[\])]"
CUES = {"secret": "token|secret|passw|pwd|api.?key|auth|bearer|credential", "card": "card|visa|iban|account|pay",
        "phone": "phone|tel|fax|call|mobil", "trace": "commit|sha|hash|rev|build|order|invoice|isbn|file|path|http"}
#: Seeds of labelled texts, the share of them that is held out, and the precision that a threshold must reach there.
TRAIN_ROWS, HELD_OUT, PRECISION = 12_000, 0.3, 0.98
TREES, DEPTH = 20, 5
CONTEXT = 24


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, kind: str, text: str) -> str:
    """SQL: array<struct<s int, e int, k string, v string>> of the matches, in code points, from what stands between them."""
    p = _lit(pattern)
    empty = "cast(array() as array<struct<s:int,e:int,k:string,v:string>>)"
    return f"""CASE WHEN {text} RLIKE {_lit(HINT)} THEN aggregate(
      zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1),
        (v, g) -> named_struct('v', v, 'g', char_length(g))),
      named_struct('at', 0, 'out', {empty}),
      (acc, x) -> if(x.v IS NULL, acc, named_struct('at', acc.at + x.g + char_length(x.v), 'out', concat(acc.out, array(
        named_struct('s', acc.at + x.g, 'e', acc.at + x.g + char_length(x.v), 'k', '{kind}', 'v', x.v))))),
      acc -> acc.out) ELSE {empty} END"""


def _inner(text: str) -> str:
    """SQL: the sub-runs of 12 to 19 digits that pass the check: those between borders of groups (they may overlap), and all of
    an unbroken run of 20 digits or more."""
    empty = "cast(array() as array<struct<s:int,e:int,k:string,v:string>>)"
    grouped, windows = [], []
    for n in CARD_DIGITS:
        p = _lit(rf"(?<![0-9])(?=([0-9](?:[\x20-]?[0-9]){{{n - 1}}})(?![0-9]))[0-9]")  # takes one digit, so matches overlap
        grouped.append(f"""aggregate(zip_with(regexp_extract_all({text}, {p}, 1), split({text}, {p}, -1),
            (v, g) -> named_struct('v', v, 'g', char_length(g))), named_struct('at', 0, 'out', {empty}),
          (acc, x) -> if(x.v IS NULL, acc, named_struct('at', acc.at + x.g + 1, 'out', if(
            x.v RLIKE '[ -]' AND luhn_check({_DIGITS}), concat(acc.out, array(named_struct('s', acc.at + x.g,
              'e', acc.at + x.g + char_length(x.v), 'k', '{INNER[0]}', 'v', x.v))), acc.out))), acc -> acc.out)""")
        windows.append(f"""filter(transform(regexp_extract_all(x.v, '(?=([0-9]{{{n}}}))[0-9]', 1), (w, i) -> named_struct(
            's', x.s + i, 'e', x.s + i + {n}, 'k', '{INNER[1]}', 'v', w)), y -> luhn_check(y.v))""")
    long = _spans("(?<![0-9])[0-9]{20,}+", INNER[1], text)
    return f"""CASE WHEN {text} RLIKE '[0-9](?:[ -]?[0-9]){{12}}' THEN concat({", ".join(grouped)},
      flatten(transform({long}, x -> concat({", ".join(windows)})))) ELSE {empty} END"""


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND try_cast(concat('0', ltrim('0', p)) AS int) <= 255)",
    "card": f"char_length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"char_length({_DIGITS}) BETWEEN 9 AND 15",
}


def base_spans(text: str) -> str:
    """SQL: the valid matches of the base patterns, kind after kind."""
    return "concat(" + ", ".join(f"filter({_spans(BASE[k], k, text)}, x -> {_VALID[k]})" for k in BASE) + ")"


def _share(pattern: str) -> str:
    return f"regexp_count(x.v, '{pattern}') / cast(char_length(x.v) AS double)"


#: SQL of the features of a candidate `x` (s, e, k, v, b: the characters before, a: those after).
FEATURES = [
    *[f"if(x.k = '{k}', 1.0D, 0.0D)" for k in ("card", "phone", "email", "secret", *INNER)],
    "if(x.v RLIKE '^([0-9]{4}[ -]?){3}[0-9]{4}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$', 1.0D, 0.0D)",
    "if(x.v RLIKE '^(4|5[1-5]|3[47]|6011)', 1.0D, 0.0D)",
    "cast(char_length(x.v) AS double)", "cast(regexp_count(x.v, '[0-9]') AS double)", _share("[0-9]"), _share("[a-z]"),
    _share("[A-Z]"), _share("[0-9a-fA-F]"), _share("[aeiouAEIOU]"), _share("[_/+-]"),
    "size(array_distinct(split(x.v, ''))) / cast(char_length(x.v) AS double)",
    f"if(char_length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check(if({_DIGITS} = '', '1', {_DIGITS})), 1.0D, 0.0D)",
    "cast(regexp_count(x.v, '[0-9](?=[a-zA-Z])') AS double)", "if(x.b RLIKE '[=:]\\\\s*[\"\\']?$', 1.0D, 0.0D)",
    "if(x.b RLIKE '[\"\\']$', 1.0D, 0.0D)", "if(x.a RLIKE '^[\"\\']', 1.0D, 0.0D)",
    "if(x.b RLIKE '[A-Za-z0-9./@-]$', 1.0D, 0.0D)", "if(x.a RLIKE '^[A-Za-z0-9/@-]', 1.0D, 0.0D)",
    *[f"if(x.b RLIKE '(?i)({cue})[^A-Za-z]*$', 1.0D, 0.0D)" for cue in CUES.values()],
    *[f"if(x.b RLIKE '(?i)({cue})', 1.0D, 0.0D)" for cue in CUES.values()],
]


def candidates(text: str) -> str:
    """SQL: the generators' matches with their context and features: struct<s, e, k, v, b, a, f array<double>>."""
    found = "concat(" + ", ".join(_spans(p, k, text) for k, p in GENERATORS.items()) + f", {_inner(text)})"
    around = (f"transform({found}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', x.v, "
              f"'b', substring({text}, greatest(x.s - {CONTEXT}, 0) + 1, least(x.s, {CONTEXT})), "
              f"'a', substring({text}, x.e + 1, 4)))")
    return (f"transform({around}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'f', array({', '.join(FEATURES)})))")


def _tree_sql(node) -> str:
    """SQL of a fitted tree over the features `x.f`."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (f"CASE WHEN x.f[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild())} "
            f"ELSE {_tree_sql(node.rightChild())} END")


def training_texts(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """(seed, text, truth array<string>): made texts and the values in them that are personal, by rules on a hash of the seed."""
    h = lambda salt: f"md5(concat('{salt}', seed))"
    num = lambda salt, m: f"cast(conv(substring({h(salt)}, 1, 8), 16, 10) AS bigint) % {m}"
    word = lambda salt: f"translate(substring({h(salt)}, 1, 3 + cast({num(salt, 9)} AS int)), '0123456789', 'oeaituntle')"
    digits = lambda salt, n: f"rpad(translate(concat({h(salt)}, {h(salt + 'x')}), 'abcdef', '284071'), {n}, '0')"
    long = f"upper({word('w1')}) || {word('w2')} || {word('w3')} || {word('w4')}"
    mixed = f"translate({h('m')}, '0a3c5e', 'XzQ8Wk')"
    size = f"cast(16 + {num('n', 33)} AS int)"
    hexed = f"substring(concat({h('a')}, {h('b')}), 1, {size})"
    number = digits("c", f"cast(12 + {num('l', 8)} AS int)")
    # The last digit is replaced by the one that passes the check.
    body = f"substring({number}, 1, char_length({number}) - 1)"
    valid = f"concat({body}, filter(array('0','1','2','3','4','5','6','7','8','9'), d -> luhn_check(concat({body}, d)))[0])"
    wrong = f"concat({body}, filter(array('0','1','2','3','4','5','6','7','8','9'), d -> NOT luhn_check(concat({body}, d)))[0])"
    def other(salt: str) -> str:  # a number that fails the check
        start = digits(salt, 15)
        return f"concat({start}, filter(array('0','1','2','3'), d -> NOT luhn_check(concat({start}, d)))[0])"

    phone = f"concat('(', {digits('p', 3)}, ') ', {digits('q', 3)}, '-', {digits('r', 4)})"
    cue = f"element_at(array('token', 'password', 'secret', 'api_key', 'auth_token', 'PASSWORD', 'Bearer'), cast({num('u', 7)} + 1 AS int))"
    sign = f"element_at(array(' = \"', '=', ': ', '=\"', ' '), cast({num('s', 5)} + 1 AS int))"
    trace = f"element_at(array('commit ', 'sha ', 'build-', 'file/', 'rev:', 'hash=', 'order '), cast({num('t', 7)} + 1 AS int))"
    kinds = [  # (value, what stands before it, personal)
        (hexed, f"concat({cue}, {sign})", True), (mixed, f"concat({cue}, {sign})", True), (hexed, f"concat({cue}, {sign})", True),
        (valid, "''", True), (valid, "'card '", True), (valid, f"concat({other('o')}, ' ')", True),
        (phone, "''", True), (f"replace(replace({phone}, '(', ''), ') ', '-')", "'tel '", True),
        (f"concat({word('e')}, ' [at] ', {word('f')}, '.com')", "''", True),
        (wrong, "''", False), (wrong, "'order '", False), (hexed, trace, False),
        (long, "''", False), (f"concat({long}, '-', {num('y', 99)})", f"concat({word('z')}, '/')", False),
        (f"concat({word('i')}, '_', {word('j')}, '_', {word('k')}, '_', {num('g', 999)})", "''", False),
        (f"concat({num('v', 90)}, ' ', {digits('d', 3)}, ' ', {digits('h', 3)}, ' ', {digits('w', 3)})", "''", False),
    ]
    # Every sixth text is about cards beside other digits: grouped ones, lists of numbers, long runs.
    start = f"element_at(array('4', '51', '55', '6011', '37', '34'), cast({num('is', 6)} + 1 AS int))"
    begun = f"rpad(concat({start}, {digits('gc', 14)}), if({start} LIKE '3%', 14, 15), '0')"
    issued = f"concat({begun}, filter(array('0','1','2','3','4','5','6','7','8','9'), d -> luhn_check(concat({begun}, d)))[0])"
    dash = f"element_at(array(' ', ' ', '-'), cast({num('da', 3)} + 1 AS int))"
    group = (f"if({start} LIKE '3%', concat(substring({issued}, 1, 4), {dash}, substring({issued}, 5, 6), {dash}, substring({issued}, 11)), "
             f"concat_ws({dash}, substring({issued}, 1, 4), substring({issued}, 5, 4), substring({issued}, 9, 4), substring({issued}, 13)))")
    named = f"element_at(array('card ', 'visa ', 'pay ', '', 'account: '), cast({num('cn', 5)} + 1 AS int))"
    date = f"concat(' ', lpad({num('mm', 12)} + 1, 2, '0'), '/', {num('yy', 20)} + 20)"
    listed = " || ' ' || ".join(digits(f"n{i}", f"cast(3 + {num(f'm{i}', 3)} AS int)") for i in range(8))
    fours = " || ' ' || ".join(digits(f"f{i}", 4) for i in range(7))
    near = [  # (value, before, after, personal)
        (group, named, date, True), (group, named, f"concat(' ', {digits('cv', 3)})", True),
        (group, f"concat({digits('nb', 2)}, ' ')", date, True), (group, named, f"concat('-', {digits('nc', 5)})", True),
        (listed, "''", "''", False), (fours, "''", "''", False),
        (issued, f"concat({named}, {digits('lb', 7)})", digits("la", 6), True), (digits("lr", 32), "'id '", "''", False)]
    at = f"cast({num('near', len(near))} AS int)"
    chosen = lambda j: f"CASE {at} " + " ".join(f"WHEN {i} THEN {x[j]}" for i, x in enumerate(near)) + " END"
    pick = f"cast({num('kind', len(kinds))} AS int)"
    value = f"CASE {pick} " + " ".join(f"WHEN {i} THEN {v}" for i, (v, _, _) in enumerate(kinds)) + " END"
    before = f"CASE {pick} " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b, _) in enumerate(kinds)) + " END"
    personal = f"CASE {pick} " + " ".join(f"WHEN {i} THEN {str(t).lower()}" for i, (_, _, t) in enumerate(kinds)) + " END"
    made = spark.range(rows).selectExpr("cast(id AS string) AS seed").selectExpr(
        "seed", f"{value} AS value", f"{before} AS before", f"{personal} AS personal")
    quote = "if(before LIKE '%\"', '\"', '')"
    more = f"if(personal AND value RLIKE '^[0-9]+$' AND {num('more', 3)} = 0, concat(' ', {other('o2')}), '')"
    made = made.selectExpr("seed", "value", "before", f"concat({quote}, {more}) AS after", "personal", f"{num('beside', 6)} = 0 AS beside")
    made = made.selectExpr("seed", *[f"if(beside, {chosen(j)}, {c}) AS {c}" for j, c in enumerate(("value", "before", "after", "personal"))])
    return made.selectExpr(
        "seed", f"concat({word('l1')}, ' ', {word('l2')}, '. ', before, value, after, ' ', {word('r1')}, ', ', {word('r2')}) AS text",
        "if(personal, value, null) AS truth")


def fitted(spark: SparkSession, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> tuple[str, dict[str, float]]:
    """The trees as an SQL expression of `x.f` (a probability), and the threshold of each kind.

    A kind whose held-out candidates never reach the precision has the threshold 2: it adds nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    texts = training_texts(spark, rows)
    each = texts.selectExpr("seed", "text", "truth", f"explode({candidates('text')}) AS x")
    each = cut(each.selectExpr(
        "x.k AS k", "x.f AS f", f"pmod(xxhash64(seed), 1000) < {int(HELD_OUT * 1000)} AS held",
        "cast(coalesce(substring(text, x.s + 1, x.e - x.s) = truth, false) AS double) AS label").coalesce(4))
    train = each.where("not held").select(array_to_vector("f").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(train)
    margin = " + ".join(f"{w!r}D * ({_tree_sql(t._java_obj.rootNode())})" for w, t in zip(model.treeWeights, model.trees))
    score = f"1 / (1 + exp(-2 * ({margin})))"
    bins = (each.where("held").selectExpr("k", "label", "named_struct('f', f) AS x")
            .selectExpr("k", "label", f"floor({score} * 100) / 100 AS p").groupBy("k", "p")
            .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect())  # at most 101 rows a kind
    limits = {}
    for kind in [*GENERATORS, *INNER]:
        good = n = 0
        limits[kind] = 2.0
        for row in sorted((r for r in bins if r["k"] == kind), key=lambda r: -r["p"]):
            good, n = good + row["good"], n + row["n"]
            if good >= precision * n:
                limits[kind] = max(float(row["p"]), 0.5)
    return score, limits


def personal_spans(df: DataFrame, text: str = "text", *, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> DataFrame:
    """`df` with `pii`: array<struct<s int, e int, k string, base boolean>>, by start, kind and end, in code points.

    Base spans are always there. Of the candidates at or above the threshold of their kind, those inside a base span or inside a
    larger accepted candidate (or one of the same place and an earlier kind) add nothing and are left out. Null and empty texts have no spans; equal rows get equal
    spans; an empty table gives an empty result; a column `pii` of `df` is replaced. The model depends on the
    parameters only, not on `df`.
    """
    score, limits = fitted(df.sparkSession, rows, precision)
    limit = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in limits.items()) + " ELSE 2D END"
    order = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    whole, base, found = (fresh(x, df) for x in ("_whole", "_base", "_found"))
    out = df.drop("pii").withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(base, F.expr(base_spans(whole))).withColumn(found, F.expr(candidates(whole)))
    inner = ", ".join(f"'{k}'" for k in INNER)
    out = out.withColumn(found, F.expr(f"transform(filter({found}, x -> {score} >= {limit}), x -> named_struct("
                                       f"'s', x.s, 'e', x.e, 'k', if(x.k IN ({inner}), 'card', x.k)))"))
    inside = "(o.s <= x.s AND o.e >= x.e)"
    out = out.withColumn(found, F.expr(f"""filter({found}, (x, i) -> NOT exists({base}, o -> {inside})
        AND NOT exists({found}, o -> {inside} AND (o.e - o.s > x.e - x.s OR {order.replace("x.", "o.")} < {order})))"""))
    rows_of = lambda name, sure: (f"transform({name}, x -> named_struct('s', x.s, 'o', {order}, 'e', x.e, 'k', x.k, "  # noqa: E731
                                  f"'base', {sure}))")
    return out.withColumn("pii", F.expr(
        f"transform(array_sort(array_distinct(concat({rows_of(base, 'true')}, {rows_of(found, 'false')}))), "
        "x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'base', x.base))")).drop(whole, base, found)


def digest(spans: str) -> str:
    """SQL: `kind:start:end` of the spans, joined by commas."""
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def redacted(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """`df` with its personal spans replaced by the kind in brackets; spans that overlap become one, of the first kind."""
    found = personal_spans(df, text, **how)
    joined = """aggregate(pii, cast(array() AS array<struct<s:int,e:int,k:string>>), (acc, x) ->
        if(size(acc) > 0 AND element_at(acc, -1).e > x.s,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s,
                  'e', greatest(element_at(acc, -1).e, x.e), 'k', element_at(acc, -1).k))),
           concat(acc, array(named_struct('s', x.s, 'e', x.e, 'k', x.k)))))"""
    pieces = f"""aggregate({joined}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (acc, x) -> named_struct(
        'at', x.e, 'out', concat(acc.out, array(substring(`{text}`, acc.at + 1, x.s - acc.at), concat('[', upper(x.k), ']')))),
        acc -> concat(array_join(acc.out, ''), substring(`{text}`, acc.at + 1)))"""
    return found.withColumn(text, F.expr(f"if(size(pii) = 0, `{text}`, {pieces})")).select(*df.columns)


def counted(df: DataFrame) -> DataFrame:
    """The digest columns of rows with doc_id and pii."""
    n = lambda kind: f"cast(size(filter(pii, x -> x.base AND x.k = '{kind}')) AS bigint) AS n_{kind}"
    return df.selectExpr("doc_id", *[n(k) for k in BASE], f"sha2({digest('filter(pii, x -> x.base)')}, 256) AS base_sha256",
                         f"{digest('pii')} AS spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal spans of every document."""
    return counted(personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op3_pii": op3_pii}
