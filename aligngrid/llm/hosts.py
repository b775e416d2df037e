"""URL filters: host rules, and host reputation by empirical Bayes, in DataFrame functions only.

Labelled pages give each host a number of pages and of bad ones. The rate of a host is shrunk towards that of its registered
domain, that towards its public suffix, and that towards the whole: each level has a beta prior whose mean is the posterior
mean of the level above and whose strength is fitted to the spread of the children around their parents (moments of the
beta-binomial). A host without labelled pages has the rate and the bound of its nearest labelled level. A host is blocked when the lower posterior bound of its bad rate lies above a limit, so a few bad
pages of a small host weigh little and many weigh much.

Counts are combined before the shuffle, so a hot host costs one row a task. Fitting collects two numbers a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.llm.common import cut, fresh, table

#: The rules of the registered query, as (verdict, host/path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
                      "com.br", "com.cn", "com.mx", "co.in", "co.nz", "co.za", "com.tr", "co.kr"]
#: A host is blocked above this lower bound of its bad rate; the bound is so many standard deviations below the mean.
LIMIT, DEVIATIONS = 0.4, 1.645
#: Larger tables of hosts are joined by a shuffle.
BROADCAST_HOSTS = 100_000
LEVELS = ["suffix", "domain", "host"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(df: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """`df` with host, path, `rule` (null: none fits) and `rule_verdict`. The longest rule wins, then the first by name.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a list that a person writes.
    """
    host, path = url_parts(F.col(url).cast("string"))
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "rule_verdict")]
    out = df.select(*own, host.alias("host"), path.alias("path"))
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, prefix = text.partition("/")
        fits = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit("." + at))) & F.startswith(
            F.col("path"), F.lit("/" + prefix))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    empty = F.lit(None).cast("string")
    return out.withColumn("rule", empty if rule is None else rule).withColumn(
        "rule_verdict", empty if verdict is None else verdict)


def levels(df: DataFrame) -> DataFrame:
    """`df` (host) with its public suffix and registered domain; a number or a single label is its own of both."""
    name = F.regexp_replace("host", r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    long = F.size(labels) >= 2
    suffix = F.when(~long | name.rlike(r"^[0-9.]+$"), name).when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(
        F.element_at(labels, -1))
    width = F.size(F.split("suffix", r"\.")) + 1
    domain = F.when(F.col("suffix") == name, name).when(F.size(labels) <= width, name).otherwise(
        F.array_join(F.expr(r"slice(_labels, -_width, _width)"), "."))
    return (df.withColumn("suffix", suffix).withColumn("_labels", labels).withColumn("_width", width)
            .withColumn("domain", domain).drop("_labels", "_width"))


def level_rates(outcomes: DataFrame, deviations: float = DEVIATIONS) -> tuple[tuple[float, float], list[DataFrame]]:
    """(rate, bound) of the whole, and (names of the level and those above, n, k, rate, bound) of each of LEVELS, from (host, bad 0/1)
    rows."""
    hosts = cut(levels(outcomes.where("bad is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))))
    whole = hosts.agg(F.sum("n"), F.sum("k")).first()
    pages, bad = whole[0] or 0, whole[1] or 0
    mean = (bad + 0.5) / (pages + 1.0)
    top = mean, max(0.0, mean - deviations * (mean * (1 - mean) / (pages + 2.0)) ** 0.5)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))
    bound = F.greatest(F.lit(0.0), F.col("rate") - deviations * deviation)
    parents, above, out = None, None, []
    for level in LEVELS:
        keys = LEVELS[:LEVELS.index(level) + 1]
        rows = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parents is None:
            rows = rows.withColumn("prior", F.lit(mean))
        else:
            rows = rows.join(parents.select(*above, F.col("rate").alias("prior")), above)
        rows = cut(rows)
        m = F.col("prior") * (1 - F.col("prior"))
        spread = F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * m
        sums = rows.agg(F.sum(spread), F.sum(F.col("n") * (F.col("n") - 1) * m)).first()
        rho = min(max(sums[0] / sums[1], 0.001), 0.999) if sums[1] else 0.5
        strength = 1 / rho - 1
        rows = rows.withColumn("total", F.col("n") + strength).withColumn(
            "rate", (F.col("k") + strength * F.col("prior")) / F.col("total"))
        parents, above = rows, keys
        out.append(rows.select(*keys, "n", "k", "rate", bound.alias("bound")))
    return top, out


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, labelled, bad, rate, bound) of (host, bad 0/1) rows; rows without an outcome don't count.

    rate: posterior mean; bound: `deviations` standard deviations below it, 0 at least.
    """
    return level_rates(outcomes, deviations)[1][-1].select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), "rate",
                                                           "bound")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else rows


def rated_hosts(hosts: DataFrame, outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, labelled, rate, bound) of every row of `hosts` (host): of a host without outcomes those of its registered domain, else
    of its suffix, else of the whole."""
    top, rates = level_rates(outcomes, deviations)
    out = levels(hosts)
    for i, rows in enumerate(rates):
        keys = LEVELS[:i + 1]
        n = [F.col("n").alias("labelled")] if keys[-1] == "host" else []
        rows = rows.select(*keys, *n, F.struct("rate", "bound").alias(f"_{keys[-1]}"))
        out = out.join(_small(rows), keys, "left")
    best = F.coalesce("_host", "_domain", "_suffix", F.struct(F.lit(top[0]).alias("rate"), F.lit(top[1]).alias("bound")))
    return out.select("host", F.coalesce("labelled", F.lit(0).cast("long")).alias("labelled"), best.rate.alias("rate"),
                      best.bound.alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url: str = "url",
           rules: list[tuple[str, str]] = RULES, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """`pages` with host, path, rule, verdict, labelled (pages of the host) and bound.

    outcomes: (id_col, bad boolean or 0/1); a page is bad if one of its outcomes is. The verdict is the rule's, else `block`
    where the lower bound of the host's bad rate is above `limit`, else `allow`. A host without a labelled page has the bound of
    its registered domain, else of its suffix, else of the whole. An empty host is allowed. Repeated pages are judged alike and
    count each; an empty table gives an empty result; columns of `pages` named as the new ones are replaced.
    """
    own = pages.drop("verdict", "labelled", "bound", "host", "path", "rule", "rule_verdict")
    parts = with_rules(own, url, rules)
    label = outcomes.select(F.col(id_col).alias("_id"), F.col("bad").cast("int").alias("bad")).groupBy("_id").agg(
        F.max("bad").alias("bad"))
    known = parts.select("host", F.col(id_col).alias("_id")).where("host <> ''").join(label, "_id")
    name = fresh("_host", parts)
    rated = rated_hosts(parts.where("host <> ''").select("host").distinct(), known, deviations)
    rated = cut(rated.select(F.col("host").alias(name), "labelled", "bound"))
    out = parts.join(_small(rated), parts.host == F.col(name), "left").drop(name)
    own_verdict = F.when(F.coalesce("bound", F.lit(0.0)) > limit, "block").otherwise("allow")
    return out.select(*own.columns, "host", "path", "rule",
                      F.coalesce("rule_verdict", own_verdict).alias("verdict"),
                      F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bound", F.lit(0.0)).alias("bound"))


def op8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page; outcomes are the quality labels of the page numbers."""
    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "quality = 0 AS bad")
    out = judged(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict", "labelled", F.round("bound", 4).alias("bound"))


def _level_sql(keys: list[str], above: str) -> str:
    name = keys[-1]
    group = ", ".join(keys)
    prior = "(SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM hosts)" if not above else "p.rate"
    join = f"JOIN {above} p USING ({', '.join(keys[:-1])})" if above else ""
    return f"""
{name}_sums AS (SELECT c.*, {prior} AS prior FROM
  (SELECT {group}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY {group}) c {join}),
{name}_fit AS (SELECT 1 / CASE WHEN d IS NULL OR d = 0 THEN 0.5 ELSE least(greatest(s / d, 0.001), 0.999) END - 1 AS strength
  FROM (SELECT sum((k - n * prior) * (k - n * prior) - n * prior * (1 - prior)) AS s,
               sum(n * (n - 1) * prior * (1 - prior)) AS d FROM {name}_sums)),
{name}_rate AS (SELECT {group}, n, n + strength AS total, (k + strength * prior) / (n + strength) AS rate
  FROM {name}_sums, {name}_fit)"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_RULE = "CASE " + " ".join(
    f"WHEN (host = '{t.partition('/')[0]}' OR host LIKE '%.{t.partition('/')[0]}') AND path LIKE '/{t.partition('/')[2]}%'"
    f" THEN '{k}|{t}'" for k, t in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))) + " END"
ORACLE = {"op8_hosts": f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
marked AS (SELECT *, {_RULE} AS hit FROM parts),
label AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL
  GROUP BY doc_id),
counted AS (SELECT host, count(*) AS n, sum(bad) AS k FROM parts JOIN label ON doc_id = page_id WHERE host <> ''
  GROUP BY host),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name,
  string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM (SELECT DISTINCT host FROM parts WHERE host <> '')),
tailed AS (SELECT *, CASE WHEN len(labels) < 2 OR regexp_matches(name, '^[0-9.]+$') THEN name
  WHEN labels[-2] || '.' || labels[-1] IN ({_TWO}) THEN labels[-2] || '.' || labels[-1] ELSE labels[-1] END AS suffix
  FROM named),
placed AS (SELECT host, suffix, CASE WHEN suffix = name OR len(labels) <= len(string_split(suffix, '.')) + 1 THEN name
  ELSE array_to_string(labels[len(labels) - len(string_split(suffix, '.')):], '.') END AS domain FROM tailed),
hosts AS (SELECT * FROM placed JOIN counted USING (host)),
{_level_sql(["suffix"], "")}, {_level_sql(["suffix", "domain"], "suffix_rate")},
{_level_sql(["suffix", "domain", "host"], "domain_rate")},
whole AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS rate, coalesce(sum(n), 0) + 1.0 AS total FROM hosts),
nearest AS (SELECT p.host, coalesce(h.n, 0) AS labelled, coalesce(h.rate, d.rate, s.rate, w.rate) AS rate,
    coalesce(h.total, d.total, s.total, w.total) AS total
  FROM placed p CROSS JOIN whole w LEFT JOIN host_rate h ON h.host = p.host
  LEFT JOIN domain_rate d ON d.suffix = p.suffix AND d.domain = p.domain LEFT JOIN suffix_rate s ON s.suffix = p.suffix),
rated AS (SELECT host, labelled, greatest(0.0, rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (total + 1))) AS bound FROM nearest)
SELECT page_id, m.host, path, split_part(hit, '|', 2) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 1) WHEN coalesce(bound, 0) > {LIMIT} THEN 'block' ELSE 'allow' END
    AS verdict,
  CAST(coalesce(labelled, 0) AS BIGINT) AS labelled, round(coalesce(bound, 0.0), 4) AS bound
FROM marked m LEFT JOIN rated r ON m.host = r.host"""}

QUERIES = {"op8_hosts": op8_hosts}
