"""URL filters: fixed rules, and for the rest trust and distrust on the host graph.

Rules are ``(action, host, path)``: a rule fits its host and all subdomains if
the url's path starts with the rule's path; the longest fitting rule wins.

Where no rule fits, the host decides.  Each host starts with the shares of its
pages that rules allow, that rules block and that no rule fits.  Allowed and
open shares are propagated along links as personalised PageRank; blocked shares
go against the links, from a bad host to those that link to it.  A host is
blocked if distrust makes up more than ``threshold`` of what has reached it.

Edges are counted per pair of hosts, so a host with very many pages is one row;
rounds are joins and sums over the edge table, written after each round.  They
go on until no score of a host moves by more than ``TOLERANCE`` of itself, or
all moves still to come add up to less than ``TOLERANCE`` of what a host with a
single page starts with; an error ends them after ``MAX_ROUNDS``.  Without circles
of links this takes two rounds more than the longest chain has links, and in any
case about 150 rounds and 14 for each factor of ten in the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.llm.work import Cuts, table

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
#: What the SQL unrolls: the fixed point only where no walk along links is longer than 11, as in the given pages.
ROUNDS = 12
MAX_ROUNDS = 2000
THRESHOLD = 0.5
TOLERANCE = 1e-9

_UPPER = "".join(map(chr, range(65, 91)))
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower()),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The index of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][0] != "block", i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        _, h, p = rules[i]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(out)
    return out


def _of_rule(index: Column, values: list[str], none: Column) -> Column:
    out = none
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


def host_scores(pages: DataFrame, cuts: Cuts, rules=RULES, damping: float = DAMPING,
                max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(host, trust, distrust, plain)`` of every host with pages or links to it,
    at the fixed point of the propagation."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("url", "html").select(host.alias("host"), path.alias("path"), "html").where("host <> ''")
    linked = F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda u: F.translate(
        F.regexp_extract(u, "//([^/?#]*)", 1), _UPPER, _UPPER.lower()))
    edges = cuts.cut(seen.select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
                     .where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    out = edges.groupBy("src").agg(F.sum("n").alias("o"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("i"))
    edges = cuts.cut(edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("o")).alias("down"), (F.col("n") / F.col("i")).alias("up")))

    kind = _of_rule(F.col("r"), [r[0] for r in rules], F.lit("none"))
    own = (pages.select("url").select(host.alias("host"), path.alias("path")).where("host <> ''")
           .select("host", fitting_rule(F.col("host"), F.col("path"), rules).alias("r"))
           .groupBy("host").agg(*[F.count(F.when(kind == k, 1)).alias(n) for k, n in
                                  (("allow", "t"), ("block", "d"), ("none", "p"))]))
    total = own.agg(F.sum(F.col("t") + F.col("d") + F.col("p"))).first()[0] or 1
    own = own.select("host", *[(F.col(c) / F.lit(float(total))).alias(c) for c in "tdp"])
    others = edges.select(F.col("dst").alias("host")).distinct().join(own, "host", "left_anti").select(
        "host", *[F.lit(0.0).alias(c) for c in "tdp"])
    start = cuts.cut(own.unionByName(others))
    state = start
    keep = 1 - damping
    for _ in range(max_rounds):
        zero = F.lit(0.0)
        along = state.join(edges, F.col("host") == F.col("src")).select(
            F.col("dst").alias("h"), (F.col("t") * F.col("down")).alias("t"), zero.alias("d"),
            (F.col("p") * F.col("down")).alias("p"))
        against = state.join(edges, F.col("host") == F.col("dst")).select(
            F.col("src").alias("h"), zero.alias("t"), (F.col("d") * F.col("up")).alias("d"), zero.alias("p"))
        sums = along.unionByName(against).groupBy("h").agg(*[F.sum(c).alias(f"{c}2") for c in "tdp"])
        new = cuts.cut(start.join(sums, F.col("host") == F.col("h"), "left").select(
            "host", *[(F.col(c) * keep + F.coalesce(F.col(f"{c}2"), zero) * damping).alias(c) for c in "tdp"])
            .join(state.select(F.col("host").alias("h0"), *[F.col(c).alias(f"{c}0") for c in "tdp"]),
                  F.col("host") == F.col("h0"))
            .withColumn("moved", sum((F.abs(F.col(c) - F.col(f"{c}0")) for c in "tdp"), zero))
            .withColumn("share", F.greatest(*[F.when(F.col(c) > 0, F.abs(F.col(c) - F.col(f"{c}0")) / F.col(c))
                                              .otherwise(zero) for c in "tdp"]))
            .select("host", "t", "d", "p", "moved", "share"))
        moved, share = new.agg(F.sum("moved"), F.max("share")).first()
        if state is not start:
            cuts.drop(state)
        state = new.drop("moved", "share")
        state._cut_path = new._cut_path
        # all later moves together are at most moved * damping / keep
        if (share or 0.0) < TOLERANCE or moved * damping / keep < TOLERANCE * keep / total:
            break
    else:
        raise RuntimeError(f"link trust not settled after {max_rounds} rounds")
    return state.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"), F.col("p").alias("plain"))


def judge(pages: DataFrame, cuts: Cuts, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages``.

    Null urls and urls without ``://`` have no host and are allowed, unless a
    rule could fit (none fits the empty host); a null html has no links; a null
    id stays null; repeated rows count as pages of their own.  An empty table
    gives an empty result; other columns are not read.
    """
    scores = host_scores(pages, cuts, rules)
    bad = scores.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + F.col("plain"))) \
        .select(F.col("host").alias("__bad"))
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "r", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.join(bad, F.col("host") == F.col("__bad"), "left").select(
        "page_id", "host", "path",
        _of_rule(F.col("r"), [h + p for _, h, p in rules], F.lit(None).cast("string")).alias("rule"),
        _of_rule(F.col("r"), [a for a, _, _ in rules],
                 F.when(F.col("__bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Cuts(spark))


def _oracle(rounds: int = ROUNDS) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
                   for _, h, p in order)
    acts = "".join(f" WHEN '{h}{p}' THEN '{a}'" for a, h, p in order)
    link = _LINK.replace("'", "''")
    lower = f"'{_UPPER}', '{_UPPER.lower()}'"
    steps = "".join(f""",
x{k} AS MATERIALIZED (SELECT s.host,
  {1 - DAMPING} * s.t + {DAMPING} * coalesce((SELECT sum(x.t * e.down) FROM x{k - 1} x JOIN e ON e.src = x.host WHERE e.dst = s.host), 0) AS t,
  {1 - DAMPING} * s.d + {DAMPING} * coalesce((SELECT sum(x.d * e.up) FROM x{k - 1} x JOIN e ON e.dst = x.host WHERE e.src = s.host), 0) AS d,
  {1 - DAMPING} * s.p + {DAMPING} * coalesce((SELECT sum(x.p * e.down) FROM x{k - 1} x JOIN e ON e.src = x.host WHERE e.dst = s.host), 0) AS p
  FROM x0 s)""" for k in range(1, rounds + 1))
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN contains(coalesce(url, ''), '://')
    THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), {lower}) AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS MATERIALIZED (SELECT *, CASE{fits} END AS rule FROM parsed),
acted AS MATERIALIZED (SELECT *, CASE rule{acts} END AS act FROM ruled),
raw AS (SELECT host AS src, translate(regexp_extract(u, '//([^/?#]*)', 1), {lower}) AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS u FROM acted WHERE host <> '')),
cnt AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM raw WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS down, n / sum(n) OVER (PARTITION BY dst) AS up FROM cnt),
own AS (SELECT host, count(*) FILTER (act = 'allow') AS t, count(*) FILTER (act = 'block') AS d,
  count(*) FILTER (act IS NULL) AS p FROM acted WHERE host <> '' GROUP BY 1),
x0 AS MATERIALIZED (SELECT host, t / (SELECT sum(t + d + p) FROM own) AS t, d / (SELECT sum(t + d + p) FROM own) AS d,
  p / (SELECT sum(t + d + p) FROM own) AS p FROM own
  UNION ALL SELECT DISTINCT dst, 0.0, 0.0, 0.0 FROM cnt WHERE dst NOT IN (SELECT host FROM own)){steps}
SELECT a.page_id, a.host, a.path, a.rule,
  coalesce(a.act, CASE WHEN x.d > {THRESHOLD} * (x.t + x.d + x.p) THEN 'block' ELSE 'allow' END) AS verdict
FROM acted a LEFT JOIN x{rounds} x ON x.host = a.host
"""


OP6_SQL = _oracle()
