"""URL verdicts: rules first, then trust that spreads over edges between hosts.

A rule names a host and a path prefix; it fits the host and its subdomains, and
the longest rule that fits a URL decides. For URLs that no rule fits, hosts are
ranked on a graph of two kinds of edges: links from a page to another host, and
between a host and the domain that it belongs to, in both directions (a.b.example.org,
b.example.org, example.org), so that subdomains of one site share what is known of
it even where pages link only within their host. Domains end at registrable ones: names under
which anyone registers (SUFFIXES) join nobody. Personalised PageRank spreads trust
along edges from hosts with allowed pages, and distrust against edges from hosts with
blocked ones; a host is a seed by the share of its pages that rules allow or block, and scores
are times the sum of these shares. A host is blocked where its
distrust is above its trust and at least LEAST_DISTRUST.

Only hosts that a seed reaches take part. Both kinds spread in one iteration, the same
number of rounds in each Spark job for graphs of any size, until what is
still on its way is below TOLERANCE of all seeds' weight. What ends at a host without
edges goes back to the seeds, which is the same as letting the scores sum to 1.

Edge cases. A null URL, or one without "://", has an empty host and path, no rule
and the verdict allow. Null or empty HTML has no links. Hosts of one label, and
numeric addresses, have no domain above them. Null ids and repeated rows are judged
like any other row. An empty table gives an empty result. Input columns of any name
are allowed.
"""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, small_or_not, text_of

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, LEAST_DISTRUST = 0.85, 0.07
#: Names of two labels under which domains are registered; a single label always is one.
SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk sch.uk com.au edu.au gov.au id.au net.au org.au ac.jp co.jp go.jp ne.jp or.jp ac.nz co.nz govt.nz net.nz org.nz com.br gov.br net.br org.br ac.in co.in gov.in net.in org.in ac.za co.za gov.za org.za com.cn edu.cn gov.cn net.cn org.cn "
    "ac.kr co.kr go.kr or.kr com.mx gob.mx org.mx com.tr edu.tr gov.tr org.tr com.sg edu.sg gov.sg com.hk edu.hk org.hk com.tw edu.tw org.tw co.il ac.il org.il com.ar gob.ar org.ar com.pl edu.pl net.pl org.pl com.ua gov.ua com.my com.ph com.vn co.th ac.th co.id ac.id github.io gitlab.io blogspot.com wordpress.com web.app netlify.app vercel.app herokuapp.com appspot.com"
).split()
#: Mass that may still be on its way when PageRank ends, as a share of all seeds', rounds in a job, and rounds after which it raises.
TOLERANCE, ROUNDS_A_JOB, ROUNDS = 1e-4, 8, 1000
#: Moves of a graph that one task holds.
SMALL_GRAPH = 100_000
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, v)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of links between different hosts, from columns host and html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    return links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> '' and src <> dst").distinct()


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst) between each host (host) or domain above it and the next domain above, in both directions, up to the registrable domain."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    chain = hosts.where(F.col("host").rlike(r"^[^.]+(\.[^.]+)*\.[^.0-9][^.]*$")).select(F.explode(above).alias("src")).distinct()
    chain = chain.select("src", F.expr("substring(src, locate('.', src) + 1)").alias("dst")).where(F.contains("dst", F.lit(".")) & ~F.col("dst").isin(SUFFIXES) & ~F.col("src").isin(SUFFIXES))
    return chain.unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def spread(edges: DataFrame, seeds: DataFrame, tmp: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score): for each kind, settled personalised PageRank along its edges (kind, src, dst) from its seeds (kind, host, weight), which share 1 by weight.

    Hosts that no seed of the kind reaches are left out before it begins.
    """
    weights = {r["kind"]: r["w"] for r in seeds.groupBy("kind").agg(F.sum("weight").alias("w")).collect()}
    share = F.coalesce(*[F.when(F.col("kind") == k, F.col("weight") / w) for k, w in sorted(weights.items())], F.lit(0.0))
    edges = tmp.save(_reached(edges, seeds, tmp), "reached")
    state = seeds.select("kind", "host", share.alias("total"), share.alias("moving"))
    out = edges.groupBy("kind", "src").agg(F.count("dst").alias("out"))
    moves = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping / F.col("out")).alias("w"))
    # what a host has got so far stays where it is: a move to itself without a weight
    hosts = moves.select("kind", "host").unionByName(moves.select("kind", F.col("dst").alias("host"))).unionByName(seeds.select("kind", "host")).distinct()
    moves = tmp.save(moves.unionByName(hosts.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("w"))), "moves")
    # a small graph is kept in one task, where rounds need no exchange; a larger one is shuffled in each round
    few = moves.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH
    moves = F.broadcast(moves) if few else moves
    for done in range(ROUNDS_A_JOB, rounds + ROUNDS_A_JOB, ROUNDS_A_JOB):
        state = state.coalesce(1) if few else state
        for _ in range(ROUNDS_A_JOB):
            # what arrives moves on in the next round
            step = state.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.when(F.col("w").isNull(), F.col("total")).otherwise(0.0).alias("total"), F.coalesce(F.col("w") * F.col("moving"), F.lit(0.0)).alias("moving"))
            state = step.groupBy("kind", "host").agg(F.sum(F.col("total") + F.col("moving")).alias("total"), F.sum("moving").alias("moving"))
        state = tmp.save(state, f"rank{done}")
        left = state.groupBy("kind").agg(F.sum("moving").alias("m"), F.sum("total").alias("all")).collect()
        if all(r["m"] < TOLERANCE for r in left):
            whole = F.coalesce(*[F.when(F.col("kind") == r["kind"], r["all"]) for r in left], F.lit(1.0))
            return state.select("kind", "host", (F.col("total") / whole).alias("score"))
    raise RuntimeError(f"PageRank has not settled after {rounds} rounds")


def _reached(edges: DataFrame, seeds: DataFrame, tmp: Scratch) -> DataFrame:
    """The edges that start at a host which a seed of their kind reaches: a frontier of new hosts, until there are none."""
    seen = frontier = tmp.save(seeds.select("kind", F.col("host").alias("src")).distinct(), "seen")
    for _ in range(ROUNDS):
        step = edges.join(frontier, ["kind", "src"], "left_semi").select("kind", F.col("dst").alias("src")).distinct()
        frontier = tmp.save(step.join(seen, ["kind", "src"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return edges.join(seen, ["kind", "src"], "left_semi")
        seen = tmp.save(seen.unionByName(frontier), "seen")
    raise RuntimeError(f"hosts are not closed after {ROUNDS} rounds")


def judge(pages: DataFrame, columns: list[str], url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(columns, host, path, rule, verdict, trust, distrust) for each page; the last two are its host's scores, from 0 to about 1."""
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    url = F.col(url_col).cast("string")
    pages = pages.select(own, host_of(url).alias("host"), path_of(url).alias("path"), text_of(html_col).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("_row", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    with Scratch(pages.sparkSession) as tmp:
        part = lambda v: F.coalesce(F.count_if(F.col("verdict") == v) / F.count(F.lit(1)), F.lit(0.0))
        hosts = tmp.save(ruled.groupBy("host").agg(part("allow").alias("allowed"), part("block").alias("blocked")), "hosts")
        links = tmp.save(host_links(pages), "links")
        named = hosts.select("host").unionByName(links.select(F.col("dst").alias("host")))
        edges = tmp.save(links.unionByName(domain_edges(named)).distinct(), "edges")
        # kind 0 is trust, along edges; kind 1 distrust, against them
        both = edges.select(F.lit(0).alias("kind"), "src", "dst").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        named = hosts.where("host <> ''")
        seeds = named.select(F.lit(0).alias("kind"), "host", F.col("allowed").alias("weight")).unionByName(named.select(F.lit(1).alias("kind"), "host", F.col("blocked").alias("weight"))).where("weight > 0")
        total = named.agg(F.coalesce(F.sum("allowed"), F.lit(0.0)).alias("allowed"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("blocked")).first()
        scores = spread(both, seeds, tmp).groupBy("host")
        scores = scores.agg(*[F.sum(F.when(F.col("kind") == k, F.col("score") * total[w]).otherwise(0.0)).alias(c) for k, c, w in ((0, "trust", "allowed"), (1, "distrust", "blocked"))])
        scores = tmp.result(scores.select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust")), "hosts")
        few = scores.limit(100_001).count() <= 100_000
    ruled = ruled.join(F.broadcast(scores) if few else scores, "host", "left")
    by_host = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LEAST_DISTRUST), "block").otherwise("allow")
    return ruled.select("_row.*", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
