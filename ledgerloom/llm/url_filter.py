"""URL filter: rules on hosts and paths, and link-graph propagation for everything else, in DataFrame operations only.

The longest rule that fits decides a page. The hosts of pages that rules allow (block) seed trust (distrust), by their numbers of such pages.
Trust is personalised PageRank over host edges, distrust the same over reversed edges: who links to blocked hosts is distrusted. Edges are the links
of pages to other hosts, weighted by linking pages, and one edge each way between a host and the domain above it. A host is blocked when its
share of distrust exceeds its share of trust.

Ranks solve x = (1 - damping) seed + damping (what the edges bring). Hosts below which nothing links hang on the forest of domains: they are eliminated from the
leaves up, x = a + b x(domain above), and filled in from the roots down, one small plan a level. What is left, the core of linked hosts and the domains above them, is iterated in few staged plans,
so that neither the driver's memory nor the number of plans grows with the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: (verdict, host, path) of the rules to judge by.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds over the core end when no rank changes by more than this share of itself, looked at after every STEPS rounds, and at the latest after ROUNDS: by then what is
#: still on its way is less than 1e-9 of a seed's weight. A host farther from all seeds is one that no seed reaches.
CHANGE, STEPS, ROUNDS = 1e-6, 8, 128
#: Hosts of more labels belong to the core.
LEVELS = 8
#: Shares of a hub's rows.
SALTS = 16
#: Ranks that differ by no more than this share of themselves are equal, so that neither the order of summation nor the last round decides a tie.
CLOSE = 2e-5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """What is between the first :// and /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict of each page."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def above(host: Column) -> Column:
    """The domain above a host; empty for a domain of two labels or less."""
    return F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share, linked): edges between different hosts; the shares of a source add up to one; linked says whether pages make the edge."""
    links = (pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("to"))
             .select("src", F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst")))
    linked = links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n")).select("src", "dst", "n", F.lit(True).alias("linked"))
    hosts = links.select("dst").union(pages.select(host_of(F.col("url")))).distinct()
    chain = hosts.select(F.col("dst").alias("src"), above(F.col("dst")).alias("dst"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("linked")).where("dst <> ''")
    edges = linked.union(chain).union(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", "linked")).groupBy("src", "dst").agg(F.sum("n").alias("n"), F.max("linked").alias("linked"))
    total = edges.groupBy("src").agg(F.sum("n").alias("t"))
    return _salted(edges, total, ["src"]).select("src", "dst", (F.col("n") / F.col("t")).alias("share"), "linked")


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with one row a key of ``few``; the rows of a hub's key are dealt over SALTS tasks. Never a broadcast."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(SALTS)).alias("salt")
    copies = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).withColumn("salt", F.col("salt").cast("long"))
    return rows.select("*", salt).join(copies.hint("merge"), [*keys, "salt"], how).drop("salt")


def iterate(edges: DataFrame, base: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(side, host, rank) with rank = (a + damping * sum of what (side, src, dst, share) edges bring) / (1 - own), from (side, host, a, own)."""
    rank, done = base.select("side", "host", (F.col("a") / (1 - F.col("own"))).alias("rank")), 0
    while done < (rounds or ROUNDS):
        steps = min(STEPS, (rounds or ROUNDS) - done)
        for _ in range(steps):
            before = rank
            moved = _salted(edges, before.withColumnRenamed("host", "src"), ["side", "src"]).select("side", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("x"), F.lit(0.0).alias("own"))
            sums = moved.union(base.select("side", "host", "a", "own")).groupBy("side", "host").agg(F.sum("x").alias("x"), F.max("own").alias("own"))
            rank = sums.select("side", "host", (F.col("x") / (1 - F.col("own"))).alias("rank"))
        done += steps
        both = rank.select("side", "host", "rank", F.lit(0.0).alias("was")).union(before.select("side", "host", F.lit(0.0), "rank"))
        rank = stage(both.groupBy("side", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        change = rank.where("rank > 0").agg(F.max(F.abs(F.col("rank") - F.col("was")) / F.col("rank"))).first()[0] if rounds is None else 1.0
        rank = rank.select("side", "host", "rank")
        if (change or 0.0) <= CHANGE:
            break
    return rank


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(side, host, rank): personalised PageRank of each side from seeds (side, host, rank) over (side, src, dst, share, linked); what hosts without edges would
    pass on is lost."""
    hosts = stage(edges.select("side", F.col("src").alias("host")).union(edges.select("side", "dst")).union(seeds.select("side", "host")).distinct())
    labels = F.size(F.split("host", r"\."))
    roots = edges.where("linked").select(F.col("src").alias("host")).union(edges.where("linked").select("dst")).union(hosts.where(labels > LEVELS).select("host")).distinct()
    domains = F.transform(F.sequence(F.lit(1), labels), lambda k: F.array_join(F.slice(F.split("host", r"\."), k, labels), "."))
    core = stage(roots.select(F.explode(domains).alias("host")).distinct())
    hanging = hosts.join(core.hint("merge"), "host", "left_anti").select("side", "host", labels.alias("level"), above(F.col("host")).alias("up"))
    lift = edges.select("side", F.col("src").alias("host"), F.col("dst").alias("up"), F.col("share").alias("rise"))
    fall = edges.select("side", F.col("dst").alias("host"), F.col("src").alias("up"), F.col("share").alias("fall"))
    placed = (hanging.join(lift.hint("merge"), ["side", "host", "up"], "left").join(fall.hint("merge"), ["side", "host", "up"], "left")
              .join(seeds.withColumnRenamed("rank", "seed").hint("merge"), ["side", "host"], "left").fillna(0.0, ["rise", "fall", "seed"]))
    placed = stage(placed)
    levels = sorted((r.level for r in placed.select("level").distinct().collect()), reverse=True)  # at most LEVELS numbers
    zero = F.lit(0.0)
    brought = seeds.limit(0).select("side", "host", zero.alias("a"), zero.alias("own"))
    solved = {}
    for level in levels:
        here = placed.where(F.col("level") == level).select("side", "host", "up", "rise", "fall", (F.col("seed") * (1 - damping)).alias("a"), zero.alias("own"))
        sums = here.unionByName(brought.join(here.select("side", "host").hint("merge"), ["side", "host"], "left_semi"), allowMissingColumns=True).groupBy("side", "host").agg(
            F.max("up").alias("up"), F.max("rise").alias("rise"), F.max("fall").alias("fall"), F.sum("a").alias("a"), F.sum("own").alias("own"))
        solved[level] = stage(sums.select("side", "host", "up", "rise", (F.col("a") / (1 - F.col("own"))).alias("a"), (F.col("fall") * damping / (1 - F.col("own"))).alias("b")))
        lifted = solved[level].where("rise > 0").groupBy("side", F.col("up").alias("host")).agg(F.sum(F.col("a") * F.col("rise") * damping).alias("a"), F.sum(F.col("b") * F.col("rise") * damping).alias("own"))
        brought = stage(brought.join(here.select("side", "host").hint("merge"), ["side", "host"], "left_anti").unionByName(lifted))
    inner = hosts.join(core.hint("merge"), "host", "left_semi").select("side", "host", zero.alias("a"), zero.alias("own"))
    known = seeds.join(core.hint("merge"), "host", "left_semi").select("side", "host", (F.col("rank") * (1 - damping)).alias("a"), zero.alias("own"))
    base = stage(inner.unionByName(known).unionByName(brought).groupBy("side", "host").agg(F.sum("a").alias("a"), F.sum("own").alias("own")))
    ranks = base.select("side", "host", zero.alias("rank"))
    if base.limit(1).count():
        among = edges.join(core.withColumnRenamed("host", "src").hint("merge"), "src", "left_semi").join(core.withColumnRenamed("host", "dst").hint("merge"), "dst", "left_semi")
        ranks = iterate(stage(among.select("side", "src", "dst", "share")), base, damping)
    over = ranks
    for level in sorted(levels):
        filled = _salted(solved[level].select("side", "host", "up", "a", "b"), over.select("side", F.col("host").alias("up"), "rank"), ["side", "up"], "left")
        found = stage(filled.select("side", "host", (F.col("a") + F.col("b") * F.coalesce("rank", zero)).alias("rank")))
        over = ranks.union(found)
        ranks = over
    return ranks


def verdicts(pages: DataFrame, rules=RULES, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page.

    Null urls and urls without :// have an empty host, no rule and no links, and are allowed, like every host that no seed reaches. Repeated pages are
    judged alike, and each counts as a page. Very long pages are searched for links whole. trust and distrust are given to nine significant digits.
    """
    judged = judged_pages(pages, rules)
    by_host = stage(judged.where("host <> ''").groupBy("host").agg(*[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]))
    totals = by_host.agg(F.sum("allow"), F.sum("block")).first()
    edges = stage(host_edges(pages))
    back = edges.groupBy("dst").agg(F.sum("share").alias("t"))
    reverse = _salted(edges, back, ["dst"]).select(F.lit("block").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("t")).alias("share"), "linked")
    graph = stage(edges.select(F.lit("allow").alias("side"), "src", "dst", "share", "linked").union(reverse))
    sides = F.array(*[F.struct(F.lit(v).alias("side"), (F.col(v) / F.lit(float(t or 1))).alias("rank")) for v, t in zip(("allow", "block"), totals)])
    seeds = stage(by_host.select("host", F.explode(sides).alias("s")).select("s.side", "host", "s.rank").where("rank > 0"))
    ranks = propagate(graph, seeds, damping)
    both = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("side") == v, F.col("rank"))), F.lit(0.0)).alias(n) for v, n in (("allow", "trust"), ("block", "distrust"))])
    out = _salted(judged, stage(both), ["host"], "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    worse = distrust > trust * (1 + CLOSE)
    digits = lambda x: F.format_string("%.8e", x).cast("double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(worse, "block").otherwise("allow")).alias("verdict"),
                      digits(trust).alias("trust"), digits(distrust).alias("distrust"))
