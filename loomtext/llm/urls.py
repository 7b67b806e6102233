"""URL filters: written rules first, then trust and distrust propagated over the links between hosts.

Seeds come from the rules: hosts most of whose pages are ruled out are distrusted by that share of their pages,
other hosts that a rule allows whole are trusted. A table of seeds can name more hosts of either kind.
Trust is personalised PageRank from trusted hosts along links; distrust is personalised PageRank from blocked
hosts against the links, so that who links to a blocked host is distrusted. A host is blocked if its distrust
makes up more than a set share of both. Everything runs as joins and sums over tables of hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """Fits host and its subdomains if the path starts with path."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
DAMPING = 0.85
#: Propagation ends when STEP rounds change the ranks by less than this in sum and reach no new host.
TOLERANCE = 1e-6
STEP = 4
#: Share of distrust above which a host is blocked.
THRESHOLD = 0.5
#: Share of a host's pages that block rules must rule out, and more, for the host to be a blocked seed.
SEED_SHARE = 0.5


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up
    to "?", "#" or the end. Null, or no "://": both empty."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, shape, 2)})


def fitting(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL for the longest rule that fits host and path, or null."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = [f"when (host = {quote(r.host)} or endswith(host, {quote('.' + r.host)})) and startswith(path, {quote(r.path)}) then {quote(str(r))}" for r in sorted(rules, key=lambda r: (-len(str(r)), str(r)))]
    return f"case {' '.join(cases)} end" if cases else "cast(null as string)"


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with host -> (src, dst, n): absolute links between different hosts, and those of a host with the
    host it is a subdomain of, where both have pages."""
    raw = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    out = pages.select(F.col("host").alias("src"), F.explode(raw).alias("dst")).withColumn("dst", F.lower("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.filter("host <> ''").select("host").distinct()
    parent = hosts.select(F.col("host").alias("src"), F.expr("substring(host, locate('.', host) + 1)").alias("dst")).filter("locate('.', src) > 0 and locate('.', dst) > 0")
    own = parent.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("n"))
    return out.unionByName(own).unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges (kind, src, dst, n), seeds (kind, host, start) with starts of a kind adding up to 1 -> (kind, host, rank).

    As many rounds as given, else until STEP more change the sum of ranks by less than tolerance and reach no new host.
    What comes to a host without links goes back to the seeds: since that scales all ranks of a kind alike, they are
    scaled once, at the end, to add up to 1.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    share = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    start = cut(seeds)
    rank = start.select("kind", "host", F.col("start").alias("rank"))
    if share.isEmpty():
        return rank
    done = 0
    while rounds is None or done < rounds:
        before, more = rank, STEP if rounds is None else min(STEP, rounds - done)
        for _ in range(more):
            sent = rank.join(share, (rank["kind"] == share["kind"]) & (rank["host"] == share["src"])).select(rank["kind"], F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            rank = sent.unionByName(start.select("kind", "host", ((1 - damping) * F.col("start")).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = cut(rank)
        done += more
        if rounds is None:
            both = rank.select("kind", "host", "rank", F.lit(0.0).alias("was")).unionByName(before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
            moved = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
            change = moved.agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("sum"), F.count_if(F.col("was") == 0).alias("new")).first()
            if not change["new"] and (change["sum"] or 0.0) < tolerance:
                break
    of = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(of), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def host_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, rule, html -> (host, blocked) for hosts that trust or distrust reaches.

    A blocked seed weighs as much as the share of its pages that is ruled out. seeds: (host, kind, weight) of further
    seeds, kind "trust" or "distrust"; what it says of a host goes before what the rules say.
    """
    whole = tuple(r for r in rules if r.path == "/" and r.verdict == "allow")
    barred = [str(r) for r in rules if r.verdict == "block"]
    ruled_out = F.coalesce(F.col("rule").isin(*barred), F.lit(False)).cast("double") if barred else F.lit(0.0)
    hosts = pages.filter("host <> ''").groupBy("host").agg(F.avg(ruled_out).alias("bad")).withColumn("path", F.lit("/"))
    distrust = F.when(F.col("bad") > SEED_SHARE, F.col("bad"))
    kind = F.when(distrust.isNotNull(), "distrust").when(F.expr(fitting(whole)).isNotNull(), "trust")
    chosen = hosts.select("host", kind.alias("kind"), F.coalesce(distrust, F.lit(1.0)).alias("weight")).filter("kind is not null")
    if seeds is not None:
        given = seeds.select(F.lower("host").alias("host"), F.col("kind").cast("string").alias("kind"), F.col("weight").cast("double").alias("weight"))
        given = given.filter("host is not null and kind in ('trust', 'distrust') and weight > 0").groupBy("host", "kind").agg(F.max("weight").alias("weight"))
        chosen = chosen.join(given, "host", "left_anti").unionByName(given)
    chosen = cut(chosen)
    of = chosen.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = chosen.join(of, "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("start"))
    found = cut(links(pages))
    both = found.withColumn("kind", F.lit("trust")).unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    rank = propagate(both, start)
    total = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    return total.select("host", (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).alias("blocked"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> page_id, host, path, rule, verdict: one row per row.

    verdict is the longest fitting rule's, else block for hosts that distrust prevails at, else allow. Urls
    without a host, null ones among them, fit no rule and are allowed. Null html has no links, however long other html
    is; rows that repeat or have no id get equal results; no rows give no rows; other columns are not looked at.
    Where no links join hosts, distrust stays with its seeds.
    """
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))).withColumn("rule", F.expr(fitting(rules)))
    hosts = cut(host_verdicts(rows, rules, seeds))
    verdict = {str(r): r.verdict for r in rules}
    ruled = F.expr("case " + " ".join(f"when rule = '{k}' then '{v}'" for k, v in verdict.items()) + " end") if verdict else F.lit(None).cast("string")
    named = rows.select("page_id", "host", "path", "rule").join(hosts, "host", "left")
    return named.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")).alias("verdict"))
