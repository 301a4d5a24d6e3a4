"""URL filters: rules, and trust and distrust carried along links between hosts.

Null or odd urls have an empty host and path, which no rule fits and which are
allowed. A null ``html`` has no links. Rows with an equal page_id are judged one
by one. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut, drop

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""

KEPT = 0.85  # of a host's mass goes on along its links
SETTLED = 1e-3  # of the seeds' mass, that may still be on its way when the rounds end
SAME = 1e-9  # relative; sums of masses depend on their order by less


def lowered(host: Column) -> Column:
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``(n, rule, verdict)``; null if none does.

    A rule is a verdict and a host with a path, such as ``("block", "a.org/b")``.
    """
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    fitting = [
        F.when(
            fits(rule),
            F.struct(
                F.lit(len(rule)).alias("n"),
                F.lit(rule).alias("rule"),
                F.lit(verdict).alias("verdict"),
            ),
        )
        for verdict, rule in rules
    ]
    return F.array_max(F.array(*fitting))


def host_edges(pages: DataFrame, labels: bool = False) -> DataFrame:
    """Distinct ``(src, dst)`` hosts from absolute links, ``<base>`` among them.

    A relative link stays on its page's host, or goes to that of ``<base>``, to which
    there is an edge then. With ``labels``, hosts that are one label apart are
    linked both ways as well.
    """
    src = host_of(F.col("url"))
    edges = pages.select(
        src.alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"),
    ).select("src", lowered(F.col("dst")).alias("dst"))
    if labels:
        hosts = pages.select(src.alias("host")).distinct()
        near = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("up"))
        edges = edges.unionByName(near.select(F.col("host").alias("src"), F.col("up").alias("dst")))
        edges = edges.unionByName(near.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    named = (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    return edges.where(named).distinct()


def rounds_for(settled: float = SETTLED) -> int:
    """After so many rounds no more than this share of the mass is still on its way."""
    return ceil(log(settled) / log(KEPT))


def propagate(edges: DataFrame, seeds: DataFrame, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank ``(kind, host, mass)`` from ``(kind, host, seed)``.

    ``trust`` follows the links; ``distrust`` goes from a host to those that
    link to it. What a host without onward links holds goes nowhere. Rounds end
    when masses no longer change, or when no more than ``settled`` of the seeds'
    mass can. Both sides of each join are read from files: a side that is still
    grouped by the key would keep adaptive execution from splitting a hub's links.
    """

    def edge(kind: str, src: str, dst: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"))

    both = edges.where("src is not null and dst is not null").select(
        F.explode(F.array(edge("trust", "src", "dst"), edge("distrust", "dst", "src"))).alias("e")
    )
    both = cut(both.select("e.*"), "host-links")
    out = cut(both.groupBy("kind", "src").agg(F.count("*").alias("n")), "host-degrees")
    edges = cut(both.join(out, ["kind", "src"]), "host-edges")
    drop(both, out)
    seeds = cut(seeds, "host-seeds")
    again = seeds.select("kind", "host", (F.col("seed") * (1 - KEPT)).alias("mass"))
    mass = cut(seeds.select("kind", "host", F.col("seed").alias("mass")), "host-mass")
    for _ in range(rounds_for(settled)):
        carried = mass.withColumnRenamed("host", "src").join(edges, ["kind", "src"])
        carried = carried.select("kind", F.col("dst").alias("host"), (F.col("mass") * KEPT / F.col("n")).alias("mass"))
        before = mass.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("_before"))
        after = again.unionByName(carried).withColumn("_before", F.lit(0.0)).unionByName(before)
        after = after.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("_before").alias("_before"))
        after = cut(after, "host-mass")
        moved = F.abs(F.col("mass") - F.col("_before")) > SAME * F.col("mass")
        done = after.where(moved).isEmpty()
        drop(mass)
        mass = after
        if done:
            break
    drop(edges, seeds)
    return mass.select("kind", "host", "mass")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    threshold: float = 0.6,
    labels: bool = False,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page.

    The longest fitting rule decides. A page without one is blocked if its
    host's distrust is more than ``threshold`` of its trust and distrust
    together. A host is a seed of either by the share of its pages with such a
    rule. ``labels`` also links hosts that are one label apart. The blocked hosts are written before the pages are joined to them, so
    that a host with very many pages can be split.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = placed.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))

    shares = (
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            F.expr("count_if(_fit.verdict = 'allow') / count(*)").alias("trust"),
            F.expr("count_if(_fit.verdict = 'block') / count(*)").alias("distrust"),
        )
    )
    seeds = shares.select(
        "host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")
    ).where("seed > 0")
    mass = propagate(host_edges(pages.select("url", "html"), labels), seeds)
    held = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0)).alias("_trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0)).alias("_distrust"),
    )
    bad = F.col("_distrust") > (F.col("_trust") + F.col("_distrust")) * threshold * (1 + SAME)
    blocked = cut(held.where(bad).select("host", F.lit("block").alias("_held")), "blocked-hosts")
    return judged.join(blocked, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", "_held", F.lit("allow")).alias("verdict"),
    )
