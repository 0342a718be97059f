"""URL filters: host and path rules, and link-graph propagation where no rule fits. DataFrame operations only.

Rules. A rule is ``host/path`` with a verdict. It fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule wins.

Method. Hosts link to hosts by the absolute links of their pages. Hosts most of whose pages an allow rule
decides are trusted seeds, hosts most of whose pages a block rule decides are blocked seeds. Personalised
PageRank spreads trust along links and distrust against them (who links to blocked hosts is suspect). A host
is blocked if its distrust exceeds both its trust and ``threshold`` times the mean share 1 / hosts.
Pages that no rule decides get their host's verdict.

Scale. Pages are joined by host with one row per host, those of hot hosts (fewer than ``HOT_HOSTS``) without a shuffle; links
are counted per pair of hosts before they meet, so there a host with a third of all pages costs one row per task and neighbour. Ranks are small tables
of hosts, cut by checkpoints; each round is an equi-join and an aggregation, and the only number
that comes to the driver is how far the ranks moved. Rounds go on until no host's rank can still move by more than
a small part of what it is compared with, ``threshold`` / hosts; their number grows with the logarithm of the hosts.

Rows. A null url or one without ``://`` has empty host and path, which no rule fits, and is allowed. Null html
has no links. Repeated rows are judged one by one. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import durable

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A host with more than this part of all pages is hot.
HOT_HOSTS = 1000
LINK = r"""(?i)\shref\s*=\s*["']?[a-z][a-z0-9+.-]*(://[^\s"'<>]*)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(pages: DataFrame, rules) -> DataFrame:
    rows = [(rule, rule.split("/", 1)[0].lower(), "/" + rule.split("/", 1)[1], verdict) for rule, verdict in rules]
    return pages.sparkSession.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules of the host and its parent domains, longest first."""
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    rule = F.struct(F.length("rule").alias("n"), "rule", "rule_path", "rule_verdict")
    return (
        hosts.select("host", F.explode(domains).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(rule), asc=False).alias("rules"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, most: float) -> DataFrame:
    """Personalised PageRank of (kind, host) rows; seeds (kind, host, seed) sum to 1 in each kind.

    ``edges`` (kind, src, dst, part) have the share of src's rank that goes to dst. What hosts without
    edges hold goes back to the seeds. Each round's summed move is at most ``damping`` times the one before, so all
    later ones together are at most damping / (1 - damping) times the last; they end below ``most``.
    """
    ranks = seeds.withColumnRenamed("seed", "rank")
    while True:
        moved = (
            edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
            .groupBy("kind", F.col("dst").alias("host"))
            .agg(F.sum(F.col("part") * F.col("rank")).alias("flow"))
        )
        flow = F.coalesce(F.col("flow"), F.lit(0.0))
        totals = moved.groupBy("kind").agg(F.sum("flow").alias("total"))
        back = 1 - damping * F.coalesce(F.col("total"), F.lit(0.0))
        new = (
            seeds.join(moved, ["kind", "host"], "full")
            .join(totals, "kind", "left")
            .select("kind", "host", (F.coalesce(F.col("seed"), F.lit(0.0)) * back + damping * flow).alias("rank"))
        )
        new = durable(new)
        old = ranks.withColumnRenamed("rank", "old")
        far = new.join(old, ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce(F.col("rank"), F.lit(0.0)) - F.coalesce(F.col("old"), F.lit(0.0))))
        )
        ranks = new
        if (far.first()[0] or 0.0) * damping <= most * (1 - damping):
            return ranks


def judge(
    pages: DataFrame,
    rules=RULES,
    damping: float = 0.85,
    threshold: float = 0.5,
    tolerance: float = 0.01,
) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict, and the host's trust and distrust.

    ``rules`` are pairs of rule and verdict, or a DataFrame with columns rule and verdict. The propagation
    ends when no rank can move by more than ``tolerance`` times threshold / hosts any more, however far from a seed.
    """
    if threshold <= 0 or tolerance <= 0 or not 0 <= damping < 1:
        raise ValueError("threshold and tolerance must be above 0, damping from 0 to below 1")
    if isinstance(rules, DataFrame):
        rule, verdict = F.col("rule"), F.col("verdict")
        table = rules.select(
            rule,
            lower_ascii(F.regexp_extract(rule, "^([^/]*)", 1)).alias("rule_host"),
            F.regexp_extract(rule, "^[^/]*(.*)$", 1).alias("rule_path"),
            verdict.alias("rule_verdict"),
        )
    else:
        table = rule_table(pages, rules)
    url = F.col("url")
    narrow = durable(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")))
    hosts = narrow.groupBy("host").agg(F.count("*").alias("n_pages"))
    by_host = durable(hosts.join(rules_by_host(hosts, table), "host", "left"))
    pages_in_all = by_host.agg(F.sum("n_pages")).first()[0] or 0
    # fewer than HOT_HOSTS hosts have so many pages: those are broadcast, so that their pages stay where they are
    hot = by_host.where(F.col("n_pages") > pages_in_all / HOT_HOSTS)
    of_hot = narrow.join(F.broadcast(hot), "host")
    others = narrow.join(F.broadcast(hot.select("host")), "host", "left_anti").join(by_host, "host")
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r.rule_path))
    first = F.try_element_at(fitting, F.lit(1))
    judged = of_hot.unionByName(others).select(
        "page_id", "host", "path", first.rule.alias("rule"), first.rule_verdict.alias("rule_verdict")
    )

    counted = judged.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("allow"),
        F.sum((F.col("rule_verdict") == "block").cast("long")).alias("block"),
    )
    linked = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    links = (
        pages.select(host_of(url).alias("src"), linked.alias("to"))
        .select("src", host_of(F.col("to")).alias("dst"))
        .where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    links = durable(links)
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = durable(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("part")))
    seeds = counted.select(
        "host", F.when(F.col("allow") * 2 > F.col("n"), "trust").when(F.col("block") * 2 > F.col("n"), "distrust").alias("kind")
    ).where("kind is not null")
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("k"))
    seeds = durable(seeds.join(sizes, "kind").select("kind", "host", (1 / F.col("k")).alias("seed")))
    n_hosts = hosts.select("host").union(links.select("src")).union(links.select("dst")).distinct().count()
    ranks = propagate(seeds, edges, damping, tolerance * threshold / max(n_hosts, 1))
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    scores = ranks.groupBy("host").agg(score("trust"), score("distrust"))
    of = lambda kind: F.coalesce(F.col(kind), F.lit(0.0))
    blocked = (of("distrust") > of("trust")) & (of("distrust") * n_hosts > threshold)
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("rule_verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        of("trust").alias("trust"),
        of("distrust").alias("distrust"),
    )
