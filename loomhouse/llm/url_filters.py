"""URL rules by hashed expressions.

Every URL is expanded into expressions: a suffix of its host's labels joined to a prefix of its path, for the label counts and path
lengths that the rules have. An expression's SHA-256 meets the rules' digests by an equi-join on the first 32 bits; the full digest
confirms the hit, and the rule that takes precedence decides. URLs that agree in host and in the part of the path that rules can see
are judged once, so a hot host costs a few rows, and what was judged is joined to all rows by broadcast up to a bound.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.llm.shared import broadcast_below, written

ALLOW, BLOCK = "allow", "block"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _hashed(df: DataFrame, host: str, path: str) -> DataFrame:
    digest = F.sha2(F.concat(host, F.lit("\n"), path), 256)
    return df.withColumn("__digest", digest).withColumn("__prefix", F.substring("__digest", 1, 8))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, max_broadcast_sites: int = 100_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has host, path (a prefix, with its slash) and action. A rule fits its host and all subdomains if the path starts with the
    rule's. The longest rule text (host and path) wins; among equally long ones that with more labels, then a block, then the larger
    text. Where none fits, rule is null and the verdict is ``default``, as for a null URL or one without ``://``, whose host and path are
    empty. Rules with a null host or path fit nothing; an unknown or null action counts as a block. Every row of ``pages`` stays, repeated ones
    too. Columns of ``pages`` named as new ones are replaced; others stay.
    """
    rules = rules.select(
        F.col("host").alias("__rule_host"), F.col("path").alias("__rule_path"), F.when(F.col("action") == ALLOW, ALLOW).otherwise(BLOCK).alias("__action")
    ).filter("__rule_host is not null and __rule_path is not null")
    labels = F.size(F.split("__rule_host", r"\."))
    shapes = sorted(tuple(r) for r in rules.select(labels, F.length("__rule_path")).distinct().collect())  # at most labels x lengths of a URL
    seen = max([0, *(n for _, n in shapes)])

    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    read = pages.select("*", host.alias("__host"), path.alias("__path")).withColumn("__seen", F.substring("__path", 1, seen))
    hashed = _hashed(rules, "__rule_host", "__rule_path").withColumn("__labels", labels)

    sites = read.select(F.col("__host").alias("__site"), F.col("__seen").alias("__start")).distinct()
    of_site = F.size(F.split("__site", r"\."))
    forms = F.array(
        *(
            F.when(
                (of_site >= j) & (F.length("__start") >= n),
                F.struct(F.substring_index("__site", ".", -j).alias("__suffix"), F.substring("__start", 1, n).alias("__head")),
            )
            for j, n in shapes
        )
    )
    if shapes:
        rule = F.concat("__rule_host", "__rule_path")
        rank = F.struct(F.length(rule), F.col("__labels"), F.col("__action") == BLOCK, rule.alias("rule"), F.col("__action").alias("action"))
        ranked = hashed.groupBy("__prefix", "__digest").agg(F.max(rank).alias("rank"))
        # the rules under a prefix go in one row, so that rows meet by the prefix alone and the full digest is compared after
        under = ranked.groupBy("__prefix").agg(F.collect_list(F.struct(F.col("__digest").alias("digest"), "rank")).alias("__under"))
        expressions = _hashed(sites.select("__site", "__start", F.explode(F.array_compact(forms)).alias("__form")).select("__site", "__start", "__form.*"), "__suffix", "__head")
        confirmed = F.filter("__under", lambda x: x["digest"] == F.col("__digest"))
        hits = expressions.join(under, "__prefix").select("__site", "__start", F.explode(confirmed).alias("__hit"))
        # stored, so that the join sees its size: it goes to all rows, or the rows of a hot host are split
        best = written(hits.groupBy("__site", "__start").agg(F.max("__hit.rank").alias("__best")), "url-hits")
        best = broadcast_below(best, max_broadcast_sites)
        read = read.join(best, (read["__host"] == best["__site"]) & (read["__seen"] == best["__start"]), "left")
    else:
        read = read.withColumn("__best", F.lit(None).cast("struct<rule:string,action:string>"))
    return read.select(
        *(F.col(f"`{c}`") for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict")
    )
