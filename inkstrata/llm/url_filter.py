"""URL filters: rules, and for what they leave open a tree of path templates.

A url's path becomes a template: segments with digits, long or hash-like ones
hold wildcards at once; a position where a host has many values of few urls
each becomes a wildcard by its counts.  Templates of a host form a tree.  Urls
that a rule decides are the labelled examples.  From the root down, a branch
keeps its own counts if its share of blocked examples differs from the rest of
its siblings (two-proportion z-test); the others are merged.  Each node's share
is smoothed towards its parent's, the root's towards all hosts'.  A template of
which the smoothed share is ``PURITY`` or more is rejected.

Only DataFrame functions run here.  Urls are counted by template before
anything is shuffled by host, and the tree is worked on as a table of templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise

#: (host and path start, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The SQL below follows a path this far; the query has no such bound.
DEPTH = 8
LONG_SEGMENT = 40
#: A position is variable with so many values, and fewer than so many urls a value.
MANY_VALUES, URLS_A_VALUE = 20, 5
#: z of a branch that differs from its siblings; weight of the parent's share; share that rejects.
DIFFERENT, PRIOR_WEIGHT, PURITY = 1.96, 4.0, 0.7
# Shapes of segments.
HASH_LIKE = "^[0-9a-f-]{8,}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path; both empty for null or a url without ``://``."""
    pick = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(pick(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), pick(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest comes to stand outermost
        name, start = text.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template_parts(path: Column) -> Column:
    """All segments, with wildcards for what varies by its look."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    one = lambda s: F.when((s.rlike(HASH_LIKE) & s.rlike("[0-9]")) | (F.length(s) > LONG_SEGMENT), "*").otherwise(F.regexp_replace(s, "[0-9]+", "*"))
    return F.transform(parts, one)


def _name(*of: Column) -> Column:
    """128 bits of hashes in place of a long text."""
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(*of, F.lit("again")).alias("b"))


def with_prefixes(levels: DataFrame) -> DataFrame:
    """Rows of (host, template, depth, segment) with names of the prefixes ``above`` them and down to them (``branch``).

    A prefix is named by the hashes of its segments with their depths, folded by
    exclusive or along the path: a path of n segments costs n, not n times its length.
    """
    down = Window.partitionBy("host", "template").orderBy("depth")
    run = lambda part, frame: F.coalesce(F.bit_xor(F.xxhash64("depth", "segment", F.lit(part))).over(frame), F.lit(0).cast("long"))
    both = lambda frame: F.struct(run("a", frame).alias("a"), run("b", frame).alias("b"))
    return levels.withColumns({"above": both(down.rowsBetween(Window.unboundedPreceding, -1)), "branch": both(down.rowsBetween(Window.unboundedPreceding, 0))})


def generalised(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates (host, template, blocked, labelled), and a row for each of their segments: wildcards where a host's values vary by their counts."""
    table = urls.groupBy("host", "template").agg(F.first("parts").alias("parts"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    table = materialise(table, "templates")
    levels = with_prefixes(table.select("host", "template", "n", "blocked", "labelled", F.posexplode("parts").alias("depth", "segment")))
    here = levels.groupBy("host", "depth", "above", "branch").agg(F.sum("n").alias("n"))
    varies = here.groupBy("host", "depth", "above").agg(F.count("*").alias("values"), F.sum("n").alias("n")).where((F.col("values") >= MANY_VALUES) & (F.col("n") < URLS_A_VALUE * F.col("values"))).select("host", "depth", "above", F.lit("*").alias("wild"))
    wild = levels.join(varies, ["host", "depth", "above"], "left").select("host", "template", "blocked", "labelled", "depth", F.coalesce("wild", "segment").alias("segment"))
    return table.drop("parts", "n"), materialise(wild, "general")  # plans stay small: the tables of templates are


def purity(table: DataFrame, levels: DataFrame) -> DataFrame:
    """(host, template, purity): smoothed share of blocked examples of each template's place in the tree."""
    total = table.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = ((total["b"] or 0) + 0.5) / ((total["l"] or 0) + 1.0)
    root = table.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    root = root.select("host", ((F.col("b") + PRIOR_WEIGHT * F.lit(overall)) / (F.col("l") + PRIOR_WEIGHT)).alias("share"))
    # what a node counts depends on the counts only, so the nodes of all depths are made at once
    levels = with_prefixes(levels)
    nodes = levels.groupBy("host", "depth", "above", "branch").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    around = nodes.groupBy("host", "depth", "above").agg(F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
    nodes = nodes.join(around, ["host", "depth", "above"])
    ratio = F.try_divide  # null where there are no examples: then a branch has nothing to differ by
    rest_b, rest_l, pooled = F.col("all_b") - F.col("b"), F.col("all_l") - F.col("l"), ratio(F.col("all_b"), F.col("all_l"))
    gap = ratio(F.col("b"), F.col("l")) - ratio(rest_b, rest_l)
    own = gap * gap > F.lit(DIFFERENT * DIFFERENT) * pooled * (1 - pooled) * (ratio(F.lit(1.0), F.col("l")) + ratio(F.lit(1.0), rest_l))
    nodes = materialise(nodes.withColumn("own", F.coalesce(own, F.lit(False))), "nodes")
    merged = nodes.where(~F.col("own")).groupBy("host", "depth", "above").agg(F.sum("b").alias("merged_b"), F.sum("l").alias("merged_l"))
    nodes = nodes.join(merged, ["host", "depth", "above"], "left").select(
        "host", "depth", "branch", F.when(F.col("own"), F.col("b")).otherwise(F.col("merged_b")).alias("use_b"), F.when(F.col("own"), F.col("l")).otherwise(F.col("merged_l")).alias("use_l")
    )
    # shares go down the tree, each smoothed towards the one above
    way = levels.select("host", "template", "depth", "branch").join(nodes, ["host", "depth", "branch"])
    way = way.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "use_b", "use_l"))).alias("way"))
    down = F.aggregate("way", F.col("share"), lambda share, x: (x["use_b"] + PRIOR_WEIGHT * share) / (x["use_l"] + PRIOR_WEIGHT))
    table = table.join(root, "host").join(way, ["host", "template"], "left")
    return table.select("host", "template", F.when(F.col("way").isNotNull(), down).otherwise(F.col("share")).alias("purity"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A null url, or one without ``://``, has an empty host and path, no rule, and
    is judged as the root of the empty host: like all hosts together.  Repeated
    rows each get their row; an empty table gives none.  A url of any length costs
    in proportion to it.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("ruled", rule_of(F.col("host"), F.col("path")))
    urls = urls.withColumn("parts", template_parts(F.col("path"))).withColumn("template", _name(F.array_join("parts", "/")))
    counted = urls.groupBy("host", "template", F.col("ruled.verdict").alias("label")).agg(F.first("parts").alias("parts"), F.count("*").alias("n"))
    counted = counted.select("host", "template", "parts", "n", F.when(F.col("label") == "block", F.col("n")).otherwise(0).alias("blocked"), F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0).alias("labelled"))
    # a written table: its size is known, and decides between a broadcast and a join
    shares = materialise(purity(*generalised(counted)), "purity")
    out = urls.select("page_id", "host", "path", "ruled", "template").join(shares, ["host", "template"], "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    rules = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{r}'" for r, h, p in ((r, *r.split("/", 1)) for r, _ in sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)))
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    steps = [
        """u0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)""",
        f"u1 AS (SELECT *, CASE {rules} END AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM u0)",
        f"""u AS (SELECT page_id, host, path, rule, CASE {verdicts} END AS label, list_concat(list_transform(list_slice(segments, 1, {DEPTH}), lambda s:
            CASE WHEN (regexp_matches(s, '{HASH_LIKE}') AND regexp_matches(s, '[0-9]')) OR length(s) > {LONG_SEGMENT} THEN '*' ELSE regexp_replace(s, '[0-9]+', '*', 'g') END),
            CASE WHEN len(segments) > {DEPTH} THEN ['**'] ELSE [] END) AS parts FROM u1)""",
        "t0 AS (SELECT host, parts, parts AS general, count(*) AS n, count(*) FILTER (label = 'block') AS blocked, count(label) AS labelled FROM u GROUP BY host, parts)",
    ]
    last = "t0"
    for d in range(1, DEPTH + 1):
        steps += [
            f"v{d} AS (SELECT host, above FROM (SELECT host, list_slice(parts, 1, {d - 1}) AS above, parts[{d}] AS segment, sum(n) AS n FROM t0 WHERE len(parts) >= {d} GROUP BY ALL) GROUP BY host, above HAVING count(*) >= {MANY_VALUES} AND sum(n) < {URLS_A_VALUE} * count(*))",
            f"""t{d} AS (SELECT t.host, t.parts, CASE WHEN v{d}.host IS NOT NULL AND len(t.parts) >= {d} THEN list_concat(list_slice(general, 1, {d - 1}), ['*'], list_slice(general, {d + 1}, len(general))) ELSE general END AS general, n, blocked, labelled
                FROM {last} t LEFT JOIN v{d} ON t.host = v{d}.host AND list_slice(t.parts, 1, {d - 1}) = v{d}.above)""",
        ]
        last = f"t{d}"
    w = PRIOR_WEIGHT
    steps += [
        f"g AS (SELECT (coalesce(sum(blocked), 0) + 0.5) / (coalesce(sum(labelled), 0) + 1.0) AS overall FROM {last})",
        f"s0 AS (SELECT t.*, (sum(blocked) OVER (PARTITION BY host) + {w}::DOUBLE * overall) / (sum(labelled) OVER (PARTITION BY host) + {w}::DOUBLE) AS share FROM {last} t, g)",
    ]
    for d in range(1, DEPTH + 1):
        steps += [
            f"n{d} AS (SELECT host, list_slice(general, 1, {d - 1}) AS above, list_slice(general, 1, {d}) AS branch, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l FROM s{d - 1} WHERE len(general) >= {d} GROUP BY ALL)",
            f"a{d} AS (SELECT *, sum(b) OVER (PARTITION BY host, above) AS ab, sum(l) OVER (PARTITION BY host, above) AS al FROM n{d})",
            f"""o{d} AS (SELECT *, CASE WHEN l > 0 AND al - l > 0 THEN power(b / l - (ab - b) / (al - l), 2) > {DIFFERENT * DIFFERENT} * (ab / al) * (1 - ab / al) * (1.0 / l + 1.0 / (al - l)) ELSE false END AS own FROM a{d})""",
            f"""m{d} AS (SELECT host, branch, CASE WHEN own THEN b ELSE sum(b) FILTER (NOT own) OVER (PARTITION BY host, above) END AS ub, CASE WHEN own THEN l ELSE sum(l) FILTER (NOT own) OVER (PARTITION BY host, above) END AS ul FROM o{d})""",
            f"""s{d} AS (SELECT s.host, s.parts, s.general, s.n, s.blocked, s.labelled, CASE WHEN len(s.general) >= {d} THEN (ub + {w}::DOUBLE * share) / (ul + {w}::DOUBLE) ELSE share END AS share
                FROM s{d - 1} s LEFT JOIN m{d} ON s.host = m{d}.host AND list_slice(s.general, 1, {d}) = m{d}.branch AND len(s.general) >= {d})""",
        ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT u.page_id, u.host, u.path, u.rule, coalesce(u.label, CASE WHEN s.share >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN s{DEPTH} s ON u.host = s.host AND u.parts = s.parts"
