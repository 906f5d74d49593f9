"""URL filtering by a tree of path templates.

Rules decide the URLs they fit, and their verdicts are the labels of a tree of path templates
kept for each host.  Level by level, segments that are numbers or hashes become classes, and branches that are
statistically similar merge into ``{alike}``: what they hold (how many of their paths end there, go on with a
number or hash, go on deeper) and, where they have labels, the blocked share must not differ significantly from
their parent's.  A branch without labels joins them only if most branches of the node have labels, three at least, and all
of these are clearly blocked or all clearly not; labels that differ among themselves say nothing about it.  Rare
children of a wide node that have no labels become the wildcard ``*``.  All others keep their
segment, however rare they are.  A template is
rejected when its smoothed labelled purity (its blocked share, drawn to one half or to the
host's share if that is lower) reaches ``threshold``; a template without labels is never that pure.

Paths of any depth count whole: a round of the tree takes each node to its next branching.
The tree is built on the counts of distinct (host, path shape), which are
aggregated per task before they move; the pages themselves move once, for the join with
their shape's verdict, an equi-join that adaptive execution splits at a hot host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    target: str

    def fits(self, host: Column, path: Column) -> Column:
        """The rule's host or a subdomain of it, and a path that starts with the rule's."""
        name, slash, rest = self.target.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; both empty where there is none."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, path = (F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def _shape(path: Column) -> Column:
    """The path without its outer slashes, numbers, hashes and identifiers in it as classes."""
    shape = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/+$", "")
    return F.regexp_replace(F.regexp_replace(shape, "[0-9a-fA-F]{16,}", "{h}"), "[0-9]+", "{n}")


# What a branch holds, by the segments behind its own (``rest`` begins with that): SQL conditions on a path.
HELD = {"ends": "size(rest) <= 1", "variable": "size(rest) > 1 AND rest[1] RLIKE '[{][hn][}]'", "deep": "size(rest) > 2"}


def judged(
    pages: DataFrame, rules: list[Rule], wide: int = 20, rare: float = 0.02, z: float = 1.96, weight: float = 4.0, threshold: float = 0.8, speakers: int = 3
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    ``rule`` is the longest fitting rule's target, else null.  Null and empty
    URLs and those without ``://`` have empty host and path and are judged as such; repeated
    rows are judged alike, each for itself, and each counts; extra columns are ignored.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r.target))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.target)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    shaped = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), _shape(F.col("path")).alias("shape"))
    labelled, blocked = F.col("fixed").isNotNull().cast("bigint"), (F.col("fixed") == "block").cast("bigint")
    sums = [F.sum(x).alias(x) for x in ("n", "labelled", "blocked")]
    tree = shaped.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0)).alias("blocked"))
    rest = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    tree = materialize(tree.withColumns({"template": F.lit(""), "rest": rest}), "paths")
    ready = []
    while not tree.isEmpty():
        # What all shapes below a node begin with is no branch, so long paths take no round a segment.
        nodes = tree.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        nodes = nodes.withColumn("apart", F.expr("int(array_position(zip_with(lo, hi, (a, b) -> a <=> b), false))"))
        nodes = nodes.select("host", "template", "apart", F.expr("if(apart = 0, size(lo), apart - 1)").alias("skip"))
        longer = F.expr("if(skip = 0, template, concat(template, '/', array_join(slice(rest, 1, skip), '/')))")
        tree = tree.join(nodes, ["host", "template"]).withColumns({"template": longer, "rest": F.expr("slice(rest, skip + 1, size(rest))")})
        tree = materialize(tree.withColumn("s", F.expr("if(size(rest) = 0, '', concat('/', rest[0]))")).drop("skip"), "paths")
        ready.append(tree.where("apart = 0"))
        tree = tree.where("apart > 0").drop("apart")
        held = [F.sum(F.expr(f"if({condition}, n, 0)")).alias(x) for x, condition in HELD.items()]
        children = tree.groupBy("host", "template", "s").agg(*sums, *held)
        own = F.col("blocked") / F.col("labelled")
        is_branch, speaks = F.col("s") != "", F.col("labelled") > 0
        parents = children.groupBy("host", "template").agg(
            F.sum("n").alias("all"), F.count("*").alias("kids"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
            F.count(F.when(speaks, 1)).alias("labelled_kids"), F.count(F.when(is_branch, 1)).alias("branches"),
            F.count(F.when(is_branch & speaks, 1)).alias("speaking"), F.min(F.when(is_branch & speaks, own)).alias("least"),
            F.max(F.when(is_branch & speaks, own)).alias("most"), F.sum(F.when(is_branch, F.col("n"))).alias("all_n"),
            *[F.sum(F.when(is_branch, F.col(x))).alias(f"all_{x}") for x in HELD],
        )

        def differs(part: Column, of: Column, whole_part: Column, whole: Column) -> Column:
            p = (whole_part + 0.5) / (whole + 1)
            return F.abs(part / of - whole_part / whole) > z * F.sqrt(p * (1 - p) / of)

        apart = F.coalesce(speaks & differs(F.col("blocked"), F.col("labelled"), F.col("all_blocked"), F.col("all_labelled")), F.lit(False))
        unlike = F.lit(False)
        for x in HELD:
            unlike = unlike | F.coalesce(differs(F.col(x), F.col("n"), F.col(f"all_{x}"), F.col("all_n")), F.lit(False))
        # Labels speak for siblings that have some, and for others where they all say the same.
        agreed = (F.col("speaking") >= speakers) & (2 * F.col("speaking") > F.col("branches")) & ((F.col("least") >= threshold) | (F.col("most") <= 1 - threshold))
        alike = ~unlike & F.when(speaks, (F.col("labelled_kids") > 1) & ~apart).otherwise(F.coalesce(agreed, F.lit(False)))
        odd = ~speaks & (F.col("kids") > wide) & (F.col("n") < rare * F.col("all"))
        branch = F.when(F.col("s") == "", "").when(alike, "/{alike}").when(odd, "/*").otherwise(F.col("s"))
        named = children.join(parents, ["host", "template"]).select("host", "template", "s", F.concat("template", branch).alias("longer"))
        tree = tree.join(named, ["host", "template", "s"]).drop("template").withColumnRenamed("longer", "template")
        tree = materialize(tree.withColumn("rest", F.expr("slice(rest, 2, size(rest))")), "paths")
        ready.append(tree.where("s = ''"))
        tree = tree.where("s != ''").drop("s")
    columns = ["host", "shape", "n", "labelled", "blocked", "template"]
    tree = tree.select(*columns)
    for part in ready:
        tree = tree.union(part.select(*columns))
    tree = materialize(tree, "paths")
    drawn = lambda prior: (F.col("blocked") + weight * prior) / (F.col("labelled") + weight)
    # A host can only speak for a template that has no labels: its own labels must reject it.
    hosts = tree.groupBy("host").agg(*sums).select("host", F.least(drawn(F.lit(0.5)), F.lit(0.5)).alias("prior"))
    templates = tree.groupBy("host", "template").agg(*sums).join(hosts, "host").select("host", "template", drawn(F.col("prior")).alias("purity"))
    shapes = tree.join(templates, ["host", "template"]).select("host", "shape", "template", "purity")
    return shaped.join(shapes, ["host", "shape"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("fixed", F.when(F.col("purity") >= threshold, "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )
