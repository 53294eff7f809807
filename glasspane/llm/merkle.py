"""A Merkle manifest of a dataset: trees whose nodes are labelled with the intervals of leaf ranks they cover.

Rows are leaves, ordered within their group; a node of level k covers the
leaves of 8**k consecutive ranks. Nodes are labelled ``lo, hi`` (ranks from lo to
below hi), so that an ancestor is a node whose interval contains another's.
Ancestors are attached level by level, from the root down, by a join on the
bucket of a level's width with the containment as its condition; the siblings of
a node are what its parent's interval has beside its own. A family (a parent with
its children) is one row, so the way to the root is joined once for every eight
nodes, and a leaf's proof is put together where its family is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glasspane.llm.rows import Scratch

#: Children of a node.
RUN = 8
#: What a node needs beside its siblings, from its parent up: digests to the left and right at each level.
_STEPS = "array<struct<left:array<binary>,right:array<binary>>>"


def field(value: Column) -> Column:
    """The text of a value within a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes; ``shown`` gives the lowercase hex that is hashed and returned."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, shown), "")


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with their ``rank`` (from 0) within the group, and its size ``n``.

    A range-partitioned sort numbers the rows; a group that fills many
    partitions, however large, is never in one task. Written first, since a
    range sort reads its input twice; rows equal in all of ``order`` may stand
    either way and are split freely. The group must not be null.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = scratch.save(rows.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ordered = written.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = scratch.save(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "ordered")
    parts = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    before = F.sum("_count").over(W.partitionBy(group).orderBy("_part")) - F.col("_count")
    parts = parts.select(group, "_part", (F.col("_first") - before).alias("_shift"), F.sum("_count").over(W.partitionBy(group)).alias("n"))
    return placed.join(parts, [group, "_part"]).withColumn("rank", F.col("_row") - F.col("_shift")).drop("_row", "_part", "_shift")


class Trees:
    """One tree for each group: families by level, and the top node of each."""

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        """``leaves``: group, rank, n, digest and ``more``, in a table that was written."""
        self.scratch, self.families = scratch, []
        nodes = leaves.select("group", "n", F.col("n").alias("count"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "more")
        largest, level, tops = leaves.agg(F.max("n").alias("n")).first()["n"] or 0, 0, []
        while True:
            tops.append(nodes.where("count = 1").select("group", "digest"))
            if largest <= 1:
                break
            width = RUN ** (level + 1)
            kid = [c for c in nodes.columns if c not in ("group", "n", "count")]
            family = nodes.where("count > 1").groupBy("group", "n", "count", F.expr(f"lo div {width}").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct(*kid))).alias("kids"))
            family = family.select(
                "group", "n", F.expr(f"(count + {RUN - 1}) div {RUN}").alias("count"), (F.col("bucket") * width).alias("lo"), F.least(F.col("n"), (F.col("bucket") + 1) * width).alias("hi"),
                digest(_joined(F.transform("kids", lambda k: k["digest"]))).alias("digest"), "kids",
            )
            self.families.append(scratch.save(family, f"level-{level}"))
            nodes = self.families[-1].drop("kids")
            largest, level = -(-largest // RUN), level + 1
        top = tops[0]
        for more in tops[1:]:
            top = top.unionByName(more)
        self.tops = scratch.save(top, "tops")

    def proofs(self, above: DataFrame) -> DataFrame | None:
        """The families of leaves with ``top`` and ``steps``: what lies beside their parents, level by level, up to the root.

        ``above`` has the same two columns for each group's top node.
        """
        out = None
        for level in reversed(range(len(self.families))):
            family = self.families[level]
            first = family.where("count = 1").join(above, "group")
            if out is None:
                out = first
            else:
                width = RUN ** (level + 2)
                parent = out.select(
                    F.col("group").alias("p_group"), F.expr(f"lo div {width}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                    F.transform("kids", lambda k: F.struct(k["lo"].alias("lo"), k["hi"].alias("hi"), k["digest"].alias("digest"))).alias("p_kids"), "top", F.col("steps").alias("p_steps"),
                )
                inside = (F.col("group") == F.col("p_group")) & (F.expr(f"lo div {width}") == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
                child = family.where("count > 1").join(parent, inside)
                steps = F.concat(F.array(beside(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_steps"))
                out = child.select(*family.columns, "top", steps.alias("steps")).unionByName(first.select(*family.columns, "top", "steps"))
            if level:
                out = self.scratch.save(out, f"above-{level}")
        return out


def beside(kids: Column, lo: Column, hi: Column) -> Column:
    """The digests of a family to the left and right of the interval from lo to hi."""
    of = lambda found: F.transform(found, lambda k: k["digest"])
    return F.struct(of(F.filter(kids, lambda k: k["hi"] <= lo)).alias("left"), of(F.filter(kids, lambda k: k["lo"] >= hi)).alias("right"))


def proof_text(steps: Column) -> Column:
    """The siblings, level by level and left to right, as hashed text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(_joined(s["left"]), _joined(s["right"]))), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give, as hex."""
    return F.aggregate(steps, shown(leaf), lambda acc, s: F.sha2(F.concat(_joined(s["left"]), acc, _joined(s["right"])).cast("binary"), 256))


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """``more, leaf, subroot, root, steps`` of each row: its way to the root of all groups' trees, digests as 32 bytes.

    ``rows`` has a column ``more`` (kept as it is), a group, the columns of the
    order and the digest ``leaf``. The tops of the groups' trees (null first,
    then by UTF-8 bytes) are the leaves of one more tree. ``steps`` has the
    siblings to the left and right at each level, from the leaf up. Rows equal
    in group, order and leaf are leaves of their own beside each other; nulls of
    the order come first; an empty table gives an empty one. The tables behind
    the result stay until the session ends.
    """
    scratch = Scratch(rows.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    keys = [f"o{i}" for i in range(len(order))]
    leaves = rows.select(name.alias("group"), *[F.col(c).alias(k) for c, k in zip(order, keys)], F.col(leaf).alias("digest"), "more")
    leaves = scratch.save(ranked(leaves, "group", [*keys, "digest"], scratch).drop(*keys), "leaves")
    trees = Trees(leaves, scratch)
    subroots = trees.tops.select(F.lit("").alias("group"), F.struct(F.col("group").alias("of")).alias("more"), "digest")
    subroots = scratch.save(ranked(subroots, "group", ["more"], scratch), "subroots")
    upper = Trees(subroots, scratch)
    root = upper.tops.first()
    root = F.lit(bytes(root["digest"])) if root else F.lit(None).cast("binary")
    end = upper.tops.select("group", F.col("digest").alias("top"), F.array().cast(_STEPS).alias("steps"))
    ways = _ways(upper, subroots, end).select(F.col("more.of").alias("group"), F.col("leaf").alias("top"), "steps")
    found = _ways(trees, leaves, scratch.save(ways, "ways"))
    return found.select("more", "leaf", F.col("top").alias("subroot"), root.alias("root"), "steps")


def _ways(trees: Trees, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """``more, leaf, top, steps`` of every leaf; a lone leaf is its tree's top."""
    out = leaves.where("n = 1").join(above, "group").select("more", F.col("digest").alias("leaf"), "top", "steps")
    families = trees.proofs(above)
    if families is None:
        return out
    kids = families.select("kids", "top", "steps", F.explode("kids").alias("k"))
    steps = F.concat(F.array(beside(F.col("kids"), F.col("k.lo"), F.col("k.hi"))), F.col("steps"))
    return out.unionByName(kids.select("k.more", F.col("k.digest").alias("leaf"), "top", steps.alias("steps")))
