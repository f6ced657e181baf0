"""A manifest of a data set: Merkle trees whose nodes are labelled with the interval of leaf ranks they cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import both_sides, shuffle_partitions
from packetloom.operators.durable import checkpointed

#: Children of a node, and levels that are built and joined at once: a bucket holds FAN ** BAND entries at most.
FAN = 2
BAND = 8

_STEPS = "array<struct<level:int,left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest (binary) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def _hashed(digests: Column) -> Column:
    return F.unhex(F.sha2(hex_text(_joined(digests)), 256))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings, level by level, lead to."""
    return F.aggregate(steps, start, lambda at, s: F.unhex(F.sha2(hex_text(F.concat(s["left"], at, s["right"])), 256)))


def siblings(steps: Column) -> Column:
    """All siblings of the steps in their order, as one binary."""
    return F.aggregate(steps, F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size``."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")


def _numbered(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """``rows`` with their rank from 0 within ``key`` by ``order``: dealt out by ranges, numbered inside each partition and
    moved by the counts of the partitions before, so no key meets in one task."""
    placed = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    placed = checkpointed(placed.withColumn("__at", F.monotonically_increasing_id()))
    held = placed.groupBy(F.shiftright("__at", 33).alias("__p"), F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has the key
    starts = held.select("__p", "__key", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__move"))
    found = placed.join(both_sides(starts), (F.shiftright("__at", 33) == F.col("__p")) & (F.col(key) == F.col("__key")))
    return found.withColumn(number, F.col("__at") + F.col("__move")).drop("__at", "__p", "__key", "__move")


@dataclass
class Forest:
    """Trees built from their leaves.

    ``nodes``: (tree, level, lo, hi, digest, left, right) of every node below a root: the leaf ranks [lo, hi) that it covers,
    and the digests of its siblings on either side. ``roots``: (tree, height, digest). ``entries``: per band of levels, the nodes it starts from.
    """

    nodes: list[DataFrame]
    roots: DataFrame
    entries: list[DataFrame]


def build(leaves: DataFrame) -> Forest:
    """Trees of ``leaves`` (tree, rank, size, digest), where ``size`` counts the tree's leaves and ranks run from 0.

    A band of ``BAND`` levels is built per shuffle: its entries meet in buckets of up to ``FAN ** BAND`` consecutive ones, whose
    runs become their parents inside the bucket, so a tree of a billion leaves takes four shuffles.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    top = (largest - 1).bit_length() if largest > 1 else 0
    entries = leaves.select("tree", F.col("rank").alias("at"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", _height(F.col("size")).alias("height"))
    nodes, starts, roots = [], [], [entries.where("height = 0").select("tree", "height", "digest")]

    def parent(children: Column) -> Column:
        return F.struct(children[0]["lo"].alias("lo"), F.element_at(children, -1)["hi"].alias("hi"), _hashed(F.transform(children, lambda c: c["digest"])).alias("digest"))

    def families(level: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda i: F.slice(level, FAN * i + 1, FAN))

    def related(children: Column) -> Column:
        """Each child with its siblings: what its parent's interval covers besides its own, to the left and to the right."""
        part = lambda keep: _joined(F.transform(F.filter(children, keep), lambda c: c["digest"]))
        return F.transform(
            children,
            lambda own: F.struct(own["lo"].alias("lo"), own["hi"].alias("hi"), own["digest"].alias("digest"), part(lambda c: c["hi"] <= own["lo"]).alias("left"), part(lambda c: c["lo"] >= own["hi"]).alias("right")),
        )

    for base in range(0, top, BAND):
        entries = entries.where(F.col("height") > base)
        starts.append(entries)
        bucket = F.floor(F.col("at") / FAN**BAND).cast("long")
        buckets = entries.groupBy("tree", "height", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("level"))
        none = F.array().cast("array<array<struct<lo:bigint,hi:bigint,digest:binary>>>")
        built = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(BAND), F.col("height") - base)),
            F.struct(F.col("level").alias("now"), none.alias("below")),
            lambda acc, _: F.struct(F.transform(families(acc["now"]), parent).alias("now"), F.concat(acc["below"], F.array(acc["now"])).alias("below")),
        )
        done = checkpointed(buckets.select("tree", "height", "bucket", built.alias("built")))
        levels = done.select("tree", F.posexplode("built.below").alias("level", "held"))
        rows = levels.select("tree", (F.col("level") + base).alias("level"), F.explode(F.flatten(F.transform(families(F.col("held")), related))).alias("node"))
        nodes.append(rows.select("tree", "level", "node.*"))
        tops = done.select("tree", F.col("bucket").alias("at"), F.col("built.now")[0].alias("node"), "height")
        entries = tops.select("tree", "at", "node.*", "height")
        roots.append(entries.where(F.col("height") <= base + BAND).select("tree", "height", "digest"))
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return Forest(nodes, every, starts)


def paths(forest: Forest, tails: DataFrame) -> DataFrame:
    """(tree, at, steps, columns of ``tails``) of every leaf ``at`` of the trees in ``tails`` (tree, height, steps, ...): the steps to
    its root, and then those of the tail.

    In each band from the top a containment join attaches to every entry its ancestors of the band's levels: both have a bucket of
    the level's width, and the ancestor's interval holds the entry's. A bucket's root hands its own steps down to its entries.
    """
    extra = [c for c in tails.columns if c not in ("tree", "height", "steps")]
    above = None
    for r in reversed(range(len(forest.entries))):
        base = r * BAND
        ends = tails.where((F.col("height") > base) & (F.col("height") <= base + BAND)).select("tree", F.lit(0).cast("long").alias("at"), "steps", *extra)
        above = ends if above is None else above.unionByName(ends)
        last = F.least(F.lit(BAND), F.col("height") - base) + base - 1
        entries = forest.entries[r].select("tree", "at", "lo", "hi", F.explode(F.sequence(F.lit(base), last)).alias("level"))
        wide = lambda: F.floor(F.col("lo") / F.pow(F.lit(float(FAN)), F.col("level"))).cast("long")
        entries = entries.withColumn("bucket", wide())
        nodes = forest.nodes[r].select(F.col("tree").alias("n_tree"), F.col("level").alias("n_level"), wide().alias("n_bucket"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), "left", "right")
        same = (F.col("tree") == F.col("n_tree")) & (F.col("level") == F.col("n_level")) & (F.col("bucket") == F.col("n_bucket"))
        held = entries.join(nodes, same & (F.col("n_lo") <= F.col("lo")) & (F.col("n_hi") >= F.col("hi")))
        own = held.groupBy("tree", "at").agg(F.sort_array(F.collect_list(F.struct("level", "left", "right"))).alias("own"))
        up = above.select(F.col("tree").alias("u_tree"), F.col("at").alias("u_at"), F.col("steps").alias("u_steps"), *extra)
        higher = F.floor(F.col("at") / FAN**BAND).cast("long")
        joined = own.join(both_sides(up), (F.col("tree") == F.col("u_tree")) & (higher == F.col("u_at")))
        above = joined.select("tree", "at", F.concat("own", "u_steps").alias("steps"), *extra)
    alone = tails.where("height = 0").select("tree", F.lit(0).cast("long").alias("at"), "steps", *extra)
    return alone if above is None else above.unionByName(alone)


def proofs(docs: DataFrame, values: list[Column], id_col: str = "doc_id", group_col: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, steps, ``also``) of every row of ``docs``; digests are binary.

    A row's leaf is the digest of ``values`` (see :func:`leaf`). The leaves of a group ascend by the id (null first; rows with the
    same id by their leaf) and form a tree: while there are more nodes than one, every ``FAN`` consecutive ones (the last run
    may be shorter, even one) become the digest of their digests' hex text. The groups' roots, ordered by the group's
    name (null first, by UTF-8 bytes), form the tree of the root in the same way; what is alone is the root itself. ``steps`` are the
    siblings (left, right) on the way from the leaf over its group's root to the root. ``also`` are more columns of a row to carry.

    An empty table gives an empty result; equal rows have equal leaves and each its own place. Other columns are ignored.
    Ranks come from ranges, not from a window over a group, and a bucket holds ``FAN ** BAND`` entries at most, so a group with most rows spreads.
    """
    own = {"__also_" + n: c for n, c in (also or {}).items()}
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), leaf(*values).alias("digest"), *[c.alias(n) for n, c in own.items()])
    ranked = _numbered(checkpointed(rows), "name", ["id", "digest", *own], "rank")
    groups = ranked.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    listed = _numbered(checkpointed(groups.withColumn("all", F.lit(0))), "all", ["name"], "tree")
    listed = checkpointed(listed.select(F.col("name").alias("g_name"), "tree", "size"))
    leaves = ranked.join(both_sides(listed), F.col("name") == F.col("g_name")).select("id", "digest", *own, "tree", "rank", "size")
    leaves = checkpointed(leaves)

    forest = build(leaves)
    roots = checkpointed(forest.roots)
    count = listed.count()
    crown = build(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(count).cast("long").alias("size"), "digest"))
    root = crown.roots.first()
    whole = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    end = crown.roots.select("tree", "height", F.array().cast(_STEPS).alias("steps"))
    over = paths(crown, end).select(F.col("at").alias("c_tree"), "steps")
    tails = roots.join(over, F.col("tree") == F.col("c_tree")).select("tree", "height", "steps", F.col("digest").alias("subroot"))
    found = paths(forest, tails).select(F.col("tree").alias("p_tree"), "at", "steps", "subroot")
    out = leaves.join(found, (F.col("tree") == F.col("p_tree")) & (F.col("rank") == F.col("at")))
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", whole.alias("root"), "steps", *[F.col(n).alias(n.removeprefix("__also_")) for n in own])
