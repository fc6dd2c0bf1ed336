"""Connected components of links between rows.

Tasks first replace the links they hold by a spanning forest of them. What is left is contracted: every
node takes the name of the neighbour, or itself, that comes first in an order drawn anew for the
round, links are renamed, and equal ones merged. The number of rounds grows with the logarithm of the longest
path. As soon as the links fit into one task of a stated size, they are resolved there; then the
names are followed back down. Hot nodes are split in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.functions.skew import join_groups
from loginlab.sources.attempts import materialize, release

LINKS_PER_TASK = 1_000_000


def roots(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The nodes of links a - b, and the smallest node each is connected with."""
    nodes = pc.unique(pa.concat_arrays([a, b])).sort()
    ends = [pc.index_in(x, value_set=nodes).to_numpy() for x in (a, b)]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[ends[0]], root[ends[1]])
        new = root.copy()
        for end in ends:
            np.minimum.at(new, root[end], low)  # the whole tree follows its root
        new = new[new]
        if (new == root).all():
            return nodes, nodes.take(pa.array(root))
        root = new


def _forests(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield _forest(held)
                held = []
        if held:
            yield _forest(held)

    return run


def _forest(held) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    node, root = roots(*(table[c].combine_chunks() for c in ("a", "b")))
    other = pc.not_equal(node, root)
    return pa.RecordBatch.from_arrays([node.filter(other), root.filter(other)], ["a", "b"])


def components(links: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """⟨node, component⟩ of links ⟨a, b⟩: every node with a link to another one, and the smallest node of
    its component. Null ends and links of a node with itself say nothing; repeated links count once."""
    kind = links.schema["a"].dataType.simpleString()
    fields = f"a {kind}, b {kind}"
    forests = lambda df: materialize(df.select("a", "b").mapInArrow(_forests(per_task), fields), "links")
    links = forests(links.where("a <> b"))
    steps: list[DataFrame] = []
    names = None
    while links.count() > per_task:
        if names is None:
            names = links.select(F.col("a").alias("name")).union(links.select("b")).distinct()
            names = materialize(names.withColumn("least", F.col("name")), "names")
        first, contracted = _contract(links, len(steps))
        step = names.join(first.select(F.col("x").alias("name"), "to"), "name", "left")
        step = materialize(step.withColumn("to", F.coalesce("to", "name")), "step")
        steps.append(step.select("name", "to"))
        names = materialize(step.groupBy(F.col("to").alias("name")).agg(F.min("least").alias("least")), "names")
        # random tasks, so that forests find other links together than before
        fewer = forests(contracted.repartition(F.xxhash64("a", F.lit(len(steps)))))
        release(first)
        release(links)
        links = fewer

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most per_task links
        if held:
            table = pa.Table.from_batches(held)
            node, root = roots(*(table[c].combine_chunks() for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([node, root], ["node", "component"])

    top = links.coalesce(1).mapInArrow(finish, f"node {kind}, component {kind}")
    if names is None:
        return top
    # names without links stand for themselves; a component is called after its smallest member
    root = F.coalesce("component", "name").alias("root")
    top = materialize(names.join(top.withColumnRenamed("node", "name"), "name", "left").select("name", "least", root), "top")
    least = materialize(top.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), "least")
    found = join_groups(top, least, ["root"], "n", "name").select("name", "component")
    for step in reversed(steps):
        above = step.groupBy("to").agg(F.count("*").alias("n"))
        above = materialize(above.join(found.withColumnRenamed("name", "to"), "to"), "above")
        found = join_groups(step, above, ["to"], "n", "name").select("name", "component")
    return found.withColumnRenamed("name", "node")


def _contract(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The new name of every node, and the renamed links."""

    def draw(c):
        return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("draw"), F.col(c).alias("id"))

    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.groupBy("x").agg(F.min(draw("y")).alias("near"), F.count("*").alias("n"))
    first = materialize(near.select("x", F.least(draw("x"), "near")["id"].alias("to"), "n"), "first")
    for old, new, spread in (("a", "_a", "b"), ("b", "_b", "_a")):
        names = first.select(F.col("x").alias(old), F.col("to").alias(new), F.col("n").alias("_n"))
        links = join_groups(links, names, [old], "_n", spread).drop("_n")
    return first, links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct()
