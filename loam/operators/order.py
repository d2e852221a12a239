"""Order of deep graphs: components of mutual imports, and levels, in few jobs.

A node that has one open dependency stands a fixed way above it, so it is taken out and hung on it; chains of such nodes are
followed by pointer doubling, 100,000 nodes in 17 steps. What is left loses its ready nodes level by level. For cycles, every
node that has one edge in, or one out, first goes into that edge's other end, over and over, and is told back from there. What
is left of the graph then has branches at every node; its cycles are told apart by forward and backward colouring, where paths
without branches are followed by doubling too. Every step ends in a stored table, of which only those that are read later stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.scratch import free, stored


def _known(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = nodes.select("id").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return ids, e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _followed(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (id, to, base, w) followed to their ends: (those that end, those that lead into a ring).

    The value of id is the larger of base and that of `to` plus w. Each step doubles the length of all pointers.
    """
    p = stored(pointers.withColumn("on", F.lit(True)), "pointers")
    steps = max(1, p.count()).bit_length() + 1
    for _ in range(steps):
        q = p.select(F.col("id").alias("at"), F.col("to").alias("to2"), F.col("base").alias("base2"), F.col("w").alias("w2"))
        further = p.join(q, F.col("to") == F.col("at"), "left")
        base = F.greatest("base", F.coalesce(F.col("base2") + F.col("w"), F.col("base")))
        last, p = p, stored(further.select("id", F.coalesce("to2", "to").alias("to"), base.alias("base"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.col("at").isNotNull().alias("on")), "pointers")
        free(last)
        if p.where("on").isEmpty():
            break
    return p.where("not on").drop("on"), p.where("on").select("id")


def acyclic_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of the nodes that no cycle lies behind: 0 without dependencies, else one more than the highest of theirs."""
    ids, e = _known(nodes, edges)
    e = stored(e.withColumn("w", F.lit(1)), "edges")
    left = stored(ids.withColumn("base", F.lit(0)), "open")
    done: list[DataFrame] = []
    hung: list[DataFrame] = []
    while True:
        out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"), F.min("w").alias("w"))
        state = stored(left.join(out, F.col("id") == F.col("src"), "left").select("id", "base", F.coalesce("n", F.lit(0)).alias("n"), "to", "w"), "state")
        free(left)
        ready = state.where("n = 0").select("id", F.col("base").alias("level"))
        single = state.where("n = 1").select("id", "to", "base", "w")
        no_ready, no_single = ready.isEmpty(), single.isEmpty()
        hang = None
        if not no_single:
            hang, _ = _followed(single)  # those that lead into a ring are never ready, and neither is what asks for them
            hang = None if hang.isEmpty() else hang
        if not no_ready:
            done.append(stored(ready, "ready"))
        if hang is not None:
            hung.append(hang)
        if no_ready and hang is None:
            break
        rest = state.where("n > 1").select("id", "base")
        x = e.join(rest.select(F.col("id").alias("src")), "src", "left_semi").withColumn("b", F.lit(None).cast("int"))
        if hang is not None:
            h = hang.select(F.col("id").alias("dst"), "to", F.col("base").alias("hbase"), F.col("w").alias("hw"))
            x = x.join(h, "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"), (F.col("w") + F.coalesce("hw", F.lit(0))).alias("w"), (F.col("hbase") + F.col("w")).alias("b"))
        r = ready.select(F.col("id").alias("dst"), "level", F.lit(True).alias("is_ready"))
        x = stored(x.join(r, "dst", "left").select("src", "dst", "w", F.greatest("b", F.col("level") + F.col("w")).alias("b"), F.coalesce("is_ready", F.lit(False)).alias("is_ready")), "mapped")
        gained = x.groupBy("src").agg(F.max("b").alias("b"))
        left = stored(rest.join(gained, F.col("id") == F.col("src"), "left").select("id", F.greatest("base", F.coalesce("b", F.lit(0))).alias("base")), "open")
        last, e = e, stored(x.where("not is_ready").groupBy("src", "dst").agg(F.max("w").alias("w")), "edges")
        free(last, x, state)
        if left.isEmpty():
            break
    levels = stored(reduce(DataFrame.unionByName, done), "levels") if done else ids.where("false").select("id", F.lit(0).alias("level"))
    for h in reversed(hung):
        found = h.join(levels.select(F.col("id").alias("to"), "level"), "to").select("id", F.greatest("base", F.col("level") + F.col("w")).alias("level"))
        last, levels = levels, stored(levels.unionByName(found), "levels")
        free(last)
    return levels


def _relaxed(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): the largest value of a node and all that lead to it; edges (a, b) lead from a to b, start (id, value).

    A node that one edge alone leads to also looks back along it, twice as far in every round.
    """
    e = stored(edges.select("a", "b").distinct(), "leading")
    back = stored(e.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b"), "back")
    v = stored(start.select("id", "value"), "values")
    while True:
        both = e.unionByName(back)
        news = v.select(F.col("id").alias("a"), "value").join(both, "a").groupBy("b").agg(F.max("value").alias("new"))
        last, v2 = v, stored(v.join(news, F.col("id") == F.col("b"), "left").select("id", F.greatest("value", "new").alias("value"), (F.col("new") > F.col("value")).alias("grew")), "values")
        v = v2.select("id", "value")
        if v2.where("grew").isEmpty():
            free(last, back, e)
            return v
        further = back.select(F.col("a").alias("at"), "b").join(back.select("a", F.col("b").alias("at")), "at", "left")
        old, back = back, stored(further.select(F.coalesce("a", "at").alias("a"), "b"), "back")
        free(old)
        v = v2.select("id", "value")


def _trees(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (id, to) as trees: the pointers, of which each ring has lost that of its least id, and (id, root) of all that still have one."""
    while True:
        p = stored(pointers.withColumn("low", F.least("id", "to")).withColumn("on", F.lit(True)), "pointers")
        for _ in range(max(1, p.count()).bit_length() + 1):
            q = p.select(F.col("id").alias("at"), F.col("to").alias("to2"), F.col("low").alias("low2"))
            further = p.join(q, F.col("to") == F.col("at"), "left")
            last, p = p, stored(further.select("id", F.coalesce("to2", "to").alias("to"), F.least("low", "low2").alias("low"), F.col("at").isNotNull().alias("on")), "pointers")
            free(last)
            if p.where("on").isEmpty():
                return pointers, p.select("id", F.col("to").alias("root"))
        ring = p.where("on").select(F.col("to").alias("id")).distinct()  # so many steps on, all are on a ring
        heads = p.join(ring, "id", "left_semi").where("id = low").select("id")
        last, pointers = pointers, stored(pointers.join(heads, "id", "left_anti"), "hung")
        free(last, p)


def _hung(left: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """What is left, its edges (not stored), and the trees (pointers, roots), when every node that one edge alone leads to has gone into the node it comes from; none if there is no such node."""
    single = stored(e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to")).where("n = 1").select(F.col("dst").alias("id"), "to"), "hung")
    if single.isEmpty():
        free(single)
        return None
    pointers, roots = _trees(single)
    gone = roots.select("id")
    fewer = e.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").join(roots.withColumnRenamed("id", "src"), "src", "left").select(F.coalesce("root", "src").alias("src"), "dst")
    return stored(left.join(gone, "id", "left_anti"), "left"), fewer.where("src <> dst").distinct(), pointers, roots


def _unhung(found: DataFrame, e: DataFrame, pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, component) of all nodes, from that of those which were left by _hung.

    A node that one edge alone leads to is in a cycle only with its root, so it must lead back to it: an edge out of the
    part of the tree below it, itself included, has to go to the root's component.
    """
    of = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(k + "_"))
    out = e.join(of("dst"), "dst").join(roots.withColumnRenamed("id", "src"), "src").join(of("root"), "root").where("dst_ = root_")
    back, step = stored(out.select(F.col("src").alias("id")).distinct(), "back"), pointers
    n = back.count()
    while n:
        above = back.join(step, "id").select(F.col("to").alias("id"))
        last, back = back, stored(back.union(above).distinct(), "back")
        free(last)
        n, before = back.count(), n
        if n == before:
            break
        last, step = step, stored(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to").select("id", F.col("to2").alias("to")), "pointers")
        if last is not pointers:
            free(last)
    own = roots.join(back.withColumn("is_back", F.lit(True)), "id", "left").join(of("root"), "root")
    return stored(found.unionByName(own.select("id", F.when(F.col("is_back"), F.col("root_")).otherwise(F.col("id")).alias("component"))), "components")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of all nodes that a node reaches and that reach it; itself, if there is none other."""
    ids, e = _known(nodes, edges)
    left, e = stored(ids, "left"), stored(e, "edges")
    found: list[DataFrame] = []
    trees: list[tuple] = []
    turned = lambda x: x.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    within = lambda x, of: x.join(of.select(F.col("id").alias("src")), "src", "left_semi").join(of.select(F.col("id").alias("dst")), "dst", "left_semi")
    while True:
        went = True
        while went:  # cycles are the same, and ways between them short, when nodes of one edge in, or out, have gone into its other end
            went = False
            for way in (lambda x: x, turned):
                told = _hung(left, way(e))
                if told:
                    trees.append((way(e), *told[2:]))
                    left, e, went = told[0], stored(way(told[1]), "edges"), True
        if e.isEmpty():
            found.append(left.withColumn("component", F.col("id")))
            break
        before = left.count()
        for way in (lambda x: x, turned):  # nodes that no cycle lies behind, or before, are alone
            alone = acyclic_levels(left, way(e)).select("id")
            found.append(alone.withColumn("component", F.col("id")))
            left = stored(left.join(alone, "id", "left_anti"), "left")
            e = stored(within(e, left), "edges")
        after = left.count()
        if not after:
            break
        if after < before:
            continue
        # a colour is a node of its own, in an order dealt anew each time, so that many components are found at once
        first = F.concat(F.lpad(F.hex(F.xxhash64("id", F.lit(len(found)))), 16, "0"), F.lit(" "), F.col("id").cast("string"))
        colour = stored(_relaxed(left.withColumn("value", first), e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("value", "colour"), "colours")
        c = lambda k: colour.select(F.col("id").alias(k), F.col("colour").alias(k + "_colour"))
        same = stored(e.join(c("src"), "src").join(c("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"), "same")
        reached = _relaxed(colour.select("id", (first == F.col("colour")).cast("int").alias("value")), same.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("value = 1")
        mine = reached.select("id").join(colour, "id")
        least = mine.groupBy("colour").agg(F.min("id").alias("component"))
        found.append(stored(mine.join(least, "colour").select("id", "component"), "components"))
        left = stored(left.join(found[-1], "id", "left_anti"), "left")
        e = stored(within(same, left), "edges")  # no component has two colours
    told = reduce(DataFrame.unionByName, found)
    for hung in reversed(trees):
        last, told = told, _unhung(told, *hung)
        free(last, *hung)
    least = told.groupBy("component").agg(F.min("id").alias("least"))
    return told.join(least, "component").select("id", F.col("least").alias("component"))


def condensed_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, level) of every node: each component comes after all it imports, and its nodes share a level."""
    of = stored(components(nodes, edges), "components")
    name = lambda k: of.select(F.col("id").alias(k), F.col("component").alias(k + "_"))
    between = edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_").alias("src"), F.col("dst_").alias("dst"))
    levels = acyclic_levels(of.select(F.col("component").alias("id")), between)
    return of.join(levels.select(F.col("id").alias("component"), "level"), "component").select("id", "component", "level")
