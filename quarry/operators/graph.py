"""Graphs as tables: nodes (id, level) and edges (layer, src, pos, dst); checks and statistics in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.kernels import max_degree
from quarry.operators.truth import share


def knn_edges(neighbours: DataFrame, layer: int = 0) -> DataFrame:
    """Edges of a neighbour table (qid, rank, id)."""
    return neighbours.select(F.lit(layer).alias("layer"), F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"))


def members(nodes: DataFrame) -> DataFrame:
    """(layer, id): a node stands on every layer up to its level."""
    return nodes.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("layer"), "id")


def layer_stats(nodes: DataFrame, edges: DataFrame, m: int = 16, max_degree0: int = 0) -> DataFrame:
    """For each layer: nodes, edges, min, max and mean degree, isolated nodes, one-way edges and their share, the degree
    cap and the bytes of its slots."""
    degree = edges.groupBy("layer", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    per = members(nodes).join(degree, ["layer", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    stats = per.groupBy("layer").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("isolated"),
    )
    back = edges.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = edges.select("layer", "src", "dst").join(back, ["layer", "src", "dst"], "left_anti").groupBy("layer").agg(F.count(F.lit(1)).alias("one_way"))
    cap = max_degree(F.col("layer"), m, max_degree0)
    out = stats.join(one_way, "layer", "left").withColumn("one_way", F.coalesce("one_way", F.lit(0)))
    return out.select(
        "layer", "nodes", "edges", "min_degree", "max_degree", share(F.col("edges").cast("double"), F.col("nodes"), 0.0).alias("mean_degree"), "isolated", "one_way",
        share(F.col("one_way").cast("double"), F.col("edges"), 0.0).alias("asymmetry_ratio"), cap.cast("long").alias("degree_cap"), (F.col("nodes") * (cap + 1) * 4).cast("long").alias("bytes"),
    )


def total_stats(layers: DataFrame) -> DataFrame:
    """One row over all layers of layer_stats."""
    r = layers.agg(
        F.count(F.lit(1)).alias("layers"), F.coalesce(F.max(F.when(F.col("layer") == 0, F.col("nodes"))), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"),
        F.coalesce(F.sum("one_way"), F.lit(0)).alias("one_way"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
    return r.select("*", share(F.col("one_way").cast("double"), F.col("edges"), 0.0).alias("asymmetry_ratio"))


def violations(nodes: DataFrame, edges: DataFrame, entry: int | None, m: int = 16, max_degree0: int = 0) -> DataFrame:
    """kind, layer, node, other of everything that a graph must not have:

    DegreeAboveCap, SelfLoop, DuplicateNeighbor, NeighborOutOfRange (no such node), NeighborNotOnLayer, LevelMismatch (an
    edge from a layer above the source's level), LayerGap (a layer without node below the top), IsolatedOnLayerZero (of
    more than one node), MissingEntryPoint and EntryPointBelowTop."""
    long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    row = lambda df, kind, layer, node, other=F.lit(None): df.select(F.lit(kind).alias("kind"), layer.cast("int").alias("layer"), long(node).alias("node"), long(other).alias("other"))
    at, none = F.col("layer"), F.lit(None)
    degree = edges.groupBy("layer", "src").agg(F.count(F.lit(1)).alias("n"))
    target = edges.join(nodes.select(F.col("id").alias("dst"), F.col("level").alias("dst_level")), "dst", "left")
    source = edges.select("layer", "src").distinct().join(nodes.select(F.col("id").alias("src"), F.col("level").alias("src_level")), "src", "left")
    top = nodes.agg(F.max("level").alias("top"), F.count(F.lit(1)).alias("n"))
    wanted = top.where("top is not null").select(F.explode(F.sequence(F.lit(0), "top")).alias("layer"))
    present = members(nodes).select("layer").distinct()
    lonely = members(nodes).where("layer = 0").join(edges.where("layer = 0").select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    several = top.where("n > 1").select(F.lit(0).alias("layer"))
    parts = [
        row(degree.where(F.col("n") > max_degree(at, m, max_degree0)), "DegreeAboveCap", at, "src", "n"),
        row(edges.where("src = dst"), "SelfLoop", at, "src", "dst"),
        row(edges.groupBy("layer", "src", "dst").count().where("count > 1"), "DuplicateNeighbor", at, "src", "dst"),
        row(target.where("dst_level is null"), "NeighborOutOfRange", at, "src", "dst"),
        row(target.where("dst_level < layer"), "NeighborNotOnLayer", at, "src", "dst"),
        row(source.where("src_level is null or src_level < layer"), "LevelMismatch", at, "src"),
        row(wanted.join(present, "layer", "left_anti"), "LayerGap", at, none),
        row(lonely.join(several, "layer"), "IsolatedOnLayerZero", at, "id"),
    ]
    if entry is None:
        parts.append(row(top.where("n > 0"), "MissingEntryPoint", none, none))
    else:
        known = nodes.where(F.col("id") == entry).agg(F.max("level").alias("own"))
        both = top.join(known)  # one row each
        parts.append(row(both.where("n > 0 and own is null"), "MissingEntryPoint", none, F.lit(entry)))
        parts.append(row(both.where("own < top"), "EntryPointBelowTop", F.col("top"), F.lit(entry)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unreached(nodes: DataFrame, edges: DataFrame, entry: int, rounds: int = 64) -> DataFrame:
    """Nodes that no path of layer 0 reaches from the entry: no violation, but never found.  One join a hop."""
    steps = edges.where("layer = 0").select("src", F.col("dst").alias("id"))
    seen = nodes.where(F.col("id") == entry).select("id")
    front = seen
    for _ in range(rounds):
        front = steps.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select("id").distinct().join(seen, "id", "left_anti").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    return nodes.join(seen, "id", "left_anti").select("id")
