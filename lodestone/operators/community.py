"""Communities of weighted graphs by modularity: Louvain, Leiden and hierarchies of them.

Links: (a, b, weight), undirected, each once; a loop is a link with a = b. Louvain and Leiden
keep links in packed blocks and send out what is known of the vertices, a few numbers each
(:mod:`lodestone.operators.packed_graph`), up to a bounded number of vertices. Beyond it, and
where a phase is called alone, all are joins and aggregations by vertex or community, round by
round, of the same result; a round's labels are cut from their lineage by a reliable
checkpoint. No links are ever gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import packed_graph
from lodestone.operators.graph import coded, coded_once, cut

#: Digits of a gain that count: sums of weights may differ in their last bits from run to run.
DIGITS = 9
#: Vertices up to which labels go to all tasks, at 24 bytes each; beyond, they are dealt out and joined.
BROADCAST_VERTICES = 2_000_000


def both_ways(links: DataFrame) -> DataFrame:
    """Each link from either end, a loop twice, so that sums by end are degrees."""
    return links.select("a", "b", "weight").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling (id, label) of all vertices; null without links."""
    ends = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    placed = links.join(labels.select(F.col("id").alias("a"), "label"), "a").join(ends, "b")
    both = placed.select("label", "weight").union(placed.select(F.col("label_b").alias("label"), "weight"))
    squares = both.groupBy("label").agg(F.sum("weight").alias("degree")).agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    inner = placed.agg(F.sum(F.when(F.col("label") == F.col("label_b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    return inner.join(squares).select((F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _turns(rounds: int) -> Column:
    """Whose turn it is to move, by the hash of an id: a bit for each round."""
    return reduce(lambda x, i: x.bitwiseOR(F.when(F.xxhash64("id", F.lit(i)) % 2 == 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")), range(rounds), F.lit(0).cast("long"))


def local_moves(links: DataFrame, rounds: int = 12, start: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """((id, label), modularity after each round): vertices move to the neighbouring community of the largest gain.

    From ``start`` (id, label), or each vertex by itself. Half of the vertices, by a hash of
    their own for each round, may move in a round, so that neighbours don't swap. The labels
    are those of the best round; rounds end once no vertex would move, or five have gained
    nothing. A vertex's loop stays with it wherever it goes, so it counts for its degree and
    for no gain.
    """
    ids, both = coded(links, None if start is None else start.select(F.col("label").alias("id")))
    # from here to the end vertices and labels are longs in the order of their ids; whose turn a round is comes from the ids
    names = ids.select("code", _turns(rounds).alias("turns"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))
    if start is None:
        first = degree.withColumn("label", F.col("id"))
    else:
        named = start.join(ids, "id").select(F.col("code").alias("vertex"), F.col("label").alias("id"))
        first = degree.join(named.join(ids, "id").select(F.col("vertex").alias("id"), F.col("code").alias("label")), "id")
    labels = cut(first.join(names.withColumnRenamed("code", "id"), "id").select("id", "label", "degree", "turns"))
    small = labels.count() <= BROADCAST_VERTICES
    sent = F.broadcast if small else (lambda x: x)
    near = cut(both.where("a <> b").join(sent(labels.select(F.col("id").alias("a"), "degree")), "a").select("a", "b", "weight", "degree"))
    twice, loops = both.agg(F.sum("weight"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0))).first()
    twice, best, history, settled = twice or 1.0, labels, [], False
    for i in range(rounds + 1):
        totals = labels.groupBy("label").agg(F.sum("degree").alias("total"))
        inside = near.join(sent(labels.select(F.col("id").alias("b"), "label")), "b").select(F.col("a").alias("id"), "label", "degree", "weight", F.lit(False).alias("stays"))
        own = labels.select("id", "label", "degree", F.lit(0.0).alias("weight"), F.lit(True).alias("stays"))
        options = inside.union(own).groupBy("id", "label", "degree").agg(F.sum("weight").alias("inside"), F.max("stays").alias("stays"))
        options = cut(options.join(sent(totals), "label"))
        # the options to stay hold all that modularity needs: twice the links inside, and the squares of totals vertex by vertex
        now = options.where("stays").agg(F.sum("inside"), F.sum(F.col("degree") * F.col("total"))).first()
        history.append(((now[0] or 0.0) + (loops or 0.0)) / twice - (now[1] or 0.0) / (twice * twice))
        if i == 0 or history[-1] > max(history[:-1]) + 1e-12:
            best = labels
        if i == rounds or settled or i >= 5 and max(history[-5:]) <= max(history[:-5]) + 1e-12:
            break
        rest = F.col("total") - F.when(F.col("stays"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("inside") - F.col("degree") * rest / twice, DIGITS)
        choice = F.min(F.struct((-gain).alias("g"), (~F.col("stays")).alias("leaves"), "label"))["label"]
        placed = options.groupBy("id", "degree").agg(choice.alias("chosen"), F.max(F.when(F.col("stays"), F.col("label"))).alias("was"))
        moves = F.col("turns").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        placed = placed.join(labels.select("id", "turns"), "id")
        labels = cut(placed.select("id", F.when(moves, F.col("chosen")).otherwise(F.col("was")).alias("label"), "degree", "turns", (F.col("chosen") != F.col("was")).alias("wants")))
        settled = labels.where("wants").isEmpty()  # no vertex would rather be elsewhere, whoever's turn it is
    back = best.select(F.col("id").alias("code"), "label").join(ids, "code").select("id", F.col("label").alias("code"))
    return cut(back.join(ids.select("code", F.col("id").alias("label")), "code").select("id", "label")), history


def refine(links: DataFrame, labels: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, label): parts of the communities ``labels``, each connected within its own.

    Every vertex starts by itself. In a round those still alone, half of them by a hash, join
    the part of the largest positive gain among the neighbouring parts of their community that
    stand still in that round. Only well-connected vertices join, and only well-connected
    parts are joined: their links to the rest of the community must be no fewer than degrees
    alone would give. As parts only grow, and by neighbours, each stays connected.
    """
    both = cut(both_ways(links))
    twice = both.agg(F.sum("weight")).first()[0] or 1.0
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))
    vertices = cut(degree.join(labels.select("id", F.col("label").alias("community")), "id"))
    whole = vertices.groupBy("community").agg(F.sum("degree").alias("all"))
    placed = both.where("a <> b").join(vertices.select(F.col("id").alias("a"), "community"), "a")
    inner = cut(placed.join(vertices.select(F.col("id").alias("b"), F.col("community").alias("other")), "b").where("community = other").select("a", "b", "weight"))
    parts = cut(vertices.select("id", F.col("id").alias("label"), "community", "degree"))
    idle = 0
    for i in range(rounds):
        ends = inner.join(parts.select(F.col("id").alias("a"), F.col("label").alias("from")), "a").join(parts.select(F.col("id").alias("b"), F.col("label").alias("to")), "b")
        out = ends.where("from <> to").groupBy(F.col("from").alias("label")).agg(F.sum("weight").alias("out"))
        sizes = parts.groupBy("label", "community").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("total"))
        sound = F.round(F.col("out") - F.col("total") * (F.col("all") - F.col("total")) / twice, DIGITS) >= 0
        state = sizes.join(out, "label").join(whole, "community").where(sound)
        turn = (F.col("size") == 1) & (F.pmod(F.xxhash64("label") + i, F.lit(2)) == 0)
        state = state.select("label", "total", turn.alias("moves"))
        movers = state.where("moves").select(F.col("label").alias("from"), F.col("total").alias("degree"))
        targets = state.where("not moves").select(F.col("label").alias("to"), "total")
        met = ends.join(movers, "from").groupBy("from", "to", "degree").agg(F.sum("weight").alias("inside")).join(targets, "to")
        options = met.select(F.col("from").alias("id"), F.col("to").alias("label"), F.round(F.col("inside") - F.col("degree") * F.col("total") / twice, DIGITS).alias("gain"))
        best = F.min(F.struct((-F.col("gain")).alias("g"), "label"))["label"]
        chosen = cut(options.where("gain > 0").groupBy("id").agg(best.alias("chosen")))
        idle = idle + 1 if chosen.isEmpty() else 0
        if idle == 2:  # neither half has anything to join
            break
        parts = cut(parts.join(chosen, "id", "left").select("id", F.coalesce("chosen", "label").alias("label"), "community", "degree"))
    return parts.select("id", "label")


def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between communities, their weights added up; those within one are its loop."""
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    return cut(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight")))


def _through(placed: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Labels of the vertices below: each vertex's node, then that node's label."""
    if placed is None:
        return cut(labels)
    up = labels.select(F.col("id").alias("node"), "label")
    return cut(placed.select("id", F.col("label").alias("node")).join(up, "node").select("id", "label"))


def _packed(links: DataFrame, rounds: int) -> tuple[DataFrame, packed_graph.Packed, np.ndarray, np.ndarray] | None:
    """(ids, graph, turns, odd hashes) of written links with vertices as numbers in the order of their ids; None for too many of them."""
    ids, one = coded_once(links.where("a IS NOT NULL AND b IS NOT NULL"))
    n = ids.count()
    if n > BROADCAST_VERTICES:
        return None
    one = one.select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"), "weight")
    known, inner = np.zeros((2, n), np.int64), one.where("a = b").groupBy("a").agg(F.sum("weight").alias("weight")).dropna().toPandas()
    hashes = ids.select("code", _turns(rounds).alias("turns"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("odd")).toPandas()
    known[:, hashes["code"].to_numpy(np.int64) - 1] = hashes[["turns", "odd"]].to_numpy(np.int64).T
    loops = np.bincount(inner["a"].to_numpy(np.int64), inner["weight"].to_numpy(np.float64), n)
    return ids, packed_graph.packed(one.where("a <> b"), np.arange(n), loops), known[0], known[1]


def _labelled(ids: DataFrame, placed: list[np.ndarray]) -> DataFrame:
    """(id, level, label) of the numbers that vertices have as labels, level by level."""
    sent = ids.sparkSession.sparkContext.broadcast(placed)

    def run(batches):
        for part in batches:
            at = part["code"].to_numpy() - 1
            for level, labels in enumerate(sent.value):
                yield part[["id"]].assign(level=level, code=labels[at] + 1)

    rows = ids.mapInPandas(run, f"id {ids.schema['id'].dataType.simpleString()}, level int, code long")
    return cut(rows.join(ids.select("code", F.col("id").alias("label")), "code").select("id", "level", "label"))


def louvain(links: DataFrame, levels: int = 4, rounds: int = 12) -> DataFrame:
    """(id, level, label): communities by local moves, then of the graph of communities, while modularity rises."""
    links = cut(links.select("a", "b", "weight"))
    if (known := _packed(links, rounds)) is None:
        return _louvain_joined(links, levels, rounds)
    ids, graph, turns, _ = known
    found, score = [], None
    for level in range(levels):
        labels, history = packed_graph.moves(graph, turns[graph.names], rounds, graph.names)
        if score is not None and max(history) <= score + 1e-9:
            break
        score = max(history)
        found.append(labels if level == 0 else labels[np.searchsorted(graph.names, found[-1])])
        if level == levels - 1 or (labels == graph.names).all():  # the graph of the communities would be this one
            break
        graph = packed_graph.merged(graph, labels)
    return _labelled(ids, found)


def _louvain_joined(links: DataFrame, levels: int, rounds: int) -> DataFrame:
    """The same for any number of vertices."""
    found, placed, graph, score = None, None, links, None
    for level in range(levels):
        labels, history = local_moves(graph, rounds)
        if score is not None and max(history) <= score + 1e-9:
            break
        score, placed = max(history), _through(placed, labels)
        rows = placed.select("id", F.lit(level).alias("level"), "label")
        found = rows if found is None else found.union(rows)
        graph = merged(graph, labels)
    return found


def top_level(found: DataFrame) -> DataFrame:
    """(id, label) of the last level of :func:`louvain`."""
    last = found.agg(F.max("level")).first()[0]
    return found.where(F.col("level") == F.lit(last)).select("id", "label")


def connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with each label split into its connected parts; a part's label is its smallest vertex.

    Vertices take the smallest label among their neighbours' of the same community, then that
    label's own label, until nothing changes: paths halve, so rounds grow with the logarithm.
    Splitting a label that isn't connected raises modularity.
    """
    both = both_ways(links).where("a <> b").select("a", "b")
    same = both.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x = y")
    same = cut(same.select("a", "b"))
    now = cut(labels.select("id", F.col("id").alias("low")))
    while True:
        least = same.join(now.select(F.col("id").alias("b"), "low"), "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("near"))
        met = now.join(least, "id", "left").select("id", "low", F.least("low", F.coalesce("near", "low")).alias("hop"))
        # a vertex tells its old root of its new one, then follows its root's root
        told = met.groupBy(F.col("low").alias("root")).agg(F.min("hop").alias("down"))
        hops = cut(met.join(told.select(F.col("root").alias("id"), "down"), "id", "left").select("id", F.col("low").alias("was"), F.least("hop", F.coalesce("down", "hop")).alias("low")))
        roots = hops.select(F.col("id").alias("low"), F.col("low").alias("root"))
        after = cut(hops.join(roots, "low").select("id", "was", F.col("root").alias("low")))
        now = after.select("id", "low")
        if after.where("was <> low").isEmpty():
            return now.select("id", F.col("low").alias("label"))


def leiden(links: DataFrame, levels: int = 4, rounds: int = 12) -> DataFrame:
    """(id, label): communities by local moves, refinement and aggregation; every one is connected.

    Each level moves vertices, refines the communities into well-connected parts and merges
    the parts to the next level's vertices, which start in the communities found so far; so
    parts may leave a community that merging it whole would have bound for good. The last
    partition is split where it isn't connected.
    """
    links = cut(links.select("a", "b", "weight"))
    if (known := _packed(links, rounds)) is None:
        return _leiden_joined(links, levels, rounds)
    ids, whole, turns, odd = known
    graph, start, nodes = whole, whole.names, whole.names
    for _ in range(levels):
        labels, _ = packed_graph.moves(graph, turns[graph.names], rounds, start)
        result = labels[np.searchsorted(graph.names, nodes)]
        parts = packed_graph.refined(graph, odd[graph.names], rounds, labels)
        if (parts == graph.names).all():
            break
        nodes = parts[np.searchsorted(graph.names, nodes)]
        # a part is named after the vertex that the others joined, and lies in its community
        start = labels[np.searchsorted(graph.names, np.unique(parts))]
        graph = packed_graph.merged(graph, parts)
    return _labelled(ids, [packed_graph.connected(whole, result)]).select("id", "label")


def _leiden_joined(links: DataFrame, levels: int, rounds: int) -> DataFrame:
    """The same for any number of vertices."""
    graph = whole = links
    start = nodes = result = None
    for _ in range(levels):
        labels, _ = local_moves(graph, rounds, start)
        result = _through(nodes, labels)
        parts = refine(graph, labels, rounds)
        if parts.where("id <> label").isEmpty():
            break
        nodes = _through(nodes, parts)
        # a part is named after the vertex that the others joined, and lies in its community
        start = cut(parts.select("label").distinct().join(labels.select(F.col("id").alias("label"), F.col("label").alias("community")), "label").select(F.col("label").alias("id"), F.col("community").alias("label")))
        graph = merged(graph, parts)
    return connected(result, whole)


def hierarchy(links: DataFrame, labels: DataFrame, levels: int = 3, rounds: int = 12) -> DataFrame:
    """(level, community, parent, entity_count, child_count): communities of communities.

    Level 0 holds the labels' communities, without children. The graph of a level counts the
    links between each two of its communities; its Louvain groups of two or more become the
    next level. A community that joins none has no parent and goes no further. It ends at
    ``levels``, at a single community, or where no links are left between any.
    """
    members = labels.select("id", "label")
    now = cut(members.groupBy(F.col("label").alias("community")).agg(F.count(F.lit(1)).alias("entity_count")).withColumn("child_count", F.lit(0).cast("long")))
    out, level = None, 0
    counted = links.select("a", "b", F.lit(1.0).alias("weight"))
    while True:
        parents = None
        if level < levels - 1 and now.count() > 1:
            counted = merged(counted, members).where("a <> b")
            if not counted.isEmpty():
                groups = top_level(louvain(counted, rounds=rounds))
                several = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
                parents = cut(groups.join(several, "label").select("id", "label"))
                parents = None if parents.isEmpty() else parents
        up = now.select("community", F.lit(None).alias("parent")) if parents is None else now.select("community").join(parents.select(F.col("id").alias("community"), F.col("label").alias("parent")), "community", "left")
        rows = now.join(up, "community").select(F.lit(level).alias("level"), "community", F.col("parent").cast(labels.schema["label"].dataType).alias("parent"), "entity_count", "child_count")
        out = rows if out is None else out.union(rows)
        if parents is None:
            return out
        now = cut(rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("community")).agg(F.sum("entity_count").alias("entity_count"), F.count(F.lit(1)).alias("child_count")))
        members, level = parents, level + 1
