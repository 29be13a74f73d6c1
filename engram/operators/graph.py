"""Bounded traversals of the edge table: hops, expansion, paths, provenance, session chains.

Each hop is one join with the edges. Frontiers are settled after each hop (a checkpoint in the
shared folder), so a plan never holds the hops before, and a lost executor costs one hop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators import edges as E
from engram.operators.lineage import settle
from engram.operators.linkers import shared_entity_neighbors
from engram.settings import DEFAULTS, DIRECTED_TYPES, INTENT_TYPES, PROVENANCE_TYPES, Settings

#: Neighbors in one row of a table of neighbors, at most.
LIST_NODES = 1024
#: Rows (pair, node) of a frontier that one slice of the last hop starts from, about.
FRONTIER_ROWS = 1 << 25


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other): distinct pairs, both ways."""
    return E.both_ways(edges).select("node", "other").distinct()


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance): least number of edges from each start, up to depth; starts themselves at 0."""
    pairs = undirected(edges)
    seen = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(pairs, "node").select("start", F.col("other").alias("node")).distinct()
        frontier = settle(step.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def multihop(edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 20, max_starts: int = 50, seqs: DataFrame | None = None) -> DataFrame:
    """(node, distance, graph_score): nodes near any start, without the starts; score = 1 / (1 + distance).

    Ties go to the later event_seq of seqs(node, event_seq), if given, then to the greater id.
    """
    first = starts.select("node").distinct().orderBy("node").limit(max_starts)
    near = hops(edges, first, max(1, min(depth, 3))).where("distance > 0").groupBy("node").agg(F.min("distance").alias("distance"))
    found = near.join(first, "node", "left_anti").withColumn("graph_score", 1.0 / (1 + F.col("distance")))
    if seqs is None:
        return found.orderBy(F.desc("graph_score"), F.desc("node")).limit(limit)
    dated = found.join(seqs.select("node", "event_seq"), "node", "left")
    return dated.orderBy(F.desc("graph_score"), F.desc_nulls_last("event_seq"), F.desc("node")).limit(limit).drop("event_seq")


def _class_neighbors(edges: DataFrame, nodes: DataFrame, mentions: DataFrame | None, types: tuple, settings: Settings) -> DataFrame:
    """(node, other, edge_type, weight): the best few neighbors of each node, by symmetric and directed types and by shared entities."""
    symmetric = [t for t in types if t not in DIRECTED_TYPES and t != "MENTIONS"]
    directed = [t for t in types if t in DIRECTED_TYPES]
    rows = edges.where((F.col("weight") >= settings.min_edge_weight) & F.col("edge_type").isin(*symmetric, *directed))
    both = E.both_ways(rows).where(F.col("edge_type").isin(*symmetric) | (F.col("direction") == "out") if directed else F.col("edge_type").isin(*symmetric))
    both = both.join(nodes.select("node").distinct(), "node", "left_semi").withColumn("class", F.col("edge_type").isin(*directed) if directed else F.lit(False))
    rank = F.row_number().over(W.partitionBy("node", "class").orderBy(F.desc("weight"), F.desc_nulls_first("created_at"), "other", "edge_type"))
    out = both.withColumn("nth", rank).where(F.col("nth") <= settings.per_class_neighbors).select("node", "other", "edge_type", "weight")
    if "MENTIONS" in types and mentions is not None:
        start = nodes.select(F.col("node").alias("memory_id")).distinct()
        via = shared_entity_neighbors(mentions, settings.hub_degree, start, settings.per_class_neighbors)
        out = out.unionByName(via.select(F.col("memory_id").alias("node"), F.col("other_id").alias("other"), F.lit("MENTIONS").alias("edge_type"), "weight"))
    return out.where(F.col("weight").between(0, 1) & ~F.isnan("weight") & (F.coalesce(F.col("other").cast("string"), F.lit("")) != ""))


def expand(edges: DataFrame, seeds: DataFrame, mentions: DataFrame | None = None, intent: str = "general", cap: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(node, expansion_score, edge_type, hop) near seeds(node, score): parent score * weight * decay a hop, at most two hops.

    Seeds are left out, a node of the first hop is none of the second; each keeps its best score.
    """
    types = INTENT_TYPES.get(intent, INTENT_TYPES["general"])
    frontier = seeds.groupBy("node").agg(F.max("score").alias("score"))
    visited, found = frontier.select("node"), None
    for hop in (1, 2):
        step = frontier.join(_class_neighbors(edges, frontier, mentions, types, settings), "node")
        step = step.select(F.col("other").alias("node"), (F.col("score") * F.col("weight") * settings.hop_decay).alias("score"), "edge_type").join(visited, "node", "left_anti")
        best = step.groupBy("node").agg(F.max("score").alias("score"), F.min_by("edge_type", F.struct(-F.col("score"), F.col("edge_type"))).alias("edge_type")).withColumn("hop", F.lit(hop))
        best = settle(best)
        found = best if found is None else found.unionByName(best)
        visited, frontier = visited.unionByName(best.select("node")), best.select("node", "score")
    return found.orderBy(F.desc("score"), "node").limit(cap or settings.max_expansion).withColumnRenamed("score", "expansion_score")


def related(edges: DataFrame, start, types: list[str] | None = None, depth: int = 2, limit: int = 20, frontier_cap: int = 20, per_node: int = 25) -> DataFrame:
    """(node, edge_type, weight, hop): breadth first from one node; the first discovery of a node counts.

    Discovery order is (hop, parent's place, symmetric types before directed, weight, id); the first
    frontier_cap of a hop go on.
    """
    spark = edges.sparkSession
    kinds = {f.name: f.dataType for f in edges.schema}
    rows = edges.where(F.col("edge_type").isin(*types)) if types else edges
    both = E.both_ways(rows).withColumn("class", F.col("edge_type").isin(*DIRECTED_TYPES).cast("int"))
    if types:
        both = both.where((F.col("class") == 0) | (F.col("direction") == "out"))
    else:
        both = both.withColumn("class", F.lit(0))
    limit_of = per_node if types else 2 * per_node
    rank = F.row_number().over(W.partitionBy("node", "class").orderBy(F.desc("weight"), F.desc_nulls_first("created_at"), "other", "edge_type"))
    near = both.withColumn("nth", rank).where(F.col("nth") <= limit_of).select("node", "other", "edge_type", "weight", "class", "nth")
    frontier = spark.range(1).select(F.lit(start).cast(kinds["source_id"]).alias("node"), F.lit(1).alias("place"))
    visited, found = frontier.select("node"), None
    for hop in range(1, max(1, min(depth, 3)) + 1):
        step = frontier.join(near, "node").select(F.col("other").alias("node"), "edge_type", "weight", "place", "class", "nth").join(visited, "node", "left_anti")
        first = step.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("place", "class", "nth", "edge_type"))).where("k = 1")
        # one hop's discoveries from at most frontier_cap nodes: a bounded number of rows to place
        placed = first.withColumn("place", F.row_number().over(W.orderBy("place", "class", "nth", "node"))).select("node", "edge_type", "weight", F.lit(hop).alias("hop"), "place")
        placed = settle(placed)
        found = placed if found is None else found.unionByName(placed)
        visited = visited.unionByName(placed.select("node"))
        frontier = placed.where(F.col("place") <= frontier_cap).select("node", "place")
    return found.orderBy(F.desc("weight"), "hop", "node").limit(limit).select("node", "edge_type", "weight", "hop")


def ego(edges: DataFrame, start, depth: int = 2, max_nodes: int = 200, max_edges: int = 400) -> tuple[DataFrame, DataFrame]:
    """(nodes with distance, edges among them): the nearest nodes and the heaviest edges, within the caps."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source_id"]
    near = hops(edges, spark.range(1).select(F.lit(start).cast(kind).alias("node")), max(1, min(depth, 3)))
    nodes = near.select("node", "distance").orderBy("distance", "node").limit(max_nodes)
    own = edges.join(nodes.select(F.col("node").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("node").alias("target_id")), "target_id", "left_semi")
    own = own.dropDuplicates(["source_id", "target_id", "edge_type"]).orderBy(F.desc("weight"), "source_id", "target_id", "edge_type").limit(max_edges)
    return nodes, own


def ego_summary(edges: DataFrame, start, depth: int = 2, max_nodes: int = 200, max_edges: int = 400) -> DataFrame:
    """(n_nodes, n_edges, truncated) of ego(): truncated if a cap left nodes or edges out."""
    kind = dict(edges.dtypes)["source_id"]
    near = hops(edges, edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node")), max(1, min(depth, 3))).select("node")
    own = edges.join(near.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("node", "target_id"), "target_id", "left_semi")
    links = own.select("source_id", "target_id", "edge_type").distinct()
    # single-row totals
    both = near.agg(F.count("*").alias("n")).join(links.agg(F.count("*").alias("m")))
    return both.select(F.least("n", F.lit(max_nodes)).alias("n_nodes"), F.least("m", F.lit(max_edges)).alias("n_edges"), ((F.col("n") > max_nodes) | (F.col("m") > max_edges)).alias("truncated"))


def shortest_path(edges: DataFrame, start, goal, max_depth: int = 4) -> DataFrame:
    """(path, length): a shortest undirected path, the least one by ids; no row if there is none."""
    kind = dict(edges.dtypes)["source_id"]
    pair = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("start"), F.lit(goal).cast(kind).alias("goal"))
    return shortest_paths(edges, pair, max_depth).select("path", "length")


def _adjacent(edges: DataFrame, parts: int) -> DataFrame:
    """(node, others): the distinct neighbors of each node, in lists of at most LIST_NODES, dealt and sorted by node: no hop shuffles them again."""
    ways = E.both_ways(edges).select("node", "other").dropna().where("node != other").repartition(parts, "node").distinct()
    ways = ways.withColumn("nth", F.floor((F.row_number().over(W.partitionBy("node").orderBy("other")) - 1) / LIST_NODES))
    return settle(ways.groupBy("node", "nth").agg(F.collect_list("other").alias("others")).select("node", "others").sortWithinPartitions("node"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 4) -> DataFrame:
    """(start, goal, path, length) of pairs(start, goal): a shortest undirected path of each, the least one by ids.

    Pairs without a path of at most max_depth (1 to 10) edges, and those with a null, are left out; a repeated pair
    counts once; a node reaches itself by no edges. Frontiers grow from both ends in turn, so neither goes
    further than half of the path, and a pair whose frontiers have met grows no more. A hop keeps
    pointers to the nodes before, not paths; paths are put together for the nodes on shortest ones only.
    """
    max_depth = max(1, min(max_depth, 10))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = _adjacent(edges, parts)
    # a pair goes by a number, so that rows are short
    asked = settle(pairs.select("start", "goal").dropna().distinct().withColumn("pair", F.monotonically_increasing_id()))
    ends = [asked.select("pair", F.col(c).alias("node")) for c in ("start", "goal")]  # the frontiers: from the start, from the goal
    seen, pointers = list(ends), ([], [])
    met = asked.where("start = goal").select("pair", F.col("start").alias("node"), F.lit(0).alias("hops"))
    searching = asked.where("start != goal").select("pair")

    def grown(frontier):
        # a count of parts that is given stays as it is, so what is settled by (pair, node) need not be shuffled again
        near = frontier.repartition(parts, "node").join(ways, "node").select("pair", F.col("node").alias("before"), F.explode("others").alias("node"))
        return near.select("pair", "node", "before").repartition(parts, "pair", "node")

    for length in range(1, max_depth + 1):
        side = (length + 1) % 2
        frontier = ends[side].join(searching, "pair", "left_semi")
        if length == max_depth:  # only what meets the other frontier matters; none of that was seen, or the pair had met before
            # the most rows of all: some pairs at a time, each slice's shuffle is gone before the next one
            slices = max(1, -(-ends[side].count() // FRONTIER_ROWS))
            some = [frontier.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == i) if slices > 1 else frontier for i in range(slices)]
            step = reduce(DataFrame.unionByName, [settle(grown(f).join(ends[1 - side], ["pair", "node"], "left_semi")) for f in some])
            pointers[side].append(step)
            met = met.unionByName(step.select("pair", "node").distinct().withColumn("hops", F.lit(len(pointers[0]))))
            break
        step = settle(grown(frontier).join(seen[side], ["pair", "node"], "left_anti"))
        pointers[side].append(step)
        ends[side] = step.select("pair", "node").distinct()
        seen[side] = seen[side].unionByName(ends[side])
        here = settle(ends[side].join(ends[1 - side], ["pair", "node"], "left_semi"))
        met = met.unionByName(here.withColumn("hops", F.lit(len(pointers[0]))))
        searching = settle(searching.join(here, "pair", "left_anti"))
        if searching.isEmpty():
            break

    # from where the frontiers met back to the start: the nodes that lead there, each with its least next one
    good, onward = None, []
    for hop in range(len(pointers[0]), 0, -1):
        here = met.where(F.col("hops") == hop).select("pair", "node")
        good = here if good is None else good.unionByName(here)
        step = settle(pointers[0][hop - 1].join(good, ["pair", "node"], "left_semi").groupBy("pair", F.col("before").alias("node")).agg(F.min("node").alias("next")))
        onward.insert(0, step)
        good = step.select("pair", "node")
    found = settle(asked.join(met.select("pair"), "pair", "left_semi"))
    # of pairs that were not found too: so no row is shuffled, and none of them is met below
    back = [p.groupBy("pair", "node").agg(F.min("before").alias("next")) for p in reversed(pointers[1])]
    out = found.withColumn("node", F.col("start")).withColumn("path", F.array("start"))
    for step in onward + back:
        out = out.join(step, ["pair", "node"], "left").select("pair", "start", "goal", F.coalesce("next", "node").alias("node"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"))
    return out.select("start", "goal", "path", (F.size("path") - 1).alias("length"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges(node, next) that lies on a cycle; component is the greatest node of its strongly connected component.

    Nodes without an edge in or out are trimmed until none is left. Then each node takes the greatest node that
    reaches it as its color; the nodes of a color that reach that node are its component. They are taken out,
    and what is left is begun anew. Each round is one join and one sum by node, settled.
    """
    kind = dict(edges.dtypes)["node"]
    done = None
    left = settle(edges.select("node", "next").where("node != next").distinct())
    while True:
        n = left.count()
        while n:  # trim
            kept = left.join(left.select(F.col("next").alias("node")).distinct(), "node", "left_semi").join(left.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node", "next")
            left, before = settle(kept), n
            n = left.count()
            if n == before:
                break
        if not n:
            break
        color = settle(left.select("node").distinct().withColumn("color", F.col("node")))
        moved = True
        while moved:
            sent = left.join(color, "node").select(F.col("next").alias("node"), F.col("color").alias("got")).groupBy("node").agg(F.max("got").alias("got"))
            color = settle(color.join(sent, "node", "left").select("node", F.greatest("color", "got").alias("color"), F.coalesce(F.col("got") > F.col("color"), F.lit(False)).alias("moved")))
            moved = not color.where("moved").isEmpty()
            color = color.drop("moved")
        # backwards from each color's own node, inside the color
        same = left.join(color, "node").join(color.select(F.col("node").alias("next"), F.col("color").alias("other")), "next").where("color = other").select("node", "next")
        same = settle(same)
        found = frontier = color.where("node = color").select("node", F.col("color").alias("component"))
        while not frontier.isEmpty():
            step = frontier.withColumnRenamed("node", "next").join(same, "next").select("node", "component").distinct()
            frontier = settle(step.join(found.select("node"), "node", "left_anti").select("node", "component"))
            found = found.unionByName(frontier)
        found = settle(found)
        done = found if done is None else done.unionByName(found)
        for end in ("node", "next"):
            left = left.join(found.select(F.col("node").alias(end)), end, "left_anti")
        left = settle(left.select("node", "next"))
    if done is None:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    # a color's node that no one else reaches again is no cycle
    return done.join(done.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component"), "component", "left_semi").select("node", "component")


def provenance(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(chain, summary) of starts(start).

    chain: (start, node, edge_type, depth), each ancestor at its least depth. summary: (start,
    original_sources, depth, depth_limited); sources are ancestors that no walk leaves inside the
    traversal, depth is the longest walk; no walk comes to one of its own nodes again.

    A walk that leaves a strongly connected component never returns to it, so a walk has to remember the nodes of
    its present component only, and outside of cycles nothing: rows are (start, node, nodes
    seen of the component) by depth. They grow with nodes times depth, and within a component with the sets of
    its nodes that walks of one length can see, never with the number of walks.
    """
    depth = max(1, min(max_depth, 10))
    rows = edges.where(F.col("edge_type").isin(*PROVENANCE_TYPES)).select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), "edge_type").where("node != next")
    rows = settle(rows.distinct())  # each hop reads them
    near = frontier = settle(starts.select(F.col("start").alias("node")).distinct())
    for _ in range(depth):  # the part of the graph that the starts reach
        step = frontier.join(rows, "node").select(F.col("next").alias("node")).distinct()
        frontier = settle(step.join(near, "node", "left_anti"))
        if frontier.isEmpty():
            break
        near = near.unionByName(frontier)
    rows = settle(rows.join(near, "node", "left_semi").select("node", "next", "edge_type"))
    comps = settle(strong_components(rows))
    ways = rows.join(comps.withColumnRenamed("component", "here"), "node", "left").join(comps.select(F.col("node").alias("next"), F.col("component").alias("there")), "next", "left")
    ways = settle(ways.select("node", "next", F.col("edge_type").alias("t"), F.col("here").eqNullSafe(F.col("there")).alias("inside"), F.col("there").isNotNull().alias("cyclic")))
    none = F.array().cast(f"array<{dict(rows.dtypes)['node']}>")
    own = starts.select("start").distinct().join(comps.select(F.col("node").alias("start"), F.lit(True).alias("cyclic")), "start", "left")
    walk = settle(own.select("start", F.col("start").alias("node"), F.when(F.col("cyclic"), F.array("start")).otherwise(none).alias("seen"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_type")))
    every, left = None, None
    for d in range(1, depth + 1):
        step = walk.select("start", "node", "seen").join(ways, "node").where(~F.array_contains("seen", F.col("next")))
        seen = F.when(~F.col("cyclic"), none).when(F.col("inside"), F.array_sort(F.concat("seen", F.array("next")))).otherwise(F.array("next"))
        step = settle(step.select("start", "node", "next", "t", seen.alias("seen")).groupBy("start", "node", "next", "seen").agg(F.min("t").alias("t")))
        if step.isEmpty():
            break
        gone = step.select("start", "node").distinct()
        left = gone if left is None else left.unionByName(gone)
        walk = step.groupBy("start", F.col("next").alias("node"), "seen").agg(F.lit(d).alias("depth"), F.min("t").alias("edge_type"))
        reached = walk.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("edge_type").alias("edge_type"))
        every = reached if every is None else every.unionByName(reached)
    if every is None:
        every, left = walk.select("start", "node", "depth", "edge_type").limit(0), walk.select("start", "node").limit(0)
    chain = every.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min_by("edge_type", F.struct("depth", "edge_type")).alias("edge_type"))
    sources = chain.join(left.distinct(), ["start", "node"], "left_anti").groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("original_sources"))
    tops = every.groupBy("start").agg(F.max("depth").alias("depth"))
    summary = starts.select("start").join(tops, "start", "left").join(sources, "start", "left")
    summary = summary.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("depth_limited", F.col("depth") >= depth)
    return chain, summary


def capped(chain: DataFrame, summary: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """provenance() with the first `most` ancestors of each start, by depth and then node; the summary says by `truncated` whether there are more.

    Where a chain is cut, its sources are those that are left in it. A node is once in a chain, so its order is total.
    """
    first = chain.withColumn("__n", F.row_number().over(W.partitionBy("start").orderBy("depth", "node"))).where(F.col("__n") <= most + 1)
    sizes = first.groupBy("start").agg((F.count("*") > most).alias("truncated"), F.array_sort(F.collect_list(F.when(F.col("__n") <= most, F.col("node")))).alias("__left"))
    out = summary.join(sizes, "start", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    sources = F.when(F.col("truncated"), F.array_intersect("original_sources", "__left")).otherwise(F.col("original_sources"))
    return first.where(F.col("__n") <= most).drop("__n"), out.withColumn("original_sources", sources).drop("__left")


def session_chain(follows: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(start, session_id, distance): each start and the sessions before it."""
    frontier = starts.select("start", F.col("start").alias("session_id"), F.lit(0).alias("distance"))
    every = frontier
    for d in range(1, max(1, min(depth, 20)) + 1):
        frontier = frontier.join(follows, "session_id").select("start", F.col("prev_session_id").alias("session_id"), F.lit(d).alias("distance"))
        every = every.unionByName(frontier)
    return every.groupBy("start", "session_id").agg(F.min("distance").alias("distance"))


def existing(nodes: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """(id, found) of each asked id."""
    known = nodes.select(F.col(key).alias("id")).distinct().withColumn("found", F.lit(True))
    return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def decisions(memories: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Decisions whose text has the query's first 50 characters, each with up to three neighbors."""
    part = query.strip()[:50].lower()
    rows = memories.where(F.col("memory_type").isin("decision", "plan", "strategy") & F.contains(F.lower("text"), F.lit(part)))
    near = E.both_ways(edges).select(F.col("node").alias("memory_id"), F.struct("other", "edge_type").alias("n"))
    best = rows.orderBy(F.desc_nulls_last("event_seq"), "memory_id").limit(limit)
    return best.join(near, "memory_id", "left").groupBy(*[c for c in best.columns]).agg(F.slice(F.array_sort(F.collect_set("n")), 1, 3).alias("related"))
