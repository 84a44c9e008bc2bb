"""Graph algorithms: components, acyclicity, modularity, Louvain, edge betweenness splits."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Edges of one weakly connected component that a single task may take; larger ones take the distributed way.
LARGEST = 2_000_000


def _min_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) by alternating star contractions on string or integer ids; links are (u, v) with v smaller."""
    link = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    link, before = materialize(link, "links"), None
    for _ in range(rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        link = materialize(small.where("u <> v").distinct(), "links")
        now = link.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select("id").join(link.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id of the node's weakly connected component."""
    return _min_labels(nodes, edges)


def trim(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """The edges left when nodes without a predecessor or without a successor are taken away again and again: those on or between cycles.

    Each round drops every source and sink at once; self loops are dropped first. Of longer chains some nodes are left after the rounds: components of one.
    """
    left = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "trim")
    n = left.count()
    for _ in range(rounds):
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = materialize(kept.select("src", "dst"), "trim")
        m = kept.count()
        if m in (0, n):
            return kept
        left, n = kept, m
    return left


def _tarjan(ids: list, succ: dict) -> dict:
    """Strongly connected components, without recursion: node -> smallest member."""
    index, low, on, stack, label, counter = {}, {}, set(), [], {}, 0
    for root in ids:
        if root in index:
            continue
        work = [(root, iter(succ.get(root, ())))]
        index[root] = low[root] = counter
        counter += 1
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = counter
                    counter += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(succ.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    first = min(members)
                    label.update(dict.fromkeys(members, first))
    return label


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id of the node's strongly connected component.

    What is on no cycle is trimmed first by joins; each weakly connected rest is solved in one task if it has up to LARGEST edges. Of larger rests nodes of low degree are eliminated in rounds (:func:`eliminate`) until they are small enough;
    a core that stays larger is dense, so its paths are short, and is solved by colouring: the largest reachable-from label forward, then the part that reaches it back, again and again.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    core = trim(edges)
    ends = core.select(F.col("src").alias("id")).unionByName(core.select(F.col("dst").alias("id"))).distinct()
    weak = materialize(weak_components(ends, core), "weak")
    tagged = core.join(weak.withColumnRenamed("id", "src"), "src")
    sizes = tagged.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > LARGEST).select("component")
    found = _tarjan_by(tagged.join(large, "component", "left_anti"), "component", kind)
    if large.count():
        found = found.unionByName(_by_elimination(tagged.join(large, "component", "left_semi").select("src", "dst"), kind, LARGEST))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("component"))


def _tarjan_by(tagged: DataFrame, group: str, kind: str) -> DataFrame:
    """(id, scc) of the edges of each group, a group in one task."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        succ = defaultdict(list)
        for a, b in zip(pdf.src, pdf.dst):
            succ[a].append(b)
        label = _tarjan(sorted(set(pdf.src) | set(pdf.dst)), succ)
        return pd.DataFrame({"id": list(label), "scc": list(label.values())})

    return tagged.select(group, "src", "dst").groupBy(group).applyInPandas(solve, f"id {kind}, scc {kind}")


def eliminate(edges: DataFrame, small: int, rounds: int = 200) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Takes nodes out of a graph while every path between the others is kept: (edges left, [(edges into, edges out of the nodes taken) for each round]).

    A node goes if joining each of its predecessors to each of its successors makes no more edges than it had: without one of either, with one of either, or with two of both. In a round those go that come before
    all their candidate neighbours in a random order, so no two of them are neighbours and a cycle of n nodes shrinks by a third: rounds grow with the logarithm of a path's length. Ends at ``small`` edges, or when a round
    takes less than a fiftieth of them.
    """
    left, taken = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "left"), []
    n = left.count()
    for turn in range(rounds):
        if n <= small:
            break
        degree = left.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(left.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        able = materialize(degree.where("o * i <= o + i").select("id", F.xxhash64("id", F.lit(turn)).alias("h")), "able")
        side = lambda x: able.select(F.col("id").alias(x), F.struct("h", "id").alias(f"{x}_h"))  # noqa: B023, E731
        beaten = left.join(side("src"), "src").join(side("dst"), "dst").select(F.when(F.col("src_h") < F.col("dst_h"), F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
        gone = materialize(able.select("id").join(beaten, "id", "left_anti"), "gone")
        into = materialize(left.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("p")), "into")
        out = materialize(left.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("s")), "out")
        kept = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        joined = into.join(out, "id").where("p <> s").select(F.col("p").alias("src"), F.col("s").alias("dst"))
        left = materialize(kept.unionByName(joined).distinct(), "left")
        taken.append((into, out))
        before, n = n, left.count()
        if before - n < before // 50:
            break
    return left, taken


def _by_elimination(edges: DataFrame, kind: str, small: int) -> DataFrame:
    """(id, scc): nodes eliminated, the core solved, and the nodes put back round by round: a node lies in the component that holds one of its predecessors and one of its successors, if any does."""
    core, taken = eliminate(edges, small)
    if core.isEmpty():
        label = core.select(F.col("src").alias("id"), F.col("dst").alias("scc"))
    else:
        label = materialize(_tarjan_by(core.withColumn("all", F.lit(1)), "all", kind) if core.count() <= small else _colouring(core, kind), "label")
    whole = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    # Ends of core edges may have no edge left at all: components of one, unless nodes put back join them.
    seen = [into.select("id").unionByName(out.select("id")) for into, out in taken]
    gone = None
    for s in seen:
        gone = s if gone is None else gone.unionByName(s)
    rest = whole.join(label.select("id"), "id", "left_anti")
    rest = rest if gone is None else rest.join(gone.distinct(), "id", "left_anti")
    label = materialize(label.unionByName(rest.select("id", F.col("id").alias("scc"))), "label")
    for into, out in reversed(taken):
        own = lambda x, name: label.select(F.col("id").alias(x), F.col("scc").alias(name))  # noqa: B023, E731
        above, below = into.join(own("p", "scc"), "p").select("id", "scc").distinct(), out.join(own("s", "scc"), "s").select("id", "scc").distinct()
        back = into.select("id").unionByName(out.select("id")).distinct().join(above.join(below, ["id", "scc"]), "id", "left")
        label = materialize(label.unionByName(back.select("id", F.coalesce("scc", "id").alias("scc"))), "label")
    least = label.groupBy("scc").agg(F.min("id").alias("least"))
    return label.join(least, "scc").select("id", F.col("least").alias("scc"))


def _colouring(edges: DataFrame, kind: str, rounds: int = 10_000) -> DataFrame:
    """Strongly connected components of a large rest, by forward colours and backward reach. Every round finishes a component at least; if any is left after ``rounds``, it raises."""
    done, left = None, materialize(edges, "rest")
    for _ in range(rounds):
        if left.isEmpty():
            break
        colour = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id"))
        colour, moved = materialize(colour, "colour"), True
        while moved:
            pushed = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("p"))
            new = materialize(colour.join(pushed, "id", "left").select("id", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("m")), "colour")
            moved = not new.where("m").isEmpty()
            colour = new.select("id", "c")
        same = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        same = materialize(same, "same")
        reach = materialize(colour.where("id = c"), "reach")
        while True:
            more = same.join(reach.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("cs").alias("c")).distinct().join(reach.select("id"), "id", "left_anti")
            more = materialize(more, "more")
            if more.isEmpty():
                break
            reach = materialize(reach.unionByName(more), "reach")
        part = reach.select("id", F.col("c").alias("scc"))
        # A component's name is its smallest member.
        part = part.join(part.groupBy("scc").agg(F.min("id").alias("least")), "scc").select("id", F.col("least").alias("scc"))
        part = materialize(part, "scc")
        done = part if done is None else done.unionByName(part)
        gone = reach.select("id")
        left = materialize(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "rest")
    if not left.isEmpty():
        raise RuntimeError(f"strong components did not settle in {rounds} rounds")
    return done


def is_dag(edges: DataFrame) -> bool:
    """Whether no directed cycle exists; a self loop is one. Long chains are peeled by one layer a round, so what is left after the rounds is solved whole."""
    if not edges.where("src = dst").isEmpty():
        return False
    left = trim(edges)
    if left.isEmpty():
        return True
    ends = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
    return strong_components(ends, left).groupBy("component").count().where("count > 1").isEmpty()


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, is_dag, strong and weak components, and counts by type."""
    spark = nodes.sparkSession
    strong, weak = (f(nodes, edges).select("component").distinct().count() for f in (strong_components, weak_components))
    kinds = {r[0]: r[1] for r in nodes.groupBy(F.coalesce("type", F.lit("Unknown"))).count().collect()}
    row = (nodes.count(), edges.count(), is_dag(edges), strong, weak, kinds)
    return spark.createDataFrame([row], "node_count long, edge_count long, is_dag boolean, strongly_connected_components long, weakly_connected_components long, node_types map<string,long>")


def modularity(wedges: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of an assignment (id, cluster_id) of an undirected weighted graph (a, b, weight)."""
    c = lambda side: assignment.select(F.col("id").alias(side), F.col("cluster_id").alias(f"{side}_c"))
    both = wedges.join(c("a"), "a").join(c("b"), "b")
    ends = both.select(F.col("a_c").alias("c"), F.col("weight").alias("d"), F.when(F.col("a_c") == F.col("b_c"), F.col("weight")).otherwise(0.0).alias("l"))
    ends = ends.unionByName(both.select(F.col("b_c").alias("c"), F.col("weight").alias("d"), F.lit(0.0).alias("l")))
    per = ends.groupBy("c").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    per = per.crossJoin(F.broadcast(per.agg((F.sum("d") / 2).alias("m"))))  # one row
    return per.agg(F.coalesce(F.sum(F.col("l") / F.col("m") - resolution * (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))), F.lit(0.0)).alias("modularity"))


def louvain_partition(ids: list, links: list[tuple], two_m: float, resolution: float = 1.0) -> dict:
    """node -> community number, by local moves and aggregation; nodes are visited in order, so a rerun agrees."""
    place = {v: i for i, v in enumerate(ids)}
    graph = [defaultdict(float) for _ in ids]
    for a, b, w in links:
        graph[place[a]][place[b]] += w
        graph[place[b]][place[a]] += w  # a self loop counts twice in its degree
    owner = list(range(len(ids)))
    while True:
        n = len(graph)
        degree = [sum(g.values()) for g in graph]
        community, total = list(range(n)), list(degree)
        moved_ever, moved = False, True
        while moved:
            moved = False
            for i in range(n):
                own = community[i]
                near: dict[int, float] = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        near[community[j]] += w
                total[own] -= degree[i]
                gain = lambda c: near[c] - resolution * total[c] * degree[i] / two_m  # noqa: B023, E731
                best, most = own, gain(own)
                for c in sorted(near):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                total[best] += degree[i]
                if best != own:
                    community[i], moved, moved_ever = best, True, True
        if not moved_ever:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(community))}
        merged = [defaultdict(float) for _ in names]
        for i in range(n):
            for j, w in graph[i].items():
                merged[names[community[i]]][names[community[j]]] += w
        owner = [names[community[o]] for o in owner]
        graph = merged
    return {v: owner[i] for i, v in enumerate(ids)}


def louvain(nodes: DataFrame, wedges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, cluster_id) by Louvain; isolated nodes are clusters of their own. Cluster ids follow their smallest members.

    Communities never cross weak components and each component uses the whole graph's weight, so components are solved apart. A component of
    more than LARGEST edges is not given to one task: its local moves are joins, until what they merge it to is small enough (:func:`merge_by_moves`).
    """
    kind = nodes.schema["id"].dataType.simpleString()
    edges = wedges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    weak = materialize(weak_components(nodes, edges), "weak")
    two_m = 2 * float(wedges.agg(F.sum("weight")).first()[0] or 0.0) or 1.0
    tagged = wedges.join(weak.withColumnRenamed("id", "a"), "a")
    large = tagged.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST).select("component")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf.a) | set(pdf.b))
        found = louvain_partition(ids, sorted(zip(pdf.a, pdf.b, pdf.weight)), two_m, resolution)
        first: dict[int, object] = {}
        for v in ids:
            first.setdefault(found[v], v)
        return pd.DataFrame({"id": ids, "leader": [first[found[v]] for v in ids]})

    leaders = tagged.join(large, "component", "left_anti").groupBy("component").applyInPandas(solve, f"id {kind}, leader {kind}")
    if large.count():
        leaders = leaders.unionByName(merge_by_moves(tagged.join(large, "component", "left_semi").select("a", "b", "weight"), two_m, resolution))
    return number_clusters(nodes, leaders)


def merge_by_moves(wedges: DataFrame, two_m: float, resolution: float = 1.0, small: int | None = None) -> DataFrame:
    """(id, leader) by Louvain whose local moves are joins: for large components.

    In a round those nodes whose turn it is, half of them by a hash of id and round, move to the neighbouring community of the largest gain; a round that does not raise the
    modularity is dropped, and two such rounds end the level. Communities then become nodes. When the merged graph has ``small`` edges or fewer, the moves are made
    in one task; if a level merges nothing, that is the result.
    """
    small = LARGEST if small is None else small
    kind = wedges.schema["a"].dataType.simpleString()
    graph = materialize(wedges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")), "level")
    ends = graph.select(F.col("a").alias("id")).unionByName(graph.select(F.col("b").alias("id"))).distinct()
    owner = materialize(ends.select("id", F.col("id").alias("leader")), "owner")

    def quality(label: DataFrame) -> float:
        side = lambda x: label.select(F.col("id").alias(x), F.col("c").alias(f"{x}_c"))
        inner = graph.join(side("a"), "a").join(side("b"), "b").where("a_c = b_c").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        spread = label.groupBy("c").agg((F.sum("degree") / two_m).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
        return 2 * inner / two_m - resolution * spread

    while graph.count() > small:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))  # a self loop counts twice in its degree
        label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree")).select("id", F.col("id").alias("c"), "degree"), "labels")
        first = best = quality(label)
        failed = turn = 0
        while failed < 2:
            turn += 1
            total = label.groupBy("c").agg(F.sum("degree").alias("total"))
            near = both.where("a != b").join(label.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("weight").alias("w"))
            own = label.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w"))  # a node may always stay
            options = near.unionByName(own).groupBy("id", "to").agg(F.sum("w").alias("w")).join(label, "id").join(total.withColumnRenamed("c", "to"), "to")
            gain = F.col("w") - resolution * (F.col("total") - F.when(F.col("to") == F.col("c"), F.col("degree")).otherwise(0.0)) * F.col("degree") / two_m
            top = options.groupBy("id").agg(F.max(F.struct(F.round(gain, 12).alias("gain"), (F.col("to") == F.col("c")).alias("stays"), "to")).alias("top"))
            moves = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
            new = materialize(label.join(top, "id").select("id", F.when(moves, F.col("top.to")).otherwise(F.col("c")).alias("c"), "degree"), "labels")
            now = quality(new)
            if now > best + 1e-9:
                label, best, failed = new, now, 0
            else:
                failed += 1
        if best <= first + 1e-9:
            return owner
        # A community is named by its smallest member.
        least = label.groupBy("c").agg(F.min("id").alias("name"))
        named = materialize(label.join(least, "c").select(F.col("id").alias("leader"), "name"), "named")
        owner = materialize(owner.join(named, "leader").select("id", F.col("name").alias("leader")), "owner")
        side = lambda x: named.select(F.col("leader").alias(x), F.col("name").alias(f"{x}_n"))
        merged = graph.join(side("a"), "a").join(side("b"), "b")
        graph = materialize(merged.groupBy(F.least("a_n", "b_n").alias("a"), F.greatest("a_n", "b_n").alias("b")).agg(F.sum("weight").alias("weight")), "level")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf.a) | set(pdf.b))
        found = louvain_partition(ids, sorted(zip(pdf.a, pdf.b, pdf.weight)), two_m, resolution)
        leaders: dict[int, object] = {}
        for v in ids:
            leaders.setdefault(found[v], v)
        return pd.DataFrame({"leader": ids, "name": [leaders[found[v]] for v in ids]})

    last = graph.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, f"leader {kind}, name {kind}")
    return owner.join(last, "leader").select("id", F.col("name").alias("leader"))


def number_clusters(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """(id, cluster_id): clusters numbered by their leaders, nodes without one as clusters of their own."""
    from .merge import sequential_ids

    whole = materialize(nodes.select("id").join(leaders, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")), "leaders")
    numbered = sequential_ids(whole.select("leader").distinct(), ["leader"], "cluster_id")
    return whole.join(numbered, "leader").select("id", F.col("cluster_id").cast("long"))


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None, rows: int = 20_000_000) -> DataFrame:
    """(a, b, score) of undirected edges (a, b; each once, a < b): over all pairs of nodes, the share of their shortest paths that go over the edge.

    Searches from many sources go on level by level as joins: forward they count the shortest paths to each node, backward each node hands its share to its predecessors. State is a row for each source and node it reaches; sources are taken in
    batches of about ``rows`` rows, by a hash, so memory and disk don't depend on the number of nodes. sources (id): only searches from these; by default from every node.
    """
    both = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))), "arcs")
    from_ = materialize((both.select(F.col("v").alias("id")).distinct() if sources is None else sources.select("id")), "sources")
    n = both.select("v").distinct().count()
    batches = max(1, -(-from_.count() * n // rows))
    scores = None
    for k in range(batches):
        own = from_.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k) if batches > 1 else from_
        part = _searches(own, both)
        part = materialize(part.groupBy("a", "b").agg(F.sum("score").alias("score")) if scores is None else part.unionByName(scores).groupBy("a", "b").agg(F.sum("score").alias("score")), "scores")
        scores = part
    return scores.select("a", "b", (F.col("score") / 2).alias("score"))  # each pair is met from both ends


def _searches(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(a, b, score) of edges over the shortest paths from some sources."""
    level = materialize(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels = [level]
    before = None
    while True:
        # What a level reaches lies in this level, the one before, or is new.
        reached = level.join(arcs, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        reached = reached.join(level.select("s", "v"), ["s", "v"], "left_anti")
        if before is not None:
            reached = reached.join(before.select("s", "v"), ["s", "v"], "left_anti")
        before, level = level, materialize(reached, "level")
        if level.isEmpty():
            break
        levels.append(level)
    out = given = None
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:])):
        # Each node hands 1 and what it was handed to its predecessors, by their numbers of paths.
        share = lower.withColumn("given", F.lit(0.0)) if given is None else lower.join(given, ["s", "v"], "left").withColumn("given", F.coalesce("given", F.lit(0.0)))
        handed = upper.join(arcs, "v").join(share.select("s", F.col("v").alias("w"), F.col("paths").alias("p"), "given"), ["s", "w"])
        handed = materialize(handed.select("s", "v", "w", (F.col("paths") / F.col("p") * (1 + F.col("given"))).alias("score")), "handed")
        given = handed.groupBy("s", "v").agg(F.sum("score").alias("given"))
        edges = handed.groupBy(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).agg(F.sum("score").alias("score"))
        out = edges if out is None else out.unionByName(edges)
    if out is None:
        return arcs.select(F.col("v").alias("a"), F.col("w").alias("b"), F.lit(0.0).alias("score")).limit(0)
    return out


def girvan_newman(nodes: DataFrame, wedges: DataFrame, most_edges: int | None = None, rows: int = 20_000_000, rounds: int = 10_000) -> DataFrame:
    """(id, cluster_id) of the first split by edge betweenness: the edge of the highest is cut, again and again, until there is a component more.

    Of equally central edges (to nine digits) the smallest (a, b) is cut. Each cut changes the betweenness of its own component only, so only that is searched again. ``rounds`` bounds the cuts; a graph that isn't split by then raises.
    Work is that of a search from every node for each cut, so the number of cuts that a split takes, not the size of a task, limits what is feasible; a caller who wants no such work sets most_edges, and larger graphs are refused.
    """
    if most_edges is not None and wedges.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges: use louvain")
    links = wedges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    parts = lambda e: materialize(weak_components(nodes, e.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "parts")
    label = parts(links)
    if links.isEmpty():
        return number_clusters(nodes, label.withColumnRenamed("component", "leader"))
    scores = edge_betweenness(links, rows=rows)
    scores = materialize(scores.join(label.withColumnRenamed("id", "a"), "a"), "scores")
    for _ in range(rounds):
        # The smallest edge among those that agree with the highest score to nine digits.
        top = scores.agg(F.max("score")).first()[0]
        cut = scores.where(F.col("score") >= top - 1e-9 * max(1.0, top)).agg(F.min(F.struct("a", "b", "component")).alias("x")).first()["x"]
        links = materialize(links.where(~((F.col("a") == cut["a"]) & (F.col("b") == cut["b"]))), "links")
        own = links.join(label.where(F.col("component") == cut["component"]).select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
        inner = label.where(F.col("component") == cut["component"]).select("id")
        split = materialize(weak_components(inner, own.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "split")
        if split.select("component").distinct().count() > 1:
            rest = label.where(F.col("component") != cut["component"])
            return number_clusters(nodes, rest.unionByName(split).withColumnRenamed("component", "leader"))
        again = edge_betweenness(own, rows=rows).withColumn("component", F.lit(cut["component"]))
        scores = materialize(scores.where(F.col("component") != cut["component"]).select("a", "b", "score", "component").unionByName(again), "scores")
    raise RuntimeError(f"no component was split by {rounds} cuts")


def detect_communities(nodes: DataFrame, wedges: DataFrame, algorithm: str = "louvain", resolution: float | None = None, constraints: list[list[str]] | None = None) -> DataFrame:
    """(id, cluster_id): constraint groups merged, communities found, groups expanded again. nodes (id), wedges (a, b, weight)."""
    from .weights import constraint_members, contract, expand

    if algorithm not in ("louvain", "girvan_newman"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    members = constraint_members(nodes, constraints or [])
    links = contract(wedges, members)
    inner = nodes.select("id").join(members.select("id"), "id", "left_anti").unionByName(members.select(F.col("super").alias("id")).distinct())
    found = louvain(inner, links, resolution or 1.0) if algorithm == "louvain" else girvan_newman(inner, links)
    return expand(found, members)
