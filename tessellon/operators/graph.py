"""Link graphs of pages, their communities, and typed graphs of entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.plans.lineage import cut

# Fixed value: types of pages that the graph does not show.
HIDDEN = ["query"]


def nodes_of(pages: DataFrame) -> DataFrame:
    """(id, label, kind, path) of pages (id, path, text): title and type of the front matter, or id and 'unknown'; hidden types are left out."""
    rows = pages.select("id", F.coalesce(X.front_value("text", "title"), F.col("id")).alias("label"), F.coalesce(X.front_value("text", "type"), F.lit("unknown")).alias("kind"), "path")
    return rows.where(~F.col("kind").isin(HIDDEN))


def links_of(pages: DataFrame) -> DataFrame:
    """(source, position, raw): the wiki links of every page in order."""
    return pages.select(F.col("id").alias("source"), F.posexplode(X.wiki_links("text")).alias("position", "raw")).where("raw <> ''")


def resolved(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (source, position, raw) with target: the node of that id, else of the id without case, else with spaces as hyphens or the reverse; links to nothing drop out."""
    ids = nodes.select("id").distinct()
    low = ids.groupBy(F.lower("id").alias("key")).agg(F.min("id").alias("target")).withColumn("rank", F.lit(1))
    exact = ids.select(F.col("id").alias("key"), F.col("id").alias("target"), F.lit(0).alias("rank"))
    keyed = links.select("source", "position", "raw", F.explode(F.array(F.struct(F.col("raw").alias("key"), F.lit(0).alias("rank"), F.lit(0).alias("order")), F.struct(F.lower("raw").alias("key"), F.lit(1).alias("rank"), F.lit(1).alias("order")), F.struct(F.replace(F.lower("raw"), F.lit(" "), F.lit("-")).alias("key"), F.lit(1).alias("rank"), F.lit(2).alias("order")), F.struct(F.replace(F.lower("raw"), F.lit("-"), F.lit(" ")).alias("key"), F.lit(1).alias("rank"), F.lit(3).alias("order")))).alias("k"))
    hits = keyed.select("source", "position", "raw", "k.*").join(exact.unionByName(low), ["key", "rank"])
    return hits.groupBy("source", "position", "raw").agg(F.min_by("target", F.struct("order", "target")).alias("target"))


def degrees(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, link_count): links (source, target) in and out of each node, repeated ones counted, own ones not."""
    ends = links.where("source <> target").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("link_count"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("link_count", F.lit(0)).alias("link_count"))


def undirected(links: DataFrame) -> DataFrame:
    """(source, target, weight): links once for each pair of nodes, in the direction that came first (by source and position)."""
    rows = links.where("source <> target").withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    first = rows.groupBy("_a", "_b").agg(F.min(F.struct("source", "position", "target")).alias("f"))
    return first.select("f.source", "f.target", F.lit(1.0).alias("weight"))


def _linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 reachable from each over edges (u, v)."""
    root = np.arange(n)
    while len(u):
        # a root only ever goes below a smaller one, so there is no circle
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def components(edges: DataFrame, in_a_task: int = 500_000, max_levels: int = 100) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b).

    On each level a node picks the first of its neighbours and itself in an
    order drawn anew by hash, and goes two picks further; nodes that arrive
    at one become one. Whatever the shape, chains and stars among them, at
    most half of the nodes are expected to be left, so the levels are few.
    Up to in_a_task arcs are finished in one task, with the same result.
    """
    ends = edges.where("a <> b")
    arcs = cut(ends.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ends.select("b", "a")).distinct())
    kind = dict(arcs.dtypes)["u"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (parts := list(batches)):
            return
        p = pd.concat(parts)
        ids = np.sort(p["u"].unique()).tolist()
        number = {x: i for i, x in enumerate(ids)}
        got = _linked(*(p[c].map(number).to_numpy(np.int64) for c in ("u", "v")), len(ids))
        if ids:
            yield pd.DataFrame({"u": ids, "c": [ids[i] for i in got]})

    levels: list[DataFrame] = []
    for level in range(max_levels):
        if arcs.count() <= in_a_task:
            levels.append(cut(arcs.coalesce(1).mapInPandas(run, f"u {kind}, c {kind}")))
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        pick = cut(arcs.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least("m", order("u"))["x"].alias("c")))
        found = pick
        for _ in range(2):
            found = found.join(pick.select(F.col("u").alias("c"), F.col("c").alias("_up")), "c").select("u", F.col("_up").alias("c"))
        levels.append(found := cut(found))
        left = arcs.where("u < v").join(found, "u").select("v", F.col("c").alias("a")).join(found.withColumnRenamed("u", "v"), "v").select("a", F.col("c").alias("b")).where("a <> b")
        arcs = cut(left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a")).distinct())
    else:
        raise RuntimeError("components did not settle")
    above = levels[-1].select(F.col("u").alias("c"), F.col("c").alias("root"))
    for found in reversed(levels[:-1]):
        above = found.join(above, "c", "left").select(F.col("u").alias("c"), F.coalesce("root", "c").alias("root"))
    above = above.select(F.col("c").alias("id"), "root")
    if len(levels) == 1:
        return above
    above = cut(above)
    return above.join(above.groupBy("root").agg(F.min("id").alias("_least")), "root").select("id", F.col("_least").alias("root"))


def propagate(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): communities by weighted label propagation over edges (source, target, weight), distributed; ties go to the smaller label, so the result is the same every time."""
    arcs = cut(edges.select("source", "target", "weight").union(edges.select("target", "source", "weight")))
    label = cut(arcs.select(F.col("source").alias("id")).distinct().withColumn("community", F.col("id")))
    for i in range(rounds):
        votes = arcs.join(label.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.max_by("community", F.struct("w", F.col("community"))).alias("new"))
        # half of the nodes move in a round, or neighbours would swap labels for ever
        moving = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
        new = cut(label.join(best, "id", "left").select("id", F.when(moving, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community")))
        label = new
    return label


#: Steps into which gains are divided, so that sums in another order give the same move.
FINE = 1e9


def _moves(ids: list, u: np.ndarray, v: np.ndarray, w: np.ndarray, turns: list[str], total: float, levels: int, rounds: int) -> np.ndarray:
    """The community of each of ids, in order, by the moves of louvain over arcs (u, v, w) of numbers of ids; turns says for each id in which rounds of each level it moves."""
    n = len(ids)
    turn = np.array([[int(x) for x in t] for t in turns], np.int8).reshape(n, levels)
    member = np.arange(n)
    for level in range(levels):
        degree = np.bincount(u, w, n)
        here = np.unique(u)
        c = np.arange(n)
        apart = u != v
        au, av, aw = u[apart], v[apart], w[apart]
        rested = moved = 0
        for i in range(rounds):
            sums = np.bincount(c[here], degree[here], n)
            key, at = np.unique(np.concatenate([au * n + c[av], here * n + c[here]]), return_inverse=True)
            link = np.bincount(at, np.concatenate([aw, np.zeros(len(here))]), len(key))
            ku, kc = key // n, key % n
            own = kc == c[ku]
            others = sums[kc] - np.where(own, degree[ku], 0.0)
            gain = np.floor((link - others * degree[ku] / total) * FINE + 0.5)
            order = np.lexsort((kc, -gain, ku))
            first = order[np.concatenate([[True], ku[order][1:] != ku[order][:-1]])]
            stays = np.zeros(n)
            stays[ku[own]] = gain[own]
            move = first[(turn[ku[first], level] == i % 2) & (gain[first] > stays[ku[first]])]
            c[ku[move]] = kc[move]
            moved, rested = moved + len(move), 0 if len(move) else rested + 1
            if rested == 2:
                break
        if not moved:
            break
        member = c[member]
        key, at = np.unique(c[u] * n + c[v], return_inverse=True)
        u, v, w = key // n, key % n, np.bincount(at, w, len(key))
    return member


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 12, rounds: int = 16, in_a_task: int = 500_000) -> DataFrame:
    """(id, community): communities of great modularity by Louvain's moves and contractions.

    In a round each node of one half, drawn by hash, moves to the neighbouring
    community of greatest gain, ties going to the smaller name; the halves
    alternate, or neighbours would swap for ever. When both halves rest, the
    communities become the nodes of the next level. A community is named by
    one of its nodes; nodes without an edge are communities of their own.

    Moves never leave a connected component, so components of up to in_a_task
    arcs are worked out in one task each, or in shares of many small ones, and
    larger ones by distributed rounds: the same moves in the same order, with
    the same result.
    """
    plain = edges.where("source <> target").select("source", "target", F.col("weight").cast("double").alias("w"))
    arcs = cut(plain.select(F.col("source").alias("u"), F.col("target").alias("v"), "w").union(plain.select("target", "source", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    total = arcs.agg(F.sum("w")).first()[0] or 0.0
    alone = nodes.select("id").distinct().join(arcs.select(F.col("u").alias("id")), "id", "left_anti").withColumn("community", F.col("id"))
    if not total:
        return alone
    roots = components(arcs.select(F.col("u").alias("a"), F.col("v").alias("b")))
    placed = cut(arcs.join(roots.withColumnRenamed("id", "u"), "u"))
    sized = cut(placed.groupBy("root").agg(F.count("*").alias("n")))
    turn = F.concat(*[F.pmod(F.xxhash64("u", F.lit(i)), F.lit(2)).cast("string") for i in range(levels)])
    # small components share tasks; components don't touch each other, so this changes no move
    few = F.col("n") <= in_a_task // 10
    shares = max(1, -(-(sized.where(few).agg(F.sum("n")).first()[0] or 0) // max(1, in_a_task // 10)))
    group = F.when(few, F.pmod(F.xxhash64("root"), F.lit(shares)).cast("string"))
    small = placed.join(sized.where(F.col("n") <= in_a_task).select("root", group.alias("share"), F.when(~few, F.col("root")).alias("one")), "root").withColumn("turns", turn)
    kind = dict(arcs.dtypes)["u"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        one = p.drop_duplicates("u").sort_values("u")
        ids = one["u"].tolist()
        number = {x: i for i, x in enumerate(ids)}
        u, v = (p[c].map(number).to_numpy(np.int64) for c in ("u", "v"))
        got = _moves(ids, u, v, p["w"].to_numpy(float), one["turns"].tolist(), total, levels, rounds)
        return pd.DataFrame({"id": ids, "community": [ids[i] for i in got]})

    done = small.groupBy("share", "one").applyInPandas(run, f"id {kind}, community {kind}")
    large = cut(placed.join(sized.where(F.col("n") > in_a_task).select("root"), "root").select("u", "v", "w"))
    if not large.isEmpty():
        done = done.unionByName(_distributed_moves(large, total, levels, rounds))
    return done.unionByName(alone)


def _distributed_moves(arcs: DataFrame, total: float, levels: int, rounds: int) -> DataFrame:
    """(id, community) by the moves of louvain over arcs (u, v, w) of any number."""
    member = cut(arcs.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")))
    for level in range(levels):
        state = cut(arcs.groupBy("u").agg(F.sum("w").alias("degree")).withColumn("c", F.col("u")))
        between = arcs.where("u <> v")
        rested = moves = 0
        for i in range(rounds):
            sums = state.groupBy("c").agg(F.sum("degree").alias("all"))
            links = between.join(state.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("link"))
            # its own community always stands for choice, also without a link to it
            offered = links.unionByName(state.select("u", "c", F.lit(0.0).alias("link"))).groupBy("u", "c").agg(F.sum("link").alias("link")).join(sums, "c").join(state.withColumnRenamed("c", "own"), "u")
            others = F.col("all") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0.0)
            gain = F.floor((F.col("link") - others * F.col("degree") / total) * FINE + 0.5)
            best = offered.withColumn("gain", gain).groupBy("u", "own", "degree").agg(F.max("gain").alias("most"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stays"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"))
            turn = F.pmod(F.xxhash64("u", F.lit(level)), F.lit(2)) == i % 2
            moved = turn & (F.col("most") > F.col("stays"))
            state = cut(best.select("u", "degree", F.when(moved, F.col("b.c")).otherwise(F.col("own")).alias("c"), moved.alias("moved")))
            n = state.where("moved").count()
            state = state.drop("moved")
            moves, rested = moves + n, 0 if n else rested + 1
            if rested == 2:
                break
        if not moves:
            break
        home = state.select("u", "c")
        member = cut(member.join(home.select(F.col("u").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        arcs = cut(arcs.join(home.select("u", F.col("c").alias("cu")), "u").join(home.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    return member


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(modularity): of communities (id, community) over undirected edges (source, target, weight)."""
    one = edges.where("source <> target").join(members.select(F.col("id").alias("source"), F.col("community").alias("cs")), "source").join(members.select(F.col("id").alias("target"), F.col("community").alias("ct")), "target")
    ends = one.select(F.explode(F.array("cs", "ct")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    inside = one.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("weight")).otherwise(0.0)).alias("inner"))
    # no edge has no modularity; both sides are one row
    return ends.agg(F.sum(F.col("d") * F.col("d")).alias("dd")).crossJoin(inside).select(F.round(F.col("inner") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))


def community_stats(members: DataFrame, edges: DataFrame, labels: DataFrame, degree: DataFrame) -> DataFrame:
    """(community, n_nodes, cohesion, top_nodes): communities of members (id, community) by size; cohesion is the part of possible inner edges that exist, 0 for one node; the five labels (id, label) of highest degree (id, link_count)."""
    size = members.groupBy("community").agg(F.count("*").alias("n_nodes"))
    s, t = members.select(F.col("id").alias("source"), F.col("community").alias("cs")), members.select(F.col("id").alias("target"), F.col("community").alias("ct"))
    inner = edges.join(s, "source").join(t, "target").where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("n_inner"))
    w = Window.partitionBy("community").orderBy(F.desc("link_count"), "id")
    ranked = members.join(labels.select("id", "label"), "id").join(degree, "id").withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    tops = ranked.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]).alias("top_nodes"))
    rows = size.join(inner, "community", "left").join(tops, "community", "left")
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    rows = rows.withColumn("cohesion", F.when(F.col("n_nodes") > 1, F.round(F.coalesce("n_inner", F.lit(0)) / possible, 6)).otherwise(0.0))
    return rows.select("community", "n_nodes", "cohesion", "top_nodes")


def numbered(stats: DataFrame) -> DataFrame:
    """stats (community, n_nodes, ...) with `number` from 0, the largest first, equals by name; ranks inside ranges of the order plus the ranges' offsets, so no task gets all rows."""
    ranged = cut(stats.repartitionByRange(F.desc("n_nodes"), "community").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("n_nodes"), "community"))
    return ranged.withColumn("_r", own).join(F.broadcast(before), "_p").withColumn("number", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def build(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with link_count, undirected edges) of pages (id, path, text)."""
    nodes = cut(nodes_of(pages))
    links = resolved(links_of(pages), nodes).join(nodes.select(F.col("id").alias("source")), "source", "left_semi")
    links = cut(links)
    return nodes.join(degrees(links, nodes), "id"), undirected(links)


def node_size(links: DataFrame) -> DataFrame:
    """links (id, link_count) with the size at which a node is drawn."""
    most = links.agg(F.max("link_count").alias("_m"))
    return links.crossJoin(F.broadcast(most)).select("id", "link_count", F.round(8 + F.sqrt(F.when(F.col("_m") > 0, F.col("link_count") / F.col("_m")).otherwise(0.0)) * 20, 6).alias("size"))
