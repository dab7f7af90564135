"""Near-duplicate embeddings by NN-descent.

1. Vectors that are equal are one node. A first neighbour graph comes from
   random-projection buckets: within a block of a bucket every node takes its
   ``k`` most similar nodes.
2. Each round joins every node with its neighbours and reverse neighbours
   (neighbours of neighbours meet there), compares them with each other and
   keeps the ``k`` best of every node's old and new neighbours.
3. A node whose list is full of links is saturated: its true links may be
   more than the list holds. All lists that link are then enlarged to the
   node's whole linked group: groups are connected components of the threshold
   edges, and all pairs of a group are compared in tiles of two slices, which
   return sums, never pairs. A group's links are thus exact. Links that leave
   the group are searched by the saturated nodes in the same way (buckets, then
   rounds), but with lists that hold only nodes outside their own group; groups
   that link become one, and nodes whose new lists are full of links search
   again, until no list is full or no link is new.
   The number of bucket tables follows from their bits, so that at any size a
   pair at ``t`` shares no bucket with probability ``miss``; rounds follow until
   under one in a hundred lists changes.
4. The audit draws ``audit`` nodes of every class of group sizes (nodes without
   a group are a class) by a seeded hash and compares them with all nodes. The
   recall is a mean over nodes, not pairs, taken for each class of true numbers
   of links, and the least of these counts. The draw grows until ``seen`` linked
   nodes outside large groups were met, all nodes were drawn, it is 64 times
   as large or its vectors reach ``DRAWN_BYTES``. While the recall is under
   ``recall`` or too few linked nodes were met, further buckets and rounds follow
   (at most ``tries``); if the recall stays under ``recall``, all pairs are
   compared. If too few were met to the end, the links are so rare that the recall
   is not measured: the column ``recall`` is null, not 1, and what holds is the
   miss probability of the tables.

Candidates are found in single precision; a link is decided in double
precision on the given components, at cosine >= ``t``.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different length never link; equal
vectors link; a null vec_id takes part and is never the smallest; repeated rows
are nodes of the same class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side
from .graph import connected_components
from .jaccard import in_bins, in_tiles, roots, tiles_of

BLOCK = 256
#: bytes of stored vectors that pass through the driver at a time
DRAWN_BYTES = 64 << 20
NEIGHBOURS = "array<struct<s: float, v: long>>"


def _usable(c: Column) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct usable vector: node, own (its group, at first the
    node), vec_id (smallest), copies, vec (float64 components as bytes)."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["vec"] = [(np.asarray(v, dtype=np.float64) + 0.0).tobytes() for v in b["embedding"]]
            b["own"] = b["node"]
            yield b[["node", "own", "vec_id", "copies", "vec"]]

    return materialize(
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .mapInPandas(pack, "node long, own long, vec_id long, copies long, vec binary"), "vectors")


def _unit(vecs: pd.Series, dtype=np.float32) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(dtype)


def _best(sims: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row; -2 for nodes of the own group."""
    sims[own[:, None] == own] = -2
    k = min(k, len(sims) - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(sims, at, 1)


def _lists(node: np.ndarray, own: np.ndarray, sims: np.ndarray, k: int) -> pd.DataFrame:
    at, s = _best(sims, own, k)
    ids = node[at]
    return pd.DataFrame({"u": node, "near": [[{"s": float(a), "v": int(b)} for a, b in zip(x, y) if a > -2]
                                             for x, y in zip(s, ids)]})


def _lengths(vecs: pd.Series) -> Iterator[np.ndarray]:
    size = vecs.str.len().to_numpy()
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def tables_for(bits: int, t: float, miss: float, least: int) -> int:
    """Bucket tables of ``bits`` random planes after which a pair at cosine ``t``
    shared no bucket with probability ``miss`` at most."""
    together = (1 - np.arccos(min(1.0, t)) / np.pi) ** bits
    return least if together >= 1 else max(least, int(np.ceil(np.log(miss) / np.log1p(-together))))


def bucket_bits(total: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, total / (BLOCK / 2))))))


def bucket_lists(nodes: DataFrame, total: int, tables: int, k: int, seed: int) -> DataFrame:
    """(u, near) from blocks of random-projection buckets, several times; a list
    holds only nodes of another group ``own``."""
    bits = bucket_bits(total)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in _lengths(b["vec"]):
                part = b.iloc[at]
                x = _unit(part["vec"])
                for t in range(tables):
                    plane = np.random.default_rng((seed, t, x.shape[1])).normal(size=(x.shape[1], bits + 1))
                    z = x @ plane
                    code = (z[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"key": (code << 24) + (t << 16) + x.shape[1] % 65536, "along": z[:, bits].astype(float),
                                        "node": part["node"].to_numpy(), "own": part["own"].to_numpy(),
                                        "vec": part["vec"].to_numpy()})

    placed = nodes.select("node", "own", "vec").mapInPandas(
        keys, "key long, along double, node long, own long, vec binary")
    # a bucket is cut into blocks along one more projection: within slices that
    # hash spreads, so no task sorts a whole bucket
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cut = placed.join(sizes, "key").withColumn("part", F.when(F.col("n") <= 2 * BLOCK, 0).otherwise(F.floor(
        (F.col("along") + 1) / 2 * F.ceil(F.col("n") / BLOCK))).cast("long")).withColumn(
        "part2", F.when(F.col("n") > 4 * BLOCK, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (4 * BLOCK)))).otherwise(0))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["key", "part", "part2"]):
            for lo in range(0, len(g), 2 * BLOCK):
                h = g.iloc[lo:lo + 2 * BLOCK]
                if len(h) > 1:
                    x = _unit(h["vec"])
                    out.append(_lists(h["node"].to_numpy(), h["own"].to_numpy(), x @ x.T, k))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "near": []})

    bins = F.pmod(F.xxhash64("key", "part", "part2"), F.lit(max(1, total * tables // 2_000)))
    return cut.withColumn("_bin", bins).groupBy("_bin").applyInPandas(within, f"u long, near {NEIGHBOURS}")


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of every node, best first."""
    top = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False), 1, 3 * k)
    best = F.aggregate(top, F.array().cast(NEIGHBOURS), lambda a, x: F.when(
        F.exists(a, lambda y: y["v"] == x["v"]), a).otherwise(F.concat(a, F.array(x))))
    return lists.groupBy("u").agg(F.slice(best, 1, k).alias("near"))


def descend(graph: DataFrame, nodes: DataFrame, total: int, k: int, seed: int,
            known: DataFrame | None = None) -> DataFrame:
    """One round: compare the neighbours and reverse neighbours of every node,
    also those that the lists ``known`` hold."""
    lists = graph if known is None else graph.unionByName(known)
    out = lists.select("u", F.explode("near").alias("x")).select("u", F.col("x.v").alias("v")).distinct()
    # a node takes part in at most k reverse lists, drawn by hash; the rest meet
    # it through their own lists
    rank = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(seed), "u", "v"))
    back = (out.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("_r", F.row_number().over(rank))
            .filter(F.col("_r") <= k).drop("_r"))
    met = out.unionByName(back).unionByName(lists.select("u", F.col("u").alias("v"))).distinct()
    met = met.join(nodes.select(F.col("node").alias("v"), "own", "vec"), "v")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["u", "v"], ignore_index=True)
        u = pdf["u"].to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
        v, own = pdf["v"].to_numpy(), pdf["own"].to_numpy()
        seen: dict[int, dict[int, float]] = {}
        for lo, hi in zip(starts[:-1], starts[1:]):
            if hi - lo > 1:
                x = _unit(pdf["vec"].iloc[lo:hi])
                at, s = _best(x @ x.T, own[lo:hi], k)
                for i, (cols, vals) in enumerate(zip(v[lo:hi][at].tolist(), s.tolist())):
                    seen.setdefault(int(v[lo + i]), {}).update((c, a) for c, a in zip(cols, vals) if a > -2)
        for node, near in seen.items():
            best = sorted(near.items(), key=lambda p: -p[1])[:k]
            out.append((node, [{"s": s, "v": w} for w, s in best]))
        return pd.DataFrame(out, columns=["u", "near"])

    bins = F.pmod(F.xxhash64("u"), F.lit(max(1, total // 200)))
    new = met.withColumn("_bin", bins).groupBy("_bin").applyInPandas(local, f"u long, near {NEIGHBOURS}")
    return materialize(merged(graph.unionByName(new), k), "graph")


def _exact(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return a @ b.T >= t


def true_edges(graph: DataFrame, nodes: DataFrame, t: float) -> DataFrame:
    """(a, b) of listed pairs at cosine >= t, decided in double precision."""
    pairs = (graph.select("u", F.explode("near").alias("x")).filter(F.col("x.s") >= t - 1e-4)
             .select(F.least("u", "x.v").alias("a"), F.greatest("u", "x.v").alias("b")).distinct())
    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for at in _lengths(p["va"]):
                q = p.iloc[at]
                cos = (_unit(q["va"], np.float64) * _unit(q["vb"], np.float64)).sum(1)
                yield q[["a", "b"]][cos >= t]

    return materialize(both.mapInPandas(decide, "a long, b long"), "true-edges")


def searched(graph: DataFrame | None, nodes: DataFrame, total: int, t: float, miss: float, tables: int, rounds: int,
             k: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """The lists of ``graph`` after further buckets and at least ``rounds`` rounds."""
    more = bucket_lists(nodes, total, tables_for(bucket_bits(total), t, miss, tables), k, seed)
    graph = materialize(merged(more if graph is None else graph.unionByName(more), k), "graph")
    done = 0
    while True:
        new = descend(graph, nodes, total, k, seed + done, known)
        changed = new.join(graph.withColumnRenamed("near", "_near"), "u", "left").filter(
            ~F.col("near").eqNullSafe(F.col("_near"))).count()
        graph, done = new, done + 1
        if done >= rounds and 100 * changed <= total:
            return graph


def linked_groups(graph: DataFrame, nodes: DataFrame, t: float, miss: float, k: int, tables: int, rounds: int,
                  seed: int) -> DataFrame:
    """(id, component) by the links of ``graph`` and those that its full lists leave out."""
    edges, lists = true_edges(graph, nodes, t), graph
    while True:
        groups = materialize(connected_components(edges), "groups")
        # a pair is left out only if both lists are full of links
        full = lists.filter((F.size("near") >= k) & (F.array_min(F.transform("near", lambda x: x["s"])) >= t - 1e-4))
        rest = materialize(nodes.drop("own").join(full.select(F.col("u").alias("node")), "node").join(
            groups.select(F.col("id").alias("node"), F.col("component").alias("own")), "node", "left")
            .withColumn("own", F.coalesce("own", "node")), "full")
        total = rest.count()
        if not total:
            return groups
        known = graph.join(full.select("u"), "u", "left_semi")
        seed += 100
        lists = searched(None, rest, total, t, miss, tables, rounds, k, seed, known)
        new = true_edges(lists, rest, t)
        if new.isEmpty():
            return groups
        edges = edges.unionByName(new)


def _count_bin(t: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, left, right in tiles_of(pdf):
            x, copies = _unit(part["vec"], np.float64), part["copies"].to_numpy()
            links = np.zeros(len(x), np.int64)
            if right is None:
                near = _exact(x[left], x[left], t)
                np.fill_diagonal(near, False)
                links[left] = near @ copies[left]
            else:
                near = _exact(x[left], x[right], t)
                links[left] += near @ copies[right]
                links[right] += near.T @ copies[left]
            out.append(pd.DataFrame({"node": part["node"].to_numpy(), "links": links}))
        return pd.concat(out)
    return run


def _compared(nodes: DataFrame, drawn: pd.DataFrame, t: float, out: str, reduce) -> DataFrame:
    """``reduce`` of the runs of links between nodes and ``drawn`` that a task
    finds: (drawn number, row number of the task's batch, batch)."""
    sent = nodes.sparkSession.sparkContext.broadcast(drawn)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = sent.value
        sets = [(at, _unit(drawn["vec"].iloc[at], np.float64)) for at in _lengths(drawn["vec"])]

        def runs():
            for b in batches:
                for at in _lengths(b["vec"]):
                    for lo in range(0, len(at), BLOCK):
                        own = at[lo:lo + BLOCK]
                        x = _unit(b["vec"].iloc[own], np.float64)
                        for q, y in sets:
                            if y.shape[1] == x.shape[1]:
                                i, j = np.nonzero(_exact(y, x, t))
                                i, j = q[i], own[j]
                                keep = drawn["node"].to_numpy()[i] != b["node"].to_numpy()[j]
                                yield i[keep], j[keep], b
        yield from reduce(drawn, runs())

    return nodes.mapInPandas(part, out)


def rows_within(nodes: DataFrame, room: int) -> int:
    """How many nodes' vectors fit ``room`` bytes (at least one)."""
    return max(1, room // (nodes.agg(F.max(F.octet_length("vec"))).first()[0] or 1))


def audited(nodes: DataFrame, groups: DataFrame, t: float, audit: int, seed: int, seen: int = 100,
            room: int = DRAWN_BYTES) -> tuple[float, bool]:
    """(least share of a node's links that lie within its group, over classes of
    nodes by their true number of links; whether enough nodes were seen)."""
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    member = groups.join(small_side(materialize(size, "audit-sizes")), "component").select(
        F.col("id").alias("node"), "component", "n")
    level = F.when(F.col("n").isNull(), 0).otherwise(F.floor(F.log2("n") / 2)).cast("int")
    nodes = materialize(nodes.select("node", "vec").join(member, "node", "left").withColumn("level", level), "audit")
    many = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    most, got = rows_within(nodes, room), None
    place = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) / float(1 << 30)

    def count(drawn, runs):
        true, found = np.zeros(len(drawn), np.int64), np.zeros(len(drawn), np.int64)
        own = drawn["component"].to_numpy()
        for i, j, b in runs:
            true += np.bincount(i, minlength=len(true))
            found += np.bincount(i[own[i] == b["component"].to_numpy()[j]], minlength=len(true))
        yield pd.DataFrame({"node": drawn["node"], "true": true, "found": found})[true > 0]

    for grown in (1, 4, 16, 64):
        wider = {c: min(1.0, grown * audit / n) for c, n in many.items()}
        asked = sum(x * many[c] for c, x in wider.items())
        if asked > most:
            if got is not None:
                break
            wider = {c: x * most / asked for c, x in wider.items()}
        share = wider
        drawn = nodes.filter(F.coalesce(*[F.when(F.col("level") == c, place < x) for c, x in share.items()])
                             if share else F.lit(False)).toPandas()
        if drawn.empty:
            return 1.0, not many or min(share.values()) == 1
        got = _compared(nodes.select("node", "component", "vec"), drawn, t, "node long, true long, found long", count)
        got = got.groupBy("node").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).toPandas()
        got = got.merge(drawn[["node", "level", "n"]], "left", "node")
        small = int((got["n"].isna() | (got["n"] <= BLOCK)).sum())
        whole = all(x == 1 for c, x in share.items() if 4 ** c <= BLOCK)
        if small >= seen or whole:
            break
    got["weight"] = 1 / got["level"].map(share).astype(float)
    got["part"] = got["found"] / got["true"] * got["weight"]
    kinds = got.groupby(np.floor(np.log2(got["true"]) / 2)).agg(n=("node", "size"), part=("part", "sum"), weight=("weight", "sum"))
    least, run = 1.0, np.zeros(3)
    for row in kinds.to_numpy():  # classes of few drawn nodes count together
        run = run + row
        if run[0] >= 20:
            least, run = min(least, run[1] / run[2]), np.zeros(3)
    total = kinds.to_numpy().sum(0) if len(kinds) else np.zeros(3)
    if run[0] and total[0] < 40:
        least = min(least, total[1] / total[2])
    return float(least), bool(small >= seen or whole)


def all_edges(nodes: DataFrame, t: float, rows: int = 4_000, room: int = DRAWN_BYTES) -> DataFrame:
    """Edges that span the groups of all pairs at cosine >= t, every node compared
    with every node, ``rows`` of them or ``room`` bytes at a time."""
    def forest(drawn, runs):
        a = drawn["node"].to_numpy()
        for i, j, b in runs:
            if len(i):
                used, back = np.unique(np.concatenate((a[i], b["node"].to_numpy()[j])), return_inverse=True)
                root = roots(len(used), back[:len(i)], back[len(i):])
                yield pd.DataFrame({"a": used, "b": used[root]})[root != np.arange(len(used))]

    rows = min(rows, rows_within(nodes, room))
    out, blocks = None, max(1, -(-nodes.count() // rows))
    for k in range(blocks):
        drawn = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select("node", "vec").toPandas()
        if len(drawn):
            part = materialize(_compared(nodes.select("node", "vec"), drawn, t, "a long, b long", forest).distinct(), "all")
            out = part if out is None else out.unionByName(part)
    return out


def link(rows: DataFrame, t: float = 0.95, k: int = 10, tables: int = 4, rounds: int = 2, audit: int = 500,
         recall: float = 0.98, tries: int = 3, seed: int = 9, miss: float = 0.01) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall per row; recall is the last
    audit's, 1 if all pairs were compared, null if too few linked nodes were met."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_usable(F.col("embedding")), F.transform(
        "embedding", lambda x: x.cast("double") + F.lit(0.0))).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    nodes = nodes_of(rows)
    total = nodes.count()
    graph = None
    for i in range(tries):
        graph = searched(graph, nodes, total, t, miss, tables, rounds, k, seed + 10_000 * i)
        groups = linked_groups(graph, nodes, t, miss, k, tables, rounds, seed + 10_000 * i)
        reached, enough = audited(nodes, groups, t, audit, seed)
        if reached >= recall and enough:
            break
    if reached < recall:
        groups, reached = materialize(connected_components(all_edges(nodes, t)), "groups"), 1.0
        enough = True
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    member = materialize(groups.join(small_side(materialize(sizes, "sizes")), "component").select(
        F.col("id").alias("node"), F.col("component").alias("key"), "n"), "member")
    tiles = member.agg(F.sum(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    links = in_bins(in_tiles(member.join(nodes.select("node", "copies", "vec"), "node"), "n", BLOCK), tiles).applyInPandas(
        _count_bin(t), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    told = (nodes.select("node", "vec_id", "copies").join(links, "node", "left")
            .join(member.select("node", "key"), "node", "left").filter("copies > 1 OR key IS NOT NULL")
            .withColumn("key", F.coalesce("key", "node")))
    least = told.groupBy("key").agg(F.min("vec_id").alias("component_id"))
    told = materialize(told.join(least, "key").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told")
    return (rows.select("vec_id", "node").join(small_side(told), "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
            .withColumn("recall", F.lit(float(reached) if enough else None).cast("double")))
