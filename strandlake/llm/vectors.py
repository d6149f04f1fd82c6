"""Near-duplicate vectors by navigable small-world graphs, and exact top-k search by ball trees.

Near-duplicates (after Malkov and Yashunin, "Efficient and robust approximate nearest neighbor search using hierarchical
navigable small world graphs"). Vectors of a label are dealt to shards by hash. Each shard has a graph; its own vectors and
those of the shards before it are searched in it, so each pair is looked for once. A search keeps a beam; if the whole
beam is near enough to be links, or if an audit against brute force finds a recall below `audit`, the beam is widened and
the search repeated. Each link is verified by cosine in double precision. Copies within a shard stand as one node.

Top-k: a shard is a ball tree; from the root on, a query opens nodes in the order of their bounds q.c + |q| r and stops when
none that is left reaches its current kth score. First each query is answered in its home shard; the kth score found there is
shared with all other shards as the score to beat.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part (near-duplicates: nor zero
vectors; they are rows of their own without links); vectors of different lengths are not compared; rows that repeat are
rows of their own; null labels are not compared; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, connected_components, read_partitions, written
from strandlake.llm.jaccard import whole_groups


def finite(v: Column) -> Column:
    """Whether a vector is whole: not null or empty, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


# ---- the graph ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphSettings:
    threshold: float = 0.98
    shard_rows: int = 16_384
    #: Shards whose vectors are searched in another shard by one task.
    query_shards: int = 8
    links: int = 12
    build_beam: int = 64
    beam: int = 64
    #: A beam whose last member is as near as this below the threshold is full of links and is widened.
    margin: float = 0.02
    audit: float = 0.995
    audited: int = 48
    #: An audit goes on until it has met so many links, or has asked so many vectors.
    audited_links: int = 64
    most_audited: int = 1024
    seed: int = 1


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, units: np.ndarray, s: GraphSettings):
        self.x, self.s, n = np.ascontiguousarray(units, np.float32), s, len(units)
        rng = np.random.default_rng(s.seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(s.links)).astype(int), 6)
        top = int(self.level.max(initial=0))
        self.room = [2 * s.links] + [s.links] * top
        self.adjacent = [np.full((n, r), -1, np.int32) for r in self.room]
        self.degree = [np.zeros(n, np.int32) for _ in self.room]
        self.seen, self.stamp = np.zeros(n, np.int32), 0
        self.entry, self.top = -1, -1
        for i in rng.permutation(n).tolist():
            self.insert(i)
        self.mend()

    def mend(self, extra: int = 8) -> None:
        """Nodes that no path from the entry leads to (their backward links were pruned) get a link from a neighbour that is led
        to, in places kept free for that."""
        base, n = self.adjacent[0], len(self.x)
        if self.entry < 0:
            return
        self.adjacent[0] = base = np.concatenate([base, np.full((n, extra), -1, np.int32)], 1)
        reached, edge = np.zeros(n, bool), np.array([self.entry])
        while True:
            while len(edge):
                reached[edge] = True
                met = np.zeros(n, bool)
                near = base[edge].ravel()
                met[near[near >= 0]] = True
                edge = np.flatnonzero(met & ~reached)
            linked = []
            for i in np.flatnonzero(~reached).tolist():
                near = base[i][base[i] >= 0]
                for j in near[reached[near]].tolist():
                    free = np.flatnonzero(base[j] < 0)
                    if len(free):
                        base[j, free[0]] = i
                        linked.append(i)
                        break
            if not linked:
                return
            edge = np.array(linked)

    def search(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's ids and similarities, nearest first. Every unexpanded member of the beam is expanded in each round."""
        self.stamp += 1
        stamp, seen, x, adjacent = self.stamp, self.seen, self.x, self.adjacent[layer]
        ids = start
        seen[ids] = stamp
        sims = x[ids] @ q
        new = np.ones(len(ids), bool)
        while True:
            more = adjacent[ids[new]].ravel()
            more = more[more >= 0]
            more = more[seen[more] != stamp]
            if not len(more):
                break
            if 16 * len(more) > len(seen):
                # many neighbours: marking them costs less than sorting them
                met = np.zeros(len(seen), bool)
                met[more] = True
                more = np.flatnonzero(met)
            else:
                more.sort()
                more = more[np.concatenate([[True], more[1:] != more[:-1]])]
            seen[more] = stamp
            ids = np.concatenate([ids, more])
            sims = np.concatenate([sims, x[more] @ q])
            new = np.zeros(len(ids), bool)
            new[-len(more) :] = True
            if len(ids) > width:
                keep = np.argpartition(-sims, width - 1)[:width]
                ids, sims, new = ids[keep], sims[keep], new[keep]
                if not new.any():
                    break
        order = np.argsort(-sims, kind="stable")
        return ids[order], sims[order]

    def select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first: those nearer to the node than to any candidate taken before, then the nearest others."""
        if len(ids) <= most:
            return ids
        v = self.x[ids]
        between = v @ v.T
        taken: list[int] = []
        closest = np.full(len(ids), -2.0, np.float32)
        for i in range(len(ids)):
            if closest[i] < sims[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                np.maximum(closest, between[i], out=closest)
        if len(taken) < most:
            rest = np.setdiff1d(np.arange(len(ids)), taken)
            taken += rest[: most - len(taken)].tolist()
        return ids[taken]

    def insert(self, i: int) -> None:
        level, q = int(self.level[i]), self.x[i]
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        start = np.array([self.entry])
        for layer in range(self.top, -1, -1):
            if layer > level:
                start = self.search(q, start, layer, 1)[0]
                continue
            ids, sims = self.search(q, start, layer, self.s.build_beam)
            own = self.select(ids, sims, self.s.links)
            adjacent, degree, room = self.adjacent[layer], self.degree[layer], self.room[layer]
            adjacent[i, : len(own)] = own
            degree[i] = len(own)
            for j in own.tolist():
                d = degree[j]
                if d < room:
                    adjacent[j, d] = i
                    degree[j] = d + 1
                else:
                    near = np.append(adjacent[j], i)
                    s = self.x[near] @ self.x[j]
                    order = np.argsort(-s, kind="stable")
                    kept = self.select(near[order], s[order], room)
                    adjacent[j] = kept
            start = ids
        if level > self.top:
            self.entry, self.top = i, level

    def near(self, q: np.ndarray, width: int) -> np.ndarray:
        """Ids that may be links of q; the beam is widened as long as it is full of them."""
        if self.entry < 0:
            return np.empty(0, np.int64)
        start, low = np.array([self.entry]), self.s.threshold - self.s.margin
        for layer in range(self.top, 0, -1):
            start = self.search(q, start, layer, 1)[0]
        while True:
            ids, sims = self.search(q, start, 0, width)
            if len(ids) < width or sims[-1] < low:
                return ids[sims >= self.s.threshold - 1e-4]
            start, width = ids, 8 * width


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first, so that none overflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def shard_links(row, units, query_row, query_units, own: bool, s: GraphSettings):
    """((row, links, other), (found, true)) of one shard: its own pairs if `own`, and its pairs with the query vectors; and of
    the links of the vectors audited last, how many were found, and how many there are."""
    _, first, of = np.unique(units.view([("", units.dtype)] * units.shape[1]).ravel(), return_index=True, return_inverse=True)
    nodes, weight = units[first], np.bincount(of)
    graph = Graph(nodes, s)
    n, nq = len(nodes), len(query_units)
    asked = np.concatenate([nodes, query_units]) if nq else nodes
    asked32 = asked.astype(np.float32)
    todo = range(0 if own else n, n + nq)
    width = s.beam

    def hits(i: int, width: int) -> np.ndarray:
        h = graph.near(asked32[i], width)
        h = h[nodes[h] @ asked[i] >= s.threshold]
        return h[h < i] if i < n else h

    rng, true, got = np.random.default_rng(s.seed), 0, 0
    while len(todo):
        found = [hits(i, width) for i in todo]
        linked = [k for k, h in enumerate(found) if len(h)]
        # some that have links, and others in random order until enough links were met or many vectors had none
        order, at, seen = rng.permutation(len(todo)), 0, set()
        more = rng.choice(linked, min(len(linked), s.audited), replace=False).tolist() if linked else []
        true = got = 0
        while True:
            for k in set(more) - seen:
                i = todo[k]
                exact = nodes @ asked[i] >= s.threshold
                true += int(exact[:i].sum() if i < n else exact.sum())
                got += len(found[k])
            seen |= set(more)
            if at >= len(order) or at >= s.audited and (true >= s.audited_links or at >= s.most_audited):
                break
            more, at = order[at : at + s.audited].tolist(), at + s.audited
        if got >= s.audit * true or width >= n:
            break
        width *= 2
    else:
        found = []
    links = np.zeros(n + nq, np.int64)
    up = np.arange(n + nq)

    def roots(a: np.ndarray) -> np.ndarray:
        while (up[a] != a).any():
            up[a] = up[up[a]]
            a = up[a]
        return a

    weight_all = np.concatenate([weight, np.ones(nq, np.int64)])
    for i, h in zip(todo, found, strict=True):
        if len(h):
            links[i] += weight[h].sum()
            links[h] += weight_all[i]
            r = np.unique(roots(np.append(h, i)))
            up[r] = r[0]
    out_row = np.concatenate([row, query_row])
    at = np.concatenate([of, np.arange(n, n + nq)]).astype(np.int64)
    copies = np.concatenate([(weight[of] - 1) if own else np.zeros(len(of), np.int64), np.zeros(nq, np.int64)])
    total = links[at] + copies
    head = np.concatenate([row[first], query_row])  # a row that stands for each node
    other = head[roots(at)]
    keep = total > 0
    return (out_row[keep], total[keep], other[keep]), (got, true)


def linked_vectors(embeddings: DataFrame, s: GraphSettings = GraphSettings()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings, and audited_links, the links that brute force finds
    for all audited vectors, and audited_recall, the share of these that the graphs found (null if there were none): both the
    same in all rows."""
    bounded_batches(embeddings.sparkSession)
    rows = written(embeddings.select(F.monotonically_increasing_id().alias("__row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "vectors")
    v = F.col("embedding")
    whole = rows.where(F.col("label").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).withColumn("__group", F.xxhash64("label", F.size(v)))
    counts = written(whole.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).withColumn("__shards", F.ceil(F.col("n") / s.shard_rows).cast("int")), "vector-labels")
    tasks = counts.agg(F.sum(F.col("__shards") * F.ceil(F.col("__shards") / s.query_shards))).first()[0] or 1
    dealt = whole.join(counts, "__group").select("__group", "__row", "embedding", "__shards", F.pmod(F.xxhash64("__row", F.lit(s.seed)), "__shards").cast("int").alias("__shard"))
    # role 0: a shard's own vectors, for each block of shards before it; role 1: vectors of shards before it
    own = dealt.select("*", F.col("__shard").alias("__at"), F.explode(F.sequence(F.lit(0), F.floor(F.col("__shard") / s.query_shards).cast("int"))).alias("__block"), F.lit(0).alias("__role"))
    asked = dealt.where("__shard + 1 < __shards").select("*", F.explode(F.sequence(F.col("__shard") + 1, F.col("__shards") - 1)).alias("__at"), F.floor(F.col("__shard") / s.query_shards).cast("int").alias("__block"), F.lit(1).alias("__role"))
    sent = own.unionByName(asked).select(F.xxhash64("__group", "__at", "__block").alias("__task"), "__role", "__block", "__row", "embedding")

    def run(batches):
        for t in whole_groups(batches):
            task = t.column(0).to_numpy()
            for a, b in _spans(task):
                part = t.slice(a, b - a)
                role, block, row = (part.column(i).to_numpy() for i in (1, 2, 3))
                units = unit_rows(matrix(part.column(4)))
                q = role == 1
                got, (seen, true) = shard_links(row[~q], units[~q], row[q], units[q], bool(block[0] == 0), s)
                # the audit's row has no vector
                got = [np.append(x, y).astype(np.int64) for x, y in zip(got, (-1, seen, true), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["__row", "n", "other"])

    parts = max(read_partitions(embeddings.sparkSession), min(4 * int(tasks), 20_000))
    found = written(sent.repartition(parts, "__task").sortWithinPartitions("__task", "__role").mapInArrow(run, "__row long, n long, other long"), "vector-links")
    audits = found.where("__row < 0").agg(F.sum("n").alias("a"), F.sum("other").alias("b"))
    found = found.where("__row >= 0")
    of = connected_components(found.select(F.col("__row").alias("a"), F.col("other").alias("b")))
    n = found.groupBy("__row").agg(F.sum("n").alias("n_links"))
    out = written(rows.select("__row", "vec_id").join(n, "__row", "left").join(of, rows["__row"] == of["id"], "left").select("__row", "vec_id", "n_links", F.coalesce("component", "__row").alias("__part")), "vector-rows")
    least = out.groupBy("__part").agg(F.min("vec_id").alias("component_id"))
    a, b = audits.first()
    recall = F.lit(float(a / b) if b else None).cast("double")
    return out.join(least, "__part").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), recall.alias("audited_recall"), F.lit(int(b or 0)).cast("long").alias("audited_links"))


def _spans(key: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True))


# ---- top-k ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TopSettings:
    k: int = 20
    scale: int = 64
    shard_rows: int = 8192
    query_block: int = 4096
    leaf: int = 64


class BallTree:
    """Nodes in breadth-first order: centre, radius, children; leaves hold runs of the permuted points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.left = [0], [len(points)], [-1]
        centres, radii, i = [], [], 0
        while i < len(self.lo):
            lo, hi = self.lo[i], self.hi[i]
            p = points[self.order[lo:hi]]
            c = p.mean(0)
            d = ((p - c) ** 2).sum(1)
            centres.append(c)
            radii.append(np.sqrt(d.max()))
            if hi - lo > leaf and radii[-1] > 0:
                far = p[d.argmax()]
                other = p[((p - far) ** 2).sum(1).argmax()]
                side = np.argsort(p @ (far - other), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][side]
                mid = (lo + hi) // 2
                self.left[i] = len(self.lo)
                self.lo += [lo, mid]
                self.hi += [mid, hi]
                self.left += [-1, -1]
            i += 1
        self.centres, self.radii, self.left = np.array(centres), np.array(radii), np.array(self.left)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.lengths = np.sqrt((self.centres**2).sum(1))

    def above(self, q: np.ndarray, norm: np.ndarray, node: np.ndarray) -> np.ndarray:
        """No point of node has a larger inner product with q, whose length is norm: q.c + |q| r, and what rounding may take."""
        slack = 4e-16 * (q.shape[1] + 8) * norm * (self.lengths[node] + self.radii[node]) + 1e-6
        return np.einsum("ij,ij->i", q, self.centres[node]) + norm * self.radii[node] + slack


def top_scores(ids, rows, points, q_rows, q, beat, s: TopSettings):
    """For each query, (query's place, id, score) of its best s.k points among those that score beat or more.

    Branch and bound: of its open nodes each query takes the one of the largest bound, opens its children or reads its points,
    and is done when no open node's bound reaches its kth score so far. All queries take their steps side by side.
    Exact: points and queries are whole numbers, and the caller sees to it that sums stay below 2**53. Bounds are rounded up.
    """
    tree = BallTree(points, s.leaf)
    norm = np.sqrt((q * q).sum(1))
    best_s = np.full((len(q), s.k), -np.inf)
    best_i = np.full((len(q), s.k), np.iinfo(np.int64).max)
    kth = beat.copy()
    waiting = np.full((len(q), len(tree.left)), -np.inf)  # bounds of each query's open nodes
    going = np.arange(len(q))
    waiting[:, 0] = tree.above(q, norm, np.zeros(len(q), np.int64))
    while len(going):
        a, leaves = going, []
        while len(a):  # until each query that goes on is at a leaf
            node = waiting[a].argmax(1)
            b = waiting[a, node]
            on = (b > -np.inf) & (b >= kth[a])
            a, node, b = a[on], node[on], b[on]
            waiting[a, node] = -np.inf
            end = tree.left[node] < 0
            leaves.append((a[end], node[end]))
            a, node, b = a[~end], node[~end], b[~end]
            for child in (0, 1):
                n = tree.left[node] + child
                waiting[a, n] = np.minimum(tree.above(q[a], norm[a], n), b)
        a, node = (np.concatenate(x) for x in zip(*leaves, strict=True))
        going = a
        order = np.argsort(node, kind="stable")
        a, node = a[order], node[order]
        for lo, hi in _spans(node) if len(node) else []:
            who = a[lo:hi]
            inside = tree.order[tree.lo[node[lo]] : tree.hi[node[lo]]]
            score = q[who] @ points[inside].T
            score[q_rows[who][:, None] == rows[inside][None, :]] = -np.inf
            all_s = np.concatenate([best_s[who], score], 1)
            all_i = np.concatenate([best_i[who], np.broadcast_to(ids[inside], score.shape)], 1)
            pick = np.lexsort((all_i, -all_s), axis=1)[:, : s.k]
            best_s[who] = np.take_along_axis(all_s, pick, 1)
            best_i[who] = np.take_along_axis(all_i, pick, 1)
            kth[who] = np.maximum(kth[who], best_s[who, -1])
    who, place = np.nonzero((best_s > -np.inf) & (best_s >= beat[:, None]))
    return who, best_i[who, place], best_s[who, place]


def _exact(points, q) -> bool:
    return float(np.abs(points).max(initial=0)) * float(np.abs(q).max(initial=0)) * points.shape[1] < 2.0**52


def _plain(ids, rows, points, q_rows, q, beat, s: TopSettings):
    """The same for numbers too large for doubles: in whole numbers, query by query. Scores stop at the ends of a long."""
    big = [[int(x) for x in p] for p in points]
    who, out_i, out_s = [], [], []
    for k in range(len(q)):
        mine = [int(x) for x in q[k]]
        scores = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(mine, p, strict=True)))), int(i)) for p, i, r in zip(big, ids, rows, strict=True) if r != q_rows[k]]
        for v, i in sorted(scores)[: s.k]:
            who.append(k), out_i.append(i), out_s.append(-v)
    return np.array(who, np.int64), np.array(out_i, np.int64), np.array(out_s, np.int64)


def top_k(embeddings: DataFrame, is_query: Column, s: TopSettings = TopSettings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's s.k best other rows; is_query is a condition on embeddings' columns.

    Rows with a null vec_id or a vector that is null or holds a null or a number that is not finite take no part; rows that share
    a vec_id are rows of their own."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    v = F.col("embedding")
    rows = embeddings.select(F.monotonically_increasing_id().alias("__row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("__q"), v).where(finite(v) & F.col("vec_id").isNotNull())
    rows = written(rows.withColumn("__dim", F.size("embedding")), "top-vectors")
    counts = written(rows.groupBy("__dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("__q").alias("nq")), "top-counts")
    counts = counts.select("__dim", F.ceil(F.col("n") / s.shard_rows).cast("int").alias("__shards"), F.greatest(F.ceil(F.col("nq") / s.query_block), F.lit(1)).cast("int").alias("__blocks"))
    tasks = counts.agg(F.sum(F.col("__shards") * F.col("__blocks"))).first()[0] or 1
    dealt = rows.join(counts, "__dim").select(
        "*", F.pmod(F.xxhash64("__row"), "__shards").cast("int").alias("__shard"), F.pmod(F.xxhash64(F.lit(1), "__row"), "__blocks").cast("int").alias("__block"))
    points = dealt.select("__dim", "__shard", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"), F.lit(0).alias("__role"), "__row", "vec_id", F.lit(0.0).alias("__beat"), "embedding")
    asked = dealt.where("__q").select("__dim", "__shards", "__shard", "__block", F.lit(1).alias("__role"), "__row", "vec_id", F.lit(float("-inf")).alias("__beat"), "embedding")
    parts = max(read_partitions(spark), min(2 * int(tasks), 20_000))

    def run(batches):
        for t in whole_groups(batches):
            for a, b in _spans(t.column(0).to_numpy()):
                part = t.slice(a, b - a)
                role, row, ids, beat = (part.column(i).to_numpy() for i in (1, 2, 3, 4))
                m = np.floor(s.scale * matrix(part.column(5)))
                q = role == 1
                if not q.any() or q.all():
                    continue
                f = top_scores if _exact(m[~q], m[q]) else _plain
                who, near, score = f(ids[~q], row[~q], m[~q], row[q], m[q], beat[q], s)
                yield pa.RecordBatch.from_arrays([pa.array(row[q][who]), pa.array(ids[q][who]), pa.array(near), pa.array(score.astype(np.int64))], names=["__row", "query_id", "vec_id", "score"])

    def answered(queries: DataFrame) -> DataFrame:
        sent = points.unionByName(queries).select(F.xxhash64("__dim", "__shard", "__block").alias("__task"), "__role", "__row", "vec_id", "__beat", "embedding")
        found = sent.repartition(parts, "__task").sortWithinPartitions("__task", "__role").mapInArrow(run, "__row long, query_id long, vec_id long, score long")
        return written(found, "top-found")

    home = answered(asked.drop("__shards"))
    kth = home.groupBy("__row").agg(F.when(F.count(F.lit(1)) >= s.k, F.min("score")).cast("double").alias("__kth"))
    away = asked.where("__shards > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("__shards") - 1)).alias("__to")).where("__to <> __shard")
    away = away.join(kth, "__row", "left").select("__dim", F.col("__to").alias("__shard"), "__block", "__role", "__row", "vec_id", F.coalesce("__kth", "__beat").alias("__beat"), "embedding")
    both = home.union(answered(away))
    rank = F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings),
p AS (SELECT rid, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c AS (SELECT rid, vec_id, list(floor(64 * x::DOUBLE) ORDER BY i) AS q FROM p GROUP BY rid, vec_id),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM c a JOIN c b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
