"""Embedding near-dedup on robust-pruned flat graphs.

Vectors are scaled to unit length; equal vectors of one label are one node.  Nodes of a label (and dimension) go to
the shard of their nearest centroid and to every shard whose vectors can lie within the distance of a link (a bound on
the halfway plane between two centroids), so that linked nodes always share a shard.  Each shard builds a
flat graph: nearest nodes and random ones as candidates, robust pruning (a candidate goes when ``ALPHA`` times
its distance to a kept neighbour is at most its distance to the node).  The adjacency lists of all shards are
united, with their reverse edges, and each shard gets the united lists of its nodes.  There a greedy search runs for
each node from the shard's medoid and from the node's own place in the graph; when its beam stands still, the search
range is expanded over every node within ``SLACK`` of the threshold until no new one is met.  Pairs found
are verified by cosine in double precision.  ``audit_recall`` compares a sample of nodes with brute force.

A shard of more than ``SHARD_LIMIT`` nodes (a dense region) is not cut but compared whole, as blocks of rows by columns
of at most about ``BLOCK_ROWS`` nodes a side, a task each.  Centroids only save work: they are fitted on a bounded
sample, and a label stays whole if its nodes would go to more than ``MAX_COPIES`` shards on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table
from .components import connected_components
from .words import mix

SHARD, SHARD_LIMIT, BLOCK_ROWS, MAX_COPIES, FIT_ROWS = 1000, 4000, 2500, 4, 20_000
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 48, 1.2
BEAM, SLACK, BLOCK = 24, 0.04, 1024


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, unit bytes, hash) of the usable vectors."""
    for batch in batches:
        out = []
        for vec_id, label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if vec_id is None or label is None or not raw.is_valid:
                continue
            if raw.values.null_count or not len(raw.values):
                continue
            x = raw.values.to_numpy().astype(np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top  # so that squares neither overflow nor vanish
            out.append((vec_id, label, len(x), (x / np.sqrt(x @ x)).tobytes()))
        if out:
            ids, labels, dims, units = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()),
                                              pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                                             ["vec_id", "label", "dim", "unit"])


def _matrix(units) -> np.ndarray:
    rows = [np.frombuffer(u, np.float64) for u in units]
    return np.stack(rows) if rows else np.zeros((0, 1))


def _places(x: np.ndarray, centroids: np.ndarray, least: float) -> np.ndarray:
    """(n, k): whether a vector whose nearest centroid is the k-th can have a cosine of ``least`` with the row.

    If u is nearest to c and v to h, then v (h - c) <= (v - u)(h - c) <= |v - u| |h - c|, and a link is no longer
    than the root of 2 - 2 least."""
    near = x @ centroids.T
    home = near.argmax(1)
    square = (centroids ** 2).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * centroids @ centroids.T, 0))
    between = np.sqrt(max(2 - 2 * least, 0)) * apart
    return near[np.arange(len(x)), home][:, None] - near <= between[home] + 1e-6


def fit_centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters keep their centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.sqrt((sums ** 2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def _prune(x: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of candidate lists (-1: none) for all nodes of a block of rows at once."""
    n, width = candidates.shape
    kept = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    own = candidates[:, :1] * 0 + rows[:, None]
    for lo in range(0, n, 512):
        part = slice(lo, min(n, lo + 512))
        cand = candidates[part]
        vec = x[np.maximum(cand, 0)]
        dist = 1 - np.einsum("ncd,nd->nc", vec, x[rows[part]])
        dist[(cand < 0) | (cand == own[part])] = np.inf
        local = np.arange(len(cand))
        for d in range(degree):
            best = dist.argmin(1)
            ok = np.isfinite(dist[local, best])
            if not ok.any():
                break
            kept[part, d] = np.where(ok, cand[local, best], -1)
            between = 1 - np.einsum("ncd,nd->nc", vec, vec[local, best])
            with np.errstate(invalid="ignore"):
                covered = ALPHA * between <= dist
            covered[local, best] = True
            dist[covered & ok[:, None]] = np.inf
    return kept


def build_graph(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (n, DEGREE) of a robust-pruned flat graph over unit vectors; -1 fills short lists."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = np.empty((n, min(NEAREST, n)), np.int64)
    for lo in range(0, n, BLOCK):
        sim = x[lo:lo + BLOCK] @ x.T
        k = near.shape[1]
        near[lo:lo + BLOCK] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    far = rng.integers(0, n, (n, min(RANDOM, n)))
    return _prune(x, np.concatenate([near, far], 1), DEGREE)


class Adjacency:
    """Undirected neighbour lists: a node's own kept edges and those that others kept to it."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        code = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.nodes = code % n
        self.starts = np.searchsorted(code, np.arange(n + 1) * n)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``nodes``, neighbour) for all neighbours."""
        size = self.starts[nodes + 1] - self.starts[nodes]
        line = np.repeat(np.arange(len(nodes)), size)
        skip = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        return line, self.nodes[self.starts[nodes][line] + skip]


def range_search(exact: np.ndarray, x: np.ndarray, graph: Adjacency, start: int, queries: np.ndarray,
                 least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with cosine >= least found by greedy search and range expansion.

    ``x`` guides the search in single precision; what it finds is verified on ``exact``."""
    n, q = len(x), len(queries)
    target = x[queries]
    seen = np.zeros((q, n), bool)
    beam = np.full((q, BEAM), -1, np.int64)
    score = np.full((q, BEAM), -np.inf)
    done = np.zeros((q, BEAM), bool)
    live = np.arange(q)
    beam[:, 0], beam[:, 1], seen[:, start] = start, queries, True
    beam[queries == start, 1] = -1
    seen[live, queries] = True
    score[:, 0] = target @ x[start]
    score[:, 1] = np.where(beam[:, 1] >= 0, (target * target).sum(1), -np.inf)
    hits = [(live, queries)]
    close = (score[:, 0] >= least - SLACK) & (queries != start)
    hits.append((live[close], np.full(int(close.sum()), start)))
    while len(live):
        open_ = np.where(done[live] | (beam[live] < 0), -np.inf, score[live])
        best = open_.argmax(1)
        going = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        line, node = graph.of(beam[live, best])
        row = live[line]
        new = ~seen[row, node]
        row, node = row[new], node[new]
        code = np.unique(row * n + node)
        row, node = code // n, code % n
        seen[row, node] = True
        sim = np.einsum("nd,nd->n", x[node], target[row])
        close = sim >= least - SLACK
        hits.append((row[close], node[close]))
        # merge into the beams: the best BEAM of old and new
        first = np.searchsorted(row, live)
        count = np.searchsorted(row, live, "right") - first
        width = int(count.max()) if len(count) else 0
        if width:
            slot = np.arange(len(row)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(live)), count)
            more = np.full((len(live), width), -1, np.int64)
            value = np.full((len(live), width), -np.inf)
            more[line, slot], value[line, slot] = node, sim
            ids = np.concatenate([beam[live], more], 1)
            values = np.concatenate([score[live], value], 1)
            marks = np.concatenate([done[live], np.zeros_like(more, bool)], 1)
            top = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
            pick = np.arange(len(live))[:, None]
            beam[live], score[live], done[live] = ids[pick, top], values[pick, top], marks[pick, top]
    # range expansion: every node near the threshold shows its neighbours, until no new one is met
    row, node = (np.concatenate(h) for h in zip(*hits))
    found_row, found_node = [row], [node]
    while len(row):
        line, node = graph.of(node)
        code = np.unique(row[line] * n + node)
        row, node = code // n, code % n
        new = ~seen[row, node]
        row, node = row[new], node[new]
        seen[row, node] = True
        close = np.einsum("nd,nd->n", x[node], target[row]) >= least - SLACK
        row, node = row[close], node[close]
        found_row.append(row)
        found_node.append(node)
    row, node = np.concatenate(found_row), np.concatenate(found_node)
    near = (exact[node] * exact[queries[row]]).sum(1) >= least
    return row[near], node[near]


def _assign(models, least: float):
    """Rows (space, id, unit): those of a space with centroids go to all shards where they can have a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, units = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows_of: dict[str, list[int]] = {}
            for i, space in enumerate(spaces):
                rows_of.setdefault(space, []).append(i)
            take, names = [], []
            for space, at in rows_of.items():
                centroids = models.value.get(space)
                if centroids is None:
                    take.append(np.array(at))
                    names += [space] * len(at)
                else:
                    row, shard = np.nonzero(_places(_matrix([units[i] for i in at]), centroids, least))
                    take.append(np.array(at)[row])
                    names += [f"{space}/{c}" for c in shard.tolist()]
            rows = batch.take(pa.array(np.concatenate(take) if take else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), rows.column(1), rows.column(2)],
                                             ["space", "id", "unit"])
    return run


def _model(x: np.ndarray, count: int, least: float) -> np.ndarray | None:
    """Centroids for a space of ``count`` vectors by its sample: those that leave the fewest pairs to compare, if any."""
    best, pairs = None, 0.9
    k = min(len(x), round(count / SHARD))
    while k > 1:
        centroids = fit_centroids(x, k)
        share = np.concatenate([_places(x[i:i + 4096], centroids, least) for i in range(0, len(x), 4096)]).mean(0)
        if share.sum() <= MAX_COPIES and (share ** 2).sum() < pairs:
            best, pairs = centroids, float((share ** 2).sum())
        k //= 4
    return best


def _shards(nodes: DataFrame, least: float) -> DataFrame:
    """(space, id, unit): the nodes in shards; linked nodes share one.  At most FIT_ROWS or so vectors reach the driver."""
    members = nodes.select(F.concat_ws("|", "label", "dim").alias("space"), "id", "unit")
    counts = {r.space: r["count"] for r in members.groupBy("space").count().where(F.col("count") > SHARD).collect()}
    if not counts:
        return members
    share = min(1.0, FIT_ROWS / sum(counts.values()))
    drawn: dict[str, list] = {}
    for r in (members.where(F.col("space").isin(list(counts)))
              .where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).select("space", "unit").collect()):
        drawn.setdefault(r.space, []).append(r.unit)
    models = {space: _model(_matrix(sorted(units)), counts[space], least) for space, units in drawn.items()}
    shared = members.sparkSession.sparkContext.broadcast({k: c for k, c in models.items() if c is not None})
    return members.mapInArrow(_assign(shared, least), "space string, id long, unit binary")


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(space, rows, columns, part, id, unit): every two of a shard's parts meet in one block."""
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = members.join(sizes, "space").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "space", F.least("part", "other").alias("rows"), F.greatest("part", "other").alias("columns"), "part", "id", "unit")


def _compare(least: float):
    def run(key, rows):
        import pandas as pd

        one, two = rows[rows.part == key[1]], rows[rows.part == key[2]]
        a, x, b, y = one.id.to_numpy(), _matrix(one.unit), two.id.to_numpy(), _matrix(two.unit)
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(a), BLOCK):
            if len(b):
                i, j = np.nonzero(x[lo:lo + BLOCK] @ y.T >= least)
                i, j = a[i + lo], b[j]
                keep = i < j if key[1] == key[2] else slice(None)
                found.append(np.stack([np.minimum(i, j)[keep], np.maximum(i, j)[keep]]))
        pairs = np.concatenate(found, 1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})
    return run


def _build(rows):
    import pandas as pd

    rows = rows.sort_values("id")
    ids, x = rows.id.to_numpy(), _matrix(rows.unit).astype(np.float32)
    graph = build_graph(x, len(x))
    source = np.repeat(ids, (graph >= 0).sum(1))
    return pd.DataFrame({"a": source, "b": ids[graph[graph >= 0]]})


def _search(least: float):
    def run(nodes, edges):
        import pandas as pd

        nodes = nodes.sort_values("id")
        ids, x = nodes.id.to_numpy(), _matrix(nodes.unit)
        n = len(ids)
        if n < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        # the united lists, restricted to the nodes of this shard
        a, b = np.searchsorted(ids, edges.a.to_numpy()), np.searchsorted(ids, edges.b.to_numpy())
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        inside = (ids[a] == edges.a.to_numpy()) & (ids[b] == edges.b.to_numpy())
        graph = Adjacency(n, a[inside], b[inside])
        single = x.astype(np.float32)
        middle = x.mean(0)
        start = int((x @ middle).argmax())
        out = []
        for lo in range(0, n, 256):
            queries = np.arange(lo, min(n, lo + 256))
            row, node = range_search(x, single, graph, start, queries, least)
            row = row + lo
            other = row != node
            out.append(np.unique(np.stack([np.minimum(row, node)[other], np.maximum(row, node)[other]], 1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})
    return run


def usable_nodes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit) of the vectors that can link."""
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                          F.col("embedding").cast("array<double>")).mapInArrow(
        _unit_rows, "vec_id long, label string, dim int, unit binary")


def embedding_links(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of ``nodes(id, label, dim, unit)`` with equal label and cosine >= least, as the search finds them."""
    every = keep_table(_shards(nodes, least), "members")
    sizes = keep_table(every.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_LIMIT), "sizes")
    members = keep_table(every.join(sizes, "space", "left_anti"), "shards")
    edges = keep_table(members.groupBy("space").applyInPandas(_build, "a long, b long").distinct(), "edges")
    united = keep_table(edges.join(members.select("space", F.col("id").alias("a")), "a").select("space", "a", "b"),
                        "graph")
    searched = (members.groupBy("space").cogroup(united.groupBy("space"))
                .applyInPandas(_search(least), "a long, b long"))
    compared = (_blocks(every, sizes).groupBy("space", "rows", "columns")
                .applyInPandas(_compare(least), "a long, b long"))
    return searched.unionByName(compared).distinct()


def embedding_components(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id, kept).

    ``vectors`` needs ``vec_id``, ``embedding``, ``label``.  Vectors link when their labels and dimensions are equal and
    their cosine is ``least`` or more.  A vector that is null, empty, zero or holds a null or non-finite component,
    and one with a null label or id, links with nothing (null id: component_id null, kept true).  Equal
    vectors are one node and all linked.  Rows that repeat a vec_id are one vector each for links, one id for
    components.  Other columns are not read; an empty table gives an empty result.
    """
    usable = keep_table(usable_nodes(vectors), "vectors")
    classes = keep_table(usable.groupBy("label", "dim", "unit")
                         .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    links = keep_table(embedding_links(classes, least), "links")
    copies = classes.select("id", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (both.join(copies.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("other"))
              .withColumnRenamed("a", "id"))
    member = usable.join(classes.select("label", "dim", "unit", "id", "copies"), ["label", "dim", "unit"])
    member = keep_table(member.select("vec_id", "id", "copies").join(linked, "id", "left").select(
        "vec_id", "id", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links")), "members")
    component = keep_table(connected_components(keep_table(links.unionByName(
        member.select(F.col("vec_id").alias("a"), F.col("id").alias("b"))), "links")), "component")
    by_id = (member.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
             .join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("own_id"))
    return (ids.join(by_id, ids["own_id"] == by_id["vec_id"], "left")
            .select(F.col("own_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "own_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))))


def audit_recall(vectors: DataFrame, least: float = 0.98, every: int = 20) -> tuple[int, int]:
    """(links found, links there are) of the nodes whose id is divisible by ``every``, against brute force.

    The queries meet all nodes block by block; nothing but the two counts comes back."""
    usable = usable_nodes(vectors)
    nodes = keep_table(usable.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("id")), "nodes")
    found = embedding_links(nodes, least)
    asked = nodes.where(F.pmod("id", F.lit(every)) == 0)

    def compare(left, right):
        import pandas as pd

        x, y = _matrix(left.unit), _matrix(right.unit)
        n = 0
        for lo in range(0, len(y), 4096):
            if len(x):
                sim = x @ y[lo:lo + 4096].T
                n += int(((sim >= least) & (left.id.to_numpy()[:, None] != right.id.to_numpy()[None, lo:lo + 4096])).sum())
        return pd.DataFrame({"n": [n]})

    blocks = 16
    there = (asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("label", "dim", "block")
             .cogroup(nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
                      .groupBy("label", "dim", "block")).applyInPandas(compare, "n long").agg(F.sum("n")).first()[0])
    hit = found.select(F.explode(F.array("a", "b")).alias("id")).where(F.pmod("id", F.lit(every)) == 0).count()
    return hit, there or 0
