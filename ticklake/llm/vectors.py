"""Embedding near-duplicates by NN-descent.

A neighbour graph starts from random-hyperplane cells and is refined by joins of
neighbours of neighbours.  A component of list edges is compared whole in square tiles.  A
list is saturated when its last entry still links, so it may lack links to other components;
cells of saturated nodes are compared wherever their centres and radii leave room for a link.
A bounded sample is compared with every vector to audit recall by vector; below the target
the search goes on from new cells with longer lists, and at last all cells are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.llm.common import prepare, table
from ticklake.llm.graph import connected_components
from ticklake.llm.jaccard import tile_links, tiles

NEIGHBOURS, TREES, CELL, TILE = 10, 4, 400, 256
#: Rounds of refinement at most, and the share of changed lists below which it stops.
ROUNDS, SETTLED = 4, 0.01
#: Radians by which angles may be off.
SLACK = 1e-6
#: Vectors compared with all others in the audit, recall to reach, searches at most.
AUDIT, TARGET, SEARCHES = 1000, 0.97, 3
_LIST = "array<struct<s:double,v:long>>"


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _offers(ids: np.ndarray, s: np.ndarray, v: np.ndarray, k: int) -> pa.Table:
    """One list for each node of ``ids``: the ``k`` most similar of what it is offered, a
    node that several offer once.  Similarities are rounded, as sums in another order differ
    in their last digits; ties go to the smaller number."""
    s = np.round(s, 9)
    order = np.lexsort((-s, v, ids))
    ids, s, v = ids[order], s[order], v[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1])
    ids, s, v = ids[new], s[new], v[new]
    order = np.lexsort((v, -s, ids))
    ids, s, v = ids[order], s[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    counts = np.diff(np.concatenate([first, [len(ids)]]))
    best = np.arange(len(ids)) - np.repeat(first, counts) < k
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.minimum(counts, k))]).astype(np.int32), pa.StructArray.from_arrays([pa.array(s[best]), pa.array(v[best])], names=["s", "v"]))
    return pa.table({"nid": pa.array(ids[first], pa.int64()), "near": lists})


def _best(lists: DataFrame, k: int) -> DataFrame:
    """One list for each node: its k most similar entries."""
    flat = F.array_distinct(F.flatten(F.collect_list("near")))
    return lists.groupBy("nid").agg(F.slice(F.sort_array(flat, asc=False), 1, k).alias("near"))


def _start(nodes: DataFrame, n: int, k: int, seed: int, kind: str) -> DataFrame:
    """Lists from exact comparison inside cells cut by random hyperplanes; cells that
    hold too many (clusters) are dealt at random to several groups."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
            code = np.zeros((TREES, len(raw)), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _unit([raw[i] for i in at], kind)
                for t in range(TREES):
                    planes = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), depth))
                    code[t, at] = (x @ planes > 0) @ (1 << np.arange(depth, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in code.T], pa.list_(pa.int64()))], names=["nid", "dim", "cells"])

    celled = nodes.select("nid", "raw", "dim").mapInArrow(cells, "nid long, dim int, cells array<long>").select("nid", "dim", F.posexplode("cells").alias("tree", "cell"))
    celled = table(celled, "cells")
    # one row for each occupied cell: at most a few for each CELL vectors
    full = table(celled.groupBy("dim", "tree", "cell").agg(F.count("*").alias("m")), "full")
    dealt = celled.join(full, ["dim", "tree", "cell"]).join(nodes.select("nid", "raw"), "nid")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("nid", "tree"), F.ceil(F.col("m") / (2 * CELL))))

    def compare(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("nid").to_pylist(), np.int64)
        x = _unit(group.column("raw").to_pylist(), kind)
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        keep = min(k, len(ids) - 1)
        near = np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(ids), 0), int)
        return _offers(np.repeat(ids, keep), np.take_along_axis(sims, near, axis=1).ravel(), ids[near].ravel(), k)

    return dealt.groupBy("dim", "tree", "cell", "part").applyInArrow(compare, f"nid long, near {_LIST}")


def _refine(graph: DataFrame, nodes: DataFrame, n: int, k: int, kind: str) -> DataFrame:
    """Lists that neighbours of neighbours offer: the members of a list and of its
    reverse meet at its centre, and a member hears of the ``k`` best that beat its last entry.
    A node that very many list meets the others at about 8k of these centres."""
    out = graph.select(F.col("nid").alias("centre"), F.explode("near.v").alias("member"))
    back = out.select(F.col("member").alias("centre"), F.col("centre").alias("member"))
    fame = table(back.groupBy("centre").agg(F.count("*").alias("m")), "fame")
    # a well-known centre hears about 2k of those that list it, chosen by a hash
    draw = F.pmod(F.xxhash64("centre", "member"), F.lit(1 << 30)) * F.col("m")
    heard = back.join(fame, "centre").where(draw < 2 * k * (1 << 30)).select("centre", "member")
    shown = out.join(fame.withColumnRenamed("centre", "member"), "member").where(draw < 8 * k * (1 << 30)).select("centre", "member")
    met = shown.unionByName(heard).distinct()
    last = graph.select(F.col("nid").alias("member"), F.when(F.size("near") >= k, F.element_at("near.s", -1)).otherwise(F.lit(-2.0)).alias("last"))
    carried = nodes.select(F.col("nid").alias("member"), "raw", "dim").join(last, "member")
    groups = max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * 2 * k // 20_000)
    joined = met.join(carried, "member").withColumn("group", F.pmod(F.xxhash64("centre"), F.lit(groups)))

    def meet(group: pa.Table) -> pa.Table:
        centre = np.array(group.column("centre").to_pylist(), np.int64)
        order = np.argsort(centre, kind="stable")
        member = np.array(group.column("member").to_pylist(), np.int64)[order]
        raw, dims = group.column("raw").to_pylist(), np.array(group.column("dim").to_pylist())[order]
        raw = [raw[i] for i in order]
        last = np.array(group.column("last").to_pylist(), np.float64)[order]
        cuts = np.flatnonzero(np.diff(centre[order])) + 1
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            if b - a < 2 or len(set(dims[a:b])) > 1:
                continue
            x = _unit(raw[a:b], kind)
            sims = x @ x.T
            sims[member[a:b, None] == member[None, a:b]] = -2
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if b - a > k else np.tile(np.arange(b - a), (b - a, 1))
            s = np.take_along_axis(sims, best, axis=1)
            better = (s > last[a:b, None]) & (s > -2)
            found.append((np.repeat(member[a:b], better.sum(axis=1)), s[better], member[a:b][best][better]))
        return _offers(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    return joined.groupBy("group").applyInArrow(meet, f"nid long, near {_LIST}")


def _near_cells(cells: DataFrame, theta: float) -> DataFrame:
    """(a, b): cells of different components, a < b, that the angle between their centres
    and their radii leave room for a link of ``theta`` or less."""
    sizes = cells.groupBy("component").agg(F.count("*").alias("m"))
    dealt = tiles(cells, sizes, "cell", CELL)
    groups = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(group: pa.Table) -> pa.Table:
        names = ["component", "ti", "tj", "block", "cell", "head", "centre", "radius"]
        by: dict[tuple, list[tuple]] = {}
        for x in zip(*(group.column(c).to_pylist() for c in names), strict=True):
            by.setdefault(x[:3], []).append(x)
        out_a, out_b = [], []
        for (_, i, j), own in by.items():
            x = np.frombuffer(b"".join(m[6] for m in own), np.float64).reshape(len(own), -1)
            block, head, radius = (np.array([m[c] for m in own]) for c in (3, 5, 7))
            room = np.arccos(np.clip(x @ x.T, -1, 1)) <= theta + radius[:, None] + radius[None, :] + SLACK
            room &= (head[:, None] != head[None, :]) & ((block == i)[:, None] & (block == j)[None, :])
            for u, v in zip(*np.nonzero(room), strict=True):
                if i != j or u < v:
                    low, high = sorted((own[u][4], own[v][4]))
                    out_a.append(low)
                    out_b.append(high)
        return pa.table({"a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string())})

    return dealt.withColumn("group", F.pmod(F.xxhash64("component", "ti", "tj"), F.lit(groups))).groupBy("group").applyInArrow(compare, "a string, b string")


def _links(graph: DataFrame, nodes: DataFrame, threshold: float, kind: str, k: int, every: bool = False) -> DataFrame:
    """(nid, component, w): nodes that link; w counts linked vectors, copies included.

    The components of list edges are cut to cells of about TILE nodes.  All cells of a
    component are compared; a saturated list may also lack links to other components, so
    cells with saturated nodes are compared with each other wherever their centres and
    radii leave room for a link.  With ``every`` that holds for all nodes, linked or not,
    which is exact whatever the lists are."""
    edges = graph.select(F.col("nid").alias("a"), F.explode("near").alias("x")).where(F.col("x.s") >= threshold).select("a", F.col("x.v").alias("b"))
    found = connected_components(edges).withColumnRenamed("node", "nid")
    if every:
        found = nodes.select("nid").join(found, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    sizes = table(found.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "sizes")
    full = graph.where((F.size("near") >= k) & (F.element_at("near.s", -1) >= threshold)).select("nid", F.lit(True).alias("full"))
    name = lambda block: F.concat_ws("/", F.col("component").cast("string"), block.cast("string"))
    celled = found.join(sizes, "component").withColumn("cell", name(F.pmod(F.xxhash64("nid", F.lit(11)), F.col("blocks"))))
    celled = table(celled.join(full, "nid", "left").join(nodes.select("nid", "raw", "copies", "dim"), "nid").select("component", "cell", "nid", "raw", "copies", "dim", "full"), "celled")
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def centre(group: pa.Table) -> pa.Table:
        names = ["cell", "component", "dim", "raw"]
        by: dict[tuple, list[bytes]] = {}
        for *key, raw in zip(*(group.column(c).to_pylist() for c in names), strict=True):
            by.setdefault(tuple(key), []).append(raw)
        out = []
        for (cell, head, dim), raw in by.items():
            x = _unit(raw, kind)
            mean = x.sum(axis=0)
            mean = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else x[0]
            out.append((dim, cell, head, mean.tobytes(), float(np.arccos(np.clip(x @ mean, -1, 1)).max())))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["component", "cell", "head", "centre", "radius"])

    cells = (celled if every else celled.where("full")).withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(parts))).groupBy("group")
    cells = table(cells.applyInArrow(centre, "component long, cell string, head long, centre binary, radius double"), "cells")
    own = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    pairs = table(own.select(name(F.col("i")).alias("a"), name(F.col("j")).alias("b")).unionByName(_near_cells(cells, float(np.arccos(min(1.0, threshold))))), "pairs")
    carried = celled.select("cell", "nid", "copies", "raw")
    left = pairs.join(carried.withColumnRenamed("cell", "a"), "a").withColumn("right", F.lit(False))
    right = pairs.where("a <> b").join(carried.withColumnRenamed("cell", "b"), "b").withColumn("right", F.lit(True))
    dealt = table(left.unionByName(right), "tiles")
    groups = max(parts, dealt.count() // 4000 + 1)

    def compare(group: pa.Table) -> pa.Table:
        names = ["a", "b", "right", "nid", "copies", "raw"]
        by: dict[tuple, list[tuple]] = {}
        for x in zip(*(group.column(c).to_pylist() for c in names), strict=True):
            by.setdefault(x[:2], []).append(x)
        ids, heads, w = [], [], []
        for (i, j), own in by.items():
            x = _unit([m[5] for m in own], kind)
            side = np.array([m[2] for m in own])
            counts, joined = tile_links(x @ x.T >= threshold, np.flatnonzero(~side), np.flatnonzero(side), i == j, np.array([m[4] for m in own], np.int64))
            ids += [m[3] for m in own]
            heads += [None] * len(own)
            w += counts.tolist()
            for members in joined:
                head, *rest = sorted(own[u][3] for u in members)
                ids += rest
                heads += [head] * len(rest)
                w += [0] * len(rest)
        return pa.table({"nid": pa.array(ids, pa.int64()), "head": pa.array(heads, pa.int64()), "w": pa.array(w, pa.int64())})

    compared = dealt.withColumn("group", F.pmod(F.xxhash64("a", "b"), F.lit(groups))).groupBy("group").applyInArrow(compare, "nid long, head long, w long")
    compared = table(compared, "compared")
    linked = connected_components(compared.where("head is not null"), "nid", "head").withColumnRenamed("node", "nid")
    counts = compared.where("head is null").groupBy("nid").agg(F.sum("w").alias("w"))
    return table(linked.join(counts, "nid").select("nid", "component", "w"), "linked")


def audit(nodes: DataFrame, linked: DataFrame, n: int, threshold: float, kind: str, most: int = AUDIT) -> float:
    """Recall of about ``most`` sampled vectors: the share of a vector's links, as comparison
    with every vector finds them, that were found; the mean over vectors that have any, or
    over those with at most NEIGHBOURS links if that is lower.  The sample is bounded, so it
    is broadcast."""
    # 62 bits of a hash, so that the rate is right for any number of vectors
    rate = (1 << 62) if n <= most else (most << 62) // n
    asked = nodes.where(F.shiftrightunsigned(F.xxhash64("nid", F.lit(9)), 2) < F.lit(rate)).join(linked, "nid", "left").select("nid", "dim", "raw", F.coalesce("w", F.lit(0)).alias("w")).collect()
    if not asked:
        if n:
            raise RuntimeError("no vector was drawn for the audit")
        return 1.0
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r.dim for r in asked}:
        own = [r for r in asked if r.dim == d]
        by[d] = (np.array([r.nid for r in own]), _unit([bytes(r.raw) for r in own], kind))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in by.items()}
        for batch in batches:
            ids, raw, dims, copies = (np.array(batch.column(i).to_pylist(), object if i == 1 else np.int64) for i in range(4))
            for d in np.unique(dims):
                if int(d) in by:
                    at = np.flatnonzero(dims == d)
                    same = ids[at][:, None] == by[int(d)][0][None, :]
                    hit = (_unit(list(raw[at]), kind) @ by[int(d)][1].T >= threshold) & ~same
                    total[int(d)] += copies[at] @ hit
        found = [(i, m) for d, (ids, _) in by.items() for i, m in zip(ids.tolist(), total[d].tolist(), strict=True) if m]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["nid", "n"])

    true = nodes.select("nid", "raw", "dim", "copies").mapInArrow(ask, "nid long, n long").groupBy("nid").agg(F.sum("n").alias("n"))
    return vector_recall({r.nid: r.w for r in asked}, {r.nid: r.n for r in true.collect()})


def vector_recall(found: dict[int, int], true: dict[int, int]) -> float:
    """Mean share of links found by vector, or that of vectors with few links if lower."""
    shares = [(found.get(i, 0) / m, m <= NEIGHBOURS) for i, m in true.items() if m]
    few = [x for x, small in shares if small]
    return min((float(np.mean(x)) for x in ([x for x, _ in shares], few) if x), default=1.0)


def link_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row for each vector: vec_id, n_links (others with a cosine of ``threshold`` or
    more), component_id (smallest vec_id reachable by links), kept, audited_recall.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Equal vectors are compared once and
    counted each; rows that repeat a vec_id are separate vectors; neighbours of equal
    similarity come into a list by their number, and a list whose last entry still links is
    never trusted to hold all; other columns are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    prepare(spark)
    narrow = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, letter = ("<f4", "float") if narrow else ("<f8", "double")
    e = F.col("embedding").cast(f"array<{letter}>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("e") > 0) & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).withColumn("e", F.when(good, F.transform("e", lambda x: x + F.lit(0.0).cast(letter))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    given = table(given.mapInArrow(encode, "vec_id long, raw binary"), "vectors")
    width = 4 if narrow else 8
    nodes = given.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = table(nodes.select(F.monotonically_increasing_id().alias("nid"), "raw", "least", "copies", (F.length("raw") / width).cast("int").alias("dim")), "nodes")
    n, k = nodes.count(), NEIGHBOURS
    graph, linked, recall = None, None, 0.0
    for search in range(SEARCHES):
        lists = _start(nodes, n, k, search, kind)
        graph = table(_best(lists if graph is None else lists.unionByName(graph), k), "graph")
        for _ in range(ROUNDS):
            refined = table(_best(graph.unionByName(_refine(graph, nodes, n, k, kind)), k), "graph")
            changed = refined.join(graph.select("nid", F.col("near").alias("old")), "nid").where(F.size(F.array_except("near.v", "old.v")) > 0).count()
            graph = refined
            if changed <= SETTLED * n:
                break
        linked = _links(graph, nodes, threshold, kind, k)
        recall = audit(nodes, linked, n, threshold, kind)
        if recall >= TARGET:
            break
        k *= 2
    else:
        # the search did not reach the target: every node is compared by cells
        linked = _links(graph, nodes, threshold, kind, k, every=True)
        recall = audit(nodes, linked, n, threshold, kind)
        if recall < TARGET:
            raise RuntimeError(f"recall {recall:.3f} is below {TARGET}")
    members = table(nodes.select("nid", "raw", "least", "copies").join(linked, "nid", "left").withColumn("component", F.coalesce("component", "nid")), "members")
    heads = table(members.groupBy("component").agg(F.min("least").alias("component_id")), "heads")
    labels = table(members.join(heads, "component").select("raw", "component_id", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    whole = given.join(labels, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return whole.withColumns({"kept": F.col("vec_id") == F.col("component_id"), "audited_recall": F.lit(float(recall))})


def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` with its links and its component."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("audited_recall")
