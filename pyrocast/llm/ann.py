"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample (by the hash of the id): each node splits its part of the sample
by the hyperplane between two of its vectors. Every row is then put into one leaf of each tree. A
query keeps one priority queue over the nodes of all trees, ordered by the squared margins that the
way crosses, and opens leaves until enough of the sample lies in them; how much is enough is measured
on other rows held out of the sample, whose neighbours are known, so that tables whose vectors lie in
clusters open few leaves. Leaves and opened leaves are joined, some leaves a group, and exact distances on the original
vectors rank what is found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


class Tree:
    """Inner nodes as arrays: normal, offset, children (a leaf is -1 - its number); size: sample rows of each leaf."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int):
        random = np.random.default_rng(seed)
        normals, offsets, children, self.sizes = [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) <= leaf_rows or depth > 40:
                self.sizes.append(len(rows))
                return -len(self.sizes)
            a, b = sample[random.choice(rows, 2, replace=False)]
            normal = a - b
            if (norm := np.linalg.norm(normal)) == 0:
                normal, norm = random.standard_normal(sample.shape[1]), 1.0
            normal = normal / norm
            side = sample[rows] @ normal
            # the middle of the two, or the median where that leaves one side nearly empty
            offset = float((a + b) @ normal / 2)
            left = side < offset
            if not 0.1 < left.mean() < 0.9:
                offset = float(np.median(side))
                left = side < offset
            if not 0 < left.sum() < len(rows):  # equal vectors can't be split
                self.sizes.append(len(rows))
                return -len(self.sizes)
            at = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append(None)
            children[at] = (grow(rows[left], depth + 1), grow(rows[~left], depth + 1))
            return at

        self.root = grow(np.arange(len(sample)), 0)
        self.normals, self.offsets = np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets)
        self.children = np.array(children, np.int64).reshape(-1, 2)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.full(len(vectors), self.root, np.int64)
        work = [(self.root, np.arange(len(vectors)))] if self.root >= 0 else []
        while work:
            node, rows = work.pop()
            right = vectors[rows] @ self.normals[node] >= self.offsets[node]
            for child, part in zip(self.children[node].tolist(), (rows[~right], rows[right]), strict=True):
                out[part] = child
                if child >= 0 and len(part):
                    work.append((child, part))
        return -1 - out


def opened(forest: list[Tree], vector: np.ndarray):
    """(tree, leaf) of all leaves in the order of one queue over all trees."""
    margins = [t.normals @ vector - t.offsets for t in forest]
    queue = [(0.0, i, t.root) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            yield i, -1 - node
            continue
        margin = float(margins[i][node])
        left, right = forest[i].children[node].tolist()
        heapq.heappush(queue, (far + max(0.0, margin) ** 2, i, left))
        heapq.heappush(queue, (far + max(0.0, -margin) ** 2, i, right))


def search(forest: list[Tree], vector: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves to open, until they hold `enough` sample rows."""
    out, held = [], 0
    for tree, leaf in opened(forest, vector):
        out.append((tree, leaf))
        held += max(1, forest[tree].sizes[leaf])
        if held >= enough:
            break
    return out


def enough_for(forest: list[Tree], held_out: np.ndarray, k: int, recall: float, asked: int = 64) -> int:
    """Sample rows that a search must hold to find this share of the k nearest held-out rows of some held-out rows.

    Rows that trees are grown on lie in their leaves better than others do, so neither those that ask
    nor those that are found are such. With fewer than k others to find, all leaves are opened.
    """
    every = sum(sum(t.sizes) for t in forest)
    if len(held_out) <= k:
        return every
    leaf_of = [t.leaves(held_out) for t in forest]
    needs = []
    for i in np.linspace(0, len(held_out) - 1, min(asked, len(held_out))).astype(int).tolist():
        far = ((held_out - held_out[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[:k].tolist()
        wanted: dict[tuple[int, int], list[int]] = {}
        for tree, leaves in enumerate(leaf_of):
            for n in near:
                wanted.setdefault((tree, int(leaves[n])), []).append(n)
        left, held = set(near), 0
        for tree, leaf in opened(forest, held_out[i]):
            held += max(1, forest[tree].sizes[leaf])
            for n in left.intersection(wanted.get((tree, leaf), ())):
                needs.append(held)
                left.discard(n)
            if not left:
                break
    return int(np.quantile(needs, recall, method="higher"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part: not null, not zero, all components finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


#: Rows, and queries, that are held against each other at a time (larger groups of leaves are split), and rows in a group on average.
_LEAF_PART, _QUERY_PART, _GROUP_ROWS = 8192, 4096, 4096
#: Bytes of the sample, with what is held out of it.
_SAMPLE_BYTES = 256 << 20
#: Rows of which the driver knows the neighbours, to measure how many leaves a search must open.
_HELD_OUT = 20_000


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest different ids."""
    order = np.lexsort((ids, scores, queries))
    order = order[np.sort(np.unique(np.stack([queries[order], ids[order]]), axis=1, return_index=True)[1])] if len(order) else order
    starts = np.flatnonzero(np.diff(queries[order], prepend=np.iinfo(np.int64).min)) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _ranked(k: int, width: int):
    """For the rows and the queries of some leaves: each query's k nearest rows."""

    def flat(table: pa.Table):
        return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))]
        if rows.num_rows and asked.num_rows:
            leaves, ids = rows.column("leaf").to_numpy(), rows.column("vec_id").to_numpy()
            order = np.lexsort((ids, leaves))
            leaves, ids, v = leaves[order], ids[order], flat(rows)[order]
            q, query_of = flat(asked), asked.column("query_id").to_numpy()
            lists = asked.column("leaves").combine_chunks()
            open_leaves, who_asks = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            order = np.argsort(open_leaves, kind="stable")
            open_leaves, who_asks = open_leaves[order], who_asks[order]
            for leaf in np.unique(open_leaves).tolist():
                a, b = np.searchsorted(leaves, [leaf, leaf + 1])
                if a == b:
                    continue
                first, last = np.searchsorted(open_leaves, [leaf, leaf + 1])
                step, distinct = max(1, (1 << 20) // ((b - a) * width)), bool((ids[a + 1 : b] != ids[a : b - 1]).all())
                for c in range(first, last, step):
                    mine = who_asks[c : min(c + step, last)]
                    with np.errstate(over="ignore"):
                        score = np.sqrt(((q[mine][:, None, :] - v[None, a:b]) ** 2).sum(2))
                    score[query_of[mine][:, None] == ids[None, a:b]] = np.nan
                    # rows stand in order of ids, so a stable sort leaves ties to the smaller; NaN comes last
                    best = np.argsort(score, axis=1, kind="stable")[:, : k if distinct else b - a]
                    who, what, far = np.repeat(query_of[mine], best.shape[1]), ids[a:b][best.ravel()], np.take_along_axis(score, best, 1).ravel()
                    other = ~np.isnan(far)
                    found.append((who[other], what[other], far[other]))
        who, what, far = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(who, what, far, k)
        return pa.table({"query_id": who[best], "vec_id": what[best], "score": far[best]})

    return run


def _sampled(rows: DataFrame, most: int, total: int, seed: int) -> list[list[float]]:
    """About `most` vectors: all whose id's hash is below a threshold, in order of that hash; of rows with one id the least vector."""
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40))
    cut = min(1 << 40, (1 << 40) * most // max(total, 1) + 1)
    taken = rows.withColumn("h", hashed).filter(F.col("h") < cut).groupBy("vec_id", "h").agg(F.min("v").alias("v"))
    found = taken.toPandas().sort_values(["h", "vec_id"])
    return found["v"].tolist()


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 8, sample_rows: int | None = None, leaf_rows: int = 16, enough: int | None = None, recall: float = 0.96, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest found.

    score: Euclidean distance in double precision; ties go to the smaller id. A query opens leaves
    until they hold `enough` rows of the sample, over all trees; by default as many as find the share
    `recall` of the neighbours of held-out rows (see enough_for). The driver holds the sample, sample_rows:
    by default a hundredth of the table, from 20,000 to 200,000, and 20,000 held-out rows, both within _SAMPLE_BYTES; of a small
    table half is sample, half held out. Vectors null, zero, or with null or
    non-finite components take no part, nor do those of another length than most of the sample.
    Distances too large for a double are infinite, and come last.
    Rows that repeat an id count once, with their smallest distance. Without usable vectors the
    result is empty.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    # what the driver holds is bounded by bytes too
    most = max(1000, _SAMPLE_BYTES // (8 * widest))
    held_rows = min(_HELD_OUT, most // 4)
    sample_rows = min(sample_rows or min(200_000, max(20_000, total // 100)), most - held_rows)
    sample = _sampled(rows, sample_rows + held_rows, total, seed)
    width = int(np.bincount([len(x) for x in sample]).argmax())
    taken = np.array([x for x in sample if len(x) == width], np.float64)
    cut = max(len(taken) - held_rows, -(-len(taken) // 2))
    taken, held_out = taken[:cut], taken[cut:]
    with np.errstate(over="ignore", invalid="ignore"):
        grown = [Tree(taken, leaf_rows, seed + i) for i in range(trees)]
        # as dense as they are against the table, the rows held out have this many of the k nearest
        enough = enough or enough_for(grown, held_out, max(1, round(k * len(held_out) / total)), recall)
    forest = spark.sparkContext.broadcast((grown, enough))
    rows = rows.filter(F.size("v") == width)

    # a tree's leaves are numbered from left to right, so leaves near one another have near numbers; some of them are a group
    starts = np.cumsum([0, *[len(t.sizes) for t in grown]])
    some = max(1, int(_GROUP_ROWS * starts[-1] // (total * trees)))
    floats = dict(vectors.dtypes)[vector_col] == "array<float>"

    def place(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                leaves = np.column_stack([t.leaves(v) + a for t, a in zip(forest.value[0], starts[:-1], strict=True)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(leaves), pa.list_(pa.int32()))], ["vec_id", "v", "leaves"])

    def ask(batches):
        """A row for each query and group in which it opens leaves."""
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, width)
            at, groups, leaves = [], [], []
            for i, x in enumerate(v):
                with np.errstate(over="ignore", invalid="ignore"):
                    opens = np.sort([starts[tree] + leaf for tree, leaf in search(forest.value[0], x, forest.value[1])]).astype(np.int32)
                cuts = np.flatnonzero(np.diff(opens // some)) + 1
                parts = np.split(opens, cuts)
                at += [i] * len(parts)
                groups += [int(p[0]) // some for p in parts]
                leaves += parts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(groups, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "v", "some", "leaves"])

    shape = "array<float>" if floats else "array<double>"
    index = rows.mapInArrow(place, "vec_id long, v array<double>, leaves array<int>").select("vec_id", F.col("v").cast(shape).alias("v"), F.explode("leaves").alias("leaf"))
    index = saved(index.withColumn("some", F.floor(F.col("leaf") / some).cast("int")), "index")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(ask, "query_id long, v array<double>, some int, leaves array<int>")
    asked = saved(asked, "asked")
    # large groups are split, by rows and by queries; there are no more groups than the forest has leaves
    split = lambda df, name, most: df.groupBy("some").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    parts = split(index, "parts", _LEAF_PART).join(split(asked, "turns", _QUERY_PART), "some")
    parts = F.broadcast(saved(parts, "parts").filter("parts > 1 OR turns > 1"))
    one = F.lit(1)
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, one) - 1))
    mine = lambda c, i: F.pmod(F.xxhash64(i), F.coalesce(c, one)).cast("int")
    index = index.join(parts, "some", "left").withColumn("part", mine("parts", "vec_id")).withColumn("turn", every_one("turns")).drop("parts", "turns")
    asked = asked.join(parts, "some", "left").withColumn("turn", mine("turns", "query_id")).withColumn("part", every_one("parts")).drop("parts", "turns")
    keys = ["some", "part", "turn"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_ranked(k, width), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
