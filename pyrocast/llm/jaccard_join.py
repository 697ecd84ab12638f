"""N-gram Jaccard join by a grouped prefix join, exact, for the components of its links.

Sets are distinct 5-word shingles as 64-bit hashes, in hash order. Texts with one set are one class.
Linked sets of at most M shingles have an overlap o of at least 0.8 M, and their l-th common token
stands among the first n - o + l of either. With l = 1 + M / 5 these are the first 0.4 n + 1 (the
prefix); documents with identical prefixes and sizes are one group, and a group with fewer than 1 + n / 5 prefix
tokens that other groups have too drops out. Of the groups that are left, few, longer prefixes are taken: with
l = 1 + M / 2 the first 0.7 n + 1, of which 1 + n / 2 must be tokens that others have too, so that texts
that share less than some 70 % of their words with others drop out, however many share them. Of the rest, tokens in
order of their frequency, the first (count - n / 2) must hold a common one of any linked pair. Groups joined by such tokens form clusters.
Their members meet block by block: each block against the cluster's first block, then whatever did not join the
cluster's largest component against all blocks of sizes that it may link with. Where blocks meet, pairs of
groups are filtered by size and by the tokens that their prefixes have in common; only the pairs that pass are
expanded to members, which are verified on whole sets. No list of pairs is ever written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_filter, filter_bits, giving_back, has, packed, saved, unpacked
from .components import connected_components

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Documents, and shingles, in a block of a cluster.
_BLOCK_DOCS, _BLOCK_TOKENS = 256, 1 << 20


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles; A-Z count as lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words), len(words))], np.uint64)
    hashes = np.array([h(w) for w in words], np.uint64)
    n = len(hashes) - width + 1
    out = hashes[:n] * _ODD[0]
    for i in range(1, width):
        out ^= out >> np.uint64(29)
        out += hashes[i : n + i] * _ODD[i % 5]
    out *= _ODD[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


#: Percent of a set that linked prefixes have in common at least: the more, the fewer groups pass and the longer the prefixes are. Of all groups, and of those that pass.
_FIRST, _COMMON = 20, 50


def common(n, share: int = _COMMON):
    """Tokens that a set of n shingles has in common with any linked one of no more, in both prefixes."""
    return 1 + share * n // 100


def prefix(n: int, percent: int, share: int = _COMMON) -> int:
    """Length of the prefix; for a partner of M >= n shingles, n - percent / 100 * M + common(M) is no longer."""
    return min(n, n - (percent - share) * n // 100 + 1)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The size of each pair's intersection."""
    n = len(sets)
    tokens, dims = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.flatnonzero(np.bincount(dims, minlength=len(tokens)) > 1)
    at = np.full(len(tokens), -1)
    at[often] = np.arange(len(often))
    dims = at[dims]
    row, dims = row[dims >= 0], dims[dims >= 0]
    overlap = np.zeros((n, n), np.float64)
    for a in range(0, len(often), 8192):
        part = (dims >= a) & (dims < a + 8192)
        has_token = np.zeros((n, min(8192, len(often) - a)), np.float32)
        has_token[row[part], dims[part] - a] = 1
        overlap += has_token @ has_token.T
    return overlap


def group_pairs(heads: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of groups may hold links, by their sizes and the common tokens of their prefixes; a group pairs with itself."""
    least, most = np.minimum(sizes[:, None], sizes[None]), np.maximum(sizes[:, None], sizes[None])
    return (100 * least >= percent * most) & (_overlaps(heads) >= common(most)) | np.eye(len(heads), dtype=bool)


def spanning_links(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links that join what is linked among these sets (what shares a known label is joined already)."""
    n = len(sets)
    heads = [s[: prefix(len(s), percent)] for s in sets]
    numbers: dict[tuple[int, bytes], int] = {}
    group = np.array([numbers.setdefault((len(s), h.tobytes()), len(numbers)) for s, h in zip(sets, heads, strict=True)])
    _, first_of = np.unique(group, return_index=True)
    pairs = group_pairs([heads[i] for i in first_of], np.array([len(sets[i]) for i in first_of], np.int64), percent)
    # members of groups that pair with another, or have other members
    able = np.flatnonzero((pairs.sum(axis=1) > 1)[group] | (np.bincount(group) > 1)[group])
    joined, out, first = _Union(n), [], {}
    for i, label in enumerate(known or []):
        joined.join(i, first.setdefault(label, i))
    if len(able) < 2:
        return out
    sizes = np.array([len(sets[i]) for i in able], np.int64)
    overlap = _overlaps([sets[i] for i in able])
    linked = np.triu(100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap), 1) & pairs[group[able]][:, group[able]]
    for i, j in zip(*np.nonzero(linked), strict=True):
        if joined.join(int(able[i]), int(able[j])):
            out.append((int(able[i]), int(able[j])))
    return out


_NODE = "struct<rep: bigint, fp: binary>"


def _verify(percent: int):
    node = pa.struct([("rep", pa.int64()), ("fp", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        labels = [(x["rep"], x["fp"]) for x in group.column("label").to_pylist()]
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        links = spanning_links(sets, percent, labels) if len(nodes) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], node), "b": pa.array([nodes[j] for _, j in links], node)})

    return run


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, n, fp, pkey (of n and prefix), prefix (array of long in hash order)."""

    def run(batches):
        for batch in batches:
            n, fp, keys, prefixes = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                head = s[: prefix(len(s), percent, _FIRST)]
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(xxhash.xxh3_128_digest(head.tobytes(), len(s)) if len(s) else None)
                prefixes.append(head.view(np.int64))
            values = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n", "fp", "pkey", "prefix"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(giving_back(run), "doc_id long, n long, fp binary, pkey binary, prefix array<long>")


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """fp, tokens of the texts whose ids are in wanted (rep), and some more: texts are shingled again where a filter of bounded size lets the id through."""
    context = docs.sparkSession.sparkContext
    bits = filter_bits(wanted.count())
    kept = context.broadcast(any_filter(wanted.select(F.xxhash64("rep").alias("h")), bits))

    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(has(kept.value, batch.column(0).to_numpy(zero_copy_only=False) & (bits - 1)))
            sets = [shingles(x, width).tobytes() for x in batch.column(1).take(pa.array(hit)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["fp", "tokens"])

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("text"))
    return texts.mapInArrow(giving_back(run), "fp binary, tokens binary")


def survivors(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, n of groups that have enough prefix tokens which others have too; sets: as sets_of; groups: gid.

    A filter of bounded size picks the rows of sets whose id is a gid. It lets a few others through:
    copies, which then count as groups of their own and change nothing.
    """
    spark = sets.sparkSession
    gid_bits = filter_bits(groups.count())
    gids = spark.sparkContext.broadcast(any_filter(groups.select(F.xxhash64("gid").alias("h")), gid_bits))

    def chosen(batch):
        """gid, n, and the tokens of their prefixes, a row for each token."""
        batch = batch.take(pa.array(np.flatnonzero(has(gids.value, batch.column(1).to_numpy() & (gid_bits - 1)))))
        many = batch.column(3).value_lengths().to_numpy()
        return np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(2).to_numpy(), many), batch.column(3).flatten().to_numpy()

    def tokens_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(chosen(batch)[2])], ["token"])

    heads = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "n", "prefix")
    shared = saved(heads.mapInArrow(giving_back(tokens_of), "token long").groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    bits = filter_bits(shared.count())
    kept = spark.sparkContext.broadcast(any_filter(shared.select("token"), bits))

    def suspects(batches):
        for batch in batches:
            ids, n, tokens = chosen(batch)
            hit = has(kept.value, tokens & (bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(tokens[hit])], ["gid", "n", "token"])

    tokens = heads.mapInArrow(giving_back(suspects), "gid long, n long, token long").join(shared.select("token"), "token", "left_semi")
    return tokens.groupBy("gid", "n").agg(F.count("*").alias("l")).filter(F.col("l") >= _least(_FIRST)).select("gid", "n")


def _least(share: int):
    return 1 + F.floor(F.col("n") * share / 100)


def clusters(left: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """gid, cluster for groups that may link to another; left: gid, n, fp of those that are left; whole: fp, tokens."""

    def tokens_of(batches):
        for batch in batches:
            heads = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            heads = [x[: prefix(len(x), percent)] for x in heads]
            many = [len(x) for x in heads]
            values = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(i).to_numpy(), many)) for i in (0, 1)] + [pa.array(values)], ["gid", "n", "token"])

    rows = left.join(whole, "fp").select("gid", "n", "tokens").mapInArrow(giving_back(tokens_of), "gid long, n long, token long")
    rows = saved(rows.groupBy("gid", "n", "token").agg(F.lit(1).alias("one")).drop("one"), "tokens")
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = rows.join(saved(shared, "shared"), "token").groupBy("gid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    mine = mine.withColumn("l", _least(_COMMON).cast("int")).filter("size(t) >= l")
    heads = saved(mine.select("gid", F.explode(F.expr("slice(t, 1, size(t) - l + 1)")).alias("t")).select("gid", "t.token"), "heads")
    # written, so that the join's own shuffles can be split where very many groups have a token
    hubs = saved(heads.groupBy("token").agg(F.min("gid").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("token", "hub"), "hubs")
    links = heads.join(hubs, "token").filter("gid <> hub").select(F.col("gid").alias("a"), F.col("hub").alias("b"))
    return connected_components(links).select(F.col("v").alias("gid"), F.col("component").alias("cluster"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id.

    Words are runs of other characters than [\\x20\\x09-\\x0D], A-Z in lower case; a set holds the
    distinct shingles of `width` words (of fewer words: all of them as one). Sets are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Texts
    without words (null, empty) are linked with nothing, and so are rows without an id (component
    null). Rows with one id are joined where their sets link; each row gets the component of its own
    set. Other columns are not read.
    """
    assert percent > _COMMON and width >= 2
    sets = saved(sets_of(docs, id_col, text_col, width, percent), "sets")
    real = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = saved(real.groupBy("fp", "pkey").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    groups = saved(classes.groupBy("pkey").agg(F.min("rep").alias("gid"), F.count("*").alias("texts")), "groups")
    left = survivors(sets, groups)
    left = saved(left.join(classes.select(F.col("rep").alias("gid"), "fp", F.col("n").alias("m")), "gid").filter("n = m").drop("m"), "left")
    found = clusters(left, _whole_sets(docs, left.select(F.col("gid").alias("rep")), id_col, text_col, width).groupBy("fp").agg(F.min("tokens").alias("tokens")), percent)
    # members of the groups in clusters, and of groups that hold different texts
    groups = groups.join(found, "gid", "left").filter("cluster IS NOT NULL OR texts > 1").select("pkey", F.coalesce("cluster", "gid").alias("cluster"))
    members = saved(classes.join(groups, "pkey").select("rep", "fp", "n", "cluster"), "members")
    size = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).filter("k > 1")
    size = size.select("cluster", _blocks("k", "tokens").alias("blocks"))
    placed = members.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("fp", F.lit(3)), "blocks").cast("int"))
    whole = _whole_sets(docs, members.select("rep"), id_col, text_col, width).groupBy("fp").agg(F.min("tokens").alias("tokens"))
    # a class is a node by its smallest id and its fingerprint, as rows with one id may be in several classes
    node = F.struct("rep", "fp")
    placed = saved(placed.join(whole, "fp").withColumn("node", node).withColumn("label", node), "placed")
    check, found = _verify(percent), f"a {_NODE}, b {_NODE}"
    cells = placed.withColumn("cell", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = saved(cells.select("cluster", "cell", "node", "label", "tokens").groupBy("cluster", "cell").applyInArrow(check, found), "verified")
    joined = connected_components(links)
    wide = placed.filter("blocks > 1").drop("label").join(joined.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("component", "node"))
    counts = wide.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all")).filter("top.k < all")
    main = saved(main.select("cluster", F.col("top.label").alias("main")), "main")
    if not main.isEmpty():
        links = links.unionByName(saved(_odd_cells(wide.join(main, "cluster"), percent).applyInArrow(check, found), "verified"))
        joined = connected_components(links)
    ids = classes.join(joined, F.struct("rep", "fp") == F.col("v"), "left").select("fp", F.coalesce("component.rep", "rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(ids, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _blocks(rows: str, tokens: str):
    return F.greatest(F.ceil(F.col(rows) / _BLOCK_DOCS), F.ceil(F.col(tokens) / _BLOCK_TOKENS)).cast("int")


def _odd_cells(rest: DataFrame, percent: int):
    """Members outside their cluster's largest component, and all members whose sizes allow a link, grouped by cells.

    Sizes fall into bands such that linked ones are in the same or in neighbouring bands. Each band of a
    cluster has its own blocks.
    """
    # a little wider than the ratio of linked sizes, so that no rounding counts
    band = F.floor(F.log("n") / (np.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.col("n").cast("int")
    rest = rest.withColumn("band", band).withColumn("odd", F.col("label") != F.col("main"))
    of_odd = [F.sum(F.when(F.col("odd"), x)).alias(a) for x, a in ((F.lit(1), "odd_k"), (F.col("n"), "odd_tokens"))]
    sizes = rest.groupBy("cluster", "band").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"), *of_odd)
    sizes = saved(sizes.select("cluster", "band", _blocks("k", "tokens").alias("of"), F.coalesce(_blocks("odd_k", "odd_tokens"), F.lit(0)).alias("odd_of")), "bands")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    rest = rest.join(sizes, ["cluster", "band"]).select("cluster", "band", "odd", "of", "odd_of", "node", "label", "tokens")
    mine, other = F.pmod(F.xxhash64("node.fp", F.lit(5)), F.greatest("odd_of", F.lit(1))).cast("int"), F.pmod(F.xxhash64("node.fp", F.lit(3)), "of").cast("int")
    fields = ["cluster", "a", "x", "b", "y", "node", "label", "tokens"]
    odd = rest.filter("odd").withColumn("x", mine).withColumn("b", near).join(sizes.select("cluster", F.col("band").alias("b"), F.col("of").alias("n_y")), ["cluster", "b"])
    odd = odd.withColumnRenamed("band", "a").withColumn("y", F.explode(F.expr("sequence(0, n_y - 1)"))).select(*fields)
    every = rest.withColumn("y", other).withColumn("a", near).join(sizes.filter("odd_of > 0").select("cluster", F.col("band").alias("a"), F.col("odd_of").alias("n_x")), ["cluster", "a"])
    every = every.withColumnRenamed("band", "b").withColumn("x", F.explode(F.expr("sequence(0, n_x - 1)"))).select(*fields)
    # a member that is in both roles of a cell counts once
    return odd.unionByName(every).dropDuplicates(["cluster", "a", "x", "b", "y", "node"]).groupBy("cluster", "a", "x", "b", "y")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns."""
    found = components(docs, id_col, text_col, width, percent)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return packed(docs).join(gone, F.col("__row").getField(id_col).cast("long") == F.col("__id"), "left_anti").select(*unpacked(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * o >= 80 * (na + nb - o)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.v = s.doc_id GROUP BY ALL
"""
