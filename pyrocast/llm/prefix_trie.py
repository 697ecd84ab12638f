"""Prefix trie of conversations by prefix doubling.

Turns get dense names (equal turns, equal names). In each round, blocks of 2**k turns at places that are
multiples of 2**k are named from the names of their halves. A prefix of d turns is a row of such
blocks, one for each bit of d: it is named from the prefix without its last block and that block, so
all prefixes have names after as many rounds as their lengths have bits. Prefixes of one length and
name are one node. All steps are joins and sums over rows of single turns, so neither a very long
conversation nor a prefix that very many share is ever in one row or group; only the digest of a
node's ids, which is one sequence by nature, is made where its ids stream by.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, saved

#: Characters of ids that are hashed together.
_CHUNK = 1 << 18


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with name in place of the columns by: equal values, equal names; from 0 on without gaps."""
    kinds = saved(rows.select(*by).distinct().withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "kinds")
    # a task's numbers start at its own multiple of 2**33; a row for each task tells how many there are before it
    tasks = kinds.groupBy("__part").agg(F.count("*").alias("n"))
    tasks = tasks.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("start"))
    number = (F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("start")).alias("name")
    kinds = kinds.join(F.broadcast(tasks), "__part").select(*by, number)
    return rows.join(kinds, by).drop(*by)


def _first_turns(conv: Column, most: int = 9) -> Column:
    return F.pmod(F.crc32(F.encode(conv.cast("string"), "UTF-8")), F.lit(most))


def placed_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, place (from 0), turn name, bytes (of the text). Only digests of texts move."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), told.alias("told"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("told")]
    rows = running(rows, ["conv"], order, F.lit(1), "place").select("conv", (F.col("place") - 1).alias("place"), "told", "bytes")
    return saved(_named(rows, ["told"]), "turns")


def rebuilt(rows: DataFrame, groups: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations). turns: conv, place, name, bytes of the rebuilt conversations; conversations: conv, size.

    Conversation c gets the first h turns of conversation c - c % groups, then its own from the h-th
    on, where h = crc32(decimal c) % most.
    """
    own = rows.groupBy("conv").agg(F.count("*").alias("n"))
    heads = own.select(F.col("conv").alias("root"), F.col("n").alias("n_root"))
    convs = own.withColumns({"h": _first_turns(F.col("conv"), most), "root": F.col("conv") - F.col("conv") % groups})
    convs = convs.join(heads, "root", "left").withColumn("head", F.least("h", F.coalesce("n_root", F.lit(0))))
    convs = saved(convs.select("conv", "root", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    fields = ["conv", "place", "name", "bytes"]
    rest = rows.join(convs.select("conv", "h", "head"), "conv").filter("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("head")).select(*fields)
    first = rows.filter((F.col("place") < most - 1) & (F.col("conv") % groups == 0)).select(F.col("conv").alias("root"), "place", "name", "bytes")
    first = first.join(convs.select("conv", "root", "head"), "root").filter("place < head").select(*fields)
    return saved(rest.unionByName(first), "rebuilt"), convs.select("conv", "size")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv, depth (from 1), name: prefixes of one depth have one name if they are equal; turns: conv, place, name."""
    level = turns.select("conv", F.col("place").alias("at"), "name")
    # blocks at even places, the last ones of a prefix; ones: bits of the prefix before them
    lasts = lambda rows, k: rows.filter(F.col("at") % 2 == 0).select("conv", F.shiftleft("at", k).alias("before"), F.shiftleft(F.col("at") + 1, k).alias("depth"), F.bit_count("at").alias("ones"), "name")
    blocks, k = lasts(level, 0), 0
    while longest >> (k + 1):
        k += 1
        half = F.col("at") % 2 == 0
        pairs = level.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(half, F.col("name"))).alias("a"), F.max(F.when(~half, F.col("name"))).alias("b"))
        level = saved(_named(pairs.filter("b IS NOT NULL"), ["a", "b"]), "blocks")
        blocks = blocks.unionByName(lasts(level, k))
    blocks = saved(blocks, "lasts")
    found = blocks.filter("ones = 0").select("conv", "depth", "name")
    every = [found]
    for ones in range(1, longest.bit_length()):
        last = blocks.filter(F.col("ones") == ones).select("conv", "before", "depth", F.col("name").alias("b"))
        known = found.select("conv", F.col("depth").alias("before"), F.col("name").alias("a"))
        found = saved(_prefix_names(last.join(known, ["conv", "before"])), "prefixes")
        every.append(found)
    out = every[0]
    for rows in every[1:]:
        out = out.unionByName(rows)
    return out


def _prefix_names(rows: DataFrame) -> DataFrame:
    """conv, depth, name from conv, depth, a, b."""
    return _named(rows.withColumn("d", F.col("depth")), ["d", "a", "b"]).select("conv", "depth", "name")


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from conv_id, depth, conv: SHA-256 of the decimal convs in ascending order, joined by commas."""

    def pack(batches):
        """Ids that follow one another in chunks."""
        key, held, size, chunks = None, [], 0, []
        for batch in batches:
            for node, depth, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (key != (node, depth) or size > _CHUNK):
                    chunks.append((*key, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                key = node, depth
                held.append(conv)
                size += 20
            yield rows(chunks, schema)
            chunks = []
        if held:
            yield rows([(*key, held[0], ",".join(map(str, held)))], schema)

    def digest(batches):
        key, sha, done = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if key == (node, depth):
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((*key, sha.hexdigest()))
                key, sha = (node, depth), hashlib.sha256(ids.encode())
            yield rows(done, told)
            done = []
        if sha:
            yield rows([(*key, sha.hexdigest())], told)

    def rows(values, schema):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in values], f.type) for i, f in enumerate(schema)], schema=schema)

    told = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    order = ["conv_id", "depth", "conv"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "conv_id long, depth long, first long, ids string")
    order = ["conv_id", "depth", "first"]
    return chunks.repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations; turns: conv, place, name, bytes; convs: conv, size.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    longest = convs.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"]
    rows = prefixes(turns, longest).unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name")))
    rows = saved(rows, "rows")
    nodes = saved(rows.groupBy("depth", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    # from here on a node is its smallest member and its depth
    members = saved(rows.join(nodes, ["depth", "name"]).select("conv", "depth", "conv_id"), "members")
    bytes_of = turns.select(F.col("conv").alias("conv_id"), (F.col("place") + 1).alias("depth"), "bytes")
    above = members.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.select("conv_id", "depth", "n_convs").join(bytes_of, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left")
    nodes = saved(nodes.withColumn("own", F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), F.lit(0))).drop("bytes"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "nodes")
    # a conversation is the smallest member of nodes from some depth down to its end: what these add to a
    # node above is their sum; the nodes themselves get the sums from their own depth down
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    down = running(nodes.select("conv_id", "depth", "own"), ["conv_id"], [F.col("depth").desc()], F.col("own"), "saved_tokens").select("conv_id", "depth", "saved_tokens")
    whole = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved_tokens"), F.sum(leaf).cast("long").alias("n_leaves"))
    other = members.filter("conv <> conv_id").join(whole.withColumnRenamed("conv_id", "conv"), "conv").groupBy("conv_id", "depth").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    mine = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children").join(whole.select("conv_id", "n_leaves"), "conv_id")
    ended = members.join(convs.select("conv", F.col("size").alias("depth")), ["conv", "depth"])
    parts = mine.unionByName(down, allowMissingColumns=True).unionByName(other, allowMissingColumns=True).unionByName(_digests(ended), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")]
    kept = [F.max(c).alias(c) for c in ("parent_conv_id", "n_convs", "n_children")]
    out = parts.groupBy("conv_id", "depth").agg(*kept, *sums, F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", groups: int = 5, most: int = 9) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations (see rebuilt).

    Turns of a conversation go by turn (null first), ties by role, then by the digest of role and text; a null
    role or text is empty; repeated rows are turns of their own. Turns are equal if role and text are.
    Rows without a conversation's id belong to none and are left out. Other columns are not read. An
    empty table has no conversation and no node, not even the root.

    conv_id: smallest member; depth: turns (the root has 0); parent_conv_id: smallest member of the parent (root: null);
    n_convs: conversations that start with the node; n_children; n_leaves: nodes without children in its subtree,
    itself included; saved_tokens: over the subtree, (n_convs - 1) * bytes of the last text; ends_sha256: of
    the ids of conversations that end here, decimal, ascending, joined by commas.
    """
    turns, convs = rebuilt(placed_turns(conversations, conv_col, turn_col, role_col, text_col), groups, most)
    return trie(turns, convs)


def query(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS c FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, told) - 1 AS place, told, bytes FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS told,
           octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS root,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
             lambda c, x: xor(c // 256, table_of.c[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), table_of
), r AS (
  SELECT c.conv_id, 0 AS own, t.place, told, bytes FROM c JOIN t ON t.conv_id = c.root WHERE t.place < h
  UNION ALL
  SELECT c.conv_id, 1, t.place, told, bytes FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.place >= h
), w AS (
  SELECT c.conv_id, coalesce(list(told ORDER BY own, place) FILTER (told IS NOT NULL), []) AS told, coalesce(list(bytes ORDER BY own, place) FILTER (told IS NOT NULL), []) AS bytes
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, d AS depth, len(told) AS size, array_to_string(told[1:d], '') AS path, array_to_string(told[1:d - 1], '') AS above, CASE WHEN d = 0 THEN 0 ELSE bytes[d] END AS bytes
  FROM (SELECT *, unnest(range(len(told) + 1)) AS d FROM w)
), n AS (
  SELECT path, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth
), k AS (
  SELECT above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
), s AS (
  SELECT a.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(b.own) AS saved_tokens
  FROM n b JOIN (SELECT conv_id, depth, path FROM p) up ON up.conv_id = b.conv_id AND up.depth <= b.depth JOIN n a ON a.path = up.path LEFT JOIN k ON k.path = b.path GROUP BY a.path
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n up ON n.depth > 0 AND up.path = n.above LEFT JOIN k ON k.path = n.path JOIN s ON s.path = n.path
"""
