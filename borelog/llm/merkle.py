"""A Merkle manifest of a data set, with a proof for every row.

Rows are leaves of one tree a group, ordered by key; the groups' roots are leaves of the tree above. Large blocks of
consecutive nodes are reduced where they lie, so only their roots are left: a top tree of a proven size, which the driver
builds. It broadcasts the paths from the blocks' roots to the top; executors put each row's path within its block before
them and fold them. Should blocks or groups be more than the driver may take, their roots are blocked again first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Children of a node; levels within a block; nodes that the driver takes and broadcasts at most.
ARITY, HEIGHT, TOP = 3, 7, 10_000
NODES = "tree string, block long, n long, keys binary, known binary, names array<string>, nodes binary, now binary, differs binary, root binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The nodes and the levels above them: ``height`` of them, or until one node remains."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level up to the top of ``tree``."""
    out = []
    for level in tree[:-1]:
        first = at // ARITY * ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields in turn: ``-`` for null, else the number of bytes, a colon and the value."""
    each = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.unhex(F.sha2(F.concat(*each), 256))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in their tree (ordered by ``order``) and its size ``n``. No tree is brought into one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order]
    at = F.monotonically_increasing_id()
    lined = cut(spark, rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"part": F.shiftright(at, 33), "at": at}), "ordered")
    # One row for each tree and partition: as many as there are trees and partitions together at most.
    starts = lined.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "n": F.sum("held").over(Window.partitionBy("tree"))})
    return lined.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "held", "before")


def blocked(nodes: DataFrame, height: int) -> DataFrame:
    """One row for each block of ``ARITY ** height`` nodes (columns tree, pos, n, node and whatever of key, now, name there is), with its root."""
    size = ARITY**height
    given = nodes.columns
    columns = {"block": F.expr(f"pos div {size}"), "key": F.col("key") if "key" in given else F.lit(None).cast("long"), "now": F.col("now") if "now" in given else F.lit(None).cast("binary"), "name": F.col("name") if "name" in given else F.lit(None).cast("string")}
    rows = nodes.withColumns(columns).select("tree", "block", "pos", "n", "key", "node", "now", "name")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = "name" in given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            key, now = t["key"].combine_chunks(), t["now"].combine_chunks()
            nodes = [x.hex() for x in t["node"].to_pylist()]
            n = t["n"][0].as_py()
            root = levels(nodes, height if n > size else None)[-1][0]
            row = {"tree": t["tree"][0].as_py(), "block": t["block"][0].as_py(), "n": n, "keys": pc.fill_null(key, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()}
            row |= {"known": pc.is_valid(key).to_numpy(zero_copy_only=False).tobytes(), "names": t["name"].to_pylist() if named else None, "nodes": bytes.fromhex("".join(nodes))}
            row |= {"now": b"".join(x for x in now.to_pylist() if x is not None), "differs": pc.is_valid(now).to_numpy(zero_copy_only=False).tobytes(), "root": bytes.fromhex(root)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("known", pa.binary()), ("names", pa.list_(pa.string())), ("nodes", pa.binary()), ("now", pa.binary()), ("differs", pa.binary()), ("root", pa.binary())])
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, block = b.column("tree"), b.column("block").to_numpy()
            new = (block[1:] != block[:-1]) | pc.not_equal(tree.slice(1), tree.slice(0, len(tree) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
                at = (tree[a].as_py(), int(block[a]))
                if held and at != last:
                    yield flush()
                held.append(b.slice(a, z - a))
                last = at
        if held:
            yield flush()

    return cut(nodes.sparkSession, rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, NODES), "blocks")


def roots(blocks: DataFrame, height: int) -> DataFrame:
    """The blocks' roots as the nodes of the next level."""
    return blocks.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {ARITY**height - 1}) div {ARITY**height}").alias("n"), F.col("root").alias("node"))


def opened(row: dict, height: int) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """The members of a block, and the path of each within it."""
    data = row["nodes"].hex()
    nodes = [data[i : i + 64] for i in range(0, len(data), 64)]
    tree = levels(nodes, height if row["n"] > ARITY**height else None)
    return nodes, [siblings(tree, i) for i in range(len(nodes))]


def flat(path: list[tuple[str, str]]) -> list[str]:
    return [x for pair in path for x in pair]


def pairs(path: list[str]) -> list[tuple[str, str]]:
    return list(zip(path[::2], path[1::2], strict=True))


def down(blocks: DataFrame, above, height: int) -> DataFrame:
    """(tree, pos, path, subroot) of the nodes within ``blocks``; ``above`` names a block's own (path, subroot) or is a table of them."""
    known = None if isinstance(above, DataFrame) else above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                path, subroot = row_above(row, known)
                nodes, paths = opened(row, height)
                first, names = row["block"] * ARITY**height, row["names"]
                # The members of the tree of trees are roots themselves, each of the tree that its name says.
                trees = names or [row["tree"]] * len(nodes)
                at = [0] * len(nodes) if names else list(range(first, first + len(nodes)))
                columns = [pa.array(trees, pa.string()), pa.array(at, pa.int64()), pa.array([flat(p) + path for p in paths], pa.list_(pa.string())), pa.array(nodes if names else [subroot] * len(nodes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "path", "subroot"])

    return with_above(blocks, above).mapInArrow(run, "tree string, pos long, path array<string>, subroot string")


def with_above(blocks: DataFrame, above) -> DataFrame:
    if not isinstance(above, DataFrame):
        return blocks.withColumns({"path": F.lit(None).cast("array<string>"), "subroot": F.lit(None).cast("string")})
    return blocks.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])


def row_above(row: dict, known) -> tuple[list[str], str]:
    return (row["path"], row["subroot"]) if known is None else known.value[row["tree"], row["block"]]


def proofs(blocks: DataFrame, above, root: str, height: int) -> DataFrame:
    """The rows of the lowest blocks with their proofs, each folded from what the row is now."""
    known = None if isinstance(above, DataFrame) else above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                path, subroot = row_above(row, known)
                tail, rest = pairs(path), "".join(path)
                nodes, paths = opened(row, height)
                now, changed = row["now"].hex(), np.frombuffer(row["differs"], bool)
                at = 64 * (np.cumsum(changed) - changed)
                found = [folded(now[a : a + 64] if new else node, [*p, *tail]) for node, p, new, a in zip(nodes, paths, changed.tolist(), at.tolist(), strict=True)]
                n = len(nodes)
                ids = pa.array(np.frombuffer(row["keys"], "<i8"), pa.int64(), mask=~np.frombuffer(row["known"], bool))
                columns = [ids, pa.array(nodes), pa.array([subroot] * n), pa.array([root] * n), pa.array([digest("".join(flat(p)) + rest) for p in paths]), pa.array(found), pa.array([f == root for f in found])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return with_above(blocks, above).mapInArrow(run, PROOFS)


def manifest(df: DataFrame, now: Column | None = None, id_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the digest of ``fields``. ``now`` is the text as it is found at verification (default: as it was); the root is
    folded again from the leaf with that text and the original siblings, and the row is verified if it is the root.
    Rows of one tree that share an id are ordered by their leaves, a null id comes first; rows equal in everything are leaves of
    their own, side by side. Null trees are one tree, before all others. Empty and very long texts need nothing special, as a text never leaves
    the task that reads it; other columns are ignored, whatever their names; an empty table gives no rows. The driver
    takes and broadcasts at most ``top`` nodes; blocks hold ``ARITY ** height`` nodes."""
    if height < 1 or top < 1:
        raise ValueError("height and top must be 1 or more")
    spark: SparkSession = df.sparkSession
    values = [F.col(f).cast("string") for f in fields]
    node = leaf(*values)
    other = leaf(*[now if f == text_col else v for f, v in zip(fields, values, strict=True)]) if now is not None else F.lit(None)
    same = F.lit(True) if now is None else F.col(text_col).cast("string").eqNullSafe(now)
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), F.col(id_col).cast("long").alias("key"), node.alias("node"), F.when(~same, other).alias("now"), F.monotonically_increasing_id().alias("row"))
    rows = cut(spark, rows, "leaves")
    below = [blocked(placed(rows, ["key", "node", "row"]).drop("row"), height)]  # the lowest level first
    nodes = roots(below[-1], height)
    while nodes.count() > top and nodes.where("n > 1").limit(1).count():
        below.append(blocked(nodes, height))
        nodes = roots(below[-1], height)
    upper: list[DataFrame] = []
    while nodes.count() > top:  # as many trees: their roots are blocked as well
        if not upper:
            nodes = placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
        upper.append(blocked(nodes, height))
        nodes = roots(upper[-1], height)
    above, root = topped(spark, nodes, bool(upper))
    for blocks in reversed(upper):
        above = cut(spark, down(blocks, above, height), "paths")
    for blocks in reversed(below[1:]):
        above = cut(spark, down(blocks, above, height), "paths")
    return proofs(below[0], above, root, height)


def topped(spark: SparkSession, nodes: DataFrame, one: bool):
    """The top tree, built by the driver: its root, and a broadcast of every node's path to it and its tree's root."""
    found = [(r["tree"], r["pos"], r["node"].hex()) for r in nodes.orderBy("tree", "pos").select("tree", "pos", "node").collect()]
    trees: dict[str, list[str]] = {}
    for tree, _, node in found:
        trees.setdefault(tree, []).append(node)
    within = {tree: levels(held) for tree, held in trees.items()}
    over = levels([t[-1][0] for t in within.values()]) if within else [[""]]
    paths = {}
    for i, (tree, held) in enumerate(within.items()):
        last = flat(siblings(over, i))
        for pos in range(len(held[0])):
            paths[tree, pos] = (flat(siblings(held, pos)) + ([] if one else last), held[-1][0])
    return spark.sparkContext.broadcast(paths), over[-1][0]


#: The rows at verification: where 2 divides the checksum of the id, the text has lost its line ends.
def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    hit = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    text = F.col(text_col).cast("string")
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


SQL = """
WITH RECURSIVE bits(x, k, v) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL SELECT x, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(v ORDER BY x) AS t FROM bits WHERE k = 8),
sums(doc_id, k, c) AS (
  SELECT DISTINCT doc_id, 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, k + 1, xor(c // 256, CAST(t[1 + xor(c % 256, CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k + 1 AS BIGINT), 1)) AS BIGINT))] AS BIGINT)) FROM sums, steps WHERE k < length(CAST(doc_id AS VARCHAR))),
checks AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM sums WHERE k = length(CAST(doc_id AS VARCHAR))),
given AS (SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents d LEFT JOIN checks USING (doc_id)),
fields AS (SELECT *,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM given),
digests AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS leaf_now FROM fields),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
low(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 3),
tops AS (SELECT tree, h AS subroot, lvl AS height FROM low WHERE n = 1),
high(lvl, pos, h, n) AS (
  SELECT 0, tree - 1, subroot, count(*) OVER () FROM tops
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY lvl, pos // 3),
crown AS (SELECT h AS root, lvl AS height FROM high WHERE n = 1),
nodes AS (SELECT tree, lvl, pos, h FROM low WHERE n > 1 UNION ALL SELECT t.tree, t.height + h.lvl, h.pos, h.h FROM high h, tops t WHERE h.n > 1),
runs AS (SELECT tree, lvl, pos // 3 AS run, list(struct_pack(p := pos, h := h) ORDER BY pos) AS held FROM nodes GROUP BY ALL),
fold(tree, pos, lvl, cur, node, path) AS (
  SELECT l.tree, l.pos, 0, CASE WHEN t.height = 0 THEN l.tree - 1 ELSE l.pos END, leaf_now, '' FROM leaves l JOIN tops t USING (tree)
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, CASE WHEN f.lvl + 1 = t.height THEN f.tree - 1 ELSE f.cur // 3 END,
    sha256(coalesce(list_aggregate(list_transform(list_filter(held, lambda x: x.p < f.cur), lambda x: x.h), 'string_agg', ''), '') || f.node || coalesce(list_aggregate(list_transform(list_filter(held, lambda x: x.p > f.cur), lambda x: x.h), 'string_agg', ''), '')),
    f.path || coalesce(list_aggregate(list_transform(list_filter(held, lambda x: x.p <> f.cur), lambda x: x.h), 'string_agg', ''), '')
  FROM fold f JOIN tops t USING (tree) JOIN runs r ON r.tree = f.tree AND r.lvl = f.lvl AND r.run = f.cur // 3)
SELECT l.doc_id, l.leaf, t.subroot, c.root, sha256(f.path) AS proof_sha256, f.node AS folded_root, f.node = c.root AS verified
FROM leaves l JOIN tops t USING (tree) CROSS JOIN crown c JOIN fold f ON f.tree = l.tree AND f.pos = l.pos AND f.lvl = t.height + c.height
"""
