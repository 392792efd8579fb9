"""Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups' roots.

H is the lowercase hex SHA-256 of its inputs, concatenated. Levels are windows: nodes of a
group are partitioned by their parent's index, and one ordered list over the whole run gives
the parent's preimage and each node's siblings; one node of each run goes on to the next
level. Proofs are put together from the top down: a node's path is its siblings and its
parent's path.

No text is shuffled, only digests. A node's index in its group is its place in a range
partition plus the sizes of the partitions before it, so a group of any size is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.operators.windows import rank_globally

from .common import cut, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as it enters a leaf: UTF-8 byte count, a colon, the value; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _run(fanout: int) -> tuple[Column, Column, Column]:
    """(nodes left of this one in its run, nodes right of it, whether it is its group's last node) by one window."""
    window = Window.partitionBy("_key", "_parent").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run, at = F.collect_list("_node").over(window), (F.col("_idx") % fanout).cast("int")
    return F.concat_ws("", F.slice(run, F.lit(1), at)), F.concat_ws("", F.slice(run, at + 2, F.lit(fanout))), (F.col("_parent") == 0) & (F.size(run) == 1)


def _levels(nodes: DataFrame, largest: int, fanout: int, name: str) -> list[DataFrame]:
    """The written levels of the trees of nodes (_key, _idx, _node, others): + _parent, _left, _right, _top.

    largest: the number of nodes of the largest group, which gives the number of levels. _top
    marks a node that has no other of its group beside it: that group's tree ends there.
    """
    found, most = [], largest - 1 if largest else None
    while most is not None:
        left, right, top = _run(fanout)
        rows = nodes.withColumn("_parent", F.floor(F.col("_idx") / fanout))
        level = cut(rows.withColumns({"_left": left, "_right": right, "_top": top}), name)
        found.append(level)
        parent = F.sha2(F.concat("_left", "_node", "_right"), 256)
        nodes = level.where((F.col("_idx") % fanout == 0) & ~F.col("_top")).select("_key", F.col("_parent").alias("_idx"), parent.alias("_node"))
        most = None if most == 0 else most // fanout
    return found


def _down(levels: list[DataFrame], tops: DataFrame, above: list[str]) -> DataFrame:
    """Rows of the lowest level with _path, siblings from the node up, and the columns `above` of their group.

    tops: _key, _level (where the group's tree ends), _path from there on, and those columns.
    Joins are by merging: a level small enough to broadcast would pass through the driver, each of them.
    """
    known = None
    for j in reversed(range(len(levels))):
        end = levels[j].where("_top").drop("_parent", "_left", "_right", "_top").join(tops.where(F.col("_level") == j).drop("_level").hint("merge"), "_key")
        here = end
        if known is not None:
            up = known.select("_key", F.col("_idx").alias("_parent"), F.col("_path").alias("_rest"), *above)
            path = F.concat(F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))), "_rest")
            here = end.unionByName(levels[j].where("NOT _top").join(up.hint("merge"), ["_key", "_parent"]).withColumn("_path", path).drop("_parent", "_left", "_right", "_top", "_rest"))
        known = here if j == 0 else here.select("_key", "_idx", "_path", *above)
    return known


def _tops(levels: list[DataFrame]) -> DataFrame:
    out = None
    for j, level in enumerate(levels):
        rows = level.where("_top").select("_key", F.lit(j).alias("_level"), "_node")
        out = rows if out is None else out.unionByName(rows)
    return out


def places(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with _idx, their place from 0 among rows of their _key in the given order, which must be strict; the rows of the largest key.

    Rows are range-partitioned by key and order. A key that goes on from one partition to
    the next needs the number of its rows before: at most one such key a partition, so that
    table is broadcast.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()), "places")
    sizes = dealt.groupBy("_key", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("_before", before).where("_before > 0").select("_key", "_part", "_before")
    local = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order))
    placed = dealt.withColumn("_local", local).join(F.broadcast(later), ["_key", "_part"], "left")
    largest = sizes.groupBy("_key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return placed.withColumn("_idx", F.col("_local") - 1 + F.coalesce("_before", F.lit(0).cast("long"))).drop("_local", "_before", "_part"), largest


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", node: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """leaves, all columns, with subroot, root and proof: array<struct<left, right>>, siblings from the leaf up.

    Groups are ordered by their bytes, a null group (one of its own) first; leaves of a group
    ascend by `order`, null first, then by digest; equal rows in any order, which gives the same
    digests. A leaf alone in its group is its subroot, a group alone the root. An empty table
    gives no rows. Columns named proof, subroot or root are replaced.
    """
    columns = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    plain = leaves.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    key = F.coalesce(F.concat(F.lit("="), F.col(at[group]).cast("string")), F.lit(""))
    # a number of its own lets range partitions split equal rows
    rows = cut(plain.withColumns({"_key": key, "_node": F.col(at[node]), "_own": F.monotonically_increasing_id()}), "leaves")
    none = F.array().cast("array<struct<left: string, right: string>>")
    nodes, largest = places(rows, [at[order], "_node", "_own"])
    levels = _levels(nodes.drop("_own"), largest, fanout, "level")
    if not levels:
        return nodes.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_node").alias("subroot"), F.col("_node").alias("root"), none.alias("proof"))
    tops = cut(_tops(levels), "tops")
    ranked = rank_globally(tops.select("_key", "_level", "_node"), ["_key"])
    roots = _levels(ranked.select(F.lit("").alias("_key"), F.col("_rank").alias("_idx"), "_node", F.col("_key").alias("_group"), F.col("_level").alias("_ends")), tops.count(), fanout, "roots")
    root = _tops(roots).select("_key", "_level", F.col("_node").alias("root"), none.alias("_path"))
    groups = _down(roots, root, ["root"])
    groups = cut(groups.select(F.col("_group").alias("_key"), F.col("_ends").alias("_level"), F.col("_node").alias("subroot"), "root", "_path"), "groups")
    whole = _down(levels, groups, ["subroot", "root"])
    return whole.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "subroot", "root", F.col("_path").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s.left, s.right))), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, node, lambda acc, s: F.sha2(F.concat(s.left, acc, s.right), 256))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents and, for rows whose text was tampered with, the root that their leaf would give.

    A null doc_id isn't tampered with; a null or empty text stays as it is.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    other = leaf([*[F.col(c) for c in FIELDS[:-1]], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    leaves = docs.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(changed, other).alias("tampered"))
    found = manifest(leaves)
    back = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """DuckDB SQL for op12_merkle; CRC-32 by its bitwise rule (polynomial 0xEDB88320, reflected)."""

    def given(text: str) -> str:
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(parts)})"

    return f"""
WITH RECURSIVE
numbered AS (SELECT *, row_number() OVER () AS row_no FROM documents),
bytes AS (SELECT row_no, i, ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT AS b, length(CAST(doc_id AS VARCHAR)) AS n
          FROM numbered, LATERAL (SELECT unnest(range(1, length(CAST(doc_id AS VARCHAR)) + 1)) AS i)),
bits AS (
  SELECT row_no, 0 AS i, 8 AS bit, 4294967295::BIGINT AS crc FROM numbered WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s.row_no, CASE WHEN s.bit = 8 THEN s.i + 1 ELSE s.i END, CASE WHEN s.bit = 8 THEN 0 ELSE s.bit + 1 END,
         CASE WHEN s.bit = 8 THEN xor(s.crc, b.b) WHEN s.crc & 1 = 1 THEN xor(s.crc >> 1, 3988292384::BIGINT) ELSE s.crc >> 1 END
  FROM bits s LEFT JOIN bytes b ON b.row_no = s.row_no AND b.i = s.i + 1 WHERE s.bit < 8 OR b.b IS NOT NULL),
crcs AS (SELECT bits.row_no, xor(crc, 4294967295::BIGINT) AS crc FROM bits
         WHERE bit = 8 AND i = (SELECT length(CAST(doc_id AS VARCHAR)) FROM numbered n WHERE n.row_no = bits.row_no)),
leaves AS (
  SELECT row_no, doc_id, coalesce('=' || source, '') AS g, {given("text")} AS leaf,
         CASE WHEN crc % 2 = 0 THEN {given("replace(text, chr(10), '')")} ELSE {given("text")} END AS tampered
  FROM numbered LEFT JOIN crcs USING (row_no)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, g, idx, leaf AS node, n FROM placed
  UNION ALL
  SELECT level + 1, g, idx // {FANOUT}, sha256(string_agg(node, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT}
  FROM nodes WHERE n > 1 GROUP BY level, g, idx // {FANOUT}, n),
subs AS (SELECT g, level AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n_subs FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS idx, subroot AS node, n_subs AS n FROM subs
  UNION ALL
  SELECT level + 1, idx // {FANOUT}, sha256(string_agg(node, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT}
  FROM tops WHERE n > 1 GROUP BY level, idx // {FANOUT}, n),
steps AS (
  SELECT row_no, x.level AS step, x.idx AS idx, x.node, p.idx // CAST(pow({FANOUT}, x.level) AS BIGINT) AS own
  FROM placed p JOIN nodes x ON x.g = p.g AND x.n > 1 AND x.idx // {FANOUT} = p.idx // CAST(pow({FANOUT}, x.level + 1) AS BIGINT)
  UNION ALL
  SELECT row_no, s.height + x.level, x.idx, x.node, s.place // CAST(pow({FANOUT}, x.level) AS BIGINT)
  FROM placed p JOIN subs s ON s.g = p.g JOIN tops x ON x.n > 1 AND x.idx // {FANOUT} = s.place // CAST(pow({FANOUT}, x.level + 1) AS BIGINT)),
sides AS (
  SELECT row_no, step, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx < own), '') AS lefts, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx > own), '') AS rights
  FROM steps GROUP BY row_no, step),
proofs AS (SELECT row_no, string_agg(lefts || rights, '' ORDER BY step) AS proof FROM sides GROUP BY row_no),
folds AS (
  SELECT row_no, 0 AS step, tampered AS node FROM placed
  UNION ALL
  SELECT row_no, step + 1, sha256(lefts || node || rights) FROM folds JOIN sides USING (row_no, step)),
ends AS (SELECT row_no, arg_max(node, step) AS folded_root FROM folds GROUP BY row_no)
SELECT doc_id, leaf, subroot, tops.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = tops.node AS verified
FROM placed JOIN subs USING (g) JOIN ends USING (row_no) LEFT JOIN proofs USING (row_no), tops WHERE tops.n = 1
"""
