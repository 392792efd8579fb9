"""What the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one Python task should hold at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id inside the operators: one id, smaller than all others.
NULL_ID = -(1 << 62)


def with_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with null ids replaced, so that Python workers get whole numbers; null_ids() turns them back."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID)))


def null_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_ID)) for c in columns or ("doc_id",)})


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs, all columns as they are, whose doc_id is in kept (doc_id, NULL_ID for null)."""
    at, ids = docs.columns.index("doc_id"), kept.select(F.col("doc_id").alias("_kept_id"))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows.join(ids, F.coalesce(F.col(f"c{at}").cast("long"), F.lit(NULL_ID)) == F.col("_kept_id"), "left_semi").toDF(*docs.columns)


class Carried:
    """Columns that an operator hands on as they are: Arrow bytes beside each chunk, whatever their types and names.

    rows: doc_id, text and the others as c0, c1, ...; whole() turns chunks' rows into docs again.
    """

    def __init__(self, docs: DataFrame):
        self.columns, fields = docs.columns, docs.schema.fields
        self.others = [i for i, c in enumerate(self.columns) if c not in ("doc_id", "text")]
        renamed = docs.toDF(*[f"c{i}" for i in range(len(self.columns))])
        at = {c: F.col(f"c{self.columns.index(c)}") for c in ("doc_id", "text")}
        self.rows = renamed.select(F.coalesce(at["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), at["text"].alias("text"), *[f"c{i}" for i in self.others])
        self.schema = StructType([*self.rows.schema.fields[:2], *[StructField(f"c{i}", fields[i].dataType) for i in self.others]])
        self.types = {"doc_id": fields[self.columns.index("doc_id")].dataType}

    @staticmethod
    def pack(slices: list[pa.RecordBatch]) -> bytes:
        """The other columns of some rows."""
        if not slices or slices[0].num_columns < 3:
            return b""
        rows = pa.Table.from_batches(slices).select(range(2, slices[0].num_columns)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(ids: list[int], texts: list[str], packed: bytes) -> pa.RecordBatch:
        """Rows of `schema` again, with new texts."""
        first = [pa.array(ids, pa.int64()), pa.array(texts, pa.string())]
        if not packed:
            return pa.RecordBatch.from_arrays(first, ["doc_id", "text"])
        rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
        others = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
        return pa.RecordBatch.from_arrays([*first, *others], ["doc_id", "text", *rows.column_names])

    def whole(self, rows: DataFrame) -> DataFrame:
        """docs' columns in docs' order; n_chars, where there is one, follows the text."""
        out = []
        for i, c in enumerate(self.columns):
            if c == "doc_id":
                out.append(F.nullif(F.col(c), F.lit(NULL_ID)).cast(self.types[c]))
            elif c == "n_chars":
                out.append(F.char_length("text").cast(self.schema[f"c{i}"].dataType))
            else:
                out.append(F.col(c if c == "text" else f"c{i}"))
        return rows.select(*[x.alias(f"c{i}") for i, x in enumerate(out)]).toDF(*self.columns)


def release() -> None:
    """Give memory that isn't used any more back to the system: idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """run (batches -> batches, for mapInPandas) that releases memory after each batch and at its end."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            release()

    def tidied(batches):
        yield from run(each(batches))
        release()

    return tidied


def tidy_group(run):
    """run (group -> rows, for applyInPandas) that releases memory after each group."""

    def tidied(group):
        out = run(group)
        release()
        return out

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a single-machine session (local tests) gets a temporary one; on a
    cluster a folder of one machine would be no use to the others, so that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


_recorded: list[list[str]] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Later reads of it survive lost executors, and its lineage ends here. The copy stays
    until the folder is cleaned, as lazy results may still read it; only settled() and the
    rounds of connected_components() know when theirs are done with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recorded:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, written; then the tables that it wrote on the way are deleted."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        df = make()
    finally:
        _recorded[:] = [x for x in _recorded if x is not paths]
    out = cut(df, name)
    drop(df.sparkSession, paths)
    return out


def grouped(batches: Iterator[pd.DataFrame], by: list[str], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Sorted rows in pieces of whole groups; a group of over `most` rows in parts, marked True."""
    held, big = None, None
    for pdf in batches:
        if big is not None:
            other = np.flatnonzero((pdf[by].to_numpy() != big).any(axis=1))
            n = int(other[0]) if len(other) else len(pdf)
            if n:
                yield pdf.iloc[:n], True
            if n == len(pdf):
                continue
            big, pdf = None, pdf.iloc[n:]
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        keys = held[by].to_numpy()
        other = np.flatnonzero((keys != keys[-1]).any(axis=1))
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield held.iloc[:whole], False
        held = held.iloc[whole:].reset_index(drop=True)
        if len(held) > most:
            yield held, True
            held, big = None, keys[-1]
    if held is not None and len(held):
        yield held, False


def bounds(pdf: pd.DataFrame, by: list[str]) -> list[tuple[int, int]]:
    keys = pdf[by].to_numpy()
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def sides(block: np.ndarray) -> tuple[slice, slice]:
    """The rows of a group that meet: all with all, or those of one block with those of the other."""
    n = len(block)
    cutat = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
    return (slice(0, cutat), slice(cutat, n)) if cutat else (slice(0, n), slice(0, n))


def in_blocks(rows: DataFrame, keys: list[str], node: str, run: Callable[[pd.DataFrame, slice, slice], pd.DataFrame | None], schema: str, block: int) -> DataFrame:
    """What run finds among the rows of each key, whatever its size: a group of over `block` rows is cut into blocks that meet two at a time.

    run gets rows of one key and the two ranges of them that are to meet (the same range
    twice: all with all). No pair is a row until run has found it worth one.
    """
    names, kinds = [x.split()[0] for x in schema.split(", ")], ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    columns, group, whole = rows.columns, [*keys, "p", "q"], f"{kinds}, p int, q int, own int, crowd boolean, {schema}"

    def meet(batches: Iterator[pd.DataFrame], by: list[str], room: int) -> Iterator[pd.DataFrame]:
        for pdf, crowd in grouped(batches, by, room):
            found, full = [], [pdf] if crowd else []
            for x, y in [] if crowd else bounds(pdf, by):
                if y - x > room:
                    full.append(pdf.iloc[x:y])
                elif y - x > 1:
                    part = pdf.iloc[x:y]
                    own = part.own.to_numpy()
                    if part.p.iat[0] == part.q.iat[0] or own[0] != own[-1]:
                        found.append(run(part, *sides(own)))
            found = [f for f in found if f is not None and len(f)]
            if found:
                yield pd.concat(found, ignore_index=True).assign(crowd=False, **{c: None for c in [*columns, "p", "q", "own"]})
            if full:
                yield pd.concat(full, ignore_index=True).assign(crowd=True, **{c: None for c in names})

    zero = [F.lit(0).alias(c) for c in ("p", "q", "own")]
    dealt = rows.select("*", *zero).repartition(*keys).sortWithinPartitions(*keys, node)
    first = cut(dealt.mapInPandas(tidy(lambda x: meet(x, keys, block)), whole), "blocks")
    crowded = first.where("crowd").select(*columns)
    sized = crowded.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dense = crowded.join(sized, keys).withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dense = dense.select(*columns, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
    dense = dense.repartition(*group).sortWithinPartitions(*group, "own", node)
    again = dense.mapInPandas(tidy(lambda x: meet(x, group, 1 << 62)), whole)
    return first.where("NOT crowd").unionByName(again).select(*names)


def min_neighbour_star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round of the alternating large-star/small-star algorithm on (a, b), a > b.

    larger: each node links its larger neighbours to its smallest neighbour, else its
    smaller ones and itself. The per-node minimum is aggregated before it is joined back,
    so no neighbourhood is ever gathered in one place.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # links of node a to larger neighbours b: edges seen from their smaller end
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(low, "a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node but the smallest of its component, which is `component`.

    edges: (a, b) long, in any direction, repeats and self links allowed. Rounds go on
    until every link joins a node to its component's smallest node; each round is a
    written table, and only two sums a round reach the driver. Empty edges: no rows.
    """
    paths: list[str] = []  # of the tables of rounds; all but the last are done with
    _recorded.append(paths)
    try:
        first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now, last = cut(first, "links"), None
        for _ in range(max_rounds):
            now = cut(min_neighbour_star(min_neighbour_star(now, True), False), "links")
            drop(edges.sparkSession, paths[:-1])
            del paths[:-1]
            state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == last:
                return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            last = state
    finally:
        _recorded[:] = [x for x in _recorded if x is not paths]
    raise RuntimeError("components did not settle")
