"""How the operators move data: shared tables, blobs routed by hash, bounded bitmaps, components.

Rows leave Python packed: one row per destination with whole numpy arrays as
binary columns. A shuffle then moves a few hundred large rows instead of
millions of small ones, and the reducer works on arrays at once.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.llm import kernel as K

#: Corpus bytes that one reducer handles, on inputs up to some 64 GB and beyond; the number of reducers follows the input.
PART_BYTES = (4 << 20, 16 << 20)
#: Text that one Arrow batch holds, in bytes, besides its last row.
BATCH_BYTES = 4 << 20
#: Bits of a bitmap of hashes, whatever the input: 16 MB. Past its capacity it lets more through, and never less.
BITMAP_BITS = 27
#: Most edges (16 bytes each) of a graph that one task joins.
EDGES_AT_ONCE = 1_000_000
#: Value that stands for a null document id: it sorts after every other.
NULL_ID = np.iinfo(np.int64).max


def _trim() -> None:
    """Gives freed memory back: idle Python workers stay alive beside the busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _trim_jvm(spark: SparkSession) -> str | None:
    """_trim for the driver's JVM, whose compilers hold on to what they freed. Its report, or None from a JVM without the command (HotSpot on Linux has it)."""
    jvm = spark._jvm
    try:
        # By the interface's method: the server's own class is closed to reflection.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        new = spark.sparkContext._gateway.new_array
        args = new(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def lean(scan):
    """scan, for mapInArrow, with its memory given back at the end of a partition."""

    def run(batches):
        yield from scan(batches)
        _trim()

    return run


def lean_group(settle):
    """settle, for applyInArrow on groups, with its memory given back after each group."""

    def run(table):
        out = settle(table)
        _trim()
        return out

    return run


def lean_cogroup(settle):
    """settle, for applyInArrow on pairs of groups, with its memory given back after each pair."""

    def run(left, right):
        out = settle(left, right)
        _trim()
        return out

    return run


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, in rows and in bytes: it ends with the row that reaches either.

    Results are lazy, so the session keeps these two settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one if all run in this process, else an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{context.applicationId}"


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and survive lost executors.

    free() deletes those that nothing needs any more. A run whose result doesn't
    read its tables frees them all before it ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        """df, written and read back."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that free() no longer deletes: a result."""
        self.held = [x for x in self.held if x[0] is not df]
        return df

    def free(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all."""
        gone = [x for x in self.held if not tables or any(x[0] is t for t in tables)]
        self.held = [x for x in self.held if not any(x is y for y in gone)]
        for _, path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def sweep(self) -> None:
        """Asks the driver to let go of finished steps: their shuffle files go when it collects its garbage, and freed memory goes back."""
        gc.collect()
        self.spark._jvm.System.gc()
        _trim()
        _trim_jvm(self.spark)


def write_table(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that stays until that folder goes."""
    return Scratch(df.sparkSession).table(df)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; where it has none, the bytes of its texts, which takes a scan."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def log_parts(df: DataFrame) -> int:
    """Binary logarithm of the number of reducers for df, never below the shuffle's.

    Each gets PART_BYTES[0] of the input. Past 2**14 reducers their share grows with
    the square root of the input, to PART_BYTES[1] at most, which a worker still holds.
    """
    shuffle, total = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * size_bytes(df)
    share = min(max((total * PART_BYTES[0] / (1 << 14)) ** 0.5, PART_BYTES[0]), PART_BYTES[1])
    return int(np.ceil(np.log2(max(shuffle, total // share, 2))))


def bitmap_parts(log_p: int) -> int:
    """Binary logarithm of the number of reducers that make a bitmap: enough to share its hashes, and a block of bytes for each."""
    return min(log_p, 14)


def texts(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """The id as ``id``, the text as ``text``, and carried columns as ``c0``, ``c1``, ...: no name can clash."""
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(carry or [])]
    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), *own)


def ids_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("id"))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text: tells rows with one id and different texts apart."""
    c = K.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    return K.span_hashes(c, offsets[:-1], offsets[1:])


def route(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per part in use, with that part's values of every column packed as binary."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = K.runs(part)
    out = {"part": pa.array(part[first].astype(np.int32))}
    edges = np.append(first, len(part))
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        offsets = (edges * values.itemsize).astype(np.int32)
        out[name] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pa.RecordBatch.from_pydict(out)


def unpack(table: pa.Table | pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """All values of a packed column, of all rows."""
    column = table.column(table.schema.get_field_index(name))
    pieces = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, offsets = K.buffers(chunk)
        pieces.append(data[offsets[0] : offsets[-1]])
    joined = np.concatenate(pieces) if len(pieces) != 1 else pieces[0]
    return joined.view(dtype) if joined.flags.aligned and joined.ctypes.data % np.dtype(dtype).itemsize == 0 else np.frombuffer(joined.tobytes(), dtype)


def slot(h: np.ndarray, log_p: int) -> np.ndarray:
    """Place of a hash in a bitmap made by log_p reducers: high bits name the reducer's block."""
    inside = BITMAP_BITS - log_p
    return ((h >> np.uint64(64 - log_p)) << np.uint64(inside)) | (h & np.uint64((1 << inside) - 1))


def part_of(h: np.ndarray, log_p: int) -> np.ndarray:
    return (h >> np.uint64(64 - log_p)).astype(np.int32)


def spread_out(h: np.ndarray) -> np.ndarray:
    """Hashes that were chosen for being small, dealt evenly again."""
    return K.mix(h ^ np.uint64(0xA0761D6478BD642F))


def row_part(ids: np.ndarray, keys: np.ndarray, log_p: int) -> np.ndarray:
    """Part of a row: by id and text, so that neither copies of a text nor a repeated id pile up."""
    return part_of(K.mix(keys ^ K.mix(ids.view(np.uint64))), log_p)


class HashSet:
    """Collects hashes of a batch; gives each once, with its number (up to 255)."""

    def __init__(self, log_p: int):
        self.log_p, self.held = log_p, []

    def add(self, h: np.ndarray) -> None:
        self.held.append(spread_out(h))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            h, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held = []
            if len(h):
                # 32 bits and the part tell hashes apart; two that are taken for one only let more through the bitmap.
                yield route(part_of(h, self.log_p), {"h": h.astype(np.uint32), "many": np.minimum(n, 255).astype(np.uint8)})


HASHES = "part int, h binary, many binary"


def bitmap(hashes: DataFrame, log_p: int, least: int = 1, often: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes met `least` times or more, as a fixed 2**BITMAP_BITS bitmap; names of those met `often`.

    Each reducer makes the block of its own hash range, so the driver receives
    BITMAP_BITS bits in all, at any input size, and no more names than there are
    hashes over `often`. log_p is one of bitmap_parts.
    """

    def block(table: pa.Table) -> pa.Table:
        h, many = unpack(table, "h", np.uint32), unpack(table, "many", np.uint8)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = K.runs(h)
        n = np.add.reduceat(many[order].astype(np.int64), first) if len(h) else first
        h = h[first]
        bits = np.zeros(1 << (BITMAP_BITS - log_p), bool)
        bits[(h[n >= least] & np.uint32(len(bits) - 1)).astype(np.int64)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "often": pa.array([h[n >= often].tobytes()], pa.binary())})

    out, names = np.zeros((1 << log_p, 1 << (BITMAP_BITS - log_p - 3)), np.uint8), [np.empty(0, np.uint64)]
    for row in hashes.groupBy("part").applyInArrow(lean_group(block), "part int, bits binary, often binary").collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
        names.append(np.frombuffer(row.often, np.uint32).astype(np.uint64) | np.uint64(row.part << 32))
    return out.reshape(-1), np.sort(np.concatenate(names))


def short_name(h: np.ndarray, log_p: int) -> np.ndarray:
    """What bitmap() calls a hash."""
    h = spread_out(h)
    return (part_of(h, log_p).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Marks the values that the sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def in_bitmap(bits: np.ndarray, h: np.ndarray, log_p: int) -> np.ndarray:
    at = slot(spread_out(h), log_p).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def id_hashes(ids: DataFrame, log_p: int) -> DataFrame:
    """HASHES of the 64-bit integers in the first column."""

    def pack(batches):
        for batch in batches:
            found = HashSet(log_p)
            found.add(K.mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            yield from found.flush()

    return ids.mapInArrow(lean(pack), HASHES)


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node that each one's edges lead to."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    up = np.arange(len(node))
    while len(i):
        # Of two roots with an edge the larger goes below the least that it meets, until no edge joins two.
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while (up[up] != up).any():
            up = up[up]
        i, j = up[i], up[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return node, node[up]


def components(edges: DataFrame, scratch: Scratch, most: int = 60, at_once: int | None = None) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); a component is named by its least node.

    Up to at_once edges (EDGES_AT_ONCE) one task joins them all. More go through
    alternating large-star and small-star rounds: every round is two group-by
    minima, the edge table stays linear, and nothing is collected but each round's
    count and checksum of the edges. As stars shrink the table, a round may leave
    few enough for one task.
    """
    at_once = EDGES_AT_ONCE if at_once is None else at_once
    pair = lambda *ends: F.struct(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"))
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def settle(batches):
        held = [[batch.column(i).to_numpy() for i in (0, 1)] for batch in batches]
        if held:
            node, component = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "component": pa.array(component)})

    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = sign(edges)
    for _ in range(most):
        if now[0] <= at_once:
            return edges.coalesce(1).mapInArrow(lean(settle), "node bigint, component bigint")
        # Both directions, and both edges of a star, come from one read: a union would repeat the plan below it, again and again.
        both = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = scratch.table(small)
        scratch.free(edges, large)
        scratch.sweep()
        before, edges, now = now, after, sign(after)
        if now == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
