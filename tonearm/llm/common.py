"""Shared helpers: shared-folder tables, Arrow text buffers, word hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the rolling word hash, its inverse modulo 2**64, and the finaliser's two factors.
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 1 << 64)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # glibc's numbers of these options


# ---------------------------------------------------------------- shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; on a local master a folder is made where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tonearm-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tonearm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialise() that no later step reads."""
    for df in frames:
        path = getattr(df, "_tonearm_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(columns: list[str], added: list[str]) -> list[str]:
    """Columns that stay beside added ones: an input column with the name of an added one, in any case, gives way to it."""
    gone = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in gone and not c.startswith("__")]


def shielded(docs: DataFrame, known: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """The same columns in order, with all but the known ones under names that clash with nothing; toDF(*names) undoes it."""
    return docs.toDF(*[c if c in known else f"extra{i}_column" for i, c in enumerate(docs.columns)])


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def bounded_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` distinct rows, those with the smallest hash of `keys`.

    Only hashes are ranked (a top-k with per-task heaps); whole rows are then filtered by the last hash,
    and rows with equal keys count once, so that repeated rows can't exceed the bound.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    last = hashed.select("__h").distinct().orderBy("__h").limit(most).agg(F.max("__h")).first()[0]
    if last is None:
        return rows.limit(0)
    return hashed.where(F.col("__h") <= last).dropDuplicates(["__h"]).drop("__h")


def keep_memory() -> None:
    """Let this worker reuse freed blocks up to 32 MB, so that numpy's temporaries don't fault in new pages each time."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc
        libc.mallopt(_MMAP_THRESHOLD, 32 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 256 << 20)


# ---------------------------------------------------------------- text buffers
def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds over `most` bytes of text, or a single row: it bounds numpy's temporaries."""
    lengths = np.zeros(batch.num_rows, np.int64)
    if batch.num_rows:
        lengths = np.diff(text_buffer(batch.column(column))[1])
    ends, at, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            ends.append((at, i))
            at, total = i, 0
        total += n
    if batch.num_rows > at:
        ends.append((at, batch.num_rows))
    for a, b in ends:
        yield batch.slice(a, b - a)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, base in (("up", MULT), ("down", MULT_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


_byte_values = mix(np.arange(1, 257, dtype=U64) * U64(MULT))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Cumulative rolling hash, n + 1 values; span_hash() takes any span from it."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(_byte_values[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def words(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't white space; runs don't cross rows."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~white[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, rows of the words, and the n + 1 word offsets of the rows."""
    raw, offsets = text_buffer(column)
    if lower:
        raw = LOWER[raw]
    starts, ends, rows = words(raw, offsets)
    hashes = span_hash(prefix_hash(raw), starts, ends) if len(starts) else np.zeros(0, U64)
    return hashes, rows, np.searchsorted(rows, np.arange(len(offsets)), side="left")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the start of each run."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], at


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component_id) for every node of an undirected edge list (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps, each a shuffle by one node with map-side minima. A node's
    neighbours meet only as aggregates and joins, never as a collected list, and each round is written to
    the shared folder. Both sides of each join are shuffled by node, so that Spark's skew join splits a node with very many
    neighbours. It ends when every node has one neighbour, a smallest one, or is one; `rounds` only guards against a fault.
    """
    edges = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"))))
        roles = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.child").alias("as_child"), F.count("*").alias("n"))
        if roles.where("as_child > 1 or (as_child > 0 and as_child < n)").isEmpty():
            break  # stars around their smallest nodes
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        done = materialise(small, "edges")
        discard(edges)
        edges = done
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return labels.unionByName(roots)


# ---------------------------------------------------------------- joins and groups
def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, how: str = "inner", share: int = 2000) -> DataFrame:
    """Equi-join on keys where `right` has one row a key and `count`, the key's rows on the left.

    Keys with over rows / share rows are at most `share` many: that bounded part is broadcast, so that no hot
    key of the left meets in one task; all others join by a shuffle.
    """
    least = max(rows // share, 1) + 1
    hot = right.where(F.col(count) >= least).withColumn("__hot", F.lit(True))
    marked = left.join(F.broadcast(hot.select(*keys, "__hot")), keys, "left")
    warm = marked.where("__hot is not null").drop("__hot").join(F.broadcast(hot.drop("__hot")), keys, "inner")
    cold = marked.where("__hot is null").drop("__hot").join(right.where((F.col(count) < least) | F.col(count).isNull()), keys, how)
    return warm.unionByName(cold)


def groups(batches, keys: list[str], most: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition sorted by keys: tables of about `most` rows and the row offsets of their groups."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        count += b.num_rows
        if count < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = _group_starts(t, keys)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
            t, at = t.slice(at[-1]), None
        held, count = t.to_batches(), t.num_rows
        if count >= most:  # one group so far: wait for more before looking again
            count = 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(_group_starts(t, keys), t.num_rows)


def _group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def fixed_bytes(column, width: int) -> np.ndarray:
    """A column of equally long binary values as a matrix of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros((0, width), np.uint8)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def binary_array(matrix: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as a binary column."""
    n, width = matrix.shape
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Union:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
