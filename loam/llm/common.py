"""What the operators of this subpackage share: scratch tables, byte-level words and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.ship import ship

#: Rows and bytes of one Arrow batch handed to a Python worker; they bound what a worker holds.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


def _give_memory_back() -> None:
    """Large arrays go back to the system as they are freed, as Python workers are kept from stage to stage."""
    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform.startswith("linux"):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


_give_memory_back()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts do not add up in a worker, and ship the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the cluster names none, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.gettempdir() + "/loam-shared"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.loam.checkpoint.dir", found)
    return found


#: Scratch tables that stand, by path: the table, and how many passing() blocks were open when it was written.
_standing: dict[str, tuple[DataFrame, int]] = {}
_depth = [0]


def written(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there and lost executors cost nothing.

    It stands until freed, else until the passing() block ends (outside: the block around that one) or the program does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _standing[path] = (out, _depth[0] - outside)
    return out


def renamed(table: DataFrame, *names: str) -> DataFrame:
    """A scratch table under other column names."""
    out = table.toDF(*names)
    for path, (t, depth) in list(_standing.items()):
        if t is table:
            _standing[path] = (out, depth)
    return out


def free(*tables: DataFrame) -> None:
    """Delete scratch tables whose successors are written; then unused shuffle files go too, once the JVM knows of it."""
    for path, (table, _) in list(_standing.items()):
        if any(table is t for t in tables):
            _delete(path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # the context's cleaner follows the collector


def _delete(path: str) -> None:
    table, _ = _standing.pop(path)
    sc = table.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Scratch tables written inside go at the end, but for those written as outside."""
    _depth[0] += 1
    try:
        yield
    finally:
        for path in [p for p, (_, d) in _standing.items() if d >= _depth[0]]:
            _delete(path)
        _depth[0] -= 1


def _at_exit() -> None:
    for path in list(_standing):
        with contextlib.suppress(Exception):  # the session may be gone; the cluster's own cleaning takes the folder
            _delete(path)


atexit.register(_at_exit)


def parallelism(spark: SparkSession) -> int:
    """Partitions for what is dealt out by an explicit repartition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_U = np.uint64
_R, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_RINV = _U(pow(int(_R), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "plain"
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1 << 16), _RINV if inverse else _R, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p)
    return _powers[key][:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """C with C[e] - C[s] = R^s times the polynomial of data[s:e], all modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    return mix((c[end] - c[start]) * powers(len(c), inverse=True)[start] + (end - start).astype(np.uint64) * _M2)


#: Bytes that part words: white space; and all of ASCII that is no letter or digit (upper case counts as its lower case).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each document's first word (one more entry than documents)."""
    inside = ~parting[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    now = np.empty(len(data) + 1, bool)
    now[:-1] = inside
    now[-1] = False
    start = np.flatnonzero(now & (~before | first))
    end = np.flatnonzero(before & (~now | first))
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and the index of each document's first word."""
    start, end, at = words(data, offsets, parting)
    return range_hash(prefix_hash(data, lower=True), start, end), at


def crc32_mod(ids: np.ndarray, m: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo m."""
    return np.array([zlib.crc32(str(int(x)).encode()) % m for x in ids], np.int64)


def crc32_fold(column: str, m: int):
    """The same as a column."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of some edges, but for those that are the smallest themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while len(a):
        np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    k = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[k], ids[parent[k]]


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Edges contracted at a time; what is left of them goes on with the next ones.
_EDGES = 1 << 20


def _contract(batches):
    """Replace the edges of a partition by a star for each of their components there, a bounded number at a time."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= _EDGES:
            u, v = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(u) > size // 2:  # hardly any fell away
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_PAIR)
                u, v = u[:0], v[:0]
            held, size = [(u, v)], len(u)
    if held:
        u, v = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_PAIR)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge that is not itself the smallest.

    Alternating large and small stars until stars are all there is; the edges are first contracted within partitions, each round ends in a written
    table, and no list of nodes ever reaches the driver. A loop or null edge is ignored.
    """
    prepare(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.mapInArrow(_contract, "u long, v long"), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        last, e = e, written(small.select("x.*").where("u <> v").distinct(), "stars")
        free(last)
    return renamed(e, "node", "component")


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge upwards at most, to a node that has none: then the edges are the components."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s")).select("s.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


#: Rows of a key that make it hot: so many at least, and this share of all, so that there are never more than 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 1000, 0.001


def join_by_key(rows: DataFrame, told: DataFrame, key: str, total: int) -> DataFrame:
    """rows left-joined by a key with told (key, rows_, ...), which has a row for a key; rows_: how many rows the key has.

    total: all rows. The few keys of many rows are broadcast, so none of them lands in one task.
    """
    hot = told.where(F.col("rows_") >= max(HOT_ROWS, int(total * HOT_SHARE))).drop("rows_")
    cold = told.where(F.col("rows_") < max(HOT_ROWS, int(total * HOT_SHARE))).drop("rows_")
    few = F.broadcast(hot)
    return rows.join(few, key).select(*rows.columns, *[c for c in hot.columns if c != key]).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))
