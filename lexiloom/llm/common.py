"""What the operators share: sessions, checkpoints, components and flat text arrays.

Text is handled as UTF-8 bytes in numpy: a column of strings becomes one byte array
with offsets, and words, hashes and shingles are computed over all its rows at once.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are handled at once in a Python worker; a longer text is handled alone.
SLICE_BYTES = 1 << 18
#: Edges that one task takes in the search for components.
FEW_EDGES = 50_000
#: Bytes of an Arrow batch, and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 250
#: Keys that spread() salts at most, and rows of a key with which it may be one.
HOT, HOT_ROWS = 4096, 1000
#: Tables of cut() that are still there.
_WRITTEN: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded rows and bytes, so that a batch of long texts fits a worker, and a checkpoint folder.

    The folder is spark.checkpoint.dir. Where none is set, a session in one process (tests) gets a new local one; on a
    cluster, whose machines share no local folder, that is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiloom-checkpoint-"))
    return spark


def task(run: Callable) -> Callable:
    """run, a function of mapInArrow, after which the worker gives back what the task no longer needs.

    Workers live on after a task, so memory that one stage has freed but not returned would add to the next one's.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def tidy() -> None:
    """Returns free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not glibc.
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the checkpoint folder, which all executors share, and read from there; its lineage ends."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables of cut() that no later step reads."""
    for df in frames:
        if spark := _WRITTEN.pop(df._written, None):
            at = spark._jvm.org.apache.hadoop.fs.Path(df._written)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; others, whatever their names, can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


# --- flat text arrays ---------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but space and the controls 9 to 13.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_TERMS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_STEP, _BACK):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        made.append(np.multiply.accumulate(x))
    return made[0], made[1]


#: Bytes whose words are hashed at once; a longer word is hashed alone.
HASHED = 1 << 16
_UP, _DOWN = _powers(HASHED)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of several texts: first and end byte, 64-bit hash, and by text the first word's number."""

    def __init__(self, data: np.ndarray, off: np.ndarray, word: np.ndarray):
        low = LOWER[data]
        self.low, self.off = low, off
        is_word = word[low]
        n = len(low)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        full = off[:-1] < off[1:]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.hash = self._hashed()
        self.first = np.searchsorted(self.start, off)

    def _hashed(self) -> np.ndarray:
        """A polynomial of each word's bytes; words are taken in stretches of bounded length, so powers and sums are, too."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            at = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, at + HASHED, "right")))
            size = int(self.end[j - 1]) - at
            up, down = (_UP, _DOWN) if size <= HASHED else _powers(size)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[self.low[at : at + size]] * up[:size], out=total[1:])
            a, b = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words that lies in one text, and by text the first run's number (texts of fewer words have none)."""
        h, n = self.hash, len(self.hash)
        count = np.maximum(np.diff(self.first) - (k - 1), 0)
        first = np.concatenate(([0], np.cumsum(count)))
        if n < k or not first[-1]:
            return np.zeros(0, np.uint64), first
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += h[j : n - k + 1 + j] * _TERMS[j]
        inside = np.repeat(self.first[:-1] - first[:-1], count) + np.arange(first[-1])
        return mix(total[inside]), first


def texts_of(batches, *columns: str):
    """(batch, rows' range, bytes, offsets) for slices of each batch's column text."""
    for batch in batches:
        data, off = flat(batch.column(batch.schema.get_field_index("text")))
        for i, j in slices(off):
            yield batch, i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


# --- joins with hot keys --------------------------------------------------------


def spread(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined on key with table, which has one row of a key and, in the column count, how many rows have the key (at least).

    A key that over a HOTth of all rows have is hot, so there are fewer than HOT hot keys, whatever the size; they are
    broadcast. A hot key's rows are dealt to several tasks by all their columns, and its row of table goes to each.
    The result has the columns of rows, then the others of table without count.
    """
    others = [c for c in table.columns if c not in (key, count)]
    if how == "left":
        # Null keys match nothing, and all of them would meet in one task.
        void = rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in others))
        return spread(rows.where(F.col(key).isNotNull()), table, key, count, "left_outer").union(void)
    total = table.agg(F.sum(count)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT)
    hot = table.where(F.col(count) > most).select(F.col(key).alias("hot key"), F.ceil(F.col(count) / most).cast("int").alias("parts")).collect()
    if not hot:
        return rows.join(table.drop(count), key, how).select(*rows.columns, *others)
    kind = table.schema[key].dataType
    small = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in hot], StructType().add("hot key", kind).add("parts", "integer")))
    mine = rows.join(small, F.col(key) == F.col("hot key"), "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("parts"))).cast("int")).drop("hot key", "parts")
    theirs = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > most, F.ceil(F.col(count) / most).cast("int") - 1).otherwise(0))))
    return mine.join(theirs.drop(count), [key, "salt"], how).select(*rows.columns, *others)


# --- connected components -----------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """Of links (u, v), both long: each node of a link with the smallest node that it reaches.

    Alternates large-star and small-star steps until nothing changes (Kiveris et al., 2014). Minima are
    aggregated before the shuffle, and hot nodes' rows meet in joins that can be split; no group is collected.
    """
    def ends(df: DataFrame, *pairs) -> DataFrame:
        """A row of each edge for each pair of expressions."""
        return df.select(F.explode(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in pairs))).alias("e")).select("e.u", "e.v")

    def settled(edges: DataFrame) -> bool:
        """Each node has one edge, to a node that has none."""
        counts = ends(edges, (u, F.lit(1)), (v, F.lit(1 << 40))).groupBy("u").agg(F.sum("v").alias("n"))
        return not counts.where((F.col("n") % (1 << 40) > 1) | (F.col("n") % (1 << 40) == 1) & (F.col("n") >= 1 << 40)).head(1)

    u, v = F.col("u"), F.col("v")
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    # Some thousand edges are not worth a shuffle: one task takes them, by the same steps.
    few = edges.count() <= FEW_EDGES
    edges = edges.coalesce(1) if few else edges
    for _ in range(60):
        if settled(edges):
            break
        both = ends(edges, (u, v), (v, u))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.distinct())
        edges = edges.coalesce(1) if few else edges
    else:
        raise RuntimeError("components did not settle")
    # An edge leads to its component's smallest node.
    return ends(edges, (u, v), (v, v)).distinct().select(u.alias("node"), v.alias("component"))
