"""Shared helpers: tables, stage tables in the shared folder, byte-level text primitives."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables

#: Rows of one Arrow batch sent to Python; long texts also split by maxBytesPerBatch.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Bytes of text hashed at once.
PIECE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name, spread=name in ("documents", "pages", "conversations"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory doesn't depend on the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local master gets one of its own; a cluster fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="parchline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def with_id(df: DataFrame, rest: str) -> T.StructType:
    """Schema of ``df``'s doc_id, whatever its type, and further columns."""
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *T.StructType.fromDDL(rest).fields])


#: Share of the driver's heap from which on its garbage is collected after a written table.
FULL_HEAP = 0.5


def release(spark: SparkSession) -> str:
    """Gives memory of finished queries back that the driver would keep, as an operator of many short queries adds it up.

    Broadcasts go with their last reference, for which the driver's garbage is collected once the heap has grown to FULL_HEAP of its limit.
    What compilers and threads have freed stays with the C library, which is asked to return it. Its answer, none of a JVM that can't ask.
    """
    jvm = spark._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() >= FULL_HEAP * heap.maxMemory():
        jvm.java.lang.System.gc()
    with suppress(Py4JError):
        (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    return ""


class Stage:
    """Intermediate tables under one run folder of the shared directory.

    Written tables cut lineage and survive the loss of any executor. Superseded
    tables are removed with ``drop``; those that a lazy result reads stay until ``passing``
    or the folder's owner removes them.
    """

    made: list[Stage] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/parchline/{name}-{uuid.uuid4().hex}"
        Stage.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """Removes at its end the tables of all stages begun inside; what is still needed must be written elsewhere by then."""
    before = len(Stage.made)
    try:
        yield
    finally:
        for stage in Stage.made[before:]:
            stage.drop()
        del Stage.made[before:]


#: A key is hot when it holds this share of all rows or more; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the one row that ``counted`` has for their keys (inner). Its column ``n`` says how many of the ``total`` rows have the key.

    Hot keys, at most 1 / HOT_SHARE of them, are broadcast and their rows stay where they are; the rest is shuffled, and no key
    of it holds more than HOT_SHARE of the rows.
    """
    hot = F.col("n") >= max(2.0, HOT_SHARE * total)
    found = F.broadcast(counted.where(hot))
    few = rows.join(F.broadcast(counted.where(hot).select(*keys)), keys, "left_anti").join(counted.where(~hot), keys)
    return rows.join(found, keys).select(*few.columns).unionByName(few)


# --- bytes -----------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Primes under 2^31 and bases for the words' hashes; a byte counts as its value and one.
_PRIMES = (2147483647, 2147483629)
_BASES = (1_103_515_245, 1_664_525_013)
_BYTE = np.arange(1, 257, dtype=np.uint64)
#: Longer words are hashed one by one, as sums over them would not fit 64 bits.
LONG_WORD = 1 << 16
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime base^i and base^-i for i < n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS.clear()
        for prime, base in zip(_PRIMES, _BASES):
            both = []
            for b in (base, pow(base, -1, prime)):
                out = np.ones(size, dtype=np.uint32)
                k = 1
                while k < size:
                    out[k : 2 * k] = out[: min(k, size - k)] * np.uint64(pow(b, k, prime)) % np.uint64(prime)
                    k *= 2
                both.append(out)
            _POWERS.append((both[0], both[1]))
    return [(p[:n], q[:n]) for p, q in _POWERS]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def _hash_piece(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the words' bytes modulo two primes, 62 bits; running sums serve all words at once.

    A word's sum is exact modulo 2^64, as it stays below 2^8 * 2^31 * LONG_WORD.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    for prime, (power, inverse) in zip(_PRIMES, _powers(len(buf) + 1)):
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
        part = (total[ends] - total[starts]) % np.uint64(prime) * inverse[starts] % np.uint64(prime)
        out = (out << np.uint64(31)) | part
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = buf[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"long word").digest(), "little")
    return mix(out)


def word_hashes(texts: list[bytes], lower: bool) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`, in order.

    Texts are hashed together in pieces of about PIECE bytes; a longer text is cut
    at white space, so memory does not follow a text's length (but for one single word).
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        buf = np.frombuffer(b" ".join(t for _, t in held), dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        starts, ends = word_bounds(buf)
        hashes = _hash_piece(buf, starts, ends)
        offsets = np.cumsum([0] + [len(t) + 1 for _, t in held])
        cuts = np.searchsorted(starts, offsets[1:-1])
        for (i, _), h in zip(held, np.split(hashes, cuts), strict=True):
            out[i].append(h)
        held, size = [], 0

    for i, text in enumerate(texts):
        for part in cut_at_space(text, PIECE):
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    return [h[0] if len(h) == 1 else np.concatenate(h) if h else np.zeros(0, np.uint64) for h in out]


def cut_at_space(text: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes that together hold the text's words whole."""
    parts, at = [], 0
    while len(text) - at > size:
        tail = np.frombuffer(text, dtype=np.uint8, offset=at + size)
        step = 1 << 16
        for k in range(0, len(tail), step):
            hit = np.flatnonzero(_SPACE[tail[k : k + step]])
            if len(hit):
                end = at + size + k + int(hit[0])
                break
        else:
            break
        parts.append(text[at:end])
        at = end
    parts.append(text[at:])
    return parts


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total = (total * np.uint64(0xD6E8FEB86659FD93)) ^ words[j : n - width + 1 + j]
        total ^= total >> np.uint64(29)
    return mix(total)


def to_bytes(values: list) -> list[bytes]:
    return [b"" if v is None else v.encode("utf-8", "replace") for v in values]
