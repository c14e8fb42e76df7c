"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks.

Vectors of one label are normalised, so a cosine is a distance.  Each of ``tables`` hash
tables puts a vector into the bucket of ``k`` random projections, shifted and quantised to
``width``.  Buckets are checked by blocks of matrix products in double precision, so no
link is below the threshold.  A pair counts in the first table in which it meets.

``k`` grows with the logarithm of the largest label, so that buckets stay small, and
``tables`` with it, so that a pair just at the threshold meets with probability
``recall`` (closer ones with a higher one).  Only keys are grouped first: vectors move to
buckets of two or more, which are few.  A bucket of more than ``CHUNK`` vectors is checked in
pairs of chunks, so a hot bucket is dealt over tasks and loses no pair.  What meets in a task
is told apart by label, length, table and bucket themselves, not by hashes of them.  Equal
vectors of a label are one class from the start; copies count in ``n_links`` by number.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components, or whose label is null, has no links and stays; vectors of different length
have no links; labels of any type are compared as text; rows without vec_id are left out; an empty table gives an empty table;
rows that repeat a vec_id are copies of each other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_cells, small_batches, smallest_linked, stored, whole_groups

THRESHOLD = 0.93
RECALL = 0.98
WIDTH = 2.0
LEAST_K = 12
CHUNK = 512
SEED = 20240607


def _meets(distance: float, width: float) -> float:
    """The probability that one projection puts two points at ``distance`` into one interval."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors of one label, most of them about orthogonal."""
    k = max(LEAST_K, math.ceil(math.log(max(n, 2)) / -math.log(_meets(math.sqrt(2), width))))
    p = _meets(math.sqrt(2 - 2 * threshold), width) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # else squares of huge components overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _bucket_keys(unit: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """A 64-bit key per vector and table."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    axes = rng.standard_normal((unit.shape[1], tables * k))
    shift = rng.uniform(0, width, tables * k)
    cell = np.floor((unit @ axes + shift) / width).astype(np.int64).reshape(len(unit), tables, k)
    odd = rng.integers(1, 1 << 63, (tables, k), np.uint64) | np.uint64(1)
    mixed = (cell.view(np.uint64) + np.uint64(1 << 20)) * odd
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed.sum(axis=2, dtype=np.uint64).view(np.int64)


_HASHED = "id long, label string, size int, n long, vector binary, keys binary, key_list array<long>"


def _hash(batches: Iterator[pa.RecordBatch], k: int, tables: int, width: float) -> Iterator[pa.RecordBatch]:
    names = ["id", "label", "size", "n", "vector", "keys", "key_list"]
    for b in batches:
        lists = b.column(3).to_pylist()
        ids, labels, counts = (b.column(i).to_pylist() for i in range(3))
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(lists):
            by_size.setdefault(len(v), []).append(i)
        for size, rows in by_size.items():
            vectors = np.array([lists[i] for i in rows])
            keys = _bucket_keys(_unit(vectors), k, tables, width)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.int64()),
                    pa.array([labels[i] for i in rows], pa.string()),
                    pa.array([size] * len(rows), pa.int32()),
                    pa.array([counts[i] for i in rows], pa.int64()),
                    pa.array([v.astype(np.float32).tobytes() if (v.astype(np.float32) == v).all() else v.tobytes() for v in vectors], pa.binary()),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                ],
                names=names,
            )


def _vector(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * size else np.float64).astype(np.float64)


def _check(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per vector with links in its cell: id, the copies linked there, and the first vector reached."""
    for t in whole_groups(batches, 2048):
        names: dict[str, int] = {}
        labels = np.fromiter((names.setdefault(x, len(names)) for x in t.column("label").to_pylist()), np.int64, t.num_rows)
        keys = [t.column("cell").to_numpy(), labels, *(t.column(c).to_numpy() for c in ("size", "table", "bucket"))]
        order = np.lexsort(keys[::-1])
        t, keys = t.take(pa.array(order)), [k[order] for k in keys]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        ends = np.r_[starts[1:], t.num_rows]
        out: tuple[list, list, list] = ([], [], [])
        for start, end in zip(starts, ends, strict=True):
            if end - start < 2:
                continue
            c = t.slice(start, end - start)
            side, table = c.column("side").to_numpy(), c.column("table")[0].as_py()
            ids, n = c.column("id").to_numpy(), c.column("n").to_numpy()
            size = c.column("size")[0].as_py()
            raw = np.stack([_vector(x, size) for x in c.column("vector").to_pylist()])
            unit = _unit(raw)
            cos = unit @ unit.T
            if side.any():
                a, b = np.nonzero((cos >= threshold - 1e-9) & (side[:, None] < side[None, :]))
            else:
                a, b = np.nonzero(np.triu(cos >= threshold - 1e-9, 1))
            if not len(a):
                continue
            close = np.abs(cos[a, b] - threshold) < 1e-9
            if close.any():  # by the plain definition
                x, y = raw[a[close]], raw[b[close]]
                exact = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                ok = np.ones(len(a), bool)
                ok[close] = exact >= threshold
                a, b = a[ok], b[ok]
            if table:
                keys = np.stack([np.frombuffer(x, np.int64) for x in c.column("keys").to_pylist()])[:, :table]
                new = np.ones(len(a), bool)
                for at in range(0, len(a), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    new[part] = ~(keys[a[part]] == keys[b[part]]).any(axis=1)
            else:
                new = np.ones(len(a), bool)
            add = np.bincount(a[new], n[b[new]], len(ids)) + np.bincount(b[new], n[a[new]], len(ids))
            first = smallest_linked(len(ids), a, b)
            there = (add > 0) | (first != np.arange(len(ids)))
            out[0].extend(ids[there].tolist())
            out[1].extend(add[there].astype(np.int64).tolist())
            out[2].extend(ids[first[there]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "add", "first"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    good = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("good", good)
    classes = stored(
        rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes"
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan_tables(largest, threshold, recall, width)
    hashed = stored(classes.select("id", "label", "n", "embedding").mapInArrow(lambda it: _hash(it, k, tables, width), _HASHED), "vector-keys")
    buckets = hashed.select("id", "label", "size", F.posexplode("key_list").alias("table", "bucket"))
    cells = in_cells(buckets, ["label", "size", "table", "bucket"], "id", CHUNK)
    checked = stored(
        cells.join(hashed.select("id", "n", "vector", "keys"), "id")
        .select("cell", "side", "label", "table", "bucket", "size", "id", "n", "vector", "keys")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(lambda it: _check(it, threshold), "id long, add long, first long"),
        "vector-links",
    )
    roots = components(checked.select(F.col("id").alias("a"), F.col("first").alias("b")))
    links = checked.groupBy("id").agg(F.sum("add").alias("add"))
    found = (
        classes.join(links, "id", "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("label", "embedding", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    linked = rows.where("good").join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE: dict[str, str] = {}
