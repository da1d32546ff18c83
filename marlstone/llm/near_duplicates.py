"""Near-duplicate records from bottom-k sketches.

Every record is reduced to the set of its runs of three tokens, each run hashed to 64 bits
by one hash function. The k smallest hashes are its sketch. The steps:

1. inverted lists of the retained values give the pairs of sets that overlap; a posting carries
   its set's shared values in 16 bits each, and a pair that can't pass step 2 goes at once;
2. the sketches of a pair, merged to the sketch of its union, estimate the Jaccard
   similarity, and pairs whose estimate is far below the threshold go;
3. the exact Jaccard similarity of the whole sets decides.

Inverted lists are not joined whole. Two sets of similarity 0.6 or more share at least
``k - prefix + 1`` of their retained values but for a chance below one in 10,000 at the
very threshold that falls off steeply above it, so each sketch only needs its ``prefix``
rarest values by document frequency. Values held by one set alone fill the prefix without
being joined, which drops most sets without a partner before any pair is made. Common runs
(licence heads, imports) fall behind the prefix. Records with equal token sets are one set
in all steps and are unfolded at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import materialise, ship

TOKEN = re.compile(r"\w+")
MIN_TOKENS = 20
K = 32
PREFIX = 24
THRESHOLD = 0.6
#: Standard errors that an estimate may lie below the threshold before its pair goes.
SLACK = 5.0
#: Distinct tokens and fingerprints remembered by one task; beyond it the memory starts anew.
REMEMBER = 500_000
#: Pairs compared at a time in a task.
PAIRS = 1 << 14


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > REMEMBER:
            self.clear()
        h = self[token] = xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def run_hashes(tokens: list[str], hashes: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of three tokens, as signed integers."""
    a = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    h = a[:-2] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += a[1:-1]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += a[2:]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def token_runs(records: DataFrame, id_col: str, text_col: str, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, fp, n, first, runs): the run set of each record as little-endian bytes.

    ``fp`` identifies the set, ``first`` marks its first record in a task, which alone need
    go on into the inverted lists. Null and short texts have no row.
    """
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("first", T.BooleanType()), T.StructField("runs", T.BinaryType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        hashes, seen = _TokenHashes(), set()
        for batch in batches:
            ids, fps, ns, firsts, runs = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or text is None:
                    continue
                tokens = TOKEN.findall(text)
                if len(tokens) < max(3, min_tokens):
                    continue
                s = run_hashes(tokens, hashes)
                raw = s.tobytes()
                fp = xxh3_64_intdigest(raw) - (1 << 63)
                ids.append(i)
                fps.append(fp)
                ns.append(len(s))
                firsts.append(fp not in seen)
                runs.append(raw)
                if len(seen) > REMEMBER:
                    seen.clear()
                seen.add(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(runs, pa.binary())],
                names=["id", "fp", "n", "first", "runs"])

    picked = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    ship(records.sparkSession)
    return picked.mapInArrow(work, schema)


def _sketches(sets: DataFrame, k: int) -> DataFrame:
    """(fp, n, value): the retained values, one row each."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("value", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            kept = [np.frombuffer(r, dtype=np.int64, count=min(k, len(r) // 8)) for r in batch.column(2).to_pylist()]
            sizes = [len(x) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(fp, sizes)), pa.array(np.repeat(n, sizes), pa.int32()), pa.array(np.concatenate(kept))],
                names=["fp", "n", "value"])

    return sets.select("fp", "n", "runs").mapInArrow(work, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches that come sorted by their first one, cut only where it changes; binary ones as rows of ``width`` 16-bit numbers."""

    def plain(c: pa.Array) -> np.ndarray:
        if not pa.types.is_binary(c.type) and not pa.types.is_large_binary(c.type):
            return c.to_numpy(zero_copy_only=False)
        return np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), width)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [plain(c) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield rest


def _postings(shared: DataFrame, k: int, prefix: int, width: int) -> DataFrame:
    """(value, fp, n, others): the rarest retained values of each set, with all of its shared ones in 16 bits each.

    ``shared`` has the retained values that more than one set holds, with their document frequency, sorted by set, frequency and value.
    """
    schema = T.StructType([T.StructField("value", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("others", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, n, df, value in _whole_groups(batches, 0):
            once = np.concatenate([[True], (fp[1:] != fp[:-1]) | (value[1:] != value[:-1])])
            fp, n, value = fp[once], n[once], value[once]
            start = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            size = np.diff(np.append(start, len(fp)))
            group = np.repeat(np.arange(len(start)), size)
            place = np.arange(len(fp)) - start[group]
            take = place < prefix - np.maximum(np.minimum(n, k) - size[group], 0)
            if width:
                others = np.zeros((len(start), width), np.uint16)
                others[group, place] = value.view(np.uint64) % np.uint64(65534) + np.uint64(1)
                others = others[group[take]]
            else:
                others = np.empty((int(take.sum()), 0), np.uint16)
            ends = np.arange(len(others) + 1, dtype=np.int32) * np.int32(2 * width)
            packed = pa.Array.from_buffers(pa.binary(), len(others), [None, pa.py_buffer(ends), pa.py_buffer(others.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(value[take]), pa.array(fp[take]), pa.array(n[take], pa.int32()), packed], names=["value", "fp", "n", "others"])

    return shared.mapInArrow(work, schema)


def _overlapping(postings: DataFrame, k: int, threshold: float, slack: float, width: int) -> DataFrame:
    """(a, b), a < b: the pairs within each inverted list that sizes and shared values don't rule out; ``postings`` are sorted by value and n.

    The 16-bit values count at least what is shared, so no pair goes that ``_estimates`` would keep.
    """

    def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, others: np.ndarray) -> np.ndarray:
        lo, hi = n[x].astype(np.float64), n[y].astype(np.float64)
        m = np.minimum(hi, k)
        need = np.where(hi <= k, threshold * (lo + hi) / (1 + threshold), threshold * m - slack * (threshold * (1 - threshold) * m) ** 0.5)
        left, right = np.ascontiguousarray(others[x].T), np.ascontiguousarray(others[y].T)
        right[right == 0] = 65535
        shared = np.zeros(len(x), np.int32)
        for row in left:
            shared += (right == row).any(axis=0)
        return shared >= need - 1e-6

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, fp, n, others in _whole_groups(batches, width):
            end = np.searchsorted(value, value, side="right")
            x, step, wait, waiting = np.arange(len(value)), 0, [], 0
            while len(x) or waiting:
                step += 1
                x = x[x + step < end[x]]
                x = x[n[x] >= (threshold - 1e-9) * n[x + step]]  # the longer ones behind it are no better
                wait.append((x, x + step))
                waiting += len(x)
                if waiting >= PAIRS or not len(x):
                    p, q = (np.concatenate(c) for c in zip(*wait))
                    wait, waiting = [], 0
                    for i in range(0, len(p), PAIRS):
                        px, qx = p[i:i + PAIRS], q[i:i + PAIRS]
                        if width:
                            keep = possible(px, qx, n, others)
                            px, qx = px[keep], qx[keep]
                        a, b = fp[px], fp[qx]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return postings.mapInArrow(work, "a long, b long")


def _estimates(pairs: DataFrame, k: int, threshold: float, slack: float) -> DataFrame:
    """Keeps the pairs whose union sketch doesn't speak against ``threshold``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ra, rb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)
                both = np.sort(np.concatenate([a, b]))
                twice = np.concatenate([both[1:] == both[:-1], [False]])
                union = both[~np.concatenate([[False], both[1:] == both[:-1]])][:k]
                shared = np.count_nonzero(twice & (both <= union[-1]))
                m = len(union)
                keep.append(shared / m >= threshold - slack * (threshold * (1 - threshold) / m) ** 0.5)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(work, "a long, b long")


def _exact(pairs: DataFrame, threshold: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            js = []
            for ra, rb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)
                shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                js.append(shared / (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(js, pa.float64())], names=["a", "b", "jaccard"])

    return pairs.mapInArrow(work, "a long, b long, jaccard double").filter(F.col("jaccard") >= threshold)


def _with_runs(pairs: DataFrame, sets: DataFrame, runs: Column) -> DataFrame:
    side = sets.select("fp", runs.alias("r"))
    return (pairs.join(side.withColumnsRenamed({"fp": "a", "r": "ra"}), "a")
            .join(side.withColumnsRenamed({"fp": "b", "r": "rb"}), "b").select("a", "b", "ra", "rb"))


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, k: int = K, prefix: int = PREFIX, slack: float = SLACK) -> DataFrame:
    """(a, b, jaccard) over different sets, a < b, from the output of ``token_runs``.

    A set that several tasks keep as their first counts once a task in the document frequencies, which only order the values of a sketch.
    """
    first = sets.filter("first")
    post = _sketches(first, k)
    shared = post.withColumn("df", F.count("*").over(Window.partitionBy("value"))).filter("df > 1")
    # without bound on what an estimate may miss, a sketch rules nothing out
    width = k if slack < float("inf") else 0
    rare = _postings(shared.select("fp", "n", "df", "value").repartition("fp").sortWithinPartitions("fp", "df", "value"), k, prefix, width)
    pairs = _overlapping(rare.repartition("value").sortWithinPartitions("value", "n"), k, threshold, slack, width).distinct()
    near = _estimates(_with_runs(pairs, first, F.substring("runs", 1, 8 * k)), k, threshold, slack).distinct()
    near = materialise(near, "near-candidates")
    needed = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return _exact(_with_runs(near, first.join(needed, "fp", "left_semi"), F.col("runs")), threshold).distinct()


def near_duplicate_pairs(records: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD,
                         min_tokens: int = MIN_TOKENS, k: int = K, prefix: int = PREFIX, slack: float = SLACK) -> DataFrame:
    """(id_a, id_b): every pair of different ids, smaller first, whose records are alike.

    Repeated rows of an id count once. A null id or text takes no part, nor does a text of
    fewer than ``min_tokens`` tokens. An empty table gives no rows. Other columns are ignored.
    The search is exact with ``k`` and ``prefix`` at the size of the largest set or above and an infinite ``slack``.
    """
    sets = materialise(token_runs(records, id_col, text_col, min_tokens), "near-runs")
    members = sets.select("id", "fp").distinct()
    alike = similar_sets(sets, threshold, k, prefix, slack).select("a", "b")
    same = members.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    x, y = members.withColumnsRenamed({"id": "x", "fp": "a"}), members.withColumnsRenamed({"id": "y", "fp": "b"})
    pairs = alike.unionByName(same).join(x, "a").join(y, "b").filter("x != y").filter("a != b or x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph (a, b): every node with the least node of its component.

    Alternates large-star and small-star steps, each a shuffle by node with a minimum; every step's table is
    written, so lineage stays short, and only a count of changes comes to the driver.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        nxt = materialise(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct(), "links")
        if not nxt.join(e, ["a", "b"], "left_anti").head(1) and not e.join(nxt, ["a", "b"], "left_anti").head(1):
            break
        e = nxt
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicate_classes(records: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS,
                           k: int = K, prefix: int = PREFIX, slack: float = SLACK) -> DataFrame:
    """(id, class_id, links): one row per record that takes part, with the least id of its class and the number of
    records it is alike to. Records without a partner are a class of their own with no links."""
    sets = materialise(token_runs(records, id_col, text_col, min_tokens), "near-runs")
    members = sets.select("id", "fp").distinct()
    alike = materialise(similar_sets(sets, threshold, k, prefix, slack).select("a", "b"), "alike")
    size = members.groupBy("fp").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    both = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.select(F.col("fp").alias("b"), "size"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("size").alias("others"))
    root = components(alike).withColumnsRenamed({"node": "fp"})
    sets_ = size.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(near, "fp", "left")
    least = sets_.groupBy("root").agg(F.min("least").alias("class_id"))
    facts = sets_.join(least, "root").select("fp", "class_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
    return members.join(facts, "fp").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
