"""The most similar vectors of every vector by multi-index hashing.

1. **Learn.** On a bounded sample of distinct vectors (``SAMPLE``) rotations are fitted by
   iterative quantisation, so that the signs of the rotated coordinates, one bit each, keep
   angles; and centres for step 4. Every vector is coded; none is left out.
2. **Index.** The code is cut into substrings whose length follows the logarithm of the number of vectors, so a
   bucket holds about as many at every size. By pigeonhole, two codes within ``3 * tables - 1`` bits of
   one another are within two bits in some substring. There are ``TABLES`` of them, or more where a sample
   of queries (``QUERIES``), compared with all vectors, shows that these find less than ``TARGET`` of the
   true neighbours.
3. **Probe.** Each substring is filed under itself and all strings one bit away. Two
   substrings within two bits then meet under a common key: half of the reach is paid by
   either side. Codes of a bucket are compared by exclusive-or and bit count; a pair counts
   in its first table and least common key only, so no pair comes out twice.
4. **Rerank.** Pairs within ``RADIUS`` of the bits are scored by the cosine of the floats. Vectors
   travel by cell: a vector goes to its own cell and once to every other cell that needs it,
   rather than once per pair. Large cells are split by the pair's first vector.

Buckets of more than about ``HOT`` codes (dense groups of vectors) are cut into blocks, and every pair of
blocks is a group of its own that is scored by floats at once and gives on the best of each vector only, so
neither a task nor the output grows with the square of a bucket. Vectors that find fewer than ``k``
are probed again with shorter substrings, against all codes; what is then still short, as where all is far from all, is
compared with all vectors in blocks.

Vectors that are equal after scaling are one vector in steps 2 to 4; they get each other as
neighbours from their ids alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialise, ship

WIDTH = 64
#: Vectors that the rotations and the centres are fitted on, at most.
SAMPLE = 20_000
#: Vectors of the sample whose true neighbours are looked up to choose the number of tables.
QUERIES = 400
#: Share of true neighbours that the tables must find; tables at least and at most.
TARGET, TABLES, MOST = 0.98, 6, 12
#: Codes that share a substring, on average, as a power of two.
SHARED = 1
#: Pairs of codes that differ in more than this share of the bits aren't reranked.
RADIUS = 17 / 64
#: Vectors a cell should hold; pairs of one cell are scored by one task. Beyond ``CENTRES`` cells are cut by bits of the code.
CELL = 4_000
CELLS, CENTRES = 8, 64
#: Pairs that one task scores; cells with more are split by the pair's first vector.
PAIRS = 500_000
#: Codes of one bucket that are compared in one go; larger buckets are cut into blocks of about ``BLOCK``.
HOT, BLOCK = 4_096, 1_024
#: Bits that the second probing of lonely vectors takes off each substring.
SHORTER = 4
ROUNDS = 30


def usable(rows: DataFrame, id_col: str, vec_col: str, width: int = WIDTH) -> DataFrame:
    """(id, vec): the rows with an id and a vector of ``width`` finite floats, not all zero, scaled to
    length 1. Bytes are float32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            col = batch.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat, at = col.values, col.offsets.to_numpy()
            good = np.flatnonzero((sizes == width) & ~col.is_null().to_numpy(zero_copy_only=False) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False))
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            m = values[at[good][:, None] + np.arange(width)] if len(good) else np.zeros((0, width))
            top = np.abs(m).max(axis=1, initial=0)
            ok = np.isfinite(m).all(axis=1) & (top > 0)
            m = m[ok] / top[ok][:, None]
            m = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
            ids = batch.column(0).take(pa.array(good[ok]))
            raw = m.tobytes()
            vecs = pa.array([raw[i:i + 4 * width] for i in range(0, len(raw), 4 * width)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vecs], names=["id", "vec"])

    ship(rows.sparkSession)
    return (rows.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
            .mapInArrow(work, "id string, vec binary"))


def rotation(sample: np.ndarray, seed: int = 7, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (iterative quantisation) whose signs are 64 bits of the code."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return mean, r


def centres(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = sample[near == j]
            if len(own) and (n := np.linalg.norm(s := own.sum(axis=0))) > 0:
                c[j] = s / n
    return c


def substring_length(total: int) -> int:
    return min(40, max(4, round(math.log2(max(total, 2))) - SHARED))


def words_of(tables: int, size: int) -> int:
    """64-bit words of a code with so many substrings."""
    return -(-tables * size // 64)


def codes_of(x: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray]) -> list[np.ndarray]:
    """Codes of vectors, one array of 64-bit words for each rotation."""
    return [np.packbits((x - mean) @ r > 0, axis=1, bitorder="little").view(np.uint64).ravel() for r in rotations]


def substring(code: list[np.ndarray], t: int, size: int) -> np.ndarray:
    w, at = divmod(t * size, 64)
    v = code[w] >> np.uint64(at)
    if at + size > 64:
        v = v | (code[w + 1] << np.uint64(64 - at))
    return v & np.uint64((1 << size) - 1)


def differ(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b))


def meet(a: list[np.ndarray], b: list[np.ndarray], tables: int, size: int) -> np.ndarray:
    """Which pairs of codes are within two bits in some substring."""
    diff = [x ^ y for x, y in zip(a, b)]
    return np.any([np.bitwise_count(substring(diff, t, size)) <= 2 for t in range(tables)], axis=0)


def table_count(queries: np.ndarray, near: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], size: int) -> tuple[int, float]:
    """(tables, share of pairs found): the least number of tables that finds ``TARGET`` of pairs of true neighbours."""
    a, b = codes_of(queries, mean, rotations), codes_of(near, mean, rotations)
    for tables in range(TABLES, MOST + 1):
        w = words_of(tables, size)
        share = float(np.mean(meet(a[:w], b[:w], tables, size) & (differ(a[:w], b[:w]) <= RADIUS * 64 * w))) if len(queries) else 1.0
        if share >= TARGET:
            break
    return tables, share


def _keys(code: list[np.ndarray], tables: int, size: int, shorter: int = 0, flip: bool = True) -> np.ndarray:
    """One row a code: its substrings and, with ``flip``, all strings one bit away, each with the number of its table."""
    out = []
    for t in range(tables):
        s = (substring(code, t, size) & np.uint64((1 << (size - shorter)) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(size - shorter, dtype=np.int64)]) if flip else np.zeros(1, np.int64)
        out.append(((s[:, None] ^ flips[None, :]) << 5) | t)
    return np.concatenate(out, axis=1)


def _probes(codes: DataFrame, names: list[str], tables: int, size: int, shorter: int = 0, flip: bool = True) -> DataFrame:
    """(key, vid, cell, words of the code): each code under its keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vid, cell, *code = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            k = _keys([c.view(np.uint64) for c in code], tables, size, shorter, flip)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), *(pa.array(np.repeat(c, k.shape[1])) for c in (vid, cell, *code))], names=["key", "vid", "cell", *names])

    return codes.select("vid", "cell", *names).mapInArrow(work, "key long, vid long, cell long, " + ", ".join(f"{c} long" for c in names))


def _met(keys: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], size: int) -> np.ndarray:
    """Of pairs of codes that meet under a key: is it in their first table and least common key?"""
    ok = np.ones(len(keys), dtype=bool)
    table, k = keys & 31, (keys >> 5).astype(np.uint64)
    diff = [a ^ b for a, b in zip(x, y)]
    for t in np.unique(table).tolist():
        here = np.flatnonzero(table == t)
        d = [v[here] for v in diff]
        good = np.ones(len(here), dtype=bool)
        for before in range(t):
            good &= np.bitwise_count(substring(d, before, size)) > 2
        sx, sd = substring([v[here] for v in x], t, size), substring(d, t, size)
        low = sd & (~sd + np.uint64(1))
        both = np.bitwise_count(sd)
        # common keys: itself and its neighbours if equal, either end if one bit apart, either midpoint if two
        end = np.minimum(sx, sx ^ sd)
        mid = np.minimum(sx ^ low, sx ^ (sd ^ low))
        ok[here] = good & (np.where(both == 0, sx, np.where(both == 1, end, mid)) == k[here])
    return ok


def _candidates(probes: DataFrame, words: int, size: int) -> DataFrame:
    """(a, ca, b), a < b: pairs within the radius that share a key; rows come sorted by key.

    All buckets of a batch are compared at once: each row with the next, then with the one after it, as long as keys are equal.
    """
    radius = int(RADIUS * 64 * words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, vid, cell = rows[:3]
            code = [c.view(np.uint64) for c in rows[3:]]
            out, held, step = [], 0, 1
            here = np.arange(len(keys))
            while len(here):
                here = here[here + step < len(keys)]
                here = here[keys[here] == keys[here + step]]
                i = here[differ([c[here] for c in code], [c[here + step] for c in code]) <= radius]
                i = i[_met(keys[i], [c[i] for c in code], [c[i + step] for c in code], size)]
                j = i + step
                swap = vid[i] > vid[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                if len(a):
                    out.append((vid[a], cell[a], vid[b]))
                    held += len(a)
                if held > 200_000:
                    yield pack(out)
                    out, held = [], 0
                step += 1
            if out:
                yield pack(out)

        def pack(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "ca", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[last:] for x in rows]
            if last:
                yield from done([x[:last] for x in rows])
        if rest is not None:
            yield from done(rest)

    return probes.mapInArrow(work, "a long, ca long, b long")


def _hot_keys(codes: DataFrame, names: list[str], tables: int, size: int, hot: int) -> DataFrame:
    """(key, blocks): buckets of more than about ``hot`` codes, from the counts of frequent substrings alone.

    A bucket that isn't found holds at most twice ``hot``: what lies in substrings too rare to be counted is less than ``hot`` in all.
    """
    exact = _probes(codes, names, tables, size, flip=False).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= hot // (size + 1))
    near = exact.select("n", F.explode(F.concat(F.array("key"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(32).cast("long"), i.cast("int")))))).alias("key"))
    return near.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def _hot_scored(rows: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """(vid, other, cos) of (key, vid, blocks): the ``k`` best of each vector within each pair of blocks of a hot bucket."""
    b = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("blocks")).cast("int")
    held = rows.select("key", "vid", "blocks", b.alias("own"))
    # a row goes to the pairs of its own block and every block: own first where it is the smaller number
    sent = held.select("key", "vid", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    sent = sent.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "vid", "own").join(vecs.select("vid", "vec"), "vid")

    def score(part: pd.DataFrame) -> pd.DataFrame:
        vid, own = part["vid"].to_numpy(), part["own"].to_numpy()
        m = np.frombuffer(b"".join(part["vec"]), dtype=np.float32).reshape(len(vid), -1).astype(np.float64)
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        for x, y in ((left, right),) if i == j else ((left, right), (right, left)):
            if not len(x) or not len(y):
                continue
            cos = m[x] @ m[y].T
            cos[vid[x][:, None] == vid[y][None, :]] = -9
            c = min(k, len(y))
            top = np.argpartition(-cos, c - 1, axis=1)[:, :c]
            val = np.take_along_axis(cos, top, axis=1)
            keep = val > -9
            found.append((np.repeat(vid[x], c).reshape(-1, c)[keep], vid[y][top][keep], val[keep]))
        a, o, c = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"vid": a, "other": o, "cos": c})

    return sent.groupBy("key", "i", "j").applyInPandas(score, "vid long, other long, cos double")


def _best(key: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of greatest cosine of each key."""
    o = np.lexsort((other, -cos, key))
    key, other, cos = key[o], other[o], cos[o]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    place = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return key[place < k], other[place < k], cos[place < k]


def _scored(pairs: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """(vid, other, cos) of written pairs (a, ca, b), both ways. Work is grouped by a's cell and, in large cells, a share
    of its vectors; a group gives on no more than the ``k`` best of each vector."""
    split = pairs.groupBy("ca").agg(F.ceil(F.count("*") / F.lit(PAIRS)).cast("long").alias("parts"))
    pairs = pairs.join(split, "ca").withColumn("part", F.pmod(F.col("a"), F.col("parts"))).select("ca", "part", "a", "b")
    wants = pairs.select("ca", "part", F.explode(F.array("a", "b")).alias("vid")).distinct()
    sent = wants.join(vecs.select("vid", "vec"), "vid").select("ca", "part", "vid", "vec").toDF("to_cell", "to_part", "vid", "vec")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"vid": [], "other": [], "cos": []}).astype({"vid": "int64", "other": "int64", "cos": "float64"})
        right = right.sort_values("vid")
        vids = right["vid"].to_numpy()
        m = np.frombuffer(b"".join(right["vec"]), dtype=np.float32).reshape(len(vids), -1)
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        ia, ib = np.searchsorted(vids, a), np.searchsorted(vids, b)
        cos = np.concatenate([np.einsum("ij,ij->i", m[ia[o:o + 20_000]].astype(np.float64), m[ib[o:o + 20_000]].astype(np.float64)) for o in range(0, len(ia), 20_000)])
        x, y, c = (np.concatenate(z) for z in zip(_best(a, b, cos, k), _best(b, a, cos, k)))
        x, y, c = _best(x, y, c, k)
        return pd.DataFrame({"vid": x, "other": y, "cos": c})

    return pairs.groupBy("ca", "part").cogroup(sent.groupBy("to_cell", "to_part")).applyInPandas(score, "vid long, other long, cos double")


def _digest(x: np.ndarray) -> list[int]:
    """Names of vectors: equal ones have one name."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(r) - (1 << 63) for r in np.round(x * 1e5).astype(np.int32)]


def true_neighbours(base: DataFrame, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, neighbours), row by row: the ``k`` nearest other vectors of each query, by one pass over all vectors in which
    a batch gives on no more than ``k`` a query."""
    shared = base.sparkSession.sparkContext.broadcast((queries, np.array(_digest(queries))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        vecs: dict[int, bytes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(0).to_pylist()
            m = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), -1)
            cos = q.astype(np.float32) @ m.T
            c = min(4 * k, len(raw))
            top = np.argpartition(-cos, c - 1, axis=1)[:, :c]
            pick = np.unique(top)
            name = dict(zip(pick.tolist(), _digest(m[pick])))
            other = np.array([[name[j] for j in row] for row in top.tolist()])
            ok = other != own[:, None]
            x = np.repeat(np.arange(len(q)), c).reshape(-1, c)[ok]
            vecs.update((name[j], raw[j]) for j in pick.tolist())
            o, v = other[ok], np.take_along_axis(cos, top, axis=1)[ok].astype(np.float64)
            first = np.unique(np.stack([x, o]), axis=1, return_index=True)[1]
            both = [np.concatenate(z) for z in zip(best, (x[first], o[first], v[first]))]
            first = np.unique(np.stack(both[:2]), axis=1, return_index=True)[1]
            best = _best(*(z[first] for z in both), k)
            vecs = {j: vecs[j] for j in set(best[1].tolist())}
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array([vecs[j] for j in best[1].tolist()], pa.binary())], names=["q", "other", "cos", "vec"])

    found = base.select("vec").mapInArrow(work, "q long, other long, cos double, vec binary").dropDuplicates(["q", "other"])
    rows = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "other"))).filter(F.col("r") <= k).select("q", "vec").collect()
    if not rows:
        return queries[:0], queries[:0]
    return queries[[r[0] for r in rows]], np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)


def similar_vectors(rows: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = 5, width: int = WIDTH, hot: int = HOT, report: dict | None = None) -> DataFrame:
    """(id, other, cos, place): the ``k`` vectors most alike to every usable vector, ties by smaller id.

    Null, zero, non-finite and otherwise wide vectors take no part, nor do null ids. Repeated
    rows of an id count once (of different vectors, the one of least hash), the same vector under several ids is several neighbours. An empty
    table gives no rows; other columns are ignored. Searching is approximate: a neighbour whose
    code differs in more than ``RADIUS`` of its bits, or that shares no key, is missed. A vector for which
    probing finds fewer than ``k`` is probed again with shorter substrings, and compared with all if that doesn't do, so each has
    its ``k`` if the table does. ``width`` is a multiple of 64. ``report`` takes the numbers of vectors, bits and tables, the share
    of true neighbours that the tables find by the sample, and the numbers of vectors that were probed again and compared with all.
    """
    spark = rows.sparkSession
    report = {} if report is None else report
    base = usable(rows, id_col, vec_col, width)
    total = base.count()
    if total == 0:
        return spark.createDataFrame([], "id string, other string, cos double, place int")
    drawn = (base.select("vec").sample(False, min(1.0, 1.2 * SAMPLE / total), 3).limit(SAMPLE) if total > SAMPLE else base.select("vec")).toPandas()["vec"]
    sample = np.frombuffer(b"".join(drawn), dtype=np.float32).reshape(-1, width).astype(np.float64)
    size = substring_length(total)
    fitted = [rotation(sample, 7 + i) for i in range(words_of(MOST, size))]
    mean = fitted[0][0]
    queries, near = true_neighbours(base, np.unique(sample, axis=0)[:: max(1, len(sample) // QUERIES)], k)
    tables, share = table_count(queries, near, mean, [r for _, r in fitted], size)
    words = words_of(tables, size)
    turns = [r for _, r in fitted[:words]]
    report.update(vectors=total, bits=size, tables=tables, share=share)
    cells = max(CELLS, min(CENTRES, math.ceil(total / CELL)))
    mid, cuts = centres(sample, cells), max(0, math.ceil(math.log2(max(1.0, total / CELL / CENTRES))))
    model = spark.sparkContext.broadcast((mean, turns, mid))
    names = [f"code{i}" for i in range(words)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turns, mid = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
            code = codes_of(x, mean, turns)
            cell = ((x @ mid.T).argmax(axis=1).astype(np.int64) << cuts) | (code[0] & np.uint64((1 << cuts) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_digest(x), pa.int64()), pa.array(cell), *(pa.array(c.view(np.int64)) for c in code)], names=["id", "vec", "vid", "cell", *names])

    coded = materialise(base.mapInArrow(encode, "id string, vec binary, vid long, cell long, " + ", ".join(f"{c} long" for c in names)), "vector-codes")
    members = coded.groupBy("id").agg(F.min("vid").alias("vid"))
    # copies: the k+1 least ids of a group serve all its members and all its neighbours
    heads = _least_ids(members, k + 1)
    # one row a group; codes and vectors apart, so that vectors are shuffled once
    codes = coded.select("vid", "cell", *names).dropDuplicates(["vid"]).join(members.select("vid").distinct(), "vid", "left_semi")
    single = coded.select("vid", "vec").dropDuplicates(["vid"])
    big = materialise(_hot_keys(codes, names, tables, size, hot), "hot-buckets")
    crowded = bool(big.head(1))
    probes = _probes(codes, names, tables, size)
    few = probes.join(big, "key", "left_anti") if crowded else probes
    pairs = materialise(_candidates(few.repartition("key").sortWithinPartitions("key"), words, size), "vector-pairs")
    scored = _scored(pairs, single, k)
    if crowded:
        both = scored.unionByName(_hot_scored(probes.join(big, "key").select("key", "vid", "blocks"), single, k))
        # the same pair from two buckets can differ in the last bit
        scored = both.groupBy("vid", "other").agg(F.max("cos").alias("cos"))
    best = materialise(_nearest(scored, k), "vector-best")
    full = F.size("near") >= min(k, total - 1)
    lost = materialise(codes.join(best.filter(full).select("vid"), "vid", "left_anti"), "lonely-vectors")
    report.update(hot=big.count() if crowded else 0, lonely=lost.count(), compared=0)
    if report["lonely"]:
        shorter = min(SHORTER, size - 1)
        wide = _probes(lost, names, tables, size, shorter).select("key", F.col("vid").alias("a"), F.col("cell").alias("ca"))
        there = _probes(codes, names, tables, size, shorter, False).select("key", F.col("vid").alias("b"), F.col("cell").alias("cb"))
        again = wide.join(there, "key").filter("a != b").select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.greatest("a", "b").alias("b"))
        again = materialise(again.distinct(), "wider-pairs")
        own = lost.select("vid")
        found = materialise(_nearest(_scored(again, single, k).join(own, "vid", "left_semi"), k), "wider-best")
        left = materialise(own.join(found.filter(full).select("vid"), "vid", "left_anti"), "left-vectors")
        report["compared"] = left.count()
        if report["compared"]:
            scanned = _nearest(_by_blocks(single.join(left, "vid", "left_semi"), report["compared"], single.join(codes.select("vid"), "vid", "left_semi"), total, k), k)
            found = found.join(left, "vid", "left_anti").unionByName(scanned)
        best = best.join(own, "vid", "left_anti").unionByName(found)
    others = (best.select(F.col("vid").alias("a"), F.explode("near").alias("n")).select("a", (-F.col("n.d")).alias("cos"), F.col("n.vid").alias("vid"))
              .join(heads, "vid").select("a", "cos", F.explode("ids").alias("other")))
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "other")
    others = others.withColumn("p", F.row_number().over(w)).filter(F.col("p") <= k).select(F.col("a").alias("vid"), "cos", "other")
    own = heads.filter(F.size("ids") > 1).select("vid", F.lit(1.0).alias("cos"), F.explode("ids").alias("other"))
    pool = others.unionByName(own).groupBy("vid").agg(F.collect_list(F.struct((-F.col("cos")).alias("d"), "other")).alias("pool"))
    out = members.select("id", "vid").join(pool, "vid").select("id", F.posexplode(F.slice(F.sort_array(F.filter("pool", lambda x: x["other"] != F.col("id"))), 1, k)))
    return out.select("id", F.col("col.other").alias("other"), (-F.col("col.d")).alias("cos"), (F.col("pos") + 1).alias("place"))


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    """(vid, near): the ``k`` best of each vector, as structs of negative cosine and vid."""
    return scored.groupBy("vid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("d"), F.col("other").alias("vid")))), 1, k).alias("near"))


def _by_blocks(queries: DataFrame, count: int, vecs: DataFrame, total: int, k: int, block: int = 2_048, slice_: int = 32_768) -> DataFrame:
    """(vid, other, cos): exact neighbours of the vectors that both probings left with fewer than ``k``.

    Queries are cut into blocks and all vectors into slices; each block meets each slice in a group of its own,
    which gives on the ``k`` best of each query.
    """
    blocks, slices = math.ceil(count / block), math.ceil(total / slice_)
    part = lambda col, n: F.pmod(F.xxhash64(col, F.lit(2)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(part("vid", blocks).alias("i"), every(slices).alias("j"), "vid", "vec")
    v = vecs.select(every(blocks).alias("vi"), part("vid", slices).alias("vj"), F.col("vid").alias("other"), F.col("vec").alias("there"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"vid": [], "other": [], "cos": []}).astype({"vid": "int64", "other": "int64", "cos": "float64"})
        a, b = left["vid"].to_numpy(), right["other"].to_numpy()
        m, n = (np.frombuffer(b"".join(side), dtype=np.float32).reshape(len(side), -1).astype(np.float64) for side in (left["vec"], right["there"]))
        cos = m @ n.T
        cos[a[:, None] == b[None, :]] = -9
        c = min(k, len(b))
        top = np.argpartition(-cos, c - 1, axis=1)[:, :c]
        val = np.take_along_axis(cos, top, axis=1)
        keep = val > -9
        return pd.DataFrame({"vid": np.repeat(a, c).reshape(-1, c)[keep], "other": b[top][keep], "cos": val[keep]})

    return q.groupBy("i", "j").cogroup(v.groupBy("vi", "vj")).applyInPandas(score, "vid long, other long, cos double")


def _least_ids(members: DataFrame, k: int) -> DataFrame:
    """(vid, ids): the ``k`` least ids of each group, cut down in shares first so that no task holds a large group."""
    share = members.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(256)))
    one = share.groupBy("vid", "share").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k).alias("ids")).select("vid", "ids")
    return one.groupBy("vid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))


def neighbour_pairs(rows: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = 5, width: int = WIDTH, report: dict | None = None) -> DataFrame:
    """(id_a, id_b), smaller id first: pairs of which one is among the ``k`` most alike of the other."""
    near = similar_vectors(rows, id_col, vec_col, k, width, report=report)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
