"""Filling containers of fixed capacity, shortest pack first over the length histogram.

Only the histogram of lengths reaches the driver: at most ``capacity`` numbers, whatever the
number of documents. Lengths are placed longest first. A length goes into the open packs
that are shortest so far, if it fits there, else into new packs; equal packs are one pattern
with a count, so placing n pieces of a length changes a few counts and not n packs. The shortest
packs take as many pieces at once as leave them no longer than the next, or a sixteenth of what fits. Each
placement is written down as a slot: for one length, which ranks go to which containers.
Every document gets the rank of its piece among those of its length, by counts of shares
rather than one sort of a whole length, and joins its slot.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialise, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Shares of a length in ranking, at least; more where there are more documents than so many a share.
SHARES, SHARE_ROWS = 64, 100_000


def token_counts(texts: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens): a null text has 0 tokens."""
    raw = texts.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    ship(texts.sparkSession)
    return texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, tokens long")


def slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, pieces a container) for all pieces.

    Rank r of the length sits in container ``first container + (r - first rank) // pieces``.
    """
    # open packs by free room: runs of containers (first, count)
    room: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []

    def put(left: int, run: tuple[int, int]) -> None:
        if left > 0 and run[1]:
            if left not in room:
                room[left] = []
                heapq.heappush(free, -left)
            room[left].append(run)

    def most() -> int:
        while free and not room.get(-free[0]):
            room.pop(-heapq.heappop(free), None)
        return -free[0] if free else 0

    out, containers = [], 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            have = most()
            if have >= length:
                first, count = room[have].pop()
                use = min(count, left)
                put(have, (first + use, count - use))
                each = max(1, min(max((have - most()) // length, have // length // 16), left // use))
            else:
                have = capacity
                each = max(1, min(capacity // length, left))
                use = max(1, left // each)
                first = containers
                containers += use
            put(have - each * length, (first, use))
            out.append((length, rank, rank + use * each, first, each))
            rank += use * each
            left -= use * each
    zeros = histogram.get(0, 0)
    if zeros:
        each = max(1, -(-zeros // max(containers, 1)))
        out.append((0, 0, zeros, 0, each))
    return out


def packed(counts: DataFrame, limits: DataFrame, shares: int | None = None) -> DataFrame:
    """(limit_id, doc_id, piece, first_token, tokens, container) of (doc_id, tokens).

    Every document is in one container of each capacity, whole unless it is longer: then it is
    cut into full containers and a rest. Documents without tokens, or with null, are spread over the
    containers. Limits without a positive capacity and documents without an id take no part;
    repeated ids are cut to one row first; an empty table gives no rows.
    """
    spark = counts.sparkSession
    counts = counts.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("tokens"))
    caps = {r[0]: r[1] for r in limits.filter("limit_id is not null and capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens")).collect()}
    if not caps:
        return spark.createDataFrame([], "limit_id long, doc_id long, piece int, first_token long, tokens long, container long")
    shares = shares or max(SHARES, counts.count() // SHARE_ROWS)
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    whole = counts.select("doc_id", "tokens", F.explode(F.array(*[F.lit(k) for k in caps])).alias("limit_id"))
    whole = whole.withColumn("cap", cap[F.col("limit_id")]).withColumn("last", F.greatest(F.ceil(F.col("tokens") / F.col("cap")).cast("int") - 1, F.lit(0)))
    pieces = (whole.select("limit_id", "doc_id", "tokens", "cap", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("piece"))
              .select("limit_id", "doc_id", "piece", (F.col("piece") * F.col("cap")).cast("long").alias("first_token"),
                      F.least("cap", F.col("tokens") - F.col("piece") * F.col("cap")).alias("length"),
                      F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int").alias("share")))
    groups = pieces.groupBy("limit_id", "length", "share").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("limit_id", "length").orderBy("share")) - F.col("n")).drop("n")
    hist: dict[int, dict[int, int]] = {}
    for r in groups.groupBy("limit_id", "length").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        hist.setdefault(r[0], {})[r[1]] = r[2]
    rows = [(k, *s) for k, h in hist.items() for s in slots(h, caps[k])]
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 1)], "limit_id long, length long, lo long, hi long, first long, each long")
    ranked = (pieces.withColumn("r", F.row_number().over(Window.partitionBy("limit_id", "length", "share").orderBy("doc_id", "piece")))
              .join(before, ["limit_id", "length", "share"]).withColumn("rank", F.col("r") - 1 + F.col("before")))
    # the slots follow from the histogram, whose size the capacities bound
    return (ranked.join(F.broadcast(plan), ["limit_id", "length"]).filter("rank >= lo and rank < hi")
            .select(F.col("limit_id").cast("long").alias("limit_id"), "doc_id", F.col("piece").cast("int").alias("piece"), "first_token", F.col("length").alias("tokens"),
                    (F.col("first") + F.expr("(rank - lo) div each")).alias("container")))


def pack_documents(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``packed`` over the token counts of (doc_id, text)."""
    return packed(materialise(token_counts(documents, "doc_id", "text", vocabulary), "token-counts"), limits)


def packing_facts(packs: DataFrame, counts: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, documents, torn, over, loose): of each capacity the documents packed, those that are cut without need or whose
    pieces don't add up, the containers above the capacity, and whether more than a fiftieth of the room is left unused
    beyond the last container."""
    whole = packs.groupBy("limit_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("sum"), F.count_distinct("piece").alias("places"))
    caps = limits.groupBy("limit_id").agg(F.max("capacity_tokens").alias("cap"))
    checked = whole.join(caps, "limit_id").join(counts.groupBy("doc_id").agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("all")), "doc_id")
    torn = (F.col("sum") != F.col("all")) | (F.col("pieces") != F.greatest(F.ceil(F.col("all") / F.col("cap")), F.lit(1))) | (F.col("places") != F.col("pieces"))
    docs = checked.groupBy("limit_id").agg(F.count("*").alias("documents"), F.sum(torn.cast("long")).alias("torn"))
    boxes = packs.groupBy("limit_id", "container").agg(F.sum("tokens").alias("held")).join(caps, "limit_id")
    full = boxes.groupBy("limit_id").agg(F.sum((F.col("held") > F.col("cap")).cast("long")).alias("over"), F.count("*").alias("boxes"), F.sum("held").alias("held"), F.max("cap").alias("cap"))
    return docs.join(full, "limit_id").select("limit_id", "documents", "torn", "over", (F.col("boxes") > F.ceil(F.col("held") / F.col("cap") * 1.02) + 1).alias("loose"))
