"""Evaluation passages inside a training corpus, found by winnowing.

A text becomes a stream of units: its words (longest runs of letters or digits, in folded
case and one encoding of accents), or, for Chinese and Japanese items, its single letters
and digits. Each stream is hashed by k-grams, and of every window of w neighbouring k-grams
the least hash is kept. Two texts that share ``k + w - 1`` successive units share a window,
so they share a kept hash: no shared span of the wanted length can be missed. Kept hashes
of corpus and items are joined, and each hit is extended to both sides unit by unit; spans
that stay too short go.

The corpus side is thinned where it is read by a bitmap of the items' hashes. Its size is
fixed, whatever the number of items; what it wrongly lets through meets no item in the join.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialise, ship

WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:nbsp|shy|zwnj|zwj);|[­​-‍⁠﻿]")
# of folded text, in which half-width kana and squared signs have become ordinary ones
EAST_ASIAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: (k, w): spans of k + w - 1 units are found for certain.
WORDS, CHARS = (8, 6), (20, 11)
#: Bits of the bitmap that thins the corpus side (16 MB), and hashes beyond which it would let too much through and is left out.
BITS, MOST_MARKS = 27, 1 << 24
REMEMBER = 500_000
SEP = "\x1f"


def folded(text: str) -> str:
    if not text.isascii() or "<" in text or "&" in text:
        text = MARKUP.sub(lambda m: " " if m[0][0] in "<&" and m[0] != "&shy;" else "", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return text
    return text.lower()


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on, by doubling; the last k-1 places are left out."""
    parts, size, at, done = [], 1, units, 0
    base = 0x9E3779B97F4A7C15
    while size <= k:
        if k & size:
            parts.append((size, at))
        nxt = at[:-size] * np.uint64(pow(base, size, 1 << 64)) + at[size:] if size * 2 <= k else at
        at, size = nxt, size * 2
    n = len(units) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for size, h in reversed(parts):
        total = total * np.uint64(pow(base, size, 1 << 64)) + h[done:done + n]
        done += size
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some window of w neighbours."""
    n = len(hashes)
    if n <= w:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, dtype=np.int64)
    least = hashes[:n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, hashes[i:n - w + 1 + i], out=least)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = padded[:n].copy()
    for i in range(1, w):
        np.maximum(most, padded[i:n + i], out=most)
    return np.flatnonzero(most == hashes)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > REMEMBER:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


SCHEMA = "id long, chars boolean, fp long, ctx string, lead int"


def fingerprints(texts: DataFrame, bitmap: dict | None = None, chars: str = "item") -> DataFrame:
    """(id, chars, fp, ctx, lead) of (id, text, is_char): kept hashes with the units around them.

    ``ctx`` holds up to k+w-1 units to either side and ``lead`` how many come before the
    k-gram. ``chars``: which streams a text gets: "item" one, by is_char; "auto" words, and
    letters where East Asian text occurs; "both" both.
    """

    def stream(out: list, ids: list, unit_lists: list, is_char: bool, hashes: _Hashes, held: np.ndarray | None) -> None:
        k, w = CHARS if is_char else WORDS
        span = k + w - 1
        pick = [(i, u) for i, u in zip(ids, unit_lists) if len(u) >= span]
        if not pick:
            return
        sizes = np.array([len(u) for _, u in pick])
        if is_char:
            units = np.frombuffer("".join(u for _, u in pick).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            units = units * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        else:
            units = np.concatenate([np.fromiter(map(hashes.__getitem__, u), dtype=np.uint64, count=len(u)) for _, u in pick])
        ends = np.cumsum(sizes)
        h = grams(units, k)
        valid = np.ones(len(units), dtype=bool)
        for back in range(1, k):
            valid[ends - back] = False
        valid = valid[:len(h)]
        h[~valid] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at, signed = winnowed(h, w), h.view(np.int64)
        at = at[valid[at]]
        if held is not None and len(at):
            bit = h[at] & np.uint64((1 << BITS) - 1)
            at = at[(held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        doc = np.searchsorted(ends, at, side="right")
        for p, d in zip(at.tolist(), doc.tolist()):
            i, u = pick[d]
            q = p - int(ends[d] - sizes[d])
            lead = min(q, span)
            part = u[q - lead:q + k + span]
            out.append((i, is_char, int(signed[p]), part if is_char else SEP.join(part), lead))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = _Hashes(), None
        if bitmap is not None:
            held = np.frombuffer(zlib.decompress(bitmap["at"].value), np.uint8)
        for batch in batches:
            ids, words, cids, letters = [], [], [], []
            for i, text, is_char in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if i is None or not text:
                    continue
                plain = folded(text)
                u = WORD.findall(plain)
                if chars != "item" or not is_char:
                    ids.append(i)
                    words.append(u)
                if is_char if chars == "item" else chars == "both" or EAST_ASIAN.search(plain):
                    cids.append(i)
                    letters.append("".join(u))
            out: list = []
            stream(out, ids, words, False, hashes, held)
            stream(out, cids, letters, True, hashes, held)
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int32()))],
                names=["id", "chars", "fp", "ctx", "lead"])

    ship(texts.sparkSession)
    return texts.mapInArrow(work, SCHEMA)


def _bitmap(marks: DataFrame) -> dict | None:
    """The items' hashes as a bitmap of fixed size, sent packed; none if there are too many of them."""
    spark = marks.sparkSession
    bits = marks.select(F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("bit")).distinct()
    if marks.count() > MOST_MARKS:
        return None
    at = bits.toPandas()["bit"].to_numpy(np.int64)
    held = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return {"at": spark.sparkContext.broadcast(zlib.compress(held.tobytes(), 1))}


def _extended(hits: DataFrame) -> DataFrame:
    """Pairs whose hit grows to the wanted length in both texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, seen = [], [], set()
            for d, i, is_char, x, lx, y, ly in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (d, i) in seen:
                    continue
                k, w = CHARS if is_char else WORDS
                if not is_char:
                    x, y = x.split(SEP), y.split(SEP)
                if x[lx:lx + k] != y[ly:ly + k]:
                    continue
                a = 0
                while a < lx and a < ly and x[lx - 1 - a] == y[ly - 1 - a]:
                    a += 1
                b, bx, by = 0, lx + k, ly + k
                while bx + b < len(x) and by + b < len(y) and x[bx + b] == y[by + b]:
                    b += 1
                if a + k + b >= k + w - 1:
                    seen.add((d, i))
                    docs.append(d)
                    items.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return hits.mapInArrow(work, "doc_id long, item_id long")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents (doc_id, text) that hold 13 successive words of an item
    (item_id, lang, text), or 30 letters of a Chinese or Japanese one.

    Null ids and null, blank or shorter texts take no part; repeated rows give one row, equal
    texts under other ids count each; empty tables give none. Other columns are ignored.
    """
    east = F.coalesce(F.lower("lang").rlike("^(zh|ja)"), F.lit(False))
    own = items.select(F.col("item_id").alias("id"), "text", east.alias("is_char")).filter("text is not null")
    marks = materialise(fingerprints(own).distinct(), "leak-items")
    # a letters item with a wholly Latin span needs the letters of every document
    latin = own.filter("is_char").filter(F.regexp_replace("text", r"[^\p{L}\p{N}]", "").rlike(r"[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}]{30}"))
    mode = "both" if latin.head(1) else "auto"
    docs = documents.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("is_char"))
    found = materialise(fingerprints(docs, _bitmap(marks), mode).withColumn("place", F.xxhash64("chars", "fp", "ctx", "lead")), "leak-places")
    # a passage that many documents hold has the same units around it in them, and is extended once for all
    places = found.groupBy("place").agg(*[F.min(c).alias(c) for c in ("chars", "fp", "ctx", "lead")])
    hits = places.alias("d").join(marks.alias("m"), ["fp", "chars"]).select(
        "place", F.col("m.id"), "chars", F.col("d.ctx"), F.col("d.lead"), F.col("m.ctx"), F.col("m.lead"))
    grown = _extended(hits.toDF("doc_id", "item_id", "chars", "x", "lx", "y", "ly")).distinct().withColumnRenamed("doc_id", "place")
    return found.select("id", "place").join(grown, "place").select(F.col("id").alias("doc_id"), "item_id").distinct()
