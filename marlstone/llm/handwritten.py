"""Generated, minified, vendored and data files, by a random forest on the shape of the text.

Labels are what a file itself declares: a notice in its header comments, a name that only tools give
(``*_pb2.py``, ``*.min.js``), or a text that is tables of values from end to end. The features never see
a declaration: header comments and names are taken off first, and the features are shares and averages of
what is left (compression ratio, token entropy, identifier lengths, comment density and the like).

Most tool-made files declare nothing, so a file without a declaration isn't a sure negative. The forest is
therefore grown twice: the first, declared against all others, finds the others that look declared at
least now and then; the second leaves these out of its negatives. Its vote decides on all files.

A copy of somebody's hand-written file looks like any hand-written file. Copies are cases by what they declare
alone, a notice or a folder of a package manager, and take no part in learning.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import materialise, ship

#: Rows the forests are grown on, at most; every file is then judged.
SAMPLE = 20_000
TREES, DEPTH = 24, 8
#: An undeclared file whose first vote is at least this is no negative of the second forest.
DOUBT = 0.15

# Wordings of notices in headers.
NOTICE = re.compile(
    r"DO NOT (?:EDIT|MODIFY|CHANGE)\b|@generated\b|<auto-?generated|\bAUTO-?GENERATED\b|\b(?:[Cc]ode|[Ff]ile|[Tt]his) (?:was |is )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with)\b"
    r"|\b[Aa]uto-?generated (?:from|by|with|file|code)\b|\bautomatically (?:generated|produced|created|written) (?:by|from)\b|\b[Gg]enerated by (?:the )?[\w.-]+"
    r"|\b[Mm]achine[- ](?:written|generated)\b|do not modify by hand|changes will be lost|regenerate it instead"
    r"|automatisch (?:von|durch|mit) \S+ (?:erzeugt|generiert|erstellt)|nicht (?:von Hand )?bearbeite[tn]|ne doit pas être modifié|(?:produit|généré)e? (?:automatiquement )?par"
    r"|(?:generado|creado) (?:automáticamente )?por|[Nn]o (?:editar|modificar)\b|сгенерирован|создан автоматически|не редактировать|自动生成|自動生成|请勿(?:编辑|修改)|編集しないで")
# Wordings of notices on copies from elsewhere.
COPIED = re.compile(
    r"\b[Tt]aken verbatim from\b|\b[Cc]opied (?:unchanged|verbatim) from\b|\b[Vv]endored (?:from|copy)\b|please send fixes upstream|^[\s#/*!]*upstream:\s*\S|\b[Ll]ocal (?:snapshot|copy|mirror) of \S+ v?\d")
TOOL_NAME = re.compile(
    r"(?:_pb2?(?:_grpc)?\.\w+|\.pb(?:\.gw)?\.\w+|\.pb\.\w+|_generated\.\w+|\.generated\.\w+|\.gen\.\w+|\.g\.\w+|\.designer\.\w+|[.-]min\.\w+|\.bundle\.\w+|\.chunk\.\w+|\.[0-9a-f]{8,20}\.(?:js|ts)|Grpc\.java|OuterClass\.java)$")
VENDORED = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|third[_-]?party|Godeps|site-packages|extern|deps(?=/[^/]+/)|external(?=/[^/]+-v?\d[\d.]*/)|Pods|_vendor|vendored)/", re.I)
HEADER = re.compile(r"\A﻿?(?:#![^\n]*\n)?(?:\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\")[ \t]*(?:\r?\n|$))*")
COMMENT = re.compile(r"(?:^|(?<=\s))(?:#|//)[^\n]*|/\*[\s\S]*?\*/", re.M)
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
NUMBER = re.compile(r"\b0x[0-9a-fA-F]+\b|\b\d[\d._]*(?:[eE][-+]?\d+)?\b")
VALUE = re.compile(NUMBER.pattern + r"|[\s,\[\]{}():;+\-.]")
NAME = re.compile(r"\w+")
FEATURES = ("log_size", "log_lines", "mean_line", "log_longest", "compression", "entropy", "distinct", "name_length", "short_names", "name_spread", "comments", "strings", "digits",
            "signs", "blanks", "shapes", "words_in_strings", "size_differs")


PAGE = re.compile(r"\A﻿?\s*<(?:!DOCTYPE|html|\?xml|head|body|div|svg)\b", re.I)
MARKED = re.compile(r"^\s*(?:[*+-]\s|\||#{1,6}\s|>\s|=+\s)", re.M)
LISTED = re.compile(r"^\s*(?:[*+-]\s|\|)", re.M)


def is_page(text: str) -> bool:
    """A web page, or prose in lists, headings and tables, under the name of a code file."""
    if PAGE.match(text):
        return True
    lines = sum(1 for x in text.split("\n") if x.strip())
    return len(LISTED.findall(text)) >= 3 and len(MARKED.findall(text)) > 0.6 * lines


STRINGS, DIGITS = FEATURES.index("strings"), FEATURES.index("digits")


def features(text: str, gap: int) -> list[float]:
    """What the forest sees of a text whose header comments are off. ``gap`` is how far the stated size of the file is from
    that of the whole text. Only whether there is one counts: its length could tell how long the header was, and so
    whether there is a notice."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(text))
    lines = text.split("\n")
    bare = COMMENT.sub(" ", text)
    strings = STRING.findall(bare)
    held = sum(map(len, strings))
    tokens = TOKEN.findall(bare)
    counts = Counter(tokens)
    m = max(1, len(tokens))
    k = total = squares = short = signs = 0
    for t, c in counts.items():
        if t[0].isalpha() or t[0] == "_":
            x = len(t)
            k += c
            total += c * x
            squares += c * x * x
            short += c * (x <= 2)
        elif not t[0].isdigit():
            signs += c
    k = max(1, k)
    mean = total / k
    digits = sum(map(text.count, "0123456789"))
    shapes = set(NAME.sub("w", text).split("\n"))
    shapes.discard("")
    return [
        math.log1p(n), math.log1p(len(lines)), n / len(lines), math.log1p(max(map(len, lines))), len(zlib.compress(raw, 1)) / max(1, len(raw)),
        -sum(c / m * math.log2(c / m) for c in counts.values()), len(counts) / m, mean, short / k,
        math.sqrt(max(0.0, squares / k - mean * mean)), (len(text) - len(bare)) / n, held / n, digits / n, signs / m,
        sum(map(text.count, " \t\r\n")) / n, len(shapes) / max(1, len(lines)), sum(s.count(" ") for s in strings) / max(1, held), float(gap > 0)]


def declared(path: str, text: str, values: float = 1.0) -> tuple[bool, bool]:
    """(made by a tool, copied from elsewhere), as far as the file itself says so. ``values`` is the share of strings
    and digits where it is known; a text with few can't be a table."""
    copied = bool(path and VENDORED.search(path))
    made = bool(path and TOOL_NAME.search(path))
    head = HEADER.match(text)[0]
    for line in head.split("\n") if head else ():
        made = made or bool(NOTICE.search(line))
        copied = copied or bool(COPIED.search(line))
    if not made and values > 0.25:
        body = text[len(head):].strip()
        made = len(body) > 400 and is_literal(body)
    return made, copied


def is_literal(body: str) -> bool:
    """Tables of values and next to nothing else."""
    bare = STRING.sub("", body)
    rest = VALUE.sub("", bare)
    values = len(body) - len(bare) + sum(map(len, NUMBER.findall(bare)))
    return len(rest) < 0.1 * len(body) and values > 0.3 * len(body)


def measured(files: DataFrame) -> DataFrame:
    """(id, made, copied, one column per feature) of (id, file_path, content, file_size)."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("made", T.DoubleType()), T.StructField("copied", T.BooleanType()), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, copied, rows = [], [], [], []
            for i, path, text, size in zip(*(batch.column(c).to_pylist() for c in range(4))):
                text = text or ""
                # dependencies kept in the tree are copies whatever they hold
                if i is None or not (path and VENDORED.search(path)) and (not text or is_page(text)):
                    continue
                ids.append(i)
                gap = abs(size - len(text.encode("utf-8", "surrogatepass"))) if size is not None else 0
                row = features(text[HEADER.match(text).end():].strip() or text, gap)
                m, c = declared(path or "", text, row[STRINGS] + row[DIGITS])
                made.append(float(m))
                copied.append(c)
                rows.append(row)
            cols = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.float64()), pa.array(copied, pa.bool_()), *(pa.array(c, pa.float64()) for c in cols)], names=schema.names)

    picked = files.select(F.col("id").cast("string").alias("id"), F.col("file_path").cast("string").alias("p"), F.col("content").cast("string").alias("t"), F.col("file_size").cast("long").alias("s"))
    ship(files.sparkSession)
    return picked.mapInArrow(work, schema)


def votes(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, made, copied, vote): the last forest's share of votes for "made by a tool".

    Null ids have no row, nor have null or empty texts, web pages and prose outside dependency folders; a null path or size is read as unknown. Without
    both declared and other files there is nothing to learn and the vote is the declaration.
    """
    table = materialise(measured(files), "file-shapes")
    return _voted(table, table, sample)


def _voted(known: DataFrame, table: DataFrame, sample: int) -> DataFrame:
    """``table`` with the vote of forests grown on ``known``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    total = known.count()
    # the sample is drawn by a hash of the id, so it is the same on every run; a copy says nothing of how code looks
    part = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(total, 1)))).filter("not copied").limit(2 * sample)
    kinds = {r[0]: r[1] for r in part.groupBy("made").count().collect()}
    if len(kinds) < 2:
        return table.select("id", "made", "copied", F.col("made").alias("vote"))
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    part = pack.transform(part).select("made", "features").cache()

    def grow(rows: DataFrame, seed: int, depth: int, leaf: float):
        return RandomForestClassifier(labelCol="made", featuresCol="features", numTrees=TREES, maxDepth=depth, minInstancesPerNode=3, minWeightFractionPerNode=leaf, subsamplingRate=0.7, seed=seed).fit(rows)

    vote = vector_to_array(F.col("probability"))[1]
    # large leaves in the first forest: a leaf must tell how often its files declare, not repeat each one's label
    first = grow(part, 5, DEPTH - 2, 1 / 400)
    clear = first.transform(part).filter((F.col("made") == 1) | (vote < DOUBT)).select("made", "features")
    second = grow(clear, 6, DEPTH, 0.0)
    part.unpersist()
    return second.transform(pack.transform(table)).select("id", "made", "copied", vote.alias("vote"))


def not_handwritten(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id) of files declared copied or made, or voted to be made by a tool; repeated ids come out once."""
    return votes(files, sample).filter("copied or made = 1 or vote >= 0.5").select("id").distinct()


def held_out(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(declared, files, voted): forests grown on one half of the files, the other half's files with and without a declaration and how
    many of each the vote alone says are made by a tool. Halves are by path, so versions of a file lie in one."""
    path = F.coalesce("file_path", F.col("id").cast("string"))
    half = lambda i: materialise(measured(files.filter(F.pmod(F.xxhash64(path), F.lit(2)) == i)), "file-shapes")
    known, other = half(0), half(1)
    rows = _voted(known, other.filter("not copied"), sample)
    return rows.groupBy((F.col("made") == 1).alias("declared")).agg(F.count("*").alias("files"), F.sum((F.col("vote") >= 0.5).cast("long")).alias("voted"))
