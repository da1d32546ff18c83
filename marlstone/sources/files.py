"""Source scans over a file tree.

The driver lists paths and sizes; executors read. Paths are spread so that the bytes of partitions are even:
files go from large to small to the partition with the least bytes. The tree must be on a path all
executors see.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.chunking import detect_language
from marlstone.session import ship

MAX_FILE = 5 * 1024 * 1024
#: Bytes of files that go on together.
BATCH = 16 * 1024 * 1024
# What is never read, in the notation of ignore files.
IGNORED = (
    ".git/",
    # tables and dumps
    "*.csv", "*.tsv", "*.psv", "*.xml", "*dump.sql", "*backup.sql", "*migration_data*.sql", "*.sql.gz",
    # locked versions
    "package-lock.json", "yarn.lock", "Cargo.lock", "Pipfile.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "pnpm-lock.yaml", "go.sum", "mix.lock", "uv.lock", "flake.lock",
    # what builds and caches leave
    "node_modules/", ".next/", "dist/", "build/", "target/", ".gradle/", "__pycache__/", ".pytest_cache/", "coverage/", "venv/", ".venv/", "env/", ".env/", "virtualenv/",
    # editors
    ".vscode/settings.json", ".idea/", "*.swp", "*.swo", "*~",
    # databases
    "*.sqlite", "*.db", "*.dump",
    # infrastructure: state, plans, generated files, caches
    "*.tfstate", "*.tfstate.*", "*.tfplan", "*.tfplan.*", ".terraform/", ".terraform.lock.hcl", "Pulumi.*.yaml", ".pulumi/", "*.retry", ".ansible/", "cdk.out/", ".cdk.staging/", "k8s-generated/", "manifests/generated/",
    "charts/*.tgz", ".helm/", ".aws/cli/cache/", ".azure/", ".docker/", ".vagrant/", ".nomad/",
    # shells and environments
    ".direnv/", ".nix-profile/", ".nix-defexpr/", "result-*", ".nix-gc-roots/", "/nix/", ".devenv/", ".direnv/flake-profile*", ".cachix/", "shell.nix", ".devcontainer/",
)
IGNORE_FILES = (".gitignore", ".ignore", ".marlstoneignore")


def rule(pattern: str, base: str = "") -> tuple[re.Pattern, bool, bool] | None:
    """(matcher of paths relative to the root, negated, folders only) of one line of an ignore file."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p.lstrip("!").replace("\\ ", " ")
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    parts = [fnmatch.translate(x)[4:-3] if x != "**" else None for x in p.split("/")]
    body = ""
    for i, x in enumerate(parts):
        if x is None:
            body += "(?:[^/]+/)*" if i < len(parts) - 1 else ".*"
        else:
            body += re.sub(r"(?<!\\)\.\*", "[^/]*", x) + ("/" if i < len(parts) - 1 else "")
    head = re.escape(base + "/") if base else ""
    return re.compile(head + ("" if anchored else "(?:.*/)?") + body + r"\Z"), negated, folder


class Ignore:
    """Rules of a tree; later and deeper rules win, as do negations after what they lift."""

    def __init__(self, patterns: list[str] | tuple[str, ...] = IGNORED) -> None:
        self.rules = [r for p in patterns if (r := rule(p))]

    def add_file(self, path: str, base: str) -> None:
        with open(path, encoding="utf-8", errors="replace") as f:
            self.rules += [r for line in f if (r := rule(line, base))]

    def ignored(self, rel: str, folder: bool) -> bool:
        hit = False
        for pattern, negated, only_folders in self.rules:
            if (folder or not only_folders) and pattern.match(rel):
                hit = not negated
        return hit


def list_files(root: str, max_size: int = MAX_FILE, extra: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(relative path, bytes, modification in microseconds) of regular, non-empty files that no rule leaves out."""
    ignore = Ignore((*IGNORED, *extra))
    out = []
    for at, folders, files in os.walk(root):
        rel = os.path.relpath(at, root)
        rel = "" if rel == "." else rel
        for name in IGNORE_FILES:
            if name in files:
                ignore.add_file(os.path.join(at, name), rel)
        folders[:] = sorted(d for d in folders if not ignore.ignored(f"{rel}/{d}" if rel else d, True))
        for name in sorted(files):
            p = f"{rel}/{name}" if rel else name
            full = os.path.join(at, name)
            if name in IGNORE_FILES or ignore.ignored(p, False) or os.path.islink(full) or not os.path.isfile(full):
                continue
            s = os.stat(full)
            if 0 < s.st_size <= max_size:
                out.append((p, s.st_size, s.st_mtime_ns // 1000))
    return out


def included(root: str, path: str, max_size: int = MAX_FILE) -> bool:
    """Would a scan of ``root`` read this path?"""
    full, base = os.path.realpath(path), os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        return False
    rel = os.path.relpath(full, base)
    ignore = Ignore()
    parts = rel.split("/")
    for i in range(len(parts)):
        at = "/".join(parts[:i])
        for name in IGNORE_FILES:
            f = os.path.join(base, at, name)
            if os.path.isfile(f):
                ignore.add_file(f, at)
        if ignore.ignored("/".join(parts[:i + 1]), i < len(parts) - 1 or os.path.isdir(full)):
            return False
    return os.path.isdir(full) or os.path.isfile(full) and 0 < os.path.getsize(full) <= max_size


def listing(spark: SparkSession, root: str, max_size: int = MAX_FILE) -> DataFrame:
    """(file_path, file_size, last_modified): metadata only."""
    rows = list_files(root, max_size)
    return spark.createDataFrame(rows, "file_path string, file_size long, m long").select("file_path", "file_size", F.timestamp_micros("m").cast("timestamp_ntz").alias("last_modified"))


def looks_binary(head: bytes) -> bool:
    """A zero byte, or the magic of a binary format."""
    return b"\0" in head or head.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"PK\x03\x04", b"%PDF", b"\x7fELF", b"\x1f\x8b", b"BZh", b"\xca\xfe\xba\xbe", b"MZ"))


FILE = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("content", T.StringType()), T.StructField("content_hash", T.BinaryType()),
                     T.StructField("language", T.StringType()), T.StructField("state", T.StringType())])


def read_files(spark: SparkSession, root: str, paths: list[tuple[str, int]], known: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of ``FILE``: state is "read", "unchanged" (digest known), "binary", "undecodable" or "gone".

    Only "read" rows carry a text. ``known`` has stored digests (file_path, content_hash), which are joined by the executors.
    """
    n = partitions or max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    heap = [(0, i) for i in range(n)]
    rows = []
    for p, size in sorted(paths, key=lambda x: (-x[1], x[0])):
        held, i = heapq.heappop(heap)
        rows.append((i, p))
        heapq.heappush(heap, (held + size, i))
    src = spark.createDataFrame(rows, "part int, path string")
    if known is None:
        src = src.withColumn("old", F.lit(None).cast("binary"))
    else:
        old = known.groupBy(F.col("file_path").alias("path")).agg(F.max("content_hash").alias("old"))
        src = src.join(old, "path", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["file_path", "file_size", "content", "content_hash", "language", "state"]
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)

        for batch in batches:
            for p, old in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, text, digest, lang, state = None, None, None, None, "gone"
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        raw = f.read()
                    size, digest = len(raw), hashlib.sha256(raw).digest()
                    if looks_binary(raw[:8192]):
                        state = "binary"
                    elif old == digest:
                        state = "unchanged"
                    else:
                        text = raw.decode("utf-8")
                        lang, state = detect_language(p, text), "read"
                except FileNotFoundError:
                    pass
                except UnicodeDecodeError:
                    state = "undecodable"
                rows.append((p, size, text, digest, lang, state))
                held += size or 0
                if held > BATCH or len(rows) >= 1_000:
                    yield pack()
                    rows, held = [], 0
        yield pack()

    ship(spark)
    return src.repartitionByRange(n, "part").select("path", "old").mapInArrow(work, FILE)


def scan_tree(spark: SparkSession, root: str, stored: DataFrame | None = None, max_size: int = MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(files, deletes) of a tree: what to read and index, and the stored paths that are no longer there."""
    found = list_files(root, max_size)
    known = None
    deletes = spark.createDataFrame([], "file_path string")
    if stored is not None:
        here = spark.createDataFrame([(p,) for p, _, _ in found], "file_path string")
        known = stored.select("file_path", "content_hash")
        deletes = stored.select("file_path").distinct().join(here, "file_path", "left_anti")
    return read_files(spark, root, [(p, s) for p, s, _ in found], known), deletes


def scan_paths(spark: SparkSession, root: str, paths: list[str], max_size: int = MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """As ``scan_tree`` for named paths: excluded ones are dropped, missing ones are deletes."""
    here = [(p, os.path.getsize(os.path.join(root, p))) for p in paths if os.path.isfile(os.path.join(root, p)) and included(root, os.path.join(root, p), max_size)]
    lost = [(p,) for p in paths if not os.path.exists(os.path.join(root, p))]
    return read_files(spark, root, here), spark.createDataFrame(lost, "file_path string")
