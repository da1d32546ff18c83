"""Column functions: hashes, sizes, lines, tokens, vectors, paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the size buckets and their labels.
SIZE_BOUNDS = (1024, 10 * 1024, 100 * 1024, 512 * 1024, 1024 * 1024, 2 * 1024 * 1024, 4 * 1024 * 1024)
SIZE_LABELS = ("0-1KB", "1-10KB", "10-100KB", "100-512KB", "512KB-1MB", "1-2MB", "2-4MB", "4MB+")
# Minutes until the n-th retry; the last holds for all later ones.
RETRY_MINUTES = (1, 5, 10, 20, 40, 60)
WORD_PATTERN = r"[\p{L}\p{N}]+"
UUID_PATTERN = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def content_digest(c: str | Column) -> Column:
    """256-bit digest of a text as 32 bytes; equal texts, equal digests."""
    return F.unhex(F.sha2(F.col(c) if isinstance(c, str) else c, 256))


def stable_id(*parts: str | Column) -> Column:
    """An id that follows from its parts, so writing twice gives the same row."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def is_uuid(c: str) -> Column:
    return F.col(c).rlike(UUID_PATTERN)


def token_estimate(c: str | Column) -> Column:
    """A quarter of the UTF-8 length, rounded down."""
    return F.floor(F.octet_length(F.col(c) if isinstance(c, str) else c) / 4).cast("long")


def words(c: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(WORD_PATTERN), F.lit(0))


def byte_prefix(c: str, offset: str | Column) -> Column:
    """The first ``offset`` bytes of a text's UTF-8 form; also right where it isn't ASCII."""
    return F.substring(F.encode(c, "UTF-8"), F.lit(1), offset if isinstance(offset, Column) else F.col(offset))


def _newlines(data: Column) -> Column:
    # one letter a byte: a newline's byte is part of no other letter of UTF-8, and a cut letter can't fail to decode
    s = F.decode(data, "ISO-8859-1")
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def line_true(c: str, offset: str) -> Column:
    """Line of a byte offset, from 1: newlines before it, plus 1."""
    return (_newlines(byte_prefix(c, offset)) + 1).cast("long")


def line_compat(c: str, offset: str) -> Column:
    """Line starts before a byte offset, plus 1, as the stored ranges of older tables have it."""
    o = F.col(offset)
    return (F.lit(1) + (o > 0).cast("int") + F.when(o > 1, _newlines(byte_prefix(c, o.cast("int") - 1))).otherwise(0)).cast("long")


def size_bucket(c: str | Column) -> Column:
    """Label of the size range; upper bounds are exclusive."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c < SIZE_BOUNDS[0], SIZE_LABELS[0])
    for bound, label in zip(SIZE_BOUNDS[1:], SIZE_LABELS[1:]):
        out = out.when(c < bound, label)
    return out.otherwise(F.when(c.isNotNull(), SIZE_LABELS[-1]))


def bucket_order(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*map(F.lit, SIZE_LABELS)), c).cast("long")


def safe_name(c: str) -> Column:
    """A name fit for a file: slashes and blanks become underscores."""
    return F.translate(c, "/ ", "__")


# States of a task.
STATES = ("pending", "running", "completed", "partially_completed", "failed", "merged")


def known_state(status: str) -> Column:
    """Is a text one of the states? Null isn't."""
    return F.coalesce(F.col(status).isin(*STATES), F.lit(False))


def quoted(text: str) -> Column:
    """A text as a literal of a query: in single quotes, those inside doubled; null stays null."""
    return F.concat(F.lit("'"), F.replace(F.col(text), F.lit("'"), F.lit("''")), F.lit("'"))


NIL = "00000000-0000-0000-0000-000000000000"


def no_sentinel(*ids: str) -> Column:
    """Rows none of whose ids is the nil id that marks an empty table."""
    out = F.lit(True)
    for c in ids:
        out &= ~F.col(c).eqNullSafe(NIL)
    return out


def retry_delay(count: str) -> Column:
    """Minutes until the next retry of something retried ``count`` times."""
    return F.element_at(F.array(*map(F.lit, RETRY_MINUTES)), F.least(F.greatest(F.col(count), F.lit(0)), F.lit(len(RETRY_MINUTES) - 1)) + 1).cast("long")


def under_path(c: str | Column, folder: str | Column) -> Column:
    """The path is the folder or lies in it; whole components count, and wildcards don't."""
    c = F.col(c) if isinstance(c, str) else c
    folder = F.lit(folder) if isinstance(folder, str) else folder
    folder = F.regexp_replace(folder, "(?<=.)/+$", "")
    return (c == folder) | c.startswith(F.when(folder == "/", folder).otherwise(F.concat(folder, F.lit("/"))))


def norm2(v: str) -> Column:
    return F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit_vector(v: str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm2(v)
    return F.transform(F.col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def l2_distance(v: str, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(F.col(v), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def sorted_set(c: str | Column) -> Column:
    """Distinct non-null items in order; a null list is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def epoch_ms(c: str) -> Column:
    return F.timestamp_millis(c).cast("timestamp_ntz")


def nearest_rank(c: str | Column, q: float) -> Column:
    """Quantile without interpolation: the element at ``round((n - 1) * q)`` of the sorted values, as an aggregate.

    It sorts the values of a group; use it where groups are bounded, as for buckets of a log.
    """
    c = F.col(c) if isinstance(c, str) else c
    a = F.sort_array(F.collect_list(c))
    return F.element_at(a, (F.floor((F.size(a) - 1) * F.lit(q) + 0.5) + 1).cast("int"))
