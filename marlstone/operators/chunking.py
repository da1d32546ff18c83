"""Table functions that split files: text by boundaries, code by its outline.

Both keep every byte: the chunks of a file put together are the file. Text is cut at the coarsest boundary that
fits (blank line, line, sentence, word, letter). Code is cut at the tops of its outline: Python by the
standard library's syntax tree, the brace languages by brackets and declarations, with scopes kept on a stack.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.tokens import Letters, Tokenizer, Tokens, Vocabulary, tokenizer
from marlstone.session import ship

MAX_CHUNK = 1500
# Extensions and their languages; names and interpreters that tell a language without one.
EXTENSIONS = {"py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
              "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala",
              "sh": "bash", "bash": "bash", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "lua": "lua", "r": "r",
              "ex": "elixir", "hs": "haskell", "ml": "ocaml", "zig": "zig", "dart": "dart", "pl": "perl", "proto": "proto", "tf": "hcl", "nix": "nix", "jl": "julia", "clj": "clojure", "erl": "erlang"}
NAMES = {"makefile": "make", "dockerfile": "dockerfile", "gemfile": "ruby", "rakefile": "ruby", "cmakelists.txt": "cmake"}
INTERPRETERS = {"python": "python", "python3": "python", "node": "javascript", "bash": "bash", "sh": "bash", "ruby": "ruby", "perl": "perl"}
OUTLINED = frozenset({"python", "rust", "typescript", "javascript", "go", "java", "c", "cpp", "csharp", "php", "kotlin", "swift", "scala", "dart", "zig"})

BOUNDARIES = (re.compile(r"\n\s*\n+"), re.compile(r"\n"), re.compile(r"(?<=[.!?。！？])\s*"), re.compile(r"\s+"), re.compile(r"(?s)."))


def supported_languages() -> list[str]:
    return sorted(set(EXTENSIONS.values()) | set(NAMES.values()))


def is_supported(language: str) -> bool:
    return language.lower() in supported_languages()


def detect_language(path: str | None, text: str | None = None) -> str | None:
    """By name, extension, or interpreter line; None if nothing tells."""
    name = (path or "").rpartition("/")[2].lower()
    if name in NAMES:
        return NAMES[name]
    ext = name.rpartition(".")[2] if "." in name else ""
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    if text and text.startswith("#!"):
        m = re.match(r"#!\S*?(?:env\s+(?:-S\s+)?)?([\w.]+)(?:\s|$)", text)
        return INTERPRETERS.get(m[1].rpartition("/")[2]) if m else None
    return None


def split_text(text: str, most: int = MAX_CHUNK, measure: Letters | None = None, start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """(start, end) in letters; pieces in order, no longer than ``most`` by ``measure`` (letters), that add up to the text
    from ``start`` to ``stop``."""
    measure = measure or Letters()
    out: list[tuple[int, int]] = []
    at, n = start, len(text) if stop is None else stop
    while at < n:
        if measure.size(at, n) <= most:
            out.append((at, n))
            break
        end, reach = 0, min(n, measure.reach(at, most))
        for b in BOUNDARIES[:-1]:
            for m in b.finditer(text, at + 1, reach):
                if m.end() <= reach:
                    end = m.end()
            if end > at:
                break
        end = end if end > at else reach
        out.append((at, end))
        at = end
    return out


def fitted(text: str, pieces: list[tuple[int, int]], most: int, tok: Tokenizer) -> list[tuple[int, int]]:
    """Pieces none of which has more than ``most`` tokens by itself; a piece can have more than its share of the whole text's tokens."""
    out = []
    for s, e in pieces:
        n = tok.count(text[s:e])
        if n <= most or e - s < 2:
            out.append((s, e))
        else:
            mine = Tokens(text[s:e], tok)
            parts = split_text(text[s:e], max(1, most - 1 - (n - most) // 2), mine)
            halves = parts if len(parts) > 1 else [(0, (e - s) // 2), ((e - s) // 2, e - s)]
            out += fitted(text, [(s + a, s + b) for a, b in halves], most, tok)
    return out


@dataclass
class Node:
    """A declaration: kind, name, first and last line (from 0, end exclusive), scopes above it."""

    kind: str
    name: str | None
    start: int
    end: int
    scope: list[str] = field(default_factory=list)


DECLARATION = re.compile(
    r"^\s*(?:(?:export|default|public|private|protected|static|final|abstract|async|unsafe|pub(?:\([\w\s:]+\))?|extern(?:\s+\"\w+\")?|const|sealed|override|open|inline|virtual)\s+)*"
    r"(?:(?P<kind>fn|func|function\*?|def|class|interface|trait|struct|enum|impl|mod|module|namespace|type|object|record|union|macro_rules!)\s+(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?(?P<name>[\w$:]+)"
    r"|(?P<method>[\w$]+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?:->\s*[^{;]+|:\s*[^{;=]+|throws\s+[\w.,\s]+)?\{\s*$|(?:const|let|var)\s+(?P<bound>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>)")
# Declaration words and the kinds they stand for.
KINDS = {"fn": "function", "func": "function", "function": "function", "function*": "function", "def": "function", "class": "class", "interface": "interface", "trait": "trait", "struct": "struct",
         "enum": "enum", "impl": "impl", "mod": "module", "module": "module", "namespace": "module", "type": "type", "object": "object", "record": "record", "union": "union", "macro_rules!": "macro"}
CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(|\.([A-Za-z_$][\w$]*)\s*\(")
WORDS = frozenset("if for while switch match return catch fn func function def class with elif print and or not in is new typeof sizeof await async super this self".split())
_QUIET = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/")


def python_outline(text: str) -> list[Node]:
    out: list[Node] = []

    def walk(body: list, scope: list[str]) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if scope else "function"
                out.append(Node(kind, n.name, first, n.end_lineno, [*scope, n.name]))
                walk(n.body, [*scope, n.name])

    walk(ast.parse(text).body, [])
    return out


def brace_outline(text: str) -> list[Node]:
    """Declarations whose braces balance; strings and comments are blanked first, line by line in place."""
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[Node] = []
    stack: list[tuple[int, Node | None]] = []
    depth = 0
    for i, line in enumerate(quiet.split("\n")):
        m = DECLARATION.match(line)
        node = None
        if m and not (m["method"] in WORDS):
            name = m["name"] or m["method"] or m["bound"]
            outer = [n for _, n in stack if n]
            kind = KINDS.get(m["kind"] or "", "function")
            if kind == "function" and outer and outer[-1].kind in ("class", "impl", "trait", "interface", "struct", "object"):
                kind = "method"
            node = Node(kind, name, i, i + 1, [*(n.name for n in outer if n.name), name])
            if "{" not in line:
                out.append(node)
                continue
        for ch in line:
            if ch == "{":
                stack.append((depth, node))
                if node:
                    out.append(node)
                node = None
                depth += 1
            elif ch == "}" and stack:
                depth, closed = stack.pop()
                if closed:
                    closed.end = i + 1
    return out


def outline(language: str, text: str) -> list[Node]:
    """Raises ValueError where the language has no outline, SyntaxError where the text has none."""
    if language == "python":
        return python_outline(text)
    if language in OUTLINED:
        return brace_outline(text)
    raise ValueError(f"no outline for {language}")


def split_code(text: str, language: str, path: str | None = None, most: int = MAX_CHUNK, tok: Tokenizer | None = None) -> list[dict]:
    """Chunks with metadata. Whole declarations stay together as long as they fit; larger ones are opened."""
    measure = Tokens(text, tok) if tok else Letters()
    nodes = outline(language, text)
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    cuts = {0, len(lines)}
    for n in nodes:
        size = measure.size(starts[n.start], starts[min(n.end, len(lines))])
        if len(n.scope) == 1 or size > most or any(p.start <= n.start and n.end <= p.end and measure.size(starts[p.start], starts[min(p.end, len(lines))]) > most for p in nodes if p is not n and len(p.scope) == len(n.scope) - 1):
            cuts |= {n.start, min(n.end, len(lines))}
    order = sorted(cuts)
    pieces: list[tuple[int, int]] = []
    for a, b in zip(order, order[1:]):
        s, e = starts[a], starts[b]
        if pieces and not text[s:e].strip() and measure.size(pieces[-1][0], e) <= most:
            pieces[-1] = (pieces[-1][0], e)
        elif measure.size(s, e) <= most:
            pieces.append((s, e))
        else:
            pieces += split_text(text, most, measure, s, e)
    if tok:
        pieces = fitted(text, pieces, most, tok)
    return [describe(text, s, e, nodes, starts, language, path, i) for i, (s, e) in enumerate(pieces)]


def describe(text: str, s: int, e: int, nodes: list[Node], starts: list[int], language: str, path: str | None, i: int) -> dict:
    part = text[s:e]
    pad = len(part) - len(part.lstrip())
    a, b = bisect_right(starts, s + min(pad, max(0, e - s - 1))) - 1, bisect_right(starts, max(s, e - 1)) - 1
    around = [n for n in nodes if n.start <= a and b < n.end]
    own = min(around, key=lambda n: (n.end - n.start, -len(n.scope)), default=None) or next((n for n in nodes if a <= n.start <= b), None)
    above = own.scope[:-1] if own else []
    defined = {n.name for n in nodes if a <= n.start <= b and n.name}
    called = {x or y for x, y in CALL.findall(_QUIET.sub(" ", part) if language != "python" else part)} - WORDS
    return {"start": s, "end": e, "node_type": own.kind if own else "module", "node_name": (own.name if own else None) or (f"chunk_{i + 1}" if path else None), "language": language,
            "parent_context": above[-1] if above else path, "scope_path": own.scope if own else [], "definitions": sorted(defined), "symbol_refs": sorted(called - defined)}


def split_plain(text: str, path: str | None = None, most: int = MAX_CHUNK, tok: Tokenizer | None = None) -> list[dict]:
    pieces = fitted(text, split_text(text, most, Tokens(text, tok)), most, tok) if tok else split_text(text, most)
    return [{"start": s, "end": e, "node_type": "text_chunk", "node_name": f"text_chunk_{i + 1}" if path else None, "language": "text", "parent_context": path, "scope_path": [], "definitions": [], "symbol_refs": []}
            for i, (s, e) in enumerate(pieces)]


def split_file(text: str, path: str | None, most: int = MAX_CHUNK, tok: Tokenizer | None = None) -> list[dict]:
    """By outline if the language is known and the text has one, else as text."""
    language = detect_language(path, text)
    if language in OUTLINED:
        try:
            return split_code(text, language, path, most, tok)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            pass
    return split_plain(text, path, most, tok)


CHUNK = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("project_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("content", T.StringType()),
    T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("node_type", T.StringType()),
    T.StructField("node_name", T.StringType()), T.StructField("language", T.StringType()), T.StructField("parent_context", T.StringType()), T.StructField("scope_path", T.ArrayType(T.StringType())),
    T.StructField("definitions", T.ArrayType(T.StringType())), T.StructField("symbol_refs", T.ArrayType(T.StringType()))])
_ARROW = [pa.string()] * 3 + [pa.int64(), pa.string()] + [pa.int64()] * 4 + [pa.string()] * 4 + [pa.list_(pa.string())] * 3


def chunk_files(files: DataFrame, most: int = MAX_CHUNK, text_only: bool = False, id_col: str = "id", group_col: str = "project_id", path_col: str = "file_path", text_col: str = "content",
                vocabulary: str | None = None) -> DataFrame:
    """Chunks of every file with byte ranges and true lines. Null texts have none; an empty text has none.

    With a vocabulary file ``most`` counts tokens rather than letters, and every chunk keeps its token ids; it has no more than ``most``
    of them unless a single letter has.
    """
    shared = files.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary)) if vocabulary else None
    schema = T.StructType([*CHUNK.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]) if vocabulary else CHUNK
    types = [*_ARROW, pa.list_(pa.int32())] if vocabulary else _ARROW

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shared.value) if shared else None
        for batch in batches:
            rows: list[tuple] = []
            for i, group, path, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if not text:
                    continue
                byte = line = last = 0
                for k, c in enumerate(split_plain(text, path, most, tok) if text_only else split_file(text, path, most, tok)):
                    part = text[c["start"]:c["end"]]
                    size, ends = len(part.encode("utf-8", "surrogatepass")), part.count("\n")
                    last = line + ends - (part.endswith("\n"))
                    rows.append((i, group, path, k, part, byte, byte + size, line + 1, max(line, last) + 1, *(c[x] for x in ("node_type", "node_name", "language", "parent_context", "scope_path", "definitions", "symbol_refs")), *([tok.encode(part)] if tok else [])))
                    byte, line = byte + size, line + ends
                    if len(rows) >= 5_000:
                        yield pack(rows)
                        rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    ship(files.sparkSession)
    return files.select(*(F.col(c).cast("string") for c in (id_col, group_col, path_col, text_col))).mapInArrow(work, schema)
