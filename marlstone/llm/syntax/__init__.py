"""Syntax checkers: recursive-descent statements, precedence-climbing expressions, panic-mode recovery.

A file is turned into one line of token classes per source line: names become ``a``, numbers
``0``, strings ``s``; keywords and operators stay. Whether a line parses depends on these
classes alone, so a line that was once parsed as whole statements, or as the head of a
block, is known from then on and isn't parsed again. All files of a task share that memory.
"""

from __future__ import annotations

from marlstone.llm.syntax.base import Problem
from marlstone.llm.syntax.go import GoParser
from marlstone.llm.syntax.java import JavaParser
from marlstone.llm.syntax.python import PythonParser
from marlstone.llm.syntax.rust import RustParser
from marlstone.llm.syntax.script import JavaScriptParser, TypeScriptParser

PARSERS = {"py": PythonParser, "rs": RustParser, "ts": TypeScriptParser, "js": JavaScriptParser, "go": GoParser, "java": JavaParser}
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "go": "go", "java": "java"}


def problems(extension: str, text: str) -> list[Problem]:
    """All errors of a text in the language of its extension, in order; none for a valid text."""
    return PARSERS[extension](text).run()
