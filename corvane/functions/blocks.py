"""Chunks of source text along its structure: a scan for strings, comments and brackets, a tree of blocks, pieces up to a budget.

A line's level is its depth in brackets, its indentation or its heading's depth, as the language has it. A block is a line
and those below it of greater levels, up to the next of its level. A block that fits the budget stays whole; one that
doesn't is cut into its head and its child blocks, and neighbours that fit together are joined again.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


@dataclass(frozen=True)
class Syntax:
    """How a language nests, and its line comments, block comments, strings on one line and strings over lines."""

    nesting: str
    comments: tuple[str, ...] = ()
    blocks: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = ()
    long_strings: tuple[str, ...] = ()
    brackets: bool = False  # whether lines go on inside brackets, where nesting is by indentation


_C = Syntax("brackets", ("//",), (("/*", "*/"),), ('"', "'"))
_SCRIPT = Syntax("brackets", ("//",), (("/*", "*/"),), ('"', "'"), ("`",))
_INDENTED = Syntax("indent", ("#",))
SYNTAX = {
    "python": Syntax("indent", ("#",), (), ('"', "'"), ('"""', "'''"), True), "yaml": _INDENTED, "ruby": _INDENTED, "shell": _INDENTED, "elixir": _INDENTED, "r": _INDENTED, "toml": _INDENTED, "dockerfile": _INDENTED, "makefile": _INDENTED,
    "lua": Syntax("indent", ("--",)), "sql": Syntax("indent", ("--",), (("/*", "*/"),)), "haskell": Syntax("indent", ("--",)), "ocaml": Syntax("indent", (), (("(*", "*)"),)), "erlang": Syntax("indent", ("%",)), "vim": Syntax("indent"), "clojure": Syntax("indent", (";",)),
    "html": Syntax("indent", (), (("<!--", "-->"),)), "xml": Syntax("indent", (), (("<!--", "-->"),)),
    **dict.fromkeys(["c", "cpp", "csharp", "java", "php", "swift", "kotlin", "scala", "dart", "protobuf", "css", "scss"], _C), "javascript": _SCRIPT, "typescript": _SCRIPT, "go": _SCRIPT,
    "rust": Syntax("brackets", ("//",), (("/*", "*/"),), ('"',)), "json": Syntax("brackets", (), (), ('"',)), "terraform": Syntax("brackets", ("#", "//"), (("/*", "*/"),), ('"',)),
    "markdown": Syntax("headings", (), (), (), ("```", "~~~")), "prose": Syntax("lines"),
}
PAIRS = {")": "(", "]": "[", "}": "{"}
WHITE = " \t\n\r\x0b\x0c"
#: Level of lines that can begin no block, and of those below all headings.
INSIDE, BELOW = 1 << 20, 7


class Broken(ValueError):
    """The text doesn't follow its language's rules: a string, comment or bracket is left open, or none was to close."""


@lru_cache(maxsize=64)
def _scanner(s: Syntax) -> re.Pattern:
    open_ = [f"(?P<open>{'|'.join(re.escape(a) for a in [*s.long_strings, *(a for a, _ in s.blocks)])})"] if s.long_strings or s.blocks else []
    whole = [rf"{re.escape(q)}(?:\\.|(?!{re.escape(q)}).)*?{re.escape(q)}" for q in s.long_strings] + [rf"{re.escape(a)}.*?{re.escape(b)}" for a, b in s.blocks]
    short = [rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in s.strings]
    comment = [rf"{re.escape(c)}[^\n]*" for c in s.comments]
    brackets = [r"(?P<bracket>[()\[\]{}])"] if s.nesting == "brackets" or s.brackets else []
    return re.compile("|".join([f"(?P<long>{'|'.join(whole)})" if whole else "(?!)", *open_, *short, *comment, *brackets]), re.S)


def levels(text: str, lines: list[str], syntax: Syntax) -> tuple[list[int], list[int]]:
    """Level of each line, and level of the block that it closes. INSIDE for lines that begin no block: blank ones, those within a string, comment or expression, those that close a block, and those under a line that belongs to them; and for those that close none."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist()
    line_at = lambda place: bisect_right(starts, place) - 1
    inside, stack, depth, seen = [False] * len(lines), [], [0] * len(lines), 0
    for m in _scanner(syntax).finditer(text):
        if m.lastgroup == "open":
            raise Broken(m[0])
        line = line_at(m.start())
        depth[seen + 1 : line + 1] = [len(stack)] * (line - seen)
        seen = max(seen, line)
        if m.lastgroup == "long":
            for i in range(line + 1, line_at(m.end() - 1) + 1):
                inside[i] = True
        elif m.lastgroup == "bracket" and m[0] in PAIRS:
            if not stack or stack.pop() != PAIRS[m[0]]:
                raise Broken(m[0])
        elif m.lastgroup == "bracket":
            stack.append(m[0])
    if stack:
        raise Broken(stack[-1])
    depth[seen + 1 :] = [0] * (len(lines) - 1 - seen)
    out, closed, glued = [], [INSIDE] * len(lines), False
    for i, x in enumerate(lines):
        body = x.strip(WHITE)
        if syntax.nesting == "lines":
            out.append(0)
            continue
        if not body or inside[i] or (syntax.nesting == "indent" and depth[i]) or body[0] in PAIRS:
            if body and not inside[i] and syntax.nesting == "brackets":
                closed[i] = depth[i] - next((n for n, c in enumerate(body) if c not in PAIRS), len(body))
            out.append(INSIDE)
            glued = glued and bool(body)
            continue
        if syntax.nesting == "brackets":
            level = depth[i]
        elif syntax.nesting == "headings":
            head = re.match("#{1,6}(?= )", body)
            level = len(head[0]) if head else BELOW
        else:
            level = len(x.expandtabs(8)) - len(x.expandtabs(8).lstrip())
        out.append(INSIDE if glued and level == last else level)
        # a comment or decorator belongs to what comes next
        glued, last = syntax.nesting != "headings" and body.startswith(("@", *syntax.comments, *(a for a, _ in syntax.blocks))), level
    return out, closed


def pieces(text: str, language: str, budget: int) -> list[tuple[int, int]]:
    """First and last line, from 1, of each piece; together all lines. Sizes count characters that are not white space."""
    lines = text.splitlines(keepends=True)
    level, closed = map(np.array, levels(text, lines, SYNTAX.get(language, _INDENTED)))
    sizes = np.concatenate([[0], np.cumsum([len(x) - sum(map(x.count, WHITE)) for x in lines])])
    fits = lambda a, b: sizes[b] - sizes[a] <= budget

    def joined(parts: Iterable[tuple[int, int, bool]]) -> list[tuple[int, int]]:
        """Neighbours joined while they fit; parts that aren't whole stay as they are."""
        out, open_ = [], False
        for a, b, whole in parts:
            if open_ and whole and fits(out[-1][0], b):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            open_ = whole
        return out

    def by_lines(a: int, b: int) -> list[tuple[int, int]]:
        return joined((i, i + 1, True) for i in range(a, b))

    def blocks(a: int, b: int) -> list[tuple[int, int]]:
        """The blocks of the least level among these lines, and what comes before the first."""
        own = level[a:b]
        heads = (np.flatnonzero(own == own.min()) + a).tolist() if own.min() < INSIDE else []
        heads = heads if heads and heads[0] == a else [a, *heads]
        return list(zip(heads, [*heads[1:], b], strict=True))

    def cut(a: int, b: int) -> list[tuple[int, int]]:
        """A block over the budget: its head and the lines that close it or a part of it, with their children between, joined where they fit."""
        own, out = level[a], []
        if own >= INSIDE:
            return by_lines(a, b)
        ends = (np.flatnonzero(closed[a + 1 : b] <= own) + a + 1).tolist()
        for x, y in zip([a, *ends], [*ends, b], strict=True):
            deeper = np.flatnonzero((level[x + 1 : y] > own) & (level[x + 1 : y] < INSIDE))
            child = x + 1 + int(deeper[0]) if len(deeper) else y
            out += [(x, child, True)] if fits(x, child) else [(i, j, False) for i, j in by_lines(x, child)]
            out += parts(child, y) if child < y else []
        return joined(out)

    def parts(a: int, b: int) -> Iterable[tuple[int, int, bool]]:
        for x, y in blocks(a, b):
            if fits(x, y):
                yield x, y, True
            else:
                yield from ((i, j, False) for i, j in cut(x, y))

    return [(a + 1, b) for a, b in joined(parts(0, len(lines)))]


SPANS = ArrayType(StructType([StructField("start_line", IntegerType()), StructField("end_line", IntegerType())]))
_SPAN = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32())]))


def spans(budget: int):
    """A function of content and language: array<struct<start_line, end_line>>; null without a language, and where the text is broken or nested too deep."""

    @F.arrow_udf(SPANS)
    def found(content: pa.Array, language: pa.Array) -> pa.Array:
        ends, none, flat = [0], [], array("i")  # a text and its pieces at a time, and numbers of what was found
        for text, name in zip(content, language, strict=True):
            text, name, own = text.as_py(), name.as_py(), None
            if text is not None and name is not None:
                with suppress(Broken, RecursionError):
                    own = pieces(text, name, budget)
            for piece in own or ():
                flat.extend(piece)
            none.append(own is None)
            ends.append(len(flat) // 2)
        numbers = np.frombuffer(flat, np.int32).reshape(-1, 2) if flat else np.zeros((0, 2), np.int32)
        each = pa.StructArray.from_arrays([pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], fields=list(_SPAN.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, type=_SPAN, mask=pa.array(none, pa.bool_()))

    return found
