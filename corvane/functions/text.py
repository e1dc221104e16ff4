"""Column functions on text: names, slugs, truncation, prompts, patches and filters. No UDFs."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file suffix (fixed values).
LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp",
    "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell",
    "sql": "sql", "html": "html", "css": "css", "scss": "scss", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "md": "markdown", "r": "r",
    "lua": "lua", "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "clj": "clojure", "vim": "vim", "proto": "protobuf",
    "tf": "terraform", "dockerfile": "dockerfile",
}
# File names that are never indexed (fixed values).
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "composer.lock", "Gemfile.lock", "Cargo.lock", "go.sum"]
MAX_FILE_BYTES = 1_000_000
# Words that a retrieval query leaves out (fixed values).
QUERY_STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


_COMPARE = {"==": operator.eq, "eq": operator.eq, "!=": operator.ne, "ne": operator.ne, ">": operator.gt, "gt": operator.gt, "<": operator.lt, "lt": operator.lt, ">=": operator.ge, "gte": operator.ge, "<=": operator.le, "lte": operator.le}


def _checked(value: object) -> object:
    if not isinstance(value, (str, int, float, bool)):
        raise TypeError(f"unsupported filter value: {value!r}")
    return value


def where_all(filters: dict[str, object]) -> Column:
    """FLT-01: every condition of a dict; a scalar means equality, a dict holds operators and their operands."""

    def one(field: str, op: str, value: object) -> Column:
        if op == "in":
            if isinstance(value, (str, bytes)) or not isinstance(value, (list, tuple, set, frozenset)):
                raise TypeError("'in' takes a sequence")
            return F.col(field).isin(*[_checked(v) for v in value])
        if op == "like":
            if not isinstance(value, str):
                raise TypeError("'like' takes a string")
            return F.col(field).like(value)
        if op not in _COMPARE:
            raise ValueError(f"unknown operator: {op}")
        return _COMPARE[op](F.col(field), F.lit(_checked(value)))

    parts = [one(f, op, v) for f, spec in filters.items() for op, v in (spec.items() if isinstance(spec, dict) else [("==", spec)])]
    return reduce(operator.and_, parts, F.lit(True))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """FLT-02: language from a file's name, null if unknown."""
    names = F.lower(file_name(path))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.when(names.isin("dockerfile", "makefile"), names).otherwise(F.try_element_at(table, F.lower(F.regexp_extract(names, r"[^.]\.([^.]+)$", 1))))


def is_indexable(path: Column, size: Column) -> Column:
    """SRC-01, filter half: a known suffix or name, not a lock file, not too large, not under .git."""
    return language_of(path).isNotNull() & ~file_name(path).isin(*LOCK_FILES) & (size <= MAX_FILE_BYTES) & ~F.concat(F.lit("/"), path).contains("/.git/")


def requested_sources(sources: Column, default: str = "code") -> Column:
    """FLT-03: ordered distinct sources, the default where there are none."""
    found = F.array_distinct(sources)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(default)))


def bounded_top_k(top_k: Column, low: int, high: int) -> Column:
    """FLT-03: top_k, or an error outside of its bounds."""
    return F.when(top_k.between(low, high), top_k).otherwise(F.raise_error(F.format_string(f"top_k must be {low} to {high}, not %s", top_k.cast("string"))).cast("int"))


def snippet(text: Column, length: int = 500) -> Column:
    """FLT-04 and FLT-16: cut to `length` characters and mark the cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def preview(text: Column, length: int = 120) -> Column:
    """FLT-16: one line; `length` counts the mark."""
    flat = F.trim(F.translate(text, "\n", " "))
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length - 3), F.lit("...")))


def repository_name(reference: Column) -> Column:
    """FLT-05: owner/repo of a URL, a host-prefixed path or a plain reference; null if it is none."""
    trimmed = F.trim(reference)
    is_url = trimmed.rlike(r"^https?://")
    host = F.lower(F.regexp_extract(trimmed, r"^https?://([^/?#]*)", 1))
    url_path = F.regexp_extract(trimmed, r"^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(is_url, url_path).otherwise(F.regexp_replace(trimmed, r"^(?i)(www\.)?github\.com/", ""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner, name = F.trim(F.get(parts, F.lit(0))), F.regexp_replace(F.trim(F.get(parts, F.lit(1))), r"(?i)\.git$", "")
    good = (~is_url | host.isin("github.com", "www.github.com")) & (F.size(parts) >= 2) & (owner != "") & (name != "")
    return F.when(good, F.concat_ws("/", F.lower(owner), F.lower(name)))


def branch_names(branches: Column) -> Column:
    """FLT-06: trimmed, without blanks, ordered distinct."""
    return F.array_distinct(F.filter(F.transform(branches, lambda b: F.trim(b)), lambda b: b != ""))


def default_first(default: Column, branches: Column) -> Column:
    """FLT-06: the default branch, then the others."""
    return F.concat(F.array(default), F.filter(branches, lambda b: b != default))


def slug(text: Column) -> Column:
    """FLT-07."""
    compact = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(compact == "", F.lit("x")).otherwise(compact)


def shorten_once(text: Column, ratio: float = 0.75, least: int = 256, marker: str = "\n...\n") -> Column:
    """FLT-08, one step: keep head and tail of `ratio` of the text, `least` characters at least."""
    n = F.length(text)
    target = F.least(F.greatest(F.floor(n * F.lit(ratio)).cast("int"), F.lit(least)), n - 1)
    head = F.floor((target - len(marker)) / 2).cast("int")
    tail = target - len(marker) - head
    return F.when(n <= least, text).otherwise(F.concat(F.substring(text, F.lit(1), head), F.lit(marker), F.right(text, tail)))


def shorten(text: Column, budget: int, attempts: int = 8) -> Column:
    """FLT-08: shorten until the text is within the budget, `attempts` times at most. A fold over the attempts, so the expression doesn't grow with each."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), text, lambda t, _: F.when(F.length(t) > budget, shorten_once(t)).otherwise(t))


def search_query(title: Column, statement: Column, apis: Column, context: Column, symbols: Column) -> Column:
    """FLT-09: retrieval query of a task; parts without content are left out."""
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    test = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Failing test context: "), context))
    return F.trim(F.concat_ws("\n", title, statement, listed("Relevant APIs: ", apis), test, listed("Likely relevant symbols: ", symbols)))


def query_terms(symbols: Column, apis: Column, text: Column, most: int = 12) -> Column:
    """RET-16: symbols, API names, then identifiers of three or more characters without stop words; the first spelling of each, `most` at most."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*QUERY_STOP_WORDS))
    terms = F.filter(F.transform(F.concat(symbols, apis, words), lambda t: F.trim(t)), lambda t: F.length(t) >= 3)
    lowered = F.transform(terms, F.lower)
    first = F.filter(terms, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    return F.slice(first, 1, most)


def lines_of(text: Column) -> Column:
    """Lines with their ends, at every line end that Python knows."""
    return F.filter(F.split(text, "(?<=\\n|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x85|\\u2028|\\u2029|\\r(?!\\n))"), lambda x: x != "")


def window_around(text: Column, terms: Column, around: int = 8) -> Column:
    """RET-17: struct of start and end line and content, `around` lines about the first that holds a term; null without one."""
    lines = F.transform(lines_of(text), lambda x: F.regexp_replace(x, "[\\r\\n]+$", ""))
    lowered = F.transform(terms, F.lower)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.exists(lowered, lambda t: F.contains(F.lower(x), t)), i)), lambda i: i.isNotNull())
    at = F.get(hits, F.lit(0))
    start, end = F.greatest(F.lit(1), at + 1 - around), F.least(F.size(lines), at + 1 + around)
    return F.when(at.isNotNull(), F.struct(start.alias("start_line"), end.alias("end_line"), F.rtrim(F.array_join(F.slice(lines, start, end - start + 1), "\n")).alias("content")))


def model_patch(response: Column) -> Column:
    """FLT-11: the patch in a model's answer: tagged or fenced blocks, those called diff or patch first, else the text before the end mark."""
    text = F.trim(F.coalesce(response, F.lit("")))
    tags = lambda n: F.regexp_extract_all(text, F.lit(r"(?s)<([\w-]+)>(.*?)</\1>"), F.lit(n))
    fences = lambda n: F.regexp_extract_all(text, F.lit(r"(?s)```(\w+)?\n(.*?)```"), F.lit(n))
    blocks = F.concat(F.arrays_zip(tags(1).alias("k"), tags(2).alias("v")), F.arrays_zip(fences(1).alias("k"), fences(2).alias("v")))
    called = F.filter(blocks, lambda b: b["k"].isin("diff", "patch"))
    other = F.filter(blocks, lambda b: ~F.coalesce(b["k"], F.lit("")).isin("diff", "patch"))
    found = F.coalesce(F.get(called, F.lit(0))["v"], F.get(other, F.lit(0))["v"], F.get(F.split(text, "</s>"), F.lit(0)))
    return F.when(text == "", F.lit("")).otherwise(F.regexp_replace(found, r"^\s+|\s+$", ""))


def touched_paths(patch: Column) -> Column:
    """FLT-13: files a patch writes, ordered distinct, without /dev/null."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "/dev/null"))


def target_path(target: Column) -> Column:
    """FLT-13: path part of a test target."""
    return F.split_part(target, F.lit("::"), F.lit(1))


def failing_tests(output: Column, targets: Column, return_code: Column) -> Column:
    """FLT-14: tests that a runner's output names as failed or in error, ordered distinct; all targets if it names none but failed."""
    lines = F.transform(F.split(output, r"\r\n|\r|\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.startswith("FAILED ") | x.startswith("ERROR "))
    names = F.array_distinct(F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(F.split_part(x, F.lit(" - "), F.lit(1)), "^(FAILED|ERROR) ", ""))), lambda x: x != ""))
    return F.when((F.size(names) == 0) & (return_code != 0), targets).otherwise(names)


def provider_and_model(name: Column) -> tuple[Column, Column]:
    """FLT-15: provider (lower case, empty without a slash) and model."""
    trimmed = F.trim(name)
    parts = F.split(trimmed, "/", 2)
    has = F.size(parts) > 1
    return F.when(has, F.lower(F.get(parts, F.lit(0)))).otherwise(F.lit("")), F.when(has, F.get(parts, F.lit(1))).otherwise(trimmed)
