"""Structural chunks by language."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import blocks
from corvane.operators import chunking

PYTHON = '''"""A module.

def not_a_function():
"""
import os

# about the class
@decorated
class A:
    """Text."""

    def one(self, a,
            b):
        text = """
def inside():
"""
        return {
"k": "]",
        }

    # about two
    def two(self):
        return 2


def f():
    pass
'''
JAVA = """package a;

/* a { comment
   over lines */
class A {
    int x = 1; // }
    void one() {
        if (x > 0) {
            call("{ not a block");
        } else {
            call('}');
        }
    }

    void two() { return; }
}
class B { int y; }
"""


def texts(text, language, budget):
    lines = text.splitlines(keepends=True)
    return ["".join(lines[a - 1 : b]) for a, b in blocks.pieces(text, language, budget)]


def test_python():
    whole = texts(PYTHON, "python", 10_000)
    assert whole == [PYTHON]
    got = texts(PYTHON, "python", 120)
    assert "".join(got) == PYTHON
    assert any(g.startswith("# about the class\n@decorated\nclass A:") for g in got)  # what stands above a block goes with it
    one = next(g for g in got if "def one" in g)
    assert "def inside" in one and one.rstrip().endswith("}")  # neither strings nor brackets are cut


def test_java():
    got = texts(JAVA, "java", 110)
    assert "".join(got) == JAVA
    one = next(g for g in got if "void one" in g)
    assert JAVA[JAVA.index("    void one") : JAVA.index("\n    void two")] in one  # braces in strings and comments don't count


def test_markdown_and_json():
    text = "intro\n# A\n" + "word " * 30 + "\n## A1\n```\n# no heading\n```\n## A2\ntext\n# B\nend\n"
    got = texts(text, "markdown", 130)
    assert "".join(got) == text and got[0] == "intro\n" and any(g.startswith("## A1") and "# no heading" in g for g in got)
    deep = '{"a": {"b": [1, 2, "]"]},\n "c": {\n  "d": 1\n }\n}\n'
    assert "".join(texts(deep, "json", 5)) == deep


@pytest.mark.parametrize(("text", "language"), [("class A {\n", "java"), ("}\n", "go"), ("x = (1, 2]\n", "python"), ('"""open\n', "python"), ("/* open\n", "css"), ("`open\n", "javascript")])
def test_broken_text(text, language):
    with pytest.raises(blocks.Broken):
        blocks.pieces(text, language, 500)


@pytest.mark.parametrize("language", [*blocks.SYNTAX, "unknown"])
def test_pieces_cover_every_line_and_keep_blocks_that_fit(language):
    rng = random.Random(language)
    for _ in range(60):
        depth, lines = 0, []
        for _ in range(rng.randrange(1, 40)):
            step = rng.random()
            if step < 0.25 and language != "json":
                lines.append("    " * depth + rng.choice(["head {", "head2 {"]) + "\n")
                depth += 1
            elif step < 0.45 and depth:
                depth -= 1
                lines.append("    " * depth + "}\n")
            else:
                lines.append(rng.choice(["", "    " * depth + "x" * rng.randrange(1, 30)]) + rng.choice(["\n", "\r\n"]))
        lines += ["    " * d + "}\n" for d in reversed(range(depth))]
        text, budget = "".join(lines), rng.choice([5, 40, 120])
        got = blocks.pieces(text, language, budget)
        assert [a for a, _ in got] == [1, *(b + 1 for _, b in got[:-1])] and got[-1][1] == len(lines)
        size = lambda a, b: len("".join("".join(lines[a - 1 : b]).split()))
        assert all(a == b or size(a, b) <= budget for a, b in got)
        if blocks.SYNTAX.get(language, blocks._INDENTED).nesting == "brackets":
            opened = []
            for i, x in enumerate(lines, 1):
                if x.rstrip().endswith("{"):
                    opened.append(i)
                elif x.strip() == "}" and size(start := opened.pop(), i) <= budget:
                    assert any(a <= start and i <= b for a, b in got)


def test_files_fall_back_to_windows(spark):
    rows = [("a.py", PYTHON), ("b.py", "x = (\n" + "1,\n" * 200), ("c.zzz", "line\n" * 200), ("d.java", " \n"), ("e.py", None), ("f.json", "[" * 5000 + "]" * 5000 + "\n")]
    d = spark.createDataFrame([("r", "b", *r) for r in rows], "repository_id string, branch string, file_path string, content string")
    got = {}
    for r in chunking.chunk_files(d, budget=60).orderBy("start_line").collect():
        got.setdefault(r["file_path"], []).append((r["start_line"], r["end_line"]))
    windows = chunking.sliding_windows(d.where("file_path = 'b.py'")).orderBy("start_line").collect()
    assert got["b.py"] == [(r["start_line"], r["end_line"]) for r in windows] and len(got["c.zzz"]) == 5
    assert len(got["a.py"]) > 2 and got["f.json"] == [(1, 1)] and set(got) == {"a.py", "b.py", "c.zzz", "f.json"}
    assert chunking.structural_blocks(d.withColumn("language", F.lit("python")).where("file_path = 'b.py'")).count() == 0


def test_overlaps(spark):
    rng = random.Random(1)
    make = lambda n, most: [("f%d" % rng.randrange(3), i, a := rng.randrange(1, 900), a + rng.randrange(most)) for i in range(n)]
    a, b = make(80, 300), make(90, 40)
    schema = "file_path string, chunk_id int, start_line int, end_line int"
    got = sorted(tuple(r) for r in chunking.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["file_path"]).collect())
    want = sorted((f, i, j, min(e, z) - max(s, y) + 1) for f, i, s, e in a for g, j, y, z in b if f == g and s <= z and y <= e)
    assert got == want and len(got) > 100
