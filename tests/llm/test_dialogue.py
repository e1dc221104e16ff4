"""Conversation repair against brute force, and on awkward rows."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from corvane.llm import dialogue

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, repaired turns) over all edits; turns: (role, text, fault)."""

    def after(state, initial):
        """States are what was emitted, as far as it matters: nothing, s, or the last of u and a."""
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @functools.cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        for initial, role in (("u", "user"), ("a", "assistant")):
            to = after(state, initial)
            if to and inserted < 2:
                ways += [(c + 3, "I" + e, ((role, ""), *r)) for c, e, r in [best(i, to, inserted + 1)] if c is not None]
        if i < len(turns):
            role, text, fault = turns[i]
            ways += [(c + 4, "D" + e, r) for c, e, r in [best(i + 1, state, 0)] if c is not None]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for initial, new, cost, edit in ((role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")):
                    to = after(state, initial)
                    if to:
                        ways += [(c + cost + more, edit + e, ((new, text), *r)) for c, e, r in [best(i + 1, to, 0)] if c is not None]
        return min(ways, key=lambda w: w[:2]) if ways else (None, "", ())

    return best(0, "", 0)


def visible(t):
    return [c for c in t if c not in " \t\n\v\f\r"]


def report(rows):
    """What op11 gives for a conversation's rows in order; role and text not null."""
    seen, turns, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        fault = "blank" if not visible(text) else "duplicate" if (role, text) in seen else "truncated" if visible(text)[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, fixed = cheapest(tuple(turns))
    assert GRAMMAR.match("".join(r[0] for r, _ in fixed))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def by_conversation(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for c, r in out.items()}


def expect(rows):
    found = {c: report(r) for c, r in by_conversation(damage(rows)).items()}
    return {c: found.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in {r[0] for r in rows}}


@pytest.fixture
def written(spark, tmp_path):
    def write(rows, schema=SCHEMA):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return {r["conv_id"]: tuple(r)[1:] for r in dialogue.op11(spark, str(tmp_path)).collect()}

    return write


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in dialogue.op11(spark, data).collect()} == expect(rows)


def test_random_conversations(written):
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No", "So?", "", " \n", "Well!\n ", "one", "two.", "three", "é", "é.", None]
    rows = [(c, t, rng.choice(roles[: rng.choice([2, 5, 9])]), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}.") for c in range(700) for t in sorted(rng.sample(range(14), rng.randrange(11)))]
    assert written(rows) == expect(rows)


def test_awkward_rows(written):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, "user", "x."), (1, None, "assistant", "y."), (2, None, "user", "x.")]
    rows += [(c, t, "user", "same.") for c in (3, 4) for t in (1, 1, 1)] + [(5, t, "ua"[t % 2] + "x", f"{t}.") for t in range(1500)]
    rows += [(i, 0, "user", "gone.") for i in range(100, 160)]
    got, want = written([(*r, 1, "x") for r in rows], SCHEMA + ", Cost int, AUDIT string"), expect([r for r in rows if r[0] != 5])
    assert {c: r for c, r in got.items() if c != 5} == want
    assert any(not r[6] and r[5] == 0 for c, r in want.items() if c and c >= 100)
    assert len(got[5][6]) >= 1400 and set(got[5][6]) <= set("DIKR")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = dialogue.op11(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_common_signatures_and_rare_ones_meet_their_audits(spark, monkeypatch):
    rows = [(c, t, "user" if (t + c % 3) % 2 else "assistant", f"{c} {t}" + "." * (c % 5 > 0)) for c in range(200) for t in range(1 + c % 7)]
    d = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for common in (0, 4, 1 << 30):
        monkeypatch.setattr(dialogue, "COMMON", common)
        found[common] = sorted(tuple(r) for r in dialogue.audited(dialogue.faults(d)).collect())
    assert len(found[0]) == 200 and found[0] == found[4] == found[1 << 30] and all(r[-1] for r in found[0])


def test_repaired_turns(spark):
    d = spark.createDataFrame([(1, 1, "assistant", "b."), (1, 0, "system", "Be kind."), (1, 2, "user", ""), (1, 3, "user", "c.")], SCHEMA)
    got = dialogue.repair(d).first()
    assert (got["audit"], got["cost"], got["blank"], got["illegal"]) == ("KIKDKI", 10, 1, 1)
    assert [tuple(t) for t in got["turns"]] == [("system", "Be kind.", "keep"), ("user", "", "insert"), ("assistant", "b.", "keep"), ("user", "c.", "keep"), ("assistant", "", "insert")]
