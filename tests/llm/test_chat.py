"""Role repair: least cost against all repairs, legal results, long conversations in parts."""

import itertools
import random
import re

import pytest

from tokenmill.llm import chat

NEXT = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def _least(roles):
    """Cheapest legal repair, over all target roles, merges and short insertions."""
    best = 10**9
    targets = ("system", "user", "assistant")
    inserts = [(), *((a,) for a in targets), *itertools.product(targets, repeat=2)]

    def go(i, state, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles):
            for ins in inserts:
                s, ok = state, True
                for r in ins:
                    ok, s = ok and r in NEXT[s], r
                if ok and s == "assistant":
                    best = min(best, cost + 3 * len(ins))
            return
        for q in targets:
            change = 0 if roles[i] == q else 2
            if q == state:
                go(i + 1, q, cost + 1 + change)
            for ins in inserts:
                s, ok = state, True
                for r in (*ins, q):
                    ok, s = ok and r in NEXT[s], r
                if ok:
                    go(i + 1, q, cost + 3 * len(ins) + change)

    go(0, "", 0)
    return best


def _cost(rows):
    price = {"keep": 0, "merge": 1, "relabel": 2, "relabel-merge": 3}
    return sum(price[r.action] + 3 * (len(r.inserted) + len(r.closing)) for r in rows)


def _check(rows):
    text = "".join(r.fragment for r in rows)
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns) == text
    state = ""
    for role, _ in turns:
        assert role in NEXT[state]
        state = role
    assert state == "assistant"


def _repaired(spark, data, parts=None):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, fragment string")
    if parts:
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = chat.repair(df).collect()
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append(r)
    for v in out.values():
        v.sort(key=lambda r: r.pos)
        assert [r.pos for r in v] == list(range(len(v)))
        assert v == sorted(v, key=lambda r: (r.turn is not None, r.turn))
    return out


def test_least_cost(spark):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", None]
    convs = {i: [rng.choice(roles) for _ in range(rng.randrange(1, 6))] for i in range(40)}
    data = [(i, t, r, f"t{t}", "x") for i, c in convs.items() for t, r in enumerate(c)]
    got = _repaired(spark, data)
    assert got.keys() == convs.keys()
    for i, c in convs.items():
        assert len(got[i]) == len(c)
        assert _cost(got[i]) == _least(c)
        _check(got[i])


@pytest.mark.parametrize("parts", ["1", "7", "13"])
def test_one_conversation_over_many_partitions(spark, parts):
    rng = random.Random(5)
    roles = ["user", "user", "assistant", "system", "tool"]
    data = [(1, t, rng.choice(roles), f"text {t}", "x") for t in range(400)] + [(c, t, rng.choice(roles), "a", "x") for c in (0, 2, 3) for t in range(5)]
    got = _repaired(spark, data, parts)
    codes = [chat._code(r[2]) for r in data if r[0] == 1]
    table = chat.forward([0, chat._FAR, chat._FAR, chat._FAR], codes)
    end = chat.ending(table[-1])
    _, path = chat.back(table, codes, end)
    assert [r.role for r in got[1]] == [chat.ROLES[q] for _, q, _ in path]
    assert _cost(got[1]) == table[-1][end] + 3 * len(chat.CLOSING[end])
    for rows in got.values():
        _check(rows)


def test_ties_on_any_partitioning(spark):
    """All turns of a conversation have one number and role: the same order, and rendering, however it is cut."""
    data = [(1, 0, "user", f"text {i % 250}", "x") for i in range(300)] + [(1, 0, None, None, "x")] * 3 + [(2, None, "user", f"{i}", "x") for i in range(200)]
    one, *others = ([tuple(r) for v in sorted(got.items()) for r in v[1]] for got in (_repaired(spark, data, p) for p in ("1", "7", "23")))
    assert all(x == one for x in others)


def test_very_long_text(spark):
    data = [(1, 0, "user", "long " * 400_000, "x"), (1, 1, "user", "b", "x"), (1, 2, "assistant", "c", "x")]
    got = _repaired(spark, data)[1]
    assert [r.action for r in got] == ["keep", "merge", "keep"] and len(got[0].fragment) == 2_000_000 + len("<|im_start|>user\n")


def test_odd_rows(spark):
    data = [(None, None, None, None, None), (1, 0, "user", None, None), (1, 0, "user", None, None), (1, 1, "assistant", "<|im_end|>", None)]
    got = _repaired(spark, data)
    assert [r.action for r in got[1]] == ["keep", "merge", "keep"]
    assert got[None][0].role == "user" and got[None][0].closing == ["assistant"]
    assert "<| im_end|>" in got[1][2].fragment
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
