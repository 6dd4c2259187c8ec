import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from haulage.llm import conversation_repair as C
from awkward import ident, prose, result

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("hit", T.LongType()), T.StructField("copies", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("name", T.StringType())])
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = "\t\n\x0b\x0c\r "


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(name.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out.append((conv, turn, role, text, {0: 0, 3: 2}.get(hit, 1)))
    return out


def cheapest(rows):
    """(cost, audit) by dynamic programming over all edits, inserts up to two in a row."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    turn = {0: "u", 1: "u", 2: "a", 3: "u"}

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                t = step[s][turn[s]]
                out[t] = min(out.get(t, (1 << 60, "")), (c + 5, a + "I"))
        return out

    states = inserts({0: (0, "")})
    for initial, fault in rows:
        new = {}

        def offer(s, v):
            new[s] = min(new.get(s, (1 << 60, "")), v)

        for s, (c, a) in states.items():
            offer(s, (c + 2, a + "D"))
            if fault != "gone":
                c += 5 if fault == "open" else 0
                if initial in step[s]:
                    offer(step[s][initial], (c, a + "K"))
                offer(step[s][turn[s]], (c + 1, a + "R"))
        states = inserts(new)
    return min(states[s] for s in (0, 3) if s in states)


def plain(rows):
    """Results by conversation, step by step."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv for _ in range(r[4])]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, counts, faults = set(), [0, 0, 0], []
        for _, _, role, text, _ in own:
            bare = text.rstrip(SPACE)
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            faults.append({0: "gone", 1: "gone", 2: "open", None: ""}[kind])
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(list(zip(initials, faults)))
        kept, i, state = [], 0, ""
        for e in audit:
            follows = "assistant" if state == "u" else "user"
            if e == "I":
                kept.append(follows + ":")
                state = follows[0]
                continue
            _, _, role, text, _ = own[i]
            i += 1
            if e == "D":
                continue
            role = role if e == "K" else follows
            kept.append(f"{role}:{text}")
            state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def awkward(seed=4):
    r, rows = random.Random(seed), []
    texts = ["Hello there.", "What now?", "no end", "", "  \n ", "Fine!  ", "Hello there.", " ", "trail ünï", None, "q?\x0b"]
    for conv in [*range(40), None]:
        for turn in range(r.randrange(1, 9)):
            t = None if r.random() < 0.08 else turn * (1 if r.random() < 0.8 else 3)
            rows.append((conv, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), r.choice(texts)))
    rows += [rows[0], rows[0], (77, 5, "user", "one.")]
    rows += [(90, None, "user", None), (90, None, "assistant", "b.")]
    return rows


def test_equals_brute_force(spark):
    rows = awkward()
    out = C.repair(C.damaged(frame(spark, rows).repartition(3)))
    assert out.columns == list(COLUMNS)
    assert result(out, *COLUMNS) == plain(damage(rows))


def test_rows_as_given(spark):
    rows = awkward(9)
    out = C.repair(C.as_given(frame(spark, rows)))
    assert result(out, *COLUMNS) == plain([(c, t, " " if r is None else r, " " if x is None else x, 1) for c, t, r, x in rows])


def long_rows(n=3000, seed=2):
    r = random.Random(seed)
    return [(5, k, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["a.", "b", f"turn {k}.", f"turn {k}!", ""])) for k in range(n)]


def test_one_long_conversation(spark):
    """A conversation that spreads over tasks, and one with a very long text."""
    rows = long_rows(1500) + [(4, 0, "user", "x."), (6, 0, "system", "y."), (6, 1, "user", "x." + prose(1, 20000))]
    whole = C.repair(C.damaged(frame(spark, rows).repartition(5)))
    assert result(whole, *COLUMNS) == plain(damage(rows))


@pytest.mark.parametrize("stretch", [1, 7, 50, 1024])
def test_stretches_join_to_the_same_repair(stretch):
    flags, seen = [], set()
    for _, _, role, text in long_rows(400):
        bare = text.rstrip(SPACE)
        flags.append((role[:1], C.GONE if not bare or (role, text) in seen else C.OPEN if bare[-1] not in ".!?" else C.OK))
        seen.add((role, text))
    parts = [tuple(flags[k:k + stretch]) for k in range(0, len(flags), stretch)]
    spans = [C.stretch_spans(s, (0,) if k == 0 else (0, 1, 2, 3), False) for k, s in enumerate(parts)]
    assert C.joined(spans) == cheapest([(i, {C.OK: "", C.GONE: "gone", C.OPEN: "open"}[f]) for i, f in flags])


def test_every_short_structure():
    """All conversations of up to four rows with any initial and fault."""
    kinds = list(itertools.product("suat", (C.OK, C.GONE, C.OPEN)))
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            want = cheapest([(i, {C.OK: "", C.GONE: "gone", C.OPEN: "open"}[f]) for i, f in rows])
            assert C.joined([C.stretch_spans(rows, (0,), True)]) == want
            if n > 1:
                parts = [C.stretch_spans(rows[:1], (0,), False), C.stretch_spans(rows[1:], (0, 1, 2, 3), False)]
                assert C.joined(parts) == want


def test_small_stretches_in_spark(spark, monkeypatch):
    """Boundaries everywhere: counts, faults and audits add up over stretches."""
    rows = awkward(3) + long_rows(150)
    want = plain(damage(rows))
    # run here, since tasks have the module's own bound
    source = C.damaged(frame(spark, rows))
    monkeypatch.setattr(C, "STRETCH", 3)
    faults = C._faults(source)
    keys = ["conv_id", C.F.col("turn").asc_nulls_first(), "role", "digest"]
    local = faults.orderBy(*keys).select("conv_id", "turn", "role", "digest", "copies", "fault", "later").toArrow().to_batches()
    by = {}
    for batch in C._stretches(iter(local)):
        for r in batch.to_pylist():
            by.setdefault(r["conv_id"], []).append(C.json.loads(r["body"]))
    for conv, gaps, blank, duplicate, truncated, illegal, cost, audit, _ in want:
        if not any(c > 0 for i, *_, c in damage(rows) if i == conv):
            continue
        own = C._Repair(conv)
        own.stretches = by[ident(conv)]
        own.derive()
        assert (own.cost, own.audit) == (cost, audit)
        own.row = lambda *a: None
        own.at = len(own.audit)
        assert own.result()[1:6] == (gaps, blank, duplicate, truncated, illegal)


def test_empty_table(spark):
    assert C.repair(C.damaged(frame(spark, []))).collect() == []
