"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn int, role string, text string, present_ string, later int"
SOME = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        held = SOME.findall(text)
        out.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """Cost, audit and repaired rows by a cheapest-first search over whole edit sequences, without merging but of equal prospects."""
    broken = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, kept = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(kept)
        if (at, initials) in done or len(audit) > 2 * len(rows) + 2 or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        done.add((at, initials))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, initials + name[0], (*kept, (name, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, kept))
            if broken[at] in ("", "truncated"):
                more = 5 * (broken[at] == "truncated")
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*kept, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, initials + name[0], (*kept, (name, text))))
    raise AssertionError


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of rows in order."""
    broken = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = best(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(broken.count(x) for x in ("blank", "duplicate", "truncated")),
        sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def streamed(rows):
    talk, seen = cr.Conversation(), {}
    for turn, role, text in rows:
        least = seen.setdefault((role, text), turn)
        talk.read(turn, role, text, turn is not None and (least is None or least < turn))
    cost, audit, digest = talk.repair.result()
    return talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost, audit, digest


TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " ", ""]), st.sampled_from(["Yes.", "No!", "so", "", " ", "Why? "])), max_size=7)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_stacks_find_the_cheapest_edits(turns):
    rows = [(k, r, t) for k, (r, t) in enumerate(turns)]
    assert streamed(rows) == plain(rows)


def test_frozen_chunks_do_not_change_the_result(monkeypatch):
    rng = random.Random(3)
    for every in (1, 2, 5):
        monkeypatch.setattr(cr, "_FREEZE", every)
        for _ in range(60):
            rows = [(k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "so", "", f"{k}."])) for k in range(rng.randrange(9))]
            assert streamed(rows) == plain(rows)


def test_a_long_conversation_is_a_stream():
    talk = cr.Conversation()
    for k in range(30_000):
        talk.read(k, "user" if k % 3 else "assistant", f"{k}.", False)
    cost, audit, _ = talk.repair.result()
    assert len(audit.replace("I", "")) == 30_000 and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit)


def messy():
    rng, rows = random.Random(11), []
    for c in range(60):
        for t in range(rng.randrange(7)):
            role = rng.choice(["system", "user", "assistant", None, "Tool", ""]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t, t, None, t + 2]), role, rng.choice(["Fine.", f"Well {t}.", "And then", "Is it? ", None, "", "é…"])))
    rows += [(None, t, "user", f"{t}.") for t in range(4)] + [(100, None, None, None), (100, None, None, None), (101, 3, "user", "x" * 200_000 + ".")]
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    space = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if way == 4 else space(role), "" if way == 1 else re.sub("[.!?]", "", space(text)) if way == 2 else space(text)
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1))
    return {c: plain(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in out.items()}


def test_damage_and_repair_equal_a_plain_run(spark):
    rows = messy()
    found = cr.repairs(cr.damaged(frame(spark, rows)), F.col("present")).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected(rows) and len(found) == len({r[0] for r in rows})


def test_query_equals_a_plain_run(spark):
    from .test_registered import FOLDER
    from lexiloom.llm import registered

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in registered.op12_conversation_repair(spark, FOLDER).collect()} == expected(rows)


def test_repaired_rows_follow_the_audit(spark):
    turns = frame(spark, messy())
    found = cr.repairs(turns).cache()
    lines = {}
    for r in cr.repaired(turns, found).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        own = lines.get(r.conv_id, [])
        assert [x.place for x in own] == list(range(len(own))) and [x.edit for x in own] == [e for e in r.audit if e != "D"]
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256


def test_nothing(spark):
    assert cr.repairs(frame(spark, [])).count() == 0
    (only,) = cr.repairs(frame(spark, [(1, 1, "user", "x")]), F.lit(False)).collect()
    assert tuple(only) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
