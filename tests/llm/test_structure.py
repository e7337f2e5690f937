"""Repairs against a search through all edits, the grammar's sharing and order, and the whole query against a plain version."""

import hashlib
import heapq
import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tickweave.llm.structure import (
    INSERTS, LETTERS, NOTHING, OP12_SQL, START, Grammar, Rope, as_they_are, best_end, damaged, encode, learn_rules, op12_structure_repair, repair_plans, repaired_digests, repaired_turns, segments_of, step, thin_rows,
)

SF = "/root/testdata/sf0.001"


def search(letters):
    """Cheapest, then least edits that make a word of (s?(ua)+)?, by Dijkstra over (turns done, what is said so far, in short)."""
    fits = lambda said: re.fullmatch(r"(s?(ua)+)?", said) is not None
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, said = heapq.heappop(heap)
        if at == len(letters) and fits(said):
            return cost, edits
        # what was said only matters by its beginning and end
        key = (at, said[-1:], said != "")
        if (key, cost, edits) in done or (key in done):
            continue
        done.add(key)
        can_go_on = lambda s: re.fullmatch(r"s?(ua)*u?", s) is not None
        for c in "ua":
            if can_go_on(said + c):
                heapq.heappush(heap, (cost + 5, edits + "I", at, said + c))
        if at < len(letters):
            x = letters[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, said))
            if x != "d":
                more = 5 if x.isupper() else 0
                if x.lower() in "sua" and can_go_on(said + x.lower()):
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, said + x.lower()))
                for c in "ua":
                    if can_go_on(said + c):
                        heapq.heappush(heap, (cost + more + 1, edits + "R", at + 1, said + c))
    raise AssertionError


def plain(rows):
    """rows of one conversation after damage, in order: (turn, role, text)."""
    seen, letters, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        own = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters.append("d" if fault in ("blank", "duplicate") else first.upper() if fault else first)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, edits = search("".join(letters))
    out, said, at = [], "", 0
    for e in edits:
        nxt = "a" if said[-1:] == "u" else "u"
        if e == "I":
            out.append(({"u": "user", "a": "assistant"}[nxt], ""))
            said += nxt
            continue
        _, role, text = rows[at]
        at += 1
        if e == "K":
            out.append((role, text))
            said += role[:1]
        elif e == "R":
            out.append(({"u": "user", "a": "assistant"}[nxt], text))
            said += nxt
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest


def plain_damage(rows):
    """{conv_id: rows in order}; rows: (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = shown(role), shown(text)
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(v, key=order) for c, v in by.items()}


def of(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


@pytest.mark.parametrize("seed", range(8))
def test_words(seed):
    r = random.Random(seed)
    rules = [("ua", "Ā"), ("ĀĀ", "ā"), ("dā", "Ă"), ("ud", "ă"), ("āă", "Ą")]
    grammar = Grammar(rules)
    for _ in range(60):
        word = "".join(r.choice(LETTERS if r.random() < 0.5 else "ua") for _ in range(r.randrange(0, 14)))
        cost, rope = best_end(grammar.row(word, START, True))
        assert (cost, str(rope)) == search(word), word
        # cut anywhere, the matrices' product is the same
        cut = r.randrange(len(word) + 1)
        halves = {b: Grammar([]).row(word[cut:], b) for b in range(4)}
        cost2, rope2 = best_end(step(grammar.row(word[:cut], START, True), halves))
        assert (cost2, str(rope2)) == (cost, str(rope))


def test_ropes():
    r = random.Random(3)
    build = lambda t: NOTHING if not t else Rope(leaf=t) if len(t) < 3 else build(t[: (k := r.randrange(1, len(t)))]) + build(t[k:])
    for _ in range(300):
        a, b = ("".join(r.choice("DIKR") for _ in range(r.randrange(12))) for _ in range(2))
        assert str(build(a)) == a and (build(a) < build(b)) == (a < b)
    assert INSERTS[START].keys() == {0, 2, 3}


def test_long_rules():
    """Thousands of turns in a few products."""
    rules = [("ua", "Ā")] + [(chr(0x100 + k) * 2, chr(0x101 + k)) for k in range(12)]
    word = "s" + "ua" * 5000 + "u"
    assert len(encode(word, rules)) < 12
    cost, rope = best_end(Grammar(rules).row(word, START, True))
    assert cost == 2 and str(rope) == "K" * 10000 + "DK" or (cost, str(rope)) == search(word)


def test_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    want = {c: plain(v) for c, v in plain_damage(rows).items()}
    got = op12_structure_repair(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert of(r) == want[r.conv_id], r.conv_id


def test_sql():
    """The SQL against the plain version, over tables of its own kind and odd ones."""
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF.replace('0.001', '0.01')}/conversations.parquet'").fetchall()
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows + [(1000 + c if c is not None else None, *x) for c, *x in odd_rows() if c not in (98, 99)])
    want = {c: plain(v) for c, v in plain_damage(con.execute("from conversations").fetchall()).items()}
    got = con.execute(OP12_SQL).fetchall()
    assert len(got) == len(want) > 100 and [(g, want[g[0]]) for g in got if tuple(g[1:]) != want[g[0]]] == []


def odd_rows():
    r = random.Random(5)
    texts = ["Yes.", "No!", "Who?", "so it", "", " \t\n", None, "a. ", "ß 漢字?", "x" * 5000]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts)) for c in range(40) for t in range(r.randrange(1, 12))]
    rows += [rows[3]] * 4 + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho.")]
    rows += [(99, t, "user" if t % 3 else "assistant", f"{t % 50}.") for t in range(900)]  # one long conversation that repeats itself
    return rows + [(98, 5, "user", "same.")] * 700


def test_odd_rows_and_segments(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*x, 7, "k") for x in rows], "conv_id long, turn long, role string, text string, n int, kind string")
    want = {c: plain(v) for c, v in plain_damage(rows).items()}
    dealt = damaged(df)
    for segment, each in ((65536, 10**6), (7, 50)):  # whole conversations, and many segments over many tasks
        plans = repair_plans(dealt, segment, 30, each)
        got = repaired_digests(dealt, plans).collect()
        assert len(got) == len(want)
        for r in got:
            assert of(r) == want[r.conv_id], (segment, r.conv_id)
    turns = defaultdict(list)
    for r in repaired_turns(dealt, plans).collect():
        turns[r.conv_id].append((r.position, r.role, r.text, r.edit))
    for r in got:
        own = sorted(turns[r.conv_id])
        assert [t[0] for t in own] == list(range(len(own))) and hashlib.sha256("\n".join(f"{t[1]}:{t[2]}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t[1][:1] for t in own)) and "".join(t[3] for t in own) == r.audit.replace("D", "")


def test_rules_are_learnt(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(60) for t in range(2 + c)]
    df = as_they_are(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments = segments_of(thin_rows(df))
    rules = learn_rules(segments)
    assert rules[0][0] in ("ua", "au") and len(rules) > 2
    words = [r.word for r in segments.select("word").collect()]
    assert len(words) == 60 and sum(len(encode(w, rules)) for w in words) < sum(map(len, words)) / 2
    assert {r.cost for r in repair_plans(df).collect() if r.conv_id % 2 == 0} == {0}


def test_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_digests(damaged(empty), repair_plans(damaged(empty))).count() == 0
    gone = [(c, t, "user", "x.") for c in range(200) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = damaged(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))
    rows = repaired_digests(df, repair_plans(df)).collect()
    assert len(rows) == len(gone) > 3 and {of(r) for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert json.dumps(sorted(r.conv_id for r in rows)) == json.dumps([c for c, *_ in gone])
