import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from veilspark.llm import structure
from veilspark.llm.common import table

SF = "/root/testdata/sf0.01"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain(codes):
    """(cost, audit) of the cheapest of all edits, each gap with up to two insertions."""
    best = None
    options = [["D"] if c == "d" else ["D", "K", "R"] for c in codes]
    for choice in itertools.product(*options):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, (*choice, "")))
            cost = sum(structure.COST[e] for e in audit) + sum(c.isupper() and e != "D" for c, e in zip(codes, choice))
            if best is not None and (cost, audit) >= best:
                continue
            kinds = ["" if e == "D" else c.lower() if e == "K" else "?" for c, e in zip(codes, choice)]
            shown = "".join("?" * g + k for g, k in zip(gaps, (*kinds, "")))
            for filled in itertools.product("ua", repeat=shown.count("?")):
                made = iter(filled)
                if LEGAL.fullmatch("".join(next(made) if c == "?" else c for c in shown)):
                    best = (cost, audit)
                    break
    return best


def whole(codes, chunk):
    chunks = [codes[i:i + chunk] for i in range(0, len(codes), chunk)]
    cost, steps = structure.chain([structure.summary(c, i == 0) for i, c in enumerate(chunks)])
    made = [structure.edits(c, a, b, i == len(chunks) - 1) for i, (c, (a, b)) in enumerate(zip(chunks, steps))]
    return cost, "".join(audit for audit, _ in made)


def test_cheapest_of_all_edits():
    draw = random.Random(11)
    for _ in range(150):
        codes = "".join(draw.choice("suaxSUAXdua") for _ in range(draw.randrange(1, 5)))
        want = plain(codes)
        for chunk in (1, 2, 9):
            assert whole(codes, chunk) == want, codes


def test_chunks_agree_on_long_conversations():
    draw = random.Random(12)
    for _ in range(40):
        codes = "".join(draw.choice("suaxSUAXdua") for _ in range(draw.randrange(50, 400)))
        assert len({whole(codes, chunk) for chunk in (3, 17, 64, 500)}) == 1


def test_stacks_are_the_grammar_s():
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            tops = [structure.stack((0,))]
            for symbol in word:
                tops = [after for top in tops for after in structure.shifted(top, symbol)]
            assert any(t.state in structure.LR.ends for t in tops) == bool(LEGAL.fullmatch("".join(word)))


def expected(rows):
    """The contract, one conversation of damaged rows (turn, role, text) at a time."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = whole(codes, 10_000)
    lines, left, place, system = [], iter(rows), 0, 0
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        place += 1
        system += place == 1 and edit == "K" and row[1][:1] == "s"
        role = row[1] if edit == "K" else "user" if (place - system) % 2 else "assistant"
        lines.append(f"{role}:{row[2] if row else ''}")
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha


def shaped(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


def harmed(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        one = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        by[conv] += [one] * (0 if kind == 0 else 2 if kind == 3 else 1)
    empty = hashlib.sha256(b"").hexdigest()
    return {conv: expected(r) if r else (0, 0, 0, 0, 0, 0, "", empty) for conv, r in by.items()}


def test_query_equals_the_contract_and_its_sql(spark):
    found = {r.conv_id: shaped(r) for r in structure.op13_glr_repair(spark, SF).collect()}
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found == harmed(rows)
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    sql = db.sql(structure.ORACLE)
    order = [sql.columns.index(c) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                            "repaired_sha256")]
    assert {r[order[0]]: tuple(r[i] for i in order[1:]) for r in sql.fetchall()} == found


@pytest.mark.parametrize("chunk", [256, 4])
def test_odd_rows(spark, tmp_path, chunk, monkeypatch):
    draw = random.Random(13)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "assistant"]
    texts = ["Yes.", "no", None, "", "  \t", "Yes.", "Why?\n", "a" * 400 + "!", "a" * 400 + "?", "é…", "last one! "]
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, 0, 1, 2, 3, 9, 9]), draw.choice(roles), draw.choice(texts))
            for _ in range(120)]
    rows += [(7, i, draw.choice(roles), f"{i}" + draw.choice(" .!")) for i in range(700)]
    rows += [(9, 0, "user", "x" * 300_000 + "."), (10, -(1 << 62), "user", "a."), (10, 1 << 62, "assistant", "b.")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, at int, conv int")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(structure.repair, "__defaults__", (*structure.repair.__defaults__[:-1], chunk))
    found = {r.conv_id: shaped(r) for r in structure.op13_glr_repair(spark, str(tmp_path)).collect()}
    want = harmed(rows)
    huge = [k for k, v in want.items() if v[0] >= 1 << 63]
    want |= {k: (None, *want[k][1:]) for k in huge}
    assert found == want
    none = frame.limit(0).select("conv_id", "turn", "role", "text")
    convs, kept = structure.repair(none)
    assert convs.count() == kept.count() == structure.digests(kept).count() == 0
