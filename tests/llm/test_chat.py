import itertools
import random
import re

from veilspark.llm import chat
from veilspark.llm.common import table

SF = "/root/testdata/sf0.01"
CODE = {"system": 1, "user": 2, "assistant": 3}


def least(roles):
    """The least cost over every choice of labels and merges, empty turns counted from the role sequence that results."""
    best = None
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        cost = sum(0 if a == b else chat.COST_UNKNOWN if a == 0 else chat.COST_RELABEL for a, b in zip(roles, labels))
        for merges in itertools.product((False, True), repeat=len(roles)):
            if any(m and (i == 0 or labels[i] != labels[i - 1]) for i, m in enumerate(merges)):
                continue
            kept = [x for x, m in zip(labels, merges) if not m]
            total, state, legal = cost + chat.COST_MERGE * sum(merges), 0, True
            for x in kept:
                if x == 1:
                    legal &= state == 0
                elif state in (0, 1) and x == 3 or state == x:
                    total += chat.COST_INSERT
                state = x
            total += {0: 0, 1: 2, 2: 1, 3: 0}[state] * chat.COST_INSERT
            if legal and (best is None or total < best):
                best = total
    return best


def cost_of(rows):
    total = 0
    for r in rows:
        code = CODE.get((r.given or "").strip().lower(), 0)
        total += chat.COST_MERGE * r.merged + chat.COST_INSERT * (len(r.inserted) + len(r.closing))
        total += 0 if not r.relabelled else chat.COST_UNKNOWN if code == 0 else chat.COST_RELABEL
    return total


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    body = roles[1:] if roles[0] == "system" else roles
    return body == ["user", "assistant"] * (len(body) // 2) and len(body) % 2 == 0 and body


def test_cheapest_of_all_repairs(spark):
    draw = random.Random(5)
    names = ["system", "user", "assistant", "tool", None, " USER "]
    convs = {n: [draw.choice(names) for _ in range(draw.randrange(1, 6))] for n in range(120)}
    rows = [(n, i, r, f"text {n} {i}") for n, roles in convs.items() for i, r in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (512, 2):
        found = chat.repair(frame, chunk=chunk).cache()
        by = {}
        for r in found.orderBy("conv", "chunk", "place").collect():
            by.setdefault(r.conv, []).append(r)
        for n, roles in convs.items():
            codes = [CODE.get((r or "").strip().lower(), 0) for r in roles]
            assert cost_of(by[n]) == least(codes), roles
            text = "".join(r.piece for r in by[n])
            assert legal(text), text
            assert re.findall(r"text \d+ \d+", text) == [f"text {n} {i}" for i in range(len(roles))]
        assert {r.conv: r.rendered for r in chat.render(found).collect()} == {
            n: "".join(r.piece for r in rows) for n, rows in by.items()}


def test_query_keeps_legal_conversations(spark):
    turns = table(spark, SF, "conversations")
    found = chat.op1_chat_repair(spark, SF).cache()
    assert found.count() == turns.count()
    by, given = {}, {}
    for r in found.orderBy("conv_id", "chunk", "place").collect():
        by.setdefault(r.conv_id, []).append(r)
    for r in turns.orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append(r)
    for n, rows in given.items():
        want = "".join(f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in rows)
        text = "".join(r.piece for r in by[n])
        assert legal(text)
        if legal(want):
            assert text == want


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "late"), (None, 1, "user", "a"),
            (None, 2, None, ""), (2, 5, "system", "only"), (3, 7, "assistant", "b"), (3, 7, "assistant", "a")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", "t" * 5000) for i in range(3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int")
    text = {r.conv: r.rendered for r in chat.render(chat.repair(frame)).collect()}
    assert text[1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert text[None] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[2] == ("<|im_start|>system\nonly<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
                       "<|im_start|>assistant\n<|im_end|>\n") or legal(text[2])
    assert legal(text[3]) and text[3].index("a") >= 0 and re.search(r"a\nb|a<", text[3])
    assert text[4].count("<|im_start|>") == 3000 and legal(text[4])
    assert chat.repair(frame.limit(0)).count() == 0


def test_chunks_by_rank(spark):
    draw = random.Random(7)
    hot = [(None, i % 8 if i % 3 else None, draw.choice(["user", "assistant", None]), f"{i} " + "w" * 300) for i in range(2000)]
    sparse = [(5, 1_700_000_000 + 977 * i, draw.choice(["system", "user", "assistant", "x"]), f"{i}") for i in range(700)]
    frame = spark.createDataFrame(hot + sparse, "conv_id long, turn long, role string, text string")
    one = {}
    for chunk, group in ((4000, 256), (50, 256), (9, 3)):
        by = {}
        for r in chat.repair(frame, chunk=chunk, group=group).orderBy("conv", "chunk", "place").collect():
            by.setdefault(r.conv, []).append(r)
        for conv, rows in by.items():
            size = {None: 2000, 5: 700}[conv]
            assert [(r.chunk, r.place) for r in rows] == [(i // chunk, i % chunk) for i in range(size)]
            keys = [(r.turn is None, r.turn or 0, r.given is not None, r.given or "", r.text) for r in rows]
            assert keys == sorted(keys)
            assert legal("".join(r.piece for r in rows)) and [r for r in rows if r.closing] in ([], rows[-1:])
            assert one.setdefault(conv, cost_of(rows)) == cost_of(rows)
