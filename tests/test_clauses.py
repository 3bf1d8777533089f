"""Profiles of clauses, their band join, and what a rewrite binds otherwise."""

import random

import pytest

from proselake.operators import clauses as C


def changes(spark, pairs, **more):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, src string, out string")
    out = {}
    for r in C.local_changes(df, ["id"], "src", "out", **more).collect():
        out.setdefault(r["id"], []).append((r["at"], r["reasons"]))
    return {i: [x for _, x in sorted(v)] for i, v in out.items()}


BOUND = [
    (("Method A reached 10 mg, and B reached 20 mg.", "Method A reached 20 mg, and B reached 10 mg."), [["numbers", "bindings"]] * 2),
    (("Group A had 10 mg.", "Group A had 10 kg."), [["numbers", "bindings", "label"]]),
    (("Model A causes loss.", "Loss causes model A."), [["direction", "label", "order"]]),
    (("甲负责训练，乙负责部署。", "甲负责部署，乙负责训练。"), [["direction"]] * 2),
    (("教师影响学生。", "学生影响教师。"), [["direction", "order"]]),
    (("It may work.", "It works."), [["uncertainty"]]),
    (("It may work.", "It might work."), None),
    (("At least 10 samples failed.", "More than 10 samples failed."), [["bounds"]]),
    (("At least 10 samples failed.", "No less than 10 samples failed."), None),
    (("Only 10 samples failed.", "About 10 samples failed."), [["bounds"]]),
    (("A is linked to B in 3 runs.", "A causes B in 3 runs."), [["direction", "label", "relation", "together", "causing"]]),
    (("Shown in 5 runs [1].", "Shown in 5 runs [2]."), [["numbers", "citations"]]),
    (("A range of 3-5 cells.", "A range of 3--5 cells."), [["numbers", "bindings"]]),
    (("It was 5 runs.", ""), [["missing"]]),
    (("It was 5 runs.", None), [["missing"]]),
    ((None, "It was 5 runs."), None),
    (("No change here, we were told", "No change here, we were told"), None),
    (("Plain words.", "Other words."), None),
]


@pytest.mark.parametrize("likeness", [C.edit_share, C.matched_share])
def test_what_is_bound_otherwise(spark, likeness):
    got = changes(spark, [p for p, _ in BOUND], likeness=likeness)
    for i, (pair, want) in enumerate(BOUND):
        assert got.get(i) == want, pair


def test_bindings_reach_and_names(spark):
    texts = ["Model A gave 5 %", "sample B, then something that is far far away 7", "the control group had 3", "A 1 B 2 C 3", "x5 y-2 PeMS04 has 1e", "实验 A 为 3 元"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, clause string")
    got = {r["id"]: (r["labels"], r["bindings"], r["numbers"]) for r in C.profiles(df).collect()}
    assert got[0] == (["model a"], ["model a=5"], ["5"])
    assert got[1] == (["sample b"], [], ["7"])
    assert got[2] == (["control group"], ["control group=3"], ["3"])
    assert got[3][0] == ["a", "b", "c"] and [b.split("=")[0] for b in got[3][1]] == ["a", "b", "c"]
    assert got[4][2] == ["1e"] and got[5][1] == ["a=3元"]


def test_band_join_looks_at_all_inside_the_window(spark):
    """Against a loop over every pair of clauses; several texts, one long, one of a single clause."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    side = lambda n: [f"{word()} {word()} {rng.randrange(9)}" for _ in range(n)]
    pairs = [(side(n), side(m)) for n, m in [(1, 1), (1, 30), (40, 3), (60, 55), (13, 13), (90, 180), (5, 1)]]
    pairs += [(x, [c for c in x if rng.random() < 0.8] + side(3)) for x in (side(70), side(33))]
    df = spark.createDataFrame([(i, ",".join(a), ",".join(b)) for i, (a, b) in enumerate(pairs)], "id long, src string, out string").repartition(3)
    rows = [(i, s, at, c) for i, p in enumerate(pairs) for s, own in enumerate(p) for at, c in enumerate(own)]
    prof = {(r["id"], r["s"], r["at"]): r for r in C.profiles(spark.createDataFrame(rows, "id long, s int, at int, clause string")).collect()}

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    got = {(r["id"], r["at"]): (r["to"], r["score"]) for r in C.aligned(df, ["id"], "src", "out").collect()}
    assert len(got) == sum(len(a) for a, _ in pairs)
    for i, (a, b) in enumerate(pairs):
        for at in range(len(a)):
            e = round(at * max(0, len(b) - 1) / max(1, len(a) - 1))
            x = prof[i, 0, at]
            best = None
            for to in range(max(0, e - C.WINDOW), min(len(b), e + C.WINDOW + 1)):
                y = prof[i, 1, to]
                p, q = x["skeleton"], y["skeleton"]
                s, t = set(x["terms"]), set(y["terms"])
                score = (1 - distance(p, q) / max(len(p), len(q)) if p or q else 1.0) + len(s & t) / max(1, len(s | t))
                if best is None or score > best[1]:
                    best = (to, score)
            assert got[i, at][0] == best[0] and abs(got[i, at][1] - best[1]) < 1e-12


def test_long_text_stays_narrow(spark):
    """Twenty thousand clauses meet at most two bands of others each."""
    text = ",".join(f"part {i} of x" for i in range(20_000))
    df = spark.createDataFrame([(1, text, text)], "id long, src string, out string")
    got = C.aligned(df, ["id"], "src", "out").select("at", "to").collect()
    assert len(got) == 20_000 and all(r["to"] == max(0, r["at"] - C.WINDOW) for r in got)  # all alike: the first of each window


def test_no_pairs(spark):
    df = spark.createDataFrame([], "id long, src string, out string")
    assert C.local_changes(df, ["id"], "src", "out").count() == 0


def test_hint_loses_no_clause_with_facts(spark):
    rng = random.Random(3)
    words = ["Group", "control", "group", "A", "B", "x", "Smith et al", "未来", "未见", "不仅", "不对", "仅", "导致", "相关", "甲", "，", "not", "NOT", "only", "no", "is", "expected to", "will", "at least", "fewer than", "<=", "≠", "3", "a few", "caused", "linked with"]
    words += ["results showed", "according to", "the same as", "nothing", "notable", "canopy", "3rd", "é", "élan", "_may", "may", "in progress", "drove", "however", "of"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(1, 5)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, clause string").localCheckpoint()
    told = lambda d: {(r.id, tuple(r.numbers), tuple(r.bounds), tuple(r.classes), r.skeleton) for r in d.collect()}
    all_of = C.profiles(df).localCheckpoint().where("sensitive")
    assert told(C.with_facts(df)) == told(all_of) and 0 < all_of.count() < len(rows)


def test_facts_are_profiled_once(spark):
    df = spark.createDataFrame([(1, "It has 3 parts, not 4."), (2, None)], "id int, text string")
    rows = C.with_facts(C.clause_rows(df, ["id"], "text"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert filters and not any("regexp_extract_all" in x or "split(" in x for x in filters)
    assert [r.clause for r in rows.orderBy("at").collect()] == ["It has 3 parts", "not 4"]
