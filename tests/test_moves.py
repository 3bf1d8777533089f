"""Moved sentences against a loop over all pairs."""

import random
import re

from proselake.operators import moves as V


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(a, b, least):
    n = max(len(a), len(b))
    return distance(a, b) * 100 <= n * (100 - least)


def units(text):
    out = []
    for p in re.split("\n+", text):
        bare = (re.sub("[^一-鿿a-z0-9]", "", s.lower()) for s in re.findall("[^\n。！？!?]+", p))
        out.append([u for u in bare if len(u) >= 6])
    return out


def plain(source, output):
    before, after = units(source), units(output)
    owners = {}
    for i, group in enumerate(before):
        for u in group:
            owners.setdefault(u, set()).add(i)
    out = set()
    for u, own in owners.items():
        if len(own) == 1:
            i = next(iter(own))
            kept = any(alike(u, x, V.KEPT) for x in (after[i] if i < len(after) else []))
            there = [x for k, g in enumerate(after) if k != i for x in g]
            if not kept and any(u in x or x in u or alike(u, x, V.FOUND) for x in there):
                out.add((i, u))
    return out


def test_moved_like_all_pairs(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join("".join(rng.choice("abce") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9)))

    def changed(s):
        s = list(s)
        for _ in range(rng.randrange(len(s) // 4 + 1)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        return "".join(s)

    pairs = [("Eins zwei drei!\nVier fünf sechs!", "Vier fünf sechs!\nEins zwei drei!"), ("甲乙丙丁戊己。\n子丑寅卯辰巳。", "甲乙丙丁戊己子丑寅卯辰巳。\n空"), ("same one here!\nsame one here!", "x\nsame one here!"), ("", "abc"), ("abcdefgh", "")]
    for _ in range(60):
        paras = [[sentence() for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 6))]
        loose = [s for p in paras for s in p]
        rng.shuffle(loose)
        new = [[changed(s) if rng.random() < 0.6 else s for s in loose[k::3]] for k in range(3)]
        pairs.append(tuple("\n\n".join("! ".join(p) for p in side) for side in (paras, new)))
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(len(pairs), None, "abcdefg"), (len(pairs) + 1, "abcdefg", None)]
    df = spark.createDataFrame(rows, "id long, src string, out string").repartition(4)
    got = {}
    for r in V.moved_sentences(df, ["id"], "src", "out").collect():
        got.setdefault(r["id"], set()).add((r["para"], r["unit"]))
    want = {i: plain(a, b) for i, (a, b) in enumerate(pairs)}
    assert got == {i: x for i, x in want.items() if x} and sum(map(len, got.values())) > 60


def test_alike_pairs_lose_none(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (6, 7, 8, 9, 11, 12, 13, 20, 33, 60, 97)]
    every = {x[:k] + rng.choice("abcd") * rng.randrange(3) + x[k + rng.randrange(3) :] for x in base for k in rng.choices(range(len(x)), k=12)} | set(base)
    every = sorted(x for x in every if len(x) >= 6)
    df = spark.createDataFrame([(1, x) for x in every], "id long, unit string")
    for least in (V.KEPT, V.FOUND):
        got = {(r["unit"], r["__unit"]) for r in V.alike_pairs(df, df, ["id"], least).collect()}
        assert got == {(a, b) for a in every for b in every if alike(a, b, least)}


def test_blocks_of_long_texts_lose_none(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 4)  # a text of more sentences is dealt to several blocks, each pair in one
    rng = random.Random(8)
    words = ["the", "and", "ing", "ion", "her", "ent"]  # frequent pieces, so that all sentences share some
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    later = [x.replace("ion", "io", 1) for x in reversed(lines)]
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(later))], "id long, src string, out string")
    got = sorted((r["para"], r["unit"]) for r in V.moved_sentences(df, ["id"], "src", "out").collect())
    assert got == sorted(plain("\n".join(lines), "\n".join(later))) and len(got) > 20


def test_no_texts(spark):
    assert V.moved_sentences(spark.createDataFrame([], "id long, src string, out string"), ["id"], "src", "out").count() == 0
