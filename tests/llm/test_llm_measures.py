"""Whitening, host rules and the source audit: against plain versions, and what odd rows give."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from proselake.llm import host_rules, source_audit, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- op11


def reference(vectors):
    """Exact means, covariance by fractions, eigenvectors of it."""
    xs = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = [list(x) for x in {tuple(x) for x in xs}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = [[sum(Fraction(n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array([[float(e) for e in row] for row in v]))
    return xs, n, s, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (0.3, 1e6), (50.0, -3.0)])
def test_whitening_like_fractions(spark, scale, shift):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 6)) * [5, 3, 2, 1, 0.5, 0.2] * scale + shift).tolist()
    vectors += vectors[:25]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    xs, n, s, values, axes = reference(vectors)
    assert len(got) == 4 * len(vectors)
    for c in range(4):
        want = (np.array(xs, float) - np.array(s) / n) @ axes[:, c] / math.sqrt(values[c])
        have = np.array([got[i, c + 1]["whitened"] for i in range(len(vectors))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert abs(got[0, c + 1]["explained"] - values[c] / values.sum()) < 1e-9
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in got.values())
    assert all(got[i, 1]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in enumerate(xs))


def test_double_double_keeps_what_doubles_lose():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3)) * [1e9, 1.0, 1e-9]
    high, low = whitening.outer_sum(x, np.zeros_like(x), tuple(np.zeros((2, 3, 3))))
    for i in range(3):
        for j in range(3):
            exact = sum(Fraction(a) * Fraction(b) for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True))
            size = sum(abs(a * b) for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True))
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction(size) / 2**70


def test_components_of_close_values():
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(8, 8)))
    a = q @ np.diag([9, 9 - 1e-6, 4, 3, 2, 1, 0.5, 0]) @ q.T
    values, axes = whitening.components((a + a.T) / 2, np.zeros((8, 8)), 4)
    assert np.abs(values - [9, 9 - 1e-6, 4, 3]).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-14
    same, axes = whitening.components(np.eye(5) * 7, np.zeros((5, 5)), 4)
    assert np.abs(same - 7).max() < 1e-14 and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-14


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<double>, n string, component int"
    rows = [(1, [1.0, 2.0], "a", 3), (2, None, "b", 3), (3, [1.0, None], "c", 3), (4, [nan, 1.0], "d", 3), (5, [inf, 1.0], "e", 3), (6, [], "f", 3), (7, [1.0], "g", 3), (None, [1.0, 2.0], "h", 3), (1, [1.0, 2.0], "i", 3), (9, [-0.0, 5.0], "j", 3), (10, [1e300, 1.0], "k", 3)]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((i, c, 2) for i in ("1", "1", "None", "9") for c in (1, 2))
    first = [r for r in got if r["component"] == 1]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in first)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in got if r["component"] == 2)
    alone = whitening.whiten(spark.createDataFrame(rows[:1], kind)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 2
    for none in (rows[1:2], []):
        empty = whitening.whiten(spark.createDataFrame(none, kind))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 5], [3, 4]], np.int64)
    assert whitening._deviations(x, 1 << 20, [0, 0]) == [None, (3 << 20) ** 2 + (4 << 20) ** 2]
    assert whitening._deviations(np.array([[3_000_000_000]], np.int64), 1, [0]) == [9 * 10**18]


# ---- op12


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_like_plain(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b", "one " * 7, "one " * 8, "one " * 9, "x\n\nx\n \n \nx\r\nx\r", "😀 ü# *\x0b|\x0c\x85\xa0 &", "a b c d e f g h\na b c d e f g h", "w " * 30_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "#"]) * 3 for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = host_rules.measured(df, df.doc_id).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_hosts_decide(spark):
    """A host that mostly breaks a rule goes whole, a small one is drawn to the others, and a lone failure among clean hosts is a false alarm."""
    word = lambda i: f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    clean = lambda i: " ".join(word(i * 40 + k) for k in range(30))
    noisy = lambda i: " ".join(word(i * 40 + k) + "#" for k in range(30))
    rows = [("good", clean(i)) for i in range(199)] + [("good", noisy(0))] + [("bad", noisy(i)) for i in range(90)] + [("bad", clean(i)) for i in range(10)]
    rows += [("small", noisy(1)), ("small", clean(2)), (None, noisy(3)), (None, clean(4)), (None, "few words"), ("other", clean(5))]
    for k in range(20):
        rows += [(f"h{k}", clean(i)) for i in range(50)]
    df = spark.createDataFrame([(i, s, t, "x", "y") for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, host string, rejected string")
    got = {r["doc_id"]: r for r in host_rules.judged(df).collect()}
    assert len(got) == len(rows)
    of = lambda name: [got[i] for i, (s, _) in enumerate(rows) if s == name]
    assert not any(r["kept"] for r in of("bad")) and all(r["host_rejected"] for r in of("bad"))
    assert not any(r["base_failed"] for r in of("bad"))
    assert all(r["kept"] for r in of("good")), "one failure of two hundred at a clean host"
    assert [r["kept"] for r in of("small")] == [False, True] and not of("small")[0]["host_rejected"]
    assert [r["kept"] for r in of(None)] == [True, True, False]
    assert all(r["kept"] for k in range(20) for r in of(f"h{k}"))


def test_host_rules_odd_rows(spark):
    kind = "doc_id long, text string, source string, n_words int, kept string"
    empty = host_rules.judged(spark.createDataFrame([], kind))
    assert empty.count() == 0
    rows = [(None, None, None, 1, "k"), (1, "", "s", 1, "k"), (1, "", "s", 1, "k"), (2, "a " * 25, "s", 1, "k")]
    got = sorted(tuple(r)[:8] for r in host_rules.judged(spark.createDataFrame(rows, kind)).fillna({"doc_id": -1}).collect())
    assert got == [(-1, 0, 0, 0, 0, 0, True, False), (1, 0, 0, 0, 0, 0, True, False), (1, 0, 0, 0, 0, 0, True, False), (2, 25, 25, 0, 0, 25, True, False)]


# ---- op13


def plain_audit(rows, least=10, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = {}, {}, {}
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.setdefault(lang, set()).add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        for t in set(terms):
            docs[lang, t] = docs.get((lang, t), 0) + 1
        for t in terms:
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        c = {(s, t): count.get((lang, s, t), 0) for s in sources for t in kept}
        n = {s: sum(c[s, t] for t in kept) for s in sources}
        v, whole = len(kept), sum(n.values())
        p = {(s, t): 1 + 10**9 * (c[s, t] + 2) // (n[s] + 2 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(c[s, t] for s in sources) + 2) // (whole + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s, t], q[t]), t.encode(), t) for t in kept if c[s, t] > 0 and p[s, t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


def test_audit_like_plain(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "été", "naïve", "x1y", "中文", "😀", "a_b", "K", "ﬁ", "zoo", "do-re"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for _ in range(300)]
    rows += [("de", "a", None), ("de", "b", "einzeln"), ("it", "solo", "x"), ("en", "c", ""), ("en", "a", "the " * 5000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(6)
    got = [tuple(r) for r in source_audit.divergence(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)
    assert {r[:5] for r in got if r[0] == "de"} == {("de", "a", "pair", "b", 0), ("de", "b", "pair", "a", 0)}


def test_audit_of_nothing(spark):
    empty = source_audit.divergence(spark.createDataFrame([], "lang string, source string, text string"))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_wide_counts_stay_exact(spark):
    big = spark.createDataFrame([(9 * 10**15, 10**16, 7)], "c long, n long, v long")
    assert big.select(source_audit.share(big.c, big.n, big.v)).first()[0] == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 14)
