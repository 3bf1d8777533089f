"""The pipeline's stages one by one and together, on a small table with nulls, empty, long and repeated texts and clashing columns."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=5)) for i in range(500)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, size long, shard int"


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 25)) for i in range(5)] + [(None, prose(rng, 25)), (7, None), (8, "")]
    rows = [(i, prose(rng, 60) + (" gruntmok " if i % 4 == 0 else " ") + prose(rng, 20), "a" if i % 3 else "b") for i in range(160)]
    base = prose(rng, 120)
    rows += [(300, base, "a"), (301, base, "b"), (302, base + " tail", "a"), (None, base + " end", "a"), (303, base, None), (303, base, None)]
    rows += [(400, prose(rng, 40) + " " + items[0][1] + " " + prose(rng, 40), "b"), (None, prose(rng, 40) + " " + items[5][1], "b")]
    rows += [(500, None, "a"), (501, "", None), (502, " \n ", "b"), (None, None, None), (503, prose(rng, 30_000), "c"), (504, "x" * 200_000, "c")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 0.5, 7, 3) for i, t, s in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet"), rows, items


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_names_and_columns(spark, world):
    path, docs, _, _ = world
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    for name, run in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = run(spark, df, path)
            assert name == "sharding" or out.schema.simpleString() == docs.schema.simpleString()
            if df is not docs:
                assert out.count() == 0


def test_toxicity_stage(spark, world):
    path, docs, rows, _ = world
    left = [r.doc_id for r in stage("toxicity")(spark, docs, path).collect()]
    assert sum(i % 4 == 0 for i in left if i is not None and i < 160) <= 2
    assert sum(i % 4 != 0 for i in left if i is not None and i < 160) >= 118
    assert {500, 501, 502} <= set(left) and left.count(303) == 2


def test_near_duplicates_stage(spark, world):
    path, docs, rows, _ = world
    left = stage("ngram_jaccard")(spark, docs, path).collect()
    ids = [r.doc_id for r in left]
    assert ids.count(300) == 1 and not {301, 302, 303} & set(ids)
    assert [r.text for r in left if r.doc_id is None and r.text and len(r.text) < 2000 and "end" in r.text] == []
    assert set(range(160)) | {400, 500, 501, 502, 503, 504} <= set(ids) and ids.count(None) == 2


def test_decontamination_stage(spark, world):
    path, docs, rows, items = world
    left = stage("decontamination")(spark, docs, path).collect()
    asked = [shingles(t) for _, t in items if shingles(t)]
    want = [t for _, t, _ in rows if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in asked)]
    assert len(want) == len(rows) - 2 and sorted(str(r.text) for r in left) == sorted(map(str, want))


def test_mixing_stage(spark, world):
    path, docs, rows, _ = world
    first, again = (sorted(map(str, stage("mixing")(spark, d, path).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    out = stage("mixing")(spark, docs, path).collect()
    source = {}
    for _, t, s in rows:
        source[s] = source.get(s, 0) + len((t or "").split())
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert all(taken.get(s, 0) <= 2 * n for s, n in source.items())
    copies = {}
    for r in out:
        copies[(r.doc_id, r.text)] = copies.get((r.doc_id, r.text), 0) + 1
    seen = {}
    for i, t, _ in rows:
        seen[i, t] = seen.get((i, t), 0) + 1
    assert all(n <= 2 * seen[k] for k, n in copies.items())


def test_sharding_stage(spark, world):
    path, docs, rows, _ = world
    out = stage("sharding")(spark, docs, path).collect()
    assert len(out) == len(rows)
    slots, of = {}, {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for i, t, _ in rows:
        of.setdefault(t, set()).update(r.shard for r in out if r.doc_id == i and r.size == len((t or "").encode()) + 1)
    assert len(of[rows[160][1]]) == 1


def test_run(spark, world):
    path, _, rows, items = world
    out = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in out}
    assert out and not {301, 302, 303, 400} & ids and all(r.law == "bytes" for r in out)
    assert corpus_pipeline.run(spark, SF).count() > 0
