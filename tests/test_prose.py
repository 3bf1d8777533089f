"""Sentences and tidying against the SQL of their queries, over texts that the small tables lack."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from proselake.functions import text as X

TEXTS = ["Éê. Óó! Çé ñ. Üü.", "Éç. Éç. Éç.\nÉç. Öö?", "12. 34! 56.", "One two. Three.", "(É. Í. Ó.)"]
LOOSE = ["ßen alt.  ßo neu ,", "- ßa und. ǰa", "a. b. ß. c", "éa. éb"]


@pytest.mark.parametrize(("name", "texts"), [("sentence_segments", TEXTS), ("short_sentence_runs", TEXTS), ("same_opener_runs", TEXTS), ("tidied_en", LOOSE)])
def test_letters_beyond_ascii(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall()) and got


def test_han_is_cut_as_chinese(spark):
    from proselake.operators import prose as P

    docs = spark.createDataFrame([(1, "研究。方法！Éa. 结果")], "doc_id long, text string")
    assert [r["text"] for r in P.sentence_segments(docs).collect()] == ["研究。", "方法！", "Éa. 结果"]


def test_language_lists_no_letters(spark):
    from pyspark.sql import functions as F

    from proselake.functions import text as X
    from proselake.operators import diagnose as D

    texts = ["", "。", "abc 研究", "研究方法 abc, d", "研究", "é", "😀研a", "本文a bcdefgh", "的的的的abc。", "A" * 7 + "的" * 3, "A" * 6 + "的" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.language(F.col("text")).alias("lang"))
    assert [r["lang"] for r in df.collect()] == [D.language(t) for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_few_texts_of_a_batch_are_python_objects_at_once(spark, monkeypatch):
    """All texts of a large batch are read, null and empty ones too; what is held beside the batch does not grow with it."""
    made = []
    monkeypatch.setattr(X, "_lists", lambda found, columns, own=X._lists: made.append(len(found)) or own(found, columns))
    monkeypatch.setattr(X.F, "arrow_udf", lambda kind: lambda run: run)
    texts = [None if i % 7 == 3 else "" if i % 7 == 4 else f" a{i}\n\nb " for i in range(1000)]
    got = X.paragraphs(pa.array(texts)).to_pylist()
    assert got == [None if t is None else [dict(zip(("start", "end", "matched"), s, strict=True)) for s in X.line_spans(t)] for t in texts]
    assert sum(made) == 1000 and max(made) <= 64
    assert X.paragraphs(pa.array([], pa.string())).to_pylist() == []
