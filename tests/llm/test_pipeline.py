"""The pipeline over planted documents: what must go goes, what is clean stays."""

import random

import corpus_pipeline
import __spark_entry__ as entry


def planted(spark, folder):
    draw = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ra", "ni", "tel", "mos", "rup")]

    def prose(n):
        return ". ".join(" ".join(draw.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(n)) + "."

    clean = [prose(draw.randint(4, 20)) for _ in range(120)]
    item = prose(4)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(clean)]
    rows += [(1000 + i, clean[i], "en", "s0") for i in range(10)]  # exact copies
    rows += [(1100 + i, f"{clean[i]} qqq", "en", "s1") for i in range(15, 20)]  # near copies
    rows += [(1200 + i, f"{prose(3)} {item} {prose(2)}", "en", "s2") for i in range(6)]
    rows += [(1300, "### " * 40, "en", "s2"), (1301, "a b", "en", "s2"), (1302, None, None, None)]
    rows += [(1400 + i, f"{prose(6)} Mail x{i}@mail.example.com or 10.1.2.{i}. {prose(1)}", "en", None) for i in range(5)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, *_ in rows}


def test_stages(spark, tmp_path):
    texts = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = set(texts) - {1300, 1301, 1302}
    single = good - set(range(1000, 1200))
    assert left[0] == good and left[1] == single
    assert left[2] == left[3] == single - set(range(1200, 1300))
    rows = docs.collect()
    assert left[4] <= left[3] and all(r.copy in (1, 2) for r in rows)
    assert all("@" not in r.text and "10.1.2" not in r.text for r in rows)
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id < 1000)


def test_registered(spark, sf_dir):
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in names} and "pipeline" in names
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0
