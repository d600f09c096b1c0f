"""The pipeline, stage by stage, on documents with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry
from panelweave.llm import language, suffix_levels


def test_stages_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeated_passages", "decontamination", "sentencepiece"]
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_each_decision_takes_effect(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(vocabulary[min(int(rng.expovariate(1 / 300)), 3999)] for _ in range(n))
    passage, item = prose(70), prose(40)
    rows, clean = [], []
    for i in range(160):
        rows.append((i, prose(rng.randint(60, 200))))
        clean.append(i)
    junk = list(range(200, 230))
    rows += [(i, " ".join(f"{w}***" for w in prose(80).split())) for i in junk]
    rows += [(300 + j, rows[j][1]) for j in range(10)]  # exact copies
    rows += [(320 + j, rows[j][1] + " " + prose(3)) for j in range(10, 20)]  # near copies
    rows += [(340 + j, f"{prose(60)} {passage} {prose(60)}") for j in range(4)]
    rows += [(360, f"{prose(60)} {item} {prose(60)}"), (370, None), (371, "")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in clean[::2]] + [(i, 0, 0) for i in junk[::2]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert set(clean) <= set(seen["quality"]) and not set(junk) & set(seen["quality"])
    near = seen["near_dedup"]
    assert set(clean) <= set(near) and not any(300 <= i < 340 for i in near)
    cut = seen["repeated_passages"]
    assert all(cut[i]["text"] == near[i]["text"] for i in clean)
    for j in range(4):
        assert passage[5:-5] not in cut[340 + j]["text"] and cut[340 + j]["n_chars"] == len(cut[340 + j]["text"])
    assert set(seen["decontamination"]) == set(cut) - {360}
    last = seen["sentencepiece"]
    assert set(last) == set(seen["decontamination"]) and all(len(r["ids"]) == r["n_tokens"] for r in last.values())
    assert corpus_pipeline.run(spark, folder).count() == len(last)


CLASHES = ["_id", "_key", "_none", "_crc", "_cuts", "_row", "_letters", "key", "node", "keep", "gumbel_key", "marks", "n_removed", "kept_text", "class", "carried 0", "a.b"]


def small(spark, folder, n=40):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=90)), "en", "s", 9, *[f"mine {i}"] * len(CLASHES)) for i in range(n)]
    rows += [(n, None, None, None, None, *[None] * len(CLASHES)), (n + 1, "", "en", "s", 0, *["mine"] * len(CLASHES))] if n else []
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rng.choices(vocabulary, k=30)))][: n], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, kinds


def test_columns_of_the_user_stay_as_they_are(spark, tmp_path):
    rows, kinds = small(spark, str(tmp_path))
    docs = spark.createDataFrame(rows, kinds)
    want = {r["doc_id"]: [r[f"{c}"] for c in CLASHES] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) >= 40 and all([r[c] for c in CLASHES] == want[r["doc_id"]] for r in got), name
    told = language.predict(docs, None)
    assert told.columns == [*docs.columns, "lang_pred", "score"] and all([r[c] for c in CLASHES] == want[r["doc_id"]] for r in told.collect())
    cut = suffix_levels.cut_repeats(docs.drop("a.b"), 50, keep_text=True)
    assert all(r["key"] == want[r["doc_id"]][7] and r["n_removed"] == 0 for r in cut.collect())


def through(spark, docs, folder):
    """The stages, each written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        yield docs


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    rows, kinds = small(spark, str(tmp_path))
    *_, last = through(spark, spark.createDataFrame(rows + rows[:7] * 3, kinds).drop("a.b"), str(tmp_path))
    assert sorted(r["doc_id"] for r in last.collect()) == list(range(42))
    (tmp_path / "none").mkdir()
    rows, kinds = small(spark, str(tmp_path / "none"), 0)
    assert [docs.count() for docs in through(spark, spark.createDataFrame([], kinds).drop("a.b"), str(tmp_path / "none"))] == [0] * 5
