"""The corpus pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from fathom.llm.common import materialize


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.randrange(20, 120))]
        if k % 10 == 0:
            words += ["grumblefink"] * 2
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
    rows += [(500, rows[1][1], "en", "s0"), (501, rows[2][1] + " extra", "en", "s1"), (502, "my password: hunter22 is here " + word(), "en", "s2"), (503, None, "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k % 10 == 0)) for k in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    seen, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), f"test-{name}")
        seen.append(now)
    toxic, unique, redacted, mixed, packed = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    ids = lambda x: sorted(r["doc_id"] for r in x.select("doc_id").collect())
    assert ids(toxic) == [r[0] for r in rows if "grumblefink" not in (r[1] or "")]
    assert ids(unique) == [i for i in ids(toxic) if i not in (500, 501)]
    texts = {r["doc_id"]: r for r in redacted.collect()}
    assert "[ASSIGN]" in texts[502]["text"] and texts[502]["n_chars"] == len(texts[502]["text"]) and texts[503]["text"] is None
    assert mixed.count() > unique.count() and packed.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def run_stages(spark, folder):
    seen, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(folder)), f"test-{name}")
        seen.append(now)
    return seen


KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, `end` int, _size int"


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [x.count() for x in run_stages(spark, tmp_path)] == [0] * len(corpus_pipeline.STAGES)


def test_stages_keep_nulls_repeats_and_columns_of_any_name(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    a, b, c = text(40), text(60), text(30)
    texts = [(1, a), (1, b), (None, c), (None, c), (2, None), (3, ""), (4, a), (5, "word " * 30_000), (6, text(3))]
    rows = [(i, t, "en", None if i == 2 else f"s{(i or 0) % 2}", len(t or ""), "x", k, k) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic, unique, redacted, mixed, packed = run_stages(spark, tmp_path)
    assert all(x.columns == toxic.columns for x in (unique, redacted, mixed)) and "_size" in toxic.columns
    assert toxic.count() == len(rows)  # nothing is known to be toxic
    kept = [r["text"] for r in unique.collect()]
    assert sorted(t for t in kept if t) == sorted(t for t in (a, b, c, texts[7][1], texts[8][1]))
    assert sum(not t for t in kept) == 2  # null and empty texts are linked with nothing
    assert redacted.count() == unique.count() and packed.count() >= 5
