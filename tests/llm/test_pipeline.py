"""The corpus pipeline: each stage's decisions, nulls, empty tables, repeated ids and clashing columns."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer


def word(rng):
    return "".join(rng.choice("an the ing on er ti re ed nd ou ea to it is or es".split()) for _ in range(rng.randint(2, 4)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(500):
        words = [word(rng) for _ in range(rng.randint(40, 120))]
        toxic, poor = int(i % 5 == 0), int(i % 5 == 1)
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "idiot", "zarq" + word(rng)]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - poor, toxic))
    clean = [r for r in rows if r[0] % 5 > 1]
    copies = [(1000 + k, t) for k, (_, t) in enumerate(clean[:10])]
    near = [(2000 + k, t + " " + word(rng)) for k, (_, t) in enumerate(clean[10:20])]
    odd = [(3000, None), (3001, ""), (None, clean[0][1]), clean[30], (3002, "x " * 9000)]
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", 1.0) for d, t in rows + copies + near + odd], "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(rows), [c for c, _ in clean]


def test_stages_take_effect(spark, folder):
    path, texts, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.saved(stage(spark, after, path), f"test-{name}")
        assert sorted(after.columns) == sorted(docs.columns)
        seen[name] = {r.doc_id for r in after.select("doc_id").collect()}
    toxic, poor = {i for i in texts if i % 5 == 0}, {i for i in texts if i % 5 == 1}
    assert len(toxic & seen["toxicity"]) <= 5 and len(set(clean) - seen["toxicity"]) <= 3 and len(poor - seen["toxicity"]) <= 2
    assert len(poor & seen["quality_classifier"]) <= 3 and len(set(clean) - seen["quality_classifier"]) <= 8
    kept = seen["ngram_jaccard_join"]
    assert len(seen["quality_classifier"] & set(clean)) == len(kept & set(clean))
    for copy, own in [*((1000 + k, c) for k, c in enumerate(clean[:10])), *((2000 + k, c) for k, c in enumerate(clean[10:20]))]:
        if own in kept:
            assert copy not in kept
    assert after.groupBy("doc_id").count().where("count > 1").isEmpty()

    packed = corpus_pipeline.STAGES[-1][1](spark, after, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in after.collect()}
    assert corpus_pipeline.run(spark, path).count() == len(packed)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
