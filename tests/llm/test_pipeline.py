"""The pipeline on planted documents, stage by stage against what was planted."""

import random

import pytest

import corpus_pipeline
from ratingml.llm import fm_decontam, toxicity_fm, unigram_pieces

WORDS = [f"w{i}" for i in range(500)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    item = prose(rng, 30)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 10 == 0
        text = prose(rng, 60)
        if toxic:
            text = "you vermin " + text + " vermin"
        labels.append((i, 1, int(toxic)))
        docs.append((i, text))
    base = docs[1][1].split()
    docs += [(1000, docs[1][1]), (1001, " ".join([*base[:59], "other"]))]
    docs += [(1002, prose(rng, 20) + ". " + item + ". " + prose(rng, 20)), (1003, item)]
    docs += [(1004, prose(rng, 30) + " write to jane.roe@mail3.example.com or +1 (212) 555-0199"), (1005, None), (1006, "")]
    docs += [(1007, prose(rng, 40) + " you vermin"), (1008, prose(rng, 20_000)), (None, prose(rng, 30))]
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder, dict(docs), item


def test_every_decision_takes_effect(spark, planted):
    folder, texts, item = planted
    vocab = unigram_pieces.load(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, folder).collect()
    coder = unigram_pieces.Encoder(vocab)
    import numpy as np

    out = {r["doc_id"]: None if r["ids"] is None else coder.decode(np.array(r["ids"], int), np.array([len(r["ids"])]))[0] for r in found}
    assert len(found) == len(out) and all(r["round_trip"] for r in found)
    toxic = {i for i in range(400) if i % 10 == 0} | {1007}
    assert set(out) == set(texts) - toxic - {1000, 1001}
    phrases = fm_decontam.phrases_of([(1, item)])
    assert not any(h.spans for h in fm_decontam.search_texts(list(out.values()), phrases))
    assert out[1003] == "" and len(fm_decontam.words_of(out[1002])) == 40 and out[1005] is None and out[1006] == ""
    assert "jane" not in out[1004] and "555-0199" not in out[1004] and out[1004].split()[:30] == texts[1004].split()[:30]
    untouched = set(out) - {1002, 1003, 1004}
    assert all(out[i] == texts[i] for i in untouched)
    assert all(r["n_chars"] == len(out[r["doc_id"]]) for r in found if out[r["doc_id"]] is not None)


def test_stages_keep_the_columns(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_empty_documents(spark, planted, tmp_path):
    folder = planted[0]
    docs = spark.read.parquet(folder + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert toxicity_fm.THRESHOLD == 0.7
