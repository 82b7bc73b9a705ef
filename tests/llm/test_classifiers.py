import random

import numpy as np

from fieldtrace.llm import language, quality, toxicity
from fieldtrace.llm.labels import labelled, remainder

from .conftest import SCHEMA, prose


def test_language_of_odd_rows(docs, no_docs):
    learned = language.train(docs)
    assert [lang for lang, _ in learned.content] == ["de", "en"]
    rows = language.identified(docs, learned).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["doc"]["text"]
        blank = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1 and (r["rejected"] or not blank)
    long = [r for r in rows if r["doc"]["lang"] and len((r["doc"]["text"] or "").split()) > 8]
    assert np.mean([r["lang_pred"] == r["doc"]["lang"] for r in long]) > 0.9
    none = language.train(no_docs)
    assert none.content == () and {r["lang_pred"] for r in language.identified(docs, none).collect()} == {"und"}
    assert language.identified(no_docs, learned).count() == 0


def test_labels_are_held_out_and_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 10 = 0 as int) AS toxic")
    sample, counts = labelled(docs, labels, "toxic", 3, 1, 150)
    rows = sample.withColumn("r", remainder(sample["doc_id"], 3)).collect()
    assert not any(r["r"] == 1 for r in rows)
    assert sum(counts.values()) == docs.where(remainder(docs["doc_id"], 3) != 1).count()
    assert sum(r["label"] for r in rows) <= 250 and 90 < len(rows) < 500


def test_ftrl_learns_and_scores_like_the_formula(spark, docs, no_docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 30) + (" ###" if i % 2 else ""), i % 2) for i in range(300)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    out = quality.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    hashes = quality.Hashes()
    text = prose(rng, "en", 30)
    good, bad = model.score(text + " ###", hashes), model.score(text, hashes)
    assert good > 0.7 and bad < good - 0.3
    assert quality.train(no_docs.selectExpr("doc_id", "text", "0 AS label")).score("any", hashes) == 0.5
    assert quality.scored(no_docs, model).count() == 0


def test_features_do_not_depend_on_the_window(monkeypatch):
    text = prose(random.Random(8), "de", 400)
    whole = quality.features(text, quality.Hashes())
    monkeypatch.setattr(quality, "WINDOW", 13)
    cut = quality.features(text, quality.Hashes())
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])


def test_toxicity_learns_its_lexicon(spark, docs, no_docs):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = prose(rng, "en", rng.randint(8, 60)).split()
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["blorgh", "snarfle"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), {0: 300, 1: 100})
    assert {"blorgh", "snarfle"} <= model.lexicon
    seen = spark.createDataFrame([(1, "you are a blorgh and snarfle"), (2, "river stone garden"), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.scored(seen, model).collect()}
    assert out[1]["predicted"] == 1 and out[2]["predicted"] == out[3]["predicted"] == out[4]["predicted"] == 0
    scored = toxicity.scored(docs, model)
    assert scored.count() == docs.count() and toxicity.scored(no_docs, model).count() == 0
    empty = toxicity.train(no_docs.selectExpr("doc_id", "text", "0 AS label"), {})
    assert {r["score"] for r in toxicity.scored(docs, empty).collect()} == {0.0}


def test_dense_features():
    lexicon = frozenset({"idiot", "lowe*"})
    at = dict(zip(toxicity.FEATURES, toxicity.features("YOU idiot! the Loweich 1d10t", lexicon)))
    assert at["lexicon_hits"] == 2 and at["hits_near_you"] == 2 and at["obfuscated"] > 0 and at["obfuscated_hits"] == 1
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon)


def test_schema_has_clashing_names():
    assert {"doc", "score", "size", "key"} <= {c.split()[0] for c in SCHEMA.split(", ")}
