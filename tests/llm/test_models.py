"""Language identification and quality scores: held-out accuracy and hard rows."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from docket_spark.llm import language, quality
from docket_spark.llm.columns import fold_of
from tests.llm.tables import documents, hard_rows

SF = "/root/testdata/sf0.01"


def plain_ranks(text, most):
    """The most frequent one to three letters of a text's words, counted one by one."""
    counts = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        counts.update(("1", c) for c in word)
        counts.update(("2", padded[k : k + 2]) for k in range(len(padded) - 1))
        counts.update(("3", padded[k : k + 3]) for k in range(len(padded) - 2))
    return sorted(counts.values(), reverse=True)[:most], len(counts)


def test_ngrams_equal_counting_one_by_one():
    draw = random.Random(9)
    texts = ["", "a", "Été à l'été", "12 34", "no no no", "日本 日本語"]
    texts += ["".join(draw.choice("abcé .,\n1") for _ in range(draw.randint(0, 80))) for _ in range(60)]
    text, gram, count, rank = language.ranked_ngrams([t.encode() for t in texts], 25)
    for k, t in enumerate(texts):
        want, different = plain_ranks(t, 25)
        own = text == k
        assert count[own].tolist() == want
        assert len(set(gram[own])) == min(25, different)
        assert rank[own].tolist() == list(range(len(want)))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = fold_of("doc_id", 4) == 2
    profiles = language.learn_profiles(docs, learn_from=~held_out)
    also = {"held_out": held_out, "lang": F.col("lang")}
    found = language.identify(docs, profiles, also=also).where("held_out").collect()
    assert len(found) > 200
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_hard_rows(spark):
    docs = documents(spark, hard_rows())
    profiles = language.learn_profiles(docs)
    assert set(profiles) == {"en", "xx"}
    found = language.identify(docs, profiles).collect()
    assert len(found) == len(hard_rows())
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {2, 3, 4, 8, None} and {r.score for r in found if r.lang_pred == "und"} == {0.0}
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "5", "6", "7", "None"]
    nothing = language.learn_profiles(documents(spark, []))
    assert nothing == {}
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held_out = fold_of("doc_id", 3) == 1
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors, learn_from=~held_out)
    scored = quality.scores(docs, vectors, network, also={"held_out": held_out})
    found = scored.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in found])
    low = [r.predicted == 0 for r in found if r.quality == 0]
    assert len(found) > 1000 and right > 0.95 and np.mean(low) > 0.75
    # Calibrated: the mean score is the share of label 1, and the likelihood beats that share's.
    chance = np.clip([r.score for r in found], 1e-6, 1 - 1e-6)
    label = np.array([r.quality for r in found])
    share = label.mean()
    assert abs(chance.mean() - share) < 0.03
    loss = -np.mean(label * np.log(chance) + (1 - label) * np.log(1 - chance))
    assert loss < -(share * np.log(share) + (1 - share) * np.log(1 - share)) / 2


def test_word_vectors_equal_counting_one_by_one(spark):
    rows = [(1, "a b c a"), (2, "b c"), (3, None), (4, "a !! b"), (None, "")]
    found = quality.word_vectors(documents(spark, rows))
    _, _, index = quality.index_vectors()
    table = np.zeros((quality.BUCKETS, quality.SIZE))
    for _, text, *_ in rows:
        bucket, _ = quality.words_of([(text or "").encode()])
        for i, here in enumerate(bucket):
            for j, there in enumerate(bucket):
                if i != j and abs(i - j) <= quality.REACH:
                    table[here] += index[there]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    assert np.allclose(found, table / np.maximum(length, 1), atol=1e-6)


def test_quality_of_hard_rows(spark):
    docs = documents(spark, hard_rows())
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, None, 0), (None, 1, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"
    )
    vectors = quality.word_vectors(docs)
    for known in (labels, labels.limit(0)):
        network = quality.fit(docs, known, vectors)
        found = quality.scores(docs, vectors, network).collect()
        assert len(found) == len(hard_rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    none = documents(spark, [])
    vectors = quality.word_vectors(none)
    assert quality.scores(none, vectors, quality.fit(none, labels, vectors)).count() == 0
