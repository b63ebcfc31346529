"""Thresholds come from perplexities that no document has helped to lower."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ratecraft.llm import kneser_ney
from test_corpus_ops import plain_kneser_ney


@pytest.mark.parametrize("shard_rows", [1000, 7])
def test_threshold_is_of_held_out_perplexities(spark, shard_rows):
    rng = random.Random(5)
    docs = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 40))) for _ in range(40)]
    good = list(range(0, 40, 2))
    df = spark.createDataFrame([(i, t, ["x", "y", None][i % 3]) for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
    fold = {r.id: r.f for r in trusted.select(F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.FOLDS)).alias("f")).collect()}
    want = {}
    for i in good:
        asked = [docs[i][j : j + 3] for j in range(len(docs[i]) - 2)]
        p = plain_kneser_ney([docs[j] for j in good if fold[j] != fold[i]], set(asked), 3)
        value = math.exp(-sum(math.log(p[g]) for g in asked) / len(asked))
        want[i % 3] = max(want.get(i % 3, 0), value)
    for r in kneser_ney.perplexity_filter(df, trusted, order=3, quantile=1.0, shard_rows=shard_rows).collect():
        assert r.threshold == pytest.approx(want[r.doc_id % 3], rel=1e-5)
        assert r.kept == (r.perplexity <= r.threshold)


def test_clean_texts_outside_a_small_trusted_set_are_kept(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40)), "x") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = kneser_ney.perplexity_filter(df, df.where("doc_id < 20").select("doc_id")).where("doc_id >= 20")
    assert got.where("kept").count() >= 85
