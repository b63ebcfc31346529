"""The training sample of the toxicity model has the size that README states."""

from ratecraft.llm import toxicity


def test_sample_takes_1500_and_3000(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda samples, y, *rest: seen.append((int((y == 1).sum()), int((y == 0).sum()))))
    rows = [(i, f"text number {i}", int(i < 1600)) for i in range(4800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), bits=12)
    assert seen == [(1500, 3000)]
