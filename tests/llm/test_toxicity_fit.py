"""The classifier of toxicity is fitted in a task: no text of the sample reaches the driver."""

import os

from prismlake.llm import labelled, toxicity

DOCS = [(i, f"the {'vile' if i % 3 == 0 else 'mild'} words of document {i} and some others") for i in range(60)]


def test_the_driver_fits_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.fit(toxicity.sample_rows(docs, labels, "toxic", toxicity.SAMPLE).orderBy("doc_id").rdd.map(lambda r: (r.y, r.text.encode())).collect())

    assert toxicity.fitted(docs, labels) == want
    assert toxicity.fitted(docs.limit(0), labels) is None and toxicity.fitted(docs, labels.limit(0)) is None
    monkeypatch.setattr(toxicity, "fit", lambda rows: (os.getpid(), len(rows)))
    process, n = toxicity.fitted(docs, labels)
    assert process != os.getpid() and n == labels.where(~labelled.held_out()).count()
