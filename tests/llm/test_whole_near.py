"""The pipeline's near-duplicate stage against brute force at its own threshold."""

from test_operators import grouped, shingles


def test_stage_links_from_eighty_percent(spark):
    import corpus_pipeline

    texts = {}
    for k in range(12):  # pairs with one changed run of words, at similarities around 0.8 and 0.85
        words = [f"w{k}x{i}" for i in range(104)]
        texts[2 * k] = " ".join(words)
        n = 2 * k + 1
        words[40 : 40 + n] = [f"new{k}x{i}" for i in range(n)]
        texts[n] = " ".join(words)
    alike = [len(a & b) / len(a | b) for a, b in ((shingles(texts[2 * k]), shingles(texts[2 * k + 1])) for k in range(12))]
    assert sum(0.8 <= x < 0.85 for x in alike) >= 2 and min(alike) < 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = grouped(texts, 80)[0]
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in texts if want[i] == i)
