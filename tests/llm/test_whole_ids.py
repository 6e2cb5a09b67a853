"""Rows without a doc_id, or with the same one, are documents of their own where their texts differ."""

from strandlake.llm import decontaminate, line_dup

RUN = "a line that comes twice\nand the one after it"
LEAK = "these are the words of a benchmark item that should not be here"
TEXTS = [f"{RUN}\nfirst tail", f"this text is clean\nin all of its {len(RUN)} lines\nand longer than the run", f"head\n{RUN}", f"so it says: {LEAK}", "nothing to see", "nothing to see"]


def test_line_runs(spark):
    for i in (None, 4):
        docs = spark.createDataFrame([(1, RUN + "\nkeeper")] + [(i, t) for t in TEXTS], "doc_id long, text string")
        got = sorted(r.text for r in line_dup.dedup_lines(docs).where("doc_id is null or doc_id <> 1").collect())
        want = ["first tail", TEXTS[1], "head", *TEXTS[3:]]
        assert got == sorted(want)


def test_items(spark):
    items = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    for i in (None, 4):
        docs = spark.createDataFrame([(i, t, 1) for t in TEXTS], "doc_id long, text string, key int")
        left = decontaminate.decontaminate(docs, items)
        assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(t for t in TEXTS if LEAK not in t)
        assert decontaminate.contaminated(docs, items).count() == 1
