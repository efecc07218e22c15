"""The near-copy stage takes its candidates by op7's grid, too."""

from itertools import count

from gridloom.llm import simhash


def test_linked_by_the_grid_alone(spark):
    """A repeated phrase and one more word: six shingles, five in common, which no class of shingles shows."""
    for k in count():
        a = " ".join(f"{w}{k}" for w in "abcde") + " "
        a, b = a * 41, a * 41 + "end"
        bits = bin((simhash.text_fingerprint(a, simhash.WORDS) ^ simhash.text_fingerprint(b, simhash.WORDS)) & (1 << 64) - 1).count("1")
        if bits <= simhash.MAX_BITS and not set(simhash.class_keys(a)) & set(simhash.class_keys(b)):
            break
    other = "quite another text of some more words than five"
    docs = spark.createDataFrame([(1, a), (2, b), (3, other)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near(docs).collect()) == [1, 3]
    keys = {r["tid"]: r["key"] for r in simhash.grid_keys(docs.withColumnRenamed("doc_id", "tid")).collect()}
    assert keys[1] == keys[2] != keys[3]
