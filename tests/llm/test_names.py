"""Users' columns stay, whatever they are called."""
from sigspark.llm import block_naming, decontaminate, pseudonyms, simhash, toxicity

OWN = ["_score", "_found", "_changed", "_key", "_kept", "_again", "_wanted"]


def test_own_columns_stay(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in OWN)
    rows = [(k, t, *range(len(OWN))) for k, t in [(1, "a calm text about the sea"), (2, None), (3, "a calm text about the sea"), (3, "other words of another kind"), (3, ""), (None, "x y z")]]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing that is found here")], "item_id long, text string")
    key = lambda found: [[r[c] for c in OWN] for r in found.collect()]
    for found in (toxicity.drop_toxic(docs, labels), decontaminate.decontaminate(docs, items), decontaminate.decontaminate(docs, items, cut=True), pseudonyms.pseudonyms(docs, b"k").drop("pii")):
        assert found.columns == docs.columns and key(found) == [list(range(len(OWN)))] * len(rows)
    for found in (block_naming.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs)):
        assert found.columns == docs.columns and all(v == list(range(len(OWN))) for v in key(found)) and 0 < found.count() < len(rows)
