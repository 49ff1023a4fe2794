"""The first stage decides by the predicted language."""

import corpus_pipeline as P

EN = ["the cat and the dog are in the house of the king", "this is the way that we go to the town and back"]
DE = ["der hund und die katze sind in dem haus des königs", "das ist der weg den wir in die stadt gehen und zurück"]


def test_predicted_language_decides(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(x, "en") for x in EN * 4] + [(x, "de") for x in DE * 4])]
    odd = [(100, "καλημέρα σε όλους εδώ", None), (101, "", "en"), (102, None, "de"), (103, "12 34", None), (104, EN[0], None), (104, EN[0], None), (None, DE[0], None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = P.identified(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.where("text IS NOT NULL AND text <> '' AND coalesce(doc_id, 0) NOT IN (100, 103)").collect())
    only = P.identified(spark, docs, "", wanted=("en",)).collect()
    assert {r.text for r in only} == set(EN)
