"""The language model keeps as many words as its limit says."""

from tremor.llm import language_id


def test_model_limits(spark):
    words = [a + b + c + d for a in "bcdfghk" for b in "aeiouy" for c in "lmnprstvwx" for d in ("ba", "ce", "di", "fo", "gu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", *(x + y for x in "bcdfghjklmnp" for y in "aeiouyhrls"))]
    assert 50_000 < len(words) < 60_000
    docs = spark.createDataFrame([(i, " ".join(words[lo : lo + 3000]), "aa") for i, lo in enumerate([*range(0, len(words), 3000)] * 2)], "doc_id long, text string, lang string")
    assert len(language_id.fit(docs).words) == len(set(words))
