"""Without a learning row the language filter keeps every lettered text."""

import zlib

import pytest

from kairos.llm import langid as L

TEXTS = ["clean text", None, "", "12 !", "\u6f22\u5b57"]
HELD = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]


@pytest.mark.parametrize("ids, lang", [(range(5), None), ([None] * 5, "en"), (HELD, "en")])
def test_lettered_texts_stay(spark, ids, lang):
    df = spark.createDataFrame([(d, t, lang) for d, t in zip(ids, TEXTS)], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in L.keep_identified(df).collect()) == ["clean text", "\u6f22\u5b57"]
