import os
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import language_id

from .helpers import ODD, SCHEMA, clash, frame

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()), sample=60)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(language_id.held_out()).where(F.length("text") > 40).collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_by_crc(spark):
    got = spark.range(200).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_margins_of_a_group_are_those_of_each_text():
    texts = [b"abc", b"a", b"the house", b"", b"x" * 1000]
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.stack([language_id.feature(t) for t in (b"the cat and the dog", b"der hund und die katze", b"le chat et le chien", b"el gato y el perro")])
    model = language_id.LanguageModel.fit(np.concatenate([x, x + rng.random(x.shape) * 1e-6]), ["en", "de", "fr", "es"] * 2)
    want = [np.append(language_id.feature(t) * language_id.SCALE, 1) @ model.weights for t in texts]
    assert np.allclose(model.margins(texts), want)
    assert model.predict([b"the cat and", b"und die katze", b"le chat et", b"el gato y"])[0] == ["en", "de", "fr", "es"]


def test_odd_rows(spark):
    rows = [(i, t, ["en", "xx", None][i % 3], "s", 0) for i, t in enumerate([*ODD, "123 $$", "²"])]
    df = clash(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
        assert got[i].lang_pred in ("en", "xx", "und")
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.fit(none) is None and language_id.predict(none, None).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc", "en"), (2, "def", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict(one, language_id.fit(one)).collect()] == ["en", "en"]
    empty = frame(spark, [])
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
