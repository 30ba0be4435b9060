import numpy as np
from pyspark.sql import functions as F

from trialloom.llm import language
from trialloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_features_by_hand():
    got = language.features(["Ab!", None, "12 $$"])
    want = np.zeros(language.SIZE)
    data = b" ab "
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            gram = 0
            for c in data[i : i + n]:
                gram = (gram * 257 + c) % 2**32
            want[(gram + n * 0x3C6EF372) % 2**32 * 0x9E3779B1 % 2**32 >> 18] += 1
    want = np.sqrt(want) / np.sqrt(want.sum())
    assert np.allclose(got[0], want, atol=1e-6)
    assert language.family("en-GB") == "germanic" and language.family("xx") == "xx"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, ~held_out(F.col("doc_id")))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_cases(spark):
    words = {"en": "the and of with", "de": "der und mit ein", "fr": "le et de avec une", "xx": "qqa wwo"}
    rows = [(i, t * (1 + i % 3), code, "s") for i, (code, t) in enumerate(list(words.items()) * 6)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 !!", "de", "s"), (None, "the and", None, "s"), (103, "le et de", None, "s"), (103, "le et de", None, "s"), (104, "der und " * 100_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(df, language.train(df, F.lit(True))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert by[None].lang_pred == "en" and by[103].lang_pred == "fr" and by[104].lang_pred == "de"
    none = language.train(df.limit(0), F.lit(True))
    assert none is None and all(r.lang_pred == "und" for r in language.identify(df, none).collect())
    single = df.where("lang = 'en'")
    assert language.identify(single, language.train(single, F.lit(True))).where("doc_id = 0").head().lang_pred == "en"


def test_rows_that_many_share_are_learned_once(spark):
    """A null or repeated id with very many rows brings no more to the driver than other rows do."""
    rows = [(None if i % 2 else 7, f"the and of {i % 500} with words", "en") for i in range(4000)] + [(i, f"der und mit {i}", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from trialloom.llm.common import bounded_sample

    picked = bounded_sample(df, "lang", ["doc_id", "text"], 200).dropDuplicates(["doc_id", "text", "lang"])
    n = {r.lang: r["count"] for r in picked.groupBy("lang").count().collect()}
    assert n["de"] == 40 and 0 < n["en"] < 60
    assert language.train(df, F.lit(True), sample=200) is not None
