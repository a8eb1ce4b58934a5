"""The pipeline's stages on odd rows: defined results, the columns of documents, nothing clean lost."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "one two three four five six seven eight nine ten " * 6
ODD = [(1, "", "en", None, 0), (2, None, None, "s", None), (3, LINE + "\nown words here", "en", "s", 9), (4, "other\n" + LINE, "en", "s", 9),
       (4, "other\n" + LINE, "en", "s", 9), (None, "no id at all", None, None, 1), (5, "word " * 30_000 + "end", "de", "t", 1),
       (6, "plain words that nobody minds", "en", "t", 29)]


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "source_mix", "bpe"])
def test_stage_on_odd_rows(spark, name):
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    docs, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, SF)
    rows = out.collect()
    extra = {"token_ids", "n_tokens"} if name == "bpe" else set()
    assert set(out.columns) == set(docs.columns) | extra
    ids = [r.doc_id for r in rows]
    assert 6 in ids and 5 in ids and None in ids and stage(spark, none, SF).count() == 0
    if name in ("toxicity", "bpe"):
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ODD)  # repeated rows stay, clean texts too
    if name == "line_dedup":
        text = {r.doc_id: r.text for r in rows}
        assert text[3] == ODD[2][1] and text[4] == "other" and text[1] == "" and text[2] is None
    if name == "near_dedup":
        assert ids.count(4) == 2 and {1, 2, 3, 4} <= set(ids)  # rows of one id share its decision; no two ids are alike enough
    if name == "source_mix":
        assert {r[0] for r in ODD} == set(ids)
