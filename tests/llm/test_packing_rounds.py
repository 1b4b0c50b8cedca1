"""Rounds of the packing: what a partition closed is final, and no task holds more than its share."""

from barloom.llm import packing
from barloom.llm.queries import tokenizer_file

WORD = tokenizer_file("word_bpe_49k.json")


def test_no_merge_takes_more_than_its_share(spark, monkeypatch):
    merge = packing._merge

    def bounded(*options):
        run = merge(*options)

        def checked(table):
            if table.num_rows > 2 * 3:
                raise AssertionError(f"{table.num_rows} windows in one task")
            return run(table)

        return checked

    monkeypatch.setattr(packing, "_merge", bounded)
    docs = spark.range(0, 600, 1, 9).selectExpr("id AS doc_id", "repeat('the cat sat ', int(3 + 37 * id % 50)) AS text")
    got = packing.pack(docs, WORD, size=200, slots=3, fan=2).toPandas()
    assert set(got.doc_id) == set(range(600))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 200
    for _, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
    assert got.sequence_id.nunique() * 200 < 1.1 * got.length.sum()
