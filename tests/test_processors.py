"""Processors as table functions."""

import pytest

from sedge.errors import InvalidParameter
from sedge.functions import processors


def test_windows(spark):
    rows = [(1, "a b  c\td e"), (2, ""), (3, None), (4, " x "), (5, "a b c")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.ord): r.content for r in processors.process(df, "text", processors.Windows(3, 1)).collect()}
    assert got == {(1, 0): "a b c", (1, 1): "c d e", (4, 0): "x", (5, 0): "a b c"}
    with pytest.raises(InvalidParameter):
        processors.Windows(3, 3)


def test_sentences_and_own_processors(spark):
    df = spark.createDataFrame([(1, "First one. 12. Second one here.")], "id int, text string")
    out = processors.process(df, "text", processors.Sentences()).orderBy("ord").collect()
    assert [r.content for r in out][0] == "First one." and {r.section for r in out} == {"body"}

    class Upper(processors.Windows):
        def postprocess(self, chunks):
            return [processors.Chunk("up", c.content.upper()) for c in chunks]

    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    assert [(r.section, r.content) for r in processors.process(df, "text", Upper(2)).collect()][0] == ("up", "FIRST ONE.")


def test_argument_is_checked_when_planned(spark):
    with pytest.raises(Exception, match="takes a text"):
        processors.process(spark.createDataFrame([(1, 2)], "id int, text int"), "text", processors.Windows(3))
