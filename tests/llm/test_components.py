from chatlens.llm import components
from chatlens.llm.components import connected_components, extended_components

PAIRS = "u long, v long"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_further_edges_join_the_components_there_are(spark):
    first, more = [(5, 4), (4, 9), (7, 8)], [(8, 9), (20, 21), (3, 20), (7, 7)]
    roots = connected_components(spark.createDataFrame(first, PAIRS))
    both = extended_components(roots, spark.createDataFrame(more, PAIRS))
    assert _rows(both) == _rows(connected_components(spark.createDataFrame(first + more, PAIRS)))
    assert dict(_rows(both)) == {4: 4, 5: 4, 7: 4, 8: 4, 9: 4, 3: 3, 20: 3, 21: 3}


def test_without_further_edges_nothing_is_written(spark, monkeypatch):
    roots = connected_components(spark.createDataFrame([(1, 2)], PAIRS))
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: (written.append(name), write(df, name))[1])
    assert _rows(extended_components(roots, spark.createDataFrame([], PAIRS))) == [(1, 1), (2, 1)] and not written
    assert _rows(connected_components(spark.createDataFrame([], PAIRS))) == [] and len(written) == 1
