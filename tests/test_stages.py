import os

from hearthline import session


def test_stages_survive_until_dropped(spark):
    df = session.cut_lineage(spark.range(10))
    path = session._STAGES[-1]
    assert df.count() == 10 and os.path.isdir(path)
    session.drop_stages(spark)
    assert not os.path.exists(path) and session._STAGES == []
