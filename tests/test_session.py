from evalframe.session import CHECKPOINT_CONF, cut_lineage, ensure_checkpoint_dir


def test_checkpoint_folder_comes_from_the_session(spark):
    before = spark.conf.get(CHECKPOINT_CONF, None)
    assert before                                    # set by the session (here: a scratch folder)
    assert ensure_checkpoint_dir(spark) == before    # never replaced once set
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    assert "LogicalRDD" in df._jdf.queryExecution().logical().toString()   # lineage cut, reliable checkpoint
