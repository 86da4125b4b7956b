from tariffscope.session import SETTINGS, build_session, ensure_checkpoint_dir


def test_given_settings_come_first(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session = build_session("again", spark__sql__files__maxPartitionBytes="64MB")
    try:
        assert session.conf.get("spark.sql.files.maxPartitionBytes") == "64MB"
        assert session.conf.get("spark.sql.shuffle.partitions") == before == "4"
        assert session.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    finally:
        name = "spark.sql.files.maxPartitionBytes"
        session.conf.set(name, SETTINGS[name])


def test_checkpoint_folder_is_kept_once_named(spark, tmp_path):
    named = ensure_checkpoint_dir(spark, str(tmp_path / "other"))
    assert named == spark.sparkContext.getCheckpointDir() and "other" not in named
