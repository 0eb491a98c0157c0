"""Session helpers respect what the cluster configured."""

from quayside.session import apply_defaults, ensure_checkpoint_dir


def test_defaults_do_not_override_cluster_settings(spark):
    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        apply_defaults(spark)
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    got = ensure_checkpoint_dir(spark)
    assert configured and got.replace("file:", "").startswith(configured.replace("file:", ""))
    assert ensure_checkpoint_dir(spark) == got          # stable, nothing new created
