import pytest
from pyspark.sql import functions as F

from fieldtally.plans.quality import assert_pruned
from fieldtally.sources.commits import CommitLog, TargetGroup
from fieldtally.streaming.ingest import ingest_committed

PARTS = ["year", "month"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, seen double, latent double, year int, month string")


@pytest.fixture
def group(spark, tmp_path):
    return TargetGroup(spark, str(tmp_path / "g"), {"observed": ["id", "seen"], "truth": ["id", "latent"]}, PARTS)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_failure_between_two_targets_shows_in_neither(spark, group):
    assert group.write("a", frame(spark, [(1, 1.0, 1.0, 2026, "01")]))
    broken = frame(spark, [(2, 2.0, 2.0, 2026, "02")]).withColumn("latent", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        group.write("b", broken)  # observed is staged by then
    assert ids(group.read("observed")) == ids(group.read("truth")) == [1]
    good = frame(spark, [(2, 2.0, 2.0, 2026, "02")])
    assert group.write("b", good) and not group.write("b", good)
    assert ids(group.read("observed")) == ids(group.read("truth")) == [1, 2]


def test_failure_before_the_manifest_shows_in_neither(spark, group, monkeypatch):
    group.write("a", frame(spark, [(1, 1.0, 1.0, 2026, "01")]))
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", lambda *_: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            group.write("b", frame(spark, [(2, 2.0, 2.0, 2026, "01")]), replace=True)
    assert ids(group.read("observed")) == ids(group.read("truth")) == [1]


def test_partitions_are_replaced_together_and_pruned(spark, group):
    group.write("a", frame(spark, [(1, 1.0, 1.0, 2026, "01"), (2, 1.0, 1.0, 2026, "02")]))
    group.write("b", frame(spark, [(3, 1.0, 1.0, 2026, "02"), (4, 1.0, 1.0, None, None)]))
    group.write("c", frame(spark, [(5, 1.0, 1.0, 2026, "02")]), replace=True)
    for target in ("observed", "truth"):
        assert ids(group.read(target)) == [1, 4, 5]
    got = group.read("observed")
    assert got.columns == ["id", "seen", *PARTS] and dict(got.dtypes)["month"] == "string"
    january = got.where("month = '01'")
    assert_pruned(january, ["month"])
    assert ids(january) == [1]


def test_missing_partitions_and_empty_batches(spark, group):
    with pytest.raises(ValueError):
        group.read("truth")
    group.write_missing("none", frame(spark, []))
    assert group.read("truth").count() == 0
    group.write_missing("a", frame(spark, [(1, 1.0, 1.0, 2026, "01"), (2, 1.0, 1.0, None, None)]))
    group.write_missing("b", frame(spark, [(3, 1.0, 1.0, 2026, "01"), (4, 1.0, 1.0, 2026, "02"), (5, 1.0, 1.0, None, None)]))
    assert ids(group.read("truth")) == [1, 2, 4]


def test_replayed_stream_batch_enters_once(spark, tmp_path):
    inbox, seen = tmp_path / "in", str(tmp_path / "ck")
    inbox.mkdir()
    group = TargetGroup(spark, str(tmp_path / "g"), {"a": ["id"], "b": ["id", "service_date_local"]}, PARTS)
    schema = "id bigint, service_date_local date"
    (inbox / "01.csv").write_text("id,service_date_local\n1,2026-01-05\n")
    publish = CommitLog.publish

    def publish_then_die(*args):
        publish(*args)
        raise OSError("driver lost after the commit")

    run = lambda: ingest_committed(spark, str(inbox), schema, group, "drops", seen).awaitTermination()
    CommitLog.publish = publish_then_die
    try:
        with pytest.raises(Exception):
            run()
    finally:
        CommitLog.publish = publish
    run()  # the batch is replayed
    (inbox / "02.csv").write_text("id,service_date_local\n2,2026-02-05\n")
    run()
    assert ids(group.read("a")) == ids(group.read("b")) == [1, 2]
