import pytest

from fieldtally.sources.tables import TableRegistry


@pytest.fixture
def registry(spark, tmp_path):
    return TableRegistry(spark, str(tmp_path / "r"))


def count(registry, name, **version):
    return registry.table(name, **version).count()


def test_a_name_answers_before_during_and_after_a_replacement(spark, registry):
    assert registry.put("bins", spark.range(3)) == 1
    registry.alias("all_bins", "bins")
    registry.alias("places", "all_bins")
    reader = registry.table("places")  # at work while the table is replaced
    staged = registry.stage("bins", spark.range(5).selectExpr("id", "'x' AS kind"))
    assert count(registry, "bins") == count(registry, "places") == 3
    assert staged.publish() == 2
    assert count(registry, "bins") == count(registry, "places") == 5 and reader.count() == 3
    assert registry.table("places").columns == ["id", "kind"]
    assert count(registry, "places", version=1) == 3 and len(registry.versions("bins")) == 2
    got = {r.name: (r.points_to, r.versions) for r in registry.names().collect()}
    assert got["places"] == ("all_bins", 0) and got["bins"][1] == 2


def test_failed_stage_and_moved_alias(spark, registry):
    registry.put("a", spark.range(1))
    registry.put("b", spark.range(2))
    registry.alias("it", "a")
    with pytest.raises(Exception):
        registry.put("a", spark.range(4).selectExpr("raise_error('lost') AS id"))
    assert count(registry, "it") == 1
    registry.alias("it", "b")
    assert count(registry, "it") == 2
    registry.put("empty", spark.range(0))
    assert count(registry, "empty") == 0


def test_unknown_names_and_circles(spark, registry):
    for name in ("none", "a"):
        with pytest.raises(KeyError):
            registry.table(name)
    with pytest.raises(KeyError):
        registry.alias("x", "none")
    registry.put("a", spark.range(1))
    registry.alias("b", "a")
    for alias, name in (("a", "b"), ("a", "a"), ("b", "b")):
        with pytest.raises(ValueError):
            registry.alias(alias, name)
    with pytest.raises(KeyError):
        registry.table("a", version=2)
