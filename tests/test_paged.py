import pytest

from ledgerloom.sources import paged


def pages_of(data, size):
    return lambda unit, page, since: [r for r in data[unit] if not since or r["day"] >= since][page * size : (page + 1) * size]


def test_units_are_read_to_a_verified_end():
    data = {"a": [{"day": f"2024-01-{i:02d}", "id": i} for i in range(1, 26)], "b": []}
    fetch = pages_of(data, 10)
    assert [r["id"] for r in paged.read_unit(fetch, "a", None, 10)] == list(range(1, 26))
    assert [r["id"] for r in paged.read_unit(fetch, "a", "2024-01-20", 10)] == list(range(20, 26))
    assert len(list(paged.read_unit(fetch, "a", None, 10, max_pages=1))) == 10
    assert list(paged.read_unit(fetch, "b", None, 10)) == []


def test_short_page_in_the_middle_raises():
    with pytest.raises(ValueError, match="rows follow"):
        list(paged.read_unit(lambda u, p, s: [[1, 2, 3], [4]][p] if p < 2 else [], "a", None, 4))


def test_retries_and_unverifiable_end():
    waits, calls = [], []

    def fetch(unit, page, since):
        calls.append(page)
        if page == 1 or len(calls) < 3:
            raise paged.Retryable
        return [1]

    with pytest.raises(ValueError, match="can't be verified"):
        list(paged.read_unit(fetch, "a", None, 5, sleep=waits.append))
    assert waits[:2] == [1.0, 2.0]
    with pytest.raises(paged.Retryable):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.Retryable()), sleep=lambda s: None)


def test_data_source(spark):
    def fetch(unit, page, since):
        return [{"n": page * 2 + i} for i in range(2 if page < 2 else 1)] if page < 3 else []

    spark.dataSource.register(paged.paged_source("testfeed", fetch))
    got = spark.read.format("testfeed").option("units", "x,y").option("pageSize", "2").load()
    assert got.count() == 10 and {r.unit for r in got.collect()} == {"x", "y"}


def test_cache(spark, tmp_path):
    path, df = str(tmp_path / "c"), spark.range(3)
    assert paged.read_cache(spark, path, 100, 10) is None
    paged.write_cache(df, path, 100)
    assert paged.read_cache(spark, path, 109, 10).count() == 3 and paged.read_cache(spark, path, 110, 10) is None
    assert paged.read_cache(spark, path, 10**9, None).count() == 3
    paged.clear_cache(spark, path)
    assert paged.read_cache(spark, path, 0, None) is None
