"""Loads that stop half way, readers of old versions, locks and the log of feeds."""

from datetime import datetime

import pytest

from townlake.sources import publishing
from townlake.streaming import feeds


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_load_that_stops_leaves_the_old_state_whole(spark, folder):
    stops = lambda n: spark.range(n).selectExpr("id")
    assert publishing.publish(spark, folder, {"stops": stops(3), "trips": stops(5)}) == 1
    old = publishing.published(spark, folder, "stops")
    broken = spark.range(4).selectExpr("id", "assert_true(id < 2) as x")
    with pytest.raises(Exception, match="assert_true|ASSERT_TRUE|USER_RAISED|is not true"):
        publishing.publish(spark, folder, {"stops": stops(9), "trips": broken})
    assert ids(publishing.published(spark, folder, "stops")) == [0, 1, 2]
    assert ids(publishing.published(spark, folder, "trips")) == [0, 1, 2, 3, 4]

    def refuse(tables):
        assert ids(tables["stops"]) == list(range(9))
        raise ValueError("too many")

    with pytest.raises(ValueError, match="too many"):
        publishing.publish(spark, folder, {"stops": stops(9)}, refuse)
    assert ids(publishing.published(spark, folder, "stops")) == [0, 1, 2]
    assert publishing.publish(spark, folder, {"stops": stops(7)}) == 2
    assert ids(publishing.published(spark, folder, "stops")) == list(range(7))
    assert ids(publishing.published(spark, folder, "trips")) == list(range(5))  # carried over
    assert ids(old) == [0, 1, 2] == ids(publishing.published(spark, folder, "stops", 1))


def test_of_two_loads_at_once_one_fails(spark, folder):
    publishing.publish(spark, folder, {"a": spark.range(1)})

    def other(_):
        publishing.publish(spark, folder, {"a": spark.range(2)})

    with pytest.raises(publishing.Busy):
        publishing.publish(spark, folder, {"a": spark.range(3)}, other)
    assert publishing.published(spark, folder, "a").count() == 2


def test_old_versions_go_and_kept_ones_stay(spark, folder):
    for n in range(1, 5):
        publishing.publish(spark, folder, {"a": spark.range(n)} | ({"b": spark.range(9)} if n == 1 else {}))
    assert publishing.drop_old(spark, folder, 2) == 2
    assert [publishing.published(spark, folder, "a", n).count() for n in (3, 4)] == [3, 4]
    assert publishing.published(spark, folder, "b").count() == 9
    assert publishing.manifest(spark, folder)["number"] == 4
    assert publishing.manifest(spark, f"{folder}-none") == {"number": 0, "tables": {}}


def test_one_feed_fails_and_the_other_goes_on(spark, folder):
    def broken():
        raise OSError("no answer\nfor a while")

    good = lambda: {"entities": 7, "rows_written": 5, "feed_timestamp": datetime(2024, 1, 2, 3, 4)}

    def nested():
        with pytest.raises(publishing.Busy):  # a second start is refused
            feeds.fetch_all(spark, folder, {"x": good})
        return good()

    assert feeds.fetch_all(spark, folder, {"vehicles": broken, "trips": nested}) == {"vehicles": False, "trips": True}
    assert feeds.fetch_all(spark, folder, {"vehicles": good}) == {"vehicles": True}
    rows = sorted((r.feed, r.error, r.rows_written, r.entities) for r in feeds.log_of(spark, folder).where("feed = 'trips' or error is not null").collect())
    assert rows == [("trips", None, 5, 7), ("vehicles", "OSError: no answer", None, None)]
    assert feeds.log_of(spark, folder).count() == 3


def test_a_lease_that_is_over_is_taken(spark, folder):
    with publishing.single_flight(spark, folder, "x", -1.0), publishing.single_flight(spark, folder, "x"):
        with pytest.raises(publishing.Busy), publishing.single_flight(spark, folder, "x"):
            pass
    with publishing.single_flight(spark, folder, "x"):
        pass


def test_batches_of_a_stream_are_logged(spark, folder, tmp_path):
    spark.range(6).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").json(f"{tmp_path}/in")
    write = lambda batch: batch.where("id < 4").count()
    query = source.writeStream.foreachBatch(feeds.batches_of(spark, folder, "ids", write)).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(60)
    log = feeds.log_of(spark, folder).collect()
    assert [(r.feed, r.entities, r.rows_written, r.error) for r in log] == [("ids", 6, 4, None)]


def test_gaps_between_good_fetches(spark):
    at = lambda d, h, m: datetime(2024, 1, d, h, m)
    rows = [("a", at(1, 23, 50), None), ("a", at(1, 23, 52), "E"), ("a", at(2, 0, 3), None), ("a", at(2, 0, 4), None), ("a", at(2, 1, 0), None), ("b", at(1, 0, 0), None)]
    log = spark.createDataFrame(rows, "feed string, fetched_at timestamp, error string")
    got = sorted((r.feed, r.gap_from, r.gap_to) for r in feeds.gaps(log).collect())
    assert got == [("a", at(1, 23, 50), at(2, 0, 3)), ("a", at(2, 0, 4), at(2, 1, 0))]
