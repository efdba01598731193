"""Text sources by header name, and broken rows kept in quarantine."""

import pytest

from sentier.sources import files as FI

STOPS = "stop_id string, stop_name string, stop_lat double, stop_lon double"


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_columns_are_matched_by_name(spark, tmp_path):
    p = _write(tmp_path / "a.csv", "b;a", "1;2")
    assert [tuple(r) for r in FI.read_csv(spark, p, "a int, b int").collect()] == [(2, 1)]
    p = _write(tmp_path / "b.csv", "﻿B , x, A", "1,y,2")
    assert [tuple(r) for r in FI.read_csv(spark, p, "a int, b int", ",").collect()] == [(2, 1)]
    with pytest.raises(ValueError, match="no column c"):
        FI.read_csv(spark, p, "a int, c int", ",")
    assert [tuple(r) for r in FI.read_csv(spark, p, "a int, c int", ",", optional=("c",)).collect()] == [(2, None)]


def test_a_real_feed(spark, tmp_path):
    """More columns, another order, quotes; a table without an optional column."""
    _write(tmp_path / "stops.txt", "stop_id,stop_code,stop_name,stop_desc,stop_lat,stop_lon,zone_id",
           'S1,001,"Gare, rue ""Verte""",,49.44,1.09,Z', "S2,002,Théâtre,,49.45,1.10,")
    _write(tmp_path / "stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type",
           "T1,08:00:00,08:00:00,S1,1,0", "T1,08:05:00,08:05:00,S2,2,0", "T1,08:05:00,,S2,two,0", "T1,08:05:00")
    _write(tmp_path / "trips.txt", "route_id,service_id,trip_id", "R1,week,T1")
    _write(tmp_path / "routes.txt", "route_id,agency_id,route_short_name,route_type", "R1,A,Métro,1")
    _write(tmp_path / "shapes.txt", "shape_pt_sequence,shape_id,shape_pt_lon,shape_pt_lat", " 1 ,H1,1.09,49.44", "2,H1,,49.45")
    feed = FI.read_gtfs_checked(spark, str(tmp_path))
    assert [tuple(r) for r in feed["stops"].good.orderBy("stop_id").collect()] == [
        ("S1", 'Gare, rue "Verte"', 49.44, 1.09), ("S2", "Théâtre", 49.45, 1.10)]
    assert [tuple(r) for r in feed["trips"].good.collect()] == [("T1", "R1", None)]
    assert [tuple(r) for r in feed["shapes"].good.orderBy("shape_pt_sequence").collect()] == [
        ("H1", 49.44, 1.09, 1), ("H1", 49.45, None, 2)]
    assert feed["stop_times"].counts() == (2, 2)
    bad = {r.reason: r for r in feed["stop_times"].quarantine.collect()}
    assert set(bad) == {"number of fields", "not of its type: stop_sequence"}
    assert bad["number of fields"].record == "T1,08:05:00" and all(r.file.endswith("stop_times.txt") for r in bad.values())
    table = FI.write_quarantine(feed, f"{tmp_path}/quarantine")
    assert {(r.source, r.reason) for r in table.collect()} == {("stop_times", x) for x in bad}
    assert FI.read_gtfs(spark, str(tmp_path))["stops"].count() == 2
    with pytest.raises(Exception, match="broken row in"):
        FI.read_gtfs(spark, str(tmp_path))["stop_times"].collect()


def test_good_rows_and_quarantine_are_all_rows(spark, tmp_path):
    lines = [f"{i},{'x' if i % 7 == 0 else i * 2}" + (",more" if i % 11 == 0 else "") for i in range(1, 500)]
    for k in range(4):  # several files of one header
        (tmp_path / "t").mkdir(exist_ok=True)
        _write(tmp_path / "t" / f"p{k}.csv", "id,twice", *lines[k::4])
    c = FI.read_csv_checked(spark, f"{tmp_path}/t", "twice long, id long", ",")
    good = [(i * 2, i) for i in range(1, 500) if i % 7 and i % 11]
    assert sorted(map(tuple, c.good.collect())) == sorted(good)
    assert c.counts() == (len(good), 499 - len(good))
    assert c.good.select("id").count() == len(good)  # a pruned read drops the same rows


def test_quoted_line_breaks_and_empty_tables(spark, tmp_path):
    p = _write(tmp_path / "m.csv", "text;id", '"one', 'two";1')
    assert [tuple(r) for r in FI.read_csv(spark, p, "id int, text string", multiline=True).collect()] == [(1, "one\ntwo")]
    p = _write(tmp_path / "e.csv", "text;id")
    assert FI.read_csv(spark, p, "id int, text string").collect() == [] and FI.read_csv_checked(spark, p, "id int").counts() == (0, 0)


def test_broken_pages_and_feeds(spark, tmp_path):
    schema = "events array<struct<uid: long, title: string>>, after string"
    p = _write(tmp_path / "pages.json", '{"events": [{"uid": 1, "title": "a"}, {"uid": 2}], "after": "x"}',
               '{"events": [{"uid": 3, "title": "c"', '{"after": "y"}', '{"events": []}', '{"events": [{"uid": "four"}]}')
    c = FI.read_event_pages_checked(spark, p, schema)
    assert sorted(map(tuple, c.good.collect())) == [(1, "a"), (2, None)]
    bad = sorted((r.reason, r.record[:12]) for r in c.quarantine.collect())
    assert bad == [("no list at events", '{"after":"y"'), ("not a document of this schema", '{"events": ['),
                   ("not a document of this schema", '{"events": [')]
    with pytest.raises(Exception):
        FI.read_event_pages(spark, p, schema).collect()
    p = _write(tmp_path / "info.json", '{"last_updated": 5, "data": {"stations": [{"station_id": "s", "name": "n", "lat": 1, "lon": 2}]}}',
               '{"last_updated": 6, "data": {}}', "no json")
    c = FI.read_station_feed_checked(spark, p, FI.STATION_INFO_SCHEMA)
    assert [tuple(r) for r in c.good.collect()] == [(5, "s", "n", 1.0, 2.0)] and c.counts() == (1, 2)
