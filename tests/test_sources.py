"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json

from tidemark.sources import calendar, graphs, market


def test_quotes_last_row_wins(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("a,b,c,d,e,f,g,h,i,j\n20171010 17:00:00,0,0,0,1.0,0,0,0,0,3.0\n20171010 17:00:00,0,0,0,2.0,0,0,0,0,4.0\nbad,0,0,0,1,0,0,0,0,1\n20171010 18:30:05,0,0,0,5,0,0,0,0,5\n")
    df = market.quotes(spark, str(p), "EUR")
    got = {r.ts: r.mid for r in df.collect()}
    assert got == {dt.datetime(2017, 10, 10, 17): 3.0, dt.datetime(2017, 10, 10, 18, 30, 5): 5.0}
    kept = market.in_hours(df, dt.datetime(2017, 10, 10), dt.datetime(2017, 10, 11)).collect()
    assert [r.ts.hour for r in kept] == [17]


def test_dataset_blank_missing_and_bad(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text(" timestamp , usdjpy_price,WTI_OIL\n2017-10-10T17:00,0.5, \n2017-10-10T18:00:30,x,1\nnever,1,1\n2017-10-10T19:00,-1.5,2\n")
    rows = market.dataset(spark, str(p)).orderBy("ts").collect()
    assert [(r.usdjpy_price, r.wti_oil, r.eurusd_atr) for r in rows] == [(0.5, 0.0, 0.0), (-1.5, 2.0, 0.0)]


def test_export_drops_unlabelled(spark, tmp_path):
    cols = ", ".join(f"{c} double" for c in market.EXPORT)
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, k), *([0.5] * 12), lab) for k, lab in enumerate((-1, 2))], f"ts timestamp_ntz, {cols}, label int")
    assert market.export_labelled(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns[0] == "Timestamp" and back.columns[-1] == "LABEL" and back.count() == 1
    assert market.dataset(spark, str(tmp_path / "out"), market.EXPORT).first().usdjpy_price == 0.5
    assert not market.export_labelled(df.where("label = -1"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_metrics_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m_AutoML_1", 1, 0.123456, 0.5, 0.25, 0.8)], "model_id string, class_id int, precision double, recall double, f1 double, accuracy double")
    market.export_metrics(df, str(tmp_path / "m"))
    assert market.metrics(spark, str(tmp_path / "m")).first().precision == 0.12346


def test_last_of_hour(spark):
    t = dt.datetime(2020, 1, 1, 5)
    df = spark.createDataFrame([(1, t, 1.0), (3, t, 3.0), (2, t, 2.0)], "event_id long, ts timestamp_ntz, value double")
    assert market.last_of_hour(df, "value", ["ts", "event_id"]).first().price == 3.0


def test_calendar(spark, tmp_path):
    rows = [{"date": "2020-01-01 08:30:00", "country": "US", "event": "CPI", "actual": 2.4, "estimate": 2.1}, {"event": None}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    assert calendar.releases(spark, str(tmp_path / "c.json")).where("actual = 2.4").count() == 1
    assert calendar.parse(spark, [json.dumps(rows), "[]"]).count() == 2
    days = list(calendar.chunks(2019, 2020))
    assert len(days) == 8 and days[0] == (dt.date(2019, 1, 1), dt.date(2019, 3, 31)) and days[-1][1] == dt.date(2020, 12, 31)

    def flaky(url):
        if "2019-04-01" in url:
            raise OSError("down")
        return "[]"

    assert len(calendar.fetch("http://localhost/x", "k", 2019, 2020, flaky, 0)) == 7


def test_graph_collection(spark, tmp_path):
    w = lambda n, s: (tmp_path / f"G_{n}.txt").write_text(s)
    w("graph_indicator", "1\n1\n2\n")
    w("graph_labels", "7\n9\n")
    w("A", "1, 2\n2, 3\n")
    w("edge_attributes", "3.5\n4\n")
    w("node_attributes", "1, -5\n3, -5\n2, -5\n")
    g = graphs.load(spark, str(tmp_path), "G")
    assert [(r.node_id, r.graph_id, r.label) for r in g["nodes"].orderBy("node_id").collect()] == [(1, 1, 0), (2, 1, 0), (3, 2, 0)]
    assert [(r.src, r.dst, r.attr, r.available_at) for r in g["edges"].orderBy("edge_idx").collect()] == [(1, 2, 3.5, 3), (2, 3, 4.0, 4)]
    assert {r.graph_id: r.label for r in g["graph_labels"].collect()} == {1: 7, 2: 9}
    scaled = {(r.node_id, r.k): r.x for r in graphs.normalized_attributes(g["nodes"]).collect()}
    assert scaled[2, 0] == 1.0 and scaled[3, 0] == 0.5 and scaled[1, 1] == 0.0
    (tmp_path / "t.txt").write_text("0,1,3,2\n5,4,9\n")
    line = {(r.node_id, r.time): r.label for r in graphs.node_timeline(spark, str(tmp_path / "t.txt")).collect()}
    assert line == {(1, 0): 1, (1, 3): 2, (2, 5): 4}


def test_lines_of_files_in_several_splits(spark, tmp_path):
    """Numbers follow the files' names and the splits within them, without Python in the plan."""
    from tidemark.sources import graphs

    want = []
    for name, n in (("b", 700), ("a", 5000), ("c", 0), ("d", 1)):
        text = [f"{name}{k} é{'x' * (k % 37)}" for k in range(n)]
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"{name}.txt").write_text("".join(x + "\n" for x in text), encoding="utf-8")
        want.append((name, text))
    want = [x for _, text in sorted(want) for x in text]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 20
        df = graphs.lines(spark, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.line_no, r.value) for r in df.orderBy("line_no").collect()] == [(k + 1, x) for k, x in enumerate(want)]
    (tmp_path / "none.txt").write_text("")
    assert graphs.lines(spark, str(tmp_path / "none.txt")).count() == 0


def test_calendar_source(spark, tmp_path):
    """A task a range, pruned by dates; ranges that fail are rows that say why."""
    from tidemark.sources import calendar

    for k, (a, b) in enumerate(calendar.chunks(2019, 2020)):
        body = {0: "[]", 1: "not json", 2: "", 3: '[1, null, {"date": 5, "actual": "x", "estimate": 2}]'}.get(k, json.dumps([{"date": f"{a} 08:30:00", "event": f"e{k}", "actual": k}]))
        if k != 7:
            (tmp_path / f"{a}_{b}").write_text(body)
    url = f"file://{tmp_path}/{{from}}_{{to}}"
    df = calendar.ranges(spark, url, 2019, 2020, tries=1)
    assert df.rdd.getNumPartitions() == 8
    rows = df.collect()
    assert sorted(r.chunk for r in rows if r.error) == ["2019-04-01", "2020-10-01"]
    assert sorted((r.date, r.event, r.actual, r.estimate) for r in rows if not r.error) == [("2020-01-01 08:30:00", "e4", 4.0, None), ("2020-04-01 08:30:00", "e5", 5.0, None), ("2020-07-01 08:30:00", "e6", 6.0, None), ("5", None, None, 2.0)]
    some = calendar.ranges(spark, url, 2019, 2020).where("date >= '2020-02-15' AND date < '2020-07-02'")
    assert some.rdd.getNumPartitions() == 3 and sorted(r.event for r in calendar.received(some).collect()) == ["e5", "e6"]
    assert calendar.ranges(spark, url, 2019, 2020).where("date > '2031'").count() == 0
    assert calendar.failures(df).count() == 2


def test_recovered_vectors(spark):
    from tidemark.functions import hv
    from tidemark.operators import clauses

    shape = hv.Shape(2, 8, 4)
    counts = spark.createDataFrame([("a", 3, 5), ("a", 19, 4), ("a", 9, 7), ("a", 0, -2), ("b", 15, 1), (None, 2, 1)], "sample string, literal int, total long")
    got = {r.sample: list(r.hv) for r in clauses.recovered(counts, 3, shape).collect()}
    assert got == {"a": [1 << 3 | 1 << 1, 1 << 1], "b": [0b11, 1 << 7], None: [0b111, 0]}
    book = spark.createDataFrame([(4, [0b1010, 0b10]), (2, [0b1010, 0b11]), (1, [0b1010, 0b10]), (9, [0, 0])], "level int, code array<bigint>")
    assert clauses.mean_bits(book) == 2 and clauses.mean_bits(book.limit(0)) == 1
    found = {r.sample: (r.level, r.distance) for r in clauses.telling(counts, book, shape).collect()}
    assert found["a"] == (1, 1)
