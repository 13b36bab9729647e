import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimweave.sources import delimited, exchange, html, store
from claimweave.streaming import feed

POLLS = """<h2>Republican primary</h2><h3>Polling</h3>
<table><tr><th>Poll source</th><th>Date(s)<br>administered</th><th>Sample size<sup class="reference">[1]</sup></th><th>Margin of error</th><th>Ann</th><th>Bob</th></tr>
<tr><td rowspan="2">Acme</td><td rowspan="2">July 28–30, 2026</td><td>437 (LV)</td><td>± 4.5%</td><td>41%</td><td>—</td></tr>
<tr><td>600 (RV)</td><td>—</td><td>38%</td><td>&lt;1%</td></tr>
<tr><td colspan="6">Bob withdraws</td></tr>
<tr><td>Zeta</td><td>through July 30</td><td>~329</td><td>—</td><td>3o%</td><td>20%</td></tr></table>
<table><tr><th>Source of poll aggregation</th><th>Dates</th><th>Ann</th></tr><tr><td>Mean</td><td>July 1, 2026</td><td>40</td></tr></table>
<table><tr><th>Poll source</th><th>Dates</th></tr><tr><td><table><tr><td>x</td></tr></table></td><td>y</td></tr></table>
<style>li { }</style><script>var t = "<li>no</li>";</script>"""
RESULTS = """<h2>Democratic primary</h2><h4>Nominee</h4><ul><li>Ann Lee, senator</li></ul><h3>Results</h3>
<table><tr><th>Candidate</th><th>Votes</th><th>%</th></tr><tr><td>Ann Lee (incumbent)</td><td>315,278</td><td>39.81%</td></tr><tr><td>Bob Ray (withdrawn)</td><td>311,495</td><td>39.3</td></tr><tr><td>Write-in</td><td>7</td><td></td></tr><tr><td>Total votes</td><td>626,780</td><td>100</td></tr></table>
<h2>Democratic primary runoff</h2><h3>Results</h3><table><tr><th>Candidate</th><th>Votes</th></tr><tr><td>Cy</td><td>5</td></tr></table>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def test_poll_tables(spark):
    got = html.polls(html.cells(pages(spark, POLLS, None, ""))).orderBy("table_no", "r").collect()
    assert [(r["pollster"], r["sample"], r["group_no"]) for r in got] == [("Acme", "437 (LV)", 1), ("Acme", "600 (RV)", 1), ("Zeta", "~329", 2)]
    assert {(r["stage"], r["party"]) for r in got} == {("primary", "republican")}
    readings = html.poll_readings(html.polls(html.cells(pages(spark, POLLS)))).collect()
    fine = {(r["population"], r["option"]): r["percentage"] for r in readings if not r["error"]}
    assert fine == {}  # one unreadable cell refuses the whole poll
    assert {(r["pollster"], r["error"]) for r in readings} == {("Acme", "reading"), ("Zeta", "dates; reading; sample")}
    good = pages(spark, POLLS.replace("&lt;1%", "2%"))
    fine = {(r["population"], r["option"]): r["percentage"] for r in html.poll_readings(html.polls(html.cells(good))).collect() if not r["error"]}
    assert fine == {("lv", "Ann"): Decimal("41.000"), ("rv", "Ann"): Decimal("38.000"), ("rv", "Bob"): Decimal("2.000")}  # a dash is no reading, not zero


@pytest.mark.parametrize("old, new", [("Poll source", "Firm"), ("<h3>Polling", "<h3>Notes"), ("Republican primary", "Background"), ("Republican primary", "Green primary"), ("Sample size", "Size"), ("Margin of error", "Margin"), ("<th>Poll source</th><th>Date(s)<br>administered</th>", "<th>Dates</th><th>Poll source</th>")])
def test_changed_pages_give_no_polls(spark, old, new):
    assert html.polls(html.cells(pages(spark, POLLS.replace(old, new, 1)))).count() == 0


def test_results(spark):
    p = pages(spark, RESULTS)
    got = {r["candidate"]: r for r in html.results(html.cells(p), html.items(p)).collect()}
    assert set(got) == {"Ann Lee", "Bob Ray"}  # a table without shares is none of results
    assert got["Ann Lee"]["votes"] == 315278 and got["Ann Lee"]["share"] == Decimal("39.810") and got["Ann Lee"]["won"] is True
    assert got["Bob Ray"]["won"] is False


@pytest.mark.parametrize("heading, stage, party", [("Democratic primary runoff", "runoff", "democratic"), ("Republican primary runoff", "runoff", "republican"), ("2026 Democratic primary", "primary", "democratic"), ("General election runoff", "general", None), ("Runoff", "runoff", None), ("Nonpartisan blanket primary", "primary", None), ("Primary elections", "primary", None), ("Green primary", None, None), ("Primary results", None, None), ("Special election", None, None), ("Caucus", None, None)])
def test_sections(spark, heading, stage, party):
    assert tuple(spark.range(1).select(html.section(F.lit(heading))).first()[0]) == (stage, party)


def test_rows_that_are_no_candidates(spark):
    rows = "".join(f"<tr><td>{n}</td><td>1,000</td><td>x</td></tr>" for n in ("Turnout", "Others", "Other", "Majority", "Plurality", "N/A", "NA", "Write-in", "Writein votes", "Total", "", "Otherly Jones", "Totally Real"))
    page = f"<h2>General election</h2><h3>Results by county</h3><table><tr><th>Candidate</th><th>Votes</th><th>%</th></tr>{rows}</table>"
    got = html.results(html.cells(pages(spark, page)), html.items(pages(spark, page))).collect()
    assert {(r["candidate"], r["won"], r["share"]) for r in got} == {("Otherly Jones", None, None), ("Totally Real", None, None)}


def test_spans_and_silence(spark):
    page = '<table><tr><td rowspan=2>a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table><ul><li>one <b>two</b></li><li> </li></ul>'
    grid = {(r["r"], r["c"]): r["text"] for r in html.cells(pages(spark, page)).collect()}
    assert grid == {(0, 0): "a", (0, 1): "b", (0, 2): "b", (1, 0): "a", (1, 1): "c", (1, 2): "d"}
    assert [r["text"] for r in html.items(pages(spark, page, POLLS)).collect()] == ["one two"]


def test_divisions(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,name\nocd-division/country:us/state:wi,Wisconsin\nocd-division/country:us/state:wi/cd:1, First \nocd-division/country:us/state:wi/precinct:9,P\nocd-division/country:us/state:mi,\njunk,x\n")
    scan = delimited.table(spark, str(tmp_path / "d.csv"), "id string, name string")
    kept = delimited.divisions(scan, ("state", "cd"))
    assert [r["name"] for r in kept.where("kept").orderBy("id").collect()] == ["Wisconsin", "First"]
    assert delimited.report(kept).first().asDict() == {"kept": 2, "filtered": 3}


def test_federal_file(spark, tmp_path):
    rows = ["H6WI01|DOE, JANE|DEM|2026|WI|H|01|C|C|||||WI|5", "S6WI01|ROE|REP|2026|WI|S||C|N|||||WI|5", "H4WI01|OLD|REP|2024|WI|H|01|C|P|||||WI|5", "H6WI02|GONE|REP|2026|WI|H|02|C|F|||||WI|5", "P8|POE|LIB|2026|US|P|00|C|N|||||DC|2", "S6XX01|MOE|REP|2026||S||C|N|||||WI|5"]
    with zipfile.ZipFile(tmp_path / "cn.zip", "w") as z:
        z.writestr("cn.txt", "\n".join(rows))
    scan = delimited.rows(spark, str(tmp_path / "cn.zip"), delimited.FEDERAL_COLUMNS, "|")
    assert [r["index"] for r in scan.orderBy("index").collect()] == [0, 1, 2, 3, 4, 5]
    found = delimited.federal_candidates(scan, 2026)
    keys = {r["CAND_ID"]: r["contest_key"] for r in found.collect()}
    us = "ocd-division/country:us"
    assert keys == {"H6WI01": f"{us}/state:wi/cd:1/us-house/2026/primary/democratic", "S6WI01": f"{us}/state:wi/us-senate/2026/primary/republican", "P8": f"{us}/president/2026/primary/libertarian", "S6XX01": None}
    assert [r["error"] for r in found.where("error is not null").collect()] == ["S6XX01 has no office state"]
    two = io.BytesIO()
    with zipfile.ZipFile(two, "w") as z:
        z.writestr("a", "1"), z.writestr("b", "2")
    with pytest.raises(ValueError):
        delimited.unwrapped(two.getvalue())
    assert delimited.unwrapped(b"plain") == b"plain"


def test_records_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,name\r\n1,"two\nlines, ""quoted"""\r\n\r\n2\n3,caf\xe9,extra\n4, 5" pipe\n')
    got = delimited.rows(spark, str(tmp_path / "a.csv"), ("id", "name"), header=True).orderBy("index").collect()
    assert [(r["index"], r["id"], r["name"]) for r in got] == [(0, "1", 'two\nlines, "quoted"'), (1, "2", ""), (2, "3", "caf\ufffd"), (3, "4", '5" pipe')]
    assert list(delimited.records(b"")) == [] and list(delimited.records(b'a,"open\n')) == ['a,"open\n']


def test_store_is_idempotent(spark, tmp_path):
    s = store.ObjectStore(spark, str(tmp_path / "objects"))
    c = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b""),), (None,)], "content binary")
    assert s.put(c).count() == 2 and s.put(c).count() == 2 and s.objects().count() == 2
    unknown = spark.createDataFrame([("0" * 64,)], "sha256 string")
    assert s.missing(unknown).count() == 1 and s.get(unknown).count() == 0
    assert store.already_archived(spark.createDataFrame([("x",), ("x",), ("y",)], "sha256 string")).count() == 1


def test_markets(spark, tmp_path):
    event = {"event": {"event_ticker": "E", "title": "t", "category": "c"}, "markets": [{"ticker": "M", "title": "m", "status": "open", "open_time": "2026-01-01T00:00:00Z", "close_time": None, "volume": 3, "yes_bid_dollars": "0.4100", "yes_ask_dollars": "x"}]}
    (tmp_path / "e.json").write_text(json.dumps(event))
    row = exchange.markets(exchange.events(spark, str(tmp_path))).first()
    assert row["yes_bid_dollars"] == Decimal("0.410000") and row["yes_ask_dollars"] is None and row["open_time"].year == 2026


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (e.limit(500).union(e.limit(500))).repartition(1).write.parquet(str(tmp_path / "in"))
    n = e.limit(500).count()
    feed.run_available(feed.fresh(feed.read_events(spark, str(tmp_path / "in")), ["event_id"], "60 days"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    feed.run_available(feed.windowed(feed.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "days"), str(tmp_path / "c2"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert 0 < days.agg(F.sum("n")).first()[0] <= 2 * n


def test_grid_by_sweep_equals_a_grid_of_all_cells():
    import random

    from claimweave.sources import html

    rng = random.Random(9)
    for _ in range(300):
        rows = [[(rng.choice([1, 1, 1, 2, 3, 9]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 7))]
        grid, k, text = {}, 0, ""
        for r, row in enumerate(rows):
            text += "<tr>"
            for down, across in row:
                text += f"<td rowspan={down} colspan={across}>x{k}</td>"
                c = next(c for c in range(99) if (r, c) not in grid)
                for i in range(down):
                    for j in range(across):
                        grid.setdefault((r + i, c + j), f"x{k}")
                k += 1
        want = [(0, r, c, x, "", "") for (r, c), x in sorted(grid.items()) if r < len(rows)]
        assert list(html._walked(f"<table>{text}</table>").cells) == want


def test_spans_end_with_the_table(spark):
    page = "<table>" + "<tr>" + "<td rowspan=65534 colspan=1000>x</td>" * 3 + "</tr><tr><td>y</td></tr></table>"
    out = html_cells(spark, page)
    assert len(out) == 6001 and max(r["r"] for r in out) == 1 and [r["c"] for r in out if r["text"] == "y"] == [3000]


def html_cells(spark, page):
    from claimweave.sources import html

    return html.cells(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()


@pytest.mark.parametrize("header", [False, True])
def test_delimited_files_cut_anywhere(spark, tmp_path, header):
    """The same records and numbers as one task finds, whatever the pieces, with line ends and quotes inside of fields."""
    from claimweave.sources import delimited

    text = '﻿id,name\r\n1,"a\nb ""q"", c"\n\n2,plain\n3,"\r\n\n\n"\r4,x "y" z\n5,"é,\n",tail\n' + "".join(f'{k},"w{k}\n{"z" * (k % 9)}"\n' for k in range(40)) + "99,end"
    (tmp_path / "f.csv").write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes(b"id,name\n1,one\n2,two\n")
    want = {}
    for f in ("f.csv", "g.csv"):
        found = list(delimited.records((tmp_path / f).read_bytes()))
        want |= {(f, k): x.split(",")[0].strip() for k, x in enumerate(found[1:] if header else found)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (11, 37, 64, 150, 10_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            out = delimited.rows(spark, str(tmp_path), ("id", "name"), header=header).collect()
            assert {(r["path"].rsplit("/", 1)[1], r["index"]): r["id"] for r in out} == want and len(out) == len(want)
            assert [r["name"] for r in out if r["id"] == "1" and "f.csv" in r["path"]] == ['a\nb "q", c', "w1\nz"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rows_of_tables_are_those_of_their_cells(spark):
    from claimweave.sources import html

    odd = "<h2>General election</h2><h3>Polling</h3><table></table><table><tr></tr><tr><td>x</td></tr></table>" + POLLS + "<table><tr><th colspan=3>a</th></tr><tr><td rowspan=2>b</td></tr><tr></tr><tr><td>c<td>d</td></tr></table>"
    every = pages(spark, POLLS, odd, None, "", "<table><tr><td rowspan=3>a</td><td>b</td><td rowspan=2>z</td></tr><tr></tr><tr><td>c</td></tr></table>")
    whole = {(r["page_id"], r["table_no"], r["r"], c, x) for r in html.lines(every).collect() for c, x in enumerate(r["cells"]) if x is not None}
    assert whole == {(r["page_id"], r["table_no"], r["r"], r["c"], r["text"]) for r in html.cells(every).collect() if r["r"]}
    one, other = html.polls(html.lines(every)), html.polls(html.cells(every))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() > 3
    read = html.poll_readings(one)._jdf.queryExecution().executedPlan().toString()
    # One to deal the pages, one for all windows.
    assert read.count("Exchange hashpartitioning(page_id") == 2 and "collect_list(struct(c" not in read


def test_plain_pages_are_taken_as_htmlparser_takes_them(monkeypatch):
    from claimweave.sources import html

    def fed(text):
        page = html._Page()
        page.feed(text)
        page._close()
        return page

    told = lambda p: (list(p.cells), list(p.lines), p.items, p.heads)
    odd = ["<td rowspan=2>a<b>x</b></td>", "<td>a<td>b", "<sup class=reference><td>1</td></sup>", "<!-- x --><td>&lt;b &amp;</td>", "<td/>", "<br/>", "<tr/>", "<li>i", "<style>td</style>"]
    plain = [f"<h2>Q &amp; A</h2><table><tr>{a}<td colspan='2'>c</td></tr><TR>{b}</table>{a}" for a in odd for b in odd]
    left = ["<td title='a>b'>c</td>", "a < b", "<script><li>x</li></script>", "<style>td<", "<td title=&amp;>x", "<![CDATA[x]]>", "tail &am"]
    want = [told(fed(t)) for t in plain + left]
    assert [told(html._walked(t)) for t in plain + left] == want
    assert not any(html._taken(html._Page(), t) for t in left)
    monkeypatch.setattr(html._Page, "feed", lambda *_: pytest.fail("a plain page was fed"))
    assert [told(html._walked(t)) for t in plain] == want[: len(plain)]
    assert list(html._walked("<table><tr><td rowspan=² colspan=1" + 5000 * "0" + ">a</td></tr></table>").cells)[-1][2] == 999


def test_tables_leave_the_parser_in_pieces(spark, monkeypatch):
    from claimweave.sources import html

    page = html._walked(POLLS + POLLS)
    monkeypatch.setattr(html, "AT_ONCE", 9)
    rows = [(n, r + k, h2, h3, heads, x) for n, r, h2, h3, heads, piece in page.pieces for k, x in enumerate(piece)]
    assert rows == list(page.lines) and max(len(p[-1]) for p in page.pieces) == 2
    every = pages(spark, POLLS, POLLS.replace("&lt;1%", "2%"), None)
    one, other = html.polls(html.tables(every)), html.polls(html.cells(every))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    plan = html.poll_readings(one).drop("group_no")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1  # what a poll's rows have in common is looked for once
