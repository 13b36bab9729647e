import hashlib
import json
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimweave.functions import canon, keys, parse, text, trigram
from claimweave.plans import catalog


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(x,) for x in inputs], "x string") if not isinstance(inputs[0], tuple) else spark.createDataFrame(inputs)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names(spark):
    got = values(spark, ["  Straße   X ", "ＡＢ c", "plain  Name", " ", None], text.normalize_name(F.col("x")))
    assert [g[0] for g in got] == ["strasse x", "ab c", "plain name", None, None]
    assert values(spark, ["A  & B!", "--", "Émile"], text.slug(F.col("x"))) == [("a-b",), (None,), ("mile",)]
    printed = ["Jane Doe (incumbent)", "Ann (WITHDRAWN) Lee", "Bo (deceased)", "Cy (writein) (write-in)", "Di (presumptive nominee)"]
    assert [g[0] for g in values(spark, printed, text.candidate_name(F.col("x")))] == ["Jane Doe", "Ann Lee", "Bo", "Cy", "Di (presumptive nominee)"]
    assert values(spark, ["dem", "XYZ", "", "NON", "CON"], text.party_slug(F.col("x"))) == [("democratic",), ("xyz",), (None,), ("nonpartisan",), ("con",)]


def test_decimals(spark):
    got = values(spark, ["100", "12.50", "0.000", "-0.0", "1e5", None], canon.decimal(F.col("x")))
    assert [g[0] for g in got] == ["100", "12.5", "0", "0", None, None]


def test_fingerprint_equals_python(spark):
    rows = [('he said "é\\"\n', "a", None), ("plain", None, '{"votes":1}')]
    for subject, obj, value in rows:
        fields = dict.fromkeys(canon.CLAIM_KEYS)
        fields |= {"subject_id": subject, "object_id": obj}
        df = spark.createDataFrame([(subject, obj, value)], "s string, o string, v string")
        columns = {k: F.lit(None).cast("string") for k in canon.CLAIM_KEYS} | {"subject_id": F.col("s"), "object_id": F.col("o"), "value": F.col("v")}
        expected = json.dumps(fields | {"value": json.loads(value) if value else None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert df.select(canon.claim_fingerprint(**columns)).first()[0] == hashlib.sha256(expected.encode()).hexdigest()
    with pytest.raises(ValueError):
        canon.claim_fingerprint(value=F.lit(1))


def test_uuid5_and_catalogue(spark):
    got = values(spark, ["a", "candidate_in/1"], canon.uuid5(catalog.SPACE, F.col("x")))
    assert [g[0] for g in got] == [str(uuid.uuid5(catalog.SPACE, "a")), catalog.version_id("candidate_in")]
    assert catalog.by_version(catalog.version_id("endorsed")).slug == "endorsed"
    with pytest.raises(KeyError):
        catalog.version_id("nothing")
    assert catalog.predicates(spark).count() == 20
    assert catalog.active_namespaces(spark).first()["namespace"] == "ocd-division"
    assert catalog.seed(spark, catalog.predicates(spark).where("slug <> 'assessed'")).count() == 1


def test_locators(spark):
    df = spark.createDataFrame([("json", '{"json_pointer": "/rows/3"}'), ("json", '{"json_pointer": "rows"}'), ("pdf", '{"page_start": "2", "page_end": "1"}'), ("web", "{}"), ("full_source", "{}"), ("video", '{"start": "1.50"}')], "k string, p string")
    got = [r[0] for r in df.select(canon.locator(F.col("k"), F.col("p"))).collect()]
    assert got == ['{"json_pointer":"/rows/3","kind":"json"}', None, None, None, '{"kind":"full_source"}', '{"end":null,"kind":"video","start":"1.5"}']


def test_contest_keys(spark):
    d = "ocd-division/country:us/state:wi"
    got = values(spark, [f"{d}/governor/2026/primary/democratic", f"{d}/governor/2026/general/democratic", f"{d}/governor/1700/general", "junk"], keys.contest_parts(F.col("x")), keys.contest_label(keys.contest_parts(F.col("x"))))
    assert tuple(got[0][0]) == (d, "governor", 2026, "primary", "democratic") and got[0][1] == "WI Governor 2026 Democratic Primary"
    assert all(g[0][0] is None for g in got[1:])
    event = keys.event_key(F.lit(d), F.lit("debate"), F.lit("2026-07-01").cast("timestamp"), F.lit("month"), F.lit(None))
    assert spark.range(1).select(event).first()[0] is None


@pytest.mark.parametrize("division, office, cycle, stage, party, key", [
    ("ocd-division/country:us/state:wi", "governor", 2026, "primary", "working-families", "ocd-division/country:us/state:wi/governor/2026/primary/working-families"),
    ("ocd-division/country:us", "governor", 2026, "general", None, "ocd-division/country:us/governor/2026/general"),
    ("ocd-division/country:us", "governor", 2026, "general", "green", None),
    ("ocd-division/Bad Div!/x", "governor", 2026, "general", None, None),
    ("country:us", "governor", 2026, "general", None, None),
    ("ocd-division/country:us", "Governor", 2026, "general", None, None),
    ("ocd-division/country:us", "governor", 2026, "primary", "Green Party", None),
    ("ocd-division/country:us", "governor", 1787, "general", None, None),
    ("ocd-division/country:us", "governor", 2026, "final", None, None),
])
def test_contest_keys_are_checked(spark, division, office, cycle, stage, party, key):
    assert spark.range(1).select(keys.contest_key(*map(F.lit, (division, office, cycle, stage)), F.lit(party).cast("string"))).first()[0] == key


@pytest.mark.parametrize("office, state, district, cycle, party, key", [
    ("H", "WI", "01", 2026, "DEM", "state:wi/cd:1/us-house/2026/primary/democratic"),
    ("H", "AK", "00", 2026, "rep", "state:ak/cd:1/us-house/2026/primary/republican"),
    ("S", "WI", None, 2026, "", "state:wi/us-senate/2026/primary/independent"),
    ("P", "", "", 2028, "W F", "president/2028/primary/w-f"),
    ("S", " ", "", 2026, "DEM", None),
    ("H", None, "01", 2026, "DEM", None),
])
def test_federal_keys_hold_the_party(spark, office, state, district, cycle, party, key):
    got = spark.range(1).select(keys.federal_contest_key(*(F.lit(x).cast("string") for x in (office, state, district)), F.lit(cycle), F.lit(party))).first()[0]
    assert got == (key and "ocd-division/country:us/" + key)


@pytest.mark.parametrize("said, started, ended", [("July 28–30, 2026", "2026-07-28", "2026-07-30"), ("Jul 28 – August 3, 2026", "2026-07-28", "2026-08-03"), ("December 30 – January 2, 2026", "2025-12-30", "2026-01-02"), ("July 4, 2026", "2026-07-04", "2026-07-04"), ("through July 30", None, None), ("July 2026", None, None), ("February 30, 2026", None, None), ("Aug. 24−29, 2023", "2023-08-24", "2023-08-29"), ("Sept 3, 2025 — Oct 1, 2025", "2025-09-03", "2025-10-01"), ("July 1 to July 3, 2026", None, None), ("Julember 3, 2026", None, None), ("3–5, 2026", None, None), ("July 1–2–3, 2026", None, None)])
def test_fieldwork(spark, said, started, ended):
    got = values(spark, [said], parse.fieldwork(F.col("x")))[0][0]
    assert tuple(None if x is None else x.isoformat() for x in got) == (started, ended)


def test_cells(spark):
    got = [tuple(g[0]) for g in values(spark, ["437 (LV)", "905 LV", "3,045 LV)", "– (LV)", "~329", "—", ""], parse.sample(F.col("x")))]
    assert got == [(437, "lv", False), (905, "lv", False), (3045, "lv", False), (None, "lv", False), (None, None, True), (None, "unknown", False), (None, "unknown", False)]
    got = [tuple(g[0]) for g in values(spark, ["41%", "39.5", "<1%", "3o%", "—"], parse.percentage(F.col("x")))]
    assert got == [(Decimal("41.000"), False), (Decimal("39.500"), False), (None, True), (None, True), (None, False)]
    got = [tuple(g[0]) for g in values(spark, ["TBA", "n/a", "?", "500 (registered)", "(x) 3"], parse.sample(F.col("x")))]
    assert got == [(None, "unknown", False), (None, "unknown", False), (None, None, True), (500, "registered", False), (None, None, True)]
    got = [tuple(g[0]) for g in values(spark, ["± 3.5%", "TBA", "?", "about 3"], parse.margin(F.col("x")))]
    assert got == [(Decimal("3.500"), False), (None, False), (None, True), (None, True)]
    assert [tuple(g[0]) for g in values(spark, ["tba", "± 3%"], parse.percentage(F.col("x")))] == [(None, False), (None, True)]
    assert values(spark, ["315,278", "x"], parse.votes(F.col("x"))) == [(315278,), (None,)]


def test_places(spark):
    row = spark.range(1).select(parse.geoid(*map(F.lit, ("11", "001", "980000", "1034"))), parse.geoid(F.lit("11"), F.lit(None), F.lit("1"), F.lit("1")), parse.geoid(F.lit(None), F.lit("1"), F.lit("1"), F.lit("1")), parse.coordinates(F.lit("-89.4,43.1")), parse.coordinates(F.lit("200,1")), parse.wkt(F.lit(-89.4), F.lit(43.1)), text.one_line(F.lit("1 Main"), F.lit(" "), F.lit("Madison"))).first()
    assert row[0] == "110019800001034" and row[1] == "11" and row[2] is None
    assert tuple(row[3]) == (-89.4, 43.1) and tuple(row[4]) == (None, None) and row[5] == "POINT(-89.4 43.1)" and row[6] == "1 Main, Madison"


def test_trigrams(spark):
    row = spark.range(1).select(trigram.similarity(F.lit("crowley city"), F.lit("crowley")), trigram.similarity(F.lit("david crowley"), F.lit("crowley")), trigram.word_similarity(F.lit("crowley"), F.lit("david crowley")), trigram.similarity(F.lit(""), F.lit(""))).first()
    assert [round(x, 3) for x in row] == [0.667, 0.571, 1.0, 0.0]
