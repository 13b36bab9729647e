"""Reads that must leave nothing out."""

from claimweave.plans import queries


def test_latest_without_a_page_gives_every_claim(spark):
    claims = spark.range(250).selectExpr("cast(id AS string) AS id", "'e' AS subject_id", "cast(null AS timestamp) AS valid_from", "cast(null AS timestamp) AS valid_at", "cast(null AS timestamp) AS created_at", "'o' AS object_id")
    assert queries.C.latest(claims).count() == 100 and queries.C.latest(claims, k=None).count() == 250


def test_search_offers_no_name_under_the_word_threshold(spark):
    from claimweave.operators import search

    aliases = spark.createDataFrame([("a", "red widget", "red widget"), ("b", "rex widow", "rex widow")], "entity_id string, name string, normalized_name string")
    entities = spark.createDataFrame([("a", "option", "A"), ("b", "option", "B")], "id string, kind string, canonical_name string")
    claims = spark.createDataFrame([], "id string, subject_id string, object_id string")
    survivors = spark.createDataFrame([], "id string, survivor_id string")
    asked = spark.createDataFrame([("red widget",)], "query string")
    near = {r["name"] for r in search.matches(search.NameIndex.build(aliases), asked).collect()}
    assert near == {"red widget", "rex widow"}
    assert [r["entity_id"] for r in search.search(aliases, entities, claims, survivors, asked).collect()] == ["a"]
