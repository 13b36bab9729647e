"""Entity search and lookup (rows Q22-Q33, H4, F35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.functions import text, trigram
from claimweave.operators.closest import closest
from claimweave.operators.integrity import followed
from claimweave.operators.name_index import NameIndex
from claimweave.plans.materialize import cut

LOOKALIKE = 0.55
#: The reference ranks so many matched names for a query, those that match best; the rest are not offered.
CANDIDATES = 200


def matches(index: NameIndex, queries: DataFrame, floor: float = trigram.MATCH) -> DataFrame:
    """(query, name, normalized_name, whole) with similarity of at least ``floor``, from shared postings only.

    Pairs without a common trigram are never made, and names are compared once, however many entities bear them.
    """
    return index.matches(queries, floor)


def bearers(found: DataFrame, index: NameIndex) -> DataFrame:
    """Matched names with the entities that bear them."""
    return found.join(index.bearers(), ["name", "normalized_name"])


def claim_degree(claims: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Q23: distinct claims that touch an entity, as subject or object: ends are exploded, so joins stay equi-joins.

    Given ``entities(entity_id)``, only theirs are counted, and other claims go before the shuffle.
    """
    ends = claims.select("id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id")).where("entity_id is not null")
    if entities is not None:
        ends = ends.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return ends.groupBy("entity_id").agg(F.count_distinct("id").alias("claims"))


def search(
    aliases: DataFrame, entities: DataFrame, claims: DataFrame, survivors: DataFrame, queries: DataFrame, kind: str | None = None, limit: int = 20,
    candidates: int = CANDIDATES
) -> DataFrame:
    """Q22, Q24: the best entities for each query, merged ones under their survivor.

    Names pass the trigram index's filter and reach the word threshold; the ``candidates`` best of them by word and
    whole similarity are looked at, each under every entity that bears it. They rank by word similarity, number of
    claims, whole similarity, canonical name, id; the first 2 * limit are resolved, and the first hit of each survivor
    stays, with the alias that matched unless that is the survivor's own name.
    """
    index = NameIndex.kept(aliases)
    near = matches(index, queries)
    # Dealt by number, since the few bytes of a pair say little of its work.
    near = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query", "name")
    word = trigram.word_similarity(text.ascii_name(F.col("query")), F.col("normalized_name"))
    # As a generator: a filter on a column would be pushed below the exchange and the column computed twice.
    reached = F.explode(F.filter(F.array(word), lambda w: w >= trigram.WORD_MATCH)).alias("word")
    near = bearers(near.select("query", "name", "normalized_name", "whole", reached), index)
    best = Window.partitionBy("query").orderBy(F.round("word", 9).desc(), F.round("whole", 9).desc(), "name", "entity_id")
    near = cut(near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= candidates).drop("k"))  # read twice
    of = entities.select(F.col("id").alias("entity_id"), "kind", "canonical_name")
    named = near.join(of.where(F.col("kind") == kind) if kind else of, "entity_id")
    ranked = named.join(claim_degree(claims, near), "entity_id", "left").withColumn("claims", F.coalesce("claims", F.lit(0)))
    order = (F.round("word", 9).desc(), F.desc("claims"), F.round("whole", 9).desc(), F.col("canonical_name"), F.col("entity_id"), F.col("name"))
    page = ranked.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("k") <= 2 * limit)
    through = followed(page.drop("kind", "canonical_name"), survivors, "entity_id", "survivor")
    first = through.withColumn("j", F.row_number().over(Window.partitionBy("query", "survivor").orderBy("k"))).where("j = 1")
    hits = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("k"))).where(F.col("rank") <= limit)
    hits = hits.join(of.withColumnRenamed("entity_id", "survivor"), "survivor")
    alias = F.when(F.col("name") != F.col("canonical_name"), F.col("name")).alias("matched_alias")
    return hits.select(
        "query", "rank", F.col("survivor").alias("entity_id"), "kind", "canonical_name", alias, F.round("word", 6).alias("word"),
        F.round("whole", 6).alias("whole"), "claims"
    )


def lookalikes(aliases: DataFrame, entities: DataFrame, names: DataFrame, kind: str, floor: float = LOOKALIKE, limit: int = 5) -> DataFrame:
    """Q29: per name (column ``query``) the closest aliases within a kind, best first."""
    of = entities.where(F.col("kind") == kind).select(F.col("id").alias("entity_id"))
    found = closest(aliases.join(of, "entity_id", "left_semi"), names, floor, limit)
    return found.withColumn("whole", F.round("whole", 6))


def entity(entities: DataFrame, survivors: DataFrame, ids: DataFrame) -> DataFrame:
    """Q25: the entities of ids (column ``id``), through redirects."""
    through = followed(ids.select(F.col("id").alias("asked_id")), survivors, "asked_id", "id")
    return through.join(entities, "id").select("asked_id", "id", "kind", "canonical_name")


def entity_detail(entities: DataFrame, survivors: DataFrame, identifiers: DataFrame, claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Q25, Q26: the entities of ids with what tells them from their namesakes."""
    found = entity(entities, survivors, ids)
    only = lambda df, c: df.join(found.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    told = contexts(only(entities, "id"), only(identifiers, "entity_id"), only(claims, "subject_id"))
    return found.join(told, "id", "left").select("asked_id", "id", "kind", "canonical_name", "context")


def contexts(entities: DataFrame, identifiers: DataFrame, claims: DataFrame) -> DataFrame:
    """Q26: what tells an entity from its namesakes: a person's party, else the first identifier by namespace."""
    # Dealt first: the smallest of structs is found by sorting, which would hold a whole split of the input.
    first = identifiers.repartition("entity_id").groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct("namespace", "value")).alias("i"))
    party = claims.where("predicate = 'party_affiliation'").repartition("subject_id").groupBy(F.col("subject_id").alias("id")).agg(
        F.max_by("object_id", "created_at").alias("party")
    )
    joined = entities.join(first, "id", "left").join(party, "id", "left")
    named = F.concat_ws(":", "i.namespace", "i.value")
    return joined.select("id", F.coalesce(F.when(F.col("kind") == "person", F.col("party")), F.when(F.col("i").isNotNull(), named)).alias("context"))


def _name_hits(found: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Q31: entities whose name holds a fragment, or one of whose aliases does."""
    wanted = " ".join(name.lower().split())
    own = F.lower("canonical_name").contains(name.strip().lower())
    by_alias = aliases.where(F.col("normalized_name").contains(wanted)).select(F.col("entity_id").alias("id")).distinct()
    return found.join(by_alias.withColumn("hit", F.lit(True)), "id", "left").where(own | F.col("hit")).drop("hit")


def _page(found: DataFrame, aliases: DataFrame, order: list, limit: int | None, columns: tuple[str, ...]) -> DataFrame:
    """Q32: the first rows, whether there are more, and the aliases of those on the page, and of no others."""
    if limit is None:
        page = found.withColumn("truncated", F.lit(False))
    else:
        k = found.orderBy(*order).limit(limit + 1).withColumn("k", F.row_number().over(Window.orderBy(*order)))
        page = k.withColumn("truncated", F.max("k").over(Window.partitionBy()) > limit).where(F.col("k") <= limit)
    listed = aliases.join(page.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set("name")), "|").alias("aliases")
    )
    return page.join(listed, "id", "left").select(*columns, "truncated", "aliases")


def find_entities(entities: DataFrame, aliases: DataFrame, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Q27, Q31, Q32: by a fragment of a name or alias, in order of name; truncated tells whether there are more."""
    found = entities.where(F.col("kind") == kind) if kind else entities
    found = _name_hits(found.select("id", "kind", "canonical_name"), aliases, name)
    return _page(found, aliases, ["canonical_name", "id"], limit, ("id", "kind", "canonical_name"))


def latest_occurrence(claims: DataFrame) -> DataFrame:
    """Q30: the moment of the occurrence claim that was made last, per event; ties go to the later moment."""
    seen = claims.where("predicate = 'event_occurrence'").select("subject_id", "created_at", F.coalesce("valid_from", "valid_at").alias("moment"))
    # Dealt first: the largest of structs is found by sorting, which would hold a whole split of the input.
    return seen.repartition("subject_id").groupBy(F.col("subject_id").alias("id")).agg(
        F.max(F.struct("created_at", "moment")).alias("m")
    ).select("id", F.col("m.moment").alias("moment"))


def find_events(
    entities: DataFrame, claims: DataFrame, kind: str | None = None, participants: DataFrame | None = None, jurisdiction: str | None = None,
    after: Column | None = None, before: Column | None = None, limit: int | None = 20, name: str | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """Q28: events by what is claimed of them, latest first (nulls last), then by name and id; both bounds are inside.

    A name is looked for in names and ``aliases``. With ``aliases`` the page is told as find_entities() tells it.
    """
    found = entities.where("kind = 'event'").select("id", "kind", "canonical_name")
    of = lambda p, c="subject_id": claims.where(F.col("predicate") == p).select(F.col(c).alias("id"), "subject_id", "object_id", "value", "valid_from", "valid_at")
    if name:
        known = aliases if aliases is not None else entities.limit(0).select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("normalized_name"))
        found = _name_hits(found, known, name)
    if kind:
        found = found.join(of("event_kind").where(F.get_json_object("value", "$.kind") == kind), "id", "left_semi")
    if participants is not None:
        found = found.join(
            of("participated_in", "object_id").join(participants.select(F.col("id").alias("subject_id")), "subject_id", "left_semi"), "id",
            "left_semi"
        )
    if jurisdiction:
        found = found.join(of("event_in_jurisdiction").where(F.col("object_id") == jurisdiction), "id", "left_semi")
    if after is not None or before is not None:
        moment = F.coalesce("valid_from", "valid_at")
        seen = of("event_occurrence")
        seen = seen.where(moment >= after) if after is not None else seen
        found = found.join(seen.where(moment <= before) if before is not None else seen, "id", "left_semi")
    dated = found.join(latest_occurrence(claims), "id", "left")
    order = [F.col("moment").desc_nulls_last(), F.col("canonical_name"), F.col("id")]
    if aliases is not None:
        return _page(dated, aliases, order, limit, ("id", "kind", "canonical_name", "moment"))
    out = dated.orderBy(*order)
    return (out.limit(limit) if limit else out).select("id", "canonical_name", "moment")
