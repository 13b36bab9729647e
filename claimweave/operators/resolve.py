"""Resolving mentions to entities, a batch at a time (rows R2-R7, H5, H43-H45)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.functions import text
from claimweave.functions.text import slug
from claimweave.operators import search
from claimweave.operators.components import connected
from claimweave.operators.integrity import followed
from claimweave.plans.materialize import cut, dealt, kept, large


def kinds_fit(stored: Column, observed: Column) -> Column:
    """H5: equal, or either is other."""
    return (stored == observed) | (stored == "other") | (observed == "other")


def mention(**fields: Column) -> Column:
    """Named id columns as an array of (namespace, value), without nulls."""
    pairs = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("namespace"), v.alias("value")) for k, v in fields.items()))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def _asserted(mentions: DataFrame, key: str = "mention_id") -> DataFrame:
    """(mention_id, k, namespace, value) of every identifier, normalized, in order."""
    each = mentions.select(key, F.posexplode("identifiers").alias("k", "i"))
    named = each.select(key, "k", text.namespace(F.col("i.namespace")).alias("namespace"), F.trim("i.value").alias("value"))
    return named.where("namespace is not null and value is not null")


def by_identifier(mentions: DataFrame, entities: DataFrame, identifiers: DataFrame, survivors: DataFrame) -> DataFrame:
    """(mention_id, entity_id, error): the survivor of the first identifier that has an owner.

    An exact key of an entity of another kind is no match but an error of the source: entity_id is null then.
    """
    owned = _asserted(mentions).join(identifiers, ["namespace", "value"])
    first = owned.groupBy("mention_id").agg(F.min(F.struct("k", "namespace", "value", "entity_id")).alias("m")).select("mention_id", "m.*")
    ends = followed(first, survivors, "entity_id", "end").join(mentions.select("mention_id", "kind"), "mention_id")
    ends = ends.join(entities.select(F.col("id").alias("end"), F.col("kind").alias("stored")), "end")
    fits = kinds_fit(F.col("stored"), F.col("kind"))
    said = F.concat("namespace", F.lit(":"), "value", F.lit(" already identifies "), "stored", F.lit(" "), "end", F.lit(", not a "), "kind")
    return ends.select("mention_id", F.when(fits, F.col("end")).alias("entity_id"), F.when(~fits, said).alias("error"))


def contradictions(pairs: DataFrame, mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(mention_id, entity_id) whose entity has values in a namespace that the mention asserts, but not its value."""
    asked = _asserted(mentions).select("mention_id", "namespace", F.col("value").alias("asserted"))
    own = pairs.select("mention_id", "entity_id").join(identifiers, "entity_id").join(asked, ["mention_id", "namespace"])
    same = own.groupBy("mention_id", "entity_id", "namespace", "asserted").agg(F.max((F.col("value") == F.col("asserted")).cast("int")).alias("same"))
    return same.where("same = 0").select("mention_id", "entity_id").distinct()


def by_alias(mentions: DataFrame, aliases: DataFrame, entities: DataFrame, identifiers: DataFrame, survivors: DataFrame) -> DataFrame:
    """(mention_id, entity_id, ambiguous_with) for mentions whose normalized name is known.

    Entities of the mention's kind, or of kind other, bear the name. If they have one survivor, that is the match,
    unless its identifiers contradict the mention's: then entity_id is null. If they have several, the name decides
    nothing, whatever their identifiers: entity_id is null, too, and ambiguous_with lists them.
    """
    # Once for a name and kind, however many mentions bear it; only contradictions are the mention's own.
    asked = mentions.select("kind", "normalized_name").where("normalized_name is not null").distinct()
    found = asked.join(aliases.select("entity_id", "normalized_name"), "normalized_name")
    found = found.join(entities.select(F.col("id").alias("entity_id"), F.col("kind").alias("stored")), "entity_id")
    found = found.where((F.col("stored") == F.col("kind")) | (F.col("stored") == "other"))
    ends = followed(found, survivors, "entity_id", "end").select("kind", "normalized_name", "end").distinct()
    named = ends.groupBy("kind", "normalized_name").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    several = F.size("ends") > 1
    named = kept(named.select("kind", "normalized_name", F.when(~several, F.col("ends")[0]).alias("entity_id"), F.when(several, F.col("ends")).alias("ambiguous_with")))
    told = mentions.select("mention_id", "kind", "normalized_name").join(named, ["kind", "normalized_name"])
    one = mentions.select("mention_id", "kind", "normalized_name").join(
        named.where("entity_id is not null").drop("ambiguous_with"), ["kind", "normalized_name"]
    )
    against = contradictions(one, mentions, identifiers).select("mention_id", F.lit(True).alias("against"))
    told = told.join(against, "mention_id", "left")
    return told.select("mention_id", F.when(F.col("against").isNull(), F.col("entity_id")).alias("entity_id"), "ambiguous_with")


def minted(kind: Column, key: Column) -> Column:
    """The id of a new entity: the same for the same kind and key, so a second run mints nothing."""
    return F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws("\x1f", kind, key), 256), 1, 32))


def _plain_namespaces(mentions: DataFrame) -> DataFrame:
    """``mentions`` whose namespaces are normalized where any holds more than ASCII; others stay as they are, in the JVM."""
    odd = F.exists("identifiers", lambda i: ~i["namespace"].rlike(r"^[\x00-\x7F]*$"))
    if mentions.where(odd).isEmpty():
        return mentions
    folded = mentions.withColumn("__n", text.folded_namespaces(F.col("identifiers.namespace")))
    pair = lambda i, n: F.struct(n.alias("namespace"), i["value"].alias("value"))
    return folded.withColumn("identifiers", F.zip_with("identifiers", "__n", pair)).drop("__n")


def _faces(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """What decides an entity, once each, known by its smallest mention_id; ``mention_id, key`` of these and of all mentions; whether they are many.

    Mentions of one kind, name and identifiers have one face, so a thing that is mentioned very often is resolved once.
    """
    sure = F.coalesce(F.col("authoritative"), F.lit(False)) if "authoritative" in mentions.columns else F.lit(False)
    ids = F.transform("identifiers", lambda i: F.struct(text.namespace(i["namespace"]).alias("namespace"), F.trim(i["value"]).alias("value")))
    ids = F.coalesce(F.filter(ids, lambda i: i["namespace"].isNotNull() & i["value"].isNotNull()), F.array().cast("array<struct<namespace:string,value:string>>"))
    rows = mentions.select("mention_id", "kind", "normalized_name", ids.alias("identifiers"), sure.alias("sure"))
    # Half of the digest's bytes, not its digits: the key is most of what is dealt of a short mention.
    digest = F.unhex(F.sha2(F.to_json(F.struct("kind", "normalized_name", "identifiers", "sure")), 256))
    rows = rows.withColumn("key", F.substring(digest, 1, 16))
    held = ("kind", "normalized_name", "identifiers", "sure")
    faces = rows.groupBy("key").agg(F.min("mention_id").alias("mention_id"), *(F.any_value(c).alias(c) for c in held))
    faces = cut(faces.withColumn("sure", F.col("sure") & (F.size("identifiers") > 0)))
    many = large(faces)
    faces = dealt(faces) if many else faces
    return _plain_namespaces(faces.drop("key")), faces.select("mention_id", "key"), rows.select("mention_id", "key"), many


def _grouped(loose: DataFrame, known: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Mentions without a stored owner, by what they share: ``root, direct, by_key, by_name, group_kind`` added.

    Mentions that share identifiers, also through others, have one root. ``direct`` is the entity that another mention
    of the batch brings to one of this one's identifiers, ``by_key`` the smallest such entity of the group, ``by_name``
    that of the group's first mention whose name decides.
    """
    asked = kept(_asked_keys(loose))
    brought = _asked_keys(known).join(identifiers.select("namespace", "value"), ["namespace", "value"], "left_anti")
    brought = brought.groupBy("namespace", "value").agg(F.min("entity_id").alias("anchor"))
    hubs = asked.groupBy("namespace", "value").agg(F.min("mention_id").alias("hub"))
    linked = asked.join(dealt(hubs), ["namespace", "value"]).where("mention_id <> hub")
    root = connected(linked.select(F.col("mention_id").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("id", "mention_id")
    direct = asked.join(brought, ["namespace", "value"]).groupBy("mention_id").agg(F.min(F.struct("k", "anchor")).alias("d"))
    each = loose.join(dealt(root), "mention_id", "left").join(dealt(direct.select("mention_id", F.col("d.anchor").alias("direct"))), "mention_id", "left")
    each = each.withColumn("root", F.coalesce("root", "mention_id"))
    group = each.groupBy("root").agg(
        F.min("direct").alias("by_key"), F.min_by("alias_id", F.when(F.col("alias_id").isNotNull(), F.col("mention_id"))).alias("by_name"),
        F.min(F.struct(F.col("kind") == "other", "mention_id", "kind")).alias("g")
    )
    return each.join(dealt(group.select("root", "by_key", "by_name", F.col("g.kind").alias("group_kind"))), "root")


def _asked_keys(rows: DataFrame) -> DataFrame:
    kept = [c for c in ("entity_id",) if c in rows.columns]
    return rows.select("mention_id", *kept, F.posexplode("identifiers").alias("k", "i")).select("mention_id", *kept, "k", "i.namespace", "i.value")


def _fresh(new: DataFrame) -> DataFrame:
    """Mentions of entities to be made: ``mention_id, entity_id, method, ambiguous_with``.

    Groups with identifiers come first. Those of one kind and name, none of them defined by its identifiers, are one
    entity unless any two of them differ in a namespace. A mention without identifiers joins the only new entity of its
    name; if there are several, it makes its own and lists them. Names that stored entities bear join nothing here.
    """
    keyed = kept(new.where(F.size("identifiers") > 0))
    first = F.element_at("identifiers", 1)
    groups = keyed.groupBy("root").agg(
        F.max("sure").alias("sure"), F.first("group_kind").alias("group_kind"), F.min(F.concat_ws("=", first["namespace"], first["value"])).alias("key")
    )
    names = keyed.where("not borne and normalized_name is not null").select("root", "group_kind", "normalized_name").distinct()
    free = names.join(groups.where("not sure").select("root"), "root", "left_semi")
    hubs = free.groupBy("group_kind", "normalized_name").agg(F.min("root").alias("hub"))
    alike = free.join(hubs, ["group_kind", "normalized_name"]).where("root <> hub")
    joined = connected(alike.select(F.col("root").alias("u"), F.col("hub").alias("v"))).select(F.col("id").alias("root"), F.col("root").alias("whole"))
    owned = keyed.join(joined, "root").select("root", "whole", F.explode("identifiers").alias("i"))
    apart = owned.groupBy("whole", "i.namespace").agg(F.count_distinct("root").alias("r"), F.count_distinct("i.value").alias("n"))
    apart = apart.where("r > 1 and n > 1").select("whole").distinct().withColumn("apart", F.lit(True))
    final = groups.join(dealt(joined), "root", "left").join(apart, "whole", "left")
    final = final.withColumn("final", F.when(F.col("apart") | F.col("whole").isNull(), F.col("root")).otherwise(F.col("whole")))
    made = final.groupBy("final").agg(F.min("key").alias("key"), F.first("group_kind").alias("group_kind"))
    made = kept(final.select("root", "final").join(made.select("final", minted(F.col("group_kind"), F.col("key")).alias("entity_id")), "final").drop("final"))
    none = F.lit(None).cast("array<string>")
    with_keys = keyed.join(made, "root").select("mention_id", "entity_id", F.lit("created").alias("method"), F.col("ambiguous_with"))
    bearers = names.join(made, "root").select("normalized_name", "group_kind", "entity_id").distinct()
    bare = new.where(F.size("identifiers") == 0).select("mention_id", "kind", "normalized_name", "ambiguous_with", "borne")
    fits = (F.col("b.normalized_name") == F.col("a.normalized_name")) & (~F.col("a.borne")) & (
        (F.col("b.group_kind") == F.col("a.kind")) | (F.col("b.group_kind") == "other")
    )
    met = bare.alias("a").join(bearers.alias("b"), fits).groupBy("a.mention_id").agg(F.sort_array(F.collect_set("b.entity_id")).alias("found"))
    told = bare.join(met, "mention_id", "left")
    one = F.size("found") == 1
    bare_told = told.select(
        "mention_id", F.when(one, F.col("found")[0]).otherwise(minted(F.col("kind"), F.col("normalized_name"))).alias("entity_id"),
        F.when(one, "alias").otherwise("created").alias("method"),
        F.coalesce("ambiguous_with", F.when(F.size("found") > 1, F.col("found")), none).alias("ambiguous_with")
    )
    return with_keys.unionByName(bare_told)


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, identifiers: DataFrame, survivors: DataFrame) -> DataFrame:
    """R2: ``mention_id, entity_id, method, ambiguous_with, error`` for every mention(mention_id, kind, name, normalized_name, identifiers).

    By identifier, else by alias, else created. A mention with a true column ``authoritative`` (false where there is
    none) has identifiers that define it: a miss makes a new entity, whatever the name. An identifier of an entity of
    another kind gives an error and no entity.

    The mentions of a batch are judged together, so their order does not matter. Those that share identifiers, also
    through others, are one thing: it is the stored entity that any of them leads to by identifier (the smallest of
    several, unless one of the mention's own identifiers leads to another), else the one that the first of them leads
    to by name, else one new entity, whose kind is the first that is known; a member of another kind gets an error.
    New entities bear their names for the rest of the batch, as _fresh() says. Ids of new entities are computed.
    """
    faces, keyed, of, many = _faces(mentions)
    if many:
        entities, aliases, identifiers = map(dealt, (entities, aliases, identifiers))
    known = by_identifier(faces, entities, identifiers, survivors)
    rest = faces.join(dealt(known.select("mention_id")), "mention_id", "left_anti")
    named = by_alias(rest.where(~F.col("sure")), aliases, entities, identifiers, survivors)
    named = named.select("mention_id", F.col("entity_id").alias("alias_id"), "ambiguous_with", F.lit(True).alias("borne"))
    state = faces.join(dealt(known.withColumn("known", F.lit(True))), "mention_id", "left").join(dealt(named), "mention_id", "left")
    state = kept(state.withColumns({"known": F.coalesce("known", F.lit(False)), "borne": F.coalesce("borne", F.lit(False))}))
    exact = state.where("known").select(
        "mention_id", "entity_id", F.when(F.col("error").isNull(), "identifier").alias("method"), "ambiguous_with", "error"
    )
    loose = _grouped(state.where("not known").drop("entity_id", "error"), state.where("entity_id is not null"), identifiers)
    anchor = F.coalesce("direct", "by_key", "by_name")
    kinds = entities.select(F.col("id").alias("anchor"), F.col("kind").alias("stored"))
    loose = kept(loose.withColumn("anchor", anchor).join(kinds, "anchor", "left"))
    wanted = F.coalesce("stored", "group_kind")
    fits = kinds_fit(wanted, F.col("kind"))
    own = F.col("alias_id").isNotNull() & (F.col("alias_id") == F.col("anchor"))
    first = F.element_at("identifiers", 1)
    said = F.concat(
        first["namespace"], F.lit(":"), first["value"], F.lit(" already identifies "), wanted,
        F.when(F.col("anchor").isNull(), "").otherwise(F.concat(F.lit(" "), "anchor")), F.lit(", not a "), "kind"
    )
    none = F.lit(None).cast("string")
    clash = loose.where(~fits & ~own).select("mention_id", none.alias("entity_id"), none.alias("method"), "ambiguous_with", said.alias("error"))
    fine = loose.where(fits | own)
    joined = fine.where("anchor is not null").select(
        "mention_id", F.col("anchor").alias("entity_id"),
        F.when(own & F.col("direct").isNull() & F.col("by_key").isNull(), "alias").otherwise("identifier").alias("method"),
        F.when(F.col("ambiguous_with").isNull(), F.lit(None).cast("array<string>")).alias("ambiguous_with"), none.alias("error")
    )
    made = _fresh(fine.where("anchor is null")).withColumn("error", none)
    told = exact.unionByName(clash).unionByName(joined).unionByName(made)
    told = told.join(dealt(keyed), "mention_id").drop("mention_id")
    return of.join(dealt(told), "key").select("mention_id", "entity_id", "method", "ambiguous_with", "error")


def recorded(
    resolved: DataFrame, mentions: DataFrame, aliases: DataFrame, identifiers: DataFrame, survivors: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aliases and identifiers to append, and identifiers that another entity owns, with their owner.

    A mention's name is recorded, and its other spellings (a column ``aliases``, where there is one). A new identifier
    that several entities of the batch want goes to the smallest of them, and is owned by it for the others.
    """
    mentions = _plain_namespaces(mentions)
    rows = cut(mentions.join(dealt(resolved.where("entity_id is not null").select("mention_id", "entity_id")), "mention_id"))
    if large(rows):
        rows, aliases, identifiers = map(dealt, (rows, aliases, identifiers))
    names = rows.select("entity_id", "name", "normalized_name")
    if "aliases" in mentions.columns:
        others = rows.select("entity_id", F.explode("aliases").alias("name"))
        names = names.unionByName(others.withColumn("normalized_name", text.normalize_name(F.col("name"))))
    names = names.where("normalized_name is not null").groupBy("entity_id", "normalized_name").agg(F.min("name").alias("name")).join(
        aliases.select("entity_id", "normalized_name"), ["entity_id", "normalized_name"], "left_anti"
    )
    ids = _asserted(rows, "entity_id").select("entity_id", "namespace", "value").distinct()
    owner = identifiers.select("namespace", "value", F.col("entity_id").alias("owner"))
    state = kept(followed(ids.join(owner, ["namespace", "value"], "left"), survivors, "owner", "end"))
    first = state.where("owner is null").groupBy("namespace", "value").agg(F.min("entity_id").alias("first"))
    late = state.where("owner is null").join(dealt(first), ["namespace", "value"]).where("entity_id <> first").select(
        "entity_id", "namespace", "value", F.col("first").alias("owner")
    )
    elsewhere = state.where("end <> entity_id").select("entity_id", "namespace", "value", "owner").unionByName(late)
    return names, first.select(F.col("first").alias("entity_id"), "namespace", "value"), elsewhere


def pollsters(names: DataFrame, aliases: DataFrame, survivors: DataFrame) -> DataFrame:
    """(name, entity_id) by slug of an alias, the smallest id of several, through redirects; null if unknown."""
    slugs = aliases.select(
        slug(F.col("name")).alias("slug"), "entity_id"
    ).where("slug is not null").groupBy("slug").agg(F.min("entity_id").alias("id"))
    found = names.select("name", slug(F.col("name")).alias("slug")).join(slugs, "slug", "left")
    return followed(found, survivors, "id", "entity_id").select("name", "entity_id")


def resolved_pollsters(
    names: DataFrame, entities: DataFrame, aliases: DataFrame, identifiers: DataFrame, survivors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``name, entity_id, created, lookalikes`` of every name, and aliases (entity_id, name, normalized_name) to record.

    By the slug of an organization's alias, else as any mention of an organization, names of one slug being one. A
    name that no slug knows lists the closest organizations (ids, best first); none of them is merged. The printed name
    is recorded, and for a new entity its slug, which the next spelling meets.
    """
    organizations = entities.where("kind = 'organization'")
    own = aliases.join(organizations.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    first = pollsters(names.select("name").distinct(), own, survivors)
    asked = cut(first.withColumn("slug", slug(F.col("name"))))
    unknown = asked.where("entity_id is null").groupBy(F.coalesce("slug", "name").alias("mention_id")).agg(F.min("name").alias("name"))
    none = F.array().cast("array<struct<namespace:string,value:string>>")
    mentions = unknown.select(
        "mention_id", F.lit("organization").alias("kind"), "name", text.normalize_name(F.col("name")).alias("normalized_name"), none.alias("identifiers")
    )
    found = resolve(mentions, entities, aliases, identifiers, survivors).select("mention_id", F.col("entity_id").alias("made"), "method")
    like = search.lookalikes(own, organizations, unknown.select(F.col("mention_id").alias("query")), "organization")
    like = like.groupBy(F.col("query").alias("mention_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity_id"))), lambda x: x["entity_id"]).alias("lookalikes"))
    told = asked.withColumn("mention_id", F.when(F.col("entity_id").isNull(), F.coalesce("slug", "name"))).join(found, "mention_id", "left").join(like, "mention_id", "left")
    told = cut(
        told.select(
            "name", F.coalesce("entity_id", "made").alias("entity_id"), F.coalesce(F.col("method") == "created", F.lit(False)).alias("created"),
            F.coalesce("lookalikes", F.array().cast("array<string>")).alias("lookalikes"), "slug"
        )
    )
    spelt = told.select("entity_id", "name").unionByName(told.where("created and slug is not null").select("entity_id", F.col("slug").alias("name")))
    spelt = spelt.distinct().withColumn("normalized_name", text.normalize_name(F.col("name"))).where("normalized_name is not null")
    spelt = spelt.groupBy("entity_id", "normalized_name").agg(F.min("name").alias("name"))
    return told.drop("slug"), spelt.join(aliases.select("entity_id", "normalized_name"), ["entity_id", "normalized_name"], "left_anti")


def namesakes(aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Names under which entities stay apart because their keys in one namespace differ: (name, namespace, entities)."""
    keyed = aliases.select("entity_id", "normalized_name").distinct().join(identifiers, "entity_id")
    return keyed.groupBy("normalized_name", "namespace").agg(
        F.count_distinct("value").alias("values"), F.count_distinct("entity_id").alias("entities")
    ).where("values > 1")


def kind_promotions(resolved: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """R2: entities stored as other of which a mention knows the kind; the first kind by name of several."""
    seen = mentions.join(resolved, "mention_id").where("kind <> 'other'").groupBy("entity_id").agg(F.min("kind").alias("new_kind"))
    return entities.where("kind = 'other'").join(seen, entities["id"] == seen["entity_id"]).select("id", "new_kind")


def first_mention(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an order column."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__k = 1").drop("__k")
