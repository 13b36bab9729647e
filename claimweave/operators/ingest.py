"""Recording claims from sources, a batch at a time (rows R8-R19, I1-I16, F30-F31, H12-H16, H46-H49)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.functions import canon, payloads
from claimweave.functions.let import let


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one per key, of keys that are not stored; null keys count as equal."""
    one = rows.dropDuplicates(keys)
    known = stored.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return one.join(known, on, "left_anti")


#: How finely a time is known.
PRECISIONS = ("year", "month", "day", "hour", "minute", "second", "exact")
TIMES = ("valid_at", "valid_from", "valid_to")


def validity(
    at: Column | None = None, since: Column | None = None, until: Column | None = None, at_precision: Column | None = None,
    since_precision: Column | None = None, until_precision: Column | None = None
) -> Column:
    """struct of valid_at, valid_from and valid_to, each with its precision.

    An end has its beginning's precision unless it is given one; a time that is null has none.
    """
    given = ((at, at_precision), (since, since_precision), (until, until_precision if until_precision is not None else since_precision))
    out = []
    for name, (time, fine) in zip(TIMES, given):
        out.append((F.lit(None).cast("timestamp") if time is None else time).alias(name))
        known = F.lit(None).cast("string") if time is None or fine is None else F.when(time.isNotNull(), fine)
        out.append(known.alias(f"{name}_precision"))
    return F.struct(*out)


def shape_errors(claims: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, error) of claims that break their predicate's contract: target, payload, time.

    Where claims have columns of precisions, a time and its precision come together, and the precision is a known one.
    """
    spec = catalogue.select(F.col("slug").alias("predicate"), "target", "time")
    joined = claims.join(F.broadcast(spec), "predicate", "left")  # the catalogue is a constant
    timed = F.col("valid_at").isNotNull() | F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    fine = []
    for c in (t for t in TIMES if f"{t}_precision" in claims.columns):
        p = F.col(f"{c}_precision")
        fine.append(F.when(F.col(c).isNotNull() & p.isNull(), f"{c} has no precision"))
        fine.append(F.when(F.col(c).isNull() & p.isNotNull(), f"a precision without {c}"))
        fine.append(F.when(~p.isin(*PRECISIONS), f"{c} has an unknown precision"))
    wrong = F.concat_ws(
        "; ",
        F.when(F.col("target").isNull(), "unknown predicate"),
        F.when((F.col("target") == "value") & F.col("object_id").isNotNull(), "a value claim has an object"),
        F.when(F.col("target").isin("entity", "qualified") & F.col("object_id").isNull(), "no object"),
        F.when((F.col("target") == "entity") & F.col("value").isNotNull(), "an entity claim has a value"),
        F.when(F.col("target").isin("value", "qualified") & F.col("value").isNull(), "no value"),
        F.when((F.col("time") == "timeless") & timed, "a timeless claim has a time"),
        F.when((F.col("time") == "required") & ~timed, "no time"),
        F.when(F.col("valid_at").isNotNull() & (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()), "a point and an interval"),
        F.when(F.col("valid_to") <= F.col("valid_from"), "ends before it begins"), *fine
    )
    return joined.select("id", wrong.alias("error")).where("error <> ''")


def ontology(claims: DataFrame, entities: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, violation): ends that do not exist or are of kinds outside the predicate's domain or range.

    Nothing is dropped, a claim of an unknown predicate neither; null is aligned.
    """
    kind = lambda p: entities.select(F.col("id").alias(f"{p}_id"), F.col("kind").alias(f"{p}_kind"))
    spec = catalogue.select(F.col("slug").alias("predicate"), "subjects", "objects")
    # Claims without an object are dealt by their id: nulls would all meet in one task.
    held = claims.join(kind("subject"), "subject_id", "left").withColumn("__object", F.coalesce("object_id", F.concat(F.lit("\x1f"), "id")))
    joined = held.join(kind("object").withColumnRenamed("object_id", "__object"), "__object", "left").join(F.broadcast(spec), "predicate", "left")

    def end(p: str, allowed: str) -> Column:
        missing = F.col(f"{p}_id").isNotNull() & F.col(f"{p}_kind").isNull()
        return F.when(missing, F.concat(F.lit(f"{p} "), F.col(f"{p}_id"), F.lit(" does not exist"))).when(
            ~F.array_contains(allowed, F.col(f"{p}_kind")), F.concat(F.lit(f"{p} is "), F.col(f"{p}_kind"))
        )

    said = F.concat_ws("; ", F.when(F.col("subjects").isNull(), "unknown predicate"), end("subject", "subjects"), end("object", "objects"))
    return joined.select("id", F.nullif(said, F.lit("")).alias("violation"))


def fingerprinted(claims: DataFrame) -> DataFrame:
    """Claims with their fingerprint: of both ends, the canonical payload, and each time with its precision.

    Without columns of precisions times are known to the day.
    """

    def fine(c: str) -> Column:
        return F.col(f"{c}_precision") if f"{c}_precision" in claims.columns else F.when(F.col(c).isNotNull(), F.lit("day"))

    target = F.when(F.col("object_id").isNull(), "value").when(F.col("value").isNull(), "entity").otherwise("qualified")
    return claims.withColumn(
        "fingerprint",
        canon.claim_fingerprint(
            object_id=F.col("object_id"), predicate_version_id=F.col("predicate"), subject_id=F.col("subject_id"), target_kind=target,
            valid_at=canon.instant(F.col("valid_at")), valid_at_precision=fine("valid_at"), valid_from=canon.instant(F.col("valid_from")),
            valid_from_precision=fine("valid_from"), valid_to=canon.instant(F.col("valid_to")), valid_to_precision=fine("valid_to"),
            value=F.coalesce(canon.canonical_json(F.col("value")), F.col("value"))
        )
    )


def outcomes(staged: DataFrame, claims: DataFrame, assertions: DataFrame) -> DataFrame:
    """staged(idempotency_key, fingerprint) with ``outcome``: unchanged, corroborated or created.

    A key that was seen is unchanged; else a fingerprint that was seen, before or earlier in this batch (by key), is
    corroborated; else the claim is created.
    """
    seen_keys = assertions.select("idempotency_key").distinct().withColumn("k", F.lit(True))
    seen_prints = claims.select("fingerprint").distinct().withColumn("f", F.lit(True))
    one = staged.dropDuplicates(["idempotency_key"]).join(seen_keys, "idempotency_key", "left").join(seen_prints, "fingerprint", "left")
    first = one.where("k is null").groupBy("fingerprint").agg(F.min("idempotency_key").alias("first"))
    told = one.join(first, "fingerprint", "left")
    return told.withColumn(
        "outcome",
        F.when(F.col("k"), "unchanged").when(F.col("f") | (F.col("idempotency_key") != F.col("first")), "corroborated").otherwise("created")
    ).drop("k", "f", "first")


def sequenced(rows: DataFrame, key: str, top: DataFrame, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``seq``, going on from ``top(top)`` without gaps, in order of (bucket of the key, key).

    Rows are numbered within buckets; only the buckets' sizes, a bounded table, are summed up in one place.
    """
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("n"))
    before = sizes.select(
        "__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    k = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return dealt.withColumn("__k", k).join(before, "__b").join(top).withColumn(
        "seq", F.col("top") + F.col("__before") + F.col("__k")
    ).drop("__b", "__before", "__k", "top")


def appended(told: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and assertions to append; seq goes on from the highest."""
    top = assertions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    numbered = sequenced(told.where("outcome <> 'unchanged'"), "idempotency_key", top)
    return told.where("outcome = 'created'").select("fingerprint"), numbered.select("seq", "idempotency_key", "fingerprint")


def review_tasks(assertions: DataFrame) -> DataFrame:
    """A review task for every assertion outside the ontology."""
    return assertions.where("not aligned").select(
        F.col("seq").alias("assertion_seq"), F.lit("pending").alias("status"), F.lit(50).alias("priority"), F.col("violation").alias("reason")
    )


def observed(contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contents(source, content) -> sources, artifacts by digest, snapshots (source, digest)."""
    hashed = contents.select(
        "source", canon.sha256(F.coalesce("content", F.lit(""))).alias("sha256"),
        F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("byte_length")
    )
    return hashed.select("source").distinct(), hashed.groupBy("sha256").agg(
        F.max("byte_length").alias("byte_length"), F.count("*").alias("copies")
    ), hashed.select("source", "sha256").distinct()


def snapshot_reuse(inputs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A run's earliest snapshot of an artifact, else the one just retrieved."""
    prior = inputs.groupBy("run_id", "sha256").agg(F.min_by("snapshot_id", "retrieved_at").alias("prior"))
    return retrieved.join(prior, ["run_id", "sha256"], "left").select(
        "run_id", "sha256", F.coalesce("prior", "snapshot_id").alias("snapshot_id"), F.col("prior").isNotNull().alias("reused")
    )


def supersede(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Supersessions to append, by a key of both ends; who and why are required and no claim supersedes itself."""
    fine = links.where("predecessor_id <> successor_id and coalesce(trim(created_by), '') <> '' and coalesce(trim(reason), '') <> ''")
    keyed = fine.withColumn(
        "idempotency_key", canon.idempotency_key("supersede", predecessor=F.col("predecessor_id"), successor=F.col("successor_id"))
    )
    return absent(keyed, stored, ["idempotency_key"])


def derive(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Lineage of artifacts, by (parent, derived, kind)."""
    return absent(edges, stored, ["parent_id", "derived_id", "kind"])


def _claim(slug: str, subject: str, obj: str | None = None, value: Column | None = None, when: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(slug).alias("predicate"), F.col(subject).alias("subject_id"), (F.col(obj) if obj else none).alias("object_id"),
        (none if value is None else value).alias("value"),
        *(((validity() if when is None else when)[c]).alias(c) for t in TIMES for c in (t, f"{t}_precision"))
    )


def _emitted(records: DataFrame, *claims: Column) -> DataFrame:
    """The claims of every record, those with a null predicate or subject, or a null object that was named, left out."""
    each = claims[0] if len(claims) == 1 else F.explode(F.array(*claims))
    return records.select("record_id", each.alias("c")).select("record_id", "c.*").where("predicate is not null and subject_id is not null")


def _fine(records: DataFrame, column: str, within: Column | None = None) -> Column:
    """How finely a record's time is known: its own column, the day where it has none or a null."""
    if within is not None:
        return F.coalesce(within, F.lit("day"))
    return F.coalesce(F.col(column), F.lit("day")) if column in records.columns else F.lit("day")


def _if(condition: Column, claim: Column) -> Column:
    return F.when(condition, claim)


def candidacies(records: DataFrame) -> DataFrame:
    """records(record_id, candidate_id, contest_id, stints ARRAY<STRUCT<entered, left>>), a claim per stint.

    A stint may say how finely its ends are known: entered_precision, left_precision.
    """
    stints = records.select("record_id", "candidate_id", "contest_id", F.explode_outer("stints").alias("s"))
    held = stints.schema["s"].dataType.names
    of = lambda c: _fine(stints, c, F.col(f"s.{c}") if c in held else None)
    when = validity(since=F.col("s.entered"), until=F.col("s.left"), since_precision=of("entered_precision"), until_precision=of("left_precision"))
    return _emitted(stints, _claim("candidate_in", "candidate_id", "contest_id", when=when))


def overlapping_stints(records: DataFrame) -> DataFrame:
    """Records whose dated stints overlap, in order of entry; an open stint overlaps any later one."""
    s = records.select("record_id", F.explode("stints").alias("s")).where("s.entered is not null")
    far = F.max(F.coalesce("s.left", F.lit("9999-12-31").cast("timestamp"))).over(
        Window.partitionBy("record_id").orderBy("s.entered").rowsBetween(Window.unboundedPreceding, -1)
    )
    return s.withColumn("before", far).where("s.entered < before").select("record_id").distinct()


def endorsements(records: DataFrame) -> DataFrame:
    """records(record_id, endorser_id, endorsee_id, strength, context, announced, ended)."""
    value = canon.canonical_object(strength=canon.json_text(F.coalesce("strength", F.lit("full"))), context=canon.json_text(F.col("context")))
    when = validity(
        since=F.col("announced"), until=F.col("ended"), since_precision=_fine(records, "announced_precision"),
        until_precision=_fine(records, "ended_precision")
    )
    return _emitted(records, _claim("endorsed", "endorser_id", "endorsee_id", value, when))


def donations(records: DataFrame) -> DataFrame:
    """records(record_id, donor_id, recipient_id, amount, currency, kind, supporting, purpose, given)."""
    value = canon.canonical_object(
        amount=canon.json_text(canon.decimal(F.col("amount"))), currency=canon.json_text(F.coalesce("currency", F.lit("USD"))),
        kind=canon.json_text(F.coalesce("kind", F.lit("contribution"))), supporting=F.col("supporting").cast("string"),
        purpose=canon.json_text(F.col("purpose"))
    )
    when = validity(at=F.col("given"), at_precision=_fine(records, "given_precision"))
    return _emitted(records, _claim("donated_to", "donor_id", "recipient_id", value, when))


def race_structures(records: DataFrame) -> DataFrame:
    """records(record_id, contest_id, stage, jurisdiction_id, office_id, election_id, party_id, next_id)."""
    stage = canon.canonical_object(stage=canon.json_text(F.col("stage")))
    links = (
        ("contest_in_jurisdiction", "jurisdiction_id"), ("contest_for_office", "office_id"), ("contest_of_election", "election_id"),
        ("contest_party", "party_id"), ("advances_to", "next_id")
    )
    return _emitted(
        records, _claim("contest_stage", "contest_id", value=stage), *(_if(F.col(c).isNotNull(), _claim(s, "contest_id", c)) for s, c in links)
    )


def debates(records: DataFrame) -> DataFrame:
    """records(record_id, event_id, status, starts, ends, participants ARRAY<STRUCT<id, role>>, contest_id, jurisdiction_id)."""
    when = validity(
        since=F.col("starts"), until=F.col("ends"), since_precision=_fine(records, "starts_precision"), until_precision=_fine(records, "ends_precision")
    )
    kind, status = canon.canonical_object(kind=F.lit('"debate"')), canon.canonical_object(status=canon.json_text(F.col("status")))
    own = _emitted(
        records, _claim("event_kind", "event_id", value=kind),
        _claim("event_occurrence", "event_id", value=status, when=when),
        _if(F.col("contest_id").isNotNull(), _claim("event_about_contest", "event_id", "contest_id")),
        _if(F.col("jurisdiction_id").isNotNull(), _claim("event_in_jurisdiction", "event_id", "jurisdiction_id"))
    )
    who = records.select("record_id", "event_id", F.explode("participants").alias("p")).select(
        "record_id", "event_id", F.col("p.id").alias("who"), F.col("p.role").alias("role")
    )
    return own.unionByName(_emitted(who, _claim("participated_in", "who", "event_id", canon.canonical_object(role=canon.json_text(F.col("role"))))))


def results(records: DataFrame) -> DataFrame:
    """records(record_id, candidate_id, contest_id, votes, share, won); won stays null if unsaid."""
    value = canon.canonical_object(
        votes=F.col("votes").cast("string"), share=canon.json_text(canon.decimal(F.col("share"))), place=F.lit(None).cast("string"),
        won=F.col("won").cast("string")
    )
    return _emitted(records, _claim("contest_result", "candidate_id", "contest_id", value))


def federal_candidacies(records: DataFrame) -> DataFrame:
    """records(record_id, candidate_id, contest_id, party_id)."""
    return _emitted(
        records, _claim("candidate_in", "candidate_id", "contest_id"),
        _if(F.col("party_id").isNotNull(), _claim("party_affiliation", "candidate_id", "party_id"))
    )


#: What each record type becomes.
INGESTORS = {
    "candidacy": candidacies, "endorsement": endorsements, "donation": donations, "race_structure": race_structures, "debate": debates,
    "contest_result": results, "federal_candidacy": federal_candidacies
}


def ingestor(record_type: str):
    """An unknown type raises KeyError."""
    return INGESTORS[record_type]


#: The predicates with a payload that a type of record gives.
EMITS = {
    "endorsement": ("endorsed",), "donation": ("donated_to",), "race_structure": ("contest_stage",), "contest_result": ("contest_result",),
    "debate": ("event_kind", "event_occurrence", "participated_in")
}
#: Times of a record that name an event's day, so that nothing coarser will do.
DATED = {"debate": ("starts",)}


def judged_records(records: DataFrame, record_type: str) -> tuple[DataFrame, DataFrame]:
    """(claims of the records that are right, ``record_id, error`` of the others), without the caller naming errors.

    A record fails as a whole, and alone: for stints that overlap, a time that is too coarse to know the event by, a
    claim that ends before it begins, or a payload that breaks its predicate's contract. A record of an unknown type
    fails, too; one without claims is right.
    """
    if record_type not in INGESTORS:
        none = F.lit(None).cast("string")
        empty = records.limit(0).select(F.col("record_id"), *(none.alias(c) for c in ("predicate", "subject_id", "object_id", "value")))
        times = {n: none.cast(t) for c in TIMES for n, t in ((c, "timestamp"), (f"{c}_precision", "string"))}
        return empty.withColumns(times), verdicts(records, record_type)
    errors = verdicts(records, record_type).where("error is not null")
    return INGESTORS[record_type](records).join(errors.select("record_id"), "record_id", "left_anti"), errors


def verdicts(records: DataFrame, record_type: str) -> DataFrame:
    """``record_id, error`` of every record that makes claims or is wrong, as judged_records() finds it; null if it is right."""
    if record_type not in INGESTORS:
        return records.select("record_id", F.concat(F.lit("unknown type "), F.lit(record_type)).alias("error")).distinct()
    claims = INGESTORS[record_type](records)
    payload = payloads.judged(F.col("predicate"), F.col("value"), EMITS.get(record_type, ()))
    said = let(payload["errors"], lambda e: F.when(F.size(e) > 0, F.concat("predicate", F.lit(": "), F.array_join(e, ", "))))
    wrong = F.coalesce(F.when(F.col("valid_to") <= F.col("valid_from"), "ends before it begins"), said)
    # Those that are right stay, or each would be judged once to be left out and once to be told.
    found = [claims.select("record_id", wrong.alias("error"))]
    if record_type == "candidacy":
        found.append(overlapping_stints(records).select("record_id", F.lit("stints overlap").alias("error")))
    for c in (c for c in DATED.get(record_type, ()) if f"{c}_precision" in records.columns):
        coarse = records.where(F.col(f"{c}_precision").isin("year", "month"))
        found.append(coarse.select("record_id", F.concat(F.lit(f"{c} is known to the "), f"{c}_precision", F.lit(" only")).alias("error")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # Dealt first: the smallest of texts is found by sorting, which would hold a whole split of the input.
    return every.repartition("record_id").groupBy("record_id").agg(F.min("error").alias("error"))


def written_readings(polls: DataFrame) -> DataFrame:
    """polls(revision_id, samples ARRAY<STRUCT<population, sample_size, readings ARRAY<STRUCT<label, percentage>>>>), a row per reading with both positions."""
    s = polls.select("revision_id", F.size("samples").alias("n"), F.posexplode("samples").alias("sample", "s"))
    r = s.select("revision_id", "n", "sample", "s", F.posexplode("s.readings").alias("position", "r"))
    return r.select(
        "revision_id", "sample", F.when(F.col("n") == 1, "overall").otherwise(F.col("s.population")).alias("label"), "s.population", "s.sample_size",
        "position", F.col("r.label").alias("option"), "r.percentage"
    )


def near_duplicates(revisions: DataFrame, days: int = 3) -> DataFrame:
    """I8: pairs of polls of one contest and pollster whose fieldwork ended at most ``days`` apart.

    An equi-join on a bucket of days: each row looks into its own bucket and the neighbours', never at all others.
    """
    width = days + 1
    bucket = F.floor(F.datediff("ended", F.lit("1970-01-01").cast("date")) / width)
    left = revisions.where("ended is not null").select(
        "contest_id", "pollster_id", F.col("revision_id").alias("a"), F.col("ended").alias("a_ended"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    )
    right = revisions.where("ended is not null").select(
        "contest_id", "pollster_id", F.col("revision_id").alias("b"), F.col("ended").alias("b_ended"), bucket.alias("bucket")
    )
    return left.join(right, ["contest_id", "pollster_id", "bucket"]).where(
        (F.col("a") < F.col("b")) & (F.abs(F.datediff("a_ended", "b_ended")) <= days)
    ).select("contest_id", "pollster_id", "a", "b")


def concerns(revisions: DataFrame, near: DataFrame, lookalikes: DataFrame, stored: DataFrame) -> DataFrame:
    """I8: (revision_id, concern) of polls without an end, with a near duplicate, with a lookalike pollster, or of which
    ``stored`` (poll_id) has another reading already."""
    undated = revisions.where("ended is null").select("revision_id", F.lit("no end of fieldwork").alias("concern"))
    ends = near.select(F.explode(F.array("a", "b")).alias("revision_id")).distinct().withColumn("concern", F.lit("near duplicate"))
    like = revisions.join(
        lookalikes.select("pollster_id").distinct(), "pollster_id", "left_semi"
    ).select("revision_id", F.lit("lookalike pollster").alias("concern"))
    prior = revisions.join(stored.select("poll_id").distinct(), "poll_id", "left_semi").select(
        "revision_id", F.lit("another reading of this poll exists").alias("concern")
    )
    return undated.unionByName(ends).unionByName(like).unionByName(prior)


def import_report(rows: DataFrame, told: DataFrame) -> DataFrame:
    """One row: rows imported and failed, claims by outcome."""
    a = rows.agg(F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    b = told.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "corroborated", "unchanged")))
    return a.join(b)


def rewritten(cells: DataFrame, rewrites: DataFrame, parser) -> DataFrame:
    """cells(id, text) parsed; what is refused gets one rewrite (text, better), which the same parser must take."""
    first = cells.withColumn("p", parser(F.col("text")))
    again = first.join(rewrites, "text", "left").withColumn("q", parser(F.col("better")))
    retried = F.col("p.refused") & F.col("better").isNotNull() & ~F.col("q.refused")
    return again.select("id", "text", F.when(retried, F.col("q")).otherwise(F.col("p")).alias("parsed"), retried.alias("rewritten"))
