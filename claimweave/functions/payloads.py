"""The payloads that predicates carry, read by contract with a verdict for each field (rows F31, Q7, H12).

The table is fixed values: for each predicate its fields, what they may hold and what stands for an absent one. A payload
is read as VARIANT in the JVM, and which contract applies is decided row by row, by the predicate.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from claimweave.functions import canon
from claimweave.functions.let import let


class Field(NamedTuple):
    """kind: integer, decimal, boolean, text or one of ``allowed``. Bounds are of the value, or of a text's length."""

    name: str
    kind: str
    nullable: bool = False
    default: str | None = None
    low: int | None = None
    high: int | None = None
    allowed: tuple[str, ...] = ()


def _one_of(name: str, *allowed: str, default: str | None = None) -> Field:
    return Field(name, "choice", default=default, allowed=allowed)


PAYLOADS: dict[str, tuple[Field, ...]] = {
    "event_kind": (_one_of("kind", "debate", "forum", "town_hall", "speech", "interview", "election", "other"),),
    "participated_in": (_one_of("role", "candidate", "moderator", "panelist", "host", "other"),),
    "endorsed": (_one_of("strength", "full", "qualified", "withdrawn", default="full"), Field("context", "text", True, high=500)),
    "donated_to": (
        Field("amount", "decimal", True, low=0), Field("currency", "text", default="USD", low=3, high=3),
        _one_of("kind", "contribution", "independent_expenditure", "in_kind", "loan", "other", default="contribution"),
        Field("supporting", "boolean", True), Field("purpose", "text", True, high=300)
    ),
    "contest_stage": (_one_of("stage", "primary", "runoff", "general", "special", "caucus"),),
    "contest_result": (
        Field("votes", "integer", True, low=0), Field("share", "decimal", True, low=0, high=100), Field("place", "integer", True, low=1),
        Field("won", "boolean", True)
    ),
    "assessed": (Field("rating", "text", low=1, high=100), Field("basis", "text", True, high=500)),
    "event_occurrence": (_one_of("status", "scheduled", "occurred", "postponed", "cancelled"),),
    "public_statement": (Field("topic", "text", low=1, high=500), Field("position", "text", low=1, high=2000), Field("summary", "text", True, high=5000)),
}
#: Texts that read as true and false, in any case.
YES, NO = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
SQL_TYPES = {"integer": "bigint", "decimal": "decimal(18,3)", "boolean": "boolean", "text": "string", "choice": "string"}


def _text(field: Field, kind: Column, raw: Column) -> Column:
    """The field's value as canonical text, null where its JSON type does not fit."""
    number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    trimmed = F.trim(raw)
    if field.kind == "integer":
        fits = trimmed.rlike(r"^[+-]?[0-9]{1,18}(\.0*)?$")
        whole = F.regexp_replace(F.regexp_replace(trimmed, r"\.0*$", ""), r"^\+", "").try_cast("bigint").cast("string")
        return F.when((number | (kind == "STRING")) & fits, whole).when(kind == "BOOLEAN", F.when(raw == "true", "1").otherwise("0"))
    if field.kind == "decimal":
        fits = trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$")
        return F.when((number | (kind == "STRING")) & fits, let(trimmed.try_cast("decimal(38,12)").cast("string"), canon.decimal))
    if field.kind == "boolean":
        said = F.lower(trimmed)
        plain = F.regexp_replace(said, r"\.0*$", "")
        return F.when(kind == "BOOLEAN", raw).when(number, F.when(plain == "1", "true").when(plain == "0", "false")).when(
            kind == "STRING", F.when(said.isin(*YES), "true").when(said.isin(*NO), "false")
        )
    return F.when(kind == "STRING", raw)


def _verdict(field: Field, kind: Column, text: Column) -> Column:
    """What is wrong with a field, null if nothing is."""
    size = F.length(text) if field.kind == "text" else text.try_cast("decimal(38,12)")
    out = F.when(kind.isNull(), F.lit(None) if field.nullable or field.default is not None else F.lit("is missing"))
    out = out.when(kind == "VOID", F.lit(None) if field.nullable else F.lit("is null"))
    out = out.when(text.isNull(), f"is no {'text' if field.kind == 'choice' else field.kind}")
    if field.allowed:
        out = out.when(~text.isin(*field.allowed), "is none of the allowed")
    if field.low is not None:
        out = out.when(size < field.low, f"is {'shorter' if field.kind == 'text' else 'less'} than {field.low}")
    if field.high is not None:
        out = out.when(size > field.high, f"is {'longer' if field.kind == 'text' else 'more'} than {field.high}")
    return out


def _judged(slug: str, value: Column) -> Column:
    """struct(errors, fields) of a JSON text under one predicate's contract."""
    fields = PAYLOADS[slug]
    ddl = "struct<errors:array<string>,fields:map<string,string>>"

    def read(v: Column) -> Column:
        parts = []
        for f in fields:
            kind = F.schema_of_variant(F.try_variant_get(v, f"$.{f.name}", "variant"))
            parts.append(F.struct(kind.alias("kind"), F.try_variant_get(v, f"$.{f.name}", "string").alias("raw")))
        return F.array(*parts)

    def said(parts: Column) -> Column:
        kinds = [parts[k]["kind"] for k in range(len(fields))]
        return F.array(*(F.struct(kind.alias("kind"), _text(f, kind, parts[k]["raw"]).alias("text")) for k, (f, kind) in enumerate(zip(fields, kinds))))

    def judge(parts: Column) -> Column:
        told = []
        for k, f in enumerate(fields):
            kind, text = parts[k]["kind"], parts[k]["text"]
            wrong = F.concat(F.lit(f"{f.name} "), _verdict(f, kind, text))
            default = F.lit(f.default) if f.default is not None else F.lit(None).cast("string")
            told.append(F.struct(wrong.alias("wrong"), F.when(kind.isNull(), default).otherwise(text).alias("text")))
        extra = F.array_except(F.json_object_keys(value), F.array(*(F.lit(f.name) for f in fields)))
        unknown = F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(" is unknown")))
        errors = F.filter(F.concat(*(F.array(t["wrong"]) for t in told), unknown), lambda e: e.isNotNull())
        return F.struct(errors.alias("errors"), F.map_from_arrays(F.array(*(F.lit(f.name) for f in fields)), F.array(*(t["text"] for t in told))).alias("fields"))

    no_object = F.struct(F.array(F.lit("the payload is no object")).alias("errors"), F.lit(None).cast("map<string,string>").alias("fields"))

    def whole(v: Column) -> Column:
        is_object = v.isNotNull() & value.rlike(r"^[ \t\n\r]*\{")
        return F.when(is_object, let(let(read(v), said), judge)).otherwise(no_object)

    return let(F.try_parse_json(value), whole).cast(ddl)


def judged(predicate: Column, value: Column, slugs: Iterable[str] = tuple(PAYLOADS)) -> Column:
    """struct(errors array<string>, fields map<string,string>): null for a null value and for predicates without a payload.

    ``slugs`` are the predicates that there can be; fewer make a smaller plan.

    A field of another type than its own, out of bounds, missing without a default or null where it may not be is an
    error, and so is an unknown field, a repeated one, and what is no JSON object. Numbers may be texts, and the other way
    round for nothing; ``fields`` has canonical texts, defaults included.
    """
    out = F.when(value.isNull(), F.lit(None).cast("struct<errors:array<string>,fields:map<string,string>>"))
    for slug in (s for s in slugs if s in PAYLOADS):
        out = out.when(predicate == slug, _judged(slug, value))
    return out


def typed(slug: str, fields: Column) -> Column:
    """The fields of one predicate's payload as a struct of their own types."""
    return F.when(fields.isNotNull(), F.struct(*(fields[f.name].try_cast(SQL_TYPES[f.kind]).alias(f.name) for f in PAYLOADS[slug])))
