"""Canonical encodings and content addresses (rows F4-F13, S18, H14, H21)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, functions as F

#: The claim's fingerprint covers these, in sorted order.
CLAIM_KEYS = (
    "object_id", "predicate_version_id", "subject_id", "target_kind", "valid_at", "valid_at_precision", "valid_from", "valid_from_precision",
    "valid_to", "valid_to_precision", "value"
)


def decimal(text: Column) -> Column:
    """fixed notation without trailing zeros, so 12.50 equals 12.5; text that is no number gives null."""
    plain = F.regexp_replace(F.regexp_replace(text.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text.cast("string").rlike(r"^-?[0-9]+(\.[0-9]*)?$"), F.regexp_replace(plain, r"^-0\z", "0"))


def instant(ts: Column) -> Column:
    """A timestamp in UTC as ISO text: microseconds only where there are any."""
    base, micro = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, ".SSSSSS")
    return F.concat(base, F.when(micro == ".000000", "").otherwise(micro), F.lit("+00:00"))


def json_text(value: Column) -> Column:
    """A string as a JSON string, null as null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def canonical_object(**fields: Column) -> Column:
    """a JSON object with sorted keys and no blanks. Fields are JSON texts already."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_json(text: Column) -> Column:
    """any JSON text with sorted keys at every depth, no blanks, decimals without trailing zeros; null for what is no JSON.

    The JVM's VARIANT keeps an object's keys in order (of UTF-16 units) and a decimal in its shortest form. It writes
    escapes of control characters in capitals; here they are in small letters. A repeated key is no JSON.
    """
    out = F.to_json(F.try_parse_json(text))
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):  # an escape follows an even number of backslashes
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return out


def sha256(text: Column) -> Column:
    """hex SHA-256 of a text's UTF-8 or of bytes."""
    return F.sha2(text, 256)


def idempotency_key(operation: str, **parts: Column) -> Column:
    """``operation:sha256(parts)``."""
    if not operation.strip():
        raise ValueError("an operation needs a name")
    return F.concat(F.lit(operation + ":"), sha256(canonical_object(**{k: json_text(v.cast("string")) for k, v in parts.items()})))


def claim_fingerprint(**fields: Column) -> Column:
    """F8: hash of the claim's eleven fields. ``value`` is canonical JSON text, the others strings; all may be null."""
    if set(fields) != set(CLAIM_KEYS):
        raise ValueError(f"a fingerprint needs exactly {CLAIM_KEYS}")
    return sha256(canonical_object(**{k: v if k == "value" else json_text(v) for k, v in fields.items()}))


def anchor_fingerprint(snapshot: Column, locator: Column, excerpt: Column) -> Column:
    """hash of snapshot, canonical locator and excerpt."""
    return sha256(canonical_object(source_snapshot_id=json_text(snapshot), locator=locator, excerpt=json_text(excerpt)))


def poll_hash(payload: Column) -> Column:
    """hash of a poll's canonical payload, which must not hold the source's address."""
    return sha256(payload)


def locator(kind: Column, payload: Column) -> Column:
    """canonical locator JSON by kind, null where it breaks that kind's rules."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    page, end = F.try_to_number(get("page_start"), F.lit("999999")), F.try_to_number(get("page_end"), F.lit("999999"))
    start, stop = decimal(get("start")), decimal(get("end"))
    pointer, css, fragment = get("json_pointer"), get("css_selector"), get("text_fragment")
    return (
        F.when(kind == "full_source", canonical_object(kind=json_text(kind)))
        .when((kind == "json") & pointer.rlike(r"^(/.*)?$"), canonical_object(kind=json_text(kind), json_pointer=json_text(pointer)))
        .when((kind == "web") & (css.isNotNull() | fragment.isNotNull()), canonical_object(kind=json_text(kind), css_selector=json_text(css), text_fragment=json_text(fragment)))
        .when((kind == "video") & (start.cast("double") >= 0) & (stop.isNull() | (stop.cast("double") >= start.cast("double"))), canonical_object(kind=json_text(kind), start=json_text(start), end=json_text(stop)))
        .when((kind == "pdf") & (page >= 1) & (end.isNull() | (end >= page)), canonical_object(kind=json_text(kind), page_start=page.cast("string"), page_end=end.cast("string")))
    )


def uuid5(space: uuid.UUID, name: Column) -> Column:
    """name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12)
    )


def content_key(digest: Column) -> Column:
    """Place of an object in the store; null for what is no digest."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest))


def parse_uri(uri: Column, scheme: str) -> Column:
    """The key in a store address, null for another scheme."""
    return F.when(uri.startswith(f"{scheme}://"), F.regexp_extract(uri, "(sha256/[0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]{64})$", 1))
