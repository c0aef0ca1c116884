"""DNS record expressions.

A record line is text built with ``concat_ws`` over coalesced fields; a null
payload prints ``None`` (the reference formats with ``%s``), so every field
is coalesced to that text first: ``concat_ws`` alone would skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Record types counted per record set, in output order.
COUNTED_TYPES = ("SOA", "NS", "A", "AAAA", "CNAME", "MX", "TXT", "SPF", "PTR",
                 "DNSKEY", "DS", "RRSIG", "CAA", "NSEC")

# Payload fields printed after ``owner TYPE`` for each layout.
LAYOUTS = {
    "NS": ("ns_address",),
    "AAAA": ("ip6_address",),
    "A": ("ip4_address",),
    "TXT": ("txt_text",),
    "SPF": ("spf_text",),
    "PTR": ("ptr_name",),
    "CNAME": ("cname_name",),
    "MX": ("mx_preference", "mx_address"),
    "DS": ("ds_key_tag", "ds_algorithm", "ds_digest_type", "ds_digest"),
    "DNSKEY": ("dnskey_flags", "dnskey_protocol", "dnskey_algorithm"),
    "CAA": ("caa_flags", "caa_tag", "caa_value"),
    "NSEC": ("nsec_next_domain_name", "nsec_owner_rrset_types"),
}
SOA_FIELDS = ("soa_mname", "soa_rname", "soa_serial", "soa_refresh", "soa_retry",
              "soa_expire", "soa_minimum")
RRSIG_HEAD = ("rrsig_type_covered", "rrsig_algorithm", "rrsig_labels", "rrsig_original_ttl")
RRSIG_TAIL = ("rrsig_signature_expiration", "rrsig_signature_inception", "rrsig_key_tag",
              "rrsig_signer_name", "rrsig_signature")


def text(c) -> Column:
    """Python ``'%s' % x`` of a column: ``None`` for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def _line(*parts) -> Column:
    return F.concat_ws(" ", *[text(p) for p in parts])


def _text_sql(x: str) -> str:
    return f"coalesce(CAST({x} AS STRING), 'None')"


def _line_sql(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(_text_sql(p) for p in parts) + ")"


def relative_owner_sql(resp: str, domain: str) -> str:
    """B3 as SQL text."""
    r = f"replace({resp}, concat({domain}, '.'), '')"
    r = f"(CASE WHEN endswith({r}, '.') THEN substr({r}, 1, char_length({r}) - 1) ELSE {r} END)"
    return f"(CASE WHEN instr({resp}, {domain}) > 0 THEN (CASE WHEN {r} = '' THEN '@' ELSE {r} END) " \
           f"ELSE {resp} END)"


def record_line_sql(domain: str = "domain") -> str:
    """B4 as one SQL expression (built once, parsed once by Spark)."""
    resp, rtype = "response_name", "response_type"
    owner = relative_owner_sql(resp, domain)
    branches = [f"WHEN {rtype} = 'SOA' THEN {_line_sql(resp, rtype, *SOA_FIELDS)}"]
    for rt, fields in LAYOUTS.items():
        branches.append(f"WHEN {rtype} = '{rt}' THEN {_line_sql(owner, rtype, *fields)}")
    rrsig = f"concat({_line_sql(owner, rtype, *RRSIG_HEAD)}, ' (', {_line_sql(*RRSIG_TAIL)}, ')')"
    branches.append(f"WHEN {rtype} = 'RRSIG' THEN {rrsig}")
    return (f"CASE WHEN {resp} IS NULL THEN NULL ELSE CASE " + " ".join(branches)
            + f" ELSE {_line_sql(resp, rtype)} END END")


def record_line(domain: str = "domain") -> Column:
    """One observation as a zone-file-like line; null when the answer
    has no ``response_name`` (artificial records such as NSHASH).

    ``domain`` names the column with the normalised query name (B1); it stays
    a column, because the expression reads it in every branch and would outgrow
    code generation otherwise.  The expression is generated as SQL text: one
    parse instead of hundreds of Column calls.
    """
    return F.expr(record_line_sql(domain))


def line_type(line) -> Column:
    """Second token of a record line: the type it is sorted and counted by."""
    line = F.col(line) if isinstance(line, str) else line
    return F.try_element_at(F.split(line, " "), F.lit(2))


def prune_falsy(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """JSON object of the row with falsy fields (null, '', 0) left out.

    ``to_json`` omits null fields, so each falsy value is mapped to null.
    Real zeros are dropped too, as in the reference (K17).
    """
    fields = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "string":
            c = F.when(c != "", c)
        elif kind in ("integer", "long", "short", "byte", "double", "float", "decimal"):
            c = F.when(c != 0, c)
        elif kind == "boolean":
            c = F.when(c, c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields))


def prune_null(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """B5 variant that keeps real zeros and empty strings."""
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns if n not in drop]))


def type_counts(records: str, mode: str = "strict") -> list[Column]:
    """Per-type record counts of a record set, in COUNTED_TYPES order.

    ``strict`` counts lines whose type token equals the type; ``text``
    counts `` T `` substrings of the ``;``-joined set, as the reference does
    (K7: a payload such as ``note A record`` also counts).
    """
    out = []
    if mode == "strict":
        for t in COUNTED_TYPES:
            out.append(F.expr(f"size(filter(`{records}`, r -> "
                              f"try_element_at(split(r, ' '), 2) = '{t}'))").alias(t))
    elif mode == "text":
        joined = f"array_join(`{records}`, ';')"
        for t in COUNTED_TYPES:
            pat = f" {t} "
            out.append(F.expr(f"CAST((char_length({joined}) - char_length(replace({joined}, '{pat}', ''))) "
                              f"div {len(pat)} AS INT)").alias(t))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out


def line_counts(line: str, mode: str = "strict") -> list[Column]:
    """B24 for one record line: what it adds to the count of each type.

    A set's ``text`` count is the sum over its lines: the set's lines are joined by
    ``;``, which no searched text holds, so no match reaches from one line to the next."""
    if mode == "strict":
        return [(line_type(line) == t).cast("int").alias(t) for t in COUNTED_TYPES]
    if mode != "text":
        raise ValueError(f"unknown mode {mode!r}")
    return [F.expr(f"CAST((char_length(`{line}`) - char_length(replace(`{line}`, ' {t} ', ''))) div {len(t) + 2} AS INT)").alias(t)
            for t in COUNTED_TYPES]


def short_line() -> Column:
    """Short display of an observation (type-specific payload for A,
    AAAA and CNAME, the name otherwise); a missing type gives fixed text."""
    resp = F.col("response_name")
    rtype = F.col("response_type")
    payload = (F.when(rtype == "A", F.col("ip4_address"))
               .when(rtype == "AAAA", F.col("ip6_address"))
               .when(rtype == "CNAME", F.col("cname_name"))
               .otherwise(resp))
    return (F.when(rtype.isNull() | (rtype == ""), F.lit("Unknown response type"))
            .otherwise(_line(resp, rtype, payload)))
