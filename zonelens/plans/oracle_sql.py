"""DuckDB fragments for the oracle queries.

Each oracle is written by a different route than the Spark expression it
checks (regex instead of prefix tests, ``string_split`` + GROUP BY for
entropy, two-pass central moments, substring-split counting, ...).  The
adapter views come first as a ``WITH`` prefix (``bindings.duckdb_prefix``).
"""

from __future__ import annotations

from zonelens.plans.bindings import duckdb_prefix


def N(x: str) -> str:
    """DuckDB text of a value as Python's ``%s`` prints it."""
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


OBS_KEYED = r"""
SELECT *, regexp_replace(regexp_replace(query_name, '^www\.', ''), '\.$', '') AS domain,
       strftime(make_timestamp(timestamp * 1000), '%Y%m%d') AS date
FROM observations
"""

OWNER = r"""
CASE WHEN contains(response_name, domain) THEN
  CASE WHEN regexp_replace(replace(response_name, domain || '.', ''), '\.$', '') = '' THEN '@'
       ELSE regexp_replace(replace(response_name, domain || '.', ''), '\.$', '') END
ELSE response_name END
"""

LINE = f"""
CASE WHEN response_name IS NULL THEN NULL
 WHEN response_type = 'SOA' THEN concat_ws(' ', response_name, 'SOA', {N('soa_mname')}, {N('soa_rname')},
      {N('soa_serial')}, {N('soa_refresh')}, {N('soa_retry')}, {N('soa_expire')}, {N('soa_minimum')})
 WHEN response_type = 'NS' THEN concat_ws(' ', owner, 'NS', {N('ns_address')})
 WHEN response_type = 'AAAA' THEN concat_ws(' ', owner, 'AAAA', {N('ip6_address')})
 WHEN response_type = 'A' THEN concat_ws(' ', owner, 'A', {N('ip4_address')})
 WHEN response_type = 'TXT' THEN concat_ws(' ', owner, 'TXT', {N('txt_text')})
 WHEN response_type = 'SPF' THEN concat_ws(' ', owner, 'SPF', {N('spf_text')})
 WHEN response_type = 'PTR' THEN concat_ws(' ', owner, 'PTR', {N('ptr_name')})
 WHEN response_type = 'CNAME' THEN concat_ws(' ', owner, 'CNAME', {N('cname_name')})
 WHEN response_type = 'MX' THEN concat_ws(' ', owner, 'MX', {N('mx_preference')}, {N('mx_address')})
 WHEN response_type = 'RRSIG' THEN concat_ws(' ', owner, 'RRSIG', {N('rrsig_type_covered')},
      {N('rrsig_algorithm')}, {N('rrsig_labels')}, {N('rrsig_original_ttl')}) || ' ('
      || concat_ws(' ', {N('rrsig_signature_expiration')}, {N('rrsig_signature_inception')},
         {N('rrsig_key_tag')}, {N('rrsig_signer_name')}, {N('rrsig_signature')}) || ')'
 WHEN response_type = 'DS' THEN concat_ws(' ', owner, 'DS', {N('ds_key_tag')}, {N('ds_algorithm')},
      {N('ds_digest_type')}, {N('ds_digest')})
 WHEN response_type = 'DNSKEY' THEN concat_ws(' ', owner, 'DNSKEY', {N('dnskey_flags')},
      {N('dnskey_protocol')}, {N('dnskey_algorithm')})
 WHEN response_type = 'CAA' THEN concat_ws(' ', owner, 'CAA', {N('caa_flags')}, {N('caa_tag')},
      {N('caa_value')})
 WHEN response_type = 'NSEC' THEN concat_ws(' ', owner, 'NSEC', {N('nsec_next_domain_name')},
      {N('nsec_owner_rrset_types')})
 ELSE concat_ws(' ', response_name, {N('response_type')}) END
"""

OBS_LINES = f"""
SELECT *, {LINE} AS line FROM (SELECT *, {OWNER} AS owner FROM obs_k)
"""

RANK_STATS = """
SELECT domain, count(rank) AS n, min(rank) AS mn, max(rank) AS mx, avg(rank) AS mean
FROM rankings GROUP BY domain
"""

# lower-cased name, tld after the last dot (null without a dot), rest before it
NAME_PARTS = r"""
SELECT domain, lower(domain) AS name,
       CASE WHEN lower(domain) LIKE '%.%' THEN regexp_extract(lower(domain), '([^.]*)$', 1) END AS tld,
       CASE WHEN lower(domain) LIKE '%.%' THEN regexp_extract(lower(domain), '^(.*)\.[^.]*$', 1)
            ELSE lower(domain) END AS rest
FROM {src}
"""


def entropy_cte(src: str, key: str, text: str) -> str:
    """Entropy by exploding characters and grouping (a different route)."""
    return f"""
SELECT s.{key} AS k, CASE WHEN length(s.{text}) = 0 THEN 0.0 ELSE
       (SELECT -sum((c.cnt / length(s.{text})) * log2(c.cnt / length(s.{text})))
        FROM (SELECT ch, count(*) AS cnt FROM unnest(string_split(s.{text}, '')) AS u(ch) GROUP BY ch) c)
       END AS entropy
FROM {src} s
"""


TXT_CLEAN = r"""regexp_replace(replace(txt_text, '"', ''), '^\s+|\s+$', '', 'g')"""

# The TXT taxonomy again, written as RE2 patterns for DuckDB.  They
# differ in spelling because RE2 searches: a trailing ".*" would say nothing.
TXT_RE2 = [
    ("mail-security.spf", r"^((?i:\\?v=spf[123]?)|(?i:include:)|spf1|spf2\.0)"),
    ("mail-security.dkim", r"^(?i:v=DKIM1)"),
    ("mail-security.dmarc", r"^(?i:v=DMARC1)"),
    ("domain-identifiers.google", r"^_?google-site-verification"),
    ("domain-identifiers.ms", r"^((?i:MS)|.*onmicrosoft\.com$|v=msv1|v=verifydomain)"),
    ("domain-identifiers.amazon", r"^_?amazonses"),
    ("domain-identifiers.yandex", r"^yandex-verification"),
    ("domain-identifiers.mailru", r"^mailru"),
    ("domain-identifiers.zoho", r"^zoho-verification"),
    ("domain-identifiers.adobe", r"^adobe-idp-site-verification"),
    ("domain-identifiers.sendinblue", r"^Sendinblue-code"),
    ("domain-identifiers.loaderio", r"^loaderio"),
    ("domain-identifiers.atlassian", r"^atlassian-domain-verification"),
    ("domain-identifiers.citrix", r"^citrix"),
    ("domain-identifiers.facebook", r"^facebook-domain-verification"),
    ("domain-identifiers.pardot", r"^pardot_"),
    ("domain-identifiers.status_page", r"^status-page-domain-verification"),
    ("domain-identifiers.proofpoint", r"^ppe-"),
    ("domain-identifiers.firebase", r"^firebase"),
    ("domain-identifiers.dropbox", r"^dropbox-domain-verification"),
    ("keys.base64_64bytes", r"^[A-z0-9+/]{86}==$"),
    ("keys.base64_32bytes", r"^[A-z0-9+/]{43}=$"),
    ("keys.hex_16bytes", r"^[A-Fa-f0-9]{32}$"),
    ("keys.hex_32bytes", r"^[A-Fa-f0-9]{64}$"),
    ("keys.hex_40_42", r"^[A-Fa-f0-9]{40,42}$"),
    ("keys.hex_8-4-4-4-12",
     r"^[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}$"),
    ("keys.dec_9_dec_678", r"^[0-9]{9}-[0-9]{6,8}$"),
    ("keys.rsa", r"^k=rsa"),
    ("keys.az_09_26", r"^[A-z0-9]{26}$"),
    ("signature-services.docusign", r"^docusign"),
    ("signature-services.globalsign", r"^_?globalsign-domain-verification"),
    ("alias", r"^ALIAS for"),
    ("i*m", r"^i=[0-9]{3}&m"),
    ("malt", r"^MAlt"),
    ("number_pipe_site", r"^[0-9]\|"),
]


def txt_labels_sql(text: str) -> str:
    """DuckDB list of labels of a text, in taxonomy order."""
    items = ", ".join(
        f"CASE WHEN regexp_matches({text}, '{pat}') THEN '{lbl}' END" for lbl, pat in TXT_RE2)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def bigint_counts(sql: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``: DuckDB's count_if is
    a HUGEINT, Spark's a BIGINT."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "count(*) FILTER (WHERE " + sql[j + len(key):k - 1] + ")")
        i = k


def oracle(final: str, **ctes: str) -> str:
    """Fixture prefix + extra CTEs + the final SELECT."""
    extra = "".join(f",\n{name} AS ({body})" for name, body in ctes.items())
    return bigint_counts(duckdb_prefix() + extra + "\n" + final)
