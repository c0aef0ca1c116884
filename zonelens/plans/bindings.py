"""Adapter views: the reference's input shapes derived from the driver tables.

The driver ships no DNS data, so ranking lists, raw DNS observations,
polluted ranking text, per-day file listings and suffix rules are derived
from ``events`` and ``pages`` by the SQL below.  The same text runs in Spark
(``spark.sql`` with DataFrame arguments, no global temp views) and in DuckDB
(as a ``WITH`` prefix of every oracle query); only the epoch-millis
expression differs between the engines.

Everything here is declarative: Catalyst prunes the columns each operator
does not read, so an operator over ``observations`` that needs three fields
only scans ``event_id``/``ts``/``user_id`` plus ``pages.url``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonelens.session import prepare_workers

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()

# Epoch milliseconds of a zone-less timestamp, floor semantics in both
# engines (DuckDB's epoch_ms rounds, so it is not used).
MS_SPARK = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000"
MS_DUCKDB = "epoch_us(ts) // 1000"

# -- fixed fixture definitions (FIXTURES.md section 2) ----------------------

HITS_SQL = """
SELECT e.event_id, e.user_id, e.value, e.ts, CAST(e.ts AS DATE) AS day,
       regexp_extract(p.url, '^https?://([^/?#:]+)', 1) AS host
FROM (SELECT ev.event_id, ev.user_id, ev.value,
             ev.ts + CASE WHEN ev.user_id % 5 = 0 THEN INTERVAL '31' DAY WHEN ev.user_id % 7 = 0 THEN INTERVAL '60' DAY
                          ELSE INTERVAL '0' DAY END AS ts,
             ev.event_id % (SELECT COUNT(*) FROM {pages}) AS pid
      FROM {events} ev) e
JOIN {pages} p ON p.page_id = e.pid
"""

RANKINGS_SQL = """
SELECT day, domain, hits,
       CAST(ROW_NUMBER() OVER (PARTITION BY day ORDER BY hits DESC, domain) AS INT) AS rank
FROM (SELECT day, host AS domain, COUNT(*) AS hits FROM {hits} GROUP BY day, host) g
"""

OBSERVATIONS_SQL = """
SELECT event_id, day,
  CASE event_id % 6 WHEN 0 THEN 'NS' WHEN 1 THEN 'SOA' WHEN 2 THEN 'MX' WHEN 3 THEN 'A'
                    WHEN 4 THEN 'TXT' ELSE 'CNAME' END AS query_type,
  CASE WHEN event_id % 3 = 0 THEN 'www.' ELSE '' END || host || '.' AS query_name,
  CASE event_id % 17 WHEN 0 THEN 'SOA' WHEN 1 THEN 'NS' WHEN 2 THEN 'A' WHEN 3 THEN 'AAAA'
    WHEN 4 THEN 'CNAME' WHEN 5 THEN 'MX' WHEN 6 THEN 'TXT' WHEN 7 THEN 'SPF' WHEN 8 THEN 'PTR'
    WHEN 9 THEN 'DNSKEY' WHEN 10 THEN 'DS' WHEN 11 THEN 'RRSIG' WHEN 12 THEN 'CAA'
    WHEN 13 THEN 'NSEC' WHEN 14 THEN 'DNAME' WHEN 15 THEN 'TXT' ELSE 'NSHASH' END AS response_type,
  CASE WHEN event_id % 17 = 16 THEN NULL
       WHEN event_id % 5 = 0 THEN 'mail.' || host || '.'
       WHEN event_id % 5 = 1 THEN 'other.test.'
       ELSE host || '.' END AS response_name,
  {ms} AS timestamp,
  CAST(user_id % 8 AS INT) AS worker_id,
  CAST(event_id % 4 AS INT) AS status_code,
  CASE WHEN event_id % 17 = 2 THEN '10.0.' || CAST(user_id % 4 AS STRING) || '.'
       || CAST(event_id % 9 AS STRING) END AS ip4_address,
  CASE WHEN event_id % 17 = 3 THEN '2001:db8::' || CAST(user_id % 4 AS STRING) END AS ip6_address,
  CASE WHEN event_id % 17 = 4 THEN 'alias.' || host || '.' END AS cname_name,
  CASE WHEN event_id % 17 = 5 THEN CAST((user_id % 3) * 10 AS INT) END AS mx_preference,
  CASE WHEN event_id % 17 = 5 THEN 'mx.' || host || '.' END AS mx_address,
  CASE WHEN event_id % 17 = 1 THEN 'ns' || CAST(user_id % 4 AS STRING) || '.' || host || '.' END AS ns_address,
  CASE WHEN event_id % 17 IN (6, 15) THEN
    CASE user_id % 44 WHEN 0 THEN '"v=spf1 include:' || host || ' -all"'
      WHEN 1 THEN 'MS=ms' || CAST(user_id AS STRING)
      WHEN 2 THEN 'google-site-verification=' || host WHEN 3 THEN '""' WHEN 4 THEN NULL
      WHEN 5 THEN 'private Login ' || host WHEN 6 THEN 'ALIAS for ' || host WHEN 7 THEN md5(host)
      WHEN 8 THEN 'v=dkim1; k=rsa' WHEN 9 THEN '4|' || host WHEN 10 THEN 'note A record here'
      WHEN 11 THEN '  ' WHEN 12 THEN 'INCLUDE:' || host WHEN 13 THEN 'v=DMARC1; p=none'
      WHEN 14 THEN '_amazonses:' || host WHEN 15 THEN 'yandex-verification: 1'
      WHEN 16 THEN 'mailru-domain: ' || host WHEN 17 THEN 'zoho-verification=1'
      WHEN 18 THEN 'adobe-idp-site-verification=1' WHEN 19 THEN 'Sendinblue-code:1'
      WHEN 20 THEN 'loaderio=1' WHEN 21 THEN 'atlassian-domain-verification=1'
      WHEN 22 THEN 'citrix-verification=1' WHEN 23 THEN 'facebook-domain-verification=1'
      WHEN 24 THEN 'pardot_1' WHEN 25 THEN 'status-page-domain-verification=1' WHEN 26 THEN 'ppe-1'
      WHEN 27 THEN 'firebase=1' WHEN 28 THEN 'dropbox-domain-verification=1'
      WHEN 29 THEN repeat('Ab1+', 21) || 'Zz==' WHEN 30 THEN repeat('Ab1+', 10) || 'xyz='
      WHEN 31 THEN md5(host) || md5(host) WHEN 32 THEN md5(host) || substr(md5(host), 1, 8)
      WHEN 33 THEN '01234567-89ab-cdef-0123-456789abcdef' WHEN 34 THEN '123456789-1234567'
      WHEN 35 THEN 'k=rsa; p=1' WHEN 36 THEN 'abcdefghijklmnopqrstuvwxyz' WHEN 37 THEN 'docusign=1'
      WHEN 38 THEN '_globalsign-domain-verification=1' WHEN 39 THEN 'i=123&m=x' WHEN 40 THEN 'MAlt 1'
      WHEN 41 THEN 'my PASSWORD or pswd' WHEN 42 THEN 'a User of ' || host ELSE 'spf2.0/pra ' || host END END AS txt_text,
  CASE WHEN event_id % 17 = 7 THEN 'v=spf1 -all' END AS spf_text,
  CASE WHEN event_id % 17 = 8 THEN 'ptr.' || host || '.' END AS ptr_name,
  CASE WHEN event_id % 17 = 9 THEN CAST(256 + user_id % 2 AS INT) END AS dnskey_flags,
  CASE WHEN event_id % 17 = 9 THEN 3 END AS dnskey_protocol,
  CASE WHEN event_id % 17 = 9 THEN CAST(5 + user_id % 4 AS INT) END AS dnskey_algorithm,
  CASE WHEN event_id % 17 = 10 THEN CAST(user_id AS INT) END AS ds_key_tag,
  CASE WHEN event_id % 17 = 10 THEN 8 END AS ds_algorithm,
  CASE WHEN event_id % 17 = 10 THEN 2 END AS ds_digest_type,
  CASE WHEN event_id % 17 = 10 THEN md5(host) END AS ds_digest,
  CASE WHEN event_id % 17 = 11 THEN CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'NS' END END AS rrsig_type_covered,
  CASE WHEN event_id % 17 = 11 THEN 8 END AS rrsig_algorithm,
  CASE WHEN event_id % 17 = 11 THEN 2 END AS rrsig_labels,
  CASE WHEN event_id % 17 = 11 THEN CAST(3600 AS BIGINT) END AS rrsig_original_ttl,
  CASE WHEN event_id % 17 = 11 THEN event_id END AS rrsig_signature_inception,
  CASE WHEN event_id % 17 = 11 THEN event_id + 1000 END AS rrsig_signature_expiration,
  CASE WHEN event_id % 17 = 11 THEN CAST(user_id AS INT) END AS rrsig_key_tag,
  CASE WHEN event_id % 17 = 11 THEN host || '.' END AS rrsig_signer_name,
  CASE WHEN event_id % 17 = 11 THEN md5(host) END AS rrsig_signature,
  CASE WHEN event_id % 17 = 12 THEN 0 END AS caa_flags,
  CASE WHEN event_id % 17 = 12 THEN 'issue' END AS caa_tag,
  CASE WHEN event_id % 17 = 12 THEN 'ca.' || host END AS caa_value,
  CASE WHEN event_id % 17 = 13 THEN 'next.' || host || '.' END AS nsec_next_domain_name,
  CASE WHEN event_id % 17 = 13 THEN 'A NS SOA MX' END AS nsec_owner_rrset_types,
  CASE WHEN event_id % 17 = 0 THEN 'ns1.' || host || '.' END AS soa_mname,
  CASE WHEN event_id % 17 = 0 THEN 'admin.' || host || '.' END AS soa_rname,
  CASE WHEN event_id % 17 = 0 THEN 2024010100 + event_id % 7 END AS soa_serial,
  CASE WHEN event_id % 17 = 0 THEN 60000 + (event_id * 7919) % 60001 END AS soa_refresh,
  CASE WHEN event_id % 17 = 0 THEN (event_id * 104729) % 14401 END AS soa_retry,
  CASE WHEN event_id % 17 = 0 THEN 2400000 + (event_id * 7919) % 1500001 END AS soa_expire,
  CASE WHEN event_id % 17 = 0 THEN 100000 + (event_id * 104729) % 150001 END AS soa_minimum
FROM {hits}
"""

RANK_LINES_SQL = """
SELECT 'Rank_' || CAST(day AS STRING) || '.csv.gz' AS file_name,
       CASE WHEN rank = 1 THEN repeat('x', 120) || '1' ELSE CAST(rank AS STRING) END
       || ',' || domain AS line
FROM {rankings}
UNION ALL
SELECT DISTINCT 'Rank_' || CAST(day AS STRING) || '.csv.gz' AS file_name,
       'no comma here' AS line
FROM {rankings}
UNION ALL
SELECT DISTINCT 'Rank_' || CAST(day AS STRING) || '.csv.gz' AS file_name,
       'n/a,bad-rank.example.com' AS line
FROM {rankings}
"""

# Many more names than the hosts of pages: every word of documents as a label.
DOC_NAMES_SQL = """
SELECT DISTINCT word || '.' || lang || '.example.com' AS domain
FROM (SELECT {words} AS word, lang FROM {documents}) w
"""
WORDS_SPARK = "explode(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+', 0))"
WORDS_DUCKDB = "unnest(regexp_extract_all(lower(text), '[a-z][a-z][a-z]+'))"

DAY_FILES_SQL = """
SELECT DISTINCT day, 'part-' || CAST(event_id % 11 AS STRING) AS file_name FROM {hits}
WHERE event_id % 11 < 12 - EXTRACT(day FROM day) % 4 AND EXTRACT(day FROM day) % 10 <> 0
"""

SUFFIX_RULES_SQL = """
SELECT * FROM (VALUES ('com'), ('net'), ('org'), ('example.org'), ('*.example.net'),
                      ('!ththth.example.net'), ('co.uk')) AS t(rule)
"""

# Extra literal hosts (IDN, IP, single label, upper case, trailing dot) that
# the generated pages never contain; appended by UNION ALL where an operator
# needs them.
EXTRA_HOSTS_SQL = """
SELECT * FROM (VALUES ('xn--bcher-kva.example'), ('xn--caf-dma.com'), ('192.168.0.1'),
                      ('256.1.1.1'), ('localhost'), ('WWW.Example.ORG.'), (' a.b.example.net x'),
                      ('ththth.example.net'), ('foo.bar.example.net'), ('shop.co.uk'),
                      ('co.uk'), ('unknown.zz'), ('')) AS t(host)
"""

# View name -> (SQL text, views it reads), in dependency order.
VIEWS = {
    "hits": (HITS_SQL, ("events", "pages")),
    "rankings": (RANKINGS_SQL, ("hits",)),
    "observations": (OBSERVATIONS_SQL, ("hits",)),
    "rank_lines": (RANK_LINES_SQL, ("rankings",)),
    "day_files": (DAY_FILES_SQL, ("hits",)),
    "doc_names": (DOC_NAMES_SQL, ("documents",)),
    "suffix_rules": (SUFFIX_RULES_SQL, ()),
    "extra_hosts": (EXTRA_HOSTS_SQL, ()),
}


class Fixture:
    """Lazy DataFrames for the driver tables and the adapter views of one
    scale-factor folder.  Nothing is registered globally."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        prepare_workers(spark)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                text, deps = VIEWS[name]
                args = {d: self.table(d) for d in deps}
                if name == "observations":
                    text = text.replace("{ms}", MS_SPARK)
                if name == "doc_names":
                    text = text.replace("{words}", WORDS_SPARK)
                self._cache[name] = self.spark.sql(text, **args)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def duckdb_prefix() -> str:
    """``WITH`` clause defining every adapter view for the DuckDB oracle."""
    parts = []
    for name, (text, _deps) in VIEWS.items():
        body = text.replace("{ms}", MS_DUCKDB).replace("{words}", WORDS_DUCKDB)
        for dep in ("events", "pages", "documents", "hits", "rankings"):
            body = body.replace("{%s}" % dep, dep)
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
