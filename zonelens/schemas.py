"""Schemas of the reference's data sets, as Spark DDL.

Fixed values: the 101 fields of one DNS answer, in file order (62 string,
30 int, 9 bigint).  Spark file sources read every field as nullable; the
five header fields (query_type, query_name, timestamp, worker_id,
status_code) are required by the data, which ``check_required`` verifies.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

OBSERVATION_DDL = """
query_type string, query_name string, response_type string, response_name string,
timestamp bigint, worker_id int, status_code int, ip4_address string, ip6_address string,
country string, `as` string, as_full string, cname_name string, dname_name string,
mx_address string, mx_preference int, mxset_hash_algorithm string, mxset_hash string,
ns_address string, nsset_hash_algorithm string, nsset_hash string, txt_text string,
txt_hash_algorithm string, txt_hash string, ds_key_tag int, ds_algorithm int,
ds_digest_type int, ds_digest string, dnskey_flags int, dnskey_protocol int,
dnskey_algorithm int, dnskey_pk_rsa_n string, dnskey_pk_rsa_e string,
dnskey_pk_rsa_bitsize int, dnskey_pk_eccgost_x string, dnskey_pk_eccgost_y string,
dnskey_pk_dsa_t string, dnskey_pk_dsa_q string, dnskey_pk_dsa_p string,
dnskey_pk_dsa_g string, dnskey_pk_dsa_y string, dnskey_pk_eddsa_a string,
dnskey_pk_wire string, nsec_next_domain_name string, nsec_owner_rrset_types string,
nsec3_hash_algorithm int, nsec3_flags int, nsec3_iterations int, nsec3_salt string,
nsec3_next_domain_name_hash string, nsec3_owner_rrset_types string,
nsec3param_hash_algorithm int, nsec3param_flags int, nsec3param_iterations int,
nsec3param_salt string, spf_text string, spf_hash_algorithm string, spf_hash string,
soa_mname string, soa_rname string, soa_serial bigint, soa_refresh bigint,
soa_retry bigint, soa_expire bigint, soa_minimum bigint, rrsig_type_covered string,
rrsig_algorithm int, rrsig_labels int, rrsig_original_ttl bigint,
rrsig_signature_inception bigint, rrsig_signature_expiration bigint, rrsig_key_tag int,
rrsig_signer_name string, rrsig_signature string, cds_key_tag int, cds_algorithm int,
cds_digest_type int, cds_digest string, cdnskey_flags int, cdnskey_protocol int,
cdnskey_algorithm int, cdnskey_pk_rsa_n string, cdnskey_pk_rsa_e string,
cdnskey_pk_rsa_bitsize int, cdnskey_pk_eccgost_x string, cdnskey_pk_eccgost_y string,
cdnskey_pk_dsa_t string, cdnskey_pk_dsa_q string, cdnskey_pk_dsa_p string,
cdnskey_pk_dsa_g string, cdnskey_pk_dsa_y string, cdnskey_pk_eddsa_a string,
cdnskey_pk_wire string, caa_flags int, caa_tag string, caa_value string, tlsa_usage int,
tlsa_selector int, tlsa_matchtype int, tlsa_certdata string, ptr_name string
"""

REQUIRED_FIELDS = ("query_type", "query_name", "timestamp", "worker_id", "status_code")

RECORDS_DDL = "domain string, date string, records array<string>"

RANK_AGGREGATE_DDL = ("domain string, count int, min_rank int, max_rank int, avg_rank double, "
                      "stddev_rank double, variance_rank double, skewness_rank double, "
                      "kurtosis_rank double")

DAY_FEATURE_COLUMNS = ("domain", "alexa_rank", "records_count", "SOA", "NS", "A", "AAAA",
                       "CNAME", "MX", "TXT", "SPF", "PTR", "DNSKEY", "DS", "RRSIG", "CAA", "NSEC")


def observation_schema() -> StructType:
    return StructType.fromDDL(OBSERVATION_DDL)


def ddl_schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def pad_to_observation_schema(df):
    """Add the observation fields a DataFrame lacks as typed nulls (its own
    columns are kept as they are)."""
    from pyspark.sql import functions as F
    have = set(df.columns)
    extra = [F.lit(None).cast(f.dataType).alias(f.name)
             for f in observation_schema().fields if f.name not in have]
    return df.select("*", *extra)
