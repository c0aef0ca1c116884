"""Domain-name expressions.

Every function takes and returns a ``Column`` built from
``pyspark.sql.functions``: all of it stays inside whole-stage codegen, no
Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic top-level domains counted as gTLD by the feature job.
GTLDS = ("com", "org", "net", "edu", "gov")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_last_char_if(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.char_length(c) - len(suffix))).otherwise(c)


def normalise_domain(c) -> Column:
    """B1: strip one leading ``www.`` and then one trailing dot; case kept."""
    c = _col(c)
    no_www = F.when(c.startswith("www."), c.substr(F.lit(5), F.char_length(c))).otherwise(c)
    return drop_last_char_if(no_www, ".")


def day_key(ms) -> Column:
    """B2: epoch milliseconds -> ``yyyyMMdd`` of the UTC day.

    Pure date arithmetic, so the result does not depend on the session zone.
    """
    days = F.floor(_col(ms) / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyyMMdd")


def relative_owner(resp, domain) -> Column:
    """Owner name relative to the zone.

    If ``resp`` contains the domain, every ``domain.`` occurrence is removed,
    then one trailing dot; an empty result is the apex ``@``.
    """
    resp, domain = _col(resp), _col(domain)
    stripped = drop_last_char_if(F.replace(resp, F.concat(domain, F.lit(".")), F.lit("")), ".")
    rel = F.when(stripped == "", F.lit("@")).otherwise(stripped)
    return F.when(F.instr(resp, domain) > 0, rel).otherwise(resp)


def split_name(c, compat: bool = False) -> Column:
    """Lower-cased name split at the last dot -> struct(name, tld, rest).

    Without a dot the tld is null and the rest is the whole name; with
    ``compat`` the tld is the whole name and the rest loses its last
    character, as the reference's ``rfind`` arithmetic does.
    """
    name = F.lower(_col(c))
    has_dot = F.instr(name, ".") > 0
    after = F.substring_index(name, ".", -1)
    rest_len = F.char_length(name) - F.char_length(after) - 1
    before = name.substr(F.lit(1), rest_len)
    if compat:
        tld = F.when(has_dot, after).otherwise(name)
        rest = F.when(has_dot, before).otherwise(name.substr(F.lit(1), F.char_length(name) - 1))
    else:
        tld = F.when(has_dot, after)
        rest = F.when(has_dot, before).otherwise(name)
    return F.struct(name.alias("name"), tld.alias("tld"), rest.alias("rest"))


def name_length(c) -> Column:
    """Length in characters."""
    return F.char_length(_col(c))


def count_matches(c, pattern: str) -> Column:
    """B9 helper: number of non-overlapping matches of a regex."""
    return F.regexp_count(_col(c), F.lit(pattern))


def dot_count(c) -> Column:
    return count_matches(c, "[.]")


def digit_count(c) -> Column:
    return count_matches(c, "[0-9]")


def vowel_count(c) -> Column:
    return count_matches(c, "[aeiou]")


def length_per_count(length, n) -> Column:
    """The reference's "ratio": length divided by a count, 0 when none."""
    length, n = _col(length), _col(n)
    return F.when(n == 0, F.lit(0.0)).otherwise(length.cast("double") / n.cast("double"))


def entropy(c) -> Column:
    """Shannon entropy in bits over the characters of a string.

    For each distinct character the count is the length drop when it is
    removed; ``aggregate`` folds -p*log2(p).  Empty string -> 0.0.
    """
    s = _col(c)
    n = F.char_length(s).cast("double")
    chars = F.array_distinct(F.split(s, ""))
    probs = F.transform(chars, lambda ch: (n - F.char_length(F.replace(s, ch, F.lit("")))) / n)
    h = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(s.isNull(), None).when(n == 0, F.lit(0.0)).otherwise(h)


def entropy_ideal(n) -> Column:
    """Entropy of a string of n distinct characters (log2 n); null for 0."""
    n = _col(n)
    return F.when(n > 0, F.log2(n.cast("double")))


def is_gtld(tld, tlds=GTLDS) -> Column:
    """1 when the tld is one of the generic ones, else 0."""
    return F.coalesce(_col(tld).isin(list(tlds)), F.lit(False)).cast("int")


def truncate_rank(c) -> Column:
    """B14 helper: ``int(float(x))`` truncation of an average rank."""
    return _col(c).cast("double").cast("int")


def not_idn(c) -> Column:
    """True for names that are not IDN (``xn--`` prefix of the whole name)."""
    return ~_col(c).startswith("xn--")


def without_keyword(c, word: str) -> Column:
    """True for names not containing ``word`` (case-sensitive)."""
    return ~F.contains(_col(c), F.lit(word))


def round2(c) -> Column:
    """Round half to even at 2 digits, like numpy's ``round``."""
    return F.rint(_col(c) * 100.0) / 100.0


def to_day(c) -> Column:
    """``yyyyMMdd`` text -> DATE (null when invalid)."""
    return F.try_to_date(_col(c), "yyyyMMdd")


def normalise_host(c) -> Column:
    """Trim, strip dots, first whitespace token, lower case."""
    s = F.regexp_replace(_col(c), r"^\s+|\s+\z", "")
    s = F.regexp_replace(s, r"^\.+|\.+\z", "")
    s = F.regexp_replace(s, r"^\s+", "")
    return F.lower(F.split(s, r"\s+").getItem(0))


def is_ipv4(c) -> Column:
    """Dotted quad with four decimal octets 0..255."""
    parts = F.split(_col(c), "[.]")
    octet_ok = F.forall(
        parts, lambda p: p.rlike(r"^[0-9]+\z") & F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    return (F.size(parts) == 4) & octet_ok
