"""TXT record expressions.

The taxonomy is a multi-label classification: a text gets every label one
of whose patterns matches at the start of the text.  Patterns that are a plain
beginning are compared as text; the others are matched with ``rlike`` (Java ``find``),
anchored with ``^(?:...)``, on texts of the right size only.  ``(?d)`` (UNIX_LINES)
makes ``.`` and ``$`` treat only ``\\n`` as a line end, as Python's ``re`` does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# TXT taxonomy, label -> patterns; "(?i)" marks case-insensitive
# patterns.  Matched at the start of the cleaned text.
TXT_TAXONOMY = {
    "mail-security.spf": [r"(?i)\\?v=spf[123]?.*", r"(?i)include:.*", r"spf1.*", r"spf2\.0.*"],
    "mail-security.dkim": [r"(?i)v=DKIM1.*"],
    "mail-security.dmarc": [r"(?i)v=DMARC1.*"],
    "domain-identifiers.google": [r"_?google-site-verification.*"],
    "domain-identifiers.ms": [r"(?i)MS.*", r".*onmicrosoft\.com$", r"v=msv1.*", r"v=verifydomain.*"],
    "domain-identifiers.amazon": [r"_?amazonses.*"],
    "domain-identifiers.yandex": [r"yandex-verification.*"],
    "domain-identifiers.mailru": [r"mailru.*"],
    "domain-identifiers.zoho": [r"zoho-verification.*"],
    "domain-identifiers.adobe": [r"adobe-idp-site-verification.*"],
    "domain-identifiers.sendinblue": [r"Sendinblue-code.*"],
    "domain-identifiers.loaderio": [r"loaderio.*"],
    "domain-identifiers.atlassian": [r"atlassian-domain-verification.*"],
    "domain-identifiers.citrix": [r"citrix.*"],
    "domain-identifiers.facebook": [r"facebook-domain-verification.*"],
    "domain-identifiers.pardot": [r"pardot_.*"],
    "domain-identifiers.status_page": [r"status-page-domain-verification.*"],
    "domain-identifiers.proofpoint": [r"ppe-.*"],
    "domain-identifiers.firebase": [r"firebase.*"],
    "domain-identifiers.dropbox": [r"dropbox-domain-verification.*"],
    "keys.base64_64bytes": [r"[A-z0-9+/]{86}==$"],
    "keys.base64_32bytes": [r"[A-z0-9+/]{43}=$"],
    "keys.hex_16bytes": [r"[A-Fa-f0-9]{32}$"],
    "keys.hex_32bytes": [r"[A-Fa-f0-9]{64}$"],
    "keys.hex_40_42": [r"[A-Fa-f0-9]{40,42}$"],
    "keys.hex_8-4-4-4-12": [
        r"[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}$"],
    "keys.dec_9_dec_678": [r"\d{9}-\d{6,8}$"],
    "keys.rsa": [r"k=rsa.*"],
    "keys.az_09_26": [r"[A-z0-9]{26}$"],
    "signature-services.docusign": [r"docusign.*"],
    "signature-services.globalsign": [r"_?globalsign-domain-verification.*"],
    "alias": [r"ALIAS for.*"],
    "i*m": [r"i=\d{3}&m.*"],
    "malt": [r"MAlt.*"],
    "number_pipe_site": [r"\d\|.*"],
}

# Words that flag a TXT text as possibly sensitive.
SENSITIVE_WORDS = ("login", "user", "password", "pswd", "private")


def _scoped(pattern: str) -> str:
    if pattern.startswith("(?i)"):
        return "(?i:" + pattern[4:] + ")"
    return "(?:" + pattern + ")"


def label_regex(label: str) -> str:
    """Java regex that is true when any pattern of ``label`` matches at the
    start of the text."""
    return "(?d)^(?:" + "|".join(_scoped(p) for p in TXT_TAXONOMY[label]) + ")"


def clean_txt(c, compat: bool = False) -> Column:
    """Remove double quotes and surrounding whitespace.

    A null text is empty; ``compat`` prints it as ``None`` first, as the
    reference's ``str(None)`` does (K11), so it then counts as non-empty.
    """
    c = F.col(c) if isinstance(c, str) else c
    if compat:
        c = F.coalesce(c, F.lit("None"))
    return F.regexp_replace(F.replace(c, F.lit('"'), F.lit("")), r"^\s+|\s+\z", "")


def is_correct_txt(rtype, text, compat: bool = False) -> Column:
    """TXT record whose cleaned text is non-empty."""
    rtype = F.col(rtype) if isinstance(rtype, str) else rtype
    cleaned = clean_txt(text, compat)
    return (rtype == "TXT") & F.coalesce(cleaned != "", F.lit(False))


def record_labels(rtype="response_type", text="txt_text", compat: bool = False) -> Column:
    """``dns`` always, ``txt`` for TXT records, ``correct_txt`` when the
    cleaned text is non-empty."""
    rt = F.col(rtype) if isinstance(rtype, str) else rtype
    arr = F.array(F.lit("dns"),
                  F.when(rt == "TXT", F.lit("txt")),
                  F.when(is_correct_txt(rt, text, compat), F.lit("correct_txt")))
    return F.filter(arr, lambda x: x.isNotNull())


#: What a text must have for the patterns that are no plain prefix: its
#: least and greatest size in bytes (a line end may follow), or a part of it.
SIZES = {"keys.base64_64bytes": (88, 88), "keys.base64_32bytes": (44, 44), "keys.hex_16bytes": (32, 32),
         "keys.hex_32bytes": (64, 64), "keys.hex_40_42": (40, 42), "keys.hex_8-4-4-4-12": (36, 36),
         "keys.dec_9_dec_678": (16, 18), "keys.az_09_26": (26, 26)}
PARTS = {"domain-identifiers.ms": "contains({c}, 'onmicrosoft.com')", "i*m": "startswith({c}, 'i=')",
         "number_pipe_site": "substr({c}, 2, 1) = '|'"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literal_prefixes(pattern: str) -> list[str] | None:
    """The texts of which one must begin a text that ``pattern`` matches, lower-cased if
    case does not count; None for a pattern that asks for more than a beginning."""
    body = pattern.removeprefix("(?i)")
    if not body.endswith(".*"):
        return None
    body = re.sub(r"\[[^]]*\]\?$", "", body[:-2])  # an optional last character says nothing
    starts = [""]
    for optional, text in (("_?", "_"), ("\\\\?", "\\")):
        if body.startswith(optional):
            starts, body = [text, ""], body[len(optional):]
    plain = body.replace("\\.", ".")
    if re.search(r"[\\\[\](){}*+?|^$]", plain):
        return None
    return [(s + plain).lower() if pattern.startswith("(?i)") else s + plain for s in starts]


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def label_condition_sql(label: str, c: str) -> str:
    """SQL: the text column ``c`` has ``label``.  Prefixes are compared as they are;
    regular expressions run only on texts that have what ``SIZES`` or ``PARTS`` ask for."""
    found, rest = [], []
    for pattern in TXT_TAXONOMY[label]:
        starts = literal_prefixes(pattern)
        if starts is None:
            rest.append(pattern)
            continue
        text = f"translate(substr({c}, 1, {max(map(len, starts))}), '{UPPER}', '{LOWER}')" if pattern.startswith("(?i)") else c
        found += [f"startswith({text}, {_quoted(s)})" for s in starts]
    if rest:
        lo, hi = SIZES.get(label, (0, 0))
        guard = f"octet_length({c}) BETWEEN {lo} AND {hi + 1}" if label in SIZES else PARTS[label].format(c=c)
        found.append(f"({guard} AND {c} RLIKE r'(?d)^(?:{'|'.join(_scoped(p) for p in rest)})')")
    return " OR ".join(found)


def txt_labels_sql(c: str) -> str:
    """B19 as one SQL expression over the text column ``c``: the labels, in the order of
    the taxonomy, put together as text by generated code and split only where there are any."""
    items = ", ".join(f"CASE WHEN {label_condition_sql(lbl, f'`{c}`')} THEN '{lbl}' END" for lbl in TXT_TAXONOMY)
    return f"(CASE WHEN `{c}` IS NULL THEN NULL ELSE filter(split(concat_ws(',', {items}), ','), x -> x <> '') END)"


def txt_labels(c: str) -> Column:
    """All taxonomy labels of a cleaned text column (may be empty)."""
    return F.expr(txt_labels_sql(c))


def sensitive_regex() -> str:
    return "(?i)(?:" + "|".join(SENSITIVE_WORDS) + ")"


def is_sensitive(c) -> Column:
    """Any sensitive word anywhere, case-insensitive."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(sensitive_regex())
