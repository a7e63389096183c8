"""Label taxonomies, BIO schemes and numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Harmonised label -> labels that map to it.
_LOCATION = "LOCATION ORGANIZATION HOSPITAL STREET CITY ZIP URL PROTECTED_ENTITY".split() + ["PROTECTED ENTITY", "LOCATION-OTHER"]
_NAME = "NAME PATIENT USERNAME RELATIVEPROXYNAME PTNAME PTNAMEINITIAL KEYVALUE".split()
_AGE = ["AGE", "AGE_>_89", "AGE > 89"]
_DATE = ["DATE", "DATEYEAR"]
_ID = "BIOID DEVICE HEALTHPLAN IDNUM MEDICALRECORD ID IDENTIFIER OTHER".split()
_CONTACT = "EMAIL FAX PHONE CONTACT IPADDR IPADDRESS".split()
_REST = ["DOCTOR", "HCPNAME", "PROFESSION", "STATE", "COUNTRY", "NATIONALITY"]
TAXONOMY = {
    "simple": {"NAME": [*_NAME, "DOCTOR", "HCPNAME"], "PROFESSION": ["PROFESSION"], "LOCATION": [*_LOCATION, "STATE", "COUNTRY", "NATIONALITY"], "AGE": _AGE, "DATE": _DATE, "ID": _ID, "CONTACT": _CONTACT, "O": ["O"]},
    "hipaa": {"NAME": _NAME, "LOCATION": _LOCATION, "AGE": _AGE, "DATE": _DATE, "ID": _ID, "CONTACT": _CONTACT, "O": [*_REST, "O"]},
    "binary": {"PHI": [*_NAME, *_LOCATION, *_AGE, *_DATE, *_ID, *_CONTACT, *_REST, "PHI"], "O": ["O"]},
}
FEATURE_LABELS = {"age": "AGE", "date": "DATE", "email": "CONTACT", "idnum": "ID", "initials": "NAME", "location": "LOCATION", "mrn": "ID", "name": "NAME", "pager": "ID", "ssn": "ID", "telephone": "CONTACT", "unit": "ID", "url": "CONTACT"}


def label_map(scheme: str) -> dict[str, str]:
    """Flat map label -> harmonised label; 'binary' also maps PHI to itself."""
    return {x: k for k, xs in TAXONOMY[scheme].items() for x in xs}


def map_label(c: Column, scheme: str, strict: bool = False) -> Column:
    """The harmonised label of `c` (upper-cased first); null for an unknown one, or an error if `strict`."""
    upper = F.upper(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in sorted(label_map(scheme).items()) for x in kv])
    found = F.try_element_at(table, upper)
    return F.when(found.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), upper))).otherwise(found) if strict else found


def coalesce_entity_type(entity_type: Column, annotator: Column | None = None, lowercase: bool = True) -> Column:
    """Name-like types as Name; a null type inferred from the annotator's name; Other for the rest."""
    c = F.when(entity_type.isin("initials", "firstname", "lastname"), "Name").otherwise(entity_type)
    if annotator is not None:
        guess = F.when(annotator.contains("wmrn"), "Identifier").when(annotator.contains("name") | annotator.contains("initials"), "Name")
        c = F.coalesce(c, guess)
    c = F.coalesce(c, F.lit("Other"))
    return F.lower(c) if lowercase else c


def softmax(logits: Column) -> Column:
    """Stable softmax of an array of scores. Maximum and sum are bound once, so the work is linear in the array."""
    top = F.transform(F.array(F.struct(logits.alias("v"), F.array_max(logits).alias("top"))), lambda b: F.transform(b["v"], lambda x: F.exp(x - b["top"])))
    return F.get(F.transform(F.transform(top, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("s"))), lambda b: F.transform(b["e"], lambda x: x / b["s"])), 0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def vocabulary(scheme: str, bio: bool = False) -> list[str]:
    """Labels in the order of their ids: O, then the harmonised labels by name; with `bio` all B- labels, then all I-."""
    names = sorted(k for k in TAXONOMY[scheme] if k != "O")
    return ["O", *names] if not bio else ["O", *[f"B-{n}" for n in names], *[f"I-{n}" for n in names]]


def label_id(c: Column, scheme: str, bio: bool = False) -> Column:
    """The id of a label of the vocabulary; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in vocabulary(scheme, bio)]), c), F.lit(0)) - 1


def first_argmax(scores: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(scores, F.array_max(scores)) - 1


def rates(tp: str, fp: str, fn: str) -> list[Column]:
    """se, ppv and f1; null where undefined, so that averages skip them."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [F.try_divide(t, t + n).alias("se"), F.try_divide(t, t + p).alias("ppv"), F.try_divide(2 * t, 2 * t + p + n).alias("f1")]
