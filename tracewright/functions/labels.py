"""Label lists and label vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_LIST = "array<string>"


def normalize_label(label: Column) -> Column:
    return F.btrim(F.lower(F.replace(label, F.lit("-"), F.lit("_"))))


def labels_from_json(text: Column) -> Column:
    """Distinct normalised labels of a JSON list or scalar; malformed text gives an empty list.

    Most lines carry the text of an empty list, which needs no parsing.
    """
    parsed = F.coalesce(
        F.from_json(text, LABEL_LIST),
        F.from_json(F.concat(F.lit("["), text, F.lit("]")), LABEL_LIST),
        F.array().cast(LABEL_LIST),
    )
    return F.when(text == "[]", F.array().cast(LABEL_LIST)).otherwise(clean_labels(parsed))


def clean_labels(labels: Column) -> Column:
    kept = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.transform(kept, normalize_label))


def labels_to_json(labels: Column) -> Column:
    return F.to_json(labels)


def label_vector(labels: Column, classes: Column) -> Column:
    """One bit per class, in class order."""
    bits = F.transform(classes, lambda c: F.array_contains(labels, c).cast("tinyint"))
    return F.coalesce(bits, F.array().cast("array<tinyint>"))


def has_any_bit(vector: Column) -> Column:
    return F.exists(vector, lambda bit: bit == 1).cast("int")


def display_label(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, "Attack").otherwise("Normal")


def label_combination(labels: Column) -> Column:
    joined = F.array_join(F.array_sort(labels), ", ")
    return F.when(F.size(labels) > 0, joined).otherwise("normal")


def single_class(vector: Column, literal: bool = False) -> Column:
    """Position of the first largest entry; an all-zero vector is -1 (normal), or 0 when ``literal``."""
    first = (F.array_position(vector, F.array_max(vector)) - 1).cast("int")
    if literal:
        return first
    return F.when(F.array_max(vector) > 0, first).otherwise(F.lit(-1))


def one_hot(index: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == index).cast("tinyint"))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / either)


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(F.lower(text), F.lit(term))
    return found
