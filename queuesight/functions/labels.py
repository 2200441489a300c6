"""Expressions on labels and label -> probability maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_exact, round_scaled


def map_label(c: Column, mapping: Mapping[str, str]) -> Column:
    """Renamed label; labels the mapping does not name pass through."""
    if not mapping:
        return c
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(pairs[c], c)


def correct_flag(true: Column, predicted: Column) -> Column:
    return true.eqNullSafe(predicted).cast("int")


def _keyed(probabilities: Column) -> Column:
    """Entries as (negative probability, label): their natural order is the ranking."""
    return F.transform(
        F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("key"), e["key"].alias("label"))
    )


def ranked_probabilities(probabilities: Column) -> Column:
    """Array of (label, probability), most probable first, ties by label."""
    return F.transform(
        F.array_sort(_keyed(probabilities)),
        lambda e: F.struct(e["label"].alias("label"), (-e["key"]).alias("probability")),
    )


def best_label(probabilities: Column) -> Column:
    """The first of `ranked_probabilities` as (key, label), without a sort; key is the
    negative probability."""
    return F.array_min(_keyed(probabilities))


def top_probabilities(probabilities: Column, k: int = 3) -> Column:
    return F.slice(ranked_probabilities(probabilities), 1, k)


def top_margin(ranked: Column, digits: int = 4) -> Column:
    """First minus second probability; a missing second counts as 0, a missing first too."""
    first = F.coalesce(F.get(ranked, F.lit(0))["probability"], F.lit(0.0))
    second = F.coalesce(F.get(ranked, F.lit(1))["probability"], F.lit(0.0))
    return round_exact(first - second, digits)


def ranked_columns(probabilities: Column, k: int = 3, digits: int = 4) -> list[Column]:
    """Flat columns of a prediction file: top_<i>_label, top_<i>_probability and the margin.

    The probabilities are rounded first; the margin is taken between the rounded ones.
    """
    ranked = ranked_probabilities(probabilities)
    columns, shown = [], []
    for i in range(k):
        entry = F.get(ranked, F.lit(i))
        shown.append(round_exact(entry["probability"], digits))
        columns += [entry["label"].alias(f"top_{i + 1}_label"), shown[i].alias(f"top_{i + 1}_probability")]
    if k > 1:
        columns.append(round_scaled(shown[0] - shown[1], digits).alias("top1_top2_margin"))
    return columns


def complete_probabilities(probabilities: Column, labels: Sequence[str], digits: int = 6) -> Column:
    """Map over exactly the given labels; a label without a probability gets 0."""
    return F.create_map(
        *[x for label in labels for x in (F.lit(label), label_probability(probabilities, label, digits))]
    )


def label_probability(probabilities: Column, label: str, digits: int = 6) -> Column:
    return round_exact(F.coalesce(probabilities[label], F.lit(0.0)), digits)


def probability_columns(probabilities: Column, labels: Sequence[str], digits: int = 6) -> list[Column]:
    """One `prob_<label>` column per label."""
    return [label_probability(probabilities, label, digits).alias(f"prob_{label}") for label in labels]


def valid_probabilities(probabilities: Column, labels: Sequence[str]) -> Column:
    """True when the map holds exactly the labels and every value lies in [0, 1]."""
    expected = F.array(*[F.lit(x) for x in sorted(labels)])
    same = F.array_sort(F.map_keys(probabilities)) == expected
    inside = F.forall(F.map_values(probabilities), lambda v: v.isNotNull() & (v >= 0.0) & (v <= 1.0))
    return F.coalesce(same & inside, F.lit(False))
