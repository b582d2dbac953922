"""Room names: SKU lookup and the two-rule classifier."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import bind, case, contains_any, strip, text


def sku(name, mapping=fv.ROOM_SKUS) -> Column:
    """Exact match on the trimmed name, else null. The map is a literal of fixed size."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.try_element_at(table, strip(text(name)))


def classify_room(name, property_id, detailed_properties=(), detail_source="deterministic") -> Column:
    """struct of code, tier, view, bedrooms, accessibility and penthouse variant.

    Properties in `detailed_properties` use the rules with named products; all others
    use the generic words.
    """
    low = F.lower(strip(text(name)))
    has = lambda *words: contains_any(low, words)
    ada = low.rlike("accessible|mobility|ada")

    def bedrooms(two, one):
        return case([(low.rlike(two), 2), (low.rlike(one), 1)], F.lit(None).cast("int"))

    def row(code, tier, view, beds, source, variant=None):
        return F.struct(
            code.alias("mapped_internal_code"), tier.alias("mapped_tier"), view.alias("mapped_view"),
            beds.alias("mapped_bedrooms"), ada.alias("mapped_ada"), F.lit(source).alias("mapping_source"),
            (F.lit(None).cast("string") if variant is None else variant).alias("penthouse_variant"),
        )

    any_beds = bedrooms(r"\b(two|2)[\s\-]*(bedroom|br)\b", r"\b(one|1)[\s\-]*(bedroom|br)\b")
    any_tier = case([
        (has("presidential", "penthouse"), "tier_5_penthouse"), (has("suite"), "tier_4_premier"),
        (has("view", "deluxe"), "tier_2_view"),
    ], "tier_1_entry")
    generic = row(
        F.concat(F.lit("CMP_"), F.coalesce(any_beds, F.lit(0)).cast("string"), F.lit("BR_"), any_tier),
        any_tier, F.when(has("view"), "view").otherwise("non_view"), any_beds, "heuristic_comp",
    )

    beds = bedrooms(r"\b(two|2)[\s\-]*bedroom|2 bedrooms", r"\b(one|1)[\s\-]*bedroom|1 bedroom")
    digit = beds.cast("string")
    upper_tier = F.when(beds == 1, "tier_1_entry").otherwise("tier_3_suite")
    view_tier = F.when(beds == 1, "tier_2_view").otherwise("tier_3_suite")
    named = (
        F.when(has("penthouse"), row(
            F.lit("PH"), F.lit("tier_5_penthouse"), F.lit("penthouse"), beds, detail_source,
            F.concat(digit, F.lit("BR"))))
        .when(has("terrace"), row(
            F.concat(F.lit("PTR"), F.coalesce(digit, F.lit(""))), F.lit("tier_4_premier"), F.lit("terrace"),
            beds, detail_source))
        .when(has("h street") & beds.isNotNull(), row(
            F.concat(digit, F.lit("BDPRC")), view_tier, F.lit("h_street"), beds, detail_source))
        .when(beds.isNotNull(), row(
            F.concat(digit, F.lit("BD")), upper_tier, F.lit("non_view"), beds, detail_source))
        .otherwise(row(
            F.lit("UNMAPPED"), F.lit("unknown"), F.lit("unknown"), F.lit(None).cast("int"), "none"))
    )
    if not detailed_properties:
        return generic
    return F.when(F.col(property_id).isin(*detailed_properties), named).otherwise(generic)


def missing_patterns(markdown, room_names) -> Column:
    """Labels whose heading is in the page but whose word is in no room name."""
    names = F.lower(F.array_join(F.transform(room_names, lambda n: F.coalesce(n, F.lit(""))), " "))
    return bind(F.lower(text(markdown)), lambda page: F.array_compact(F.array(*[
        F.when(page.rlike(heading) & ~names.rlike(word), F.lit(label))
        for label, heading, word in fv.VARIANCE_PATTERNS
    ])))
