"""Classification and scores of places, as expressions over a name and a map of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as v
from .text import any_of, bound, js_round, weight

REASON = "struct<label:string,points:double>"


def tag(tags: Column, key: str) -> Column:
    """A tag's value; empty where the map or the key is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def has(tags: Column, *keys: str) -> Column:
    """Whether one of the tags is there and not empty."""
    out = F.lit(False)
    for k in keys:
        out = out | (tag(tags, k) != "")
    return out


def set_tags(tags: Column, keys: list[str]) -> Column:
    """The keys whose value is neither empty nor "no", in the given order."""
    return F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: ~F.coalesce(F.try_element_at(tags, k), F.lit("")).isin("", "no"))


def classify(tags: Column, name: Column) -> Column:
    """bar, restaurant, other, coffee or bakery; bar words win, and count inside of words."""
    n, amenity, cuisine, shop = F.lower(F.coalesce(name, F.lit(""))), F.lower(tag(tags, "amenity")), F.lower(tag(tags, "cuisine")), F.lower(tag(tags, "shop"))
    all_ = F.concat_ws(" ", n, amenity, cuisine, shop)
    signal = any_of(n, v.TYPE_COFFEE) | any_of(cuisine, v.TYPE_COFFEE)
    return (
        F.when(any_of(all_, v.TYPE_BAR), "bar").when(any_of(all_, v.TYPE_RESTAURANT), "restaurant").when(any_of(all_, v.TYPE_OTHER) & ~signal, "other")
        .when(amenity.isin("cafe", "coffee") | (shop == "coffee") | signal, "coffee")
        .when((amenity == "bakery") | (shop == "bakery") | any_of(n, ["bakery", "boulangerie", "bäckerei"]), "bakery").otherwise("other")
    )


def confidence(tags: Column) -> Column:
    """How much is known, from 0 to 100."""
    yes = lambda c, p: F.when(c, F.lit(float(p))).otherwise(F.lit(0.0))
    total = yes(has(tags, "phone", "contact:phone", "contact:mobile"), 10) + yes(has(tags, "website", "contact:website"), 10) + yes(has(tags, "email", "contact:email"), 10) + yes(has(tags, "opening_hours"), 20)
    for k in ("addr:street", "addr:housenumber", "addr:postcode", "addr:city"):
        total = total + yes(has(tags, k), 7.5)
    for k in ("amenity", "cuisine", "shop", "brand"):
        total = total + yes(has(tags, k), 5)
    return F.least(total, F.lit(100.0))


def add_score(df: DataFrame, name: str = "name", tags: str = "tags", weights: dict[str, Column | float] | str = "balanced") -> DataFrame:
    """Add score, place_type, confidence, explanation and reasons (array of label and points).

    ``weights``: a preset's name, or weights by name (numbers or columns); zero or missing ones fall
    back to the balanced preset.
    """
    given, default = v.PRESETS[weights] if isinstance(weights, str) else weights, v.PRESETS["balanced"]
    w = {k: weight(given.get(k), d) for k, d in default.items()}
    n, t = F.lower(F.coalesce(F.col(name), F.lit(""))), F.col(tags)
    df = df.withColumn("_n", n).withColumn("_brand", F.lower(tag(t, "brand"))).withColumn("place_type", classify(t, F.col(name))).withColumn("confidence", confidence(t))
    n, brand = F.col("_n"), F.col("_brand")
    df = (
        df.withColumn("_chain", any_of(n, v.CHAINS) | any_of(brand, v.CHAINS)).withColumn("_weak", any_of(n, v.WEAK_CHAINS) | any_of(brand, v.WEAK_CHAINS))
        .withColumn("_special", any_of(n, v.SPECIALTY_WORDS)).withColumn("_roaster", any_of(n, v.ROASTER_WORDS))
    )
    chain, special, roaster = F.col("_chain"), F.col("_special"), F.col("_roaster")
    r = lambda cond, label, points: F.when(cond, F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), points.cast("double").alias("points")))
    generic = n.isin(v.GENERIC_NAMES + [f"the {g}" for g in v.GENERIC_NAMES])

    def group(title: str, keys: list[str], each: int | None, most: int, unless: Column | None = None) -> Column:
        found = set_tags(t, keys)
        points = F.lit(most) if each is None else F.least(F.lit(most), F.size(found) * each)
        cond = F.size(found) > 0
        return r(cond & ~unless if unless is not None else cond, F.concat(F.lit(f"{title} ("), F.array_join(found, ", "), F.lit(")")), points)

    reasons = [
        r(chain, "Chain cafe", w["chainPenalty"]), r(generic, "Generic name", w["genericPenalty"]),
        r(any_of(n, v.SCORE_RESTAURANT) & ~chain & ~special, "Restaurant/bar", w["restaurantPenalty"]),
        r(special, "Specialty keyword", w["specialtyKeywords"]), r(roaster & ~special, "Roaster", w["roaster"]),
        r(has(t, "website", "contact:website"), "Has website", w["website"]), r(has(t, "opening_hours"), "Opening hours listed", w["openingHours"]),
        r(tag(t, "internet_access").isin("wlan", "yes"), "WiFi available", w["wifiAccess"]),
        group("Specialty tag", v.CORE_TAGS, None, 15), group("Roasting tag", v.ROASTING_TAGS, None, 12, roaster),
        group("Brew methods", v.BREWING_TAGS, 2, 10), group("Equipment", v.EQUIPMENT_TAGS, 2, 8), group("Experience", v.EXPERIENCE_TAGS, 2, 6),
    ]
    df = df.withColumn("_reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    df = df.withColumn("_sum", w["baseline"] + F.aggregate("_reasons", F.lit(0.0), lambda s, x: s + x["points"]))
    df = df.withColumn("_s0", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_sum"))))
    df = df.withColumn("_s1", F.when(F.col("_weak"), F.least("_s0", F.lit(20.0))).otherwise(F.col("_s0")))
    df = df.withColumn("_s2", F.when(F.col("place_type") != "coffee", F.least("_s1", F.lit(40.0))).otherwise(F.col("_s1")))
    low = (F.col("confidence") < 40) & (F.size(set_tags(t, v.VERIFIED_TAGS)) == 0)
    df = df.withColumn("score", F.when(low, F.least("_s2", F.lit(65.0))).otherwise(F.col("_s2")))
    caps = [
        r(F.col("_weak"), "Weak chain cap", F.col("_s1") - F.col("_sum")), r(F.col("_s2") != F.col("_s1"), "Not pure coffee (score cap)", F.col("_s2") - F.col("_s1")),
        r(F.col("score") != F.col("_s2"), "Low data (score cap)", F.col("score") - F.col("_s2")),
    ]
    df = df.withColumn("reasons", F.concat("_reasons", F.filter(F.array(*caps), lambda x: x.isNotNull())))
    labels = lambda keep: F.array_join(F.transform(F.filter("reasons", keep), lambda x: x["label"]), ", ")
    or_ = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    explanation = (
        F.when(F.size("reasons") == 0, "Standard cafe").when(F.col("score") >= 60, or_(labels(lambda x: x["points"] > 0), "Looks promising"))
        .when(F.col("score") <= 30, or_(labels(lambda x: x["points"] < 0), "Likely generic"))
        .otherwise(or_(F.array_join(F.transform(F.slice("reasons", 1, 2), lambda x: x["label"]), ", "), "Mixed signals"))
    )
    return df.withColumn("explanation", explanation).drop("_n", "_brand", "_chain", "_weak", "_special", "_roaster", "_reasons", "_sum", "_s0", "_s1", "_s2")


def boosted(score: Column, place_type: Column, rating: Column, tags: Column) -> Column:
    """struct(score, place_type, why): a rating sets the score; without one, specialty tags give a coffee place 100."""
    rated = F.coalesce(rating, F.lit(0))
    target = F.when(rated >= 5, 100.0).when(rated == 4, 90.0).when(rated >= 3, 80.0).when(rated == 2, 70.0).when(rated == 1, 60.0)
    tagged = (place_type.isNull() | place_type.isin("", "coffee")) & (F.size(set_tags(tags, v.VERIFIED_TAGS)) > 0)
    out = lambda s, p, why: F.struct(s.cast("double").alias("score"), p.alias("place_type"), why.alias("why"))
    return (
        F.when(target.isNotNull(), out(target, F.when(rated >= 3, F.lit("coffee")).otherwise(place_type), F.concat(rated.cast("string"), F.lit("★ rating"))))
        .when(tagged, out(F.lit(100.0), place_type, F.lit("Prioritized by specialty tags"))).otherwise(out(score, place_type, F.lit(None).cast("string")))
    )


def quality(address: Column, source: Column, score: Column) -> Column:
    """Rank of a record among duplicates."""
    source = F.lower(F.coalesce(source, F.lit("")))
    of_source = F.lit(0)
    for k, p in v.SOURCE_PRIORITY.items():
        of_source = F.when(source == k, p).otherwise(of_source)
    return F.when(F.trim(F.coalesce(address, F.lit(""))) != "", 50).otherwise(0) + of_source * 10 + F.coalesce(js_round(score / 10), F.lit(0))


def tag_rules(text: Column, score: Column) -> Column:
    """Tags of a place by words in its text and by its score, sorted."""
    found = bound(text, lambda t: F.filter(F.array(*[F.when(any_of(t, words), F.lit(name)) for name, words in v.TAG_RULES]), lambda x: x.isNotNull()))
    by_score = lambda f: F.when((score >= 80) & ~F.array_contains(f, "specialty_coffee"), F.array(F.lit("specialty_coffee"))).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda f: F.array_sort(F.concat(f, by_score(f))))


def tag_evidence(text: Column, score: Column) -> Column:
    """Map from tag to the words that gave it."""
    entries = [F.struct(F.lit(name).alias("key"), F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)).alias("value")) for name, words in v.TAG_RULES]
    kept = F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0)
    mark = F.struct(F.lit("specialty_coffee").alias("key"), F.array(F.concat(F.lit("specialtyScore:"), js_round(score).cast("string"))).alias("value"))
    by_score = (score >= 80) & ~F.exists(kept, lambda e: e["key"] == "specialty_coffee")
    return F.map_from_entries(F.when(by_score, F.concat(kept, F.array(mark))).otherwise(kept))


def agent_components(score: Column, source: Column, tags: Column) -> Column:
    """Parts of the second score: the first one scaled, the source, and each tag that has points."""
    base = F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(45), js_round(score * 0.45)))).otherwise(0).cast("double")
    c = lambda k, p: F.struct(k.alias("key"), p.cast("double").alias("points"))
    source = F.lower(F.coalesce(source, F.lit("")))
    of = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[x for k, p in table.items() for x in (F.lit(k), F.lit(p))]), key), F.lit(0))
    all_ = F.concat(F.array(c(F.concat(F.lit("source:"), source), of(v.SOURCE_POINTS, source))), F.transform(tags, lambda t: c(F.concat(F.lit("tag:"), t), of(v.TAG_POINTS, t))))
    return F.concat(F.array(c(F.lit("specialtyScore"), base)), F.filter(all_, lambda x: x["points"] != 0))


def agent_score(components: Column) -> Column:
    total = F.aggregate(components, F.lit(0.0), lambda s, x: s + x["points"])
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(total)))


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "elite").when(score >= 70, "high").when(score >= 50, "medium").otherwise("low")


def source_quality(kinds: Column, domains: Column) -> Column:
    """strong, medium or weak, from the kinds of sources that have a URL and their domains."""
    site, page, map_ = (F.array_contains(kinds, k) for k in ("website", "source_url", "map"))
    n, with_domain = F.size(kinds), F.size(F.filter(domains, lambda d: d.isNotNull())) >= 1
    return (
        F.when(site & (page | map_) & with_domain, "strong").when((n > 0) & map_ & ~site & ~page, "weak").when(site | page, "medium")
        .when((n >= 2) & with_domain, "strong").when(n >= 1, "medium").otherwise("weak")
    )


def coffee_bucket(tags: Column, band: Column, sources: Column) -> Column:
    of = lambda names: F.arrays_overlap(tags, F.array(*[F.lit(x) for x in names]))
    leading, baked, relevant = of(v.LEADING_TAGS), of(v.BAKERY_BRUNCH_TAGS), of(v.RELEVANT_TAGS)
    return F.when((band == "low") | (sources == "weak"), "weak").when(~leading, F.when(baked & relevant, "mixed").otherwise("weak")).when(baked, "mixed").otherwise("coffee_led")


def review_flags(components: Column, score: Column, sources: Column, quality_: Column, story: Column, tags: Column, bucket: Column) -> Column:
    """Flags for a reviewer, in a fixed order without repeats."""
    total = F.aggregate(components, F.lit(0.0), lambda s, x: s + x["points"])
    only_map = (F.size(sources) > 0) & F.array_contains(sources, "map") & ~F.array_contains(sources, "website") & ~F.array_contains(sources, "source_url")
    leading = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in v.LEADING_TAGS]))
    flags = [
        F.when(F.size(components) == 0, "low_score"), F.when(js_round(total) != js_round(score), "score_mismatch"),
        F.when(F.size(sources) == 0, "missing_sources").when(quality_ == "weak", "weak_sources"), F.when(only_map, "google_maps_only"),
        F.when(F.trim(F.coalesce(story, F.lit(""))) == "", "missing_story"), F.when(score_band(score) == "low", "low_score"),
        F.when(~leading, "no_specialty_signals"), F.when(bucket == "weak", "coffee_profile_weak"),
    ]
    return F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull()))


def leans_from_coffee(bucket: Column, sources: Column, band: Column, flags: Column, tags: Column) -> Column:
    """Whether a reviewed place is weak, or bakery and brunch without a leading coffee tag; null parts of a review count as none."""
    has_tag = lambda names: F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(x) for x in names])), F.lit(False))
    weak = (bucket == "weak") | (sources == "weak") | (band == "low") | F.arrays_overlap(flags, F.array(*[F.lit(x) for x in ("weak_sources", "low_score", "no_specialty_signals")]))
    return F.coalesce(weak, F.lit(False)) | (bucket.isNotNull() & has_tag(v.BAKERY_BRUNCH_TAGS) & ~has_tag(v.LEADING_TAGS))
