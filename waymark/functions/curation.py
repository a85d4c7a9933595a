"""Rules of curated places: keyword lists by city, floors, badges, import and discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .scoring import set_tags, tag
from .text import any_of, bound, joined


def normal_words(words: Column) -> Column:
    """Trimmed lower-case words without empties and repeats; null where nothing is left."""
    found = F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(F.coalesce(w, F.lit(""))))), lambda w: w != ""))
    return F.when(F.size(found) > 0, found)


def city_words(everywhere: Column, own: Column) -> Column:
    """The words that hold everywhere and then the city's own."""
    return F.array_union(everywhere, F.coalesce(normal_words(own), F.array().cast("array<string>")))


def city_aliases(city: Column, aliases: Column) -> Column:
    """The city's name and its configured aliases, in lower case."""
    return F.coalesce(normal_words(F.concat(F.array(city), F.coalesce(aliases, F.array().cast("array<string>")))), F.array().cast("array<string>"))


def is_european(country: Column, countries: Sequence[str] = v.EUROPEAN_COUNTRIES) -> Column:
    return F.coalesce(country.isin(list(countries)), F.lit(False))


def exclusion_word(text: Column, words: Column, european: Column, chains: Sequence[str] = v.EUROPE_CHAINS) -> Column:
    """The word that leaves a place out, else null: in European cities a chain's first, then the city's words in order."""
    chains_here = F.when(european, F.array(*[F.lit(c) for c in chains])).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.array(text), lambda t: F.filter(F.concat(chains_here, words), lambda w: F.contains(t, w)))
    return F.get(F.element_at(found, 1), F.lit(0))


def specialty_flag(*parts: Column) -> Column:
    """Whether name, cuisine, description, brand or operator speak of specialty coffee."""
    return any_of(joined(*parts), v.SPECIALTY_FLAG_WORDS)


def seeded_floor(score: Column, place_type: Column, reasons: Column, curated: Column) -> Column:
    """struct(score, place_type, reasons): places curated as specialty have at least 72 and are coffee."""
    least = F.greatest(score, F.lit(float(v.SEEDED_FLOOR)))
    more = F.concat(reasons, F.array(F.struct(F.lit("Curated specialty seed").alias("label"), (least - score).alias("points"))))
    yes = F.coalesce(curated, F.lit(False))
    return F.struct(F.when(yes, least).otherwise(score).alias("score"), F.when(yes, F.lit("coffee")).otherwise(place_type).alias("place_type"), F.when(yes, more).otherwise(reasons).alias("reasons"))


def radius_km(city: Column) -> Column:
    """How far a city reaches: its own radius or 2.2 km, at least 3.5 and at most 40 km."""
    metres = F.lit(float(v.DEFAULT_RADIUS_METRES))
    for name, m in v.CITY_RADIUS_METRES.items():
        metres = F.when(city == name, F.lit(float(m))).otherwise(metres)
    return F.least(F.lit(v.MOST_RADIUS_KM), F.greatest(F.lit(v.LEAST_RADIUS_KM), F.greatest(F.lit(1.0), metres / 1000)))


def display_city(city: Column) -> Column:
    out = city
    for name, shown in v.CITY_DISPLAY.items():
        out = F.when(city == name, F.lit(shown)).otherwise(out)
    return out


def shown_score(score: Column, rating: Column) -> Column:
    """One star shows as 50, though it is stored as 60."""
    return F.when(F.coalesce(rating, F.lit(0)) == 1, F.lit(50.0)).otherwise(score)


def score_badge(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score >= 95, "top").when(score >= 80, "high").when(score >= 50, "mid").otherwise("low")


def discovery_score(tags: Column) -> Column:
    """struct(score, total) of a map element's tags; candidates have a score of at least 18."""
    return bound(tags, lambda t: bound(joined(*[tag(t, k) for k in ("name", "brand", "operator", "description", "cuisine")]), lambda said: _discovery_score(t, said)))


def _discovery_score(tags: Column, text: Column) -> Column:
    real = lambda keys: F.size(F.filter(set_tags(tags, keys), lambda k: ~F.lower(F.try_element_at(tags, k)).isin("no", "false", "0")))
    hits = lambda words: F.size(F.element_at(F.transform(F.array(text), lambda t: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))), 1))
    yes = lambda c, p: F.when(c, p).otherwise(0)
    score = (
        yes(real(v.CORE_TAGS) > 0, 25) + yes(real(v.ROASTING_TAGS) > 0, 15) + F.least(F.lit(12), 3 * real(v.BREWING_TAGS)) + F.least(F.lit(8), 2 * real(v.EQUIPMENT_TAGS)) + F.least(F.lit(8), 2 * real(v.EXPERIENCE_TAGS))
        + F.least(F.lit(20), 4 * hits(v.DISCOVERY_TEXT)) + F.least(F.lit(12), 3 * hits(v.DISCOVERY_NAME)) + yes(F.lower(tag(tags, "cuisine")).rlike("coffee_shop|specialty_coffee"), 8) + yes(F.lower(tag(tags, "roasting")) == "yes", 8)
        - yes(any_of(text, v.DISCOVERY_NEGATIVE), 25)
    )
    return bound(F.greatest(F.lit(0), score), lambda s: F.struct(s.alias("score"), F.least(F.lit(100), v.DISCOVERY_FROM + s).alias("total")))


def import_passes(name: Column, address: Column, search: Column, tags: Column, score: Column, mode: str = "coffeeOnly", excluded=v.IMPORT_EXCLUDED, allowed=v.ALLOWED_WORDS) -> Column:
    """Whether an imported place stays; ``search``: its search text, ``tags``: those of the second score."""
    text = joined(name, address)
    strong = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in v.LEADING_TAGS]))
    evidence = strong | any_of(F.lower(name), v.IMPORT_COFFEE_NAME)
    coffee_text, obvious, food = any_of(search, v.IMPORT_COFFEE_TEXT), any_of(search, v.IMPORT_NON_COFFEE), any_of(search, v.IMPORT_FOOD_FIRST)
    baked = F.arrays_overlap(tags, F.array(F.lit("bakery"), F.lit("brunch"))) | any_of(text, v.IMPORT_BAKERY_BRUNCH)
    out = F.when(any_of(text, excluded), False).when(any_of(text, allowed), True).when(obvious & ~strong, False)
    if mode == "coffeeAndBakery":
        return out.otherwise(evidence | coffee_text | (baked & ~obvious))
    neutral = F.coalesce(score >= v.IMPORT_NEUTRAL_SCORE, F.lit(False))
    return out.when((baked | food) & ~strong, False).otherwise(evidence | (~baked & ~food & (coffee_text | neutral)))


def lookup_address(properties: Column) -> Column:
    """One line from a geocoder's properties (a map): street and number, postcode and town, country."""
    p = lambda k: F.nullif(F.coalesce(F.try_element_at(properties, F.lit(k)), F.lit("")), F.lit(""))
    country = F.when(F.upper(p("countrycode")) == "CZ", F.lit("Czech Republic")).otherwise(p("country"))
    line = lambda *x: F.nullif(F.trim(F.concat_ws(" ", *x)), F.lit(""))
    return F.concat_ws(", ", line(p("street"), p("housenumber")), line(p("postcode"), F.coalesce(p("city"), p("district"), p("locality"))), country)


def first_image(scalars: Sequence[Column], arrays: Sequence[Column] = ()) -> Column:
    """The first image address that is not empty: of single fields in order, then of lists in order."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(*map(full, scalars), *[F.get(F.filter(F.transform(a, full), lambda x: x.isNotNull()), F.lit(0)) for a in arrays])


def query_texts(*variants: tuple[Column, ...]) -> Column:
    """The texts to look a place up with: the parts of each variant joined by commas, without empties and repeats."""
    line = lambda parts: F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.array_distinct(F.filter(F.array(*[line(x) for x in variants]), lambda q: q != ""))


def city_of_url(url: Column, names: dict[str, str] | None = None) -> Column:
    """The city that the first part of a path names, as ``names`` has it, else in title case; null for no URL."""
    first = F.lower(F.get(F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != ""), F.lit(0)))
    out = F.initcap(F.replace(F.coalesce(first, F.lit("")), F.lit("-"), F.lit(" ")))
    for slug, name in (names or {}).items():
        out = F.when(first == slug, F.lit(name)).otherwise(out)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), out)


def card_text(id_: Column, name: Column, roaster: Column, texts: Sequence[str], roaster_texts: Sequence[str], nameless: str = "") -> Column:
    """One of the caller's texts, always the same for a place, by the hash of its id, else its name, else ``nameless``."""
    from .text import stable_hash

    key = F.coalesce(F.nullif(id_, F.lit("")), F.nullif(name, F.lit("")), F.lit(nameless))
    pick = lambda t: F.element_at(F.array(*[F.lit(x) for x in t]), (stable_hash(key) % len(t) + 1).cast("int"))
    return F.when(roaster, pick(roaster_texts)).otherwise(pick(texts))


def output_row(score: Column, rating: Column, confidence: Column, place_type: Column, source: Column, open_: Column, address: Column, image: Column, photo: Column, needs_coords: Column, has_coords: Column) -> Column:
    """struct of what a result line shows: score and badge, open or closed, flags and image."""
    rated = F.coalesce(rating, F.lit(0)) > 0
    shown = shown_score(score, rating)
    return F.struct(
        shown.alias("shown"), score_badge(shown).alias("badge"), F.when(open_, "open").when(~open_, "closed").alias("open"), F.coalesce(F.nullif(image, F.lit("")), photo).alias("image"),
        (F.coalesce(needs_coords, F.lit(False)) & ~has_coords).alias("missing_coordinates"), (F.coalesce(place_type, F.lit("")) != "").__and__(place_type != "coffee").alias("non_pure"),
        (~rated & F.coalesce(confidence < 40, F.lit(False))).alias("low_data"), (~rated & (F.coalesce(source, F.lit("")) != "google")).alias("editorial"), (F.trim(F.coalesce(address, F.lit(""))) == "").alias("missing_address"),
    )


def shown_reasons(reasons: Column, most: int = 3) -> Column:
    """The first reasons of a score, as many as a card has room for."""
    return F.slice(F.coalesce(reasons, F.array().cast("array<struct<label:string,points:double>>")), 1, most)
