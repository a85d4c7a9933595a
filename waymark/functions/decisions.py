"""Whether a place is listed, with the reason; and whether it is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .scoring import tag
from .text import any_of, bound


# The reasons below are fixed values: results show them.


def _says(included: bool, reason: str) -> Column:
    return F.struct(F.lit(included).alias("included"), F.lit(reason).alias("reason"))


def list_decision(text: Column, types: Column, status: Column, mode: str = "coffeeAndBakery", excluded=v.EXCLUDED_WORDS, allowed=v.ALLOWED_WORDS) -> Column:
    """struct(included, reason) of a place from a list; ``text``: name, address and description in lower case.

    Modes: all, coffeeOnly, coffeeAndBakery.  The rules are tried in order.
    """
    return bound(text, lambda t: _list_decision(t, types, status, mode, excluded, allowed))


def _list_decision(text: Column, types: Column, status: Column, mode: str, excluded, allowed) -> Column:
    whole = F.concat_ws(" ", text, F.lower(status))
    coffee, bakery = any_of(text, v.COFFEE_WORDS), any_of(text, v.BAKERY_WORDS)
    leading = any_of(F.lower(F.array_join(types, " ")), v.LEADING_TYPES) | any_of(text, v.LEADING_WORDS)
    out = (
        F.when(any_of(whole, v.CLOSED_WORDS), _says(False, "temporarily closed")).when(any_of(text, excluded), _says(False, "explicit non-coffee keyword"))
        .when(any_of(text, allowed), _says(True, "explicit allowlist")).when(~any_of(text, v.STRICT_COFFEE_WORDS), _says(False, "missing strict coffee/cafe keyword"))
        .when(any_of(text, v.FOOD_WORDS), _says(False, "food/bar/dessert keyword"))
    )
    if mode == "all":
        return out.otherwise(_says(True, "all mode"))
    if mode == "coffeeOnly":
        out = out.when((bakery | any_of(text, v.BRUNCH_WORDS)) & ~leading, _says(False, "bakery/brunch without strong coffee-leading tags"))
        return out.when(coffee, _says(True, "coffeeOnly match")).otherwise(_says(False, "not classified as coffee"))
    return out.when(coffee | bakery, _says(True, "coffee/bakery match")).otherwise(_says(False, "not coffee/bakery"))


def map_decision(text: Column, tags: Column, excluded=v.EXCLUDED_WORDS, allowed=v.ALLOWED_WORDS) -> Column:
    """struct(included, reason) of a place from the map, strict; its tags take part."""
    amenity, shop, cuisine = (F.lower(tag(tags, k)) for k in ("amenity", "shop", "cuisine"))
    whole = F.concat_ws(" ", text, F.nullif(cuisine, F.lit("")))
    return (
        F.when(any_of(text, allowed), _says(True, "explicit allowlist")).when(any_of(text, excluded), _says(False, "explicit non-coffee keyword"))
        .when(any_of(whole, [*v.FOOD_WORDS, *v.BAKERY_WORDS, *v.MORE_SWEET_WORDS]), _says(False, "non-coffee signal (dessert/boba/food)"))
        .when(~((shop == "coffee") | any_of(cuisine, v.CUISINE_COFFEE) | any_of(whole, v.STRICT_COFFEE_WORDS)), _says(False, "missing strong coffee signal"))
        .when(~(amenity.isin("cafe", "coffee") | (shop == "coffee")), _says(False, "type is not cafe/coffee")).otherwise(_says(True, "strict coffee match"))
    )


def city_locked_out(text: Column, city: Column, locks=v.CITY_LOCKS) -> Column:
    """Whether words of the text tie the place to another city than this one."""
    out = F.lit(False)
    for words, allowed in locks:
        out = out | (any_of(text, words) & (F.lower(F.trim(F.coalesce(city, F.lit("")))) != allowed))
    return out


def conflicting_city(text: Column, city_key: Column, aliases: Column) -> Column:
    """Whether the text mentions another configured city and not this one.

    ``aliases``: array of struct(city_key, alias) of all configured cities.
    """
    mentions = lambda a: (a["alias"] != "") & F.contains(text, a["alias"])
    own = F.contains(text, city_key) | F.exists(aliases, lambda a: (a["city_key"] == city_key) & mentions(a))
    return F.exists(aliases, lambda a: (a["city_key"] != city_key) & mentions(a)) & ~own


def in_city_scope(text: Column, city: Column, city_key: Column, aliases: Column, locks=v.CITY_LOCKS) -> Column:
    """Whether neither a lock nor a mention of another city keeps the place from this one."""
    return ~city_locked_out(text, city, locks) & ~conflicting_city(text, city_key, aliases)


def is_open(hours: Column, day: Column, minute: Column) -> Column:
    """true, false or null (unknown) at a weekday (0 is Sunday) and minute of the day.

    Rules end at ";" and ",", so that of "mo,we 08:00-18:00" only "we" keeps its times; both ends of a
    range count; ranges of days and of hours may wrap.
    """
    h = F.lower(hours)
    days = F.create_map(*[x for i, d in enumerate(("su", "mo", "tu", "we", "th", "fr", "sa")) for x in (F.lit(d), F.lit(i))])
    dated, timed = r"([a-z]{2})(?:-([a-z]{2}))?\s+(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})", r"^(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})$"

    def rule(p: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(p, pattern, i)
        minutes = lambda pattern, i: part(pattern, i).try_cast("int") * 60 + part(pattern, i + 1).try_cast("int")

        def within(pattern: str, i: int) -> Column:
            a, b = minutes(pattern, i), minutes(pattern, i + 2)
            return F.when(a <= b, (minute >= a) & (minute <= b)).otherwise((minute >= a) | (minute <= b))

        first = F.try_element_at(days, part(dated, 1))
        last = F.try_element_at(days, F.coalesce(F.nullif(part(dated, 2), F.lit("")), part(dated, 1)))
        on = F.when(first <= last, (day >= first) & (day <= last)).otherwise((day >= first) | (day <= last))
        return F.when(p.rlike(r"\b(?:off|closed)\b"), False).when(p.rlike(dated), F.coalesce(first.isNotNull() & last.isNotNull() & on & within(dated, 3), F.lit(False))).when(p.rlike(timed), within(timed, 1)).otherwise(False)

    rules = F.filter(F.transform(F.split(h, "[;,]"), lambda p: F.trim(p)), lambda p: p != "")
    always = F.contains(h, F.lit("24/7")) | F.contains(h, F.lit("24h")) | F.contains(h, F.lit("24 hours"))
    return F.when(hours.isNull() | (hours == ""), F.lit(None).cast("boolean")).when(always, True).otherwise(F.exists(rules, rule))
