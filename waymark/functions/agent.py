"""Story, sources and image of a place, and how fields that are there already win."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .curation import first_image
from .text import bound, domain, squeeze


def _full(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark, at most 180 characters; empty for no text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    end = F.regexp_instr(t, F.lit("[.!?]"))
    return F.when(end == 0, F.substring(t, 1, 180)).otherwise(F.substring(t, F.lit(1), F.least(end, F.lit(180))))


def source_ids(website: Column, source_url: Column, map_url: Column, map_link: Column) -> Column:
    """The id of the source that a story cites first, or null."""
    return F.when(_full(website).isNotNull(), "website").when(_full(source_url).isNotNull(), "source-url").when(_full(map_url).isNotNull(), "google-maps-url").when(_full(map_link).isNotNull(), "gmaps-link")


def story(notes: Column, description: Column, tags: Column, preferred: Column) -> Column:
    """struct(summary, sources), or null: the first sentence of the notes, else of the description, else the tags."""
    said = first_sentence(F.coalesce(_full(notes), description))
    told = F.when(_full(notes).isNotNull(), F.array(F.lit("notes"))).otherwise(F.array(F.lit("description")))
    with_preferred = lambda ids: F.when(preferred.isNotNull() & ~F.array_contains(ids, F.coalesce(preferred, F.lit(""))), F.concat(ids, F.array(preferred))).otherwise(ids)
    known = F.concat(F.lit("Known for "), F.array_join(F.transform(F.slice(tags, 1, 3), lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", "), F.lit("."))
    return F.when(said != "", F.struct(said.alias("summary"), with_preferred(told).alias("sources"))).when(F.size(tags) > 0, F.struct(known.alias("summary"), with_preferred(F.array(F.lit("tags"))).alias("sources")))


def sources(website: Column, source_url: Column, map_url: Column, map_link: Column, source: Column) -> Column:
    """array of struct(id, kind, title, url, domain), one for each source that the place has."""
    site, page = domain(_full(website)), domain(_full(source_url))
    one = lambda here, id_, kind, title, url, at: F.when(_full(here).isNotNull(), F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("kind"), title.alias("title"), url.alias("url"), at.alias("domain")))
    titled = lambda text, at: F.when(_full(at).isNotNull(), F.concat(F.lit(f"{text} ("), at, F.lit(")"))).otherwise(F.lit(text))
    host = lambda url: F.lower(F.try_parse_url(url, F.lit("HOST")))
    found = [
        one(website, "website", "website", titled("Official website", site), website, site),
        one(source_url, "source-url", "source_url", F.when(_full(page).isNotNull() & (page == site), F.lit("Source (official site)")).otherwise(titled("Source", page)), source_url, page),
        one(map_url, "google-maps-url", "map", F.lit("Google Maps"), map_url, host(map_url)), one(map_link, "gmaps-link", "map", F.lit("Google Maps"), map_link, host(map_link)),
        one(source, "source-primary", "dataset", F.upper(source), F.lit(None).cast("string"), F.lit(None).cast("string")),
    ]
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def usable(url: Column) -> Column:
    """The address of an image, or null where it is empty or of the kind that browsers may not read."""
    full = _full(F.trim(url))
    return F.when(~F.contains(full, F.lit(v.BROKEN_PHOTO)), full)


def image(photo: Column, site_images: list[Column], website: Column, source_url: Column) -> Column:
    """struct(url, source, attribution), or null: the photo of the map, else the first image of the site."""
    site = first_image(site_images)
    by = F.coalesce(_full(domain(_full(website))), _full(domain(_full(source_url))))
    s = lambda url, source, by: F.struct(url.alias("url"), F.lit(source).alias("source"), by.alias("attribution"))
    return F.when(usable(photo).isNotNull(), s(usable(photo), "google", F.lit("google-maps"))).when(site.isNotNull(), s(site, "website", by))


def merged(existing: Column, computed: Column) -> Column:
    """Two structs of story, sources, tags, image, score and status: what is there already wins field by field.

    Empty lists, unusable images and the status "none" do not count as being there.
    """
    some = lambda f: F.when(F.size(existing[f]) > 0, existing[f]).otherwise(computed[f])
    status = F.when(F.coalesce(existing["status"], F.lit("none")).isin("none", ""), computed["status"]).otherwise(existing["status"])
    picture = F.when(usable(existing["image"]["url"]).isNotNull(), existing["image"]).otherwise(computed["image"])
    return F.struct(
        F.coalesce(existing["story"], computed["story"]).alias("story"), some("sources").alias("sources"), some("tags").alias("tags"), picture.alias("image"),
        F.when(picture.isNotNull(), "ok").otherwise("missing").alias("image_status"), F.coalesce(existing["score"], computed["score"]).alias("score"), status.alias("status"),
    )


def story_quality(summary: Column, source_ids_: Column) -> Column:
    """strong (8 to 45 words, with a source), medium or weak (no story)."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(summary, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    return F.when(words == 0, "weak").when(words.between(8, 45) & (F.size(F.coalesce(source_ids_, F.array().cast("array<string>"))) > 0), "strong").otherwise("medium")


def breakdown(components: Column) -> Column:
    """Score components, the greatest effect first, equal ones in their order."""
    numbered = F.transform(components, lambda c, i: F.struct((-F.abs(c["points"])).alias("o"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(numbered), lambda x: x["c"])


def import_text(name: Column, description: Column, notes: Column, address: Column, types: Column, source: Column) -> Column:
    """The text that an importer tags: with the address and the types, in lower case, white space single."""
    return squeeze(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (name, description, notes, address, F.array_join(types, " "), source)]))


def import_sources(source: Column, map_url: Column, source_url: Column, website: Column) -> Column:
    """An importer's sources in its order: array of struct(id, type, title, url, domain)."""
    one = lambda id_, kind, title, url: F.when(_full(url).isNotNull(), F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("type"), title.alias("title"), url.alias("url"), F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("domain")))
    none = F.lit(None).cast("string")
    dataset = F.when(_full(source).isNotNull(), F.struct(F.lit("source-primary").alias("id"), F.lit("dataset").alias("type"), F.upper(source).alias("title"), none.alias("url"), none.alias("domain")))
    rest = [one("google-maps-url", "map", F.lit("Google Maps"), map_url), one("source-url", "source_url", F.lit("Source"), source_url), one("website", "website", F.lit("Website"), website)]
    return F.array_compact(F.array(dataset, *rest))


#: The sentences of an imported place's story.
ROASTERY_STORY = "A roastery-forward coffee spot with specialty signals in its public-facing metadata."
BAKERY_STORY = "A bakery-and-coffee stop with visible espresso cues and a broader cafe profile."
PLAIN_STORY = "A coffee-oriented venue with structured public source references."
CUE_STORY = ("A specialty-leaning cafe with clear ", " signals in its public-facing metadata.")
REFERENCE_STORY = "Source metadata references "
ADDRESS_STORY = "Address metadata is available for location context."
POUR_TAGS = ["pour_over", "v60", "chemex", "aeropress"]


def import_story(tags: Column, sources_: Column, address: Column) -> Column:
    """struct(summary, source_ids) of an imported place: what its tags say, up to two of its sources, and whether it has an address.

    ``sources_``: array of struct with id, title, url and domain.
    """
    return bound(F.struct(tags.alias("tags"), sources_.alias("sources")), lambda x: _import_story(x["tags"], x["sources"], address))


def _import_story(tags: Column, sources_: Column, address: Column) -> Column:
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    specialty, espresso, pour = has("specialty_coffee"), has("espresso_bar"), has(*POUR_TAGS)
    cues = F.array_compact(F.array(F.when(pour, F.lit("pour-over")), F.when(espresso, F.lit("espresso"))))
    cues = F.when(F.size(cues) > 0, F.array_join(cues, " and ")).otherwise(F.lit("specialty coffee"))
    first = (
        F.when(has("roastery") & specialty, ROASTERY_STORY).when(has("bakery") & (espresso | specialty), BAKERY_STORY)
        .when(specialty | espresso | pour, F.concat(F.lit(CUE_STORY[0]), cues, F.lit(CUE_STORY[1]))).otherwise(PLAIN_STORY)
    )
    named = F.transform(F.filter(sources_, lambda s: _full(s["url"]).isNotNull()), lambda s: F.coalesce(_full(s["domain"]), _full(s["title"])))
    named = F.slice(F.array_distinct(F.array_compact(named)), 1, 2)
    second = F.when(F.size(named) > 0, F.concat(F.lit(REFERENCE_STORY), F.array_join(named, " and "), F.lit(".")))
    summary = F.concat_ws(" ", first, second, F.when(_full(address).isNotNull(), ADDRESS_STORY))
    return F.struct(summary.alias("summary"), F.transform(sources_, lambda s: s["id"]).alias("source_ids"))
