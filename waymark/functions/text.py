"""Text and number expressions with the exact semantics that the place rules were written for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value bound to a variable: its expression is evaluated once, and not wherever ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are made once a row.

    A filter on a column is else pushed below it and takes its expression along, with those that this reads in
    turn; nothing is pushed below rows that are generated.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[e.alias(c) for c, e in columns.items()]))))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of the words, as raw substrings ("bar" is in "barn"); null: no.

    The text is bound to a variable, so that an expression is evaluated once and not for each word.  Over
    200,000 names and eight lists this took 1.8 s on one core; a chain of OR took 7.1 s, its code being too
    long to compile, and one regular expression a list 8.4 s.
    """
    return F.coalesce(F.exists(F.array(text), lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))), F.lit(False))


def first_of(text: Column, words: Sequence[str]) -> Column:
    """The first word of the list that the text contains, else null."""
    found = F.transform(F.array(text), lambda t: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))
    return F.try_element_at(F.element_at(found, 1), F.lit(1))


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined by a space, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def js_round(x: Column) -> Column:
    """Half goes up, also below zero: -2.5 gives -2."""
    return F.floor(x + 0.5)


def weight(value: Column | float | None, default: float) -> Column:
    """A weight of zero, like a missing one, falls back to the default."""
    return F.coalesce(F.nullif((F.lit(value) if not isinstance(value, Column) else value).cast("double"), F.lit(0.0)), F.lit(float(default)))


def finite(x: Column) -> Column:
    """A double, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_number(text: Column) -> Column:
    """A coordinate from text, a decimal comma allowed; null where it is none."""
    t = F.regexp_replace(F.trim(text), "^([^,]*),", "$1.")
    return finite(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))


def squeeze(text: Column) -> Column:
    """Trimmed, lower case, Unicode white space to single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def place_text(text: Column) -> Column:
    """Name or address for comparison: squeezed, then only a-z, 0-9, Hebrew and spaces; null: empty."""
    return F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), r"[^a-z0-9֐-׿\s]", "")


def id_part(value: Column, fallback: str = "na") -> Column:
    """A part of an id: lower case, spaces to hyphens, other signs dropped, hyphens single and inside."""
    v = F.regexp_replace(squeeze(F.coalesce(value, F.lit(""))), r"(?U)\s+", "-")
    v = F.regexp_replace(F.regexp_replace(v, r"[^a-z0-9֐-׿-]", ""), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(v, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def fixed5(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.5f", x.cast("double")))


def stable_id(city: Column, name: Column, lat: Column, lon: Column) -> Column:
    """seeded-<city>-<name>-<lat>-<lon>; a missing coordinate reads "na"."""
    part = lambda x: F.coalesce(fixed5(finite(x)), F.lit("na"))
    return F.concat_ws("-", F.lit("seeded"), id_part(city, "city"), id_part(name, "unnamed"), part(lat), part(lon))


def parse_stable_id(value: Column) -> Column:
    """struct(city_key, name_key, lat, lon), or null.  The last two hyphened parts are the numbers, so a
    minus sign is lost and its empty part reads as 0; this is kept as it is."""
    return F.element_at(F.transform(F.array(F.split(value, "-")), _stable_parts), 1)


def _stable_parts(parts: Column) -> Column:
    number = lambda x: F.when(F.trim(x) == "", F.lit(0.0)).otherwise(finite(x.try_cast("double")))
    name = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 4, F.lit(0))), "-")
    read = F.struct(F.get(parts, F.lit(1)).alias("city_key"), name.alias("name_key"), number(F.try_element_at(parts, F.lit(-2))).alias("lat"), number(F.try_element_at(parts, F.lit(-1))).alias("lon"))
    ok = lambda r: (r["city_key"] != "") & (r["name_key"] != "") & r["lat"].isNotNull() & r["lon"].isNotNull()
    kept = F.filter(F.array(read), lambda r: (F.get(parts, F.lit(0)) == "seeded") & (F.size(parts) >= 5) & ok(r))
    return F.get(kept, F.lit(0))


def parse_strict_id(value: Column, city: Column | None = None) -> Column:
    """``parse_stable_id`` with the signs of its numbers and whole words of the city, if that is given; "na" reads as null.

    Without ``city`` its key is the first hyphened part.  Null for what is no such id, or one of another city.
    """
    number = r"(-?\d+(?:\.\d+)?|na)"
    key = id_part(city, "city") if city is not None else F.regexp_extract(value, r"^seeded-([^-]+)-", 1)
    pattern = rf"^(.*[^-])-{number}-{number}$"

    def read(id_: Column) -> Column:
        rest = F.substring(id_["value"], F.length(id_["key"]) + 9, F.length(id_["value"]))  # after seeded-<city>-
        part = lambda i: F.regexp_extract(rest, pattern, i)
        parts = F.struct(id_["key"].alias("city_key"), part(1).alias("name_key"), part(2).try_cast("double").alias("lat"), part(3).try_cast("double").alias("lon"))
        return F.when((id_["key"] != "") & id_["value"].startswith(F.concat(F.lit("seeded-"), id_["key"], F.lit("-"))) & rest.rlike(pattern), parts)

    return bound(F.struct(value.alias("value"), key.alias("key")), read)


def stable_hash(text: Column) -> Column:
    """h = h * 31 + code, modulo 2**32, over the characters (those of the basic plane)."""
    chars = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, i: (h * 31 + F.ascii(F.substring(text, i, F.lit(1)))).bitwiseAND(F.lit(4294967295)))


def ascii_word(text: Column, word: str) -> Column:
    """Whether the word stands between ASCII word boundaries, as a lower-case match."""
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return text.rlike(edge + "\\Q" + word + "\\E" + edge)


#: The marks that fuzzy matching drops: the block of combining diacritical marks.
LATIN_MARKS = (0x0300, 0x036F)
_PAIR, _ITEM = "\ue000", "\ue001"  # of the private use area: no compatibility form has them


@cache
def _folds(marks: tuple[int, int] | None) -> tuple[str, str, str]:
    """By Unicode's tables: the characters that one other stands for and then those that none does, the others, and the list of those that several do.

    Those several are of the basic plane.  Hangul syllables, whose parts are letters and no accents, are left whole.
    """
    drop = (lambda c: unicodedata.combining(c)) if marks is None else (lambda c: marks[0] <= ord(c) <= marks[1])
    one, none, several = [], [], []
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)):
        c = chr(code)
        kept = "".join(x for x in unicodedata.normalize("NFKD", c) if not drop(x))
        if kept == "":
            none.append(c)
        elif len(kept) == 1 and kept != c:
            one.append((c, kept))
        elif kept != c and code < 0x10000:
            several.append((c, kept))
    return "".join(c for c, _ in one) + "".join(none), "".join(k for _, k in one), _ITEM.join(c + _PAIR + k for c, k in several)


def folded(text: Column, marks: tuple[int, int] | None = None) -> Column:
    """The text in compatibility decomposition without combining marks: "Café Münster" reads "Cafe Munster".

    ``marks``: the range of marks that go, all if none is given.  Of texts beyond ASCII the characters that one
    character stands for are translated; only where one is left that several stand for, they are looked up one by one.
    """
    come, go, several = _folds(marks)
    t = F.translate(text, come, go)
    known = F.str_to_map(F.lit(several), F.lit(_ITEM), F.lit(_PAIR))
    letters = "".join(x[0] for x in several.split(_ITEM))
    each = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    whole = F.element_at(F.transform(F.array(t), lambda t: F.when(F.translate(t, letters, "") != t, each(t)).otherwise(t)), 1)
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def chain_key(text: Column) -> Column:
    """A name for counting chains: lower case, without accents, all but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(folded(F.lower(F.coalesce(text, F.lit(""))), LATIN_MARKS), r"[^\p{L}\p{N}]+", " "))


def match_text(text: Column) -> Column:
    """Text for fuzzy matching: without accents, & to "and", quotes dropped, other signs to spaces, squeezed."""
    t = F.lower(folded(F.coalesce(text, F.lit("")), LATIN_MARKS))
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), "['’`]", "")
    return squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}\s-]", " "))


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    found = F.filter(F.split(match_text(text), " "), lambda t: t != "")
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets (arrays without repeats); 0 if one is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), bound(n, lambda n: n / (F.size(a) + F.size(b) - n))).otherwise(F.lit(0.0))


def bigrams(text: Column) -> Column:
    pairs = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return bound(F.regexp_replace(match_text(text), r"(?U)\s+", ""), lambda s: F.when(F.length(s) >= 2, pairs(s)).when(s != "", F.array(s)).otherwise(F.array().cast("array<string>")))


def dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams over all; 0 if one has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def format_distance(km: Column) -> Column:
    """Metres below one kilometre, one decimal below ten, else whole kilometres."""
    return F.when(km < 1, F.format_string("%d m", js_round(km * 1000))).when(km < 10, F.format_string("%.1f km", km)).otherwise(F.format_string("%d km", js_round(km)))


def link_part(text: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def domain(url: Column) -> Column:
    """Host of an absolute URL in lower case without a leading www., else null."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def clean_notes(notes: Column, phrases: Sequence[str]) -> Column:
    """Notes without the given provenance phrases, pipes tidy; null where nothing is left."""
    out = notes
    for p in phrases:
        out = F.regexp_replace(out, "(?i)" + p, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\|\s*(\|\s*)*", " | "), r"^[\s|]+|[\s|]+$", "")
    return F.nullif(F.trim(out), F.lit(""))


def area_of_notes(notes: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(notes), r"(?i)^area\s*:\s*(.+)$", 1))


_URL = {"scheme": (r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), "authority": (r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), "query": (r"^[^?#]*\?([^#]*)", 1), "fragment": (r"^[^#]*#(.*)", 1)}


def _url_part(url: Column, part: str) -> Column:
    """A part of a URL, null where it has none (an empty one is none but for the authority)."""
    pattern, group = _URL[part]
    found = F.when(url.rlike(pattern), F.regexp_extract(url, pattern, group))
    return found if part == "authority" else F.nullif(found, F.lit(""))


def _url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """An absolute path with its "." and ".." steps taken: a fold over its parts."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    step = lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, step)
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def absolute_url(reference: Column, base: Column) -> Column:
    """A reference as an absolute URL, as seen from the base (RFC 3986, 5.2); null if it is blank, or relative without a base.

    A reference with the base's own scheme and no authority counts as relative, as browsers take it.
    Hosts are neither checked nor put in lower case; empty queries and fragments go.
    """
    r, b = F.trim(reference), F.trim(base)
    of = lambda url, part: _url_part(url, part)
    own = of(r, "scheme").isNotNull() & (of(r, "authority").isNotNull() | (F.lower(of(r, "scheme")) != F.lower(F.coalesce(of(b, "scheme"), F.lit("")))))
    path, from_base = _url_path(r), _url_path(b)
    whole = of(r, "authority").isNotNull()
    hosted = of(b, "authority").isNotNull()
    merged = F.when(hosted & (from_base == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(from_base, r"^(.*/)?[^/]*$", 1), path))
    relative = F.when(path == "", from_base).when(path.startswith("/"), without_dots(path)).otherwise(F.when(merged.startswith("/"), without_dots(merged)).otherwise(merged))
    rooted = F.when(path.startswith("/"), without_dots(path)).otherwise(path)
    scheme = F.lower(F.when(own, of(r, "scheme")).otherwise(of(b, "scheme")))
    authority = F.when(own | whole, of(r, "authority")).otherwise(of(b, "authority"))
    query = F.when(own | whole | (path != ""), of(r, "query")).otherwise(F.coalesce(of(r, "query"), of(b, "query")))
    tail = lambda mark, part: F.coalesce(F.concat(F.lit(mark), part), F.lit(""))
    out = F.concat(scheme, F.lit(":"), F.coalesce(F.concat(F.lit("//"), authority), F.lit("")), F.when(own | whole, rooted).otherwise(relative), tail("?", query), tail("#", of(r, "fragment")))
    return F.when((r != "") & scheme.isNotNull() & (own | of(b, "scheme").isNotNull()), out)


def component(text: Column) -> Column:
    """Percent-encoded as a part of a URL, where letters, digits and -_.!~*'() stay."""
    out = link_part(text)
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def direct_link(url: Column, name: Column, address: Column, search: str) -> Column:
    """A place's own link, else ``search`` and its name and address, else nothing."""
    asked = F.concat_ws(" ", *[F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")) for x in (name, address)])
    return F.coalesce(F.nullif(url, F.lit("")), F.when(asked != "", F.concat(F.lit(search), component(asked))).otherwise(F.lit("")))
