"""Dictionary matches and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape.config import Groups, Taxonomy
from rolescape.functions.phrases import Dictionary
from rolescape.functions.text import closing_date_text, collapse, contains_phrase, first_filled, join_filled, once, text

#: The fields that are searched, in order.
SEARCHED = ("title", "normalized_role", "company", "location", "city", "country", "description", "experience_text", "skills_text", "software_text", "sector", "employment_type")


def searchable(df: DataFrame) -> Column:
    return F.lower(join_filled([df[c] for c in SEARCHED if c in df.columns], " "))


def first_match(lowered: Column, groups: Groups) -> Column:
    """The group of the longest alias found as a phrase; of equally long ones the group declared first."""
    book = Dictionary(groups)
    return book.first(book.found(lowered), groups)


def all_matches(lowered: Column, groups: Groups, separator: str = "; ") -> Column:
    """Every group with an alias in the text, in declared order, joined."""
    book = Dictionary(groups)
    return book.every(book.found(lowered), groups, separator)


def first_by_pattern(lowered: Column, groups: Groups) -> Column:
    """first_match by a regular expression for each alias: the form that can stand inside a transform."""
    ranked = sorted(((-len(a), i, name, a) for i, (name, aliases) in enumerate(groups) for a in aliases), key=lambda x: x[:2])
    out = F.lit("")
    for _, _, name, alias in reversed(ranked):
        out = F.when(contains_phrase(lowered, alias), name).otherwise(out)
    return out


def city_groups(taxonomy: Taxonomy) -> Groups:
    return tuple((c, aliases) for c, _, aliases in taxonomy.cities)


def city(location: Column, taxonomy: Taxonomy) -> Column:
    """The city that a place names, or empty."""
    return first_by_pattern(F.lower(collapse(location)), city_groups(taxonomy))


def country_of(city: Column, taxonomy: Taxonomy) -> Column:
    """The country of a city by its name."""
    of = {c: country for c, country, _ in taxonomy.cities}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), city), F.lit("")) if of else F.lit("")


def enrich(jobs: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Fill role, city, country, software, sector, employment type and closing date where they are empty.

    The role is the one a title names, unless it has a negative term, else the one that title and 2000 characters of
    description name; the place a city and its country, else a country, else a region as country. Each text is searched
    once for all phrases that matter in it.
    """
    cities = city_groups(taxonomy)
    roles, negative = taxonomy.roles, taxonomy.negative_roles
    titles, contexts = Dictionary(roles, terms=negative), Dictionary(roles)
    wheres, texts = Dictionary(cities, taxonomy.countries, taxonomy.regions), Dictionary(taxonomy.software, taxonomy.sectors, taxonomy.employment)
    title = F.lower(collapse(jobs["title"]))
    context = F.concat(title, F.lit(" "), F.lower(F.left(text(jobs["description"]), F.lit(2000))))
    # what is found in a text is used by several columns
    df = once(jobs, _title=titles.found(title), _context=contexts.found(context), _where=wheres.found(F.lower(collapse(jobs["location"]))), _found=texts.found(searchable(jobs)))
    df = once(df, _city=wheres.first(F.col("_where"), cities))
    where, found, at = F.col("_where"), F.col("_found"), F.col("_city")
    computed = {
        "normalized_role": F.when(titles.any(F.col("_title"), negative), "").otherwise(first_filled(titles.first(F.col("_title"), roles), contexts.first(F.col("_context"), roles))),
        "city": at,
        "country": F.when(at != "", country_of(at, taxonomy)).otherwise(first_filled(wheres.first(where, taxonomy.countries), wheres.first(where, taxonomy.regions))),
        "software_text": texts.every(found, taxonomy.software),
        "sector": texts.first(found, taxonomy.sectors),
        "employment_type": texts.first(found, taxonomy.employment),
        "closing_at": closing_date_text(F.col("description")),
    }
    return df.withColumns({c: first_filled(F.col(c), x) for c, x in computed.items()} | {"duplicate_status": first_filled(F.col("duplicate_status"), F.lit("unique"))}).drop("_title", "_context", "_where", "_found", "_city")
