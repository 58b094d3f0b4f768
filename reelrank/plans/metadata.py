"""Reading filters, titles and sorts out of query texts (PL1-PL4, PL11, PL15, PL16), as columns
over a whole table of queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelrank.functions.text import exact_key, ordered_tokens

#: How genres are written in queries.
GENRE_ALIASES = {
    "action": "Action",
    "adventure": "Adventure",
    "animated": "Animation",
    "animation": "Animation",
    "comedy": "Comedy",
    "crime": "Crime",
    "documentary": "Documentary",
    "drama": "Drama",
    "fantasy": "Fantasy",
    "horror": "Horror",
    "musical": "Musical",
    "mystery": "Mystery",
    "romance": "Romance",
    "romantic": "Romance",
    "sci-fi": "Sci-Fi",
    "sci fi": "Sci-Fi",
    "science fiction": "Sci-Fi",
    "thriller": "Thriller",
    "war": "War",
    "western": "Western",
}
COMPOUND_GENRES = ["romantic comedy"]
#: Words that are no title terms beside metadata.
NON_TITLE_TERMS = ["a", "an", "and", "at", "about", "film", "films", "for", "from", "in", "is", "movie", "movies", "of", "or", "the", "which", "with", "featuring", "starring", "rated", "rating", "ratings", "above", "over", "least", "after", "before", "since", "minimum", "no", "fewer", "than", "user"]
MEDIA_WORDS = ["movie", "movies", "film", "films"]
#: The phrasings that queries may use for filters, titles and sorts.
YEAR = r"((?:19|20)\d{2})"
PATTERNS = {
    "decade": r"\b((?:19|20)\d0)s\b",
    "range": rf"\bfrom\s+{YEAR}\s+to\s+{YEAR}\b",
    "from": rf"\bfrom\s+{YEAR}\b",
    "after": rf"\b(after|since)\s+{YEAR}\b",
    "before": rf"\bbefore\s+{YEAR}\b",
    "rating": r"\b(?:rated|rating)\s+(?:above|over|at least)\s+(\d(?:\.\d)?)\b",
    "count": r"\b(?:with\s+)?(?:at least|minimum(?:\s+of)?|no fewer than)\s+(\d+)\s+(?:user\s+)?ratings?\b",
}
TITLE_PATTERNS = [r"\btitle\s+(?:contains?|containing|has|with)\s+(.+)$", r"\b(?:movies?|films?)\s+(?:with|containing)\s+(.+?)\s+in\s+(?:the\s+)?title\b", r"\b(?:called|named|titled)\s+(.+)$"]


SORT_WORDS = r"\b(latest|newest|recent)\b"
SORT_WORD_WITH_MEDIA = r"\b(new)\b"
IMDB_BOUNDS = [r"\b(\d(?:\.\d)?)\s*\+\s*(?:(?:in|on)\s+)?imdb\b", r"\bimdb\s*(\d(?:\.\d)?)\s*\+"]


def _quote(term: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in term)


def whole(term: str) -> str:
    """A pattern for a term with no ASCII letter or digit on either side."""
    return f"(?:^|[^a-z0-9]){_quote(term)}(?:$|[^a-z0-9])"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def explicit_title(key: Column) -> Column:
    """PL2: what the query names as a title, as tokens; '' for nothing."""
    text = F.coalesce(*[found(key, p) for p in TITLE_PATTERNS], F.lit(""))
    return F.array_join(ordered_tokens(text), " ")


def aliases_for(genres: list[str]) -> dict[str, str]:
    """The fixed aliases and every known genre by its own key."""
    return {**{" ".join(g.lower().replace("_", " ").split()): g for g in genres}, **GENRE_ALIASES}


def _any_alias(aliases: dict[str, str]) -> str:
    names = "|".join(_quote(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return f"(?:^|[^a-z0-9])({names})(?=$|[^a-z0-9])"


def _genres_of(aliases: dict[str, str]) -> Column:
    """alias -> its genre and those of aliases that stand whole within it."""
    pairs = []
    for a in aliases:
        inside = [b for b in aliases if a == b or re.search(whole(b), a)]
        pairs += [F.lit(a), F.array(*[F.lit(aliases[b]) for b in inside])]
    return F.create_map(*pairs)


def parse(queries: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """PL1/PL3/PL4: queries (.., text) with query_key, title_text, matched (aliases), genres,
    genre_mode, is_compound, year_min, year_max, rating_min, count_min and residual (the
    title terms left). All aliases are found by one pattern; each step is a column that the
    next ones refer to, so that no expression is repeated."""
    aliases = aliases or GENRE_ALIASES
    names = _any_alias(aliases)
    p = queries.withColumn("query_key", exact_key(F.col("text")))
    key = F.col("query_key")
    p = p.withColumn("title_text", explicit_title(key))
    all_of = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(names), 1))
    p = p.withColumn("matched", F.array_except(all_of(key), all_of(F.col("title_text"))))
    mapped = _genres_of(aliases)
    p = p.withColumn("genres", F.array_distinct(F.flatten(F.transform("matched", lambda a: mapped[a]))))
    compound = reduce(lambda x, y: x | y, [key.rlike(whole(c)) for c in COMPOUND_GENRES])
    p = p.withColumn("is_compound", compound)
    p = p.withColumn("genre_mode", F.when((F.size("genres") > 1) & (F.col("is_compound") | key.rlike(r"\band\b|&")), "all").otherwise("any"))
    number = lambda name, group=1: found(key, PATTERNS[name], group).cast("int")
    p = p.withColumns({"_decade": number("decade"), "_lo": number("range"), "_hi": number("range", 2), "_from": number("from"), "_after": number("after", 2) + F.when(found(key, PATTERNS["after"], 1) == "after", 1).otherwise(0), "_before": number("before") - 1})
    year_min = F.when(F.col("_decade").isNotNull(), F.col("_decade")).when(F.col("_hi").isNotNull(), F.col("_lo")).when(F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("_after"))
    year_max = F.when(F.col("_decade").isNotNull(), F.col("_decade") + 9).when(F.col("_hi").isNotNull(), F.col("_hi")).when(F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("_before"))
    left = F.regexp_replace(key, names, " ")
    for name in ("count", "range", "rating", "after", "before", "from", "decade"):
        left = F.regexp_replace(left, PATTERNS[name], " ")
    stop = F.array(*map(F.lit, NON_TITLE_TERMS))
    residual = F.filter(F.regexp_extract_all(left, F.lit("([a-z0-9]+)"), 1), lambda t: ~F.array_contains(stop, t) & ~t.rlike(r"^\d+\z"))
    out = p.withColumns({"year_min": year_min, "year_max": year_max, "rating_min": found(key, PATTERNS["rating"]).cast("double"), "count_min": found(key, PATTERNS["count"]).cast("bigint"), "residual": residual})
    return out.drop("_decade", "_lo", "_hi", "_from", "_after", "_before")


def has_metadata() -> Column:
    """Over the columns of parse()."""
    return (F.size("genres") > 0) | F.coalesce(*[F.col(c).cast("double") for c in ("year_min", "year_max", "rating_min", "count_min")]).isNotNull()


def sort_source(key: Column) -> Column:
    """PL15: the word that asks for the newest first, else null."""
    media = F.arrays_overlap(ordered_tokens(key), F.array(*map(F.lit, MEDIA_WORDS)))
    return F.coalesce(found(key, SORT_WORDS), F.when(media, found(key, SORT_WORD_WITH_MEDIA)))


def unsupported(key: Column) -> Column:
    """PL16: a bound on a rating the catalogue doesn't have, else null."""
    bound = F.coalesce(*[found(key, p) for p in IMDB_BOUNDS])
    return F.concat(F.lit("IMDb rating >= "), bound)
