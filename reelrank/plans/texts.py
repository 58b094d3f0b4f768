"""Queries of the text functions (TX*) over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.plans import catalogue as cat
from reelrank.plans import people as pe
from reelrank.plans.corrections import title_aliases
from reelrank.plans.people_sql import PEOPLE, slug
from reelrank.plans.sql import TITLES, edit, key
from reelrank.runtime import table

MINOR = "['" + "', '".join(tx.MINOR_WORDS) + "']"


def title_forms(spark, folder):
    """TX4, TX5, TX8, TX16-TX18, ETL12, SO7's keys: what a title becomes."""
    t = cat.titles(spark, folder)
    toks = tx.ordered_tokens(F.col("title"))
    return t.select("id", tx.exact_key(tx.exact_key(F.col("title"))).alias("planner_key"), tx.title_case(F.array_join(toks, " ")).alias("cased"), tx.initials(F.col("title")).alias("initials"), tx.phrase_shape(toks).alias("shape"), tx.slug(F.col("title")).alias("slug"), F.array_join(tx.ignored_tokens(F.col("title")), " ").alias("ignored"))


def term_replacement(spark, folder):
    """TX14, TX15: whether "the" or a title's last token stands whole in it, and the title with it replaced."""
    t = cat.titles(spark, folder).select("id", tx.edit_text(F.col("title")).alias("e")).where("e <> ''")
    last = F.substring_index("e", " ", -1)
    return t.select("id", tx.contains_term(F.col("e"), F.lit("the")).alias("has_the"), tx.contains_term(F.col("e"), F.left(last, F.greatest(F.length(last) - 1, F.lit(1)))).alias("has_stem"), tx.replace_term(F.col("e"), last, F.lit("end")).alias("replaced"))


def neighbour_swaps(spark, folder):
    """TX10-TX12: every alias of a title against itself with its second and third character
    swapped and with its last one missing."""
    a = title_aliases(cat.titles(spark, folder)).select("alias").distinct().where("length(alias) > 3")
    swapped = F.concat(F.left("alias", F.lit(1)), F.substring("alias", 3, 1), F.substring("alias", 2, 1), F.expr("substring(alias, 4)"))
    short = F.expr("left(alias, length(alias) - 1)")
    return a.select("alias", tx.is_adjacent_swap(F.col("alias"), swapped).alias("is_swap"), tx.correction_distance(F.col("alias"), swapped).alias("swap_distance"), tx.correction_distance(F.col("alias"), short).alias("short_distance"), F.levenshtein(swapped, short).alias("edit_distance"))


def person_keys(spark, folder):
    """TX13, TX27, TX29: names as they are compared, whether the last name alone is the same person, and the roles."""
    p = pe._people(spark, folder).withColumn("k", tx.person_key_udf("name"))
    toks = F.split("k", " ")
    label = tx.role_label(F.col("roles"))
    return p.select("entity_id", F.col("k").alias("person_key"), tx.same_person(toks, F.array(F.element_at(toks, -1))).alias("same_last"), tx.same_person(toks, F.array(F.lit("nobody"))).alias("same_nobody"), label.alias("roles"))


def unicode_forms(spark, folder):
    """TX19-TX22, TX24, TX25: titles in any script: normal form, tokens, graphemes, script."""
    t = cat.titles(spark, folder).select("id", "title", tx.unicode_text(F.col("title")).alias("n"))
    k = t.withColumn("k", tx.unicode_key(F.col("n")))
    return k.select("id", F.col("k").alias("unicode_key"), F.size(tx.unicode_tokens(F.col("n"))).alias("n_tokens"), F.size(tx.graphemes(F.col("k"))).alias("n_graphemes"), F.size(tx.grapheme_trigrams(tx.graphemes(F.col("k")))).alias("n_trigrams"), tx.script_of(F.col("title")).alias("script"))


def judged_titles(spark, folder):
    """TX26: titles as judges compare them; TX30: their revision."""
    return cat.titles(spark, folder).select("id", tx.judged_title_udf("title").alias("judged"), tx.revision(F.col("title")).alias("revision"))


def poster_urls(spark, folder):
    """TX28: a URL for paths of the usual form only."""
    path = F.concat(F.lit("/"), "imdbId", F.when(F.pmod("tmdbId", F.lit(3)) == 0, ".jpg").when(F.pmod("tmdbId", F.lit(3)) == 1, ".png").otherwise(".gif"))
    return table(spark, folder, "links").select("movieId", tx.poster_url(path, "w185", "https://images.example").alias("poster")).distinct()


_ALL = [title_forms, term_replacement, neighbour_swaps, person_keys, unicode_forms, judged_titles, poster_urls]
QUERIES = {f.__name__: f for f in _ALL}


def ukey(x: str) -> str:
    """unicode_key."""
    return f"array_to_string(regexp_extract_all(translate(lower(nfc_normalize({x})), '०१२३४५६७८९', '0123456789'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{M}}\\p{{N}}]*'), ' ')"


def judged(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '\\([^)]*\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"regexp_replace({plain}, '^(?:a|an|the)\\s+', '')"


def person_key(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


#: A letter with its marks, after the consonants that a virama joins to it.
GRAPHEME = "(?:[\\x{0915}-\\x{0939}\\x{0958}-\\x{095f}\\x{0978}-\\x{097f}]\\x{093c}?\\x{094d}\\x{200d}?)*\\P{M}\\p{M}*"
SCRIPT = "case when regexp_matches(title, '\\p{Devanagari}') and regexp_matches(title, '\\p{Latin}') then 'mixed' when regexp_matches(title, '\\p{Devanagari}') then 'devanagari' when regexp_matches(title, '\\p{Latin}') then 'latin' else 'other' end"
_ALIAS = f"""f as (select id, title, unnest([tedit, {edit(key("regexp_replace(title, '[\\s]+\\([^)]*\\).*$', '')"))}]) e from keyed),
al as (select distinct id, title, unnest([e, regexp_replace(e, '^(?:a|an|the)\\s+', '')]) alias from f), ok as (select id, title, alias from al where alias <> '')"""

ORACLE = {
    "title_forms": f"""with {TITLES}, t as (select id, title, tkey, regexp_extract_all(tkey, '[a-z0-9]+') ts from keyed)
select id, {key('tkey')} planner_key, array_to_string(list_transform(ts, lambda w, i: case when i > 1 and list_contains({MINOR}, w) then w else upper(w[1]) || substr(w, 2) end), ' ') cased,
  array_to_string(list_transform(ts, lambda w: w[1]), '') initials, len(ts) || ':' || array_to_string(list_transform(ts, lambda w: w[1]), '') shape, {slug('title')} slug,
  array_to_string(list_filter(list_distinct(ts), lambda w: false), ' ') || coalesce((select string_agg(w, ' ' order by p) from (select w, min(p) p from (select unnest(ts) w, generate_subscripts(ts, 1) p) where w in ('a','an','and','for','from','in','movie','movies','of','on','the','to','with') group by w)), '') ignored from t""",
    "term_replacement": f"""with {TITLES}, t as (select id, tedit e, list_extract(string_split(tedit, ' '), -1) l from keyed where tedit <> '')
select id, list_contains(string_split(e, ' '), 'the') has_the, list_contains(string_split(e, ' '), left(l, greatest(length(l) - 1, 1))) has_stem,
  array_to_string(list_transform(string_split(e, ' '), lambda w, i: case when i = list_position(string_split(e, ' '), l) then 'end' else w end), ' ') replaced from t""",
    "neighbour_swaps": f"""with {TITLES}, {_ALIAS}, a as (select distinct alias, alias[1] || alias[3] || alias[2] || substr(alias, 4) s, left(alias, length(alias) - 1) c from ok where length(alias) > 3)
select alias, alias <> s is_swap, (alias <> s)::int swap_distance, 1 short_distance, levenshtein(s, c)::int edit_distance from a""",
    "person_keys": f"""with {PEOPLE} select entity_id, {person_key('"name"')} person_key, true same_last, false same_nobody, array_to_string(list_filter([case when actor_movie_count > 0 then 'Actor' end, case when director_movie_count > 0 then 'Director' end], lambda r: r is not null), ' · ') roles from people""",
    "unicode_forms": f"""with {TITLES}, u0 as (select id, title, {ukey('title')} k from titles), u as (select *, regexp_extract_all(k, '{GRAPHEME}') g from u0)
select id, k unicode_key, case when k = '' then 0 else len(string_split(k, ' ')) end::int n_tokens, len(g)::int n_graphemes,
  case when k = '' then 0 else len(list_distinct(list_transform(range(1, len(g) + 1), lambda i: array_to_string((['^'] || g || ['$'])[i:i + 2], '')))) end::int n_trigrams, {SCRIPT} script from u""",
    "judged_titles": f"""with {TITLES} select id, {judged('title')} judged, left(sha256(title), 16) revision from titles""",
    "poster_urls": """select distinct "movieId", case when tmdbId % 3 in (0, 1) and regexp_matches(imdbId, '^[A-Za-z0-9_-]+$') then 'https://images.example/w185/' || imdbId || case when tmdbId % 3 = 0 then '.jpg' else '.png' end end poster from links""",
}
