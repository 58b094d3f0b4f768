"""SQL for the queries of corrections, typeahead, aliases, boosts and catalogue matches."""

from __future__ import annotations

from reelrank.operators.index import TRIGRAM_SHARE
from reelrank.operators.multilingual import GENRE_TERMS
from reelrank.plans.corrections import ACTOR, CONTROL_WORDS, CORRECTION_CANDIDATES, DIRECTOR, TITLE_CONTAINS, TITLE_CONTEXT
from reelrank.plans.people_sql import CREDITS, PEOPLE, _near
from reelrank.plans.records import sql_key
from reelrank.plans.sql import _TOKENS, RECORDS, SEARCHED, STOP, TITLES, _parsed, edit, evidence, fixed, grams, key, tokens
from reelrank.plans.sql import ORACLE as CATALOGUE
from reelrank.plans.texts import _ALIAS, SCRIPT, judged, person_key, ukey

CONTROL = "['" + "', '".join(CONTROL_WORDS) + "']"
ALL_QUERIES = f"""aq as (select {sql_key('_id')} query_id, min(text) t from queries where text is not null and {sql_key('_id')} is not null group by 1)"""
ROLE = f"case when regexp_matches(k, '{DIRECTOR}') then 'director' when regexp_matches(k, '{ACTOR}') then 'actor' end"
_round = lambda x, d: f"round({x}, {d})"


def _typeahead(queries: str, entities: str) -> str:
    """queries: (query_id, qk); entities: (id, n, nk, weight)."""
    return f"""{queries}, {entities}, h as (
  select query_id, id, n, weight, case when nk = qk then 4 when starts_with(nk, qk) then 3 else 2 end score from qy join es on contains(' ' || nk, ' ' || qk) where length(qk) >= 2)
select query_id, rank_no::int rank_no, id, score::int score from (select *, row_number() over (partition by query_id order by score desc, weight desc, n, id) rank_no from h) where rank_no <= 6"""


TARGETS = f"""ky as (select query_id, {key('t')} k from aq), kt as (select *, regexp_extract_all(k, '[a-z0-9]+') ts, coalesce(nullif(regexp_extract(k, '{TITLE_CONTEXT}', 1), ''), nullif(regexp_extract(k, '{TITLE_CONTAINS}', 1), '')) named from ky where k <> ''),
tg as (select query_id, named is not null ctx, case when named is not null then {key('named')} when len(ts) <= 8 then array_to_string(ts, ' ') end target from kt), tgt as (select * from tg where target <> '')"""

PHRASES = f"""{_ALIAS}, tk0 as (select distinct id, regexp_extract_all(regexp_replace(alias, '^(?:(?:a|an|the)\\s+)+', ''), '[a-z0-9]+') ts from ok),
pf as (select distinct id, array_to_string(ts[1:n], ' ') phrase from (select *, unnest([2, 3, 4]) n from tk0) where len(ts) >= n),
ph as (select phrase, count(*) movie_count from pf group by 1 having count(*) >= 2)"""


def _phrase_corrections() -> str:
    """pc: over tgx (query_id, target, ctx) and ph."""
    near = _near("x.a", "x.b")
    shape = lambda l: f"(len({l}) || ':' || array_to_string(list_transform({l}, lambda w: w[1]), ''))"
    return f"""t4 as (select *, regexp_extract_all({key('target')}, '[a-z0-9]+') tt from tgx), t5 as (select * from t4 where len(tt) between 2 and 4 and array_to_string(tt, ' ') not in (select phrase from ph)),
pp as (select *, string_split(phrase, ' ') pt from ph),
cj as (select query_id, target, phrase, movie_count, unnest(list_transform(range(1, len(tt) + 1), lambda i: struct_pack(a := tt[i], b := pt[i]))) x from t5 join pp on {shape('tt')} = {shape('pt')}),
cd as (select query_id, target, phrase, movie_count, sum(case when x.a = x.b then 0 when {near} then 1 else 9 end) d, count(*) filter (x.a <> x.b) moved from cj group by all),
ck as (select *, 1 - d::double / greatest(length(target), length(phrase)) sim from cd where d between 1 and 2),
cr2 as (select *, row_number() over w r, lead(d) over w nx from ck where sim >= 0.8::double window w as (partition by query_id order by d, movie_count desc, phrase)),
pc as (select query_id, target original, array_to_string(list_transform(string_split(phrase, ' '), lambda w, i: case when i > 1 and list_contains(['a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'], w) then w else upper(w[1]) || substr(w, 2) end), ' ') replacement,
  d::int distance, {_round('sim', 3)} confidence, case when moved > 1 then 'automatic' else 'suggest' end policy from cr2 where r = 1 and (nx is null or nx > d))"""


_SWAP = "length(target) = length(alias) and levenshtein(target, alias) = 2 and len(list_filter(range(1, length(target) + 1), lambda i: target[i] <> alias[i])) = 2 and len(list_filter(range(1, length(target)), lambda i: target[i] <> alias[i] and target[i] = alias[i + 1] and target[i + 1] = alias[i])) = 1"

ORACLE = {
    "typeahead_titles": "with " + _typeahead(f"{RECORDS}, {SEARCHED}, qy as (select query_id, {key('left(qkey, 6)')} qk from qt)", "es as (select id, title n, tkey nk, rating_count weight from rec)"),
    "typeahead_people": "with " + _typeahead(f"""{PEOPLE}, qy as (select distinct lower(left("name", 3)) query_id, {key('lower(left("name", 3))')} qk from people)""", f"""es as (select entity_id id, "name" n, {key('"name"')} nk, movie_count weight from people)"""),
    "partial_people": f"""with {PEOPLE}, w as (select distinct left(w, length(w) - 1) t from (select lower(list_extract(string_split("name", ' '), -1)) w from people) where length(w) >= 5),
q1 as (select t query_id, regexp_extract_all({key('t')}, '[a-z0-9]+') ts from w), q2 as (select query_id, list_filter(ts, lambda x: not list_contains({CONTROL}, x)) l from q1), q3 as (select query_id, l[1] token from q2 where len(l) = 1 and length(l[1]) >= 3),
pt as (select *, unnest(ts) part, generate_subscripts(ts, 1) pos from (select *, regexp_extract_all({key('"name"')}, '[a-z0-9]+') ts from people)),
h as (select query_id, token, entity_id, "name", movie_count, actor_movie_count, director_movie_count, arg_min(part, pos) part from q3 join pt on length(part) >= 3 and starts_with(part, token) group by all),
r as (select *, row_number() over (partition by query_id order by movie_count desc, "name", entity_id) rank_no from h where part = token or length(token) >= 4)
select query_id, rank_no::int rank_no, entity_id, case when director_movie_count > actor_movie_count then 'director' when actor_movie_count > 0 then 'actor' else 'director' end role, movie_count popularity from r where rank_no <= 5""",
    "control_corrections": f"""with {ALL_QUERIES}, k as (select query_id, regexp_extract_all({key("'latset ' || t")}, '[a-z0-9]+') ts from aq), tk as (select query_id, unnest(ts) token, generate_subscripts(ts, 1) pos from k),
tt as (select * from tk where length(token) >= 4 and not list_contains({CONTROL}, token)), cw as (select unnest({CONTROL}) term),
one as (select d.token, min(term) term from (select distinct token from tt) d join cw on {_near('d.token', 'term')} group by 1 having count(*) = 1)
select query_id, token original, term replacement from (select query_id, tt.token, term, row_number() over (partition by query_id order by pos) n from tt join one using (token)) where n = 1""",
    "alias_coverage": f"""with {TITLES}, a as (select id, title, {ukey('title')} k, 0 pos from titles union all select id, regexp_replace(title, '\\s*\\(\\d{{4}}\\)\\s*$', ''), {ukey("regexp_replace(title, '[[:space:]]*[(][0-9]{4}[)][[:space:]]*$', '')")}, 1 from titles),
f as (select id, k, arg_min(title, pos) title from a where k <> '' group by 1, 2), sc as (select id, k, {SCRIPT} script from f), pr as (select id, count(*) n, max((script in ('devanagari', 'mixed'))::int) d from sc group by 1)
select count(*) entities, coalesce(sum(n), 0)::bigint aliases, coalesce(sum(d), 0)::bigint with_devanagari from pr""",
    "alias_suggestions": f"""with {TITLES}, q as (
  select {sql_key('_id')} query_id, min(text) txt from queries where text is not null and try_cast(regexp_extract({sql_key('_id')}, '([0-9]+)$', 1) as bigint) % 20 = 0 group by 1
), qy as (select query_id, {ukey('left(txt, 5)')} qk from q where length(trim(left(txt, 5))) >= 2),
a as (select id, title, {ukey('title')} k, 0 pos from titles union all select id, t2, {ukey('t2')}, 1 from (select id, regexp_replace(title, '[[:space:]]*[(][0-9]{{4}}[)][[:space:]]*$', '') t2 from titles)),
f as (select id, k, arg_min(title, pos) title, min(pos) pos from a where k <> '' group by 1, 2),
h as (select query_id, id, title, pos, case when k = qk then 1.0::double else 0.9::double end score from qy join f on k = qk or (length(qk) >= 2 and starts_with(k, qk)) where qk <> ''),
b as (select query_id, id, max(score) score, arg_max(title, (score, -pos)) title from h group by 1, 2)
select query_id, rank_no::int rank_no, id entity_id, score from (select *, row_number() over (partition by query_id order by score desc, title, id) rank_no from b) where rank_no <= 8""",
    "fuzzy_phrase_join": f"""with {TITLES}, {PHRASES}, {ALL_QUERIES.replace('aq as', 'aq0 as')}, aq as (select * from aq0 union all select 'typo:' || phrase, left(phrase, length(phrase) - 1) from ph), {TARGETS}, tgx as (select * from tgt), {_phrase_corrections()}
select query_id, original, replacement, distance, policy from pc""",
    "title_corrections": f"""with {TITLES}, {PHRASES}, {ALL_QUERIES}, {TARGETS}, tgx as (select * from tgt where {edit(key('target'))} not in (select alias from ok)), {_phrase_corrections()},
rs as (select * from tgx where query_id not in (select query_id from pc)), qg as (select query_id, {grams(edit(key('target')))} g from rs), tgm as (select id, title, {grams('tedit')} g from keyed),
hg as (select query_id, id, title, n, count(*) m from (select query_id, len(g) n, unnest(g) gram from qg) join (select id, title, unnest(g) gram from tgm) using (gram) group by all),
nm as (select *, row_number() over (partition by query_id order by m desc, title, id) r from hg where m >= greatest(2, ceil(n * {TRIGRAM_SHARE}::double))),
pr as (select query_id, id, nm.title, target, ctx, alias from nm join ok using (id) join rs using (query_id) where r <= {CORRECTION_CANDIDATES}),
ds as (select *, case when {_SWAP} then 1 else levenshtein(target, alias) end d from pr), sm as (select *, 1 - d::double / greatest(length(target), length(alias)) sim from ds),
bs as (select query_id, id, title, target, ctx, max(sim) sim, arg_max(d, (sim, -d)) d from sm group by all),
tp as (select *, row_number() over w r, lead(sim) over w nx from bs window w as (partition by query_id order by sim desc, d, title, id)), n1 as (select *, len(regexp_extract_all({key('target')}, '[a-z0-9]+')) n from tp where r = 1)
select * from pc union all
select query_id, target, title, d::int, {_round('sim', 3)}, case when ctx or (n = 1 and length(target) >= 9) then 'automatic' else 'suggest' end from n1
where sim >= case when n = 1 then 0.8::double else 0.86::double end and d <= greatest(2, floor(length(target) * 0.15::double)) and (nx is null or sim - nx >= 0.08::double)""",
    "catalogue_match_band": f"""with {TITLES}, {CREDITS}, pe as (select movie_id id, list(distinct "name") people from cr group by 1), f as (select t.id, {judged('title')} k, "year" y, coalesce(people, []) people from titles t left join pe using (id)),
w as (select id cid, k, y + 1 y1, case when len(people) > 0 then list_min(people) end person from f where k <> ''),
j as (select cid, f.id fid, w.person, f.people from w join f using (k) where y1 is null or f.y is null or abs(y1 - f.y) <= 1),
toks as (select *, string_split({person_key('person')}, ' ') p1 from j)
select cid candidate_id, min(fid) film_id from toks where person is null or len(list_filter(people, lambda p: list_has_all(string_split({person_key('p')}, ' '), p1) or list_has_all(p1, string_split({person_key('p')}, ' ')))) > 0 group by 1""",
}

_BOOST_TOKENS = _TOKENS.replace(f"with {TITLES}", f"with {RECORDS}", 1)
ORACLE["person_popularity_boost"] = f"""{_BOOST_TOKENS}, {evidence('rec')},
b0 as (select query_id, id, {fixed('n_matched::double / n_tokens * 0.9::double', 6)} s, rating_count, evidence from hit join ev using (id)),
b1 as (select *, row_number() over (partition by query_id order by s desc, rating_count desc, id) base_rank from b0), b as (select * from b1 where base_rank <= 100),
{CREDITS}, c as (select distinct movie_id id, lower("name") p from cr), n as (select p, count(*) pop from c group by 1),
oq as (select distinct query_id, p, pop from b join c using (id) join n using (p)), top5 as (select * from (select *, row_number() over (partition by query_id order by pop desc, p) r from oq) where r <= 5),
hi as (select query_id, id, p, r, pop from b join c using (id) join top5 using (query_id, p)), fi as (select query_id, id, arg_min(p, r) p, arg_min(pop, r) pop from hi group by 1, 2), mo as (select query_id, max(pop) most from hi group by 1),
jb as (select b.*, p, pop, most from b left join fi using (query_id, id) left join mo using (query_id)),
ob as (select *, case when p is not null then row_number() over (partition by query_id, p order by base_rank) end occ from jb),
xb as (select *, case when p is null then 0.0 else {fixed(fixed('0.06::double * (pop::double / most) / sqrt(occ::double)', 6) + ' + ' + fixed('0.01::double * evidence', 6), 6)} end boost from ob),
yb as (select *, case when p is null then s else least(1.0, {fixed('s + boost', 6)}) end bs from xb)
select query_id, id, base_rank::int base_rank, boost, bs boosted_score, occ::int occurrence, p person_id, (row_number() over (partition by query_id order by bs desc, base_rank))::int rank_no from yb"""

_TERMS = ", ".join(f"('{g}:{i}', '{g}')" for g, t in GENRE_TERMS.items() for i in range(len(t)))
ORACLE["genre_grammar"] = f"""with {RECORDS}, {evidence('rec')}, sg as (select genre from genre_names where genre is not null), tm as (select * from (values {_TERMS}) v(query_id, genre) where genre in (select genre from sg)),
rq as (select query_id, [genre] wanted, 'any' m from tm union all select 'pair', ['Comedy', 'Drama'], 'all' where (select count(*) from sg where genre in ('Comedy', 'Drama')) = 2 union all select 'either', ['Horror', 'Thriller'], 'any' where (select count(*) from sg where genre in ('Horror', 'Thriller')) = 2),
j as (select *, len(list_intersect(wanted, genres))::double / greatest(len(wanted), len(genres), 1) fo from rq join ev on case when m = 'all' then len(list_intersect(wanted, genres)) = len(wanted) else list_has_any(wanted, genres) end),
s2 as (select query_id, id, rating_count, title, case when len(wanted) = 1 then {fixed(' + '.join(fixed(x, 6) for x in ('fo * 0.15::double', 'bayes / 5 * 0.55::double', 'evidence * 0.3::double')), 6)} else {fixed(' + '.join(fixed(x, 6) for x in ('fo * 0.55::double', 'bayes / 5 * 0.3::double', 'evidence * 0.15::double')), 6)} end score from j)
select query_id, rank_no::int rank_no, id, score from (select *, row_number() over (partition by query_id order by score desc, rating_count desc, title, id) rank_no from s2) where rank_no <= 24"""

_FIELDS = CATALOGUE["field_match_best"]
_WORDS = lambda x: f"list_filter(list_distinct(regexp_extract_all({x}, '[a-z0-9]+')), lambda w: not list_contains({STOP}, w))"
_BOUNDED = """(year_min is null or rec."year" >= year_min) and (year_max is null or rec."year" <= year_max) and (rating_min is null or rec.average_rating >= rating_min) and (count_min is null or rec.rating_count >= count_min)"""
#: cx: (query_id, id, source) of all search queries; pl: their plans.
_CANDIDATES = f"""{RECORDS}, {SEARCHED}, {_parsed('qk')}, pl as (
  select *, case when title_text <> '' then title_text when has_metadata and len(residual) = 0 then '' else qkey end tq, case when is_pure_genre then '' else qkey end fq from parsed),
ek as (select distinct id, unnest([{key('source_title')}, tkey, {key("regexp_replace(title, '(?i)^(a|an|the)[\\s]+', '')")}]) k from keyed),
tok as (select id, unnest({tokens('tkey')}) token from keyed), gt as (select id, unnest({grams('tedit')}) gram from keyed),
gq as (select query_id, len(g) n, unnest(g) gram from (select query_id, {grams(edit('tq'))} g from pl where not has_metadata and tq <> '')),
fd as ({_FIELDS}),
cx as (
  select query_id, id, 'exact' source from pl join ek on k = qkey where k <> ''
  union select query_id, id, 'token' from (select query_id, unnest({_WORDS('tq')}) token from pl where not has_metadata and tq <> '') join tok using (token)
  union select query_id, id, 'trigram' from (select query_id, id, n, count(*) m from gq join gt using (gram) group by all) where m >= greatest(2, ceil(n * {TRIGRAM_SHARE}::double))
  union select query_id, id, 'field' from fd semi join (select query_id from pl where not has_metadata and fq <> '') using (query_id)
  union select query_id, rec.id, 'metadata' from pl join rec on has_metadata and (len(pl.genres) = 0 or (genre_mode = 'all' and len(list_intersect(list_distinct(pl.genres), rec.genres)) = len(pl.genres)) or (genre_mode = 'any' and list_has_any(pl.genres, rec.genres))) and {_BOUNDED}
  union select query_id, id, 'fallback' from (select query_id, year_min, year_max, rating_min, count_min, unnest({_WORDS("array_to_string(aliases, ' ') || ' ' || tq")}) token from pl where len(genres) > 0 and not is_pure_genre) join tok using (token) join rec using (id) where {_BOUNDED})"""

ORACLE["search_candidates"] = f"""with {_CANDIDATES} select query_id, id, array_to_string(list_sort(list(source)), ',') sources, bool_or(source = 'exact') is_exact, bool_or(source = 'fallback') is_fallback from cx group by 1, 2"""
ORACLE["weighted_scores"] = f"""with {_CANDIDATES}, wc as (select query_id, id, bool_or(source = 'exact') ex from cx group by 1, 2 having not bool_or(source = 'fallback')),
wj as (select wc.*, tq, fq, {edit('tq')} qe, tedit, tkey, coalesce(score, 0.0) field_score from wc join pl using (query_id) join keyed using (id) left join fd using (query_id, id)),
wk as (select *, {_WORDS('tq')} qw, {tokens('tkey')} tw, {grams('qe')} qg, {grams('tedit')} tgr, regexp_replace(tkey, '^(a|an|the)[ ]+', '') bare from wj),
ws as (select *, case when len(qw) > 0 then {fixed('len(list_intersect(qw, tw))::double / len(qw)', 4)} else 0.0 end cov, case when len(qg) + len(tgr) > 0 then {fixed('2 * len(list_intersect(qg, tgr))::double / (len(qg) + len(tgr))', 4)} else 0.0 end di,
  case when greatest(length(qe), length(tedit)) > 0 then {fixed('1 - levenshtein(qe, tedit)::double / greatest(length(qe), length(tedit))', 4)} else 1.0 end ed from wk),
wt as (select *, {fixed(' + '.join(fixed(x, 6) for x in ('cov * 0.4::double', 'di * 0.3::double', 'ed * 0.3::double')), 6)} ts from ws)
select query_id, id, cov token_coverage, di dice, ed edit_similarity, ts title_score, field_score, case when ex then 1.0 when fq <> '' then {fixed('ts * 0.35::double + field_score * 0.65::double', 6)} else ts end combined_score,
  case when contains(tq, ' ') and (bare = tq or starts_with(bare, tq || ' ')) then 1 else 0 end phrase_priority from wt"""
