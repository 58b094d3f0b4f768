"""SQL for the queries of reelrank.plans.people."""

from __future__ import annotations

from reelrank.plans.records import SQL_WS, sql_key
from reelrank.plans.sql import EVAL, RECORDS, SEARCHED, TITLES, _parsed, edit, evidence, fixed, key

NAME = "([A-Z][a-z]+ [A-Z][a-z]+)"
CREDITS = f"""cr as (
  select {sql_key('"movieId"')} movie_id, 'actor' role, unnest(regexp_extract_all(text, '{NAME} plays', 1)) "name" from documents where {sql_key('"movieId"')} is not null
  union all select {sql_key('"movieId"')}, 'director', unnest(regexp_extract_all(text, '{NAME} directs', 1)) from documents where {sql_key('"movieId"')} is not null)"""


def slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({key(x)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


PEOPLE = f"""{CREDITS}, pm as (
  select 'person:name:' || {slug('"name"')} entity_id, movie_id, min("name") "name", max((role = 'actor')::int) acts, max((role = 'director')::int) directs from cr group by 1, 2
), people as (select entity_id, min("name") "name", count(*) movie_count, sum(acts)::bigint actor_movie_count, sum(directs)::bigint director_movie_count from pm group by 1)"""

_MEMBERS = lambda kind, rows: f"""select entity_id, min(n) "name", count(*) movie_count from (
  select '{kind}:' || {slug('n')} entity_id, id, min(n) n from ({rows}) where n is not null and n <> '' and id is not null group by 1, 2) group by 1"""  # noqa: E731

REVIEWS = f"""rv as (
  select {sql_key('"query-id"')} query_id, {sql_key('"corpus-id"')} doc_id, year(judged_at)::varchar reviewer_id, score grade, judged_at from provisional
  where {sql_key('"query-id"')} is not null and {sql_key('"corpus-id"')} is not null and score >= 0
), lt as (select query_id, doc_id, reviewer_id, grade, judged_at from (select *, row_number() over (partition by query_id, doc_id, reviewer_id order by judged_at desc nulls last, grade desc) n from rv) where n = 1
), js0 as (select query_id, doc_id, count(*) n, max(grade) hi, min(grade) lo, sum(grade) s from lt group by 1, 2
), js as (select query_id, doc_id, n n_reviews, n >= 2 and (hi - lo >= 2 or (hi = 3 and lo <= 1)) is_conflict, case when n >= 2 and not (hi - lo >= 2 or (hi = 3 and lo <= 1)) then floor(s::double / n + 0.5::double)::int end final_grade from js0)"""

POOL = f"""en as (select {sql_key('query_id')} query_id, max(run_at) hi, min(run_at) lo from tiny_run where {sql_key('query_id')} is not null and run_at is not null group by 1
), fl as (
  select query_id, run_at, hi, lo, {sql_key('r.doc_id')} doc_id, r.score score from (select e.query_id, t.run_at, e.hi, e.lo, unnest(t.results) r from tiny_run t join en e on e.query_id = {sql_key('t.query_id')} where t.run_at is not null)
  where {sql_key('r.doc_id')} is not null and r.score is not null and isfinite(r.score)
), ls as (
  select query_id, 'current' source, 0 no, doc_id, max(score) score from fl where run_at = hi group by all union all select query_id, 'baseline', 1, doc_id, max(score) from fl where run_at = lo group by all
  union all select {sql_key('"query-id"')}, 'judged', 2, {sql_key('"corpus-id"')}, max(score)::double from provisional where score >= 0 and {sql_key('"query-id"')} is not null and {sql_key('"corpus-id"')} is not null group by all
), nm as (select * from (select *, row_number() over (partition by query_id, source order by score desc, doc_id) rnk from ls) where rnk <= 10
), pl as (select query_id, place, doc_id, n_sources from (
  select query_id, doc_id, n_sources, row_number() over (partition by query_id order by turn, doc_id) place from (select query_id, doc_id, min(rnk * 4 + no) turn, count(distinct source) n_sources from nm group by 1, 2)) where place <= 40)"""

_TRIALS = f"""tr as (
  select {sql_key('query_id')} case_id, (len(coalesce(results, [])) >= 10)::int passed, strftime(run_at, '%Y-%m') "month",
    case when regexp_matches({sql_key('query_id')}, '^q[0-9]{{8}}$') then 'regular' else 'other' end kind from tiny_run where {sql_key('query_id')} is not null and run_at is not null)"""

_BASE_EVAL = EVAL.replace("max(run_at) run_at from tiny_run", "min(run_at) run_at from tiny_run where run_at is not null")
_NOW_EVAL = EVAL.replace("max(run_at) run_at from tiny_run", "max(run_at) run_at from tiny_run where run_at is not null")


def _near(a: str, b: str) -> str:
    """Levenshtein distance 1, or one swap of neighbours, of ASCII words."""
    swap = f"(length({a}) = length({b}) and len(list_filter(range(1, length({a}) + 1), lambda i: {a}[i] <> {b}[i])) = 2 and len(list_filter(range(1, length({a})), lambda i: {a}[i] <> {b}[i] and {a}[i] = {b}[i + 1] and {a}[i + 1] = {b}[i])) = 1)"
    return f"(levenshtein({a}, {b}) = 1 or {swap})"


_SCORE = lambda a, b, c: fixed(" + ".join(fixed(f"{x} * {w}::double", 6) for x, w in (("focus", a), ("(bayes / 5)", b), ("evidence", c))), 6)

ORACLE = {
    "judgment_pool": f"""with {RECORDS}, {SEARCHED}, {_parsed('qk')}, j as (
  select query_id, rec.id, rating_count, row_number() over (partition by query_id order by average_rating desc nulls last, rating_count desc, title, rec.id) rank_no from parsed p join rec on p.has_metadata
  and (len(p.genres) = 0 or (p.genre_mode = 'all' and len(list_intersect(list_distinct(p.genres), rec.genres)) = len(p.genres)) or (p.genre_mode = 'any' and list_has_any(p.genres, rec.genres)))
  and (year_min is null or coalesce(rec."year", 0) >= year_min) and (year_max is null or coalesce(rec."year", 0) <= year_max) and (rating_min is null or rec.average_rating >= rating_min) and (count_min is null or rec.rating_count >= count_min))
select query_id, rank_no::int rank_no, id, rating_count from j where rank_no <= 20""",
    "genre_evidence": f"""with {RECORDS}, {evidence('rec')}, h as (select *, 1.0::double / greatest(1, len(genres)) focus, coalesce(average_rating, 0.0) av, case when eligible then coalesce(average_rating, 0.0) else 0.0 end ea, unnest(list_distinct(genres)) genre from ev),
sx as (select genre, id, title, rating_count, 0 strategy, av score, 0.0 average from h union all select genre, id, title, rating_count, 1, {_SCORE(0.15, 0.55, 0.3)}, ea from h
  union all select genre, id, title, rating_count, 2, {_SCORE(0.1, 0.2, 0.7)}, ea from h union all select genre, id, title, rating_count, 3, {_SCORE(0.1, 0.8, 0.1)}, ea from h),
t as (select *, row_number() over (partition by genre, strategy order by score desc, average desc, rating_count desc, title, id) rank_no from sx)
select genre, id, min(strategy)::int first_strategy, min(rank_no)::int best_rank, count(*) n_strategies from t where rank_no <= 10 group by 1, 2""",
    "entity_registry_people": f"""with {PEOPLE} select *, array_to_string(list_filter([case when actor_movie_count > 0 then 'actor' end, case when director_movie_count > 0 then 'director' end], lambda r: r is not null), ',') roles from people""",
    "entity_registry_genres": f"with {TITLES} {_MEMBERS('genre', 'select id, trim(g, ' + SQL_WS + ') n from (select id, unnest(genres) g from titles)')}",
    "entity_registry_tags": _MEMBERS("tag", f"""select {sql_key('"movieId"')} id, trim(tag, {SQL_WS}) n from tags"""),
    "entity_page": f"""with {PEOPLE}, k as (select entity_id, "name", actor_movie_count movie_count from people where actor_movie_count > 0)
select entity_id, "name", movie_count, (select count(*) from k) total, ((select count(*) from k) + 19) // 20 pages from k order by movie_count desc, "name", entity_id limit 20 offset 20""",
    "entity_related": f"""with {RECORDS}, e as (select distinct unnest(genres) entity_id, id from rec)
select entity_id, rank_no::int rank_no, id, rating_count from (select e.*, rating_count, row_number() over (partition by entity_id order by rating_count desc, title, id) rank_no from e join rec using (id)) where rank_no <= 20""",
    "exact_people": f"""with {PEOPLE}, aq as (
  select {sql_key('_id')} query_id, min(text) t from queries where text is not null and {sql_key('_id')} is not null group by 1 union all select entity_id, 'films with ' || "name" || ' after 1990' from people
), tk as (select query_id, {key('t')} k, regexp_extract_all({key('t')}, '[a-z0-9]+') ts from aq), rl as (
  select *, case when regexp_matches(k, '\\b(?:directed\\s+by|director)\\b') then 'director' when regexp_matches(k, '\\b(?:starring|featuring|with|actor|actress|cast)\\b') then 'actor' end role from tk
), w as (select query_id, role, s start, unnest([2, 3, 4]) size, ts from (select *, unnest(range(0, len(ts))) s from rl)),
ph as (select query_id, role, start::int start, array_to_string(ts[start + 1:start + size], ' ') phrase from w where start + size <= len(ts)),
h as (select ph.*, p.*, array_to_string(regexp_extract_all({key('p."name"')}, '[a-z0-9]+'), ' ') full_name from ph join people p on array_to_string(regexp_extract_all({key('p."name"')}, '[a-z0-9]+'), ' ') = ph.phrase
  where role is null or (role = 'actor' and actor_movie_count > 0) or (role = 'director' and director_movie_count > 0))
select query_id, phrase, start, entity_id, case when role is not null then role when director_movie_count > actor_movie_count then 'director' when actor_movie_count > 0 then 'actor' else 'director' end role from (
  select *, row_number() over (partition by query_id, phrase, start order by movie_count desc, entity_id) n from h) where n = 1""",
    "fuzzy_person_join": f"""with {PEOPLE}, q0 as (select entity_id query_id, left('films with ' || lower("name"), length('films with ' || "name") - 1) t from people),
tk as (select query_id, regexp_extract_all({key('t')}, '[a-z0-9]+') ts from q0),
w as (select query_id, s start, unnest([2, 3, 4]) size, ts from (select *, unnest(range(0, len(ts))) s from tk)),
ph as (select query_id, start, size, array_to_string(ts[start + 1:start + size], ' ') phrase from w where start + size <= len(ts)),
nm as (select *, {key('"name"')} f from people where actor_movie_count > 0),
known as (select distinct query_id from ph join nm on f = phrase),
c as (
  select ph.query_id, ph.start, phrase, nm.*, levenshtein(phrase, f) d, 1 - levenshtein(phrase, f)::double / greatest(length(phrase), length(f)) sim from ph join nm
    on size = len(string_split(f, ' ')) and phrase <> f and abs(length(phrase) - length(f)) <= 3 and left(phrase, 1) = left(f, 1)
    and array_to_string(list_transform(string_split(phrase, ' '), lambda x: x[1]), '') = array_to_string(list_transform(string_split(f, ' '), lambda x: x[1]), '')
  where ph.query_id not in (select query_id from known)),
ok as (select * from c where d <= least(3, greatest(1, floor(length(f) * 0.2::double))) and sim >= 0.82::double)
select query_id, phrase original, entity_id found_id, d::int distance, 'suggest' policy from (select *, row_number() over (partition by query_id order by sim desc, d, movie_count desc, entity_id, start) n from ok) where n = 1""",
    "genre_corrections": f"""with al as (
  select trim({key('genre')}) term, genre from genre_names where genre is not null union select * from (values ('action','Action'),('adventure','Adventure'),('animated','Animation'),('animation','Animation'),('comedy','Comedy'),('crime','Crime'),('documentary','Documentary'),('drama','Drama'),('fantasy','Fantasy'),('horror','Horror'),('musical','Musical'),('mystery','Mystery'),('romance','Romance'),('romantic','Romance'),('sci-fi','Sci-Fi'),('sci fi','Sci-Fi'),('science fiction','Sci-Fi'),('thriller','Thriller'),('war','War'),('western','Western'))
), fx as (select * from (values ('action'),('adventure'),('animated'),('animation'),('comedy'),('crime'),('documentary'),('drama'),('fantasy'),('horror'),('musical'),('mystery'),('romance'),('romantic'),('thriller'),('war'),('western')) v(term)
), t1 as (select distinct term, genre from al where len(regexp_extract_all(term, '[a-z0-9]+')) = 1),
aq as (select {sql_key('_id')} query_id, min(text) t from queries where text is not null and {sql_key('_id')} is not null group by 1
  union all select 'typo:' || {key('genre')}, left({key('genre')}, length({key('genre')}) - 1) || ' movies' from genre_names where genre is not null),
kq as (select query_id, {key('t')} k from aq), cq as (
  select *, regexp_extract_all(k, '[a-z0-9]+') ts from kq), fq as (
  select * from cq where list_has_any(ts, ['movie', 'movies', 'film', 'films']) or regexp_matches(k, '\\b(?:genre|after|before|since|latest|newest|recent)\\b')),
tk as (select query_id, unnest(ts) token, generate_subscripts(ts, 1) pos from fq), tt as (select * from tk where length(token) >= 4 and token not in (select term from fx)),
nr as (select d.token, term, genre from (select distinct token from tt) d join t1 on {_near('d.token', 'term')}),
one as (select token, min(term) term from nr group by 1 having count(distinct genre) = 1)
select query_id, token original, term replacement from (select query_id, tt.token, term, row_number() over (partition by query_id order by pos) n from tt join one using (token)) where n = 1""",
    "recurring_title_phrases": f"""with {TITLES}, f as (select id, unnest([tedit, {edit(key("regexp_replace(title, '[\\s]+\\([^)]*\\).*$', '')"))}]) e from keyed),
t as (select distinct id, regexp_extract_all(regexp_replace(regexp_replace(e, '^(?:a|an|the)[\\s]+', ''), '^(?:(?:a|an|the)[\\s]+)+', ''), '[a-z0-9]+') ts from f where e <> '' union select distinct id, regexp_extract_all(regexp_replace(e, '^(?:(?:a|an|the)[\\s]+)+', ''), '[a-z0-9]+') from f where e <> ''),
p as (select distinct id, array_to_string(ts[1:k], ' ') phrase from (select *, unnest([2, 3, 4]) k from t) where len(ts) >= k)
select phrase, count(*) movie_count from p group by 1 having count(*) >= 2""",
    "review_keep_last": f"with {REVIEWS} select query_id, doc_id, reviewer_id, grade, strftime(judged_at, '%Y-%m-%d %H:%M:%S') reviewed_at from lt",
    "judgment_status": f"with {REVIEWS} select * from js",
    "pool_round_robin": f"with {POOL} select query_id, place::int place, doc_id, n_sources from pl",
    "review_progress": f"""with {POOL}, {REVIEWS} select query_id, count(*) pool_size, count(*) filter (n_reviews >= 2) twice_reviewed, count(*) filter (is_conflict and final_grade is null) conflicts, count(*) filter (final_grade is not null) finalized from pl left join js using (query_id, doc_id) group by 1""",
    "baseline_compare": f"""with b0 as (with {_BASE_EVAL} select * from per), c0 as (with {_NOW_EVAL} select * from per),
d as (select query_id, c.precision_at_k - b.precision_at_k p, c.reciprocal_rank - b.reciprocal_rank r, c.ndcg_at_k - b.ndcg_at_k n from b0 b left join c0 c using (query_id))
select query_id, {fixed('p', 6)} delta_precision_at_k, {fixed('r', 6)} delta_reciprocal_rank, {fixed('n', 6)} delta_ndcg_at_k, coalesce(p < -0.0001 or r < -0.0001 or n < -0.0001, true) is_worse from d""",
    "case_summary_grouping_sets": f'with {_TRIALS} select "month", kind, count(*) trials, sum(passed)::bigint passed from tr group by grouping sets ((), ("month"), (kind))',
    "case_pass_rates": f"""with {_TRIALS}, c as (select case_id, avg(passed::double) rate, count(*) n from tr group by 1), s as (select count(*) cases, sum(n)::bigint trials, avg(rate) a, stddev_samp(rate) d, count(*) filter (rate > 0 and rate < 1) flaky from c)
select cases, trials, {fixed('a', 6)} pass_rate, {fixed('d', 6)} deviation, {fixed('greatest(0.0::double, a - 1.96::double * coalesce(d, 0) / sqrt(cases))', 6)} low, {fixed('least(1.0::double, a + 1.96::double * coalesce(d, 0) / sqrt(cases))', 6)} high, flaky from s""",
    "hash_shuffle_sample": f"""with m as (select distinct {sql_key('"movieId"')} id from movies where {sql_key('"movieId"')} is not null)
select id, left(sha256(id), 16) revision from m where ('0x' || left(sha256('calibration' || chr(0) || id), 8))::bigint % 4 = 0""",
    "hash_shuffle_every_fourth": f"""with m as (select distinct {sql_key('"movieId"')} id from movies where {sql_key('"movieId"')} is not null)
select id, left(sha256(id), 16) revision from (select id, row_number() over (order by sha256('calibration' || chr(0) || id)) n from m) where n % 4 = 1""",
}
