"""SQL for the queries of reelrank.plans.catalogue: the same results by plain statements."""

from __future__ import annotations

from reelrank.functions.text import QUERY_STOP_WORDS
from reelrank.operators.evaluation import METRICS, THRESHOLDS
from reelrank.operators.index import FIELD_ORDER, FIELD_WEIGHTS
from reelrank.plans.records import SQL_WS, sql_key

SPACES = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
STOP = "[" + ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS) + "]"
MOVED = r"(?is)^(.*),\s+(A|An|The)\z"
YEAR = r"(?s)^(.*?)\s*\((\d{4})\)\s*\z"


def key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[_–—]', ' ', 'g'), '{SPACES}', ' ', 'g'))"


def shown(x: str) -> str:
    return f"case when regexp_matches({x}, '{MOVED}') then regexp_extract({x}, '{MOVED}', 2) || ' ' || regexp_extract({x}, '{MOVED}', 1) else {x} end"


def fixed(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5::double)::double / 1e{digits})"


def tokens(k: str) -> str:
    """Distinct tokens of a key."""
    return f"list_distinct(regexp_extract_all({k}, '[a-z0-9]+'))"


def edit(k: str) -> str:
    return f"trim(regexp_replace({k}, '[^a-z0-9]+', ' ', 'g'))"


def grams(e: str) -> str:
    return f"case when {e} = '' then []::varchar[] else list_distinct([substr('^' || {e} || '$', i, 3) for i in range(1, length({e}) + 1)]) end"


TITLES = f"""m as (
  select {sql_key('"movieId"')} id, min(title) t, min(genres) g from movies where {sql_key('"movieId"')} is not null group by 1
), y as (
  select *, nullif(regexp_extract(coalesce(t, ''), '{YEAR}', 2), '') y4 from m
), s as (
  select id, case when y4 is not null then trim(regexp_extract(t, '{YEAR}', 1)) else trim(coalesce(t, '')) end source_title, y4::int "year",
    case when g is null or trim(g) in ('', '(no genres listed)') then []::varchar[] else string_split(g, '|') end genres from y
), titles as (select id, source_title, {shown('source_title')} title, "year", genres from s),
keyed as (select *, {key('title')} tkey, {edit(key('title'))} tedit from titles)"""

RATED = f"""ra as (
  select {sql_key('"movieId"')} id, sum(rating) / count(*) average_rating, count(*) rating_count from ratings
  where rating is not null and not isnan(rating) and {sql_key('"movieId"')} is not null group by 1)"""

RECORDS = f"""{TITLES}, {RATED}, rec as (
  select t.*, {fixed("r.average_rating", 3)} average_rating, coalesce(r.rating_count, 0) rating_count from keyed t left join ra r using (id))"""


def evidence(rows: str) -> str:
    return f"""st as (
  select coalesce(sum(average_rating * rating_count) filter (rating_count >= 5 and average_rating is not null) / nullif(sum(rating_count) filter (rating_count >= 5 and average_rating is not null), 0), 0.0) mean,
    greatest(coalesce(max(rating_count), 1), 1) top from {rows}
), ev as (
  select r.*, coalesce(rating_count >= 5 and average_rating is not null, false) eligible,
    case when rating_count >= 5 and average_rating is not null then (rating_count::double * average_rating + 20 * mean) / (rating_count::double + 20) else 0.0 end bayes,
    ln(1 + rating_count::double) / ln(1 + top::double) evidence from {rows} r, st)"""


SEARCHED = f"""q as (
  select {sql_key('_id')} query_id, min(text) txt from queries
  where text is not null and try_cast(regexp_extract({sql_key('_id')}, '([0-9]+)$', 1) as bigint) % 20 = 0 group by 1
), qk as (select query_id, {key('txt')} qkey from q),
qt as (select *, list_filter({tokens('qkey')}, lambda x: not list_contains({STOP}, x)) ts, {edit('qkey')} qedit from qk)"""


def _discovery(compound: bool) -> str:
    wanted = "[genre, 'Drama']" if compound else "[genre]"
    w = (0.55, 0.3, 0.15) if compound else (0.15, 0.55, 0.3)
    keep = "where genre <> 'Drama' and list_contains(genres, 'Drama')" if compound else ""
    focus = f"len(list_intersect({wanted}, genres))::double / greatest(len({wanted}), len(genres), 1)"
    score = fixed(" + ".join(fixed(f"{s} * {v}::double", 6) for s, v in ((f"({focus})", w[0]), ("(bayes / 5)", w[1]), ("evidence", w[2]))), 6)
    return f"""with {RECORDS}, {evidence('rec')},
h as (select *, unnest(list_distinct(genres)) genre from ev),
s2 as (select *, {score} score from h {keep})
select genre, rank_no::int rank_no, id, score from (
  select *, row_number() over (partition by genre order by score desc, case when eligible then average_rating else 0.0 end desc, rating_count desc, title, id) rank_no from s2) where rank_no <= 12"""


def _genre_pairs() -> str:
    score = fixed(" + ".join(fixed(f"{s} * {v}::double", 6) for s, v in (("(2::double / greatest(2, len(genres)))", 0.55), ("(bayes / 5)", 0.3), ("evidence", 0.15))), 6)
    return f"""with {RECORDS}, {evidence('rec')},
h as (select *, unnest(list_distinct(genres)) genre from ev),
b as (select id, unnest(list_distinct(genres)) other from ev),
s2 as (select h.*, other, {score} score from h join b using (id) where other > genre)
select genre, other, rank_no::int rank_no, id, score from (
  select *, row_number() over (partition by genre, other order by score desc, case when eligible then average_rating else 0.0 end desc, rating_count desc, title, id) rank_no from s2) where rank_no <= 12"""


_TOKENS = f"""with {TITLES}, {SEARCHED},
tp as (select id, unnest({tokens('tkey')}) token from keyed),
qx as (select query_id, len(ts) n_tokens, unnest(ts) token from qt),
hit as (select query_id, id, n_tokens::int n_tokens, count(*) n_matched from qx join tp using (token) group by all)"""

_ALIASES = """al as (
  select lower(genre) a, genre from genre_names where genre is not null union
  select * from (values ('action','Action'),('adventure','Adventure'),('animated','Animation'),('animation','Animation'),('comedy','Comedy'),('crime','Crime'),('documentary','Documentary'),('drama','Drama'),('fantasy','Fantasy'),('horror','Horror'),('musical','Musical'),('mystery','Mystery'),('romance','Romance'),('romantic','Romance'),('sci-fi','Sci-Fi'),('sci fi','Sci-Fi'),('science fiction','Sci-Fi'),('thriller','Thriller'),('war','War'),('western','Western')))"""


def _parsed(source: str) -> str:
    """parsed: what metadata says of the rows (query_id, qkey) of `source`."""
    y = "((?:19|20)\\d{2})"
    ex = lambda p, g=1: f"nullif(regexp_extract(qkey, '{p}', {g}), '')"
    rating = "\\b(?:rated|rating)\\s+(?:above|over|at least)\\s+(\\d(?:\\.\\d)?)\\b"
    count = "\\b(?:with\\s+)?(?:at least|minimum(?:\\s+of)?|no fewer than)\\s+(\\d+)\\s+(?:user\\s+)?ratings?\\b"
    stop = "['" + "', '".join("a an and at about film films for from in is movie movies of or the which with featuring starring rated rating ratings above over least after before since minimum no fewer than user".split()) + "']"
    title = ", ".join(ex(p) for p in ("\\btitle\\s+(?:contains?|containing|has|with)\\s+(.+)$", "\\b(?:movies?|films?)\\s+(?:with|containing)\\s+(.+?)\\s+in\\s+(?:the\\s+)?title\\b", "\\b(?:called|named|titled)\\s+(.+)$"))
    whole = "'(^|[^a-z0-9])' || regexp_escape(a) || '($|[^a-z0-9])'"
    return f"""{_ALIASES}, tt as (
  select query_id, qkey, array_to_string(regexp_extract_all(coalesce({title}, ''), '[a-z0-9]+'), ' ') title_text from {source}
), hits as (
  select query_id, list(distinct genre) genres, list(distinct a) aliases from tt join al on regexp_matches(qkey, {whole}) and not regexp_matches(title_text, {whole}) group by 1
), longest as (
  select string_agg(regexp_escape(a), '|' order by length(a) desc, a) alias_re from (select distinct a from al)
), py as (
  select tt.*, coalesce(h.genres, []::varchar[]) genres, coalesce(h.aliases, []::varchar[]) aliases, {ex(chr(92) + 'b((?:19|20)' + chr(92) + 'd0)s' + chr(92) + 'b')}::int dec,
    {ex(f'{chr(92)}bfrom{chr(92)}s+{y}{chr(92)}s+to{chr(92)}s+{y}{chr(92)}b')}::int lo, {ex(f'{chr(92)}bfrom{chr(92)}s+{y}{chr(92)}s+to{chr(92)}s+{y}{chr(92)}b', 2)}::int hi, {ex(f'{chr(92)}bfrom{chr(92)}s+{y}{chr(92)}b')}::int fr,
    {ex(f'{chr(92)}b(after|since){chr(92)}s+{y}{chr(92)}b', 2)}::int + case when {ex(f'{chr(92)}b(after|since){chr(92)}s+{y}{chr(92)}b')} = 'after' then 1 else 0 end aft, {ex(f'{chr(92)}bbefore{chr(92)}s+{y}{chr(92)}b')}::int - 1 bef,
    {ex(rating)}::double rating_min, {ex(count)}::bigint count_min,
    regexp_matches(qkey, '(^|[^a-z0-9])romantic comedy($|[^a-z0-9])') compound
  from tt left join hits h using (query_id)
), pr as (
  select *, coalesce(dec, case when hi is not null then lo end, fr, aft) year_min, coalesce(dec + 9, hi, fr, bef) year_max,
    case when len(genres) > 1 and (compound or regexp_matches(qkey, '\\band\\b|&')) then 'all' else 'any' end genre_mode,
    list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(replace(qkey || ' ', ' ', '  '), '(^|[^a-z0-9])(' || replace(alias_re, ' ', '  ') || ')[^a-z0-9]', ' ', 'g'),
      ' +', ' ', 'g'), '{count}', ' ', 'g'), '\\bfrom\\s+{y}\\s+to\\s+{y}\\b', ' ', 'g'), '{rating}', ' ', 'g'), '\\b(after|since)\\s+{y}\\b', ' ', 'g'), '\\b(before|from)\\s+{y}\\b', ' ', 'g'), '\\b((?:19|20)\\d0)s\\b', ' ', 'g'), '[a-z0-9]+'),
      lambda x: not list_contains({stop}, x) and not regexp_matches(x, '^[0-9]+$')) residual
  from py, longest
), parsed as (
  select *, len(genres) > 0 or year_min is not null or year_max is not null or rating_min is not null or count_min is not null has_metadata,
    len(genres) > 0 and (len(genres) = 1 or compound) and year_min is null and year_max is null and rating_min is null and count_min is null and len(residual) = 0 and title_text = '' is_pure_genre from pr)"""


_FIELD_WEIGHT = "case field " + " ".join(f"when '{k}' then {v}::double" for k, v in FIELD_WEIGHTS.items()) + " end"
_FIELD_PLACE = "case field " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(FIELD_ORDER)) + " end"

_TAGS = f"""tl as (
  select id, low, min(struct_pack(a := "timestamp", b := "userId", c := tag, t := t)).t t from (
    select {sql_key('"movieId"')} id, trim(tag, {SQL_WS}) t, lower(trim(tag, {SQL_WS})) low, "timestamp", "userId", tag from tags)
  where id is not null and t is not null and t <> '' group by 1, 2)"""

EVAL = f"""j as (
  select {sql_key('"query-id"')} query_id, {sql_key('"corpus-id"')} doc_id, max(score) grade from provisional
  where score >= 0 and {sql_key('"query-id"')} is not null and {sql_key('"corpus-id"')} is not null group by 1, 2
), last_at as (select {sql_key('query_id')} query_id, max(run_at) run_at from tiny_run group by 1),
lr as (
  select distinct {sql_key('t.query_id')} query_id, latency_ms, candidate_ids, results from tiny_run t join last_at l on l.query_id = {sql_key('t.query_id')} and l.run_at = t.run_at
), px as (select query_id, generate_subscripts(results, 1) p, unnest(results) r from lr),
pf as (select query_id, {sql_key('r.doc_id')} doc_id, min(p) p from px where {sql_key('r.doc_id')} is not null group by 1, 2),
rk as (select query_id, doc_id, row_number() over (partition by query_id order by p) rnk from pf),
idl as (select *, row_number() over (partition by query_id order by grade desc, doc_id) i from j),
b as (select query_id, count(*) filter (grade > 0) relevant, count(*) filter (grade >= 2) strong, sum(case when i <= 10 then (2.0::double ** grade - 1) / log2(i + 1) else 0 end) ideal from idl group by 1),
l as (select r.*, j.grade from rk r left join j using (query_id, doc_id)),
p as (
  select query_id, count(*) retrieved, count(*) filter (rnk <= 10 and grade >= 1) hits, count(*) filter (rnk <= 100 and grade >= 1) deep, count(*) filter (rnk <= 10 and grade >= 2) hits2, count(*) filter (rnk <= 100 and grade >= 2) deep2,
    min(rnk) filter (grade >= 1) first1, min(rnk) filter (grade >= 2) first2, min(rnk) filter (grade >= 3) first3, count(*) filter (rnk <= 10 and grade is not null) judged,
    sum(case when rnk <= 10 then (2.0::double ** coalesce(grade, 0) - 1) / log2(rnk + 1) else 0 end) actual from l group by 1
), cd as (select distinct query_id, {sql_key('c')} doc_id from (select query_id, unnest(candidate_ids) c from lr)),
ch as (select j.query_id, count(*) filter (grade > 0) c1, count(*) filter (grade >= 2) c2 from j semi join cd on cd.query_id = j.query_id and cd.doc_id = j.doc_id group by 1),
ctg as (select {sql_key('_id')} query_id, metadata.category category from queries),
per as (
  select b.query_id, coalesce(g.category, 'uncategorized') category,
    case when lr.candidate_ids is not null then coalesce(coalesce(c1, 0) / nullif(relevant, 0)::double, 0.0) end candidate_recall,
    coalesce(hits, 0) / 10.0::double precision_at_k, coalesce(coalesce(hits, 0) / nullif(relevant, 0)::double, 0.0) recall_at_k, coalesce(coalesce(deep, 0) / nullif(relevant, 0)::double, 0.0) recall_at_recall_k,
    coalesce(1.0::double / first1, 0.0) reciprocal_rank, coalesce(coalesce(actual, 0.0) / nullif(ideal, 0.0), 0.0) ndcg_at_k,
    case when lr.candidate_ids is not null then coalesce(coalesce(c2, 0) / nullif(strong, 0)::double, 0.0) end candidate_recall_grade_2,
    coalesce(hits2, 0) / 10.0::double precision_at_k_grade_2, coalesce(coalesce(hits2, 0) / nullif(strong, 0)::double, 0.0) recall_at_k_grade_2, coalesce(coalesce(deep2, 0) / nullif(strong, 0)::double, 0.0) recall_at_recall_k_grade_2,
    coalesce(1.0::double / first2, 0.0) reciprocal_rank_grade_2, coalesce(coalesce(judged, 0) / nullif(least(coalesce(retrieved, 0), 10), 0)::double, 0.0) judged_at_k,
    first3::int first_grade_3_rank, first2::int first_grade_2_rank, coalesce(retrieved, 0) retrieved, relevant, case when not isnan(latency_ms) then latency_ms end latency_ms, lr.query_id is null is_missing
  from b left join p using (query_id) left join ch using (query_id) left join lr using (query_id) left join ctg g using (query_id))"""

_MEAN = {"reciprocal_rank": "mrr", "reciprocal_rank_grade_2": "mrr_grade_2"}
_SUMMARY = (
    "select count(*) evaluated_queries, "
    + ", ".join(f"{fixed(f'avg({m})', 6)} {_MEAN.get(m, m)}" for m in METRICS)
    + f", {fixed('min(judged_at_k)', 6)} minimum_judged_at_k, {fixed('avg(latency_ms)', 6)} mean_latency_ms, quantile_disc(latency_ms, 0.5) p50_latency_ms, quantile_disc(latency_ms, 0.95) p95_latency_ms, count(*) filter (is_missing) missing_queries from per"
)

ORACLE = {
    "genre_discovery_topk": _discovery(False),
    "compound_genre_topk": _discovery(True),
    "compound_genre_pairs_topk": _genre_pairs(),
    "rating_stats": f"""with {RATED}, {evidence('ra')}
select id, average_rating, rating_count, eligible, {fixed('bayes', 6)} bayesian_rating, {fixed('evidence', 6)} rating_evidence from ev""",
    "corpus_documents": f"""with {RECORDS}, {_TAGS}, tc as (select id, count(*) n from tl group by 1),
lk as (select {sql_key('"movieId"')} id, min("imdbId") imdb, min("tmdbId") tmdb from links group by 1)
select rec.id _id, source_title title, "year", array_to_string(genres, '|') genres, coalesce(n, 0)::int n_tags, rating_count, 'tt' || nullif(trim(imdb), '') imdb_id, tmdb tmdb_id from rec left join tc using (id) left join lk using (id)""",
    "exact_title_collisions": f"""with {TITLES}, k as (
  select distinct id, unnest([{key('source_title')}, tkey, {key("regexp_replace(title, '(?i)^(a|an|the)[\\s]+', '')")}]) "key" from keyed)
select "key", count(*) n_records, min(id) first_id from k where "key" <> '' group by 1 having count(*) > 1""",
    "exact_title_lookup": f"""with {TITLES}, k as (
  select distinct id, unnest([{key('source_title')}, tkey, {key("regexp_replace(title, '(?i)^(a|an|the)[\\s]+', '')")}]) k from keyed)
select distinct {sql_key('_id')} query_id, k.id from queries join k on k.k = {key('text')} where text is not null and k.k <> ''""",
    "token_lookup_union": _TOKENS + " select * from hit",
    "token_lookup_intersect": _TOKENS + " select query_id, id from hit where n_matched = n_tokens",
    "trigram_candidates": f"""with {TITLES}, {SEARCHED},
tg as (select id, len(g) n_title, unnest(g) gram from (select id, {grams('tedit')} g from keyed)),
qg as (select query_id, len(g) n_query, unnest(g) gram from (select query_id, {grams('qedit')} g from qt)),
h as (select query_id, id, n_query, n_title, count(*) n_matched from qg join tg using (gram) group by all),
c as (select *, {fixed('n_matched::double / n_query', 3)} coverage, {fixed('n_matched::double / (n_query + n_title - n_matched)', 4)} jaccard, {fixed('2 * n_matched::double / (n_query + n_title)', 4)} dice from h where n_matched >= greatest(2, ceil(n_query * 0.12::double)))
select query_id, rank_no::int rank_no, id, n_matched, coverage, jaccard, dice from (select *, row_number() over (partition by query_id order by n_matched desc, dice desc, id) rank_no from c) where rank_no <= 12""",
    "edit_similarity_topk": _TOKENS + f""", e as (
  select h.query_id, h.id, levenshtein(qedit, tedit)::int d, greatest(length(qedit), length(tedit)) m from hit h join qt using (query_id) join keyed using (id)),
s3 as (select query_id, id, d edit_distance, case when m > 0 then {fixed('1 - d::double / m', 4)} else 1.0 end edit_similarity from e)
select query_id, rank_no::int rank_no, id, edit_distance, edit_similarity from (select *, row_number() over (partition by query_id order by edit_similarity desc, edit_distance, id) rank_no from s3) where rank_no <= 12""",
    "token_coverage_topk": _TOKENS + f""", c as (
  select h.query_id, h.id, n_matched, len({tokens('tkey')})::int n_title, {fixed('n_matched::double / n_tokens', 4)} coverage from hit h join keyed using (id))
select query_id, rank_no::int rank_no, id, n_matched, n_title, coverage from (select *, row_number() over (partition by query_id order by coverage desc, n_matched desc, n_title, id) rank_no from c) where rank_no <= 12""",
    "field_match_best": f"""with {RECORDS}, {_TAGS}, {SEARCHED},
fv as (select id, 'genres' field, unnest(genres) v from rec union all select tl.id, 'tags', t from tl semi join rec on rec.id = tl.id),
fk as (select id, field, {key('v')} k from fv where v <> ''),
fp as (select distinct id, field, unnest({tokens('k')}) token from fk),
nm as (select query_id, qkey, len(ts) n_tokens, id, field, count(*) n_matched from (select query_id, qkey, ts, unnest(ts) token from qt) join fp using (token) group by all),
cm as (select n.*, max(k = qkey) is_exact, max(contains(k, qkey)) is_phrase from nm n join fk using (id, field) group by all),
sc as (select query_id, id, field, is_exact exact_entity, case when is_exact then 'exact_value' when is_phrase then 'phrase' else 'token_coverage' end match_type,
  {fixed(f'(case when is_exact then 1.0::double when is_phrase then 0.9::double else n_matched / n_tokens end) * {_FIELD_WEIGHT}', 6)} score from cm)
select query_id, id, field, score, exact_entity, match_type from (select *, row_number() over (partition by query_id, id order by exact_entity desc, score desc, {_FIELD_PLACE}) r from sc) where r = 1""",
    "metadata_parse": f"""with aq as (select {sql_key('_id')} query_id, {key('text')} qkey from queries where text is not null and {sql_key('_id')} is not null), {_parsed('aq')}
select query_id, array_to_string(list_sort(genres), '|') genres, genre_mode, year_min, year_max, rating_min, count_min, array_to_string(residual, ' ') residual,
  case when title_text <> '' then title_text when has_metadata and len(residual) = 0 then '' else qkey end title_query, case when is_pure_genre then '' else qkey end field_query, is_pure_genre,
  coalesce(nullif(regexp_extract(qkey, '\\b(latest|newest|recent)\\b', 1), ''), case when regexp_matches(qkey, '(^|[^a-z0-9])(movies?|films?)($|[^a-z0-9])') then nullif(regexp_extract(qkey, '\\b(new)\\b', 1), '') end) sort_source from parsed""",
    "metadata_filters": f"""with {RECORDS}, {SEARCHED}, {_parsed('qk')}
select query_id, rec.id from parsed p join rec on p.has_metadata
  and (len(p.genres) = 0 or (p.genre_mode = 'all' and len(list_intersect(list_distinct(p.genres), rec.genres)) = len(p.genres)) or (p.genre_mode = 'any' and list_has_any(p.genres, rec.genres)))
  and (year_min is null or rec."year" >= year_min) and (year_max is null or rec."year" <= year_max) and (rating_min is null or rec.average_rating >= rating_min) and (count_min is null or rec.rating_count >= count_min)""",
    "index_statistics": f"""with {RECORDS}, {_TAGS},
p as (
  select 'exact' n, k t from (select distinct id, unnest([{key('source_title')}, tkey, {key("regexp_replace(title, '(?i)^(a|an|the)[\\s]+', '')")}]) k from keyed) where k <> ''
  union all select 'token', unnest({tokens('tkey')}) from keyed
  union all select 'trigram', unnest({grams('tedit')}) from keyed
  union all select 'field', field || ':' || token from (
    select distinct id, field, unnest({tokens('k')}) token from (select id, 'genres' field, {key('v')} k from (select id, unnest(genres) v from rec) where v <> '' union all select id, 'tags', {key('t')} from tl semi join rec on rec.id = tl.id)))
select n index_name, count(distinct t) terms, count(*) postings from p group by 1""",
    "eval_per_query": f"with {EVAL} select query_id, category, {', '.join(f'{fixed(m, 6)} {m}' for m in METRICS)}, first_grade_3_rank, first_grade_2_rank, retrieved, relevant, latency_ms, is_missing from per",
    "eval_summary": f"with {EVAL} {_SUMMARY}",
    "eval_by_category": f"with {EVAL} select category, count(*) queries, {', '.join(f'{fixed(f'avg({m})', 6)} {_MEAN.get(m, m)}' for m in ('ndcg_at_k', 'precision_at_k_grade_2', 'recall_at_k_grade_2', 'reciprocal_rank_grade_2', 'judged_at_k'))} from per group by 1",
    "regression_gate": f"with {EVAL}, sm as ({_SUMMARY}) " + " union all ".join(f"select '{m}' metric, {fixed(m, 6)} \"value\", {b}::double bound, coalesce({m} {d} {b}, false) passed from sm" for m, b, d in THRESHOLDS),
    "integrity_violations": f"""with {EVAL}, v as (
  select 'duplicate_document' rule, "movieId" x from movies where "movieId" is not null group by 2 having count(*) > 1
  union all select 'duplicate_query', _id from queries where _id is not null group by 2 having count(*) > 1
  union all select distinct 'empty_document', coalesce("movieId", '') from movies where "movieId" is null or trim("movieId") = ''
  union all select distinct 'empty_query', coalesce(_id, '') from queries where _id is null or trim(_id) = ''
  union all select distinct 'unknown_query', query_id from j where query_id not in (select _id from queries where _id is not null)
  union all select distinct 'unknown_document', doc_id from j where doc_id not in (select "movieId" from movies where "movieId" is not null)
  union all select 'no_positive_grade', query_id from j group by 2 having max(grade) <= 0
  union all select distinct 'unknown_run_document', doc_id from rk where doc_id not in (select "movieId" from movies where "movieId" is not null))
select rule, count(*) n, array_to_string(list_slice(list_sort(list(x)), 1, 3), ', ') "sample" from v group by 1""",
    "dataset_summary": f"with {EVAL} select (select count(*) from movies) documents, (select count(*) from queries) queries, count(distinct query_id) judged_queries, count(*) judgments, count(*) filter (grade > 0) positive_judgments from j",
}
