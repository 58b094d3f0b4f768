"""Sources, corpus, evaluation, validation, corrections, review, entities, aliases."""

import gzip
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelrank.operators import corpus as cp
from reelrank.operators import entities as en
from reelrank.operators import evaluation as ev
from reelrank.operators import fuzzy
from reelrank.operators import multilingual as ml
from reelrank.operators import review as rv
from reelrank.operators import validation
from reelrank.plans import corrections as co
from reelrank.sources import readers as rd
from reelrank.sources import sinks as sk


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        return str(p)

    return write


def test_corpus_from_csv(spark, files):
    paths = {
        "movies": files("movies.csv", 'movieId,title,genres\n1,Toy Story (1995),Adventure|Animation|Children|Comedy|Fantasy\n2,"Odd, The (19x5)",(no genres listed)\n'),
        "ratings": files("ratings.csv", "userId,movieId,rating,timestamp\n1,1,4.0,5\n2,1,5.0,6\n1,2,3.0,7\n"),
        "tags": files("tags.csv", "userId,movieId,tag,timestamp\n1,1,Pixar,1\n2,1,pixar,2\n2,1, friendship ,3\n2,1,  ,4\n"),
        "links": files("links.csv", "movieId,imdbId,tmdbId\n1,0114709,862\n2,,\n"),
    }
    corpus = cp.build_corpus(*(rd.read_csv(spark, paths[n], n) for n in ("movies", "ratings", "tags", "links")))
    got = {r._id: r for r in corpus.collect()}
    m = got["1"].metadata
    assert got["1"].title == "Toy Story" and m.year == 1995 and len(m.genres) == 5 and m.tags == ["Pixar", "friendship"] and m.average_rating == 4.5 and m.rating_count == 2 and m.imdb_id == "tt0114709" and m.tmdb_id == 862
    assert "Genres: Adventure" in got["1"].text
    assert got["2"].title == "Odd, The (19x5)" and got["2"].metadata.genres == [] and got["2"].metadata.imdb_id is None
    assert cp.records(corpus).where("id = '2'").first().title == "Odd, The (19x5)"
    e = spark.createDataFrame([("1", ["Tom ", "Tom", ""], ["Jo"], ["toys"], "A boy.")], "_id string, cast array<string>, directors array<string>, keywords array<string>, overview string")
    rich = cp.enrich(corpus, e)
    r = rich.where("_id = '1'").first()
    assert r.cast == ["Tom"] and "Directors: Jo" in r.text and r.text.endswith("A boy.")
    assert cp.coverage(rich).first().coverage == 0.5


def beir(files):
    files("d/corpus.jsonl", '{"_id": " d1 ", "title": "Cats", "text": "c"}\n\n{"_id": "d2", "title": "Dogs"}\n{"_id": "d3", "title": "Tigers"}\n')
    files("d/queries.jsonl", '{"_id": "q1", "text": "domestic cats", "metadata": {"category": "genre"}}\n{"_id": "q2", "text": "loyal animal"}\n')
    return files("d/qrels/test.tsv", "query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td3\t1\nq2\td2\t1\n")


RUN = '{"query_id": "q1", "latency_ms": 10, "candidate_ids": ["d1","d2","d3"], "results": [{"doc_id":"d3","score":0.9},{"doc_id":"d1","score":0.8},{"doc_id":"d2","score":0.1}]}\n{"query_id": "q2", "latency_ms": 20, "candidate_ids": ["d2"], "results": [{"doc_id":"d2","score":0.95},{"doc_id":"d1","score":0.2}]}\n'


def test_evaluation(spark, files):
    folder = str(Path(beir(files)).parent.parent)
    ds = rd.load_dataset(spark, folder)
    s = validation.summary(ds.documents, ds.queries, ds.qrels).first()
    assert (s.documents, s.queries, s.judged_queries, s.judgments, s.positive_judgments) == (3, 2, 2, 3, 3)
    run = rd.load_run(spark, files("run.jsonl", RUN))
    per = ev.evaluate(ds.qrels, run, k=2, recall_k=3, categories=ds.queries.select(F.col("_id").alias("query_id"), "category"))
    r = ev.summarize(per).first()
    assert (r.candidate_recall, r.precision_at_k, r.recall_at_k, r.recall_at_recall_k, r.mrr) == (1, 0.75, 1, 1, 1)
    assert (r.mean_latency_ms, r.p50_latency_ms, r.p95_latency_ms, r.missing_queries) == (15, 10, 20, 0)
    q1 = per.where("query_id = 'q1'").first()
    assert q1.ndcg_at_k == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3))) and q1.category == "genre" and q1.first_grade_2_rank == 2
    assert per.where("query_id = 'q2'").first().category == "uncategorized"
    short = ev.summarize(ev.evaluate(ds.qrels, run.where("query_id = 'q1'"), k=2, recall_k=3)).first()
    assert short.missing_queries == 1 and short.recall_at_k == 0.5
    j3 = ev.evaluate(ds.qrels.where("query_id = 'q1'"), run, k=3).first()
    assert j3.judged_at_k == pytest.approx(2 / 3)
    nocand = ev.evaluate(ds.qrels, run.withColumn("candidate_ids", F.lit(None).cast("array<string>"))).first()
    assert nocand.candidate_recall is None
    empty = ev.evaluate(ds.qrels, run.withColumn("candidate_ids", F.array().cast("array<string>"))).first()
    assert empty.candidate_recall == 0
    gate = {x.metric: x.passed for x in ev.gate(ev.summarize(per)).collect()}
    assert gate["mrr"] and gate["p95_latency_ms"] and gate["missing_queries"]
    cmp = {x.query_id: x for x in ev.compare(per, ev.evaluate(ds.qrels, run.where("query_id = 'q1'"), k=2, recall_k=3), ["recall_at_k"]).collect()}
    assert cmp["q2"].is_worse and not cmp["q1"].is_worse
    with pytest.raises(ValueError):
        ev.evaluate(ds.qrels, run, k=0)
    assert json.loads(sk.report_json(ev.summarize(per)))["evaluated_queries"] == 2
    assert "| mrr |" in sk.report_markdown(ev.summarize(per).select("mrr"), "Report")


@pytest.mark.parametrize(
    "line",
    ['[1]', '{"query_id": "q1"', '{"query_id": "", "results": []}', '{"query_id": "q", "results": [{"doc_id": "a", "score": 1}, {"doc_id": " a", "score": 1}]}', '{"query_id": "q", "latency_ms": -1, "results": []}', '{"query_id": "q", "results": [{"doc_id": "a", "score": null}]}', '{"query_id": "q", "candidate_ids": ["a", "a"], "results": []}', '{"query_id": "q"}', '{"query_id": "q", "results": []}\n{"query_id": "q ", "results": []}'],
)
def test_bad_runs(spark, files, line):
    with pytest.raises(rd.DataError):
        rd.load_run(spark, files("bad.jsonl", line + "\n"))


def test_bad_datasets(spark, files):
    beir(files)
    q = files("d/queries.jsonl", '{"_id": "q1", "text": "x"}\n')
    corpus = str(Path(q).parent / "corpus.jsonl")
    with pytest.raises(rd.DataError, match="unknown_query: q2"):
        rd.load_dataset(spark, str(Path(q).parent))
    for text in ("query-id\tscore\nq1\t1\n", "query-id\tcorpus-id\tscore\nq1\td1\tx\n", "query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\n", "query-id\tcorpus-id\tscore\nq1\td1\t0\n", "query-id\tcorpus-id\tscore\nq1\tdx\t1\n"):
        with pytest.raises(rd.DataError):
            rd.load_dataset_files(spark, corpus, q, files("bad.tsv", text))
    with pytest.raises(rd.DataError):
        rd.load_documents(spark, files("twice.jsonl", '{"_id": "a"}\n{"_id": "a "}\n'))


def test_files(spark, files, tmp_path):
    p = files("x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert rd.count_lines(spark, p) == 2 and rd.first_readable(spark, [str(tmp_path / "no"), p]) == p
    d = rd.file_digests(spark, p).first()
    assert d.bytes == 19 and len(d.sha256) == 64
    with pytest.raises(FileNotFoundError):
        rd.first_readable(spark, [str(tmp_path / "no")])
    good = {"schemaVersion": 1, "releaseId": "r-2024.1", "expiresAt": "2030-01-01", "files": {"a": {"pathname": "a", "sha256": "0" * 64, "bytes": 3}}}
    rd.check_manifest(good, "2029-01-01")
    for bad in ({"schemaVersion": 2}, {"releaseId": "X"}, {"expiresAt": "2028"}, {"files": {}}, {"files": {"a": {"pathname": "a", "sha256": "1", "bytes": 3}}}):
        with pytest.raises(rd.DataError):
            rd.check_manifest({**good, **bad}, "2029-01-01")
    df = spark.createDataFrame([("a\tb\nc", 1), (None, 2)], "t string, n int").coalesce(1)
    sk.write_tsv(df, str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part*")).read_text()
    assert body.splitlines()[:2] == ["t\tn", "a b c\t1"]
    sk.write_release({"t": df}, str(tmp_path / "rel"), "r-2024.1", "2030-01-01")
    part = next((tmp_path / "rel" / "t").glob("part*.gz"))
    assert json.loads(gzip.open(part, "rt").readline())["n"] == 1
    with pytest.raises(Exception):
        sk.write_release({"t": df}, str(tmp_path / "rel"), "r-2024.1", "2030-01-01")
    manifest, found = rd.read_release(spark, str(tmp_path / "rel"), "2029-01-01")
    assert [r.is_whole for r in found.collect()] == [True] and manifest["releaseId"] == "r-2024.1"
    with pytest.raises(rd.DataError):
        rd.read_release(spark, str(tmp_path / "rel"), "2031-01-01")
    (tmp_path / "rel" / "t" / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(gzip.compress(b"{}"))
    assert [r.is_whole for r in rd.read_release(spark, str(tmp_path / "rel"), "2029-01-01")[1].collect()] == [False]
    cases = spark.createDataFrame([("a", "ok"), ("a", "no"), ("b", "ok")], "category string, status string")
    assert {(r.category, r.status): r.n for r in sk.case_workbook(cases).collect()}[(None, None)] == 3


def test_enrichment(spark):
    payload = spark.createDataFrame([("1", {"cast": [(k, f"A{k}") for k in range(20)], "crew": [(90, "D", "Director"), (91, "W", "Writer")]}, {"keywords": [(7, "k")]}, "o", None)], "_id string, credits struct<cast:array<struct<id:int,name:string>>,crew:array<struct<id:int,name:string,job:string>>>, keywords struct<keywords:array<struct<id:int,name:string>>>, overview string, poster_path string")
    new = rd.project_enrichment(payload)
    r = new.first()
    assert len(r.cast) == 12 and [d.name for d in r.directors] == ["D"]
    docs = spark.createDataFrame([("1",), ("2",)], "_id string")
    assert [x._id for x in rd.pending(docs, new).collect()] == ["1", "2"]
    merged, counts = rd.merge_cache(new, new)
    c = counts.first()
    assert merged.count() == 1 and (c.updated, c.unchanged, c.kept, c.without_poster) == (0, 1, 0, 1)
    p = spark.createDataFrame([("1", "Dil Se", "hi", [("hi", "दिल से"), ("fr", "x"), ("en", "dil  se!")], [("IN", "Dil Se.."), ("DE", "y")])], "_id string, original_title string, original_language string, translations array<struct<language:string,title:string>>, alternatives array<struct<country:string,title:string>>")
    assert sorted(x.text for x in rd.movie_aliases(p).collect()) == ["Dil Se", "दिल से"]


def test_registry(spark):
    credits = spark.createDataFrame([("m1", "actor", "500", "Alex Star"), ("m2", "actor", "500", "Alex Star"), ("m2", "director", "500", "Alex Star"), ("m1", "director", "700", "Dana Ray"), ("m1", "actor", None, " No Id "), ("m1", "actor", None, "no-id"), ("m1", "actor", "1", " ")], "movie_id string, role string, person_id string, name string")
    got = {r.entity_id: r for r in cp.people(credits).collect()}
    a = got["person:id:500"]
    assert (a.movie_count, a.actor_movie_count, a.director_movie_count, a.roles) == (2, 2, 1, ["actor", "director"])
    assert got["person:name:no-id"].movie_count == 1 and len(got) == 3
    p = en.page(cp.people(credits), 1, 2).collect()
    assert [r.entity_id for r in p] == ["person:id:500", "person:id:700"] or p[0].entity_id == "person:id:500"
    assert p[0].total == 3 and p[0].pages == 2
    with pytest.raises(ValueError):
        en.page(cp.people(credits), 0, 2)
    groups = spark.createDataFrame([("q", 0, "person:id:500"), ("q", 1, "person:id:700")], "query_id string, group_no int, entity_id string")
    edges = spark.createDataFrame([("person:id:500", "m1"), ("person:id:500", "m2"), ("person:id:700", "m1")], "entity_id string, movie_id string")
    assert [r.movie_id for r in en.in_every_group(edges, groups).collect()] == ["m1"]
    tags = cp.tag_sources({"b": spark.createDataFrame([("m", "Spy")], "movie_id string, tag string"), "a": spark.createDataFrame([("m", "spy ")], "movie_id string, tag string")}).first()
    assert tags.sources == ["a", "b"]


def test_typeahead(spark):
    people = spark.createDataFrame([("1", "Christopher Nolan", 10), ("2", "Nolan North", 7), ("3", "Ann Nola", 99)], "id string, name string, weight int")
    q = spark.createDataFrame([("a", "nolan"), ("b", "n"), ("c", "christopher no")], "query_id string, text string")
    got = [(r.query_id, r.id, r.score) for r in en.typeahead(q, people).orderBy("query_id", "rank_no").collect()]
    assert got == [("a", "2", 3), ("a", "1", 2), ("c", "1", 3)]


PEOPLE = [("tc", "Tom Cruise", ["actor"], 20, 20, 0), ("cn", "Christopher Nolan", ["director"], 10, 0, 10), ("nn", "Nolan North", ["actor"], 7, 7, 0), ("ss", "Steven Spielberg", ["director"], 30, 0, 30)]


def test_corrections(spark):
    people = spark.createDataFrame(PEOPLE, "entity_id string, name string, roles array<string>, movie_count int, actor_movie_count int, director_movie_count int")
    titles = ["Interstellar", "Horror of Dracula", "Horror Express", "Harry Potter and the Stone", "Harry Potter and the Cup"]
    records = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "id string, title string")
    genres = spark.createDataFrame([("Horror",), ("Comedy",)], "genre string")
    texts = {"p": "tom cruse", "d": "movies directed by steven speilberg", "t": "intersteler", "g": "horor movies", "c": "latets movies", "h": "hary poter", "x": "interstellar", "n": "nolan", "e": "films with tom cruise"}
    q = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    got = {r.query_id: r for r in co.corrections(q, records, people, genres).collect()}
    assert got["p"].entity_type == "person" and got["p"].replacement == "Tom Cruise" and got["p"].effective_query == "tom cruise"
    assert got["d"].replacement == "Steven Spielberg" and got["d"].policy == "automatic"
    assert got["t"].entity_type == "title" and got["t"].replacement == "Interstellar" and got["t"].effective_query == "interstellar"
    assert got["g"].entity_type == "genre" and got["g"].effective_query == "horror movies"
    assert got["c"].entity_type == "control" and got["c"].effective_query == "latest movies"
    assert got["h"].entity_type == "title" and got["h"].replacement == "Harry Potter" and got["h"].policy == "automatic"
    assert "x" not in got and "e" not in got
    off = {r.query_id: r for r in co.corrections(q, records, people, genres, autocorrect=False).collect()}
    assert off["t"].policy == "suggest" and off["t"].effective_query == "intersteler" and off["t"].suggested_query == "interstellar"
    part = [r.entity_id for r in co.partial_people(q, people).where("query_id = 'n'").orderBy("rank_no").collect()]
    assert part == ["cn", "nn"]
    exact = {(r.query_id, r.entity_id) for r in co.exact_people(q, people).collect()}
    assert exact == {("e", "tc")}


def test_plans(spark):
    from reelrank.plans.planner import parser_cases, plan_queries

    people = spark.createDataFrame(PEOPLE, "entity_id string, name string, roles array<string>, movie_count int, actor_movie_count int, director_movie_count int")
    titles = ["Interstellar", "Horror of Dracula", "Horror Express"]
    records = spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "id string, title string")
    texts = {"x": "Interstellar", "g": "horror movies", "f": "horror movies after 1990", "e": "films starring tom cruise", "l": "latest movies", "s": "steven", "t": "dark dream harbor"}
    q = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    p = plan_queries(q, records, people, spark.createDataFrame([("Horror",)], "genre string"))
    got = {r.query_id: r for r in p.collect()}
    assert (got["x"].intent, got["x"].strategy, got["x"].title_priority, got["x"].concepts) == ("exact_title", "exact_title", "exact", [])
    assert got["g"].intent == "discovery" and got["g"].is_pure_genre and got["g"].title_query == "" and got["g"].field_query == ""
    assert got["f"].intent == "filtered_discovery" and got["f"].year_min == 1991 and got["f"].strategy == "structured"
    assert got["e"].intent == "person_discovery" and got["e"].person_ids == ["tc"] and got["e"].field_query == "tom cruise" and got["e"].title_query == "" and got["e"].field_role == "actor"
    assert got["l"].intent == "sorted_discovery" and got["l"].sort_source == "latest"
    assert got["s"].intent == "person_discovery" and got["s"].person_candidates == ["ss"] and got["s"].person_intent
    assert got["t"].intent == "general_search" and got["t"].concepts == ["dark", "dream", "harbor"] and got["t"].expansions == ["gritty", "crime", "thriller"]
    expected = spark.createDataFrame([("x", "exact_title", []), ("g", "discovery", ["Comedy"])], "query_id string, intent string, genres array<string>")
    assert {r.query_id: r.mismatches for r in parser_cases(p, expected).collect()} == {"x": [], "g": ["genres"]}


def test_draft(spark):
    q = spark.createDataFrame([("q001", "a", "c"), ("q1", " ", None), ("q001", "b", "c")], "query_id string, text string, category string")
    j = spark.createDataFrame([("q001", "d1", 2), ("q001", "d1", 4), ("q009", "dx", 1)], "query_id string, doc_id string, grade int")
    got = {r.rule: r.n for r in validation.draft_violations(q, j, spark.createDataFrame([("d1",)], "doc_id string")).collect()}
    assert got == {"bad_query_id": 1, "empty_text": 1, "empty_category": 1, "duplicate_query": 1, "bad_grade": 1, "duplicate_judgment": 1, "unknown_query": 1, "unknown_document": 1}
    assert validation.next_query_id(q) == "q002"


def test_within_distance_is_exact(spark):
    import random

    rnd = random.Random(9)
    words = lambda n, z: sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(0, z))) for _ in range(n)})
    from tests_lev import lev

    for d in (1, 2, 3):
        a, b = words(60, 9), words(60, 9)
        got = {(r.a, r.b): r.distance for r in fuzzy.within_distance(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b", d).collect()}
        assert got == {(x, y): lev(x, y) for x in a for y in b if lev(x, y) <= d}


def test_review(spark):
    events = spark.createDataFrame([("q", "d", "a", 1, 1), ("q", "d", "a", 3, 2), ("q", "d", "b", 2, 1), ("q", "e", "a", 3, 1), ("q", "e", "b", 1, 1), ("q", "f", "a", 2, 1)], "query_id string, doc_id string, reviewer_id string, grade int, reviewed_at int")
    last = rv.latest_reviews(events)
    adj = spark.createDataFrame([("q", "f", 0)], "query_id string, doc_id string, final_grade int")
    got = {r.doc_id: (r.n_reviews, r.is_conflict, r.final_grade) for r in rv.judgment_status(last, adj).collect()}
    assert got == {"d": (2, False, 3), "e": (2, True, None), "f": (1, False, 0)}
    pool = spark.createDataFrame([("q", x) for x in "defg"], "query_id string, doc_id string")
    p = rv.progress(pool, rv.judgment_status(last, adj)).first()
    assert (p.pool_size, p.twice_reviewed, p.conflicts, p.finalized) == (4, 2, 1, 2)
    lists = spark.createDataFrame([("q", s, n, f"{s}{k}", float(-k)) for n, s in enumerate("xy") for k in range(30)] + [("q", "y", 1, "x0", 5.0)], "query_id string, source string, source_no int, doc_id string, score double")
    order = [r.doc_id for r in rv.interleave(rv.nominate(lists), size=5).orderBy("place").collect()]
    assert order == ["x0", "x1", "y0", "x2", "y1"]
    m = rv.judged_metrics(spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 2)], "query_id string, rank int, grade int")).first()
    assert m.precision_5 == pytest.approx(2 / 3) and m.top1_relevant and not m.zero_relevant
    ag = rv.agreement(spark.createDataFrame([("a", 1, 3, 3), ("a", 2, 1, 3), ("b", 1, 0, 0)], "item_id string, rep int, grade int, gold int")).first()
    assert (ag.agreement, ag.recall, ag.specificity, ag.instability) == (pytest.approx(2 / 3), 0.5, 1.0, 0.5)
    rates = ev.case_rates(spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, p int"), "c", "p").first()
    assert rates.pass_rate == 0.75 and rates.flaky == 1 and rates.high == 1.0


def test_aliases(spark):
    e = spark.createDataFrame([("m1", "Dil Se (1998)", [("दिल से", "reviewed", "hi"), ("dil se", "reviewed", "hi")]), ("m2", "Horror Express", []), ("m3", "क़िला", [])], "entity_id string, name string, aliases array<struct<text:string,source:string,language:string>>")
    a = ml.alias_catalog(e)
    keys = {(r.entity_id, r.key) for r in a.collect()}
    assert keys == {("m1", "dil se 1998"), ("m1", "dil se"), ("m1", "दिल से"), ("m2", "horror express"), ("m3", "क़िला")}
    c = ml.alias_coverage(a).first()
    assert (c.entities, c.aliases, c.with_devanagari) == (3, 5, 2)
    q = spark.createDataFrame([("a", "दिल  से"), ("b", "horor expres"), ("c", "express"), ("d", "क़िला"), ("e", ""), ("f", "zzz")], "query_id string, text string")
    got = {(r.query_id, r.entity_id): round(r.score, 3) for r in ml.match_aliases(q, a).collect()}
    assert got == {("a", "m1"): 1.0, ("b", "m2"): round(0.65 * (1 - 2 / 14), 3), ("c", "m2"): 0.8, ("d", "m3"): 1.0}
    s = [(r.entity_id, r.score) for r in ml.suggest_aliases(spark.createDataFrame([("a", "horr"), ("b", "h")], "query_id string, text string"), a).collect()]
    assert s == [("m2", 0.9)]
    g = {(r.query_id, r.rank_no): r for r in ml.ground(spark.createDataFrame([("a", "films like horor express please"), ("b", "dil se songs")], "query_id string, text string"), a).collect()}
    assert g[("a", 1)].entity_id == "m2" and g[("b", 1)].entity_id == "m1" and g[("b", 1)].score == 1.0
    r = {x.query_id: (sorted(x.genres), x.genre_mode) for x in ml.genre_requests(spark.createDataFrame([("a", "मुझे डरावनी फिल्में दिखाओ"), ("b", "comedy aur drama films"), ("c", "horror ya thriller"), ("d", "horror express"), ("e", "horror or drama both")], "query_id string, text string"), ["Horror", "Comedy", "Drama", "Thriller"]).collect()}
    assert r == {"a": (["Horror"], "any"), "b": (["Comedy", "Drama"], "all"), "c": (["Horror", "Thriller"], "any")}
    films = spark.createDataFrame([("1", "Wind Rises, The (Kaze)", 2013, ["Hideaki Anno"]), ("2", "Wanted", 2008, ["James McAvoy"])], "id string, title string, year int, people array<string>")
    cand = spark.createDataFrame([("a", "Wind Rises, The", 2014, None), ("b", "Wanted", 2009, "Salman Khan"), ("c", "Wanted", None, "McAvoy"), ("d", "Wanted", 2001, None)], "candidate_id string, title string, year int, person string")
    assert {x.candidate_id: x.film_id for x in ml.match_catalogue(cand, films).collect()} == {"a": "1", "c": "2"}


def test_streams(spark, tmp_path):
    from reelrank.streaming import reviews as st

    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(str(src))
    events = spark.readStream.schema("k string, t timestamp").parquet(str(src))
    query = st.distinct_events(events, ["k"], "t").writeStream.format("memory").queryName("distinct_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("distinct_events").count() == 2
