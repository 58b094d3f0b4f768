"""The command line: exit codes and reports."""

import json

from reelrank.__main__ import main


def dump(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "qrels").mkdir()
    dump(tmp_path / "corpus.jsonl", [{"_id": k, "title": k.upper()} for k in "abc"])
    dump(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "one"}, {"_id": "q2", "text": "two"}])
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta\t2\nq1\tb\t0\nq2\tc\t1\n")
    hit = lambda *ids: [{"doc_id": d, "score": 1.0 / (i + 1)} for i, d in enumerate(ids)]
    dump(tmp_path / "run.jsonl", [{"query_id": "q1", "latency_ms": 3.0, "results": hit("b", "a")}, {"query_id": "q2", "latency_ms": 5.0, "results": hit("c")}])
    dump(tmp_path / "part.jsonl", [{"query_id": "q1", "latency_ms": 3.0, "results": hit("c", "a")}, {"query_id": "q2", "latency_ms": 5.0, "results": hit("c")}])
    dump(tmp_path / "bad.jsonl", [{"query_id": "q1", "latency_ms": 3.0, "results": hit("zzz")}])
    folder = str(tmp_path)
    assert main(["inspect", folder], spark) == 0
    assert "| 3 | 2 | 2 | 3 | 2 |" in capsys.readouterr().out
    assert main(["evaluate", folder, f"{folder}/run.jsonl", "--require-fully-judged-at-k", "--output", f"{folder}/report"], spark) == 0
    report = json.loads(next((tmp_path / "report").glob("part*.json")).read_text())
    assert report["mrr"] == 0.75 and report["evaluated_queries"] == 2
    assert main(["evaluate", folder, f"{folder}/part.jsonl"], spark) == 0
    assert main(["evaluate", folder, f"{folder}/part.jsonl", "--require-fully-judged-at-k"], spark) == 2
    assert "fully judged" in capsys.readouterr().err
    assert main(["evaluate", folder, f"{folder}/bad.jsonl"], spark) == 2
    assert main(["evaluate", folder, f"{folder}/run.jsonl", "--corpus", "x"], spark) == 2
    for name, head, row in (("movies", "movieId,title,genres", '1,"Meadow, The (1999)",Drama|War'), ("ratings", "userId,movieId,rating,timestamp", "1,1,4.0,1"), ("tags", "userId,movieId,tag,timestamp", "1,1,quiet,1"), ("links", "movieId,imdbId,tmdbId", "1,0012,5")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n{row}\n")
    assert main(["transform", folder, f"{folder}/made"], spark) == 0
    made = json.loads(next(p for p in (tmp_path / "made").glob("part*.json") if p.stat().st_size).read_text())
    assert made["_id"] == "1" and made["metadata"]["imdb_id"] == "tt0012" and made["metadata"]["genres"] == ["Drama", "War"]
