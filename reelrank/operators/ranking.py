"""Similarity signals and the weighted, explainable ranker (RK*, SO1-SO7, AG17), over
pairs of queries and records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.runtime import cut, sized_broadcast

#: Default weights.
TITLE_WEIGHTS = {"token_coverage": 25, "ordered_coverage": 20, "phrase_match": 15, "proximity": 10, "dice": 15, "edit_similarity": 15}
SINGLE_GENRE_WEIGHTS = {"genre_focus": 15, "bayesian_rating": 55, "rating_evidence": 30}
COMPOUND_GENRE_WEIGHTS = {"genre_focus": 55, "bayesian_rating": 30, "rating_evidence": 15}
TITLE_SHARE, FIELD_SHARE = 0.35, 0.65
CLUSTER_MIN, CLUSTER_BOOST = 3, 0.08
PERSON_BOOST, PERSON_EVIDENCE = 0.06, 0.01


def effective_weights(given: dict[str, float] | None, defaults: dict[str, float]) -> dict[str, float]:
    """RK7: weights from 0 to 100, not all zero, as shares of their sum (6 decimals)."""
    weights = {k: (given or {}).get(k, v) for k, v in defaults.items()}
    for k, v in weights.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not 0 <= v <= 100:
            raise ValueError(f"{k} weight must be a finite number from 0 to 100")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("at least one weight must be greater than zero")
    return {k: round(v / total, 6) for k, v in weights.items()}


def query_features(text: Column, prefix: str = "q_") -> list[Column]:
    return [tx.exact_key(text).alias(prefix + "key"), tx.query_tokens(text).alias(prefix + "tokens"), tx.trigrams(text).alias(prefix + "grams"), tx.edit_text(text).alias(prefix + "edit")]


def record_features(title: Column, prefix: str = "r_") -> list[Column]:
    return [tx.exact_key(title).alias(prefix + "key"), tx.ordered_tokens(title).alias(prefix + "tokens"), tx.trigrams(title).alias(prefix + "grams"), tx.edit_text(title).alias(prefix + "edit")]


def edit_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """RK2: (distance, similarity); two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    return d, F.when(longest > 0, tx.fixed(1 - d / longest, 4)).otherwise(F.lit(1.0))


def title_signals(pairs: DataFrame) -> DataFrame:
    """RK1-RK5 for pairs that carry query_features and record_features: token_coverage,
    ordered_coverage, match_span, gap_count, proximity, phrase_match, shared_grams, dice, jaccard and
    edit_similarity. Pairs with fewer than two matching tokens need no alignment and send
    nothing to Python."""
    q, r = F.col("q_tokens"), F.col("r_tokens")
    n = F.size(q)
    present = F.size(F.array_intersect(q, r))
    aligned = tx.align_udf(F.when(present > 1, q), F.when(present > 1, r))
    with_path = pairs.withColumn("_present", present).withColumn("_path", aligned)
    matched = F.when(F.col("_present") > 1, F.col("_path.matched")).otherwise(F.col("_present"))
    span = F.when(F.col("_present") > 1, F.col("_path.last") - F.col("_path.first") + 1).otherwise(F.col("_present"))
    share = lambda a, b, d=4: F.coalesce(tx.fixed(F.try_divide(a.cast("double"), b), d), F.lit(0.0))
    shared = F.size(F.array_intersect("q_grams", "r_grams"))
    grams = F.size("q_grams") + F.size("r_grams")
    distance, similarity = edit_similarity(F.col("q_edit"), F.col("r_edit"))
    out = with_path.withColumns({"matched_tokens": matched, "match_span": span, "query_tokens": n, "shared_grams": shared, "all_grams": grams, "edit_distance": distance, "edit_similarity": similarity})
    out = out.withColumns({
        "token_coverage": share(F.col("_present"), F.col("query_tokens")),
        "ordered_coverage": share(F.col("matched_tokens"), F.col("query_tokens")),
        "proximity": share(F.col("matched_tokens"), F.col("match_span")),
        "gap_count": F.col("match_span") - F.col("matched_tokens"),
        "phrase_match": ((F.col("query_tokens") > 0) & (F.col("matched_tokens") == F.col("query_tokens")) & (F.col("match_span") == F.col("query_tokens"))).cast("double"),
        "dice": share(2 * F.col("shared_grams"), F.col("all_grams")),
        "jaccard": share(F.col("shared_grams"), F.col("all_grams") - F.col("shared_grams")),
    })
    return out.drop("_path", "_present", "all_grams")


def combined_score(weights: dict[str, float]) -> Column:
    """RK6: each contribution to 6 decimals, then their sum. Signals of weight 0 aren't asked for, so that
    where nothing else wants them they are never computed."""
    parts = [tx.fixed(F.col(k) * F.lit(w), 6) for k, w in weights.items() if w]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return tx.fixed(total, 6)


def genre_focus(wanted: Column, genres: Column) -> tuple[Column, Column]:
    """(number of wanted genres held, that number over the larger list)."""
    n = F.size(F.array_intersect(wanted, genres))
    return n, F.when(F.size(wanted) > 0, n / F.greatest(F.size(wanted), F.size(genres), F.lit(1))).otherwise(F.lit(0.0))


def structured_genre_score(n_wanted: Column, weights: dict[str, float] | None = None) -> Column:
    """RK9, over genre_focus, bayesian_rating and rating_evidence."""
    signals = {"genre_focus": F.col("genre_focus"), "bayesian_rating": F.col("bayesian_rating") / 5, "rating_evidence": F.col("rating_evidence")}

    def score(defaults: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for k, w in effective_weights(weights, defaults).items():
            total = total + tx.fixed(signals[k] * F.lit(w), 6)
        return tx.fixed(total, 6)

    return F.when(n_wanted == 1, score(SINGLE_GENRE_WEIGHTS)).otherwise(score(COMPOUND_GENRE_WEIGHTS))


def phrase_priority(title_key: Column, query_key: Column) -> Column:
    """RK12: 1 if the title without its article is, or starts with, a query of several words."""
    bare = F.regexp_replace(title_key, r"^(a|an|the)\s+", "")
    return F.when((F.size(F.split(query_key, " ")) >= 2) & ((bare == query_key) | F.startswith(bare, F.concat(query_key, F.lit(" ")))), 1).otherwise(0)


def prefix_match(title_key: Column, query_key: Column) -> Column:
    """RK10/AG17: the title without its article starts with the one-word query and goes on."""
    bare = F.regexp_replace(title_key, r"^(a|an|the)\s+", "")
    return (query_key != "") & ~F.contains(query_key, F.lit(" ")) & F.startswith(bare, F.concat(query_key, F.lit(" ")))


def base_order() -> list[Column]:
    """SO1, with the record's id last so that ties always fall alike."""
    average = F.when(F.col("eligible"), F.coalesce("average_rating", F.lit(0.0))).otherwise(F.lit(0.0))
    return [
        F.desc("is_exact"), F.desc("phrase_priority"), F.desc("exact_entity"), F.desc("genre_matches"), F.desc("structured_score"), F.desc("combined_score"), F.desc("ordered_coverage"), F.desc("token_coverage"), F.desc("dice"),
        average.desc(), F.desc("rating_count"), F.asc("title"), F.asc("id"),
    ]


def numeric_order(value: Column) -> list[Column]:
    """SO6: order by text in which runs of digits count as numbers, whatever the case; of equal
    ones by the text itself. Symbols come before digits, digits before letters."""
    parts = F.regexp_extract_all(F.lower(value), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    sized = lambda n: F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n)
    return [F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), sized(number(p))).otherwise(p)), "").asc(), value.asc()]


def prefix_clusters(pairs: DataFrame) -> DataFrame:
    """AG17: (query_id, cluster): how many candidates of each query have a title that goes on from its
    one word. pairs: (query_id, prefix_match)."""
    return pairs.groupBy("query_id").agg(F.count_if("prefix_match").alias("cluster"))


def cluster_boost(score: Column, title_intent: Column, prefix: Column) -> Column:
    """RK10: a little more for titles of the cluster, at most 1."""
    return F.when(title_intent & prefix, F.least(F.lit(1.0), tx.fixed(score + CLUSTER_BOOST, 6))).otherwise(score)


def person_boost(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """RK11/JN12/WN3: rows (query_id, id, combined_score, rating_evidence and the columns of base_order)
    with person_id, person_rank, occurrence, boost and boosted_score.

    hints: (query_id, id, person_id, person_rank, popularity): the people of a query (at most five, by
    rank from 0) that a record credits; the first of a record counts. A person's records count less
    from one to the next, in base order. Rows without a person are groups of one."""
    first = hints.groupBy("query_id", "id").agg(F.min_by(F.struct("person_id", "person_rank", "popularity"), F.struct("person_rank", "person_id")).alias("p"))
    most = hints.groupBy("query_id").agg(F.max("popularity").alias("most"))
    near = cut(first.join(most, "query_id"))
    joined = rows.join(sized_broadcast(near, near.count()), ["query_id", "id"], "left")
    # only rows with a person are brought together; all others stay where they are
    named = joined.where("p is not null").withColumn("occurrence", F.row_number().over(W.partitionBy("query_id", "p.person_id").orderBy(*base_order())))
    seen = named.unionByName(joined.where("p is null").withColumn("occurrence", F.lit(None).cast("int")))
    signal = F.try_divide(F.col("p.popularity").cast("double"), F.col("most"))
    boost = tx.fixed(tx.fixed(F.lit(PERSON_BOOST) * signal / F.sqrt(F.col("occurrence").cast("double")), 6) + tx.fixed(F.lit(PERSON_EVIDENCE) * F.col("rating_evidence"), 6), 6)
    lifted = F.when(F.col("boost").isNotNull(), F.least(F.lit(1.0), tx.fixed(F.col("combined_score") + F.col("boost"), 6))).otherwise(F.col("combined_score"))
    out = seen.withColumn("boost", boost).withColumn("boosted_score", lifted).withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumns({"person_id": F.col("p.person_id"), "person_rank": F.col("p.person_rank")}).drop("p", "most")


def people_order(has_people: Column) -> list[Column]:
    """SO2, for queries that hint at people (has_people): titles of the cluster where the title
    is meant, then the people in their order where people are, then the boosted score; base order for
    all that is equal, and for all other queries."""
    only = lambda c: F.when(has_people, c)
    return [
        only(F.when(F.col("title_intent"), F.col("prefix_match").cast("int")).otherwise(0)).desc_nulls_last(),
        only(F.when(F.col("person_intent"), F.coalesce("person_rank", F.lit(1 << 30))).otherwise(0)).asc_nulls_last(),
        only(F.col("boosted_score")).desc_nulls_last(),
        *base_order(),
    ]


def boost_people(ranked: DataFrame, hints: DataFrame) -> DataFrame:
    """Both for rows that hold a base_rank instead of the columns of base_order: `rank_no` is SO2's."""
    base = {"is_exact": F.lit(0), "phrase_priority": F.lit(0), "exact_entity": F.lit(0), "genre_matches": F.lit(0), "structured_score": -F.col("base_rank"), "eligible": F.lit(False), "average_rating": F.lit(0.0), "ordered_coverage": F.lit(0), "token_coverage": F.lit(0), "dice": F.lit(0), "rating_count": F.lit(0), "title": F.lit("")}
    rows = person_boost(ranked.withColumns({c: v for c, v in base.items() if c not in ranked.columns}), hints)
    return rows.withColumn("rank_no", F.row_number().over(W.partitionBy("query_id").orderBy(*people_order(F.lit(True)))))
