"""Adaptive retrieval: the legs that a question's kind asks for, composed from the list operators.

Questions are (query_id, question, strategy); ranked lists are
(query_id, id, file_key, rank, score); ``texts`` is (id, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing as R
from . import ranking as K
from .mmr import rerank as mmr_rerank

_LIST = ("query_id", "id", "file_key", "rank", "score")


def _of(hits: DataFrame, questions: DataFrame, strategy: str) -> DataFrame:
    return hits.join(questions.where(F.col("strategy") == strategy).select("query_id"), "query_id", "left_semi")


def hybrid(vector: DataFrame, keyword: DataFrame, keyword_weight: float) -> DataFrame:
    """The vector list alone at weight zero, else both, fused by weight; ``file_key`` is kept."""
    if not keyword_weight:
        return vector.select(*_LIST)
    return _with_files(K.reciprocal_rank_fusion([vector, keyword], [1 - keyword_weight, keyword_weight], first_rank=1), vector, keyword)


def _with_files(fused: DataFrame, *lists: DataFrame) -> DataFrame:
    every = lists[0].select("query_id", "id", "file_key")
    for h in lists[1:]:
        every = every.unionByName(h.select("query_id", "id", "file_key"))
    return fused.join(every.groupBy("query_id", "id").agg(F.min("file_key").alias("file_key")), ["query_id", "id"]).select(*_LIST)


def rerank_by_words(hits: DataFrame, questions: DataFrame, texts: DataFrame, least: float, k: int, digits: int = 6) -> DataFrame:
    """Candidates scored by the question's words in their text; those of ``least`` or more, the best ``k``, ties by old rank."""
    scored = K.with_texts(hits.join(questions.select("query_id", "question"), "query_id"), texts).withColumn("score", F.round(K.keyword_score(F.col("question"), F.col("text")), digits))
    return K.renumber(scored.where(F.col("score") >= least), F.col("score").desc(), "rank").where(F.col("rank") <= k).select(*_LIST)


def adaptive(
    questions: DataFrame,
    vector: DataFrame,
    keyword: DataFrame,
    texts: DataFrame,
    k: int,
    content_filter: Column | None = None,
    least: float = 0.1,
    rebalanced: bool = True,
    spread_by: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, id, rank) of the best ``k`` for each question, by its strategy.

    ``exact_match`` takes the keyword list, ``conceptual`` the vector list. A
    ``complex`` question fuses 2k vector hits with the keyword hits, reranks 3k of
    them by words, keeps 2k of score ``least`` or more, rebalances them over files
    and gives every file its share (two at least). With a filter on content the
    keyword leg is left out: exact questions then take the vector list, to which
    the filter applies. ``rebalanced`` false is the serving path, without
    rebalancing and threshold. With ``spread_by``, vectors (id, vector) and vectors
    of questions (query_id, vector), maximal marginal relevance picks the ``k``
    instead of shares by file.
    """
    if content_filter is not None:
        vector, keyword = K.renumber(vector.where(content_filter), "rank"), keyword.limit(0)
        questions = questions.withColumn("strategy", F.when(F.col("strategy") == "exact_match", "conceptual").otherwise(F.col("strategy")))
    exact = _of(keyword, questions, "exact_match").where(F.col("rank") <= k)
    concept = _of(vector, questions, "conceptual").where(F.col("rank") <= k)
    legs = [_of(vector, questions, "complex").where(F.col("rank") <= 2 * k), _of(keyword, questions, "complex")]
    fused = _with_files(K.reciprocal_rank_fusion(legs), *legs).where(F.col("rank") <= 3 * k)
    best = rerank_by_words(fused, questions, texts, least if rebalanced else 0.0, 2 * k)
    if rebalanced:
        best = K.rebalance(best).where(F.col("rank") <= 2 * k)
    if spread_by is None:
        spread = K.diversify(best, 2, k)
    else:
        own, asked = spread_by
        spread = mmr_rerank(best.join(own.select("id", "vector"), "id", "left").join(asked.select("query_id", F.col("vector").alias("query_vector")), "query_id"), k)
    pick = ["query_id", "id", "rank"]
    return exact.select(pick).unionByName(concept.select(pick)).unionByName(spread.select(pick))


def multi_query(variants: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, id, rank): hits of all variants of a question, each once, in order of variant and rank.

    ``variants`` is (query_id, variant, text); ``search`` answers (query_id, text)
    with ranked lists. Variants are numbered below 1,000.
    """
    found = search(variants.select((F.col("query_id") * 1000 + F.col("variant")).alias("query_id"), "text"))
    first = found.groupBy(F.floor(F.col("query_id") / 1000).alias("query_id"), "id").agg(F.min(F.struct((F.col("query_id") % 1000).alias("variant"), "rank")).alias("first"))
    return K.renumber(first, "first", "id").select("query_id", "id", "rank")


def compressed(hits: DataFrame, questions: DataFrame, texts: DataFrame, passage: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, id, rank, passage): what of each hit bears on its question; hits of which nothing is left go, ranks close up."""
    cut = K.with_texts(hits.join(questions.select("query_id", "question"), "query_id"), texts).withColumn("passage", passage(F.col("question"), F.col("text")))
    return K.renumber(cut.where("passage <> ''"), "rank").select("query_id", "id", "rank", "passage")


def comparison(questions: DataFrame, in_file: DataFrame, of_entity: DataFrame, plain: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank) of a balanced answer to a comparison.

    ``questions`` is (query_id, files, entities), arrays in order of mention.
    Two files or more: ``k // 2 + 1`` hits inside each of the first two, interleaved,
    ``k`` in all. Else two entities or more: ``k // 2`` hits of the question with
    each added, interleaved; a row that both find comes twice. Else the list
    ``plain``, of which 2k rows are spread over files, ``k // 2`` of each at most.
    ``in_file`` and ``of_entity`` are lists with a column ``side``, 0 or 1.
    """
    files, entities = F.coalesce(F.size("files"), F.lit(0)), F.coalesce(F.size("entities"), F.lit(0))
    way = F.when(files >= 2, "files").when(entities >= 2, "entities").otherwise("plain")
    ways = questions.select("query_id", way.alias("way"))
    of = lambda hits, name: hits.join(ways.where(F.col("way") == name).select("query_id"), "query_id", "left_semi")

    def pair(hits: DataFrame, each: int) -> DataFrame:
        side = lambda n: hits.where(F.col("side") == n).where(F.col("rank") <= each).select("query_id", "id", "rank")
        return K.interleave(side(0), side(1)).select("query_id", "id", "rank")

    spread = K.cap_per_file(K.diversity_rerank(of(plain, "plain").where(F.col("rank") <= 2 * k), 0.3 * 0.5), k // 2, k)
    parts = [pair(of(in_file, "files"), k // 2 + 1).where(F.col("rank") <= k), pair(of(of_entity, "entities"), k // 2), spread.select("query_id", "id", "rank")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def general(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): of 2k hits two of a file at most; for an overview, of 4k hits one of every file at least, three at most."""
    wide = questions.select("query_id", R.has_any(F.lower("question"), R.OVERVIEW_PHRASES).alias("overview"))
    known = hits.join(wide, "query_id")
    some = K.cap_per_file(K.diversity_rerank(known.where("not overview").where(F.col("rank") <= 2 * k), 0.3 * 0.7), 2, k)
    every = K.overview_cap(K.diversity_rerank(known.where("overview").where(F.col("rank") <= 4 * k), 0.3 * 0.7), 3, k)
    return some.select("query_id", "id", "rank").unionByName(every.select("query_id", "id", "rank"))
