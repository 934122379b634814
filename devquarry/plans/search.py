"""The hybrid search plan: intent, lanes, fusion, score adjustments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as words
from ..operators import index as postings
from ..operators import retrieval

#: What a document file keeps of a definition's score, what a definition of a sought name gains, the bounds of a branch's gain, and the score of a literal hit.
DOC_KEEPS, NAME_GAINS, BRANCH_GAINS, LITERAL = 0.5, 2.0, (1.0, 3.0), 0.001
DOC_FILES = "md txt toml yaml yml json".split()
DEFINITIONS = "struct enum class trait type_alias function method".split()
#: Fixed value: what an exactly named entity gets, as a multiple of the text lane's weight.
NAMED_GETS = 1.5


@dataclass
class SearchQuery:
    text: str
    top_k: int = 10
    mode: str = "code"
    domain_terms: tuple[str, ...] = field(default=())


def reason(vector: Column, lexical: Column, graph: Column | None = None, second: str = "vector") -> Column:
    """Why a chunk was found: lanes that hold it count before the graph that led to it."""
    by_graph = F.lit(False) if graph is None else F.coalesce(graph, F.lit(False))
    v, b = F.coalesce(vector, F.lit(False)), F.coalesce(lexical, F.lit(False))
    return F.when(v & b, "hybrid").when(v, second).when(b, "bm25").when(by_graph, "hybrid+kg").otherwise("fallback:ripgrep")


def hybrid(code: postings.Index, other: postings.Index | DataFrame, query: SearchQuery, embedded: list[float] | None = None) -> DataFrame:
    """key, score, reason and intent of the best chunks: lanes of 4 x top_k, weighted by the query's intent and fused by rank.

    ``code`` indexes code tokens. The second lane is a table of vectors (key, vec), or an index of words whose repeats count.
    The lane that a chunk comes from goes through the fusion, so no lane is read twice.
    """
    name, alpha, beta, _ = words.intent(query.text, query.domain_terms)
    want = 4 * query.top_k
    lexical = postings.search(code, words.code_terms(query.text), want)
    by_words = isinstance(other, postings.Index)
    second = postings.search(other, words.chat_terms(query.text), want) if by_words else retrieval.vector_search(other, "key", "vec", embedded, want)
    lanes = [retrieval.ranked(lane, "key").select("key", (F.lit(weight) / (retrieval.RRF + F.col("rank"))).alias("part"), F.lit(first).alias("first")) for lane, weight, first in ((second, alpha, True), (lexical, beta, False))]
    fused = lanes[0].unionByName(lanes[1]).groupBy("key").agg(F.sum("part").alias("score"), F.bool_or("first").alias("a"), F.bool_or(~F.col("first")).alias("b"))
    best = fused.orderBy(F.desc("score"), "key").limit(query.top_k)
    return best.select("key", "score", reason(F.col("a"), F.col("b"), second="terms" if by_words else "vector").alias("reason"), F.lit(name).alias("intent"))


def adjust(hits: DataFrame, query: str, mode: str = "code", branch: DataFrame | None = None, branch_gain: float = 1.5) -> DataFrame:
    """Hits (key, score, file, chunk_type, name) with their final score, best first.

    A document file loses half in a query for a definition, every file what the mode takes, a definition whose name
    contains a word of the query is doubled, and files of the branch gain a factor from 1 to 3.
    """
    looks = words.intent(query)[0] == "definition"
    factor = paths.mode_penalty(F.col("file"), mode)
    if looks:
        factor = factor * F.when(paths.extension(F.col("file")).isin(*DOC_FILES), DOC_KEEPS).otherwise(1.0)
        tokens = [t.lower() for t in query.split() if len(t.encode()) >= 2]
        named = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower("name"), t)) if tokens else F.lit(False)
        factor = factor * F.when(F.col("chunk_type").isin(*DEFINITIONS) & F.coalesce(named, F.lit(False)), NAME_GAINS).otherwise(1.0)
    if branch is not None:
        gain = min(max(branch_gain, BRANCH_GAINS[0]), BRANCH_GAINS[1])
        own = branch.select("file", F.lit(gain).alias("gain")).distinct()
        hits = hits.join(own, "file", "left")
        factor = factor * F.coalesce("gain", F.lit(1.0))
    return hits.withColumn("score", F.col("score") * factor).select("key", "file", "score").orderBy(F.desc("score"), "key")


def entity_first(lane: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """key, score and rank of a lane (key, score; a top-k list) behind the chunk of an entity that the one-word query names, ignoring case; the smallest key if there are several.

    The named chunk has rank 1 and a fixed multiple of the text lane's weight as its score, whatever the others have.
    """
    word, (name, _, weight, _) = query.strip().lower(), words.intent(query)
    exact = entities.filter(F.lower("name") == word) if word and " " not in word and name in ("definition", "unknown") else entities.limit(0)
    first = exact.agg(F.min("key").alias("key")).filter("key is not null")
    rest = lane.join(F.broadcast(first), "key", "left_anti").select("key", "score")
    shift = first.agg(F.count("*").cast("int").alias("shift"))
    below = retrieval.ranked(rest, "key").join(F.broadcast(shift)).select("key", "score", (F.col("rank") + F.col("shift")).alias("rank"))
    return first.select("key", F.lit(NAMED_GETS * weight).alias("score"), F.lit(1).alias("rank")).unionByName(below)


def post_filter(hits: DataFrame, mode: str, exclude_archived: bool = False, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Hits (key, score, file, content, chunk_type, age_days) without documentation strings and files that the mode doesn't show, scaled by what archives keep."""
    allowed = hits.filter("chunk_type <> 'docstring'").filter(paths.allowed_in(F.col("file"), mode, left_out))
    keeps = paths.archive_multiplier(F.col("file"), F.col("content"), F.col("age_days"))
    scaled = allowed.withColumn("keeps", keeps)
    scaled = scaled.filter("keeps >= 0.7") if exclude_archived else scaled  # age alone is no archive
    return scaled.withColumn("score", F.col("score") * F.col("keeps")).drop("keeps").orderBy(F.desc("score"), "key")


def literal(chunks: DataFrame, key: str, text: str, query: str, want: int) -> DataFrame:
    """key and a constant score of the first chunks that contain the query as it is."""
    return chunks.filter(F.contains(F.col(text), F.lit(query))).select(F.col(key).alias("key"), F.lit(LITERAL).alias("score")).orderBy("key").limit(want)


def in_language(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int, language: str) -> DataFrame:
    """key, score and language of those of the ``top_k`` nearest vectors that are in a language, ignoring case; fewer than ``top_k`` may be."""
    best = retrieval.vector_search(vectors, key, vector, query, top_k)
    return best.join(vectors.select(key, "language"), key).filter(F.lower("language") == language.lower()).select(key, "score", "language").orderBy(F.desc("score"), key)


def rendered(hits: DataFrame, query: str, full: bool = False, truncated: bool = False) -> DataFrame:
    """One row, text: the hits (rank, file, start_line, end_line, language, content, compact_snippet, score, reason), a top-k list, as Markdown."""
    body = F.col("content") if full else F.coalesce("compact_snippet", "content")
    ended = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    head = F.format_string("\n### %d. `%s:%d-%d` [score: %.2f, %s]\n", F.col("rank"), "file", F.col("start_line"), F.col("end_line"), F.col("score"), "reason")
    text = F.concat(head, F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), ended, F.lit("```\n"))
    all_ = hits.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("items"))
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    title = F.format_string("## Search Results for \"%s\" (%d result%s)\n", F.lit(query), F.col("n"), plural)
    note = "\n_Note: results truncated to fit token budget._\n" if truncated else ""
    return all_.select(F.concat(title, F.lit(note), F.array_join(F.transform("items", lambda x: x["text"]), "")).alias("text"))
