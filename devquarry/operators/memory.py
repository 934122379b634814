"""Memory store: recall, triples, analytics."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import scores


@F.pandas_udf(LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits as a signed long; arithmetic that wraps has no builtin."""

    def one(s):
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return text.map(one)


def essentials(drawers: DataFrame, n: int = 15) -> DataFrame:
    return drawers.orderBy(F.desc("importance"), "id").limit(n)


def decayed(drawers: DataFrame, now: Column) -> DataFrame:
    age = scores.age_days(F.col("created_at"), now)
    return drawers.withColumn("effective", scores.effective_importance(F.col("importance"), age, scores.access_boost(F.col("access_count"))))


def recall(drawers: DataFrame, similar: DataFrame, top_k: int, penalty: float = 0.5) -> DataFrame:
    """id, layer and score: similar ones (id, score) as layer 2, else essentials as layer 1 at ``penalty`` of their importance."""
    first = essentials(drawers).select("id", F.lit(1).alias("layer"), (F.col("importance") * penalty).alias("score"))
    second = similar.select("id", F.lit(2).alias("layer"), "score")
    both = first.unionByName(second).groupBy("id").agg(F.max("layer").alias("layer"), F.max_by("score", "layer").alias("score"))
    return both.orderBy(F.desc("score"), "id").limit(top_k)


def purge_expired(drawers: DataFrame, now: Column) -> DataFrame:
    return drawers.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def miss_rate(events: DataFrame, since: Column) -> DataFrame:
    """One row: distinct missed query hashes over distinct query hashes since a time; 0 without queries."""
    own = events.filter(F.col("occurred_at") >= since)
    missed = F.countDistinct(F.when(F.col("drawer_id").isNull(), F.col("query_hash")))
    return own.agg(missed.alias("missed"), F.countDistinct("query_hash").alias("asked")).withColumn("rate", F.when(F.col("asked") > 0, F.col("missed") / F.col("asked")).otherwise(0.0))


def validity(triples: DataFrame) -> DataFrame:
    """valid_to of each assertion: when the next of its subject and predicate begins."""
    own = Window.partitionBy("subject", "predicate").orderBy("valid_from", "object")
    return triples.withColumn("valid_to", F.lead("valid_from").over(own))


def active(triples: DataFrame) -> DataFrame:
    return triples.filter("valid_to is null")


def merge_facts(facts: DataFrame) -> DataFrame:
    """One fact for each (subject, predicate, object): provenance united and sorted, first creation, last confidence between 0 and 1."""
    clamped = F.greatest(F.least(F.max_by("confidence", "created_at"), F.lit(1.0)), F.lit(0.0))
    return facts.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("provenance")).alias("provenance"), F.min("created_at").alias("created_at"), clamped.alias("confidence"))


def prompt_sections(triples: DataFrame) -> DataFrame:
    """predicate and its active facts, a line each."""
    line = F.format_string("- %s: %s", "subject", "object")
    return active(triples).groupBy("predicate").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("section"))


def hits_of(events: DataFrame) -> DataFrame:
    """drawer_id and hits of recalled drawers."""
    return events.filter("drawer_id is not null").groupBy("drawer_id").agg(F.count("*").alias("hits"))


def top_drawers(events: DataFrame, limit: int = 10) -> DataFrame:
    return hits_of(events).orderBy(F.desc("hits"), "drawer_id").limit(limit)


def top_misses(events: DataFrame, limit: int = 10) -> DataFrame:
    """query_hash and misses of the queries that found nothing most often."""
    return events.filter("drawer_id is null").groupBy("query_hash").agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "query_hash").limit(limit)


def match_facts(facts: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Facts with the given parts; None matches all."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        facts = facts.filter(F.col(name) == F.lit(value)) if value is not None else facts
    return facts


def neighbours_of(triples: DataFrame, entity: str) -> DataFrame:
    """predicate, other end and direction of an entity's active triples."""
    own = active(triples)
    out = own.filter(F.col("subject") == entity).select("predicate", F.col("object").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(own.filter(F.col("object") == entity).select("predicate", F.col("subject").alias("other"), F.lit("in").alias("direction"))).distinct()


def retract(triples: DataFrame, subject: str, predicate: str, at: Column) -> DataFrame:
    """The triples with the active one of a subject and predicate closed."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & F.col("valid_to").isNull()
    return triples.withColumn("valid_to", F.when(hit, at).otherwise(F.col("valid_to")))


def recall_across(results: DataFrame, top_k: int) -> DataFrame:
    """Of recalls in several palaces (palace, id, score) the best of all."""
    return results.orderBy(F.desc("score"), "palace", "id").limit(top_k)


def with_expiry(drawers: DataFrame, days: int = 7) -> DataFrame:
    """Drawers whose session events expire after ``days``."""
    return drawers.withColumn("expires_at", F.when(F.col("kind") == "session_event", F.col("created_at") + F.make_dt_interval(F.lit(days))).otherwise(F.lit(None)))


def batch_key(rows: DataFrame, batch: str, key: str, content: str) -> DataFrame:
    """batch and the first 16 bytes, in hex, of the SHA-256 of its contents in the order of their keys; a batch is of bounded size."""
    listed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(key, content))).alias("all"))
    return listed.select(batch, F.substring(F.sha2(F.array_join(F.transform("all", lambda x: x[content]), "\n"), 256), 1, 32).alias("cache_key"))


def consolidate(drawers: DataFrame, actions: DataFrame) -> DataFrame:
    """Drawers (id, importance, tags) after actions (kept, superseded): a kept one takes the greatest importance and all tags, superseded ones go."""
    named = drawers.join(actions.select(F.col("superseded").alias("id"), "kept"), "id", "left").withColumn("owner", F.coalesce("kept", "id"))
    return named.groupBy(F.col("owner").alias("id")).agg(F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


#: The fields of a model's actions, those that each kind needs, and the least importance of merged drawers.
ACTION = "array<struct<action:string,`from`:string,`to`:string,canonical_content:string,superseded_ids:array<string>,drawer_id:string,reason:string>>"
NEEDED = {"alias": ("from", "to"), "merge": ("canonical_content", "superseded_ids"), "flag": ("drawer_id", "reason")}
LEAST_IMPORTANCE = 0.5


def parsed_actions(answer: Column) -> Column:
    """The actions in a model's answer, from its first [ to its last ]; none if that is no list of whole, known actions."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), ACTION)

    def whole(a: Column) -> Column:
        known = F.lit(False)
        for kind, needs in NEEDED.items():
            own = a["action"] == kind
            for n in needs:
                own = own & a[n].isNotNull()
            known = known | own
        return F.coalesce(known, F.lit(False))

    return F.when(F.forall(found, whole), found).otherwise(F.from_json(F.lit("[]"), ACTION))


def planned_calls(batches: DataFrame, cache: DataFrame, most: int = 20) -> DataFrame:
    """batch, cache_key and answer of the batches (batch, cache_key) of a cycle: answered from the cache, or with no answer and to be asked.

    Batches go in their order until ``most`` calls are used up. A key that occurs again is asked once. Of several cached answers of a key the smallest counts.
    """
    known = batches.join(cache.groupBy("cache_key").agg(F.min("answer").alias("answer")), "cache_key", "left")
    asked = known.filter("answer is null").groupBy("cache_key").agg(F.min("batch").alias("first"))
    last = asked.orderBy("first").limit(most).agg(F.max("first").alias("last"), F.count("*").alias("n"))
    # the cycle ends as soon as its calls are used up, cached batches after the last call included
    return known.join(F.broadcast(last)).filter((F.col("n") < most) | (F.col("batch") <= F.col("last"))).select("batch", "cache_key", "answer")


def applied_actions(drawers: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merged drawers, aliases, flags and superseded ids from the answers (batch, answer) for drawers (batch, place, id, importance, tags).

    A merged drawer (batch, at, content, importance, tags, canonical_for) has the greatest importance of those it replaces, 0.5
    at least, and their tags in the order of drawers, each once; ids outside the batch only count as superseded.
    """
    actions = answers.select("batch", F.posexplode(parsed_actions(F.col("answer"))).alias("at", "a"))
    merges = actions.filter("a.action = 'merge'").select("batch", "at", F.col("a.canonical_content").alias("content"), F.col("a.superseded_ids").alias("canonical_for"))
    named = merges.select("batch", "at", F.explode(F.array_distinct("canonical_for")).alias("key"))
    met = named.join(drawers.select("batch", "place", F.col("id").cast("string").alias("key"), "importance", "tags"), ["batch", "key"])
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags")))), lambda x: x["tags"])))
    merged = met.groupBy("batch", "at").agg(F.max("importance").alias("most"), tags.alias("tags"))
    out = merges.join(merged, ["batch", "at"], "left").select("batch", "at", "content", F.greatest(F.coalesce("most", F.lit(LEAST_IMPORTANCE)), F.lit(LEAST_IMPORTANCE)).alias("importance"), F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"), "canonical_for")
    aliases = actions.filter("a.action = 'alias'").select("batch", "at", F.col("a.from").alias("alias"), F.col("a.to").alias("name"))
    flags = actions.filter("a.action = 'flag'").select("batch", "at", F.col("a.drawer_id").alias("id"), F.col("a.reason").alias("reason"))
    return out, aliases, flags, merges.select(F.explode("canonical_for").alias("id")).distinct()


@F.pandas_udf(LongType())
def fact_hash(subject: pd.Series, predicate: pd.Series, obj: pd.Series) -> pd.Series:
    """XXH3 of 64 bits, as a signed long, over the parts of a fact, each behind its length in eight bytes; null if a part is."""
    def one(*parts: str | None) -> int | None:
        if any(p is None for p in parts):
            return None
        raw = [p.encode() for p in parts]
        h = xxhash.xxh3_64_intdigest(b"".join(len(p).to_bytes(8, "little") + p for p in raw))
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([one(*x) for x in zip(subject, predicate, obj)], dtype="Int64")
