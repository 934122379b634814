"""Review profile, usage and reporting operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts from mild to strict, then the one that stays; confidences up to which findings are advice, and from which they count.
VERDICTS, UNKNOWN = ("APPROVE", "APPROVE*", "REQUEST_CHANGES", "BLOCK"), "UNKNOWN"
ADVICE, COUNTS = 0.65, 0.80


def verdicts(reviews: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """key and verdict of each review (key, model): the stricter of the model's and the floor of its findings (key, effort, confidence).

    A finding of high effort blocks, two of medium effort that count request changes, one approves with reservations. A
    model that does not know stays so; if all findings are advice and none is of high effort, the review approves.
    """
    effort, counts = F.col("effort"), F.col("confidence") > COUNTS
    per = findings.groupBy(*key).agg(F.max((effort == "high").cast("int")).alias("high"), F.sum(((effort == "medium") & counts).cast("int")).alias("medium"), F.max("confidence").alias("sure"))
    joined = reviews.join(per, key, "left")
    floor = F.when(F.col("high") == 1, 4).when(F.col("medium") >= 2, 3).when(F.col("medium") == 1, 2).otherwise(1)
    ladder = F.array(*map(F.lit, VERDICTS))
    own = F.greatest(F.array_position(ladder, F.col("model")).cast("int"), floor)
    advice = (F.col("sure") <= ADVICE) & (F.col("high") == 0)
    return joined.select(*key, F.when(F.col("model") == UNKNOWN, UNKNOWN).when(advice, VERDICTS[0]).otherwise(F.element_at(ladder, own)).alias("verdict"))


#: Letter grades from best to worst with the verdict that each implies.
GRADE_VERDICTS = {"A": "APPROVE", "B": "APPROVE", "C": "APPROVE*", "D": "REQUEST_CHANGES", "F": "BLOCK"}


def stratified(items: DataFrame, key: str, category: str, effort: str, first: list[str], n: int) -> DataFrame:
    """``n`` items: the one of most effort of each category in ``first``, then the others by effort."""
    own = Window.partitionBy(category).orderBy(F.desc(effort), key)
    marked = items.withColumn("lead", (F.row_number().over(own) == 1) & F.col(category).isin(*first))
    return marked.orderBy(F.desc("lead"), F.desc(effort), key).limit(n).drop("lead")


def activity(weekly: DataFrame) -> DataFrame:
    """author and score in a period: weighted shares, each from least to most of the period."""
    weights = {"commits": 0.22, "prs": 0.26, "lines": 0.26, "complexity": 0.11, "ticketed": 0.15}
    sums = weekly.groupBy("author").agg(*[F.sum(c).cast("double").alias(c) for c in weights])
    bounds = sums.agg(*[f(c).alias(f"{c}_{n}") for c in weights for n, f in (("low", F.min), ("high", F.max))])
    share = lambda c: F.when(F.col(f"{c}_high") > F.col(f"{c}_low"), (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low"))).otherwise(0.0)
    return sums.join(F.broadcast(bounds)).select("author", sum((w * share(c) for c, w in weights.items()), F.lit(0.0)).alias("score"))  # bounds: one row


def week_spans(first: Column, last: Column) -> Column:
    """Mondays of the ISO weeks from one date to another."""
    return F.sequence(F.date_trunc("week", first).cast("date"), last.cast("date"), F.expr("interval 7 days"))


def daily_cost(usage: DataFrame, prices: DataFrame, other: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tokens and cost by day. Prices (family, input, output, and place, their order) are for a million tokens; a model has those of the first family that its name contains, ignoring case, or ``other``.

    Usage is summed by day and model before models meet the families, which are a short list of the caller's.
    """
    used = usage.groupBy(F.to_date("ts").alias("day"), "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    listed = [(r.family.lower(), float(r.input), float(r.output)) for r in prices.orderBy("place").collect()]
    rates = [F.lit(x) for x in other]
    for family, *own in reversed(listed):
        held = F.contains(F.lower("model"), F.lit(family))
        rates = [F.when(held, own[i]).otherwise(rates[i]) for i in range(2)]
    cost = (F.col("input_tokens") * rates[0] + F.col("output_tokens") * rates[1]) / 1e6
    return used.groupBy("day").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost"))


def claims(events: DataFrame, stale_hours: int) -> DataFrame:
    """The claims (state in_progress) that are granted, each key's in order of time.

    The first is; a later one is if more than ``stale_hours`` have passed since the last that was granted, as a rejected
    claim renews nothing; none is after a completion. Each grant depends on the one before, so a key's events are folded
    in order; a key is one review of one commit.
    """
    keys = ["owner", "repo", "pr", "sha"]
    others = [c for c in events.columns if c not in keys]
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp("at").alias("t"), (F.col("state") != "completed").alias("asks"), F.struct(*others).alias("row")))).alias("all"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("done"), F.expr("array()").cast(lists.schema["all"].dataType).alias("granted"))

    def step(s: Column, e: Column) -> Column:
        grant = e["asks"] & ~s["done"] & (s["last"].isNull() | (e["t"] - s["last"] > stale_hours * 3600))
        return F.struct(F.when(grant, e["t"]).otherwise(s["last"]).alias("last"), (s["done"] | ~e["asks"]).alias("done"), F.when(grant, F.concat(s["granted"], F.array(e))).otherwise(s["granted"]).alias("granted"))

    granted = lists.select(*keys, F.explode(F.aggregate("all", start, step)["granted"]).alias("e"))
    return granted.select(*keys, "e.row.*").select(*events.columns)


def merge_rules(rules: DataFrame) -> DataFrame:
    """Rules (id, source, body): a later source's body, at the place where the id was first seen."""
    return rules.groupBy("id").agg(F.min("source").alias("place"), F.max_by("body", "source").alias("body"))


def contribute(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with those of another producer: nodes that exist stay, edges to unknown nodes and repeated ones go."""
    all_nodes = nodes.unionByName(more_nodes.join(nodes.select("id"), "id", "left_anti"))
    ids = all_nodes.select("id")
    known = more_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return all_nodes, edges.unionByName(known.select(*edges.columns)).distinct()


#: Words of contributed edges and what kind they are.
EDGE_WORDS = {"reads": "Reads", "writes": "Writes", "references": "References", "calls_function": "CallsFunction", "calls_proc": "CallsFunction", "accesses_resource": "AccessesResource"}


def united(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (by id) and edges (by src, dst and kind) with those of another graph that aren't there yet; further columns are the first graph's own.

    Of several new rows with one key the least stays, column by column. Edges to nodes that neither graph has stay too.
    """

    def with_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        rest = [c for c in old.columns if c not in key]
        once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_rest")).select(*key, *[F.col(f"_rest.{c}").alias(c) for c in rest]) if rest else new.select(*key).distinct()
        have = old.select(*key).distinct().alias("old")
        fresh = once.alias("new").join(have, F.expr(" and ".join(f"old.{k} <=> new.{k}" for k in key)), "left_anti")
        return old.unionByName(fresh.select(*old.columns))

    return with_new(nodes, more_nodes, ["id"]), with_new(edges, more_edges, ["src", "dst", "kind"])


def replace_contributions(kept: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions after each producer in ``new`` has replaced all of its own, and producer and replaced, whether it had any.

    Rows (producer, id, src, dst, kind, tag) are nodes (id), edges (src, dst) or, with neither, the mark of a producer
    that may have nothing else; a producer that only has its mark in ``new`` is emptied. Rows without producer go.
    """
    told = new.filter("producer is not null")
    producers = told.select("producer").distinct()
    before = kept.join(F.broadcast(producers), "producer", "left_semi").select("producer").distinct().withColumn("replaced", F.lit(True))
    flags = producers.join(before, "producer", "left").select("producer", F.coalesce("replaced", F.lit(False)).alias("replaced"))
    return kept.join(F.broadcast(producers), "producer", "left_anti").unionByName(told), flags


def without_producer(kept: DataFrame, producer: str) -> DataFrame:
    return kept.filter(F.col("producer") != F.lit(producer))


def merge_contributions(nodes: DataFrame, edges: DataFrame, kept: DataFrame, tags: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id), edges (src, dst, kind) and one row of counts after all contributions are merged in order of producer.

    A node that exists stays. An edge's kind is told by its word, else by its tag, where ``tags`` and custom:... stand for
    themselves; others are dropped, as are edges to nodes that no producer up to their own has given, and repeated ones.
    Merging again changes nothing. Each node has the first producer that gives it, so that no producer waits for another.
    """
    given = kept.filter("id is not null").select("producer", "id")
    first = nodes.select("id", F.lit("").alias("since")).unionByName(given.select("id", F.col("producer").alias("since"))).groupBy("id").agg(F.min("since").alias("since"))
    known = lambda c: F.when(F.col(c).isin(*tags) | F.startswith(F.col(c), F.lit("custom:")), F.col(c)) if tags else F.when(F.startswith(F.col(c), F.lit("custom:")), F.col(c))
    word = F.coalesce(*[F.when(F.col("kind") == w, k) for w, k in EDGE_WORDS.items()], known("kind"), known("tag"))
    drawn = kept.filter("src is not null or dst is not null").select("producer", "src", "dst", word.alias("kind"))
    for end in ("src", "dst"):
        drawn = drawn.join(first.select(F.col("id").alias(end), F.col("since").alias(f"{end}_since")), end, "left")
    there = F.coalesce((F.col("src_since") <= F.col("producer")) & (F.col("dst_since") <= F.col("producer")), F.lit(False))
    fate = F.when(F.col("kind").isNull(), "unknown").when(~there, "dangling").otherwise("good")
    drawn = drawn.select("src", "dst", "kind", fate.alias("fate"))
    fresh = drawn.filter("fate = 'good'").select("src", "dst", "kind").distinct().join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    fates = drawn.agg(F.count_if(F.col("fate") == "good").alias("good"), F.count_if(F.col("fate") == "dangling").alias("edges_dangling"), F.count_if(F.col("fate") == "unknown").alias("edges_unknown_kind"))
    counts = [first.agg(F.count_if(F.col("since") != "").alias("nodes_added")), given.agg(F.count("*").alias("given")), fates, fresh.agg(F.count("*").alias("edges_added"))]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])  # each column stands in one of four rows
    stats = one.select("nodes_added", (F.col("given") - F.col("nodes_added")).alias("nodes_existing"), "edges_added", (F.col("good") - F.col("edges_added")).alias("edges_duplicate"), "edges_dangling", "edges_unknown_kind")
    return first.select("id"), edges.select("src", "dst", "kind").unionByName(fresh), stats


def trend_tags(findings: DataFrame, group: str, cluster: str, place: str, period: str, confidence: str) -> DataFrame:
    """Findings with trend: of a group's clusters, new ones are in its latest period alone, resolved ones aren't in it.

    The latest period is the one whose first finding comes last by ``place``, a distinct number in its group. A cluster in
    the latest and an earlier period is worsening if its last confidence is over its first by more than 0.1, else recurring.
    """
    latest = findings.groupBy(group, period).agg(F.min(place).alias("_first")).groupBy(group).agg(F.max_by(period, "_first").alias("_latest"))
    marked = findings.join(latest, group)
    now = F.col(period) == F.col("_latest")
    spans = marked.groupBy(group, cluster).agg(F.bool_or(now).alias("_now"), F.bool_or(~now).alias("_then"), F.min_by(confidence, place).alias("_from"), F.max_by(confidence, place).alias("_to"))
    both = F.col("_now") & F.col("_then")
    trend = F.when(both & (F.col("_to") > F.col("_from") + 0.1), "worsening").when(both, "recurring").when(F.col("_now"), "new").otherwise("resolved")
    return findings.join(spans.select(group, cluster, trend.alias("trend")), [group, cluster])


def history_scores(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """conversation, turn, cost and score: the share of a turn's words that are distinct x their mean rarity in the conversation x the logarithm of its bytes.

    A word is what is left of letters and digits between spaces, in lower case. Scores are rounded to nine digits, as
    sums depend on their order. A null turn is an empty one.
    """
    own = turns.select(conversation, turn, F.coalesce(text, F.lit("")).alias("_text"))
    words = F.filter(F.transform(F.split("_text", r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", ""))), lambda w: w != "")
    cost = F.floor(F.size(F.filter(F.split("_text", r"\s+"), lambda w: w != "")) * 1.3).cast("long")
    told = own.select(conversation, turn, cost.alias("cost"), F.log(F.greatest(F.octet_length("_text"), F.lit(1)).cast("double")).alias("_long"), words.alias("_words"))
    sizes = told.groupBy(conversation).agg(F.count("*").alias("_turns"))
    terms = told.select(conversation, turn, F.explode(F.array_distinct("_words")).alias("_term"))
    df = terms.groupBy(conversation, "_term").agg(F.count("*").alias("_df")).join(sizes, conversation)
    rare = terms.join(df, [conversation, "_term"]).groupBy(conversation, turn).agg(F.avg(F.greatest(F.log(F.col("_turns") / F.col("_df")), F.lit(0.0)) + 1).alias("_rare"))
    share = F.size(F.array_distinct("_words")) / F.size("_words")
    score = F.when(F.size("_words") > 0, share * F.col("_rare") * F.col("_long")).otherwise(0.0)
    return told.join(rare, [conversation, turn], "left").select(conversation, turn, "cost", F.round(score, 9).alias("score"))


def compress_history(turns: DataFrame, conversation: str, turn: str, text: str, budget: int | None = None, keep_last: int = 6) -> DataFrame:
    """The turns that stay: a conversation's first, its last ``keep_last``, and of those between, by falling score, each that still fits into what the budget leaves; all without a budget.

    Turns have distinct numbers in their conversation; of equal scores the earlier turn is first. A conversation's numbers
    (turn, cost, score) are gathered in one row, its texts are not.
    """
    if budget is None:
        return turns
    row = F.struct(F.col(turn).alias("turn"), "cost", "score")
    lists = history_scores(turns, conversation, turn, text).groupBy(conversation).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    n = F.size("_all")
    ends = F.when(n <= keep_last + 1, F.col("_all")).otherwise(F.concat(F.slice("_all", 1, 1), F.slice("_all", n - keep_last + 1, F.lit(keep_last))))
    middle = F.when(n <= keep_last + 1, F.slice("_all", 1, 0)).otherwise(F.slice("_all", F.lit(2), n - keep_last - 1))
    ranked = F.array_sort(middle, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["turn"] < b["turn"], -1).otherwise(1))
    room = F.greatest(F.lit(budget) - F.aggregate(F.col("_ends"), F.lit(0).cast("long"), lambda s, x: s + x["cost"]), F.lit(0)).cast("long")
    start = F.struct(F.col("_room").alias("left"), F.transform(F.slice("_all", 1, 0), lambda x: x["turn"]).alias("kept"))
    step = lambda s, x: F.struct(F.when(x["cost"] <= s["left"], s["left"] - x["cost"]).otherwise(s["left"]).alias("left"), F.when(x["cost"] <= s["left"], F.concat(s["kept"], F.array(x["turn"]))).otherwise(s["kept"]).alias("kept"))
    lists = lists.withColumns({"_ends": ends, "_ranked": ranked}).withColumn("_room", room)
    kept = lists.select(conversation, F.explode(F.concat(F.transform("_ends", lambda x: x["turn"]), F.aggregate("_ranked", start, step)["kept"])).alias(turn))
    return turns.join(kept, [conversation, turn], "left_semi")


def turn_scores(turns: DataFrame, key: list[str], tokens: str) -> DataFrame:
    """Score of each turn: share of unique tokens x their mean inverse frequency x the logarithm of the length."""
    n = turns.agg(F.count("*").alias("n"))
    terms = turns.select(*key, F.size(tokens).alias("length"), F.size(F.array_distinct(tokens)).alias("kinds"), F.explode(F.array_distinct(tokens)).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.0)) + 1
    joined = terms.join(df, "term").join(F.broadcast(n))
    return joined.groupBy(*key, "length", "kinds").agg(F.avg(rarity).alias("rarity")).select(*key, (F.col("kinds") / F.col("length") * F.col("rarity") * F.log(F.col("length"))).alias("score"))


def compress(turns: DataFrame, conversation: str, turn: str, cost: str, score: str, budget: int, pinned: int = 1) -> DataFrame:
    """The first and last turns of each conversation and, by score, as many of the others as the budget takes."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(turn)
        kept = set(pdf.index[:pinned]) | set(pdf.index[-pinned:])
        used = pdf.loc[list(kept), cost].sum()
        for i in pdf.sort_values([score, turn], ascending=[False, True]).index:
            if i not in kept and used + pdf.at[i, cost] <= budget:
                kept.add(i)
                used += pdf.at[i, cost]
        return pdf.loc[sorted(kept, key=lambda i: pdf.at[i, turn])]

    return turns.groupBy(conversation).applyInPandas(keep, turns.schema)


#: Predicates and the phrases between their subject and object; what triples of notes carry; tags that exclude a note.
PHRASES = (("is-a", (" is a ", " is an ")), ("works-at", (" works at ",)), ("uses", (" uses ", " using ")), ("depends-on", (" depends on ", " requires ")))
AUTO_CONFIDENCE, AUTO_PROVENANCE = 0.6, "auto:remember"


def extract_triples(notes: DataFrame, deny_tags: tuple[str, ...] = ()) -> DataFrame:
    """subject, predicate, object, confidence and provenance of notes (id, room, tags, content).

    Tags, rooms and hashtags are subjects of their own, so that one note may have several; of each predicate's phrases the
    first in the list that occurs gives the words on its sides. A note with a denied tag gives nothing.
    """
    drawer, lower = F.concat(F.lit("drawer:"), F.col("id").cast("string")), F.lower("content")
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    clean = F.filter(F.transform(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    marks = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"#([A-Za-z0-9_-]+)"), F.lit(1)), F.lower))
    word = lambda x: F.regexp_replace(x, r"[,.;:!?\"']+$", "")
    found = []
    for name, phrases in PHRASES:
        at = F.coalesce(*[F.when(F.contains(lower, F.lit(p)), F.struct(F.locate(p, lower).alias("at"), F.lit(len(p)).alias("n"))) for p in phrases])
        left = word(F.element_at(F.split(F.trim(F.substring(lower, F.lit(1), at["at"] - 1)), r"\s+"), -1))
        right = word(F.split(F.trim(F.substring(lower, at["at"] + at["n"], F.length(lower))), r"\s+")[0])
        found.append(F.when((left != "") & (right != ""), triple(left, name, right)))
    room = F.trim("room")
    parts = F.concat(
        F.transform(clean, lambda x: triple(F.concat(F.lit("tag:"), x), "tags", drawer)), F.array_compact(F.array(F.when(room != "", triple(F.concat(F.lit("room:"), room), "contains", drawer)))),
        F.transform(F.coalesce(marks, F.expr("cast(array() as array<string>)")), lambda x: triple(F.concat(F.lit("topic:"), x), "mentioned-in", drawer)), F.array_compact(F.array(*found)),
    )
    allowed = notes.filter(~F.arrays_overlap(clean, F.array(*map(F.lit, deny_tags)))) if deny_tags else notes
    out = allowed.select(F.explode(F.array_distinct(parts)).alias("t"))
    return out.select(F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), F.lit(AUTO_CONFIDENCE).alias("confidence"), F.lit(AUTO_PROVENANCE).alias("provenance"))
