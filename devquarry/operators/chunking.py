"""Chunks of files, calls and the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_windows(files: DataFrame, key: str, text: str, size: int = 150, stride: int = 50) -> DataFrame:
    """key, start, end and content of windows of lines; the first that reaches the end is the last."""
    lines = files.select(key, F.split(text, "\n").alias("lines")).withColumn("n", F.size("lines"))
    last = F.greatest(F.ceil((F.col("n") - size) / stride), F.lit(0)) * stride
    starts = lines.select(key, "lines", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long"))).alias("at"))
    return starts.select(key, (F.col("at") + 1).alias("start"), F.least(F.col("at") + size, "n").cast("long").alias("end"), F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.lit(size)), "\n").alias("content"))


def split_oversized(chunks: DataFrame, most: int = 200, size: int = 100, stride: int = 50, emptied: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (id, file, start_line, end_line, content) with parent_id and child_ids; those of more than ``most`` lines also as windows of ``size`` lines.

    Windows begin ``stride`` lines apart, the first that reaches the end is the last, and their ids are the parent's with
    ::sub:: and a number. The parent stays and lists them. Further columns are the parent's; arrays named in ``emptied``
    are empty in windows. Null content has no windows.
    """
    split = F.split(F.coalesce("content", F.lit("")), "\r?\n")
    lines = chunks.withColumn("_lines", F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split))
    n = F.size("_lines")
    large = (F.col("end_line") - F.col("start_line") + 1 > most) & (n > 0)
    places = F.when(large, F.sequence(F.lit(0), (F.ceil(F.greatest(n - size, F.lit(0)) / stride)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    name = lambda i: F.concat(F.col("id").cast("string"), F.lit("::sub::"), i.cast("string"))

    def window(i):
        at = i * stride
        return F.struct(
            name(i).alias("id"), (F.col("start_line") + at).cast("long").alias("start_line"), (F.col("start_line") + F.least(at + size, n) - 1).cast("long").alias("end_line"),
            F.array_join(F.slice("_lines", at + 1, F.lit(size)), "\n").alias("content"), F.col("id").cast("string").alias("parent_id"), F.expr("cast(array() as array<string>)").alias("child_ids"),
        )

    own = F.struct(F.col("id").cast("string").alias("id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("content").alias("content"), F.lit(None).cast("string").alias("parent_id"), F.transform(places, name).alias("child_ids"))
    rest = [c for c in chunks.columns if c not in ("id", "start_line", "end_line", "content")]
    out = lines.select(*rest, F.explode(F.concat(F.transform(places, window), F.array(own))).alias("_chunk")).select(*rest, "_chunk.*")
    for c in emptied:
        out = out.withColumn(c, F.when(F.col("parent_id").isNull(), F.col(c)).otherwise(F.slice(c, 1, 0)))
    return out


def heading_chunks(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, heading and lines of Markdown cut at headings."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    own = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(F.col("line").rlike(r"^#{1,6} ").cast("int")).over(own))
    return marked.groupBy(key, "section").agg(F.min_by("line", "n").alias("heading"), F.count("*").alias("lines"))


def calls(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key and callee of textual calls, keywords left out."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    return chunks.select(key, F.explode(names).alias("callee")).filter(~F.col("callee").isin("if", "for", "while", "match", "switch", "return", "catch", "fn", "def", "function"))


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, callee and dst: the only node of that name, else the one in the caller's file, else null."""
    by_name = nodes.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    in_file = nodes.groupBy("file", F.col("name").alias("callee")).agg(F.min("id").alias("near"))
    joined = calls.join(by_name, "callee", "left").join(in_file, ["file", "callee"], "left")
    return joined.select("src", "callee", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("near")).alias("dst"))


#: Callers with more callees than this have their pairs made distinct by a shuffle; callees with more callers are several tasks' work.
MANY_CALLEES, MANY_CALLERS = 64, 4096


def tests_of_same(calls: DataFrame, many_callees: int = MANY_CALLEES, many_callers: int = MANY_CALLERS) -> DataFrame:
    """Both directions of all pairs that call one callee, each once.

    A pair is made at the smallest callee that both call: a row carries its caller's smaller callees, so the pairs, which
    are far more than the rows, are never shuffled. Only pairs with a caller of more than ``many_callees``, if there is
    one, are made distinct. Pairs of a callee of more than ``many_callers`` are dealt by a salt of ``src``.
    """
    calls = calls.select("src", "callee").filter("src is not null and callee is not null")
    over = lambda key, most: calls.groupBy(key).agg(F.count("*").alias("calls")).filter(F.col("calls") > most)
    mine = Window.partitionBy("src")
    before = F.collect_list("callee").over(mine.orderBy("callee").rowsBetween(-many_callees, -1))
    rows = calls.repartition("src").distinct().select("src", "callee", before.alias("before"), (F.count("*").over(mine) > many_callees).alias("many"))
    large = F.broadcast(over("callee", many_callers).select("callee", F.ceil(F.col("calls") / many_callers).cast("int").alias("salts")))

    def pairs(a: DataFrame, b: DataFrame) -> list[DataFrame]:
        salted = a.join(large, "callee").withColumn("salt", F.pmod(F.xxhash64("src"), "salts").cast("int"))
        dealt = b.join(large, "callee").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        out = []
        for x, y, on in ((a.join(large, "callee", "left_anti"), b.join(large, "callee", "left_anti"), ["callee"]), (salted, dealt, ["callee", "salt"])):
            x, y = x.alias("x"), y.hint("merge").alias("y")
            same = F.col("x.src") != F.col("y.src")
            for key in on:
                same &= F.col(f"x.{key}") == F.col(f"y.{key}")
            out.append(x.join(y, same))
        return out

    def ends(joined: list[DataFrame]) -> DataFrame:
        one, two = (j.select(F.col("x.src").alias("src"), F.col("y.src").alias("dst")) for j in joined)
        return one.unionByName(two)

    few = rows.filter("not many").drop("many")
    once = ends([j.filter("not arrays_overlap(x.before, y.before)") for j in pairs(few, few)])
    if over("src", many_callees).isEmpty():
        return once
    rows = rows.drop("before")
    rest = ends(pairs(rows.filter("many"), rows)).unionByName(ends(pairs(rows.filter("not many"), rows.filter("many"))))
    return once.unionByName(rest.distinct())


def test_groups(calls: DataFrame) -> DataFrame:
    """callee, src and tests, the number of distinct callers of the callee, of each caller that has a sibling: the pairs of ``tests_of_same`` in a row for each member."""
    own = calls.select("src", "callee").filter("src is not null").distinct()
    sizes = own.groupBy("callee").agg(F.count("*").alias("tests")).filter("tests > 1")
    return own.join(sizes, "callee").select("callee", "src", "tests")


def siblings(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """src and dst: the siblings of some callers (src), looked up in their groups."""
    mine = groups.join(asked.select("src").distinct(), "src", "left_semi").select("src", "callee")
    return mine.join(groups.select("callee", F.col("src").alias("dst")), "callee").filter("src <> dst").select("src", "dst").distinct()
