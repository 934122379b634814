"""Author identities and similar texts."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import likeness
from .index import shared_folder
from .likeness import winkler  # noqa: F401


#: Buckets of letters whose counts bound a pair's common letters.
LETTERS = 64


def likely(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Which pairs can have a Jaro-Winkler likeness of ``least``: by lengths, common letters and beginning. For single pairs; ``likeness`` does blocks."""
    def counted(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        at, own = pd.factorize(words)
        counts = np.zeros((len(own), LETTERS), np.uint16)
        for row, w in zip(counts, own):
            for c in w:
                row[ord(c) % LETTERS] += 1
        return counts[at], own.str.len().to_numpy(np.int64)[at]

    (x, n), (y, k) = counted(a), counted(b)
    common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    jaro = np.where(common > 0, (common / np.maximum(n, 1) + common / np.maximum(k, 1) + 1) / 3, 0)
    begins = np.fromiter((next((i for i in range(4) if v[i : i + 1] != w[i : i + 1]), 4) for v, w in zip(a, b)), float, len(a))
    return (jaro + begins * 0.1 * (1 - jaro) >= least - 1e-9) | (a == b).to_numpy()


def local_part(email):
    """What stands before the @ of an e-mail, in lower case; all of it without one."""
    return F.lower(F.split(email, "@")[0])


def normalized(text):
    """Lower case, with ``.``, ``-`` and ``_`` as spaces and single spaces between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[._-]", " "), r"\s+", " "))


def same_name_pairs(authors: DataFrame) -> DataFrame:
    """source and target e-mail of authors who share a name: the smallest e-mail is the target."""
    own = Window.partitionBy(F.lower("name"))
    marked = authors.withColumn("target", F.min("email").over(own))
    return marked.filter("email <> target").select(F.col("email").alias("source"), "target")


#: Lengths up to which local parts meet on what is left without one or two characters, and from which on thirds.
SHORT, LONG = 24, 23
#: The shortest local part of a suggestion, and its confidence by edits.
LEAST_LOCAL, BY_EDITS = 3, {1: 0.85, 2: 0.78}


@F.pandas_udf(ArrayType(StringType()))
def variants(words: pd.Series) -> pd.Series:
    """What is left of each word without at most two characters, each once; two words within two edits share one."""
    def left(w: str) -> list[str]:
        once = {w[:i] + w[i + 1 :] for i in range(len(w))}
        return list({w} | once | {x[:i] + x[i + 1 :] for x in once for i in range(len(x))})

    return words.map(left)


def met_once(at: DataFrame) -> DataFrame:
    """first, second and edits of the pairs of rows (at, visits, local, tail) whose local parts are of one length and one or two edits apart, each pair once; a pair has one row at least that doesn't visit.

    Two such words either differ in one or two places, or one is the other with a letter moved. So they share what is left
    without two places, both of them told, or without one letter of a run of equal ones: keys that only such words share,
    so that next to nothing is joined that isn't found. What a key finds besides is found by another one: two places that
    don't both differ are one place, of which the words without it tell; a letter moved so that two places differ is found by
    these; a letter that may have moved either way counts to the right. Places that all words of a length have in common
    at their beginning make no keys.
    """
    sizes = at.withColumn("n", F.length("local"))
    bounds = sizes.groupBy("at", "n").agg(F.min("local").alias("lo"), F.max("local").alias("hi"))
    bounds = bounds.select("at", "n", F.expr("size(filter(sequence(1, n), i -> substring(lo, 1, i) = substring(hi, 1, i)))").alias("same"))
    places = F.expr("""if(same > n - 2, array(), flatten(transform(sequence(same, n - 2), i -> transform(sequence(i + 1, n - 1), j -> named_struct(
        'key', xxhash64(at, n, i, j, substring(local, 1, i), substring(local, i + 2, j - i - 1), substring(local, j + 2)), 'p', ascii(substring(local, i + 1, 1)), 'q', ascii(substring(local, j + 1, 1)))))))""")
    runs = F.expr("""if(same > n - 1, array(), transform(filter(sequence(same, n - 1), i -> i = n - 1 or substring(local, i + 1, 1) <> substring(local, i + 2, 1)), i -> named_struct(
        'key', xxhash64(at, n, concat(substring(local, 1, i), substring(local, i + 2))), 'p', length(trim(TRAILING substring(local, i + 1, 1) FROM substring(local, 1, i + 1))), 'q', i)))""")
    # of both sides in one term, so that it isn't pushed to one of them and the other can read the same shuffle
    once = F.expr("a.visits + 2 * b.visits < 2 and a.local <> b.local and (a.visits = 1 or a.local < b.local)")
    edits = F.levenshtein(F.col("a.local"), F.col("b.local"), 2)

    def met(made: Column, differ: Column) -> DataFrame:
        """Pairs of words that share a key, with their edits; a collision of keys gives none that isn't near."""
        keyed = sizes.join(bounds, ["at", "n"]).select("visits", "local", "tail", F.explode(made).alias("k")).select("k.*", "visits", "local", "tail")
        a, b = keyed.alias("a"), keyed.hint("merge").alias("b")  # from a small table, but many times its size: not to be broadcast
        return a.join(b, (F.col("a.key") == F.col("b.key")) & once & differ)

    two = met(places, F.expr("a.p <> b.p and a.q <> b.q")).filter(edits == 2)
    # p and q of a run are its first and last place; x is where the words differ first, y where last
    moved = met(runs, F.lit(True)).withColumns({"x": F.least("a.q", "b.q"), "y": F.greatest("a.p", "b.p")})
    inner = F.expr("substring(a.local, x + 2, y - x - 1) <> substring(b.local, x + 2, y - x - 1)")
    right = F.expr("a.q < b.q or substring(a.local, x + 2, y - x) <> substring(b.local, x + 1, y - x)")
    moved = moved.filter((edits == 1) | ((edits == 2) & inner & right))
    first, second = F.concat("a.local", "a.tail"), F.concat("b.local", "b.tail")
    ends = F.least(first, second).alias("first"), F.greatest(first, second).alias("second")
    return two.select(*ends, F.lit(2).alias("edits")).unionByName(moved.select(*ends, edits.alias("edits")))


def near_emails(authors: DataFrame) -> DataFrame:
    """first, second, edits and confidence of e-mails whose local parts, of three bytes at least, are one or two edits apart, of one domain or of two of which one ends with the other. The larger is the alias of the smaller.

    Domains meet on their endings. Short local parts of one length meet as ``met_once`` tells, those of several lengths on what is
    left without two characters at most, long ones on pieces of a third, one of which two edits leave whole: keys that only
    few parts share, so no domain is a task's work. Only pairs of the last two are told apart, as they may meet on several keys.
    """
    split = F.split("email", "@")
    part = authors.select("email", split[0].alias("local"), F.get(split, F.lit(1)).alias("domain")).filter(f"octet_length(local) >= {LEAST_LOCAL} and domain <> ''").distinct()
    domains = part.select("domain").distinct()
    endings = domains.select("domain", F.explode(F.expr("transform(sequence(2, greatest(length(domain), 2)), i -> substring(domain, i))")).alias("at"))
    visits = part.join(endings.join(domains.select(F.col("domain").alias("at")), "at"), "domain")
    at = part.select("email", "local", F.col("domain").alias("at"), F.lit(0).alias("visits")).unionByName(visits.select("email", "local", "at", F.lit(1).alias("visits")))
    at = at.select("at", "visits", "local", F.expr("substring(email, length(local) + 1)").alias("tail"))
    found = met_once(at.filter(F.length("local") <= SHORT))

    sizes = at.select("at", F.length("local").alias("n")).distinct()
    other = sizes.select("at", F.explode(F.expr("array(n - 2, n - 1, n + 1, n + 2)")).alias("n")).distinct()
    short = at.filter(F.length("local") <= SHORT).withColumn("n", F.length("local")).join(other.filter(F.col("n") <= SHORT), ["at", "n"], "left_semi").drop("n")
    pieces = F.expr("array_distinct(flatten(transform(sequence(greatest(cast(floor((length(local) - 2) / 3) as int), 1), cast(floor((length(local) + 2) / 3) as int)), k -> transform(sequence(1, length(local) - k + 1), i -> substring(local, i, k)))))")
    grams = short.withColumn("piece", F.explode(variants("local"))).unionByName(at.filter(F.length("local") >= LONG).withColumn("piece", F.explode(F.transform(pieces, lambda x: F.concat(F.lit("\0"), x)))))
    a, b = grams.alias("a"), grams.filter("visits = 0").hint("merge").alias("b")
    once = (F.col("a.visits") == 1) | (F.col("a.local") < F.col("b.local"))
    n, m = F.length("a.local"), F.length("b.local")
    whole = F.col("a.piece").startswith("\0")
    own = F.when(whole, F.greatest(n, m) > SHORT).otherwise((n != m) & (F.greatest(n, m) <= SHORT))
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.piece") == F.col("b.piece")) & once & (F.abs(n - m) <= 2) & own)
    edits = F.levenshtein(F.col("a.local"), F.col("b.local"), 2)
    removed = F.greatest(n, m) - F.length("a.piece")
    met = pairs.filter(edits.between(1, 2) & (whole | (removed == edits)))  # two words k edits apart also share a key with k characters less than the longer
    x, y = F.concat("a.local", "a.tail"), F.concat("b.local", "b.tail")
    found = found.unionByName(met.select(F.least(x, y).alias("first"), F.greatest(x, y).alias("second"), edits.alias("edits")).distinct())
    return found.withColumn("confidence", F.when(F.col("edits") == 1, BY_EDITS[1]).otherwise(BY_EDITS[2]))


#: The domain of private addresses, the ending of host names, and confidences of the noise rules.
PRIVATE, HOSTS = "users.noreply.github.com", ".local"
NOISE = {"host": 0.90, "login": 0.90, "part": 0.78, "typo": 0.88}


def edits_apart(a: str, b: str) -> int:
    """Levenshtein's distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def noise_aliases(authors: DataFrame, domain: str | None = None) -> DataFrame:
    """source, target, confidence and rule of authors' e-mails that look like another's: host names and misspelt domains of ``domain``, private addresses by their login.

    A login or local part inside another meets it on its first three characters; nothing is compared with all. Of several
    rules for a pair the most confident counts. A pair has several only where ``domain`` itself is a misspelt private one:
    else the sources of host names and misspelt domains are no private addresses, of which a login is equal to a local part,
    inside it or around it, and meets it once. So pairs need not be gathered.
    """
    mail = authors.select("email").filter("email is not null").distinct()
    split = mail.select("email", F.lower(F.regexp_extract("email", "^(.*)@([^@]*)$", 1)).alias("local"), F.lower(F.regexp_extract("email", "^(.*)@([^@]*)$", 2)).alias("domain")).filter("local <> '' and domain <> ''")
    out = []
    if domain:
        home = domain.strip().lstrip("@").lower()
        edits = F.levenshtein(F.col("domain"), F.lit(home), 2)
        rule = F.when(F.col("domain").endswith(HOSTS), "host").when((F.col("domain") != home) & edits.between(1, 2), "typo")
        stray = split.withColumn("rule", rule).filter("rule is not null").withColumn("target", F.concat("local", F.lit(f"@{home}")))
        there = mail.select(F.lower("email").alias("target")).distinct()
        out.append(stray.join(there, "target", "left_semi").select(F.col("email").alias("source"), "target", "rule"))
    private = split.filter((F.col("domain") == PRIVATE) & F.contains("local", F.lit("+"))).select(F.col("email").alias("source"), F.regexp_extract("local", r"^[^+]*\+(.*)$", 1).alias("login")).filter("login <> ''")
    others = split.select(F.col("email").alias("target"), "local")
    out.append(private.join(others, F.col("login") == F.col("local")).filter("source <> target").select("source", "target", F.lit("login").alias("rule")))

    def inside(inner: DataFrame, word: str, outer: DataFrame, text: str) -> DataFrame:
        """Pairs whose ``word`` stands inside ``text``, but isn't all of it: by the first three characters of the word among the runs of the text."""
        heads = inner.withColumn("head", F.substring(word, 1, 3))
        runs = F.expr(f"array_distinct(flatten(transform(sequence(1, 3), k -> transform(sequence(1, greatest(length({text}) - k + 1, 1)), i -> substring({text}, i, k)))))")
        return heads.join(outer.withColumn("head", F.explode(runs)), "head").filter((F.col(word) != F.col(text)) & F.contains(F.col(text), F.col(word)))

    for pairs in (inside(private, "login", others, "local"), inside(others, "local", private, "login")):
        out.append(pairs.filter("source <> target").select("source", "target", F.lit("part").alias("rule")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    confidence = F.lit(0.0)
    for rule, value in NOISE.items():
        confidence = F.when(F.col("rule") == rule, value).otherwise(confidence)
    found = found.withColumn("confidence", confidence).select("source", "target", "confidence", "rule")
    if not domain or not 1 <= edits_apart(home, PRIVATE) <= 2:
        return found
    best = found.groupBy("source", "target").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("rule"), F.max("confidence").alias("confidence"))
    return best.select("source", "target", "confidence", "rule")


# -- pairs of alike names --------------------------------------------------------------------------------------

#: Letters from rare to frequent, the order in which a name's letters become keys, and how many of them a key holds besides a common beginning of 0 to 4.
RARE, TOGETHER = "zqxjkvbpgwyfmculdhrsnioate", (2, 2, 1, 1, 1)
ORDER = {c: i for i, c in enumerate(RARE)}


def length_classes(most: int) -> list[tuple[int, int]]:
    """The least and greatest lengths of classes: single lengths at first, then about an eighth wide."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 9 // 8)
        out.append((low, high))
        low = high + 1
    return out


def name_keys(word: str, least: float, left: bool) -> list[int]:
    """Keys of which two words share one if their Jaro-Winkler likeness is ``least`` or more. ``alike`` needs none.

    A common beginning of p letters leaves a Jaro likeness j of at least (least - p/10) / (1 - p/10). So of lengths a and
    b at least o = (3j - 1) ab / (a + b) letters are common, and of the rarest a - o + k letters of the one and b - o + k
    of the other k are: keys are the beginning (its length in their last three bits), the classes of both lengths, whose least lengths make o, and k of these
    letters.
    """
    n, out = len(word), set()
    if not n:
        return [0]
    seen: dict[str, int] = {}
    letters = []
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        letters.append((ORDER.get(c, -1), c, seen[c]))
    letters = [f"{c}{i}" for _, c, i in sorted(letters)]
    for p in range(min(4, n) + 1):
        jaro = (least - p / 10) / (1 - p / 10)
        ratio = max(3 * jaro - 2, 0.05)  # of the lengths, the shorter by the longer; lower ones have classes up to 20 n all the same
        classes = length_classes(math.floor(n / ratio) + 1)
        own = next(c for c in classes if c[0] <= n <= c[1])
        for other in classes:
            if other[1] < max(p, ratio * n - 1e-9):
                continue
            common = max(math.ceil((3 * jaro - 1) * own[0] * other[0] / (own[0] + other[0]) - 1e-9), 1)
            if common > min(n, other[1]):
                continue
            k = min(TOGETHER[p], common)
            sizes = (own[0], other[0]) if left else (other[0], own[0])
            head = f"{p}|{word[:p]}|{sizes}|"
            for some in itertools.combinations(letters[: n - common + k], k):
                raw = (head + "".join(some)).encode()
                out.add((zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1]) & ~7 | p) - (1 << 63))
    return list(out)


#: Most words of a side that a task compares, and fewest; a task's memory and what moves hang on them.
BLOCK, LEAST_BLOCK = 1 << 14, 1 << 8


def in_blocks(left: DataFrame, right: DataFrame) -> GroupedData:
    """cell, side (0 or 1), word and owner of the distinct words (word) of two tables, dealt so that each pair of words meets in one cell; the smallest owner of a word counts.

    Words of each side are dealt to blocks by their hash, and a cell is a block of the one with a block of the other. So
    a word moves once for each block of the other side, and no pair moves.
    """
    sides = [left.filter("word is not null").select("word").distinct().withColumn("owner", F.lit(None).cast("string"))]
    sides.append(right.filter("word is not null").groupBy("word").agg(F.min("owner").alias("owner")) if "owner" in right.columns else right.filter("word is not null").select("word").distinct().withColumn("owner", F.lit(None).cast("string")))
    counts = [s.count() for s in sides]
    size = min(max(math.isqrt(counts[0] * counts[1] // (4 * left.sparkSession.sparkContext.defaultParallelism)), LEAST_BLOCK), BLOCK)
    n, m = (max(-(-c // size), 1) for c in counts)
    block = lambda k: F.pmod(F.xxhash64("word"), F.lit(k)).cast("long")
    a = sides[0].select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other"), block(n).alias("own"), F.lit(0).alias("side"), "word", "owner")
    b = sides[1].select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"), block(m).alias("own"), F.lit(1).alias("side"), "word", "owner")
    cells = a.select((F.col("own") * m + F.col("other")).alias("cell"), "side", "word", "owner").unionByName(b.select((F.col("other") * m + F.col("own")).alias("cell"), "side", "word", "owner"))
    return cells.repartition(min(n * m, 1 << 14), "cell").groupBy("cell")


def read_cell(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], list[str], list[str]]:
    """The words of both sides and the owners of the second."""
    left, right, owners = [], [], []
    for batch in batches:
        for side, word, owner in zip(*(batch.column(c).to_pylist() for c in ("side", "word", "owner"))):
            if side:
                right.append(word)
                owners.append(owner)
            else:
                left.append(word)
    return left, right, owners


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b and score of all pairs of distinct words (word) of two tables with a Jaro-Winkler likeness of ``least`` (above 0) or more.

    Blocks of words are compared in a task, by bounds as products of matrices first; pairs that aren't alike never leave it.
    """
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others, _ = read_cell(batches)
        for a, b, score in likeness.alike(words, others, least):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score)], names=["a", "b", "score"])

    return in_blocks(left, right.select("word")).applyInArrow(compared, "a string, b string, score double")


def nearest(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """word, owner and score of the words (word) of a table that have one alike by ``least`` (above 0) or more in another (word, owner): the greatest likeness, and of equal ones the smallest owner."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(zip(*likeness.nearest(*read_cell(batches), least)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["word", "owner", "score"])

    blocks = in_blocks(left, right).applyInArrow(compared, "word string, owner string, score double")
    return blocks.groupBy("word").agg(F.min_by("owner", F.struct(-F.col("score"), "owner")).alias("owner"), F.max("score").alias("score"))


def resolve(people: DataFrame, known: DataFrame, least: float = 0.85, least_normalized: float = 0.82) -> DataFrame:
    """email, name and the known author by e-mail, then by name, then by likeness.

    Likeness is the larger of the names' and the e-mails', ``least`` or more; else that of normalised names and local
    parts, each with each, ``least_normalized`` or more; equal scores go to the smallest author. Only the nearest of a word
    leaves its block, and only who has none by names and e-mails is compared by what is normalised.
    """
    by_mail = known.select(F.col("email"), F.col("author").alias("by_mail")).dropDuplicates(["email"])
    by_name = known.groupBy("name").agg(F.min("author").alias("by_name"))
    out = people.join(by_mail, "email", "left").join(by_name, "name", "left")
    mine = out.filter("by_mail is null and by_name is null").select("email", "name").distinct()

    def forms(rows: DataFrame, *kept: str) -> list[DataFrame]:
        """The rows with a form as word: names and e-mails in lower case, normalised names, normalised local parts."""
        made = (F.lower("name"), F.lower("email"), normalized(F.col("name")), normalized(local_part(F.col("email"))))
        return [rows.select(*kept, f.alias("word")) for f in made]

    theirs = forms(known.withColumn("owner", F.col("author").cast("string")), "owner")

    def by_likeness(rows: DataFrame, compared: list[tuple[int, int]], bound: float) -> DataFrame:
        """email, name and by_like of the rows that have one alike; written, as it is read twice."""
        own, found = forms(rows, "email", "name"), None
        for i, j in compared:
            more = own[i].join(nearest(own[i], theirs[j], bound), "word").select("email", "name", "owner", "score")
            found = more if found is None else found.unionByName(more)
        path = shared_folder(rows.sparkSession)
        found.groupBy("email", "name").agg(F.min_by("owner", F.struct(-F.col("score"), "owner")).alias("by_like")).write.parquet(path)
        return rows.sparkSession.read.schema("email string, name string, by_like string").parquet(path)

    same = lambda a, b: a["email"].eqNullSafe(b["email"]) & a["name"].eqNullSafe(b["name"])
    first = by_likeness(mine, [(0, 0), (1, 1)], least)
    rest = mine.join(first, same(mine, first), "left_anti")
    best = first if rest.isEmpty() else first.unionByName(by_likeness(rest, [(2, 2), (2, 3), (3, 2), (3, 3)], least_normalized))
    return out.join(best, same(out, best), "left").select(out["email"], out["name"], F.coalesce("by_mail", "by_name", "by_like", out["name"]).alias("author"))


def greedy_clusters(items: DataFrame, key: str, tokens: str, group: str, least: float = 0.7) -> DataFrame:
    """key and cluster (its seed's key): in key order each item joins the first seed of its group that is similar enough, else it is one."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, out = [], []
        for k, own in pdf.sort_values(key)[[key, tokens]].itertuples(index=False):
            own = list(own)
            found = None
            for seed, theirs in seeds:
                shared = sum(x in theirs for x in own)
                whole = len(own) + len(theirs) - shared
                if whole and shared / whole >= least:
                    found = seed
                    break
            if found is None:
                found = k
                seeds.append((k, own))
            out.append((k, found))
        return pd.DataFrame(out, columns=[key, "cluster"])

    kind = dict(items.dtypes)[key]
    return items.groupBy(group).applyInPandas(cluster, f"{key} {kind}, cluster {kind}")
