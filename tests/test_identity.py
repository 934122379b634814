"""Pairs of alike names by keys against all pairs, and aliases of noisy e-mails."""

import random

import pytest
from pyspark.sql import functions as F

from devquarry.operators import identity


def names(rng, n):
    first, last = "bob robert katherine catherine jürgen li anna maria mo x".split() + [""], "matsuoka jones johnson smith-jones o'neil wu zhang müller".split()
    out = set()
    while len(out) < n:
        w = f"{rng.choice(first)}{rng.choice([' ', '.', '', '_'])}{rng.choice(last)}{rng.choice(['', '', str(rng.randrange(99))])}"
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abcxyz") + w[i:], w[:i] + w[i + 1 :], w[::-1] if rng.random() < 0.1 else w])
        out.add(w)
    return sorted(out)


@pytest.mark.parametrize("least", [0.82, 0.85, 0.93])
def test_no_pair_is_lost(least):
    rng = random.Random(int(least * 100))
    a, b = names(rng, 300), names(rng, 300)
    own = {w: set(identity.name_keys(w, least, True)) for w in a}
    theirs = {w: set(identity.name_keys(w, least, False)) for w in b}
    met, wanted = 0, 0
    assert sum(map(len, own.values())) < 700 * len(own)
    for x in a:
        for y in b:
            hit = not own[x].isdisjoint(theirs[y])
            met += hit
            if identity.winkler(x, y) >= least:
                wanted += 1
                assert hit, (x, y)
    print(least, wanted, met / len(a) / len(b), sum(map(len, own.values())) / len(own))
    assert wanted > 60 and met < len(a) * len(b) / 3


def test_alike(spark):
    rng = random.Random(2)
    a, b = names(rng, 200), names(rng, 1000)
    frame = lambda words: spark.createDataFrame([(w,) for w in [*words, *words[:9], None]], "word string")
    found = identity.alike(frame(a), frame(b), 0.9)
    assert {(r.a, r.b) for r in found.collect()} == {(x, y) for x in a for y in b if identity.winkler(x, y) >= 0.9}
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_resolved(spark):
    known = spark.createDataFrame([("bob.matsuoka@co.com", "Bob Matsuoka", "Bob Matsuoka"), ("cj@co.com", "Catherine Jones", "Catherine Jones")], "email string, name string, author string")
    people = [("x@y.z", "Katherine Jones"), ("bob.matsuoka@home.net", "Bob M"), ("cj@co.com", "C"), ("q@q.q", "Bob Matsuoka"), ("nobody@none.org", "Wu"), (None, "Wu"), ("z@z", None)]
    found = identity.resolve(spark.createDataFrame(people, "email string, name string"), known)
    assert {(r.email, r.author) for r in found.collect()} == {("x@y.z", "Catherine Jones"), ("bob.matsuoka@home.net", "Bob Matsuoka"), ("cj@co.com", "Catherine Jones"), ("q@q.q", "Bob Matsuoka"), ("nobody@none.org", "Wu"), (None, "Wu"), ("z@z", None)}
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_noise(spark):
    mails = ["bob@ENCD.local", "bob@co.com", "BOB@CO.com", "eve@c0.com", "eve@co.com", "1+bob@users.noreply.github.com", "2+bobby@users.noreply.github.com", "3+zed@users.noreply.github.com", "bob@b", None, "none"]
    found = identity.noise_aliases(spark.createDataFrame([(m,) for m in mails], "email string"), "@co.com")
    rows = {(r.source, r.target): (r.confidence, r.rule) for r in found.collect()}
    assert rows[("bob@ENCD.local", "bob@co.com")] == (0.9, "host") and rows[("eve@c0.com", "eve@co.com")] == (0.88, "typo")
    assert rows[("1+bob@users.noreply.github.com", "bob@b")] == (0.9, "login") and rows[("2+bobby@users.noreply.github.com", "bob@b")] == (0.78, "part")
    assert rows[("1+bob@users.noreply.github.com", "2+bobby@users.noreply.github.com")] == (0.78, "part") and not any("zed" in s for s, _ in rows)
    assert all(s.endswith("github.com") for s, _ in {(r.source, 0) for r in identity.noise_aliases(spark.createDataFrame([(m,) for m in mails], "email string")).collect()})


def test_near_emails_against_all_pairs(spark):
    rng = random.Random(5)
    locals_ = [w.replace("@", "") or "x" for w in names(rng, 60)] + ["averyveryverylonglocalpart" + s for s in ("", "s", "st", "x1")] + ["ab", "ac"]
    mails = sorted({f"{w}@{rng.choice(['co.com', 'x.co.com', 'other.org'])}" for w in locals_ for _ in range(2)})
    lev = lambda a, b: spark_levenshtein(a, b)
    wanted = set()
    for i, x in enumerate(mails):
        for y in mails[i + 1 :]:
            (la, da), (lb, db) = x.split("@"), y.split("@")
            if min(len(la.encode()), len(lb.encode())) >= 3 and 1 <= lev(la, lb) <= 2 and (da.endswith(db) or db.endswith(da)):
                wanted.add((x, y))
    found = identity.near_emails(spark.createDataFrame([(m,) for m in mails], "email string"))
    assert {(r.first, r.second) for r in found.collect()} == wanted and len(wanted) > 20
    assert {(r.edits, r.confidence) for r in found.select("edits", "confidence").distinct().collect()} == {(1, 0.85), (2, 0.78)}
    assert F is not None


def spark_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_noise_aliases_are_not_gathered(spark):
    private = "@users.noreply.github.com"
    mails = ["ann@co.com", "ann@c0.com", "ann@pc.local", "ANN@co.com", f"1+ann{private}", f"2+anna{private}", f"ann{private}", "nn@co.com", "anna@users.noreply.github.co", f"an+an{private}", "an@co.com", None, "@co.com"]
    df = spark.createDataFrame([(m,) for m in mails + mails], "email string")
    for domain in ("co.com", None, "users.noreply.github.co"):
        out = identity.noise_aliases(df, domain)
        assert ("max_by" in out._jdf.queryExecution().optimizedPlan().toString()) == (domain == "users.noreply.github.co")
        rows = out.collect()
        assert rows and len({(r.source, r.target) for r in rows}) == len(rows)
        if domain == "users.noreply.github.co":  # a pair by two rules has the more confident one
            assert {r.rule for r in rows if (r.source, r.target) == (f"2+anna{private}", "anna@users.noreply.github.co")} == {"login"}
    assert [identity.edits_apart(*p) for p in (("", "ab"), ("co.com", "c0.com"), ("abc", "abc"), ("abc", "xbcd"))] == [2, 1, 0, 2]


def test_near_emails_of_one_length_meet_once_without_being_told_apart(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("ab") for _ in range(n)) for n in (3, 4, 5, 6) for _ in range(40)} | {"".join(rng.choice("abc\0é") for _ in range(7)) for _ in range(60)}
    words |= {f"dev{rng.randrange(300):06d}" for _ in range(80)} | {"averylonglocalpartoftwe" + w for w in ("", "n", "nt", "m", "mt", "nty", "ntz", "tny", "ntyx")}
    mails = sorted({f"{w}@{rng.choice(['co.com', 'x.co.com', 'org', 'org@co.com'])}" for w in sorted(words) for _ in range(2)} | {"none", "abc@", "@org", "abd@"})
    wanted = {}
    for i, x in enumerate(mails):
        for y in mails[i + 1 :]:
            (la, da), (lb, db) = (m.split("@")[:2] if "@" in m else (m, "") for m in (x, y))
            if da and db and min(len(la.encode()), len(lb.encode())) >= 3 and 1 <= (k := spark_levenshtein(la, lb)) <= 2 and (da.endswith(db) or db.endswith(da)):
                wanted[x, y] = k
    rows = identity.near_emails(spark.createDataFrame([(m,) for m in mails + mails[:9]], "email string")).collect()
    assert len(rows) == len(wanted) > 1000 and {(r.first, r.second): r.edits for r in rows} == wanted
    same = spark.createDataFrame([("co.com", 0, f"dev{i:06d}", "@co.com") for i in range(0, 4000, 3)], "at string, visits int, local string, tail string")
    out = identity.met_once(same)
    rows = out.collect()
    assert len(set(rows)) == len(rows) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # none above the join
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
