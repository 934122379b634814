"""Jaro-Winkler likeness over blocks of words, against each pair measured by itself."""

import random

import pytest

from devquarry.operators import identity, likeness


def words(rng, n):
    first, last = "bob robert katherine jürgen li maria x".split() + [""], "matsuoka jones smith-jones o'neil wu zhang müller".split()
    out = {"", "a", "ab", "\0b", "b\0", "\0", "a" * 64, "a" * 63 + "b", "a" * 65, "b" * 70 + "c", "\U0001d4ea\U0001d4eb", "\U0001d4ea"}
    while len(out) < n:
        w = f"{rng.choice(first)}{rng.choice([' ', '.', '', '_'])}{rng.choice(last)}{rng.choice(['', str(rng.randrange(99))])}"
        i = rng.randrange(len(w) + 1)
        out.add(rng.choice([w, w[:i] + rng.choice("abcxyz") + w[i:], w[:i] + w[i + 1 :], w[::-1], "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))]))
    return sorted(out)


@pytest.mark.parametrize("least", [0.3, 0.82, 0.93])
def test_blocks_give_what_each_pair_gives(least, monkeypatch):
    monkeypatch.setattr(likeness, "AT_ONCE", 1000)
    monkeypatch.setattr(likeness, "ENTRIES", 1500)
    rng = random.Random(int(least * 100))
    a, b = words(rng, 130), words(rng, 170)
    wanted = {(x, y): s for x in a for y in b if (s := likeness.winkler(x, y)) >= least}
    found = [(x, y, s) for p, q, scores in likeness.alike(a, b, least) for x, y, s in zip(p, q, scores.tolist())]
    assert len(found) == len(wanted) > 50 and {(x, y): s for x, y, s in found} == wanted
    owners = [f"o{rng.randrange(20)}" for _ in b]
    best = {}
    for x in a:
        if mine := [(-wanted[x, y], o) for y, o in zip(b, owners) if (x, y) in wanted]:
            best[x] = (min(mine)[1], -min(mine)[0])
    assert {x: (o, s) for x, o, s in likeness.nearest(a, b, owners, least)} == best


def test_words_that_cannot_be_nearer_are_not_measured(monkeypatch):
    known = [f"supplier#{i:09d}" for i in range(6000)]
    people = [f"supplier#{i:08d}o" for i in range(0, 600, 7)]
    asked, plain = [], likeness.Pairs.measured
    monkeypatch.setattr(likeness.Pairs, "measured", lambda self, i, j, least: asked.append(len(i)) or plain(self, i, j, least))
    found = {w: o for w, o, _ in likeness.nearest(people, known, known, 0.85)}
    assert found[people[3]] == min(known, key=lambda k: (-likeness.winkler(people[3], k), k)) and len(found) == len(people)
    assert sum(asked) < len(known) * len(people) / 20


def test_only_the_nearest_of_a_word_leaves_its_block(spark, monkeypatch):
    monkeypatch.setattr(identity, "LEAST_BLOCK", 40)
    names = [f"Supplier#{i:04d}" for i in range(0, 900, 3)]
    known = [(n.lower(), n, n[:-1]) for n in names] + [("zoe.weiss@co.com", "Zoë Weiß", "Zoë")]
    people = [(f"x{n}", n[:-1] + "O") for n in names[::9]] + [("q@q.q", "Zoe_Weiss"), (None, None), ("zoe-weiss@other.org", None), ("z" * 80, "z" * 80)]
    found = identity.resolve(spark.createDataFrame(people + people[:3], "email string, name string"), spark.createDataFrame(known, "email string, name string, author string"))
    like = lambda a, b: likeness.winkler(a, b) if a is not None and b is not None else 0.0

    def plain(email, name):
        low = lambda w: w and w.lower()
        norm = lambda w: w and " ".join("".join(" " if c in "._-" else c for c in w.lower()).split())
        local = lambda w: w and w.split("@")[0]
        first = [(-max(like(low(name), k[1].lower()), like(low(email), k[0].lower())), k[2]) for k in known]
        second = [(-max(like(x, y) for x in (norm(name), norm(local(email))) for y in (norm(k[1]), norm(local(k[0])))), k[2]) for k in known]
        return min(first)[1] if -min(first)[0] >= 0.85 else min(second)[1] if -min(second)[0] >= 0.82 else name

    rows = sorted(map(str, map(tuple, found.collect())))
    assert rows == sorted(str((e, n, plain(e, n))) for e, n in people + people[:3]) and any("'q@q.q', 'Zoe_Weiss', 'Zoë'" in r for r in rows)
    text = found._jdf.queryExecution().toString()
    assert "MapInPandas" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_no_pair_moves(spark, monkeypatch):
    monkeypatch.setattr(identity, "LEAST_BLOCK", 30)
    rng = random.Random(9)
    a, b = words(rng, 100), words(rng, 160)
    frame = lambda own: spark.createDataFrame([(w,) for w in [*own, *own[:9], None]], "word string")
    out = identity.alike(frame(a), frame(b), 0.85)
    assert sorted(map(tuple, out.collect())) == sorted((x, y, s) for x in a for y in b if (s := likeness.winkler(x, y)) >= 0.85)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Exchange")
    assert identity.alike(frame([]), frame(b), 0.85).collect() == []
