"""URL rules, conversation tries and vector codes against brute force, and their odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fileloom.llm import prefixtrie, urlrules, vectorcodes

ODD = "extra string, h int, code string, c long, depth long, tokens string, bad int, vector string, label_error long, row long"


def plain_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    conv = {c: [t[3:] for t in sorted(turns)] for c, turns in conv.items()}
    built = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(conv.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    for s in sorted(members, key=len, reverse=True):
        leaves[s] += not children[s]
        if s:
            saved[s] += (len(members[s]) - 1) * len(s[-1][1])
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    return {(min(m), len(s)): (min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(s)).encode()).hexdigest()) for s, m in members.items()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*(c for c in range(330) if c != 200), -7, -130, 100000, 100001, 100002]:
        rows += [(c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "a", "b", "", None, "é😀x"])) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]  # one hot conversation
    rows += [(2000, t, "u", str(t % 3)) for t in range(300)]  # one long conversation
    return [*rows, (None, 1, "u", "x"), (5, 1, "u", "x"), (5, 1, "u", "x"), (3001, 9, "u", "long " * 100_000)]


@pytest.mark.parametrize("limit", [200_000, 40, 0])
def test_trie_equals_brute_force(spark, talks, limit):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "t", 1, "v", 4, 5) for r in talks], f"conv_id long, turn long, role string, text string, {ODD}").repartition(3)
    found = prefixtrie.prefix_trie(df, shard_turns=limit).drop("hi", "lo").collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in found} == plain_trie(talks)
    assert len(found) == len(plain_trie(talks))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(df).count() == 0
    alone = prefixtrie.prefix_trie(spark.createDataFrame([(1, 0, "u", "x")], df.schema)).collect()  # h of 1 is 3: no turn is left
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.n_children) for r in alone] == [(1, 0, 1, 1, 0)]


def test_louds_bits_and_parents():
    # sequences ab, ac, d: the root has two children, a has two, in level order
    trie = prefixtrie.Louds(np.array([0, 1, 0, 1, 0]), np.array([1, 2, 1, 3, 4]))
    assert "".join(str(int(b)) for b in trie.bits) == "110" + "110" + "0" + "0" + "0"
    assert trie.parent.tolist() == [-1, 0, 0, 1, 1] and trie.labels.tolist() == [-1, 1, 4, 2, 3]
    assert trie.rolled(np.array([0, 0, 5, 1, 2])).tolist() == [8, 3, 5, 1, 2]


def plain_codes(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(256 * int_ratio(x)) for x in r[1]] for r in kept]
    first = {}
    for r, v in sorted(zip(kept, ints, strict=True), key=lambda z: (z[0][0] is None, z[0][0] or 0, z[0][1])):
        if r[0] is not None:
            first.setdefault(r[0], v)
    seeds = [first[k] for k in sorted(first)[:64]]
    width = len(seeds[0])
    part = lambda v, p: v[p * width // 16 : (p + 1) * width // 16]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(s, p) for s in seeds] for p in range(16)]
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    good = [v for v in ints if len(v) == width]
    for _ in range(2):
        codes = [[best(v, p) for p in range(16)] for v in good]
        new = []
        for p in range(16):
            groups = defaultdict(list)
            for v, c in zip(good, codes, strict=True):
                groups[c[p]].append(part(v, p))
            new.append([[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])])
        books = new
    out = []
    for r, v in zip(kept, ints, strict=True):
        if len(v) != width:
            out.append((r[0], r[2], None, None))
            continue
        c = [best(v, p) for p in range(16)]
        e = sum(far(part(v, p), books[p][c[p]]) for p in range(16))
        out.append((r[0], r[2], "".join(f"{x:02x}" for x in c), e if e < 1 << 63 else None))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def int_ratio(x):
    from fractions import Fraction

    return Fraction(*float(x).as_integer_ratio())


VECTORS = f"vec_id long, embedding array<float>, label int, {ODD}"
MORE = ("x", 1, "y", 2, 3, "t", 1, "v", 4, 5)


@pytest.mark.parametrize("width,huge", [(32, False), (64, True), (40, False)])
def test_codes_equal_brute_force(spark, width, huge):
    rng = random.Random(width)
    grid = lambda: [float(rng.randrange(-3, 4)) / rng.choice([1, 256]) for _ in range(width)]  # noqa: E731  many ties
    rows = [(i, grid(), rng.choice([1, 2, None])) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 420)] + [(5, rows[5][1], 2), (None, grid(), 2)]
    rows += [(500, None, 1), (501, [None] * width, 1), (502, [float("nan")] * width, 1), (503, [float("inf")] * width, None), (504, [1.0] * (width - 1), 3), (505, [], 3)]
    if huge:
        rows += [(i, [np.float32(rng.uniform(-1, 1) * 3e38).item() if rng.random() < 0.1 else 1.5 for _ in range(width)], 9) for i in range(20, 24)]
        rows += [(600 + i, [np.float32(rng.uniform(-1, 1) * 1e9).item() for _ in range(width)], 8) for i in range(5)]
    found = vectorcodes.compress(spark.createDataFrame([(*r, *MORE) for r in rows], VECTORS).repartition(4)).collect()
    want, digest = plain_codes(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in found} == {digest}
    total = defaultdict(int)
    for _, label, code, e in want:
        if code:
            total[label] = None if e is None or total[label] is None else total[label] + e
    assert {r.label: r.label_error for r in found if r.label != 3} == dict(total)


def test_codes_of_nothing(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1, *MORE)], VECTORS)).count() == 0
    assert [r.code for r in vectorcodes.compress(spark.createDataFrame([(None, [1.0], 1, *MORE)], VECTORS)).collect()] == [None]


def test_screening_keeps_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 20):
        x, c = rng.integers(-scale, scale, (500, 12)), rng.integers(-scale, scale, (64, 12))
        c[40] = c[3]
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        index, best = vectorcodes.nearest(x, c)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        lower, upper = vectorcodes.screened(x, c)
        exact = (c * c).sum(axis=1)[None] - 2 * (x @ c.T)
        assert (lower <= exact).all() and (exact <= upper).all()


def test_joined_labels_without_broadcast(spark, monkeypatch):
    rows = [(i, [float(i % 7)] * 16, i % 3 or None, *MORE) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS)
    want = sorted(tuple(r) for r in vectorcodes.compress(df).drop("label").collect())
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    assert sorted(tuple(r) for r in vectorcodes.compress(df).drop("label").collect()) == want


PAGES = f"page_id long, url string, html string, {ODD}"
LISTED = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain_rules(known, wanted, confidence):
    """All frequent token sets by levels, and those of enough confidence that no more general one beats."""
    baskets = [(frozenset(t), b) for t, b in known]
    count = lambda s: sum(s <= t for t, _ in baskets)
    level = {frozenset([t]) for t in {x for s, _ in baskets for x in s}}
    level, frequent = {s for s in level if count(s) >= wanted}, set()
    while level:
        frequent |= level
        level = {a | b for a, b in itertools.combinations(level, 2) if len(a | b) == len(a) + 1}
        level = {s for s in level if count(s) >= wanted}
    rules = {}
    for s in frequent:
        bad = sum(s <= t and b for t, b in baskets)
        if bad >= wanted and bad / count(s) >= confidence:  # the set with its class must be frequent too
            rules[s] = (bad, count(s))
    return {tuple(sorted(s)): v for s, v in rules.items() if not any(g < s and rules[g][0] / rules[g][1] >= v[0] / v[1] for g in rules)}


@pytest.fixture(scope="module")
def web():
    rng = random.Random(2)
    pages, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        host = rng.choice(["cheap-pills", "casino"]) if spam else rng.choice(["news", "blog", "wiki"])
        url = f"{rng.choice(['http', 'HTTPS'])}://{host}.Example{i % 3}.org/{rng.choice(['en', 'de'])}/{i}{'?buy=now' if spam and i % 8 == 0 else ''}"
        pages.append((i, url, None))
        if i % 3:
            labels.append((i, int(not spam) if rng.random() < 0.9 else None, int(spam)))
    return pages, [*labels, (None, 1, 0), (1, None, None), (7, 1, 0), (7, 1, 0)]


def test_mined_rules_equal_brute_force(spark, web):
    pages = spark.createDataFrame([(*p, *MORE) for p in web[0]], PAGES)
    known = urlrules.labelled(pages, spark.createDataFrame(web[1], "doc_id long, quality int, toxic int"))
    rules = urlrules.mined(known, support=0.05, least=5, confidence=0.6, most_tokens=50)
    rows = [(r.tokens, r.bad) for r in known.collect()]
    wanted = max(5, math.ceil(0.05 * len(rows)))
    assert {r.tokens: (r.bad, r.support) for r in rules} == plain_rules(rows, wanted, 0.6)
    assert rules and [r.confidence for r in rules] == sorted((r.confidence for r in rules), reverse=True)


def test_judged_urls(spark, web):
    odd = [(900, None, "x"), (901, "", "x"), (902, "no scheme", "x"), (903, "http://Sub.EXAMPLE.net/en/x?y#z", "x"), (904, "http://example.net/enx", "x"), (905, "http://net/", "x"), (906, "http://a.net", "x"), (None, "ftp://b.org/fr/1", "x"), (907, "http://example.com/de/#://x.net/", "x"), (908, "http://x.org/" + "a/" * 50_000, "x"), (909, "http://h\n.net/\n/en/", "x"), (0, web[0][0][1], "x"), (910, "http://cheap-pills.other.io/?", "x")]
    rows = [*web[0], *odd]
    pages = spark.createDataFrame([(*p, *MORE) for p in rows], PAGES).repartition(3)
    labels = spark.createDataFrame(web[1], "doc_id long, quality int, toxic int")
    found = urlrules.judge(pages, labels, LISTED, support=0.02, least=5, confidence=0.8)
    got = defaultdict(list)
    for r in found.collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    one = {k: (v[0].host, v[0].path, v[0].rule, v[0].verdict) for k, v in got.items()}
    assert one[900] == one[901] == one[902] == ("", "", None, "allow")
    assert one[903] == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert one[904] == ("example.net", "/enx", "net/", "block") and one[905] == ("net", "/", "net/", "block")
    assert one[906] == ("a.net", "", None, "allow") and one[None] == ("b.org", "/fr/1", "org/fr/", "allow")
    assert one[907] == ("example.com", "/de/", "example.com/de/", "block") and len(one[908][1]) == 100_001
    assert one[909] == ("h\n.net", "/\n/en/", "net/", "block")
    assert one[910][3] == "block" and got[910][0].learned  # by what its host shares with labelled ones
    learned = [got[i][0].verdict == "block" for i in range(400)]
    assert all(learned[0::4]) and not any(v for i, v in enumerate(learned) if i % 4)
    # the index finds what a scan of all rules finds
    rules = urlrules.mined(urlrules.labelled(pages, labels), support=0.02, least=5, confidence=0.8)
    sets = {r.page_id: set(r.tokens) for r in pages.select("page_id", urlrules.url_tokens(pages.url).alias("tokens")).collect()}
    for i, s in sets.items():
        fits = [" ".join(r.tokens) for r in rules if set(r.tokens) <= s]
        assert got[i][0].learned == (fits[0] if fits else None)


def test_all_tokens_and_all_rules_of_urls_count(spark):
    """Bad pages are told by a word that is rarer than ten others of their pages; rules that don't go
    to all tasks block what those of the tasks would block."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        often = "".join(f"{w}/" for w in "a b c d e f g h i j k l".split() if rng.random() < 0.95)
        rows.append((i, f"http://x.org/{often}{'pills/' if bad else ''}{rng.randrange(9**9)}", bad))
    pages = spark.createDataFrame([(i, u, None, *MORE) for i, u, _ in rows], PAGES)
    labels = spark.createDataFrame([(i, int(not bad), int(bad)) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    got = urlrules.judge(pages, labels, [])
    assert {r.page_id for r in got.collect() if r.verdict == "block"} == {i for i, _, bad in rows if bad}


def test_rules_beyond_those_in_tasks_are_joined(spark, web):
    pages = spark.createDataFrame([(*p, *MORE) for p in web[0]], PAGES).repartition(3)
    labels = spark.createDataFrame(web[1], "doc_id long, quality int, toxic int")
    fit = {"support": 0.02, "least": 5, "confidence": 0.3}
    plain = sorted((tuple(r) for r in urlrules.judge(pages, labels, LISTED, **fit).collect()), key=repr)
    assert sum(r[5] is not None for r in plain) > 100
    for most in (1, 3):
        assert sorted((tuple(r) for r in urlrules.judge(pages, labels, LISTED, most_rules=most, **fit).collect()), key=repr) == plain


def test_urls_of_nothing(spark, web):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urlrules.judge(spark.createDataFrame([], PAGES), labels, LISTED).count() == 0
    pages = spark.createDataFrame([(*p, *MORE) for p in web[0]], PAGES)
    assert {r.verdict for r in urlrules.judge(pages, labels, []).collect()} == {"allow"}
