"""The language model with a restaurant for every word."""

import glob
import math
import os
import random
import zlib
from collections import Counter

import numpy as np

from fileloom.llm import lm, lmwords
from fileloom.llm.queries import QUERIES

from .conftest import frame
from .test_operators import WORD, gibbs_brute, lower

HELD = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1]
LEARNT = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 != 1]


def test_words_beyond_the_most_frequent_have_contexts_of_their_own(spark, tmp_path):
    """600 words are more frequent than "left" and "right", each of which has a follower of its own;
    "none" is in no training text."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(600)]
    texts = [" ".join(rng.sample(common, 600)) for _ in range(30)] + ["left up", "right down"] * 12
    rows = [(i, t, None, None) for i, t in zip(LEARNT, texts)]
    asked = ["left up", "left down", "right down", "right up", "none up", "none down"]
    made = frame(spark, rows + [(i, t, None, None) for i, t in zip(HELD, asked)])
    made.coalesce(1).write.parquet(f"{tmp_path}/made")
    os.rename(glob.glob(f"{tmp_path}/made/*.parquet")[0], f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op7_language_model"](spark, str(tmp_path)).collect()}
    left_up, left_down, right_down, right_up, none_up, none_down = (got[i] for i in HELD[:6])
    assert left_up > left_down + 0.5 and right_down > right_up + 0.5
    assert abs(none_up - none_down) < 0.05


def test_every_context_agrees_with_single_customers(spark):
    rng = random.Random(45)
    vocabulary = [f"w{k}" for k in range(30)]

    def text():
        t = [rng.choice(vocabulary[:8])]
        while len(t) < 14:
            t.append(vocabulary[(vocabulary.index(t[-1]) * 3 + rng.choice([0, 0, 0, 1, 5])) % 30] if rng.random() < 0.8 else rng.choice(vocabulary))
        return t

    out, learnt = HELD[:12], LEARNT[:40]
    texts = {i: text() for i in out + learnt}
    want = gibbs_brute([[*texts[i], "end"] for i in learnt], [[*texts[i], "end"] for i in out], set(vocabulary))
    docs = frame(spark, [(i, " ".join(t), None, None) for i, t in texts.items()])
    got = {r.doc_id: r.score for r in lm.score_texts(docs, burn_in=20, every=True).collect()}
    for i, x in zip(out, want):
        assert abs(got[i] - x) < 0.04 * abs(x)


def test_base_and_odd_rows_with_every_context(spark, docs, texts, empty):
    def tokens(t):
        return [*WORD.findall(lower(t or "")), None]

    out = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, *_) in enumerate(texts)}
    c = Counter(w for k, (_, t, *_) in enumerate(texts) if not out[k] for w in tokens(t))
    total, v = sum(c.values()), len(c)
    want = []
    for k, (i, t, *_) in enumerate(texts):
        w = tokens(t)
        want.append((i, out[k], len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w), 6)))
    got = lm.score_texts(docs, every=True).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(empty, every=True).count() == 0
    alone = lm.score_texts(frame(spark, [(HELD[0], "never learnt", None, None), (HELD[1], None, None, None)]), every=True).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in alone) == [(1, 0, 0), (3, 0, 0)] and all(r.score < 0 for r in alone)


def test_each_context_is_normalised(spark):
    """All pairs stand in held-out texts, so that a block asks for each word after each context."""
    rng = random.Random(46)
    some = [f"w{k}" for k in range(25)]
    learnt = [(i, " ".join(rng.choices(some, weights=range(1, 26), k=30)), None, None) for i in LEARNT[:60]]
    asked = [(i, f"{a} {b}", None, None) for i, (a, b) in zip(HELD, [(a, b) for a in some for b in [*some, "unseen"]])]
    tokenised = lm.stored(lm.blocks(frame(spark, learnt + asked).coalesce(1)), "blocks")
    said, sums = lmwords.modelled(tokenised, 4, 3, lm.SWEEPS)
    (block,) = tokenised.collect()
    known, _, at, _, number = lm.opened(block.vocabulary, block.texts)
    every = lmwords.pairs(known, at, number)
    pair = np.unique(every)
    logp, total = lmwords.probabilities([r.said for r in said.orderBy("piece").collect()], lm.SWEEPS, pair)
    p = dict(zip(pair.tolist(), 10**logp))
    end, unseen = np.searchsorted(known, lm.END), int(np.flatnonzero(total == 0)[0])
    assert len(total) == 27 and sums["words"] == 26
    for c in range(27):
        if c not in (end, unseen):
            assert abs(sum(p[w * 27 + c] for w in range(27)) - 1) < 1e-5


def test_halls_and_pieces_of_any_number(spark, monkeypatch):
    """What a text scores doesn't depend on the number of halls, and messages go by halls, not by pieces."""
    rng = random.Random(47)
    docs = frame(spark, [(i, " ".join(rng.choices([f"w{k}" for k in range(80)], k=40)), None, None) for i in [*LEARNT[:40], *HELD[:10]]]).cache()
    tokenised = lm.stored(lm.blocks(docs), "blocks")
    found = []
    for tokens in (1 << 24, 700, 1):
        monkeypatch.setattr(lmwords, "HALL_TOKENS", tokens)
        halls = min(9, max(1, 50 * 41 // tokens))
        pieces = lmwords.Kept(lmwords.merged(lmwords.sent(tokenised, 9), 9, halls), "pieces")
        assert 9 <= pieces.rows("sent").count() <= 9 * halls
        said, _ = lmwords.modelled(tokenised, 9, 2, 2)
        found.append(sorted((r.block, r.piece, r.said) for r in said.collect()))
    assert found[0] == found[1] == found[2]
