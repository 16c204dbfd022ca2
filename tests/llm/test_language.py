import random
from collections import Counter

from tests.llm.conftest import NASTY
from wattline.llm import language as op

SAMPLE = {"en": "the cat and the dog went to the old house by the river and sat there",
          "de": "der hund und die katze gingen zum alten haus an dem fluss und sassen dort",
          "xx": "παρα πολυ ωραια μερα σημερα και αυριο παλι"}


def brute_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for w in low.split():
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i:i + n]
                if g.strip():
                    out[g] += 1
    return out


def rank(counts, top):
    key = lambda g: sum(ord(c) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:top])}


def test_profiles_and_distances_equal_brute_force(docs_of):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        lang = rng.choice(list(SAMPLE))
        words = SAMPLE[lang].split()
        rows.append((i, " ".join(rng.choice(words).title() for _ in range(rng.randint(1, 40))) + "!", lang))
    profiles = op.train(docs_of(rows), top=40)
    want = {}
    for lang in SAMPLE:
        total = Counter()
        for _, t, x in rows:
            if x == lang:
                total += brute_grams(t)
        want[lang] = rank(total, 40)
        assert len(profiles[lang]) == len(want[lang])
    judge = op.Classifier(profiles, 40)
    names, scores = judge.predict([t for _, t, _ in rows])
    for (_, t, lang), name, score in zip(rows, names, scores):
        mine = rank(brute_grams(t), 40)
        dist = {x: sum(min(abs(p[g] - r), 40) if g in p else 40 for g, r in mine.items()) for x, p in want.items()}
        assert name == min(sorted(dist), key=dist.get)
        assert abs(score - (1 - dist[name] / (len(mine) * 40))) < 1e-12
        assert name == lang


def test_nasty_rows(docs_of, spark):
    train = docs_of([(i, t, x) for i, (x, t) in enumerate(SAMPLE.items())] + [(50, None, "en"), (51, "text", None)])
    profiles = op.train(train)
    assert sorted(profiles) == sorted(SAMPLE)
    out = op.predict(docs_of(NASTY), profiles, carry=["doc_id", "n_chars"]).collect()
    assert len(out) == len(NASTY)
    for r in out:
        assert 0 <= r.score <= 1
    und = {r.row.doc_id for r in out if r.lang_pred == "und"}
    assert {1, 2, 3, None} <= und | {None} and 4 not in und and 8 not in und
    assert op.predict(docs_of([]), profiles).count() == 0
    none = op.train(docs_of([]))
    assert none == {} and {r.lang_pred for r in op.predict(docs_of(NASTY), none).collect()} == {"und"}
