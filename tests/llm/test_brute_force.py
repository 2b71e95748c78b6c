"""Operators against brute force on made-up tables, and what long and hard inputs cost."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import language, licenses, mixing, near_dups, quality, secrets, topk


def test_license_scan_brute_force(spark):
    """Every template at every start, laid by plain comparison, against the index; other words and cut templates between."""
    rng = random.Random(8)
    made = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice(licenses.BASE + licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                for _ in range(rng.randrange(1, 4)):
                    own[rng.randrange(len(own))] = "zzz"
            words += own + [rng.choice(["alpha", "license", "the", "software"]) for _ in range(rng.randrange(4))]
        made.append((i, " ".join(words).title()))
    got = {r.doc_id: r.labels for r in licenses.licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = {}
    for i, text in made:
        w, found = text.lower().split(), set()
        for label, phrase in licenses.BASE:
            p = phrase.split()
            found |= {label} if any(w[s : s + len(p)] == p for s in range(len(w))) else set()
        for label, template, keys in licenses.TEMPLATES:
            t = template.split()
            for s in range(-1, len(w) + 1):
                at = lambda j, d, s=s: w[s + j + d] if 0 <= s + j + d < len(w) else None
                good = sum(any(at(j, d) == t[j] for d in (-1, 0, 1)) for j in range(len(t)))
                whole = True
                for key in keys.split("|"):
                    k = key.split()
                    a = next(a for a in range(len(t)) if t[a : a + len(k)] == k)
                    whole &= any(all(at(j, d) == t[j] for j in range(a, a + len(k))) for d in (-1, 0, 1))
                if whole and good >= licenses.COVER * len(t):
                    found.add(label)
        want[i] = ",".join(sorted(found))
    assert got == want


def test_secret_scan_finds_what_only_the_models_can(spark):
    rng = random.Random(2)
    letters = secrets.ALPHABET[:62]
    planted = [("".join(rng.choice(letters) for _ in range(rng.randrange(16, 44))), i) for i in range(200)]
    made = [(i, f"plain prose about configuration_manager_factory and {v} then internationalisation") for v, i in planted]
    made += [(1000 + i, f"{rng.choice(['getUserAccountName', 'read_table_column_index', 'RESPONSE_HEADER_BODY'])} misunderstanding {i}") for i in range(200)]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    caught = sum(any(abs(int(x.split(":")[1]) - made[i][1].index(v)) < 4 for x in got[i].split(",") if x) for v, i in planted)
    assert caught >= 180 and not any(got[1000 + i] for i in range(200))


def test_secret_scan_of_many_matches(spark):
    many = "x " + " ".join(f"{i:016x}" for i in range(20000))
    began = time.time()
    (row,) = secrets.secret_digest(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect()
    assert row.n_hex == 20000 and time.time() - began < 30
    spans = ",".join(f"hex:{2 + 17 * i}:{18 + 17 * i}" for i in range(20000))
    assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_mixing_targets_by_brute_force(spark):
    rng = random.Random(6)
    made = [(i, f"s{rng.randrange(7)}" if rng.random() < 0.9 else None, rng.randrange(1, 400) if rng.random() < 0.9 else 0) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, source string, n long")
    got = mixing.mixed(docs, F.col("n")).collect()
    names = sorted({s for _, s, _ in made if s is not None}) + [None]
    size = {s: sum(n for _, x, n in made if x == s) for s in names}
    weight, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}
    open_, left = list(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= 2 * size[s]
            open_.remove(s)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in names)


def test_language_long_words_and_expected_counts():
    pieces = language.Pieces.of(["a", "b", "ab", "ba", "▁", "▁a"])
    chance = np.array([[0.2, 0.3], [0.2, 0.1], [0.15, 0.2], [0.15, 0.1], [0.2, 0.2], [0.1, 0.1], [0.0, 0.0]])
    long = "".join(random.Random(3).choice("abc") for _ in range(5000))
    x, _ = language.points([long])
    plain = np.zeros(2)
    for lang in range(2):
        alpha = [0.0]
        p = {"a": 0, "b": 1, "ab": 2, "ba": 3, "▁": 4, "▁a": 5}
        w = "▁" + long
        for e in range(1, len(w) + 1):
            terms = [alpha[e - k] + np.log(chance[p[w[e - k : e]], lang]) for k in (1, 2) if k <= e and w[e - k : e] in p]
            if w[e - 1 : e] not in p:
                terms.append(alpha[e - 1] + np.log(language.UNKNOWN))
            alpha.append(np.logaddexp.reduce(terms))
        plain[lang] = alpha[-1]
    assert language.long_forward(x[0], pieces, chance) == pytest.approx(plain)
    assert language.forward([long, "ab"], pieces, chance)[0] == pytest.approx(plain)
    # Expected counts by listing every segmentation.
    word, want = "▁abab", np.zeros((6, 2))
    p = ["a", "b", "ab", "ba", "▁", "▁a"]
    for cut in range(1 << (len(word) - 1)):
        ends = [i + 1 for i in range(len(word) - 1) if cut >> i & 1] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if all(x in p for x in parts):
            for lang in range(2):
                for x in parts:
                    want[p.index(x), lang] += np.prod([chance[p.index(y), lang] for y in parts])
    want = want / np.exp(language.forward(["abab"], pieces, chance)[0])
    assert language.expected(["abab"], np.array([[1.0, 1.0]]), pieces, chance) == pytest.approx(want)


def test_quality_by_brute_force(spark):
    rng = random.Random(12)
    made = [(i, " ".join(rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(rng.randrange(1, 40))), rng.choice(["x", "y"])) for i in range(120)]
    made += [(500, "a bb zzz a a", None), (501, None, "x"), (502, "", None), (503, "a a", "none")]
    labels = [(i, 1, 0) for i in range(60)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(table, label_rows).collect()}
    few = {r.doc_id: r for r in quality.quality(table, label_rows, shard_rows=5).collect()}
    assert all(few[i].perplexity == pytest.approx(got[i].perplexity) and few[i].rejected == got[i].rejected for i in got if got[i].perplexity is not None)
    held = {r.doc_id for r in table.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    models = {}
    for lang in ("x", "y"):
        c = Counter()
        for i, t, g in made[:60]:
            if g == lang and i not in held:
                w = ["<s>", *t.split()]
                c.update(zip(w, w[1:]))
        after, total = Counter(w for _, w in c), Counter()

        def taken(counts):
            n = [sum(v == k for v in counts.values()) or None for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
            raw = [1 - 2 * y * n[1] / n[0] if y and n[0] and n[1] else None, 2 - 3 * y * n[2] / n[1] if y and n[1] and n[2] else None, 3 - 4 * y * n[3] / n[2] if y and n[2] and n[3] else None]
            d = [min(max(a if a is not None else b, 0.05), t) for a, b, t in zip(raw, (0.5, 1.0, 1.5), (0.95, 1.95, 2.95))]
            return lambda v: d[min(v, 3) - 1]

        d1, d2 = taken(after), taken(c)
        types, all_ = len(after), sum(after.values())
        unseen = sum(d1(v) for v in after.values()) / all_ / (types + 1)
        low = lambda w, after=after, d1=d1, all_=all_, unseen=unseen: (max(after[w] - d1(after[w]), 0) / all_ if w in after else 0) + unseen
        for (v, _), n in c.items():
            total[v] += n
        over = {v: sum(n if n < quality.LEAST else d2(n) for (x, _), n in c.items() if x == v) for v in total}
        models[lang] = lambda v, w, c=c, total=total, over=over, low=low, d2=d2: (max(c[v, w] - d2(c[v, w]), 0) / total[v] + over[v] / total[v] * low(w)) if c[v, w] >= quality.LEAST else (over[v] / total[v] if v in total else 1.0) * low(w)
    nats = lambda t, m: -sum(np.log(m(v, w)) for v, w in zip(["<s>", *(t or "").split()], (t or "").split()))
    mean = {g: sum(nats(t, models[g]) for i, t, x in made[:60] if x == g and i in held) / sum(len(t.split()) for i, t, x in made[:60] if x == g and i in held) for g in models}
    for i, t, g in made[:120]:
        want = np.exp((nats(t, models[g]) + quality.PRIOR * mean[g]) / (len(t.split()) + quality.PRIOR))
        assert got[i].perplexity == pytest.approx(want, rel=1e-4)
    best = min(models, key=lambda g: nats(made[120][1], models[g]))
    assert got[500].model_lang == best and got[503].perplexity is None and not got[503].rejected and got[501].n_words == 0


def test_quality_weighs_bigrams_seen_once(spark):
    made = [(i, "a b c d a b c d", "x") for i in range(40)] + [(100 + i, f"a{i} b{i} c{i} d{i}", "x") for i in range(20)] + [(i, t, "x") for i in range(1000, 1020) for t in [f"a{i - 1000} b{i - 1000}"]]
    made += [(i, f"b{i - 2000} a{i - 2000}", "x") for i in range(2000, 2020)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in made if i < 1000], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in table.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    trusted = table.where("doc_id < 1000").where(~F.col("doc_id").isin(list(held))).select("lang", "text")
    seen = Counter((v, w) for _, t, _ in (r for r in made if r[0] < 1000 and r[0] not in held) for v, w in zip(["<s>", *t.split()], t.split()))
    words, contexts = {w for _, w in seen}, {v for v, _ in seen}
    weights, _ = quality.fit(trusted)
    assert min(seen.values()) == 1 and weights.count() == len(seen) + len(words) + len(contexts)
    whole = {r.doc_id: r.perplexity for r in quality.quality(table, labels).collect()}
    for settings in ({"shard_rows": 7}, {"shard_rows": 40}):
        few = {r.doc_id: r.perplexity for r in quality.quality(table, labels, **settings).collect()}
        assert few == {i: pytest.approx(x) for i, x in whole.items()}
    once = [i for i in range(20) if 100 + i not in held]
    assert once and all(whole[1000 + i] < whole[2000 + i] for i in once)


def test_top_k_blocks_and_shuffled_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist(), "extra") for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    x = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)
    want = []
    for q in range(0, 900, 100):
        s = sorted((-int(v), i) for i, v in enumerate(x @ x[q]) if i != q)[:10]
        want += [(q, k, i, -v) for k, (v, i) in enumerate(s, 1)]
    for settings in ({}, {"rows": 64, "queries": 2}, {"rows": 64, "queries": 2, "broadcast_bytes": 0}):
        assert sorted(tuple(r) for r in topk.top_k(table, **settings).collect()) == sorted(want)


def test_near_dup_strays_are_not_lost(spark):
    """A group of near copies with strays just under and over the bar, against all pairs."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        made.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in made]
    label = list(range(len(made)))
    moved = True
    while moved:
        moved = False
        for a in range(len(sets)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    assert got == dict(enumerate(label))
