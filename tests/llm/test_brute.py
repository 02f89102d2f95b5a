"""Operators that SQL can't express, against brute force over small inputs; skew and density."""

from __future__ import annotations

import importlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tesserine.llm import _store, licenses, minhash, packing, pii, rp_forest, toxicity

from .test_llm import brute_lines, prose, table, vectors, words


def groups_of(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {i: root(i) for i in range(n) if root(i) != i}


# ---------------------------------------------------------------- 3 PII

def test_cards_equal_brute_force():
    """Every stretch of whole digit groups goes to the validator; of overlapping ones the longer stays, then the first."""
    r, finder = random.Random(7), pii.Finder(kinds=tuple(k for k in pii.KINDS if k.name == "credit_card"), threshold=0.0)

    def card():
        d = "".join(r.choice("123456789") for _ in range(r.randint(12, 17)))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    hits = 0
    for _ in range(400):
        groups = []
        for _ in range(r.randint(1, 4)):
            c = card() if r.random() < 0.6 else "".join(r.choice("0123456789") for _ in range(r.randint(1, 9)))
            while c:
                n = r.choice((4, 4, 5, 19))
                groups.append(c[:n])
                c = c[n:]
        text, spans = "pay ", []
        for i, g in enumerate(groups):
            text += r.choice(" -") if i else ""
            spans.append((len(text), len(text) + len(g)))
            text += g
        text += " today"
        valid = [(s, e) for i, (s, _) in enumerate(spans) for _, e in spans[i:] if pii.luhn(text[s:e])]
        kept = []
        for s, e in sorted(valid, key=lambda v: (v[0] - v[1], v[0])):
            if all(e <= a or s >= b for a, b in kept):
                kept.append((s, e))
        assert [(s, e) for _, s, e, _ in finder.find(text)] == sorted(kept), text
        hits += len(kept)
    assert hits > 200


def test_digits_of_any_script_are_read(spark):
    eastern = "".join(chr(0x0660 + int(c)) for c in "4111111111111111")
    got = [(r.doc_id, r.value) for r in pii.spans(table(spark, [(1, f"card {eastern}"), (2, f"1 card {eastern} x"), (3, "a@b.org"), (4, "no sign at all")])).collect()]
    assert sorted(got) == [(1, eastern), (2, eastern), (3, "a@b.org")]


# ---------------------------------------------------------------- 4 toxicity

def test_every_labelled_text_has_a_counterfactual(spark):
    docs = table(spark, [(i, " ".join(prose(i, 20)) + (" scum vermin" if i % 2 else "")) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.pairs == 60
    s = toxicity.scores(model, pa.array(["these women met", "these men met", "scum and vermin", "", None, "?!"]))
    assert abs(s[0] - s[1]) < 0.05 and s[2] > 0.5 and max(s[3:]) < 1e-9


# ---------------------------------------------------------------- 5 licenses

def test_partial_copies_are_found_as_counted_by_brute_force(spark):
    """Templates with words taken out or replaced: found where the share of shingles left reaches the threshold."""
    r, t = random.Random(3), licenses.prepare()
    rows, want = [], set()
    for i in range(240):
        k = r.choice([j for j, (_, text) in enumerate(licenses.TEMPLATES) if len(words(text)) > 25])
        w = licenses.TEMPLATES[k][1].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"odd{r.randrange(1000)}"
        body = words(" ".join(w))
        own = words(licenses.TEMPLATES[k][1])
        grams = lambda x: {tuple(x[j : j + 3]) for j in range(len(x) - 2)}
        rows.append((i, " ".join(prose(i, 30) + w + prose(i + 500, 30))))
        if len(grams(body) & grams(own)) >= 0.8 * len(grams(own)):
            want.add((i, licenses.TEMPLATES[k][0]))
    got = {(x.doc_id, x.license) for x in licenses.scan(table(spark, rows)).collect()}
    assert len(want) > 60 and len(want & got) >= 0.99 * len(want)
    assert {g for g in got - want if g[1] not in {n for n, _ in licenses.TEMPLATES}} == set() and t.names


# ---------------------------------------------------------------- 7 MinHash

def test_groups_equal_all_pairs_of_signatures(spark):
    rows = []
    for g in range(40):
        w = prose(g, 120)
        for c in range(4):
            v = list(w)
            for k in range(c * 3):
                v[(k * 37 + 5) % len(v)] = f"edit{g}x{k}"
            rows.append((len(rows), " ".join(v)))
    sig = np.concatenate([s for _, _, s, _ in minhash.signature_block(pa.array([t for _, t in rows]), minhash.BANDS * minhash.ROWS, minhash.SHINGLE)])
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (sig[a] == sig[b]).mean() >= minhash.THRESHOLD]
    want = set(groups_of(len(rows), pairs).items())
    got = {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert len(want) > 80 and len(got & want) >= 0.97 * len(want) and {a for a, _ in got} <= {a for a, _ in want}

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(rows[a][1]), words(rows[b][1])))
        return len(x & y) / len(x | y)

    exact = groups_of(len(rows), [p for p in itertools.combinations(range(len(rows)), 2) if jaccard(*p) >= 0.5])
    assert set(exact) <= {a for a, _ in got}


def test_an_id_with_two_texts_links_to_both(spark):
    a, b = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " more"), (5, b + " more"), (6, " ".join(prose(3, 60)))]
    for _ in range(2):
        got = {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(table(spark, rows)).collect()}
        assert got == {(i, 1) for i in (2, 3, 4, 5)}
        rows.reverse()


# ---------------------------------------------------------------- 8 packing

def least_windows(sizes, capacity):
    best = len(sizes)

    def go(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(sizes):
            best = len(gaps)
            return
        for g in sorted({*gaps}):
            if g >= sizes[i]:
                rest = list(gaps)
                rest.remove(g)
                go(i + 1, [*rest, g - sizes[i]])
        go(i + 1, [*gaps, capacity - sizes[i]])

    go(0, [])
    return best


def test_packing_against_exhaustive_search():
    """Best-fit decreasing needs at most 11/9 of the least number of windows and one more."""
    r = random.Random(5)
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        got = packing.best_fit([(s, i) for i, s in enumerate(sizes)], 20)
        assert sorted(p[0] for w in got for p in w) == sorted(sizes) and all(sum(p[0] for p in w) <= 20 for w in got)
        least = least_windows(sizes, 20)
        assert least <= len(got) <= 11 * least / 9 + 1


def test_rows_that_nothing_tells_apart_spread_over_the_shards(spark):
    docs = spark.range(40_000).selectExpr("if(id % 2 = 0, null, 7L) as doc_id", "repeat('word', 250) as text")
    rows = packing.pack(docs, shard_tokens=1_000_000).select("shard", "tokens", "doc_ids").collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.tokens
    assert sum(load.values()) == 40_000 * 250 and len(load) == 10 and max(load.values()) <= 1_100_000
    assert sum(r.doc_ids.count(None) for r in rows) == 20_000


# ---------------------------------------------------------------- 10 embeddings

def copies(cuts, x, tree):
    return sum(len(rows) for _, rows in rp_forest.route(x, tree, cuts)) / len(x)


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_dense_and_wide_vectors_are_split_without_growing(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(384)
    for dim, x, node in ((384, unit(base + rng.standard_normal((30_000, 384)) * 0.098), 1000), (1536, unit(rng.standard_normal((4000, 1536))), 400)):
        if dim == 384:
            assert 0.98 < float((x[:100] @ x[100:200].T).mean()) < 0.995
        vecs = spark.createDataFrame(pa.table({"_id": np.arange(len(x)), "vec": pa.array([v.tobytes() for v in x], pa.binary())}))
        cuts = rp_forest._cuts(vecs, range(2), rp_forest.SPILL, node, rp_forest.SENT_LEVELS)
        for tree in range(2):
            placed = rp_forest.route(x, tree, cuts)
            assert max(len(rows) for _, rows in placed) <= node and copies(cuts, x, tree) <= 4


def test_cuts_joined_by_node_find_what_sent_ones_find(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 16))
    x = np.concatenate([base, base + rng.standard_normal(base.shape) * 0.05])
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for levels in (1, 13):
        got = {(r.vec_id, r.duplicate_of) for r in rp_forest.near_duplicates(rows, node_rows=60, leaf_rows=16, sent_levels=levels, threshold=0.95).collect()}
        pairs = np.argwhere(np.triu(unit(x) @ unit(x).T >= 0.95, 1))
        want = set(groups_of(len(x), pairs.tolist()).items())
        assert len(want) >= 380 and len(got & want) >= 0.97 * len(want) and {a for a, _ in got} <= {a for a, _ in want}


def test_vectors_that_no_split_tells_apart(spark):
    """All projections of one-entry vectors tie: they collapse to two, and are not near each other."""
    got = rp_forest.near_duplicates(vectors(spark, [(i, [1.0 if i % 2 else -1.0]) for i in range(50)]), node_rows=1, leaf_rows=1, trees=2).collect()
    assert {(r.vec_id, r.duplicate_of) for r in got} == {(i, i % 2) for i in range(2, 50)}


# ---------------------------------------------------------------- shared storage

def test_tables_made_on_the_way_are_removed(spark):
    def step():
        _store.cut(spark.range(3).toDF("x"), "on-the-way")
        return _store.cut(spark.range(5).toDF("x"), "result")

    before = set(_store._made)
    out = _store.kept_only(step)
    assert out.count() == 5 and set(_store._made) - before == {out._tesserine_path}


# ---------------------------------------------------------------- pipeline

def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages over a small corpus, against the same decisions taken one by one in Python."""
    pipeline = importlib.import_module("corpus_pipeline")
    item = " ".join(prose(9000, 40))
    rows, near = [], {}
    for i in range(120):
        lines = [" ".join(prose(10_000 + 10 * i + k, 30)) for k in range(4)]
        if i % 5 == 1:
            lines.append(" ".join([*prose(i + 77, 6), *"scum vermin filth trash idiots".split()]))
        if i % 9 == 2:
            lines.insert(1, "all rights belong to the same people who wrote these very words for us")
        if i % 11 == 3:
            lines.append(item)
        rows.append((i, "\n".join(lines)))
    for i in (0, 12, 18, 24, 30, 42, 48, 54):  # near copies: four words of every line changed, too many for the line stage
        w = [x.split() for x in rows[i][1].split("\n")]
        for k, line in enumerate(w):
            for j in range(10, min(14, len(line))):
                line[j] = f"swap{i}x{k}x{j}"
        near[len(rows)] = i
        rows.append((len(rows), "\n".join(" ".join(x) for x in w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (None, "a row without an id has words too")]
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    toxic = {i for i, t in rows if t and "scum vermin" in t}
    left = [(i, t) for i, t in rows if i not in toxic]
    gone = brute_lines(left)
    cut_ = [(i, t if not any(x[0] == i for x in gone) else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in left]
    cut_ = [(i, t) for i, t in cut_ if not any(x[0] == i for x in gone) or words(t)]
    own = [(i, t) for i, t in cut_ if i is not None and words(t)]
    sig = np.concatenate([s for _, _, s, _ in minhash.signature_block(pa.array([t for _, t in own]), minhash.BANDS * minhash.ROWS, minhash.SHINGLE)])
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if (sig[a] == sig[b]).mean() >= minhash.THRESHOLD]
    copies_ = {own[a][0] for a in groups_of(len(own), pairs)}
    kept = [(i, t) for i, t in cut_ if i not in copies_ and not (t and item in t)]
    want = Counter()
    for i, t in kept:
        want[i] += -(-len((t or "").encode()) // 4)
    got, windows = Counter(), pipeline.run(spark, sf).collect()
    for r in windows:
        assert r.tokens == sum(r.lengths) <= r.capacity
        for d, n in zip(r.doc_ids, r.lengths):
            got[d] += n
    assert got == +want and toxic and len({i for i, _ in gone}) > 5 and copies_ >= set(near)
