"""Spelling variants, hard negatives and the class language model against plain versions, with edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import class_lm, hard_negatives, queries, spelling_variants
from assetlens.scratch import Scratch

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


# ---- spelling variants


def plain_counts(rows, every=97):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            if i is not None and every is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = defaultdict(set)
    by = defaultdict(list)
    for w in counts:
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].append(w)
        by[w].append(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        if near[w]:
            top = min(near[w], key=lambda v: (-counts[v], v))
            if counts[top] >= 2 * n:
                form[w] = top
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def variants(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.group_variants(df, **options).collect()}


@pytest.mark.parametrize("hot", [256, 2])
def test_variants_of_the_documents(spark, data, hot):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = variants(docs, hot=hot)
    assert got == plain_variants(plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    if hot == 256:
        assert got == {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.QUERIES["op11_spelling_variants"](spark, data).collect()}


@pytest.mark.parametrize("hot", [256, 1])
def test_every_kind_of_edit(spark, hot):
    # replaced, inserted and deleted at each place, doubled letters, capital accents, chains of forms, ties, a very long word
    word, long = "stone", "q" * 3000 + "z"
    forms = [word[:k] + "x" + word[k + 1 :] for k in range(5)] + [word[:k] + c + word[k:] for k in range(6) for c in "xs"] + [f"{word}É", f"{word}é", "sstonee", long, long[1:], long[:-1]]
    rows = [(k, " ".join([w] * (3 + k % 4))) for k, w in enumerate(forms)]
    rows += [(None, "STONE " * 40), (7, None), (8, ""), (9, " \n×÷ 1,2"), (9, "stone" * 1), (9, "stone" * 1), (100, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "abcdef " * 13)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS + ", word string, n int")
    got = variants(df, hot=hot)
    assert got == plain_variants(plain_counts(rows))
    assert got["abcde"][:2] == ("abcdef", "abcdef")


def test_a_hot_chunk_and_an_empty_table(spark):
    letters = "abcdefghijklmnop"
    words = [f"common{a}{b}{c}ending" for a in letters for b in letters[:6] for c in letters[:4]]
    rows = [(k, f"{w} {w} {w}") for k, w in enumerate(words)]
    want = plain_variants(plain_counts(rows, None))
    assert variants(spark.createDataFrame(rows, DOCS), typo_every=None, hot=16) == want
    assert variants(spark.createDataFrame([], DOCS)) == {}


# ---- hard negatives


def plain_negatives(rows, every=100):
    """rows: (id, label, vector) that take part."""
    z = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    label = {i: lab for i, lab, _ in rows}
    score = lambda a, b: sum(x * y for x, y in zip(z[a], z[b]))
    out = []
    for a in (i for i in z if i % every == 0):
        ranked = sorted((-score(a, b), b) for b in z if b != a and len(z[b]) == len(z[a]))
        for p, positive in [x for x in ranked if label[x[1]] == label[a]][:5]:
            fits = [x for x in ranked if label[x[1]] != label[a] and -30 * p <= -100 * x[0] <= -90 * p][:10]
            out += [(a, positive, k + 1, b, -p, -s) for k, (s, b) in enumerate(fits)]
    return sorted(out)


def mined(df, **options):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hard_negatives.mine(df, **options).collect())


VECTORS = "vec_id long, label int, embedding array<double>, z int, i string"


def test_negatives_with_copies_ties_and_odd_rows(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 40)) / 6
    rows = [(k, int(r.integers(0, 3)), list(map(float, base[r.integers(0, 12)] + r.choice([0, 0.02], p=[0.6, 0.4]) * r.normal(size=40)))) for k in range(600)]
    short = [(1000 + k, k % 2, list(map(float, r.normal(size=3)))) for k in range(30)] + [(1100, 0, [0.0, 0.0, 0.0]), (1200, 9, [1.0, 2.0, 3.0])]
    large = [(1300, 0, [3e6, 1.0]), (1301, 0, [2e6, -5.0]), (1302, 1, [1e6, 7.0]), (1303, 1, [1.5e6, 0.5])]
    odd = [(None, 1, [1.0] * 40), (2000, None, [1.0] * 40), (2001, 1, None), (2002, 1, []), (2003, 1, [None] + [1.0] * 39), (2004, 1, [float("nan")] * 40), (2005, 1, [float("inf")] * 40), (2006, 1, [1e300] * 40)]
    good = rows + short + large
    df = spark.createDataFrame([(*x, 1, "x") for x in good + good[:50] + odd], VECTORS)
    want = plain_negatives(good)
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df, levels=1, row_block=64, anchor_block=2, least_blocks=3) == want
    assert mined(df.where("false")) == []


def test_intervals_hold_and_shrink():
    r = np.random.default_rng(4)
    z = np.floor(256 * r.normal(size=(500, 70))).astype(np.int64)
    z[0] = 0
    exact = z[:40] @ z.T
    width = []
    for levels in (1, 3):
        lower, upper = hard_negatives.intervals(z[:40], *hard_negatives.codes(z, levels))
        assert (lower <= exact).all() and (exact <= upper).all()
        width.append((upper - lower)[:, 1:].mean())
    assert width[1] < 0.5 * width[0]


# ---- class language model


def test_scores_against_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "unheardof wordz the The THE"), (-3, "the " * 50_000)], DOCS)
    docs = docs.unionByName(extra)
    scratch = Scratch(spark, "test")
    model = class_lm.fit(docs, scratch, classes=12, clustered=300, known=2000, least=3, rounds=3)
    u = model.units
    assert u.cut > 1 and 0 < len(u.words) <= 300 and len(u.h) <= 2000
    got = {r["doc_id"]: r for r in class_lm.score(docs, model, scratch).collect()}

    rows = [tuple(r) for r in docs.collect()]
    tokens = {i: [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWERED))] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for i in train for w in [*tokens[i], None])
    n, v = sum(c.values()), len(c)
    clustered = set(u.words.tolist())
    h = {w: int(class_lm.hashed([w])[0][0]) for w in {w for x in tokens.values() for w in x}}
    place = {x: k + 1 for k, x in enumerate(u.words.tolist())}
    ending = lambda w: ((w[-2] if len(w) > 1 else 0) << 8) | w[-1]
    rare_n, rare_types = Counter(), Counter()
    for w, m in c.items():
        if w is not None and h[w] not in clustered:
            rare_n[ending(w)] += m
            rare_types[ending(w)] += 1

    def unit(w):
        if w is None:
            return 0, 0.0
        if h[w] in clustered:
            return place[h[w]], 0.0
        e = ending(w)
        if not rare_n[e]:
            return u.other, 0.0
        return len(u.words) + 1 + e, math.log10((c[w] + 1) / (rare_n[e] + rare_types[e] + 1))

    for i, t in tokens.items():
        r = got[i]
        seq = [*t, None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(seq), sum(c[w] > 0 for w in seq), n, i not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq), rel=1e-9)
        before, total = model.cls[0], 0.0
        for w in seq:
            x, inside = unit(w)
            total += model.transition[before, model.cls[x]] + model.emission[x] + inside
            before = model.cls[x]
        assert r["score"] == pytest.approx(total, rel=1e-9) and r["perplexity"] == pytest.approx(10 ** (-total / len(seq)), rel=1e-6)
    # a history's probabilities add up to one
    used = np.flatnonzero(u.count)
    assert np.bincount(model.cls[used], 10 ** model.emission[used], len(model.transition))[np.unique(model.cls[used])] == pytest.approx(1)
    assert (10**model.transition).sum(axis=1) == pytest.approx(1)
    scratch.close()


def test_held_out_texts_are_likelier_than_under_the_base(spark, data):
    out = queries.QUERIES["op13_class_lm"](spark, data).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 10 and out[0] > out[1]


def test_exchange_finds_alternating_words(spark):
    # adjectives and nouns alternate, in two languages that don't mix
    r = np.random.default_rng(5)
    kinds = [[f"{c}{k}" for k in range(20)] for c in "abcd"]
    rows = [(i, " ".join(kinds[2 * (i % 2) + p % 2][r.integers(0, 20)] for p in range(60))) for i in range(400)]
    scratch = Scratch(spark, "test")
    model = class_lm.fit(spark.createDataFrame(rows, DOCS), scratch, classes=12, rounds=4)
    of = {int(x): int(model.cls[k + 1]) for k, x in enumerate(model.units.words)}
    found = [{of[int(class_lm.hashed([w.encode()])[0][0])] for w in kind} for kind in kinds]
    assert sum(len(x) for x in found) == len(set.union(*found)) <= 12  # no class mixes kinds
    scratch.close()


def test_gain_is_the_likelihoods_change():
    r = np.random.default_rng(6)
    n = r.integers(0, 5, (9, 9)).astype(float)  # bigrams of nine words
    cls = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])

    def likelihood(cls):
        m = np.zeros((3, 3))
        np.add.at(m, (cls[:, None], cls[None, :]), n)
        f = class_lm._xlogx
        return m, f(m).sum() - f(m.sum(axis=0)).sum() - f(m.sum(axis=1)).sum()

    m, now = likelihood(cls)
    for w in range(9):
        for to in range(3):
            if to != cls[w]:
                new = cls.copy()
                new[w] = to
                after = np.bincount(cls, n[w], 3)[None]
                before = np.bincount(cls, n[:, w], 3)[None]
                assert class_lm.gain(m, cls[[w]], np.array([to]), after, before, n[[w], w])[0] == pytest.approx(likelihood(new)[1] - now)


def test_scores_of_no_rows_and_of_no_training(spark):
    assert class_lm.score_texts(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if class_lm.held_out(i))
    r = class_lm.score_texts(spark.createDataFrame([(held, "a b", "x")], DOCS + ", n string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


# ---- embeddings: repeated ids, and every pair


@pytest.mark.parametrize("exact", [False, True])
def test_embeddings_with_repeated_ids(spark, exact):
    from assetlens.llm.embedding_lsh import link_vectors

    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [1.0, 0.001], 0), (4, [0.0, 1.0], 1), (5, [0.3, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), exact=exact).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_exact_embeddings_miss_no_link_at_the_threshold(spark):
    from assetlens.llm.embedding_lsh import link_vectors

    r = np.random.default_rng(8)
    v = r.normal(size=(150, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    side = r.normal(size=v.shape)
    side -= (side * v).sum(1, keepdims=True) * v
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    pairs = 0.9801 * v + math.sqrt(1 - 0.9801**2) * side
    rows = [(2 * i + k, [float(y) for y in x], i % 2) for i, two in enumerate(zip(v, pairs)) for k, x in enumerate(two)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=16, exact=True).collect()}
    assert got == {i: (1, i - i % 2) for i in range(300)}


# ---- url templates


def plain_templates(urls, rules, support=3, share=0.005, prior=0.2, weight=4.0, z=1.96, threshold=0.8):
    """url -> (template, purity, verdict) for paths of letters: the tree by recursion over whole lists."""
    from urllib.parse import urlsplit

    out = {}
    hosts = defaultdict(Counter)
    for u in urls:
        x = urlsplit(u)
        hosts[x.netloc][tuple(s for s in x.path.split("/") if s)] += 1

    def label(path):
        fits = [(len(p), kind) for kind, p in rules if ("/" + "/".join(path) + "/").startswith(p)]
        return max(fits)[1] if fits else None

    def grow(host, paths, level, template, node, purity, alike):
        n, m = sum(c for _, c in paths), sum(c for p, c in paths if label(p))
        b = sum(c for p, c in paths if label(p) == "block")
        purity = (b + weight * purity) / (m + weight)
        done = defaultdict(list)
        go = []
        for p, c in paths:
            if len(p) <= level:
                done[template].append((p, c))
            elif n < support or not m:
                done[template + "/**"].append((p, c))
            elif alike:
                done[template + "/" + "/".join(p[level:])].append((p, c))
            else:
                go.append((p, c))
        for t, ps in done.items():
            lm, lb = sum(c for p, c in ps if label(p)), sum(c for p, c in ps if label(p) == "block")
            own = (lb + weight * purity) / (lm + weight)
            for p, _ in ps:
                out[host, p] = (t or "/", own, "block" if own >= threshold and lm else "allow")
        kids = defaultdict(list)
        for p, c in go:
            kids[p[level]].append((p, c))
        pn = sum(c for _, c in go)
        kinds = defaultdict(list)
        bins = defaultdict(list)
        for seg, ps in kids.items():
            kn, km = sum(c for _, c in ps), sum(c for p, c in ps if label(p))
            if kn < support or kn < share * pn:
                kinds["*"].append(seg)
            elif km:
                bins[min(31, int(sum(c for p, c in ps if label(p) == "block") / km * 32))].append(seg)
            else:
                kinds["=", frozenset(p[level + 1] if len(p) > level + 1 else "" for p, _ in ps)].append(seg)
        cluster, cb, cm = 0, 0, 0
        for k in sorted(bins):
            ps = [x for seg in bins[k] for x in kids[seg]]
            xb, xm = sum(c for p, c in ps if label(p) == "block"), sum(c for p, c in ps if label(p))
            pooled = (cb + xb) / (cm + xm)
            if cm and abs(xb / xm - cb / cm) > z * math.sqrt(pooled * (1 - pooled) * (1 / cm + 1 / xm)):
                cluster, cb, cm = cluster + 1, 0, 0
            cb, cm = cb + xb, cm + xm
            kinds["~", cluster] += bins[k]
        for kind, segs in kinds.items():
            name = "*" if kind == "*" else segs[0] if len(segs) == 1 else kind[0] + min(segs)
            ps = [x for seg in segs for x in kids[seg]]
            grow(host, ps, level + 1, f"{template}/{name}", None, purity, len({p[level + 1 :] for p, _ in ps}) == 1)

    for host, paths in hosts.items():
        grow(host, list(paths.items()), 0, "", None, prior, False)
    return {u: out[urlsplit(u).netloc, tuple(s for s in urlsplit(u).path.split("/") if s)] for u in urls}


def test_templates_against_a_plain_tree(spark):
    from assetlens.llm.url_templates import judge_urls

    r = np.random.default_rng(9)
    word = lambda k: "".join(chr(97 + d) for d in divmod(int(k), 26))
    # the paths ruled by /x/ and /y/ are labels; deeper parts follow with them or apart from them
    rules = [("allow", "/q/"), ("block", "/q/bad/"), ("block", "/q/s/z/"), ("block", "/x/")]
    urls = [f"http://h{r.integers(0, 2)}.com/" + "/".join(r.choice(["q", "x", "bad", "s", "z", word(r.integers(0, 200))]) for _ in range(r.integers(0, 6))) for _ in range(3000)]
    urls += [f"http://h0.com/q/s/{r.choice(['z', 'w'])}/{word(r.integers(0, 40))}" for _ in range(600)] + [f"http://h0.com/q/{r.choice(['bad', 'fine'])}/{word(k)}/page" for k in range(40) for _ in range(4)]
    urls = [u.rstrip("/") + "/" for u in urls]  # a rule fits the whole segment then, as the plain version has it
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    both = tuple((kind, "com", path) for kind, path in rules)
    want = plain_templates(urls, rules)
    got = judge_urls(pages, both).where("rule is null").collect()
    assert len(got) > 1000
    for x in got:
        t, purity, verdict = want[urls[x.page_id]]
        assert (x.template, x.verdict) == (t, verdict) and x.template_purity == pytest.approx(purity), (urls[x.page_id], x, t)


def test_like_siblings_merge_and_deep_paths_are_cheap(spark):
    from assetlens.llm.url_templates import judge_urls, template_verdicts

    word = lambda k: "".join(chr(97 + d) for d in divmod(k, 26))
    rows = [("h", ["top", f"b{word(k)}"], "block") for k in range(40) for _ in range(5)] + [("h", ["top", f"a{word(k)}"], "allow") for k in range(40) for _ in range(5)]
    judged = spark.createDataFrame(rows + [("h", ["top", "once"], None)], "host string, shape array<string>, rule_verdict string")
    got = {(tuple(r.shape), r.template, r.template_verdict) for r in template_verdicts(judged, share=0.0).collect()}
    assert {(t, v) for _, t, v in got} == {("/top/~aaa", "allow"), ("/top/~baa", "block"), ("/top/*", "allow")}
    deep = [(k, "http://d.com/" + "/".join(f"s{word(j)}" for j in range(200))) for k in range(3)] + [(3, None)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    assert judge_urls(spark.createDataFrame(deep, "page_id bigint, url string"), (("block", "d.com", "/sab/"),)).count() == 4
    assert len(jobs.getJobIdsForGroup("deep")) < 30
    spark.sparkContext.setJobGroup("", "")


# ---- co-training


def adam(x, y, weight, ridge, penalty=1e-3, steps=150, rate=0.1):
    """Logistic weights by Adam; ridge: how many leading columns (all but the last, a one) are penalised."""
    w, m, v = np.zeros((3, x.shape[1]))
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y) / total)
        g[:ridge] += penalty * w[:ridge]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def plain_co_training(rows, good, rounds, added, confidence):
    """rows: key, text, lang, source, n_chars of each distinct document; good: label by key. What each round names per view, and the final scores and threshold."""
    one = lambda n: np.ones((n, 1))
    words = [set(re.findall("[a-z]+", t.lower())) for _, t, *_ in rows]
    names = sorted(set().union(*words))
    ones = np.array([[w in own for w in names] for own in words], float)
    count = lambda t, chars: sum(c in chars for c in t)
    capitals, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shares = np.array([[math.log1p(100 * count(t, c) / max(len(t), 1)) for c in ("#*$%&|<>", capitals, "!?", digits)] + [2 * len(own) / max(len(re.findall("[a-z]+", t.lower())), 1), math.log1p(max(len(re.findall("[a-z]+", t.lower())), 1)) / 4] for (_, t, *_), own in zip(rows, words)])
    kinds = [[f"lang:{a}", f"source:{b}", f"size:{int(math.log2(n + 1))}"] for _, _, a, b, n in rows]
    meta = np.array([[k in own for k in sorted(set(sum(kinds, [])))] for own in kinds], float)
    at = {row[0]: i for i, row in enumerate(rows)}
    pool = [at[k] for k in sorted(good)]
    y = {i: float(good[rows[i][0]]) for i in pool}
    held, train = pool[::3], [i for k, i in enumerate(pool) if k % 3]
    known = [{i: y[i] for i in train}, {i: y[i] for i in train}]
    named_by_round = []
    for k in range(rounds + 1):
        often = ones[pool].sum(0) >= 4
        x = np.hstack([ones * often, shares, one(len(rows))]), np.hstack([meta, one(len(rows))])
        models = []
        for v in (0, 1):
            i, t = list(known[v]), np.array(list(known[v].values()))
            share = np.clip(t.mean(), 0.01, 0.99)
            models.append(adam(x[v][i], t, np.where(t == 1, 0.5 / share, 0.5 / (1 - share)), x[v].shape[1] - 1))
        if k == rounds:
            break
        named = []
        for v in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(x[v] @ models[v], -30, 30)))
            free = [i for i in range(len(rows)) if rows[i][0] not in good and i not in known[1 - v] and abs(p[i] - 0.5) > confidence - 0.5]
            free.sort(key=lambda i: (-abs(p[i] - 0.5), rows[i][0]))
            named.append({rows[i][0]: float(p[i] > 0.5) for i in free[: max(1, int(added * len(train)))]})
        named_by_round.append(named)
        if not any(named):
            break
        for v in (0, 1):
            known[1 - v] |= {at[h]: t for h, t in named[v].items()}
        pool += sorted({at[h] for n in named for h in n} - set(pool), key=lambda i: rows[i][0])
    return named_by_round, models, x, held, y


def test_co_training_round_by_round(spark, monkeypatch):
    from assetlens.llm import cotrain

    r = np.random.default_rng(12)
    vocabulary = ["apple", "bread", "cloud", "drift", "ember", "flint", "grain", "hazel"]
    made, labels = [], []
    for k in range(420):
        bad = bool(r.random() < 0.4)
        text = " ".join(r.choice(vocabulary, int(r.integers(5, 30)))) + (" junk #" * int(r.integers(0, 3)) if bad else " Fine." * int(r.integers(0, 2)))
        lang, source = ("en" if r.random() < 0.7 else "de"), ("spam" if bad and r.random() < 0.7 else "news")
        made.append((k, text, lang, source, len(text)))
        if k < 150:
            labels.append((k, int(not bad), 0))
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [tuple(x)[1:] for x in cotrain._keyed(docs).select("doc_id", "_h", "text", "lang", "source", "n_chars").collect()]
    key = {x.doc_id: x._h for x in cotrain._keyed(docs).collect()}
    seen, inner = [], cotrain.surest_unlabelled
    monkeypatch.setattr(cotrain, "surest_unlabelled", lambda *a: seen.append(inner(*a)) or seen[-1])
    model = cotrain.fit(docs, lab, confidence=0.8, rounds=2, added=0.2)
    want, models, x, held, y = plain_co_training(rows, {key[d]: q for d, q, _ in labels}, 2, 0.2, 0.8)
    assert [named for named, _ in seen] == want and all(len(n) > 5 for named in want for n in named)
    # the views are calibrated on one half of the held rows, the threshold is set on the other
    t = np.array([y[i] for i in held])
    margins = [xv[held] @ mv for xv, mv in zip(x, models)]
    maps = [adam(np.c_[m[::2], np.ones(len(m[::2]))], t[::2], np.ones(len(t[::2])), 1, 1e-4, 400, 0.05) for m in margins]
    assert np.allclose(model.views, maps, atol=1e-6)
    both = np.stack([m * a + b for m, (a, b) in zip(margins, maps)], 1)
    mix = adam(np.c_[both[::2], np.ones(len(t[::2]))], t[::2], np.ones(len(t[::2])), 2, 1e-4, 400, 0.05)
    assert np.allclose(model.mix, mix, atol=1e-6)
    p = 1 / (1 + np.exp(-(both[1::2] @ mix[:2] + mix[2])))
    gain = lambda c: (p[t[1::2] == 1] >= c).mean() + (p[t[1::2] == 0] < c).mean()
    assert gain(model.threshold) == pytest.approx(max(gain(c) for c in [0, *np.sort(p) + 1e-9]), abs=0.02)
    scores = {s.doc_id: s for s in cotrain.score(docs, model).collect()}
    every = np.stack([xv @ mv * a + b for xv, mv, (a, b) in zip(x, models, maps)], 1)
    plain = dict(zip([row[0] for row in rows], 1 / (1 + np.exp(-(every @ mix[:2] + mix[2])))))
    assert all(scores[d].score == pytest.approx(plain[key[d]], abs=1e-6) and scores[d].kept == (scores[d].score >= model.threshold) for d in key)
