"""The learned operators, hot paths and the pipeline's stages against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(sets, percent):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def repeats(texts):
    split = {d: WORDS.findall(t or "") for d, t in texts.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    out = {}
    for d, w in split.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        out[d] = [x for x, k in zip(w, keep) if k]
    return out


# ---- chat


def test_chat_windows_keep_the_budget_with_a_long_system_turn(spark):
    from assetlens.llm import chat_windows
    from assetlens.llm.chat_windows import format_windows, read_back
    from assetlens.scratch import Scratch

    rows = [(1, 0, "system", "s " * 400), *[(1, k, "user" if k % 2 else "assistant", f"t{k} " * 100) for k in range(1, 40)]]
    rows += [(2, 0, "system", "s " * 2000), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (None, None, None, None), (None, None, "assistant", "x"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    rows += [(4, k, "assistant" if k % 3 else "user", f"<|im_end|> & [{k}]") for k in range(300)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"no": F.lit("clash"), "span": F.lit(1), "tokens": F.lit(2), "part": F.lit(3), "s_text": F.lit(4)})
    rows += (crowd := [(None, k % 6, "assistant" if k % 2 else "user", f"{k * 7919 % 2000} words and more") for k in range(2000)])
    d = d.unionByName(spark.createDataFrame(crowd, "conv_id bigint, turn bigint, role string, text string"), allowMissingColumns=True)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for ranges in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            placed = chat_windows._placed(d, Scratch(spark, "test"))
            crowded = placed.where("conv_id is null").groupBy("block").count().agg(F.max("count"), F.count("*")).first()
            windows = format_windows(d, budget=1024)
            got = windows.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert ranges == 1 or (crowded[0] < 300 and crowded[1] > 10)  # one conversation, few turn numbers, many ranges
        seen.append(sorted((r.conv_id or 0, r.window_no, r.n_repeated, r.formatted) for r in got))
        # history reaches over the borders of ranges, so the windows are the same however the turns are dealt out
        assert seen[0] == seen[-1] and any(r.n_repeated == 2 for r in got if r.conv_id is None)
        assert all(r.n_tokens <= 1024 for r in got if r.conv_id != 2) and len({(r.conv_id, r.window_no) for r in got}) == len(got)
        assert all(("s " * 400) in r.formatted for r in got if r.conv_id == 1) and sum(r.n_repeated > 1 for r in got if r.conv_id == 1) > 1
        back = {r.conv_id: r for r in read_back(windows).collect()}
        for c in {x[0] for x in rows}:
            mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
            turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
            loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
            assert (back[c].n_turns, back[c].turns_sha256, back[c].loss_chars, back[c].loss_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert format_windows(d.limit(0)).count() == 0


# ---- archives


def test_archives_are_runs_and_their_merge_is_global(spark, tmp_path):
    from assetlens.llm import warc_index as w

    r = random.Random(6)
    rows = [(k, f"http://h{r.randrange(6)}.org/p {r.randrange(9)}", f"<p>{'x' * r.randrange(300)}{k % 7}</p>") for k in range(900)]
    rows += [(k, None, None) for k in range(900, 903)] + [(None, "http://h1.org/p 1", "y" * 200), (5, *rows[5][1:]), (901, "http://h1.org/p 1", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"file": F.lit("clash"), "digest": F.lit(1), "rows": F.lit(2)}).repartition(3)
    folder = f"file://{tmp_path}/w"
    made = w.write_archives(pages, folder, file_bytes=4096).collect()
    assert len(made) > 6 and sum(m.records for m in made) == len(rows)
    index = w.read_archives(spark, folder)
    key = lambda x: (x.url_key, x.captured_at, x.page_id is not None, x.page_id or 0)
    by_file: dict = {}
    for x in index.collect():
        by_file.setdefault(x.file, []).append(x)
    assert len(by_file) == len(made) and all([key(x) for x in v] == sorted(key(x) for x in v) for v in by_file.values())
    merged = w.merge_runs(index, rows_per_range=100).collect()  # in the order of partitions
    assert [key(x) for x in merged] == sorted(key(x) for v in by_file.values() for x in v)
    assert Counter(x.page_id for x in merged) == Counter(x[0] for x in rows)
    with pytest.raises(ValueError, match="isn't sorted"):
        list(w.LoserTree([[1, 3, 2]]))
    with pytest.raises(EOFError):
        list(w._parsed(next(tmp_path.glob("w/*.gz")).read_bytes()[:-9]))


def test_archives_are_read_in_time_proportional_to_their_size():
    import os
    import time

    from assetlens.llm import warc_index as w

    record = w._gzip(w._record(1, "u", "2024", os.urandom(900), "d", None), 1)

    def seconds(n: int) -> float:
        began = time.process_time()
        assert sum(1 for _ in w._parsed(record * n)) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000) + 0.2


# ---- urls


def test_templates_of_any_depth(spark):
    from assetlens.llm.url_templates import judge_urls

    rules = (("block", "h.com", "/a/b/c/q"), ("allow", "h.com", "/a/b/c/home"), ("block", "i.com", "/x"), ("allow", "i.com", "/y"))
    urls = [f"http://h.com/a/b/c/q{chr(97 + k)}{chr(98 + k)}" for k in range(20)]  # twenty rare segments, all blocked
    urls += ["http://h.com/a/b/c/zz", "http://h.com/a/b/c/home", "http://h.com/a/b/other", *["http://h.com/a/b/c/list"] * 40, *["http://h.com/a/b/d/zz"] * 3]
    urls += ["http://i.com/x1", "http://i.com/y1", "http://i.com/" + "/".join("abcdefghijkl"), None, "http://j.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"node": F.lit("clash"), "shape": F.lit(1), "branch": F.lit(2)})
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    at = {u: got[k] for k, u in enumerate(urls)}
    assert all(got[k].verdict == "block" and got[k].rule == "h.com/a/b/c/q" for k in range(20))
    rare, often = at["http://h.com/a/b/c/zz"], at["http://h.com/a/b/c/list"]
    assert rare.rule is None and (rare.verdict, rare.template) == ("block", "/a/b/c/*") and rare.template_purity > 0.8
    assert (often.verdict, often.template) == ("allow", "/a/b/c/list") and at["http://h.com/a/b/d/zz"].verdict == "allow"
    assert at[None].verdict == at["http://j.com/"].verdict == at["http://i.com/" + "/".join("abcdefghijkl")].verdict == "allow" and len(got) == len(urls)
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_alike_branches_are_merged(spark):
    from assetlens.llm.url_templates import judge_urls

    rules = (("block", "h.com", "/es/"), ("block", "h.com", "/fr/"), ("allow", "h.com", "/en/"))
    urls = [f"http://h.com/{lang}/{w}" for lang in ("es", "fr", "en") for w in ("one", "two", "three", "four") for _ in range(10)] + ["http://h.com/es", "http://h.com/fr", "http://h.com/en"]
    got = {u: r for r, u in zip(sorted(judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect(), key=lambda r: r.page_id), urls)}
    assert got["http://h.com/es"].rule is None and len({got[f"http://h.com/{x}"].template for x in ("es", "fr", "en")}) >= 2


# ---- n-gram join


def test_ngram_join_hot_paths(spark):
    from assetlens.llm.ngram_join import Limits, jaccard_components, keep_one_per_component

    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(300)]
    rows = []
    for g in range(3):  # groups of near copies, some just under and some just over the threshold to each other
        base = r.choices(vocabulary, k=120)
        for _ in range(60):
            w = list(base)
            for at in r.sample(range(120), r.choice([0, 1, 2, 5, 6, 7])):
                w[at] = r.choice(vocabulary)
            rows.append(" ".join(w))
    common = " ".join(r.choices(vocabulary, k=30))
    rows += [common + " " + " ".join(r.choices(vocabulary, k=40)) for _ in range(80)]
    rows += [rows[0]] * 90
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumns({"n": F.lit("clash"), "k1": F.lit(1), "component": F.lit(2)})
    want = linked({d: shingles(t, 3) for d, t in enumerate(rows)}, 80)
    for limits in (Limits(), Limits(pivots=3, large=4, members=5, queries=7, ids=10, heavy=30)):
        assert {x.doc_id: x.component_id for x in jaccard_components(docs, 3, 80, limits).collect()} == want
    kept = keep_one_per_component(docs, 3, 80)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, c in want.items() if d == c}


def test_ngram_join_of_repeated_ids(spark):
    from assetlens.llm.ngram_join import jaccard_components

    a, b, c = ("a b c d e f g h", "p q r s t u v w", "zz yy xx ww vv uu")
    rows = [(1, a), (2, a), (3, b), (3, c), (4, c), (5, b), (None, a), (6, None)]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80).collect())
    # both texts of 3 count: one links it with 5, the other with 4, and 3 is the smallest of them
    assert got == [(0, 6, 0), (1, 6, 1), (2, 6, 1), (3, 4, 3), (3, 6, 3), (4, 4, 3), (5, 6, 3), (6, 0, 6)]


def test_shingle_counts_are_whole(spark):
    """A shingle in more leads than `heavy` is found heavy, however the documents are dealt out."""
    from assetlens.llm import ngram_join

    r = random.Random(4)
    rows = [(k, "one common shingle " + " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = ngram_join.shingle_counts(docs, 3)
    assert counts.max() == 3000
    heavy = ngram_join.signatures(docs, 3, 90, counts, 2000).where("heavy < n").count()
    assert heavy == 3000


# ---- suffix trees


def test_suffix_tree():
    from assetlens.llm.substring_dedup import suffix_tree

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for seed in range(60):
        r = random.Random(seed)
        strings = [[r.randrange(r.choice([2, 3, 9])) for _ in range(r.randrange(1, r.choice([3, 9, 26])))] for _ in range(r.randrange(1, 9))]
        strings += [strings[0]] * (seed % 3)
        order, lcp, depth = suffix_tree(np.array([x for s in strings for x in s]), np.array([len(s) for s in strings]))
        suffix = [tuple(s[i:]) for s in strings for i in range(len(s))]
        assert [suffix[i] for i in order] == sorted(suffix)
        assert lcp.tolist() == [0] + [common(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
        assert depth.tolist() == [max([common(x, y) for j, y in enumerate(suffix) if j != i], default=0) for i, x in enumerate(suffix)]


@pytest.mark.parametrize("subtree", [50_000, 40, 1])
def test_substring_dedup_of_a_common_passage(spark, subtree):
    from assetlens.llm.substring_dedup import remove_repeats, repeat_digests

    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = {k: " ".join(r.choices(vocabulary, k=r.randrange(50))) + f" {passage} " + " ".join(r.choices(vocabulary, k=r.randrange(50))) for k in range(90)}
    texts |= {100 + k: " ".join(r.choices(vocabulary, k=200)) for k in range(20)} | {200: "ab " * 400, 201: None, 202: ""}
    texts |= {300 + k: texts[100] for k in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"row": F.lit("clash"), "gram": F.lit(1), "repeats": F.lit(2), "start": F.lit(3)})
    want = repeats(texts)
    got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in repeat_digests(docs, subtree=subtree).collect()}
    assert got == {d: (len(WORDS.findall(texts[d] or "")) - len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, w in want.items()}
    out = remove_repeats(docs, subtree=subtree)
    assert out.columns == docs.columns and {x.doc_id: WORDS.findall(x.text or "") for x in out.collect()} == want


# ---- sentencepiece


def test_sentencepiece_reports_differences(spark, monkeypatch):
    from assetlens.llm import sp_agenda

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "more words here")], "doc_id bigint, text string")
    assert sum(x.n_differences for x in sp_agenda.encode_digests(docs, path).collect()) == 0
    e = sp_agenda.PieceEncoder(path)
    monkeypatch.setattr(e, "in_lockstep", lambda words: [b"\x05\x00\x00\x00" for _ in words])
    want = e.library.encode("some words")
    assert np.frombuffer(e.encode(["some words"])[0], "<u4").tolist() == want and e.differences == 2


# ---- vectors


def test_embedding_recall_at_the_threshold(spark):
    from assetlens.llm.embedding_lsh import link_vectors

    r = np.random.default_rng(3)
    rows, pairs = [], []
    for k in range(400):
        a = r.standard_normal(64)
        a /= np.linalg.norm(a)
        b = r.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.9801, 0.985)
        b = c * a + np.sqrt(1 - c * c) * b
        scale = 1e200 if k % 50 == 0 else 1.0
        rows += [(2 * k, [float(x * scale) for x in a], f"l{k % 3}"), (2 * k + 1, [float(x * scale) for x in b], f"l{k % 3}")]
    d = spark.createDataFrame(rows + [(9000, rows[0][1], "l1"), (9001, rows[0][1], None), (9002, rows[0][1], "l0"), (None, rows[0][1], "l0")], "vec_id bigint, embedding array<double>, label string").withColumns({"l": F.lit("clash"), "cid": F.lit(1), "n": F.lit(2), "bucket": F.lit(3)})
    got = {x.vec_id: x for x in link_vectors(d).collect()}
    found = sum(got[2 * k].n_links > 0 and got[2 * k + 1].component_id == 2 * k for k in range(400))
    assert found >= 380, found
    assert got[9000].n_links == got[9001].n_links == 0 and got[9002].component_id == 0 and not got[9002].kept
    assert link_vectors(d.limit(0)).count() == 0


# ---- rules


def plain_rules(rows, measures, bins=24, max_rules=8, max_conditions=3, min_rows=5, precision=0.95):
    """Sequential covering in plain Python. rows: (values by measure, good, grow)."""
    edges = {m: sorted({float(np.quantile([v[m] for v, _, _ in rows], i / bins)) for i in range(1, bins)}) for m in measures}
    left, rules = list(rows), []
    test = lambda v, c: v[c[0]] > c[2] if c[1] else v[c[0]] <= c[2]
    for _ in range(max_rules):
        grow, prune = [x for x in left if x[2]], [x for x in left if not x[2]]
        conditions, best = [], None
        for _ in range(max_conditions):
            here = [x for x in grow if all(test(x[0], c) for c in conditions)]
            found = None
            for m in measures:
                for cut in edges[m]:
                    for above in (True, False):
                        part = [x[1] for x in here if test(x[0], (m, above, cut))]
                        bad, good = part.count(0), part.count(1)
                        if bad >= min_rows:
                            value = (bad + 1) / (bad + good + 2)
                            if found is None or (value * bad**0.1, bad) > found[0]:
                                found = ((value * bad**0.1, bad), (m, above, cut), value, bad / (bad + good))
            if found is None or (best is not None and found[2] <= best):
                break
            conditions.append(found[1])
            best = found[2]
            if found[3] >= 0.999:
                break
        if not conditions or best < precision * 0.9:
            break
        purity = []
        for k in range(1, len(conditions) + 1):
            part = [x[1] for x in prune if all(test(x[0], c) for c in conditions[:k])]
            purity.append((part.count(0) + 1) / (len(part) + 1) if part else 0.0)
        if max(purity) < precision:
            break
        k = next(k for k, v in enumerate(purity) if v >= max(precision, max(purity) - 0.01))
        rules.append(conditions[: k + 1])
        left = [x for x in left if not all(test(x[0], c) for c in rules[-1])]
    return rules


def labelled_texts():
    r = random.Random(12)
    base = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(420):
        words = r.choices(base, k=r.randrange(60, 200))
        kind = i % 5
        if kind == 0:
            words = [w + "###" if k % 2 else w for k, w in enumerate(words)]
        elif kind == 1:
            words = [w.upper() + "!" for w in words]
        rows.append((i, " ".join(words)))
        if i < 360:
            labels.append((i, 0 if kind < 2 else 1, 0))
    return rows, labels


def test_decision_list_against_plain_covering(spark):
    from assetlens.llm import decision_list as dl

    rows, labels = labelled_texts()
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (1, rows[1][1])], "doc_id bigint, text string").withColumns({"words": F.lit("clash"), "_h": F.lit(1), "n_words": F.lit("old")})
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    stats = dl.text_stats(dl.labelled_sample(docs.select("doc_id", "text"), lab))
    sample = [({m: x[m] for m in dl.MEASURES}, x.good, x.grow) for x in stats.withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).collect()]
    assert len(sample) == 360  # the repeated row counts once
    got = dl.learn_rules(stats)
    want = plain_rules(sample, dl.MEASURES)
    assert [[(c.measure, c.above, round(c.cut, 9)) for c in r.conditions] for r in got] == [[(m, a, round(c, 9)) for m, a, c in r] for r in want] and got
    judged = dl.judge(docs, lab).collect()
    assert len(judged) == 423 and dl.judge(docs, lab).columns[:1] == ["doc_id"]
    by_id = {x.doc_id: x for x in judged}
    assert by_id[500].base_failed and not by_id[500].kept
    assert sum(by_id[i].kept == (i % 5 > 1) for i in range(360, 420)) >= 57
    kept = dl.keep_documents(docs, lab)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in judged if x.kept}
    for some in (lab.limit(0), lab.where("quality = 1"), lab.withColumn("quality", F.lit(None).cast("int"))):
        assert dl.learn_rules(dl.text_stats(dl.labelled_sample(docs.select("doc_id", "text"), some))) == []
    assert dl.judge(docs.limit(0), lab).count() == 0
    assert dl.labelled_sample(docs.select("doc_id", "text"), lab, sample=10).count() == 10


def test_samples_are_bounded_in_rows(spark):
    from assetlens.llm import cotrain, decision_list as dl

    many = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert dl.labelled_sample(many.select("doc_id", "text"), lab, sample=10).count() == 10
    assert dl.labelled_sample(many.select("doc_id", F.lit("same").alias("text")), lab, sample=10).count() == 1
    seen, inner = [], cotrain.co_train
    cotrain.co_train = lambda pool, *a, **b: seen.append(len(pool.key)) or inner(pool, *a, **b)
    try:
        assert cotrain.fit(many, lab, sample=10) is None and seen == [10]
    finally:
        cotrain.co_train = inner


def test_cotraining_does_not_depend_on_the_layout(spark):
    from assetlens.llm.cotrain import classify, keep_documents

    rows, labels = labelled_texts()
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"score": F.lit("clash"), "kept": F.lit(1), "_h": F.lit(2)})
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    a = {x.doc_id: x.kept for x in classify(d.repartition(7), lab.repartition(3)).collect()}
    b = {x.doc_id: x.kept for x in classify(d.coalesce(1), lab.coalesce(1)).collect()}
    assert a == b and sum(a[i] == (i % 5 > 1) for i in range(360, 420)) >= 57
    out = keep_documents(d.drop("score", "kept", "_h").withColumn("extra", F.lit(1)), lab)
    assert {x.doc_id for x in out.collect()} == {i for i, k in a.items() if k} and out.columns[-1] == "extra"


# ---- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = labelled_texts()
    r = random.Random(4)
    passage = " ".join(r.choices([f"p{k}" for k in range(99)], k=70))
    good = [t for i, t in rows if i % 5 > 1]
    rows += [(1000, good[0]), (1001, good[0] + " tail"), *[(1002 + k, good[k + 1] + " " + passage) for k in range(6)], (1100, None), (1101, ""), (1102, "few words"), (1103, good[9]), (None, good[10] + " other end")]
    path = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_pipeline_stage_by_stage(spark, folder):
    import corpus_pipeline as cp
    from assetlens.llm import cotrain, decision_list

    docs, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = lambda d: sorted((tuple(x) for x in d.select(*cp.COLUMNS).collect()), key=str)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "packed"]
    outs = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name == "quality_rules":
            want = {x.doc_id for x in decision_list.judge(docs, lab).collect() if x.kept}
            assert rows(out) == sorted((x for x in rows(docs) if x[0] in want), key=str)
        elif name == "quality_classifier":
            want = {x.doc_id for x in cotrain.classify(docs, lab).collect() if x.kept}
            assert rows(out) == sorted((x for x in rows(docs) if x[0] in want), key=str)
        elif name == "near_duplicates":
            texts = {x.doc_id: x.text for x in docs.collect() if x.doc_id is not None}
            group = linked({i: shingles(t, 5) for i, t in texts.items()}, 80)
            assert rows(out) == sorted((x for x in rows(docs) if x[0] is None or group[x[0]] == x[0]), key=str)
            assert 1000 not in {x[0] for x in rows(out)}
        elif name == "repeated_passages":
            texts = {x.doc_id: x.text for x in docs.collect()}
            want = repeats(texts)
            assert {x[0]: WORDS.findall(x[1]) for x in rows(out)} == want and any(len(want[i]) < len(WORDS.findall(texts[i])) for i in want)
            assert all(x[4] == len(x[1]) for x in rows(out))
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            pieces: dict = {}
            for x in sorted(out.collect(), key=lambda x: x.start):
                pieces.setdefault(x.doc_id, []).extend(x.ids)
                assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
            assert pieces == {x[0]: tok.encode(x[1] or "", add_special_tokens=False).ids + [1] for x in rows(docs)}
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = outs[name] = spark.read.parquet(path)
        assert name == "packed" or docs.columns == list(cp.COLUMNS)
    whole = cp.run(spark, folder)
    assert whole.count() == outs["packed"].count() and {x.doc_id for x in whole.select("doc_id").collect()} == {x.doc_id for x in outs["packed"].select("doc_id").collect()}


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_removes_what_it_has_used_up(spark, folder):
    import os

    import corpus_pipeline as cp
    from assetlens.scratch import shared_root

    root = shared_root(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    cp.run(spark, folder)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left <= {"packed", "repeats", "ngram-components"}, left
