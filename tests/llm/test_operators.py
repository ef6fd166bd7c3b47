"""The training-data operators against plain versions, on small fixtures with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts() -> list:
    r = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    out = [None, "", " \t\n", "one", "one two", "Éa  b\n\nc </s> [INST] <|im_end|>", "x" * 3000, "ab " * 400]
    seeds = [" ".join(r.choices(base, k=n)) for n in (30, 60, 90, 150, 400)]
    for s in seeds:
        out += [s, s, s.upper(), s + " tail", s.replace("w1 ", "w2 ", 1)]
    passage = " ".join(r.choices(base, k=50))
    out += [" ".join(r.choices(base, k=20)) + " " + passage + " " + " ".join(r.choices(base, k=20)) for _ in range(6)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("rule", F.lit("clash")).withColumn("hash", F.lit(1))


def components_of(sets: dict, percent: int) -> dict:
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, n, percent):
    from assetlens.llm.ngram_join import jaccard_components

    sets = {}
    for d, t in enumerate(texts()):
        w = WORDS.findall((t or "").translate(ASCII))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    want = components_of(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    assert jaccard_components(docs.limit(0), n, percent).count() == 0


@pytest.mark.parametrize("subtree", [50_000, 2])
def test_substring_dedup(docs, subtree):
    from assetlens.llm.substring_dedup import remove_repeats, repeat_digests

    split = {d: WORDS.findall(t or "") for d, t in enumerate(texts())}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    want = {}
    for d, w in split.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        kept = [x for x, k in zip(w, keep) if k]
        want[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in repeat_digests(docs, subtree=subtree).collect()}
    assert got == want
    out = remove_repeats(docs, subtree=subtree)
    assert out.columns == docs.columns and {r.doc_id: len(WORDS.findall(r.text or "")) for r in out.collect()} == {d: v[0] - v[1] for d, v in want.items()}


def test_sentencepiece(docs):
    import sentencepiece

    from assetlens.llm.sp_agenda import PieceEncoder, decode_ids, encode_digests, encode_ids

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {d: sp.encode(t or "", add_bos=True, add_eos=True) for d, t in enumerate(texts())}
    ids = encode_ids(docs, path)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: r.text for r in decode_ids(ids, path).collect()} == {d: sp.decode(v) for d, v in want.items()}
    for r in encode_digests(docs, path).collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
    alone = PieceEncoder(path, check=False)
    r = random.Random(3)
    odd = ["".join(r.choices("ab thein  ▁éñ日本\n\t😀<s>.,#", k=r.randrange(1, 90))) for _ in range(400)]
    for t, x in zip(odd, alone.encode(odd)):
        assert np.frombuffer(x, "<u4").tolist() == sp.encode(t)
        assert alone.by_heap("▁" + t.replace(" ", "▁")) == x


def test_packing(docs):
    from tokenizers import Tokenizer

    from assetlens.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in enumerate(texts())}
    rows = pack(docs.coalesce(1), path, with_ids=True).collect()
    at, pieces = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, parts in pieces.items():
        assert [x for r in sorted(parts, key=lambda r: r.start) for x in r.ids] == want[d]
    assert max(at.values()) <= 2048 and set(pieces) == set(want)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in at.values())
    assert padding <= 0.05 * sum(at.values()) + 64
    assert pack(docs.limit(0), path).count() == 0


def test_best_cuts_is_optimal():
    from assetlens.llm.packing import best_cuts

    r = random.Random(1)
    for _ in range(60):
        places = np.cumsum([0] + [r.randrange(1, 9) for _ in range(12)])
        costs = np.array([0.0] + [r.choice([0.0, 1.0, 3.0]) for _ in range(12)])
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        f = [0.0]
        for i in range(1, len(places)):
            f.append(costs[i] + min(f[j] + pad(places[i] - places[j]) for j in range(i) if places[i] - places[j] <= 16))
        cuts = best_cuts(places, costs, 16)
        cost = {p: c for p, c in zip(places.tolist(), costs)}
        assert sum(cost[b] + pad(b - a) for a, b in zip(cuts, cuts[1:])) == pytest.approx(f[-1])


def test_warc_index(spark, tmp_path):
    from assetlens.llm.warc_index import LoserTree, capture_index, read_archives

    rows = [(1, "http://b.org/x", "<p>é" + "a" * 200), (2, "http://a.org/", "<p>é" + "a" * 200), (3, None, None), (4, "http://a.org/", "short"), (5, "http://c.org/\r\nX: y", "short"), (6, "HTTP://A.org/?q#f", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = capture_index(pages, f"file://{tmp_path}/w").collect()
    for r in out:
        html = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id == 2 else ("response", None))
    assert sorted(r.page_id for r in out) == [1, 2, 3, 4, 5, 6]
    assert read_archives(spark, f"file://{tmp_path}/w").count() == 6
    lists = [sorted(random.Random(k).choices(range(9), k=k)) for k in range(6)]
    assert [lists[a][b] for a, b in LoserTree(lists)] == sorted(x for v in lists for x in v)
    assert capture_index(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_urls(spark):
    from assetlens.llm.url_templates import judge_urls

    rows = [(1, "http://a.com/en/1"), (2, "https://example.com/en/1?x"), (3, "http://www.example.com/en/"), (4, "http://x.net/es/1"), (5, "http://x.net/fr#t"), (6, None), (7, "nothing"), (8, "HTTP://X.Org"), (9, "http://notexample.com/en/"), (10, "http://m.example.com/en/2")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[1] == ("a.com", "/en/1", "com/", "allow") and got[2] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("net/es/", "block") and got[5][:3] == ("x.net", "/fr", None)
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("x.org", "") and got[9][2] == "com/" and got[10][2] == "example.com/en/"


def test_text_stats(docs):
    from assetlens.llm.decision_list import _places_by_sorting, text_stats

    got = {r.doc_id: r for r in text_stats(docs).collect()}
    for d, t in enumerate(texts()):
        t = t or ""
        w = WORDS.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        hit = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
    spark = docs.sparkSession
    a = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (5, 1, 5, 2, 1, 9)]).alias("g"))
    assert a.select(_places_by_sorting("g")).first()[0] == [0, 1, 2, 4]


def test_chat(spark):
    from assetlens.llm.chat_windows import format_windows, read_back

    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (2, 0, "system", "be &lt; kind"), (3, 0, "user", None), (3, 1, "assistant", None)]
    rows += [(2, k, "user" if k % 2 else "assistant", f"<|im_end|>\n t{k} " + "w " * (k * 7 % 50)) for k in range(1, 40)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=120)
    for r in read_back(windows).collect():
        mine = sorted(x for x in rows if x[0] == r.conv_id)
        turns = "".join(f"{x[2]}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = [r for r in windows.collect() if r.conv_id == 2]
    assert len(many) > 3 and all(r.n_tokens <= 120 and "be &amp;lt; kind" in r.formatted for r in many)


def test_embeddings(spark):
    from assetlens.llm.embedding_lsh import link_vectors

    r = np.random.default_rng(0)
    v = r.standard_normal((60, 16))
    v[10:20] = v[0] + 0.02 * r.standard_normal((10, 16))
    v[20:25] = v[1]
    rows = [(i, [float(y) for y in x], i % 2 if i > 30 else 0) for i, x in enumerate(v)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, rows[0][1], None), (104, rows[0][1], 1), (105, [1.0, None], 0)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=4).collect()}
    good = [x for x in rows if x[0] < 100 or x[0] == 104]
    u = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in good}
    near = {i: [j for j, _, m in good if j != i and m == lab and u[i] @ u[j] >= 0.98] for i, _, lab in good}
    assert {i: got[i][0] for i in near} == {i: len(n) for i, n in near.items()}
    assert got[15][1] == 0 and got[24][1] == 1 and all(got[i] == (0, i, True) for i in (100, 101, 102, 103, 105))


def test_cotraining(spark, docs):
    from assetlens.llm.cotrain import classify

    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = " ".join(r.choices([f"w{k}" + "abcdefghij"[k % 10] for k in range(60)], k=40)) + (" awful" if bad else "")
        rows.append((i, t, "en", "s", len(t)))
        if i < 300:
            labels.append((i, 0 if bad else 1, 0))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x.kept for x in classify(d, lab).collect()}
    right = sum(got[i] == (i % 4 != 0) for i in range(300, 400))
    assert right >= 95
    assert all(x.kept for x in classify(docs, lab.limit(0)).collect())


def test_cotraining_uses_every_unlabelled_document_and_only_labels_with_one(spark, monkeypatch):
    from assetlens.llm import cotrain

    r = random.Random(5)
    words = [f"w{k}" + "abcdefghij"[k % 10] for k in range(60)]
    rows = []
    for i in range(3000):
        bad, new = i % 2 == 0, i >= 2960  # labelled, then unlabelled of unknown source, then a few whose source tells that they are bad
        t = " ".join(r.choices(words, k=30)) + (" zeta" if new else (" awful" if bad else " fine") if i < 120 else "")
        rows.append((i, t, "en", ("bad" if bad or new else "good") if i < 120 or new else "other", 200))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = [(i, i % 2, 0) for i in range(120)] + [(-i, i % 2, 0) for i in range(1, 4000)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    seen, inner = [], cotrain.co_train
    monkeypatch.setattr(cotrain, "co_train", lambda *a, **b: seen.append(a) or inner(*a, **b))
    model = cotrain.fit(d, lab, sample=120, confidence=0.9, added=0.25)
    assert [int((x >= 0).sum()) for a in seen for x in a if isinstance(x, np.ndarray)] == [120]
    zeta = cotrain.text_features([b"zeta"])[1][0]
    assert model.text[zeta] < -0.01


def test_components(spark):
    from assetlens.llm._components import components

    edges = [(k, k + 1) for k in range(50)] + [(200, k) for k in range(201, 260)] + [(7, None), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 200 for k in range(200, 260)}
