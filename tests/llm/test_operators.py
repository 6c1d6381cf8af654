"""Each operator against brute force, the library, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe_codec, chat_format, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, quality_rules, toxicity
from weftline.llm.components import connected_components
from weftline.llm.token_counts import with_token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, id string, h string"


def words(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 200)
    near = base.split()
    near[50] = "changed"
    return [base, base, " ".join(near), None, "", "  \n\t ", "one", "it's <|endoftext|> 12!! é\u3000\x1c", "a" * 3000, words(rng, 9000), "\n".join([words(rng, 8) for _ in range(5)] * 2), *(words(rng, 120) for _ in range(8))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de"][i % 3], ["s1", None, "s2"][i % 3], len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "without an id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(0, 19, 2)] + [(None, 0, None), (3, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_token_counts_and_codec(docs, texts):
    lib = Tokenizer.from_file(BPE)
    counts = {r.doc_id: r for r in with_token_counts(docs, BPE).collect()}
    out = bpe_codec.encode(docs, BPE, decoded=True).cache()
    for r in out.collect():
        if r.doc_id is None:
            continue
        t = texts[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) == t
        assert counts[r.doc_id].n_tokens == len(ids) and counts[r.doc_id].n_bytes == len(t.encode())
    assert {r.doc_id: r.text for r in bpe_codec.decode(out, BPE).collect()}[7] == texts[7]
    assert with_token_counts(docs.limit(0), BPE).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c", "d"]), rng.randint(0, 90)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.plan(df, ["doc_id"]).collect()
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, capped = 1.5 * sum(total.values()), set()
    while True:
        level = (goal - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in out:
        want = 2 * total[r.source] if r.source in capped else level * weight[r.source]
        assert math.isclose(r.target, want, rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.plan(df.repartition(7), ["doc_id"]).collect())) if None not in order else True
    assert mixing.plan(df.limit(0), ["doc_id"]).count() == 0


def test_mix_takes_texts(docs):
    sized = docs.where("doc_id is not null").select("doc_id", "text", "source", "n_chars")
    out = mixing.mix(sized).collect()
    n = Counter()
    for r in out:
        n[r.source] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text or "")
    plan = mixing.plan(sized.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size")), ["doc_id"]).collect()
    assert all(abs(n[r.source] - r.target) <= 1 for r in plan)


def brute_features(t):
    w = (t or "").encode().split()
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if win[x] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, labels, texts):
    for t in [*texts, "a b c a b c a b", "x x x x x", "a|b\n\na|b\n #"]:
        assert quality_rules.base_features(t) == brute_features(t)
    out = quality_rules.judge(docs, labels).collect()
    assert len(out) == docs.count() and not any(r.kept for r in out if r.n_words < 50)
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    for k, n in ((0, 300), (2, 500), (5, 100)):
        exact = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
        assert quality_rules.upper_bound_holds(k, n, 0.02, 0.05) == (exact <= 0.05)


def test_quality_rejects_what_labels_allow(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 80) if i % 5 else " ".join(w + "###" for w in words(rng, 80).split()), "en") for i in range(3000)]
    lab = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(3000)], "doc_id long, quality int")
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lab).collect()
    assert all(r.kept == (r.doc_id % 5 > 0) for r in out)


def test_cutoffs_match_brute_force(spark):
    rng = random.Random(17)
    rows, marks = [], []
    for i in range(4000):
        w, lang, good = words(rng, 70).split(), rng.choice(["en", "en", "en", "de", "rare"]) if i % 400 else "few", int(rng.random() < 0.7)
        junk = rng.random() * (0.25 if good and rng.random() < 0.05 else 0 if good else 0.4)
        w = [x + "#" * 3 if rng.random() < junk else x for x in w]
        lines = ["the same line here"] * int(junk * 20) + [" ".join(w)]
        rows.append((i, "\n".join(lines), lang))
        marks.append((i, good))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")
    feats = {i: brute_features(t) for i, t, _ in rows}
    share = lambda f: (f[2] / f[1] if f[1] else 0, f[4] / f[3] if f[3] else 0, f[5] / f[0] if f[0] else 0)
    base = {i: f[0] < 50 or 100 * f[5] > 50 * f[0] for i, f in feats.items()}
    h = {r.doc_id: r.u for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1000)).alias("u")).collect()}
    good = dict(marks)
    grids = list(quality_rules.RULES.values())
    rejects = lambda i, p: any(p[r] and share(feats[i])[r] > grids[r][p[r] - 1] for r in range(3))
    path, at = [], (0, 0, 0)
    explore = [i for i in h if h[i] < 300 and not base[i]]
    while at != tuple(map(len, grids)):
        best = None
        for r in range(3):
            if at[r] < len(grids[r]):
                p = tuple(x + (k == r) for k, x in enumerate(at))
                new = [i for i in explore if rejects(i, p) and not rejects(i, at)]
                gain = (sum(not good[i] for i in new) + 0.5) / (sum(good[i] for i in new) + 0.5)
                if best is None or gain > best[0]:
                    best = (gain, p)
        at = best[1]
        path.append(at)
    strata = {s: [i for i, _, x in rows if x == s and h[i] >= 300 and good[i] and not base[i]] for s in ("en", "de", "rare", "few")}
    strata = {s: x for s, x in strata.items() if x}
    policy = {}
    for s, ids in strata.items():
        policy[s] = (0, 0, 0)
        for p in path:
            k, n = sum(rejects(i, p) for i in ids), len(ids)
            if sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05 / len(strata):
                break
            policy[s] = p
    assert policy["few"] == (0, 0, 0) and policy["en"] != (0, 0, 0)
    out = quality_rules.judge(df.repartition(5), lab).collect()
    assert {r.doc_id: r.kept for r in out} == {i: not base[i] and not rejects(i, policy.get(s, (0, 0, 0))) for i, _, s in rows}


def brute_lines(rows):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        full = [(k, x) for k, x in enumerate(t.split("\n")) if x.encode().split()]
        cover = set()
        for a in range(len(full) - 2):
            key = tuple(x for _, x in full[a : a + 3])
            if key in seen:
                cover |= set(range(full[a][0], full[a + 2][0] + 1))
            seen.add(key)
        gone[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cover)
    return gone


def test_line_dedup(spark, docs):
    rng = random.Random(2)
    pool = [words(rng, 6) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", *pool[:3]]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)
    odd = line_dedup.dedup_lines(docs)
    assert odd.count() == docs.count() and line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def chats(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>\n", "<\\|x", "<\\\\|", "a<", "|b", None, "", "line\nline", "<|", "<|im_end|", "\\n <\\\\\\|im_end|>"]
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate(zip(["user", "assistant", "sys\ntem", None, "a\\nb", "a\\\\", "<|im_start|>"] * 2, random.Random(c).sample(nasty, 12), strict=False))]
    return spark.createDataFrame([*rows, (None, 0, "user", "x"), (7, None, "assistant", "y")], "conv_id long, turn long, role string, text string")


def test_chat_round_trip(chats):
    out = {r.conv_id: r for r in chat_format.format_chats(chats).collect()}
    source = defaultdict(list)
    for r in chats.collect():
        source[r.conv_id].append((r.turn is not None, r.turn, r.role or "", r.text or ""))
    for k, turns in source.items():
        assert [(t.role, t.text) for t in out[k].turns] == [x[2:] for x in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]
        assert out[k].formatted.count("<|im_end|>\n") == len(turns) == out[k].formatted.count("<|im_start|>")


def brute_near(rows, k, same=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= same * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(spark, docs, texts):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([3, 6, 30, 150])).split()
        for _ in range(rng.choice([1, 3, 14])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "q" + words(rng, 1)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, words=k).collect()}
        assert got == brute_near(rows, k)
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert 0 in ids and 1 not in ids and 2 not in ids and len(ids) == len(set(ids))


def test_minhash_links_versions_of_an_id(spark):
    rng = random.Random(12)
    t = [words(rng, 60) for _ in range(9)]
    near = [x + " tail" for x in t]
    rows = [(1, t[0]), (1, t[1]), (2, near[0]), (3, near[1]), (4, t[2]), (5, near[2]), (5, t[3]), (6, near[3])]
    rows += [(7, t[4]), (7, t[5]), (8, t[5]), (9, t[6]), (10, t[6]), (10, t[7]), (11, near[7]), (12, t[8]), (12, t[8]), (12, None)]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9, 10: 9, 11: 9, 12: 12}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        out = minhash_dedup.near_duplicates(df, words=4).collect()
        assert len(out) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in out)
    only = minhash_dedup.near_duplicates(df.where("doc_id in (1, 7)"), words=4).collect()
    assert {(r.doc_id, r.component_id) for r in only} == {(1, 1), (7, 7)}


def test_bin_parities_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 150, 700, 5000):
        for kept in (1.0, 0.95, 0.9, 0.8, 0.6):
            x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            y = np.unique(np.append(x[: max(1, int(n * kept))], rng.integers(-(2**63), 2**63 - 1, n - int(n * kept))))
            a, b = (np.array(minhash_dedup.bin_parities(v)).view(np.uint64) for v in (x, y))
            odd = sum(int(v).bit_count() for v in a ^ b)
            both = len(np.intersect1d(x, y))
            assert odd <= len(x) + len(y) - 2 * both
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert 180 * odd <= 20 * (len(x) + len(y))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.2
    x[100:120] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (None, [1.0] * 16)]
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None, :], 10**6).min(1))
    assert all(out[i].n_links == link[i].sum() and out[i].component_id == comp[i] for i in range(len(u)))
    assert all(out[i].n_links == 0 and out[i].kept for i in (900, 901, 902, 903, 904, None))


def test_embeddings_of_repeated_ids_and_by_graphs(spark, monkeypatch):
    e = lambda *v: [float(x) for x in v]
    rows = [(1, e(1, 0, 0)), (1, e(0, 1, 0)), (2, e(1, 0.01, 0)), (3, e(0.01, 1, 0)), (4, e(0, 0, 2)), (4, e(0, 0, 2)), (5, e(1, 1, 1))]
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), shards=2).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == Counter({(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1, (4, 1, 4, True): 2, (5, 0, 5, True): 1})
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    # two shards large enough for a graph's beam in each: every link of whole tables, recall against a scan
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[1000:] = x[rng.integers(0, 1000, 500)] + rng.normal(size=(500, 24)) * 0.12
    u = embedding_dedup._unit(x)
    a, b = np.arange(0, 1500, 2), np.arange(1, 1500, 2)
    monkeypatch.setattr(embedding_dedup, "WORTH", 2)
    pack = lambda who: embedding_dedup._build(embedding_dedup.pd.DataFrame({"node": who, "dim": 24, "shard": 0, "many": 1, "embedding": list(x[who])}))
    pa_, pb = pack(a), pack(b)
    truth = (u[a] @ u[b].T >= 0.95).sum()
    out = embedding_dedup.link_pair(pa_.vectors[0], pb.vectors[0], pb.links[0], False, 0.95)
    assert truth > 50 and out.links.sum() >= 2 * 0.99 * truth and embedding_dedup.Graph.load(pb.links[0], u[b]).links


def test_embedding_links_are_found_where_they_are_rare(monkeypatch):
    # 2,000 nodes, half of them cut off from the graph's entry; one link, to a node that is cut off and no query of the sample has
    rng = np.random.default_rng(11)
    x = embedding_dedup._unit(rng.normal(size=(2000, 32)))
    q = embedding_dedup._unit(rng.normal(size=(500, 32)))
    q[101] = embedding_dedup._unit((x[1500] + 0.03 * rng.normal(size=32))[None])[0]
    assert q[101] @ x[1500] >= 0.95 and (q @ x.T >= 0.95).sum() == 1
    g, cut, whole = embedding_dedup.Graph.build(x[:1000]), embedding_dedup.Graph(x), embedding_dedup.Graph.build(x)
    cut.links, cut.rows = g.links, [np.append(r, np.full(1000, 0 if k == 0 else -1, np.int32)) for k, r in enumerate(g.rows)]
    for worth in (embedding_dedup.WORTH, 4):  # a scan from the start; beams as far as they pass the audit
        monkeypatch.setattr(embedding_dedup, "WORTH", worth)
        for graph in (cut, whole):
            found = [(a, b) for i, j in embedding_dedup.candidates(graph, q.astype(np.float32), 0.95) for a, b in zip(i, j, strict=True)]
            assert found == [(101, 1500)]
    assert not embedding_dedup._finds_planted(cut, 96, 0.95) and embedding_dedup._finds_planted(whole, 384, 0.95)



def test_embedding_links_do_not_depend_on_the_size(monkeypatch):
    # the graph has lost its ways to one node, which no link that the gauge plants would tell
    rng = np.random.default_rng(12)
    n = 2500
    x = embedding_dedup._unit(rng.normal(size=(n, 16)))
    q = embedding_dedup._unit(rng.normal(size=(400, 16)))
    drawn = []
    for ef in (24, 96, 384):
        draw = np.random.default_rng(ef)
        for _ in range(0, embedding_dedup.PLANTED, 256):
            drawn.append(draw.integers(0, n, 256))
            draw.normal(size=(256, 16))
    lost = np.setdiff1d(np.arange(1, n), np.concatenate(drawn))[0]
    q[101] = embedding_dedup._unit((x[lost] + 0.03 * rng.normal(size=16))[None])[0]
    q[202:206] = embedding_dedup._unit(x[[5, 5, 700, 800]] + 0.03 * rng.normal(size=(4, 16)))
    g = embedding_dedup.Graph.build(x)
    for links in g.links:
        links[links == lost] = -1
    truth = {(a, b) for a, b in zip(*np.nonzero(q @ x.T >= 0.95), strict=True)}
    assert (101, lost) in truth and len(truth) >= 5
    searched, search = [], embedding_dedup.Graph.search
    monkeypatch.setattr(embedding_dedup.Graph, "search", lambda g, q, ef: searched.append(len(q)) or search(g, q, ef))
    for worth in (embedding_dedup.WORTH, 4):
        monkeypatch.setattr(embedding_dedup, "WORTH", worth)
        searched.clear()
        found = [(a, b) for i, j in embedding_dedup.candidates(g, q.astype(np.float32), 0.95) for a, b in zip(i, j, strict=True)]
        assert sorted(found) == sorted(truth) and sum(searched) >= len(q)
    # a shard of any size has a graph, and beams alone find most links
    rows_of = lambda v: embedding_dedup.pd.DataFrame({"node": np.arange(len(v)), "dim": 16, "shard": 0, "many": 1, "embedding": list(v)})
    g = embedding_dedup.Graph.load(embedding_dedup._build(rows_of(x)).links[0], x)
    assert g.links and (search(g, q.astype(np.float32), embedding_dedup.BEAM)[1] >= 0.95).sum() >= 0.9 * len(truth)
    for n in (1, 2, 3):
        assert embedding_dedup.Graph.load(embedding_dedup._build(rows_of(x[:n])).links[0], x[:n]).links


def test_language(spark, docs):
    rng = random.Random(9)
    stems = {"aa": ["kor", "lim", "sta"], "bb": ["ñue", "za", "dor"], "cc": ["öch", "ung", "ßei"]}
    make = lambda x, n: " ".join("".join(rng.choice(stems[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(x := rng.choice(list(stems)), 40), x) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 > 0"))
    out = language_id.predict(df, model, ["doc_id", "lang"]).where("doc_id % 3 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    tagger = language_id.Tagger(model)
    long = make("aa", 300) + " " + make("bb", 100)
    share = dict(zip(model["langs"], tagger.shares([long])[0], strict=True))
    assert 0.6 < share["aa"] < 0.9 and share["bb"] > 0.1
    # blocks give what one pass over the whole sequence gives
    w = long.lower().split()
    e = np.array([model["weights"][language_id._padded([language_id.bare(x)], model["lexicon"], len(model["weights"]) - 1)][0].sum(0) for x in w], float)
    m, _ = language_id._forward_backward(e[None], model["trans"], np.ones((1, len(w)), bool))
    assert np.allclose(m[0].mean(0), tagger.shares([long])[0], atol=1e-5)
    odd = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert odd[3] == odd[4] == odd[5] == "und"
    assert language_id.predict(docs, language_id.fit(df.limit(0)), ["doc_id"]).where("lang_pred = 'und'").count() == docs.count()


def test_marginals_match_all_label_paths(monkeypatch):
    import itertools

    rng = np.random.default_rng(4)
    langs = ["a", "b", "c"]
    model = {"langs": langs, "weights": rng.normal(size=(language_id.FEATURES + 4, 3)).astype(np.float32), "trans": rng.normal(size=(3, 3)), "lexicon": {"kor": 1}}
    model["weights"][-1] = 0
    words_ = "kor, ñue! lim 12 kor za".split()
    e = language_id.emissions([language_id.bare(w) for w in words_], model).astype(float)
    m = np.zeros((len(words_), 3))
    for path in itertools.product(range(3), repeat=len(words_)):
        w = math.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(model["trans"][a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            m[i, y] += w
    m /= m.sum(1, keepdims=True)
    real = [bool(language_id.bare(w)) for w in words_]
    want = m[real].mean(0)
    assert np.allclose(language_id.Tagger(model).shares([" ".join(words_)])[0], want, atol=1e-5)
    monkeypatch.setattr(language_id, "BLOCK", 2)
    assert np.allclose(language_id.Tagger(model).shares([" ".join(words_)])[0], want, atol=1e-5)
    monkeypatch.setattr(language_id, "SLAB", 3)  # slabs of blocks
    assert np.allclose(language_id.Tagger(model).shares(["", " ".join(words_), None, "kor"])[1], want, atol=1e-5)


def test_language_of_scripts_without_blanks_and_of_many_languages(spark):
    rng = random.Random(2)
    zh = ["".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(120)) for _ in range(40)]
    th = ["".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(90)) for _ in range(40)]
    rows = [(i, t, x) for i, (t, x) in enumerate([*((t, "zh") for t in zh), *((t, "th") for t in th), *((words(rng, 30), "en") for _ in range(40))])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 2 = 0"))
    assert model["langs"] == ["en", "th", "zh"]
    out = language_id.predict(df.withColumn("lang_pred", F.lit("x")), model, ["doc_id", "lang", "lang_pred"])
    assert out.columns == ["doc_id", "lang", "lang_pred", "score"] and out.where("lang = lang_pred").count() >= 118
    big = words(rng, 10) + " " + "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(3_300_000))  # 10 MB, one run
    tagger = language_id.Tagger(model)
    assert model["langs"][tagger.shares([big])[0].argmax()] == "zh"
    many = [(f"l{k:02d}", [f"x{chr(97 + k % 26)}{chr(97 + k // 26)}{j}q" for j in range(16)]) for k in range(60) for _ in range(6)]
    m = language_id.train(many)
    assert len(m["langs"]) == 60 and sum(m["langs"][language_id.Tagger(m).shares([" ".join(w)])[0].argmax()] == x for x, w in many[::6]) >= 55
    assert set("".join(language_id.units("ab" * 40))) == {"a", "b"} and "".join(language_id.units("abc" * 40)) == "abc" * 40


def test_toxicity(spark, docs, labels):
    rng = random.Random(10)
    bad = ["vilex", "grumbo", "nastor", "zzork"]
    rows, marks = [], []
    for i in range(1200):
        w, toxic = words(rng, 60).split(), i % 6 == 0
        if toxic:
            for b in rng.sample(bad, rng.randint(1, 3)):
                w.insert(rng.randrange(60), b)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(df.where("doc_id % 4 > 0"), lab)
    out = toxicity.score(df, model, ["doc_id"]).where("doc_id % 4 = 0").collect()
    right = sum((r.score >= 0.7) == (r.doc_id % 6 == 0) for r in out)
    assert right >= 0.98 * len(out)
    assert toxicity.score(docs, model, ["doc_id"]).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(docs.withColumn("score", F.lit(7)), model, ["doc_id", "score"]).columns == ["doc_id", "score"]
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels), ["doc_id"]).count() == docs.count()


def test_label_model_against_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.2
    votes = np.zeros((3000, 4), int)
    votes[:, 0] = np.where(rng.random(3000) < np.where(y, 0.7, 0.03), 1, 0)
    votes[:, 1] = np.where(rng.random(3000) < 0.9, votes[:, 0], 0)  # repeats voter 0
    votes[:, 2] = np.where(rng.random(3000) < np.where(y, 0.6, 0.02), 1, 0)
    votes[:, 3] = -(votes == 0).all(1).astype(int)
    m = toxicity.LabelModel(0.2, (3,))
    p = m.fit(votes)
    assert {frozenset((j, int(i))) for j, i in enumerate(m.parent) if i >= 0} >= {frozenset((0, 1))}  # the correlation is seen
    assert np.allclose(np.exp(m.tables).sum(-1), 1)
    every = np.array(list(itertools.product((-1, 0, 1), repeat=4)))
    for v, post in zip(every, m.posterior(every), strict=True):  # the chain rule over the votes cast, written out
        odds = m.prior / (1 - m.prior)
        for j, i in enumerate(m.parent):
            a, b = (math.exp(m.tables[c, j, v[i] + 1 if i >= 0 else 1, v[j] + 1]) for c in (0, 1))
            odds *= max(b / a, 1) if v[j] > 0 else min(b / a, 1) if v[j] < 0 else 1
        assert math.isclose(post, odds / (1 + odds), rel_tol=1e-6)
    assert ((p > 0.5) == y).mean() > 0.92 and abs(p.mean() - 0.2) < 0.05
    # tables are shares of weighted rows, counted one by one
    w, i = np.array([0.25, 0.5, 1.0, 0.0]), 1
    few = np.array([[1, 1, 0, 0], [1, 0, 0, -1], [0, 1, 1, 0], [0, 0, 0, 0]])
    m.parent = np.array([-1, 0, 0, -1])
    m.update(few, w, smooth=0.5)
    for c, weight in ((0, 1 - w), (1, w)):
        for up in (-1, 0, 1):
            n = [0.5 + sum(x for x, v in zip(weight, few, strict=True) if v[0] == up and v[i] == val) for val in (-1, 0, 1)]
            assert np.allclose(np.exp(m.tables[c, i, up + 1]), np.array(n) / sum(n))
    # the mutual information behind the tree, against a loop over values
    w = np.where(y, 1.0, 0.0)
    alone = toxicity.LabelModel(0.2, (3,))
    tree = alone.tree(votes, w)
    assert tree[3] == -1 and 3 not in tree and sorted(tree[:3])[0] == -1
    info = lambda a, b: sum(
        q * math.log(q / ((votes[y == c, a] == s).mean() * (votes[y == c, b] == t).mean())) * (y == c).mean()
        for c in (0, 1) for s in (-1, 0, 1) for t in (-1, 0, 1) if (q := ((votes[y == c, a] == s) & (votes[y == c, b] == t)).mean()) > 0
    )
    pairs = sorted(((info(a, b), a, b) for a, b in ((0, 1), (0, 2), (1, 2))), reverse=True)[:2]
    assert {frozenset((j, int(k))) for j, k in enumerate(tree) if k >= 0} == {frozenset(x[1:]) for x in pairs}


def test_toxic_patterns():
    assert "d:vilex" in toxicity.forms("v1l3x!") and "s:vilex" in toxicity.forms("vileeex") and toxicity.forms("...") == []
    words_ = {"w:vilex": 1.0, "c:calm": -1.0}
    assert toxicity.voted(["w:vilex", "d:vilex", "d:other", "r:vilex", "p:shout"], words_) == ["w:vilex", "p:disguise", "p:repeat", "p:shout"]
    assert toxicity._features("AAAA BBBB CCCC dd") >= {"p:shout", "w:dd"} and "r:dd" in toxicity._features("dd x dd")
    votes = toxicity.ballots([[0], [1], [2, 0], []], ["w:vilex", "c:calm", "p:disguise"])
    assert votes.tolist() == [[1, 0, 0, 0], [0, 0, -1, -1], [1, 1, 0, 0], [0, 0, 0, -1]]


def test_digests(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    r = chat_format.digests(chat_format.format_chats(rows)).first()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest() and r.loss_sha256 == hashlib.sha256(b"yo").hexdigest() and r.loss_chars == 2
