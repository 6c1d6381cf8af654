import random
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_features, brute_lines, brute_near, words
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute_mix(spark, rows):
    """Rows (id, text, source) as often as the mix takes them, from the same random keys."""
    df = spark.createDataFrame(rows, "id long, text string, source string")
    h = F.xxhash64("text", "source")
    key = F.xxhash64(F.lit(mixing.SEED), F.coalesce(F.col("id").cast("string"), F.lit("")), h, F.coalesce("source", F.lit("")))
    of = {(r.id, r.text, r.source): r.key for r in df.select("*", key.alias("key")).collect()}
    size = lambda t: len((t or "").encode().split())
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight, capped = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, set()
    goal = 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (goal - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in order:
        budget = round(2 * total[s] if s in capped else level * weight[s])
        epochs, begin = budget // total[s] if total[s] else 0, 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: of[r]):
            n = size(r[1])
            rest = max(0, min(n, budget - epochs * total[s] - begin))
            out += [r[0:2]] * epochs * bool(n)
            if rest:
                at, seen = 0, 0
                for part in r[1].encode().split():
                    at = r[1].encode().index(part, at) + len(part)
                    seen += 1
                    if seen == rest:
                        break
                out.append((r[0], r[1] if rest == n else r[1].encode()[:at].decode()))
            begin += n
    return out


def test_run_matches_plain_python(spark, tmp_path):
    rng = random.Random(31)
    shared = [words(rng, 7) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randint(5, 12)) for _ in range(rng.randint(2, 12))]
        if i % 3 == 0:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines), ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], 7))
    rows += [(60 + i, rows[i][1] + " tail", "en", "c", 7) for i in range(0, 20, 2)] + [(80, rows[5][1], "en", "a", 7), (81, None, "en", "a", 0), (82, "", "en", None, 0), (83, "x y " * 60, "de", "b", 0)]
    one_line = [words(rng, 90) for _ in range(5)]
    rows += [(90 + 10 * k + i, t + " end" * k, "de", "b", 7) for k in range(3) for i, t in enumerate(one_line)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for r in rows:
        f = brute_features(r[1])
        if f[0] >= 50 and 100 * f[5] <= 50 * f[0]:
            kept.append(r)
    text = brute_lines([(r[0], r[1]) for r in kept])
    near = brute_near(list(text.items()), 5)
    single = [(r[0], text[r[0]], r[3]) for r in kept if near[r[0]][1] == r[0]]
    assert 0 < len(single) < len(kept) < len(rows)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(lib.encode(t, add_special_tokens=False).ids)) for i, t in brute_mix(spark, single))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_on_odd_tables(spark):
    d = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "a b", "xx", None, 3), (1, "a b", "xx", None, 3), (None, "word " * 60, None, "s", 300)], SCHEMA)
    for docs, least in ((odd, 0), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            n = out.count()
            assert n >= least and (docs is odd or n == 0), name
            assert name == "bpe codec" or out.columns == docs.columns
    n = defaultdict(int)
    for r in corpus_pipeline.lines(spark, odd, d).collect():
        n[r.doc_id] += 1
    assert n == {None: 2, 1: 3}
