"""Small cases with brute force beside the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import classlm, components, langid, minhash, mixing, packing, quality, sharding, shared, suffixes, urls, vectors

DOCS = "doc_id long, text string, source string, lang string, k1 string, band string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, "x", "y") for i, t, s, lang in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties and one long text."""
    base = prose(1, 120)
    return docs(spark, [(1, base, "a", "en"), (1, base, "a", "en"), (2, base, None, None), (3, None, "a", "en"), (4, "", "b", "de"), (5, " \n\t", "b", None),
                        (6, base + " tail", "c", "de"), (7, prose(2, 3000), "c", "de"), (None, "null id", None, None)])


def test_operators_take_odd_rows_and_empty_tables(spark, odd):
    for table in (odd, odd.where("false")):
        n = table.count()
        assert quality.judge(table).count() == n
        assert minhash.near_duplicates(table).count() == n
        assert langid.identify(table).count() == n
        assert classlm.score_texts(table, F.lit(True), classlm.ClassModel(clustered=50, classes=4)).count() == n
        assert sharding.shuffled_shards(table, 3).count() == n
        assert suffixes.drop_repeats(table).columns == table.columns
        sized = table.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(packing.WORD)), F.lit(0)).cast("long"))
        assert mixing.mix(sized, mixing.cycle_weights).count() == n
        assert packing.pack(table).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_minhash_against_brute_force(spark):
    rng, texts = random.Random(4), {}
    for group in range(3):
        base = prose(50 + group, 80).split()
        for copy in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(80)] = "x" + str(rng.randrange(999))
            texts[group * 8 + copy] = " ".join(words)
    sets = {i: {tuple(w[j:j + 2]) for j in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in texts.items())}
    low = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    got = minhash.near_duplicates(docs(spark, [(i, t, "s", "en") for i, t in texts.items()]), minhash.NearDup(shingle=2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == low


def test_suffixes_find_a_shared_passage(spark):
    shared = prose(9, 60)
    rows = [(1, prose(10, 90) + " " + shared, "a", "en"), (2, shared + " " + prose(11, 80), "a", "en"), (3, prose(12, 100), "a", "en")]
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffixes.repeated_spans(docs(spark, rows)).collect()}
    assert spans == {(1, 90, 150), (2, 0, 60)}
    cut = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(docs(spark, rows)).collect()}
    assert cut[1] == rows[0][1] and cut[2] == prose(11, 80)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    x = np.repeat(base, 10, axis=0) + rng.normal(size=(60, 8)) * 0.08
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(60, None, 0), (61, [0.0] * 8, 0), (62, [float("nan")] * 8, 1), (63, x[0].tolist(), 0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), vectors.Range(cell=5, chunk=7, block=4)).collect()}
    x, label = np.vstack([x, x[:1]]), np.array([i % 2 for i in range(60)] + [0])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    ids = np.array([*range(60), 63])
    assert {int(i): got[i]["n_links"] for i in ids} == dict(zip(ids.tolist(), links.sum(axis=1).tolist()))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (60, 61, 62)) and got[63]["component_id"] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1009])
def test_feistel_is_a_permutation_with_an_inverse(spark, n):
    p = sharding.Feistel(n, 5)
    rows = spark.range(n).select("id", p.forward(F.col("id")).alias("at")).withColumn("back", p.backward(F.col("at"))).collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_sainte_lague_against_one_by_one():
    rng = random.Random(2)
    for _ in range(50):
        votes, seats = [rng.randint(0, 50) for _ in range(5)], rng.randint(0, 40)
        want = [0] * 5
        for _ in range(seats if sum(votes) else 0):
            want[max(range(5), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague([float(v) for v in votes], seats) == want


def test_mix_stays_near_targets(spark):
    rows = [(i, prose(i, 40), "abc"[i % 3], "en") for i in range(90)]
    sized = docs(spark, rows).withColumn("size", F.lit(40).cast("long"))
    got = mixing.mix(sized, mixing.cycle_weights, mixing.Mix(block=16)).collect()
    assert all(0 <= r["taken"] <= 120 and sum(r["shard_words"]) == r["taken"] for r in got)
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 32


def test_best_fit_takes_the_tightest_compatible_bin():
    items = [(6, 0, -1), (5, 1, -1), (4, 0, -1), (4, 2, -1), (1, 3, -1)]
    assert best(items) == packing.best_fit(items, 10)
    rng = random.Random(1)
    for _ in range(20):
        items = [(rng.randint(1, 10), rng.randint(-1, 3), rng.randint(-1, 2)) for _ in range(40)]
        assert best(items) == packing.best_fit(items, 10)


def best(items, capacity=10):
    bins, out = [], []
    for size, s, c in items:
        fit = [(left, i) for i, (left, ss, cc) in enumerate(bins) if left >= size and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((capacity, set(), set()))
        bins[i] = (bins[i][0] - size, bins[i][1] | {s}, bins[i][2] | {c})
        out.append(i)
    return out


def test_urls_reject_a_pure_template(spark):
    rules = [urls.Rule.parse("block", "net/de/")]
    pages = [(i, f"http://A.net/{'de' if i % 2 else 'en'}/{i}?q#f") for i in range(60)] + [(60, None), (61, "nothing"), (62, "x://b.net/de/1")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got[1]["host"] == "a.net" and got[1]["path"] == "/de/1" and got[1]["template"] == "/de/*" and got[1]["purity"] > 0.9
    assert {got[i]["verdict"] for i in (0, 2, 60, 61)} == {"allow"} and got[62]["rule"] == "net/de/" and got[60]["host"] == ""


def test_language_and_class_model_learn(spark):
    rows = [(i, prose(i % 40, 60) if i % 2 else prose(i % 40, 60).translate(str.maketrans("abcdefgh", "rstuvwxy")), "a", "en" if i % 2 else "de") for i in range(80)]
    got = langid.identify(docs(spark, rows)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["held_out"])
    # Two vocabularies of 40 words that never meet in a text: the class before tells which one follows.
    vocabulary = [prose(90 + side, 40).split() for side in (0, 1)]
    rows = [(i, " ".join(random.Random(i).choices([w + "xy"[i % 2] for w in vocabulary[i % 2]], k=60)), "a", "en") for i in range(80)]
    scored = classlm.score_texts(docs(spark, rows), F.col("doc_id") < 60, classlm.ClassModel(clustered=200, classes=4)).collect()
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["n_tokens"] == 61 for r in scored)


def test_sifted_members_keep_all_links_of_the_exact_round(spark):
    plan = minhash.NearDup(shingle=2, block=7)
    hasher = minhash.Hasher(plan)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(24):
        words = list(base)
        words[2 * i] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(24, 30):
        texts[i] = " ".join(f"far{i}_{j}" for j in range(40))
    rows = [(0, 5, i, i // 3, hasher.minima(minhash.shingle_sets([t.encode()], 2)[0]).tobytes(), t) for i, t in texts.items()]
    members = spark.createDataFrame(rows, "band int, key long, rep long, component long, sig binary, text string")
    every = {tuple(r) for r in minhash._across(members, plan, None).collect()}
    close = minhash._across(members.drop("text"), plan, None, sift=True).distinct()
    near = {r.rep for r in close.collect()}
    assert every and all(a in near and b in near for a, b in every) and max(near) < 24
    sifted = members.join(close, ["key", "rep"], "left_semi")
    assert {tuple(r) for r in minhash._across(sifted, plan, None).collect()} == every


def test_shared_shingles_equal_set_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (1, 5, 30, 60, 60)] + [np.zeros(0, dtype=np.uint64)]
    table = minhash.SetTable(sets)
    for i in range(len(sets)):
        assert table.shared(i, np.arange(5)).tolist() == [len(set(sets[i]) & set(s)) for s in sets[:5]]
    assert len(minhash.SetTable([]).sizes) == 0


def test_quality_sample_is_bounded(spark):
    rows = docs(spark, [(i, prose(i, 5), "a", "en") for i in range(60)])
    assert quality.sampled(rows, rows=10).count() <= 10
    assert quality.sampled(rows, rows=100).count() == 60
    assert quality.sampled(rows.where("false")).count() == 0


def test_passages_keep_words_that_no_earlier_document_has(spark):
    shared, own = prose(70, 60).split(), [prose(80 + i, 40).split() for i in range(6)]
    # Document 1 has the middle only; what 5 and 9 have in common around it is first in document 5.
    texts = {1: own[0] + shared[4:56] + own[1], 5: own[2] + shared + own[3], 9: own[4] + shared + own[5]}
    rows = docs(spark, [(i, " ".join(w), "a", "en") for i, w in texts.items()])
    got = {r["doc_id"]: (r["n_words"], r["n_later"], r["first_doc_id"]) for r in suffixes.repeated_spans(rows).collect()}
    assert got == {1: (52, 0, 1), 5: (60, 52, 1), 9: (60, 60, 1)}
    cut = {r["doc_id"]: r["text"].split() for r in suffixes.drop_repeats(rows).collect()}
    assert cut == {1: texts[1], 5: own[2] + shared[:4] + shared[56:] + own[3], 9: own[4] + own[5]}


@pytest.mark.parametrize("cell", [1 << 16, 8])
def test_passages_around_a_hot_anchor_against_brute_force(spark, cell):
    plan = suffixes.Sparse(cell=cell)  # the hot anchor in one cell, and in eight
    rng, anchor, texts = random.Random(8), prose(60, 36).split(), {}
    sides = [[prose(100 + 10 * s + i, 15).split() for i in range(4)] for s in (0, 1)]
    for i in range(60):
        left, right = rng.randint(0, 15), rng.randint(0, 15)
        texts[i] = prose(200 + i, 30).split() + rng.choice(sides[0])[15 - left:] + anchor + rng.choice(sides[1])[:right] + prose(300 + i, 30).split()
    windows = {i: [tuple(w[j:j + 50]) for j in range(len(w) - 49)] for i, w in texts.items()}
    low, high = {}, {}
    for i in sorted(windows):
        for w in windows[i]:
            low.setdefault(w, i)
            high[w] = i
    cover = lambda i, test: {j + k for j, w in enumerate(windows[i]) if test(w, i) for k in range(50)}
    rows = docs(spark, [(i, " ".join(w), "a", "en") for i, w in texts.items()])
    spans = suffixes.repeated_spans(rows, plan).collect()
    assert {(r["doc_id"], k) for r in spans for k in range(r["start_word"], r["end_word"])} == {
        (i, k) for i in texts for k in cover(i, lambda w, _: low[w] < high[w])}
    cut = {r["doc_id"]: r["text"].split() for r in suffixes.drop_repeats(rows, plan).collect()}
    assert cut == {i: [w for k, w in enumerate(texts[i]) if k not in cover(i, lambda w, own: low[w] < own)] for i in texts}


def test_words_beyond_the_first_clustered_get_classes(spark):
    # Two vocabularies that never meet; the driver clusters 20 words of 240, and tasks hold no more than 60 by themselves.
    vocabulary = [[f"{w}{side}x" for w in dict.fromkeys(prose(95 + side, 140).split())][:120] for side in (0, 1)]
    rows = [(i, " ".join(random.Random(i).choices(vocabulary[i % 2], k=80)), "a", "en") for i in range(200)]
    plan = classlm.ClassModel(clustered=20, classes=2, near=60)
    table = docs(spark, rows)
    counts = classlm.word_counts(table)
    model = classlm.fit(table, counts, plan)
    side = {int(h): i for i in (0, 1) for h in classlm.Words([" ".join(vocabulary[i]).encode()], lower=True).hashes.view(np.int64)}
    of = {int(h): int(c) for h, c in zip(model.known.view(np.int64), model.near_class)} | {r["word"]: r["class"] for r in model.rare.collect()}
    assert of.keys() == side.keys() and 0 < len(model.known) <= 60
    assert len({(side[w], of[w]) for w in of}) == 2 and set(of.values()) == {0, 1}
    scored = classlm.score_texts(table, F.col("doc_id") < 150, plan).collect()
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["n_tokens"] == 81 for r in scored)


def test_class_model_counts_all_bigrams_in_little_space(spark):
    # 400 words, of which tasks hold 100; texts with ends, repeats, an empty one, and rarer words next to each other.
    vocabulary = list(dict.fromkeys(f"{w}{i % 7}" for i, w in enumerate(prose(31, 900).split())))[:400]
    texts = [" ".join(random.Random(i).choices(vocabulary, [1 / (k + 1) for k in range(400)], k=400)) for i in range(300)] + ["", vocabulary[0] * 3]
    table = docs(spark, [(i, x, "a", "en") for i, x in enumerate(texts)])
    often = Counter(w for x in texts for w in x.split())
    hash_of = {w: int(classlm.Words([w.encode()], lower=True).hashes.view("int64")[0]) for w in often}
    counts, total = classlm.word_counts(table), 4 + classlm.SHAPES + 1
    top = sorted(((hash_of[w] % 2**64, n) for w, n in often.most_common(100)))
    known, near_n = np.array([h for h, _ in top], dtype=np.uint64), np.array([n for _, n in top])
    inside = set(known.view(np.int64).tolist())
    near_class = (known % np.uint64(4)).astype(np.int64)
    rare = counts.where(~F.col("word").isin(sorted(inside))).select("word", F.pmod("word", F.lit(4)).cast("int").alias("class"), "n")
    rows = classlm.neighbours(table, known, near_n, 3).union(classlm._rare_rows(rare, 3))
    pairs = classlm._pairs(rows, len(known)).cache()
    got = Counter()
    for r in classlm._counted(classlm._cell_rows(pairs, known, near_class, total, 3), near_class, total).collect():
        names = [known.view(np.int64), classlm.unpack(r["state"])[0]]
        for name, (of, kind, owner, cell, n) in zip(names, classlm._entries(r["cells"], r["state"], near_class, total)):
            assert (kind == name[of] % 4).all()
            for w, c, k in zip(name[of][owner].tolist(), cell.tolist(), n.tolist()):
                got[w, c] += k
    want = Counter()
    for x in texts:
        row = [total - 1, *[hash_of[w] % 4 for w in x.split()], total - 1]
        for i, w in enumerate(x.split()):
            want[hash_of[w], row[i + 2]] += 1
            want[hash_of[w], total + row[i]] += 1
    assert got == want
    # Rows of five columns took 16 bytes for each side of a bigram.
    bigrams = len({p for x in texts for p in zip(["", *x.split()], [*x.split(), ""])})
    assert sum(len(r["data"]) for r in pairs.collect()) < 8 * bigrams


def test_urls_tell_apart_branches_below_the_sixth_segment(spark):
    rules = [urls.Rule.parse("block", "net/a/b/c/d/e/f/bad/")]
    pages = [(i, f"http://a.net/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got[1]["template"].endswith("/bad/*") and got[0]["template"] != got[1]["template"]
    assert got[1]["purity"] > 0.9 and got[0]["purity"] == 0.5 and got[0]["verdict"] == "allow"


def test_language_id_keeps_texts_that_two_languages_share(spark):
    import corpus_pipeline

    rows = [(i, "shared words only", "a", "en" if i % 2 else "de") for i in range(20)] + [(20, "12 34", "a", "en"), (21, "qqqqqq", "a", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs(spark, rows), "").collect()}
    assert kept == set(range(20))


def test_words_are_counted_as_the_pattern_finds_them_and_texts_read_once(spark, tmp_path):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "\n a\x0bb  c\r\n", "\x00 \x1f\x85 \u00a0\u3000 $1 \\", "\U0001f600 é\u0301 x" * 50]
    table = docs(spark, [(i, t, "s", "en") for i, t in enumerate(texts)])
    rows = table.select("doc_id", packing.word_count(F.col("text")).alias("n"), F.coalesce(
        F.regexp_count("text", F.lit(packing.WORD)), F.lit(0)).alias("old")).collect()
    assert [r["n"] for r in rows] == [r["old"] for r in rows] and max(r["n"] for r in rows) == 101
    table.write.parquet(str(tmp_path / "docs"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "docs")))
    assert not [f for f in packed.inputFiles() if str(tmp_path) in f]
    assert {r["doc_id"]: r["length"] for r in packed.collect()} == {r["doc_id"]: r["n"] for r in rows}


def test_later_links_contract_only_components(spark, monkeypatch):
    seen, plain = [], components.components
    chain = spark.createDataFrame([(i, i + 1) for i in [*range(5, 40), *range(50, 80)]], "a long, b long")
    more = spark.createDataFrame([(12, 60), (13, 61), (7, 8), (60, 3), (90, 91), (None, 4)], "a long, b long")
    reach = plain(chain)
    monkeypatch.setattr(components, "components", lambda links: seen.append(links.where("a <> b").distinct().count()) or plain(links))
    got = {r["node"]: r["component"] for r in components.joined(reach, more).collect()}
    assert got == {r["node"]: r["component"] for r in plain(chain.union(more)).collect()}
    assert seen == [3]
    same = {r["node"]: r["component"] for r in components.joined(reach, more.where("false")).collect()}
    assert same == {r["node"]: r["component"] for r in reach.collect()}


def test_a_round_without_links_is_not_repeated(spark, monkeypatch):
    rng, base, seen, across = random.Random(9), prose(3, 80).split(), [], minhash._across
    texts = [" ".join(w if rng.random() > 0.2 else "x" + str(rng.randrange(999)) for w in base) for _ in range(12)]
    monkeypatch.setattr(minhash, "_across", lambda members, plan, best, sift=False: seen.append(best) or across(members, plan, best, sift))
    got = minhash.near_duplicates(docs(spark, [(i, t, "s", "en") for i, t in enumerate(texts)]), minhash.NearDup(shingle=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in range(12)}
    assert seen == [2, None, None]


def test_texts_are_cut_by_one_python_worker_a_task(spark, capsys):
    shared = prose(9, 60)
    rows = [(1, prose(10, 90) + " " + shared, "a", "en"), (2, shared + " \u00e4 " + prose(11, 80), None, "en"), (3, shared, "a", "en"), (4, None, "a", "en")]
    cut = suffixes.drop_repeats(docs(spark, rows))
    cut.explain()
    assert capsys.readouterr().out.count("EvalPython") == 1
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: rows[0][1], 2: "\u00e4 " + prose(11, 80), 4: None}


def test_tables_of_the_driver_start_no_python_worker(spark, monkeypatch):
    made, plain = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    table = spark.range(90).selectExpr("id as doc_id", "concat('some words of ', id % 7) as text", "if(id % 3 = 0, null, 's') as source",
                                       "if(id % 2 = 0, 'en', 'de') as lang", "4L as size")
    assert langid.identify(table).count() == 90
    got = mixing.mix(table, mixing.cycle_weights).collect()
    assert {(r["source"], r["source_size"], r["target"]) for r in got} == {("s", 240, 120.0), (None, 120, 240.0)}
    plans = [df._jdf.queryExecution().toString() for df in made]
    assert len(plans) == 2 and not any("ExistingRDD" in p or "LogicalRDD" in p for p in plans)


def test_a_worker_holds_arrays_over_little_text_at_a_time(monkeypatch):
    taken, texts = [], [prose(i, 400).encode() for i in range(900)]
    plain = minhash.Words
    monkeypatch.setattr(minhash, "Words", lambda part, lower: taken.append(sum(map(len, part))) or plain(part, lower))
    sets = minhash.shingle_sets(texts, 5)
    assert len(sets) == 900 and sum(taken) == sum(map(len, texts)) and max(taken) <= 1 << 18
    assert all((a == minhash.shingle_sets([t], 5)[0]).all() for a, t in zip(sets[::100], texts[::100]))


def test_tables_that_nothing_reads_any_more_are_emptied(spark, monkeypatch):
    rng, base, made, plain = random.Random(9), prose(3, 80).split(), {}, shared.stored
    texts = [" ".join(w if rng.random() > 0.02 else "x" + str(rng.randrange(999)) for w in base) for _ in range(12)] + [prose(4, 60), None]
    table = docs(spark, [(i, t, "s", "en") for i, t in enumerate(texts)])
    monkeypatch.setattr(shared, "stored", lambda df, path=None: made.setdefault(path, (df.columns, plain(df, path)))[1])
    found = minhash.near_duplicates(table, minhash.NearDup(shingle=1))
    spans = suffixes.repeated_spans(table)
    left = [spark.read.parquet(path).count() for path in made]
    assert ["doc_id", "n_shingles", "k1", "k2", "sig", "bands"] in [c for c, _ in made.values()] and ["rep", "text"] in [c for c, _ in made.values()]
    assert ["key", "doc", "th", "pos"] in [c for c, _ in made.values()] and not any(left)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(12)}, 12: 12, 13: 13} and spans.count() > 0
