"""Ranked search, token counts and spelling variants beside brute force, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamline.llm import ranking, tokens, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, n long, score double, block int, m int"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0, 3, 4) for i, t in rows], DOCS)


def ranked(docs, items, k):
    """Every item against every document, one by one."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 8, 8, 40, 300])))) for i in range(300)]
    rows += [(300 + i, "w3, w4; W5-w6 über") for i in range(120)]  # copies: ties, and one length held by very many
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(25)] + [(90, "w3 w4 w5"), (91, "nowhere"), (92, None), (93, "")]
    return rows, items


@pytest.mark.parametrize("plan", [ranking.Search(), ranking.Search(k=3, block=7, seeds=1), ranking.Search(item_terms=20, block=64)])
def test_search_against_brute_force(spark, library, plan):
    rows, items = library
    found = ranking.search(table(spark, rows).repartition(5), spark.createDataFrame(items, "item_id long, text string"), plan)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == ranked(rows, items, plan.k)


def test_search_splits_a_length_that_many_documents_have(spark, library):
    rows, _ = library
    vocabulary = {b"w3": 0, b"w4": 1}
    vectors = ranking._vectors(table(spark, rows), vocabulary).withColumn("m", F.lit(7))
    blocks = ranking.build_index(vectors, len(rows), ranking.Search(block=50)).select(F.size("docs").alias("n")).collect()
    assert sum(r.n for r in blocks) == len(rows) and max(r.n for r in blocks) <= 50


def test_search_odd_rows(spark):
    rows = [(1, "deep sea"), (1, "deep sea"), (None, "deep sea"), (2, None), (3, ""), (4, " ,;\x00"), (5, "deep " * 5000 + "x" * 50000)]
    items = spark.createDataFrame([(None, "Deep"), (7, "sea"), (7, "x"), (8, None)], "item_id long, text string")
    found = [tuple(r) for r in ranking.search(table(spark, rows), items).collect()]
    assert sorted(r[1] for r in found if r[0] is None) == [1, 2, 3, 4]
    assert [r[2] for r in sorted(f for f in found if f[0] == 7)] == [None, 1, 1]
    empty = table(spark, rows).where("false")
    assert ranking.search(empty, items).count() == 0
    assert ranking.search(table(spark, rows), items.where("false")).count() == 0


def test_long_texts_are_cut_between_terms_only(monkeypatch):
    monkeypatch.setattr(ranking, "PART", 10)
    text = b"aa bb " * 40 + b"c" * 100 + b"-aa"
    assert ranking.count_terms(text) == Counter({b"aa": 41, b"bb": 40, b"c" * 100: 1})
    monkeypatch.setattr(variants, "PART", 10)
    assert "".join(variants._parts("straße Älter " * 9 + "x" * 50)) == "straße Älter " * 9 + "x" * 50


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return tokens.Vocabulary.read(path), Tokenizer.from_file(path), public


def test_token_counts_equal_the_library(vocabulary):
    proven, library, _ = vocabulary
    counter, rng = tokens.Counter(proven), random.Random(1)
    bits = ["a", "B", "'s", "'S", " ", "  ", "\n", "\r\n", "\t", "1", "½", "é", "ñ", "漢", "😀", "՘", "Ᲊ", " ", "\x1c", "\x85", "'ll", "<|endoftext|>",
            "<|endoftext", "|>", ".", "--", "́", "the", " of", " ", "‍", "Ⅷ", "zxqj"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_are_proven_and_parts_do_not_change_counts(vocabulary, monkeypatch):
    proven, library, _ = vocabulary
    rng = random.Random(2)
    assert "<|endoftext|>" not in proven.whole and len(proven.whole) > 40_000
    for text in rng.sample(proven.whole, 2000):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
    counter = tokens.Counter(proven)
    text = "it's the end, we've seen  three   things\n\n of no use " * 50 + "x" * 3000
    pieces = list(tokens.parts(text, 40))
    assert "".join(pieces) == text and len(pieces) > 20
    assert sum(map(counter.ordinary, pieces)) == len(library.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    assert tokens.Counter(proven).count(text) == counter.count(text)


def test_token_counts_of_odd_rows(spark, vocabulary):
    proven, library, public = vocabulary
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "null id <|endoftext|>"), (4, "lang " * 40_000), (5, "zq" * 3000)]
    docs = table(spark, rows).withColumn("n_tokens", F.lit("taken"))
    found = tokens.count_tokens(docs, proven, limit=100)
    assert found.columns == [*docs.columns, "n_bytes", "over_limit"]
    for r in found.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    assert tokens.count_tokens(docs.where("false"), proven).count() == 0
    with pytest.raises(ValueError):
        tokens.Vocabulary.read(public.path("word_bpe_49k.json"))


def spelled(rows, least, seen, ratio, slip):
    """Words, and all pairs by removing letters."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if slip and h % slip == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= seen}
    near = {w: {v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and edit(v, w)} for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("slip", [None, 5])
def test_variants_against_brute_force(spark, slip):
    rng = random.Random(8)
    letters = "abÀß÷"
    stems = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = list(rng.choices(stems, [1 / (j + 1) ** 2 for j in range(60)])[0])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                rng.choice([lambda: w.pop(at), lambda: w.insert(at, rng.choice(letters)), lambda: w.__setitem__(at, rng.choice(letters))])()
            words.append("".join(w))
        rows.append((i, "; ".join(words).upper() if i % 3 else " ".join(words)))
    rows += [(1, rows[0][1]), (None, rows[2][1]), (900, None), (901, ""), (902, "1 2 3")]
    rows = [(i, t and t.replace("SS", "ß")) for i, t in rows]
    plan = variants.Spelling(least=4, seen=2, ratio=3)
    found = variants.group_variants(table(spark, rows), plan, slip)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = spelled(rows, 4, 2, 3, slip)
    assert {tuple(r) for r in found.collect()} == want and any(r[1] and r[2] != r[1] for r in want)


def test_variants_long_chain_and_empty_table(spark):
    n, rows = 2, []
    for i in range(9):  # each word is one letter from the next, which is twice as frequent
        rows.append(("a" * i + "b" * (12 - i), n))
        n *= 2
    found = variants.variants(spark.createDataFrame(rows, "word string, n long"), variants.Spelling(ratio=2))
    assert {r.root for r in found.collect()} == {rows[-1][0]}
    assert variants.group_variants(table(spark, [(1, "x")]).where("false")).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(table(spark, [(1, "x")]), variants.Spelling(ratio=1))
