"""The registered queries of these operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamline.llm import classlm, langid, minhash, mixing, packing, quality, ranking, sharding, suffixes, tokens, urls, variants, vectors

RULES = [urls.Rule.parse(v, t) for v, t in (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op2_vector_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return packed.select("doc_id", "piece", "start", "length", "bin", "place")


def op4_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    training = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    return classlm.score_texts(_table(spark, folder, "documents").select("doc_id", "text"), training)


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"), minhash.NearDup(shingle=2))


def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    spans = suffixes.repeated_spans(_table(spark, folder, "documents").select("doc_id", "text"))
    return spans.select("doc_id", "start_word", "end_word", "n_words")


def op7_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.identify(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(_table(spark, folder, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op9_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return sharding.shuffled_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op10_sainte_lague_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), packing.word_count(
        F.col("text")).alias("size"))
    return mixing.mix(docs, mixing.cycle_weights).select("doc_id", "size", "source_size", "target", "taken", "shard_words")


def op11_length_strata(spark: SparkSession, folder: str) -> DataFrame:
    found = ranking.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_whole_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokens.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.count_tokens(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_spelling_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(_table(spark, folder, "documents").select("doc_id", "text"), slip=31)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_quality_cascade, op2_vector_range_join, op3_best_fit_packing, op4_class_lm, op5_minhash, op6_suffix_array,
    op7_language_filters, op8_url_templates, op9_feistel_shards, op10_sainte_lague_mix,
    op11_length_strata, op12_whole_tokens, op13_spelling_chunks, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_COMPONENTS = """
reach(node, seen) as (
  select id, id from nodes
  union
  select r.node, l.b from reach r join links l on l.a = r.seen)"""

ORACLES = {
    "op1_quality_cascade": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, {_WORDS.format('text')} as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
             len(string_split(text, chr(10))) as n_lines from t),
win as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g
        from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
cov as (select r, sum(least(3, coalesce(nx - i, 3))) as n from (select r, i, lead(i) over (partition by r order by i) as nx from rep) group by r),
f as (select w.r, doc_id, text, n_lines, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
      from w left join cov on w.r = cov.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > 0.2 * greatest(n_words, 1)
       or word_chars < 2 * greatest(n_words, 1) or word_chars > 20 * greatest(n_words, 1)
       or (n_dup_lines > 2 and n_dup_lines > 0.3 * n_lines)
       or length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) < 0.5 * word_chars) as kept
from f""",
    "op2_vector_range_join": f"""
with recursive v as (select vec_id as id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null),
nodes as (select vec_id as id from embeddings),
links as (select x.id as a, y.id as b from v x join v y on x.label = y.label and x.id <> y.id
          where list_cosine_similarity(x.e, y.e) >= 0.98),
n as (select a, count(*) as n from links group by a),{_COMPONENTS},
low as (select node, min(seen) as c from reach group by node)
select id as vec_id, coalesce(n.n, 0)::bigint as n_links, c as component_id, c = id as kept
from nodes left join n on n.a = id join low on low.node = id""",
    "op5_minhash": f"""
with recursive d as (select doc_id as id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct id, g from (
  select id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])
                         when len(w) = 1 then w else [] end) as g from d)),
n as (select id, count(*) as n from s group by id),
nodes as (select doc_id as id from documents),
links as (select a, b from (select x.id as a, y.id as b, count(*) as k from s x join s y on x.g = y.g and x.id <> y.id group by 1, 2)
          join n p on p.id = a join n q on q.id = b where 100 * k >= 80 * (p.n + q.n - k)),{_COMPONENTS},
low as (select node, min(seen) as c from reach group by node)
select nodes.id as doc_id, coalesce(n.n, 0)::bigint as n_shingles, c as component_id, c = nodes.id as kept
from nodes left join n on n.id = nodes.id join low on low.node = nodes.id""",
    "op6_suffix_array": f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
win as (select doc_id, i, hash(array_to_string(w[i+1:i+50], ' ')) as h from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from d)),
hot as (select h from win group by h having count(distinct doc_id) > 1),
hit as (select distinct doc_id, i from win where h in (select h from hot)),
cut as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hit),
grp as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from cut)
select doc_id, min(i)::bigint as start_word, (max(i) + 50)::bigint as end_word, (max(i) + 50 - min(i))::bigint as n_words
from grp group by doc_id, g""",
    "op11_length_strata": rf"""
with d as (select row_number() over () as r, doc_id,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
c as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
p as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) group by r, t),
f as (select t, count(*)::bigint as df from p group by t),
g as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as weight from f, c),
l as (select r, doc_id, 10 + (90 * len(w)::bigint * n_docs) // n_terms as m from d, c where len(w) > 0),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select item_id, l.r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join p using (t) join g using (t) join l on l.r = p.r group by item_id, l.r, doc_id),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10""",
    "op13_spelling_chunks": rf"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda x, y:
    case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as step),
runs as (select doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents where text is not null),
u as (select doc_id, run, count(*) as k from runs where length(run) >= 7 group by doc_id, run),
b as (select run, k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from u),
h as (select run, k, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i+1])::bigint),
        lambda a, c: xor(step[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) as h from b, crc),
v as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
w as (select word, sum(k)::bigint as n from v where length(word) >= 7 group by word having sum(k) >= 2),
cut as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (select x.word, x.n, y.word as other, y.n as m from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word
         union select cut.word, cut.n, w.word, w.n from cut join w on cut.rest = w.word
         union select w.word, w.n, cut.word, cut.n from cut join w on cut.rest = w.word),
best as (select word, n, other, m, count(*) over (partition by word) as n_near,
           row_number() over (partition by word order by m desc, other) as r from near),
k as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 10 * w.n then other end as form,
        case when m >= 10 * w.n then m end as form_n from w left join best on best.word = w.word and r = 1),
way(word, here) as (select word, word from k union all select way.word, k.form from way join k on k.word = way.here where k.form is not null)
select k.word, form, here as root, n, n_near, form_n
from k join (select way.word, here from way join k on k.word = way.here where k.form is null) e on e.word = k.word""",
}
