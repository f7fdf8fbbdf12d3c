"""Registered queries of the operators here, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .decontamination import contaminated_spans
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .lexical import lexical_search
from .licenses import scan_licenses
from .lm_scoring import lm_scores
from .packing import pack_documents
from .pii import BASE, find_pii
from .quality import quality
from .quality import train as train_quality
from .query_sql import SPELLING_SQL, pii_sql
from .simhash import simhash_groups
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import toxicity, train

QUERIES: dict = {}
ORACLES: dict = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op8_exact_dedup", f"""
with t as (select doc_id, sha256({LOWER_SQL}) as text_sha256, {LOWER_SQL} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256
from t join g using (norm)""")
def op8(spark, sf_dir):
    """Whole-table exact dedup."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    out = simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_substring_dedup", """
with w as (select doc_id, row_number() over () as r,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
           from documents),
p as (select r, i, md5(array_to_string(ws[i:i + 34], ' ')) as m
      from w, unnest(range(1, len(ws) - 33)) u(i) where len(ws) >= 35),
d as (select m from p group by m having count(*) > 1),
g as (select distinct r, i + o as i from p join d using (m), range(0, 35) t(o)),
t as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as x from w),
k as (select r, count(*) as n, string_agg(x, ' ' order by i) as kept from t anti join g using (r, i) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (r)""")
def op10(spark, sf_dir):
    """Words under 35-word windows that occur elsewhere, removed from every document."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


WORDS_SQL = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")


@query("op5_benchmark_decontamination", f"""
with b as (select item_id, {WORDS_SQL} as ws from benchmark),
win as (select item_id, unnest(range(1, greatest(2, len(ws) - 8))) as i, ws from b where len(ws) > 0),
pat as (select distinct item_id, array_to_string(ws[i:i + 9], ' ') as p, len(ws[i:i + 9]) as n from win),
sizes as (select distinct n from pat),
d as (select row_number() over () as r, doc_id, {WORDS_SQL} as ws from documents),
dw as (select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as p
       from d, sizes, unnest(range(1, len(ws) - n + 2)) u(i) where len(ws) >= n),
hit as (select r, i, dw.n, item_id from dw join pat using (p)),
cov as (select r, count(distinct i + o) as n_hit from hit, range(0, 10) t(o) where o < n group by r),
its as (select r, count(distinct item_id) as n_items,
               string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
        from hit group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (r) left join its using (r)""")
def op5(spark, sf_dir):
    """Benchmark windows found in every document."""
    out = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    """Toxicity of every document; rows of fold 1 are held out from training."""
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, table(spark, sf_dir, "labels"), usable=fold != 1)
    return toxicity(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


@query("op3_html_extraction")
def op3(spark, sf_dir):
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    """Posterior quality of every document; rows of fold 1 are held out from training."""
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train_quality(docs, table(spark, sf_dir, "labels"), usable=fold != 1)
    return quality(docs, model).withColumn("held_out", fold == 1)


@query("op7_lm_scoring", f"""
with d as (select row_number() over () as r, doc_id,
                  list_filter(regexp_split_to_array({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
t as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from d),
g as (select r, i, w, lag(w) over p as v, lag(w, 2) over p as u, count(*) over (partition by r) as n_words
      from t window p as (partition by r order by i)),
one as (select w, count(*) as c from g group by w), one_d as (select r, w, count(*) as c from g group by r, w),
two as (select v, w, count(*) as c from g where i >= 2 group by v, w),
two_d as (select r, v, w, count(*) as c from g where i >= 2 group by r, v, w),
three as (select u, v, w, count(*) as c from g where i >= 3 group by u, v, w),
three_d as (select r, u, v, w, count(*) as c from g where i >= 3 group by r, u, v, w),
total as (select count(*) as n from g),
s as (select g.r, g.i, total.n - g.n_words as rest, o1.c - d1.c as c1, o2.c - d2.c as c2, o3.c - d3.c as c3,
             ov.c - dv.c as cv, ouv.c - duv.c as cuv
      from g cross join total join one o1 using (w) join one_d d1 on g.r = d1.r and g.w = d1.w
      left join two o2 on g.v = o2.v and g.w = o2.w left join two_d d2 on g.r = d2.r and g.v = d2.v and g.w = d2.w
      left join three o3 on g.u = o3.u and g.v = o3.v and g.w = o3.w
      left join three_d d3 on g.r = d3.r and g.u = d3.u and g.v = d3.v and g.w = d3.w
      left join one ov on g.v = ov.w left join one_d dv on g.r = dv.r and g.v = dv.w
      left join two ouv on g.u = ouv.v and g.v = ouv.w left join two_d duv on g.r = duv.r and g.u = duv.v and g.v = duv.w),
s1 as (select *, case when c1 > 0 then c1 / cast(rest as double) else 1 / (rest + 1.0::double) end as p1 from s),
s2 as (select *, case when i < 2 then p1 when c2 > 0 then c2 / cast(cv as double) else 0.4::double * p1 end as p2 from s1),
s3 as (select *, case when i < 3 then p2 when c3 > 0 then c3 / cast(cuv as double) else 0.4::double * p2 end as p3 from s2),
x as (select r, sum(ln(p3)) as log_score from s3 group by r)
select doc_id, len(ws) as n_words, round(coalesce(log_score, 0), 4) as log_score,
       round(log_score / len(ws), 6) as mean_log_score
from d left join x using (r)""")
def op7(spark, sf_dir):
    """Trigram stupid-backoff score of every document by the counts of all the others."""
    out = lm_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                      F.round("mean_log_score", 6).alias("mean_log_score"))


@query("op6_license_scans")
def op6(spark, sf_dir):
    """Licences named in every document, with the number and the best of their matches."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                      F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
                      F.round(F.array_max("matches.dice"), 6).alias("best_dice"), "matches")


def _spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op11_pii", pii_sql())
def op11(spark, sf_dir):
    """Personal data in every document."""
    out = find_pii(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in BASE]
    base = _spans_text(of(*[k.name for k in BASE]))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                      _spans_text(F.col("spans")).alias("spans"))


@query("op12_ranked_lexical_search", f"""
with i as (select row_number() over () as q, item_id, unnest({WORDS_SQL}) as term from benchmark),
q as (select q, item_id, term, count(*) as times from i group by all),
d as (select row_number() over () as r, doc_id, {WORDS_SQL} as ws from documents),
st as (select count(*) filter (len(ws) > 0) as n_docs, sum(len(ws))::bigint as n_terms from d),
tf as (select r, doc_id, n, term, count(*) as tf
       from (select r, doc_id, len(ws) as n, unnest(ws) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select q, item_id, r, doc_id,
             sum(times * cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint)
                 * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
      from q join tf using (term) join df using (term) cross join st group by all),
x as (select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank
      from s where score > 0)
select item_id, rank::int as rank, doc_id, score from x where rank <= 20""")
def op12(spark, sf_dir):
    """The 20 best documents for every benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
