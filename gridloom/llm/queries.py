"""The registered queries of the corpus operators, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, imatch, langid, lm, mixing, neardup, substrings, toxicity, urltree, warc
from .common import UPPER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_dedup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("factor")


def op4_language_id(spark, sf_dir):
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filters(spark, sf_dir):
    """A page is labelled by the quality of the document its path names."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    named = pages.select("page_id", F.regexp_extract(urltree.path_of(F.col("url")), "/([0-9]{1,15})(?:[./]|$)", 1).try_cast("long").alias("doc_id")).filter("doc_id is not null")
    good = named.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")
    return urltree.judge(pages.select("page_id", "url"), good)


def op7_fingerprints(spark, sf_dir):
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_decontamination(spark, sf_dir):
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark, sf_dir):
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_warc, op2_minhash_dedup, op3_mixing, op4_language_id, op5_toxicity, op6_url_filters, op7_fingerprints, op8_substring_dedup, op9_decontamination, op10_lm_scoring)}


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_SPACE = "[^\\x20\\x09-\\x0D]+"

OP1 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
o as (select payload_digest, min(page_id) as owner from p where payload_bytes >= 100 group by 1)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when o.owner is not null and p.page_id is distinct from o.owner then 'revisit' else 'response' end as record_type,
  case when o.owner is not null and p.page_id is distinct from o.owner then o.owner end as refers_to
from p left join o on p.payload_digest = o.payload_digest and p.payload_bytes >= 100
"""

OP2 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
pr as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from pr join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
c as (select doc_id, doc_id as r from w union select e.a, c.r from c join e on e.b = c.doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.r as component_id, w.doc_id = m.r as kept
from w left join n using (doc_id) join (select doc_id, min(r) as r from c group by 1) m on m.doc_id = w.doc_id
"""

OP8 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as ws from documents),
g as (select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from g) where k > 1),
gone as (select distinct doc_id, i + j as p from r, range(0, 20) t(j)),
k as (select t.doc_id, array_to_string(list(t.x order by t.p), ' ') as kept, count(*) as n from (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w) t anti join gone on gone.doc_id = t.doc_id and gone.p = t.p group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id
"""

_WORDS9 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = f"""
with b as (select cast(item_id as varchar) as item, {_WORDS9} as ws from benchmark),
bw as (select distinct item, least(len(ws), 10) as k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') as g
  from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
w as (select doc_id, {_WORDS9} as ws from documents),
dw as (select doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select distinct k from bw) where len(ws) >= k)),
h as (select dw.doc_id, dw.i, dw.k, bw.item from dw join bw on bw.k = dw.k and bw.g = dw.g),
p as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from h) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item collate "C") as names from (select distinct doc_id, item from h) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items, sha256(coalesce(m.names, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from w left join p on p.doc_id = w.doc_id left join m on m.doc_id = w.doc_id
"""


def _op3() -> str:
    """The fitting, unrolled: one step for each round and dimension."""
    dims = mixing.DIMENSIONS
    share = lambda chars: f"(length(text) - length(translate(text, '{chars}', '')))"
    steps = [
        f"""d as (select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,
  case when text is null or text = '' then 'empty' when {share("|")} * 50 > length(text) then 'table' when {share("#%&*$")} * 25 > length(text) then 'symbols'
  when {share("!")} * 25 > length(text) then 'shout' else 'prose' end as topic,
  cast(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) as bigint) as tokens from documents)""",
        "c as (select source, lang, topic, cast(sum(tokens) as double) as tokens from d group by all)",
    ]
    for d in dims:
        steps.append(f"t_{d} as (select {d}, case when sum(tokens) > 0 then pow(sum(tokens), {mixing.FLATTEN[d]}) else 0 end as p from c group by 1)")
        steps.append(f"g_{d} as (select {d}, (select sum(tokens) from c) * p / nullif((select sum(p) from t_{d}), 0) as goal from t_{d})")
    last = "c0"
    steps.append("c0 as (select source, lang, topic, tokens, tokens as weight from c)")
    k = 0
    for _ in range(mixing.ROUNDS):
        for d in dims:
            k += 1
            steps.append(f"c{k} as materialized (select source, lang, topic, tokens, coalesce(weight * goal / nullif(sum(weight) over (partition by {d}), 0), 0) as weight from {last} join g_{d} using ({d}))")
            last = f"c{k}"
    rand = f"cast(('0x' || substr(md5(cast(doc_id as varchar) || ':{mixing.SEED}'), 1, 12)) as bigint) / {float(1 << 48)!r}"
    return f"""with {", ".join(steps)},
f as (select source, lang, topic, case when tokens > 0 then round(least(1.0, weight / tokens * {mixing.RATE}), 9) else 0 end as p from {last}),
o as (select doc_id, source, lang, d.topic, d.tokens, case when d.tokens > 0 then p else 0.0 end as p from d join f using (source, lang, topic))
select doc_id, source as mix_source, lang as mix_lang, topic, tokens, p as probability, coalesce({rand} < p, false) as sampled from o"""


def oracle_sql():
    return {"op1_warc": OP1, "op2_minhash_dedup": OP2, "op3_mixing": _op3(), "op8_substring_dedup": OP8, "op9_decontamination": OP9}
