"""The registered queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import collocations, decontamination, hard_negatives, license_scan, media, mixing, packing, passage_dedup, quality_rules, secret_scan, sharding, simhash, url_filter
from loomwork.session import table

ARRIVAL_DOCS = 512
POLICY = "web-1"


def tokenizer_files() -> tuple[str, str]:
    """(ranks file, pattern) of the public byte-level BPE that is installed on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("values", "n_literal")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), POLICY)
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE_RULES))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", quality_rules.sole_rule(POLICY).alias("sole_rule"))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in shards of ARRIVAL_DOCS ids and is compacted; each row with the file that holds it then."""
    docs = table(spark, sf_dir, "documents")
    root = sharding.new_root(spark)
    sharding.append(docs, root, F.expr(f"coalesce(doc_id, 0) div {ARRIVAL_DOCS}"), gather=False)
    sharding.compact(spark, root, docs.schema)
    first = F.col("made").startswith("00000001")
    files = sharding.manifest(spark, root).select("made", F.col("shard").alias("file"), (~first).alias("merged"), F.col("rows").alias("file_rows"), F.col("bytes").alias("file_bytes"))
    held = sharding.current(spark, root, docs.schema).select("doc_id", F.col("__made").alias("made"), F.col("__shard").alias("file"))
    return held.join(files, ["made", "file"]).select("doc_id", "file", "merged", "file_rows", "file_bytes")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents")).orderBy("position", "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from docs),
counted as (select r, count(*) as n_words, sum(length(w)) as word_chars from words group by r),
runs as (select r, i, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2, lead(w, 3) over o as w3, lead(w, 4) over o as w4 from words window o as (partition by r order by i)),
twice as (select r, i, count(*) over (partition by r, w, w1, w2, w3, w4) as n from runs where w4 is not null),
again as (select r, count(distinct i + k) as n_repeat_words from twice, unnest([0, 1, 2, 3, 4]) as t(k) where n > 1 group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
dups as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from docs left join counted using (r) left join again using (r) left join dups using (r)),
bits as (select *, (BITS)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & BASE) <> 0 as base_failed, (fail_bits & POLICY) = 0 as kept, fail_bits, case fail_bits & POLICY SOLE end as sole_rule from bits
"""

OP8_SQL = """
with docs as (select doc_id, coalesce(doc_id, 0) // ARRIVAL as shard, coalesce(strlen(text), 0) + ROW_BYTES as b from documents),
shards as (select shard, count(*) as rows, sum(b)::bigint as bytes from docs group by shard),
tiers as (select *, case when 2 * bytes <= TARGET then TIERS end as tier from shards),
strides as (select *, TARGET - least(TARGET // 2, (SMALLEST * pow(FANOUT, tier))::bigint) as stride from tiers),
ahead as (select *, (sum(bytes) over (partition by tier order by shard) - bytes)::bigint as ahead from strides),
runs as (select *, ahead // stride as run from ahead),
files as (select *, tier is not null and count(*) over f > 1 as merged, sum(rows) over f as run_rows, sum(bytes) over f as run_bytes from runs window f as (partition by tier, run))
select doc_id, (case when merged then tier::bigint * 1099511627776 + run else shard end)::bigint as file, merged,
  (case when merged then run_rows else rows end)::bigint as file_rows, (case when merged then run_bytes else bytes end)::bigint as file_bytes
from docs join files using (shard)
"""

OP10_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source is null, source) - 1 as n from s),
v as (select *, [1, 2, 3][(n % 3) + 1]::bigint as weight, 3 * source_size as cap, (1 - n % 3)::double * 0.8 as slope from w),
o as (
  select *, coalesce(sum(cap) over (f rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    sum(weight) over (f rows between current row and unbounded following)::bigint as after
  from v window f as (order by cap / weight, source is null, source)),
l as (select *, ((select sum(source_size) from s) - before)::bigint as rest from o),
p as (select *, cap * after >= rest * weight as is_open from l),
q as (select min({'before': before, 'rest': rest, 'after': after}) as first from p where is_open),
t as (select source, source_size, slope, case when is_open then (weight * first.rest) / first.after else cap::double end as target from p, q),
x as (
  select d.*, source_size, slope, target, coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from d join t on d.source is not distinct from t.source),
y as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as whole from x),
z as (select *, (whole * size + greatest(0, least(size, floor(target)::bigint - whole * source_size - ahead)))::bigint as taken from y),
e as (select *, case when taken > 0 and target > 0 then least(1.0::double, ahead / target) end as share from z)
select doc_id, size, source_size, target, taken,
  round(case when slope = 0 then share else (sqrt((1 - slope / 2) * (1 - slope / 2) + 2 * slope * share) - (1 - slope / 2)) / slope end, 6) as position
from e
"""


OP11_SQL = r"""
with docs as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from docs),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
grams as (select lang, w[i:i + s - 1] as p, s from starts, unnest([1, 2, 3, 4]) as t(s) where i + s - 1 <= len(w)),
f as (select lang, p, s, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from f where s = 1 group by lang),
c as (select * from f where s > 1 and f >= 30),
cuts as (
  select c.lang, c.p, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, s)) as k from c) c join f x on x.lang = c.lang and x.p = c.p[1:c.k] join f y on y.lang = c.lang and y.p = c.p[c.k + 1:c.s]),
weakest as (select lang, p, a, min({'score': score, 'k': k, 'l': l, 'r': r}) as cut from cuts group by lang, p, a),
inside as (select lang, p[i:i + z - 1] as p, max(f) as longer from (select *, unnest(range(1, s + 1)) as i from c where s > 2), unnest([2, 3]) as t(z) where z < s and i + z - 1 <= s group by all),
kept as (select w.*, array_to_string(w.p, ' ') as phrase from weakest w left join inside i on w.lang = i.lang and w.p = i.p where longer is null or 100 * longer < 80 * a),
ranked as (select *, row_number() over (partition by lang order by cut.score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, cut.l as l, cut.r as r, n, cut.score as score from ranked join totals using (lang) where rank <= 2000
"""

OP12_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
each as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as i from e),
pairs as (
  select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, sum(a.x * c.x)::bigint as score
  from each a join each c on a.i = c.i where a.vec_id % 100 = 0 group by all),
ranked as (select *, row_number() over (partition by anchor_id order by score desc, id) as k from pairs where same and id <> anchor_id),
fit as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
  from ranked p join pairs n on p.anchor_id = n.anchor_id and not n.same where p.k <= 5 and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from fit where rank <= 5
"""

OP13_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as x from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
dw as (select r, p, k, array_to_string(w[p:p + k - 1], ' ') as x from (select r, w, unnest(range(1, len(w) + 1)) as p from d), (select distinct k from iw) where p + k - 1 <= len(w)),
hits as (select dw.r, dw.p, dw.k, iw.item_id from dw join iw using (k, x)),
spans as (select r, count(distinct p + o) as n_hit from hits, unnest(range(0, k)) as t(o) group by r),
items as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spans using (r) left join items using (r)
"""


def op4_sql() -> str:
    bits = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, rule in enumerate(quality_rules.RULES.values()))
    base, policy = quality_rules.mask(quality_rules.BASE_RULES), quality_rules.mask(quality_rules.POLICIES[POLICY])
    sole = " ".join(f"when {quality_rules.mask((r,))} then '{r}'" for r in quality_rules.POLICIES[POLICY])
    return OP4_SQL.replace("BITS", bits).replace("SOLE", sole).replace("BASE", str(base)).replace("POLICY", str(policy))


def op8_sql() -> str:
    tiers = "(" + " + ".join(f"case when bytes >= {sharding.SMALLEST_TIER * sharding.FANOUT**i} then 1 else 0 end" for i in range(sharding.TIERS)) + ")"
    values = {"ARRIVAL": ARRIVAL_DOCS, "ROW_BYTES": sharding.ROW_BYTES, "TIERS": tiers, "TARGET": sharding.TARGET_BYTES, "SMALLEST": sharding.SMALLEST_TIER, "FANOUT": sharding.FANOUT}
    sql = OP8_SQL
    for name, value in values.items():
        sql = sql.replace(name, str(value))
    return sql


def op9_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    case = lambda k: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + " end"
    depth = url_filter.DEPTH
    steps, last = [], "forms"
    for level in range(1, depth + 1):
        steps.append(
            f"wide{level} as (select host, made from (select distinct host, made, segs[{level}] as seg from {last} where len(segs) >= {level}) group by host, made having count(*) > {url_filter.MOST_CHILDREN}),\n"
            f"tree{level} as (select t.host, t.raw, t.segs, case when len(segs) < {level} then t.made else t.made || case when w.host is null then [segs[{level}]] else ['*'] end end as made from {last} t left join wide{level} w on t.host = w.host and t.made = w.made)"
        )
        last = f"tree{level}"
    weight = f"({url_filter.STRENGTH}::double + domains)"
    drawn = lambda k: f"coalesce((b{k} + {weight} * purity) / (n{k} + {weight}), purity)"
    pulls = "".join(f"p{k} as (select * replace ({drawn(k)} as purity) from p{k - 1 if k else 'start'}),\n" for k in range(depth + 2))
    return rf"""
with urls as (
  select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
judged as (
  select *, {case(1)} as rule, {case(2)} as ruled,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[0-9]') then '*' else s end) as own from urls),
cut as (select *, case when len(own) > {depth} then own[1:{depth}] || ['**'] else own end as segs from judged),
rows as (select *, array_to_string(segs, '/') as raw, case ruled when 'block' then 1 when 'allow' then 0 end as label from cut),
forms as (select distinct host, segs, raw, []::varchar[] as made from rows),
{",".join(steps)},
tree as (select host, raw, case when len(segs) > {depth} then made || ['**'] else made end as nodes, array_to_string(nodes, '/') as template from {last}),
labels as (select host, raw, count(label) as labelled, coalesce(sum(label), 0) as bad from rows group by host, raw),
counted as (select host, template, nodes, sum(labelled) as labelled, sum(bad) as bad from tree join labels using (host, raw) group by host, template, nodes),
steps as (select *, array_to_string(nodes[1:level - 1], '/') as parent, array_to_string(nodes[1:level], '/') as node from (select *, unnest(range(1, len(nodes) + 1)) as level from counted)),
summed as (select host, parent, node, sum(labelled) as labelled, sum(bad) as bad from steps group by host, parent, node),
rated as (select *, bad / labelled as rate from summed where labelled > 0),
beside as (select *, lag(rate) over o as rate0, lag(bad) over o as bad0, lag(labelled) over o as labelled0 from rated window o as (partition by host, parent order by rate, node)),
pooled as (select *, (bad + bad0) / (labelled + labelled0) as p from beside),
apart as (select *, coalesce((rate - rate0 > {url_filter.Z} * sqrt(p * (1 - p) * (1.0::double / labelled + 1.0::double / labelled0)))::int, 0) as a from pooled),
branches as (select *, sum(a) over (partition by host, parent order by rate, node rows unbounded preceding) as branch from apart),
shares as (select host, parent, node, sum(bad) over b as b, sum(labelled) over b as n from branches window b as (partition by host, parent, branch)),
held as (select host, template, {", ".join(f"max(b) filter (level = {k}) as b{k}, max(n) filter (level = {k}) as n{k}" for k in range(1, depth + 2))} from steps join shares using (host, parent, node) group by host, template),
named as (select *, array_to_string(string_split(host, '.')[-2:], '.') as domain from counted where labelled > 0),
everywhere as (select template, round(sum(share), 9) as bad_domains, count(*) as domains from (select template, domain, sum(bad) / sum(labelled) as share from named group by template, domain) group by template),
roots as (select host, sum(bad) as b0, sum(labelled) as n0 from counted group by host),
pstart as (
  select c.host, c.template, h.* exclude (host, template), b0, n0, coalesce(domains, 0) as domains, (coalesce(bad_domains, 0) + {url_filter.STRENGTH * url_filter.PRIOR}::double) / (coalesce(domains, 0) + {url_filter.STRENGTH}::double) as purity
  from counted c join roots r on c.host = r.host left join everywhere e on c.template = e.template left join held h on c.host = h.host and c.template = h.template),
{pulls}pure as (select host, template, purity from p{depth + 1})
select page_id, host, path, rule, coalesce(ruled, case when purity >= {url_filter.REJECT_FROM} then 'block' else 'allow' end) as verdict, template
from rows join tree using (host, raw) join pure using (host, template)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_best_fit_packing, op2_license_scan, op3_secret_scan, op4_quality_rules, op5_passage_dedup, op6_simhash, op7_media_columns, op8_size_tiered_shards, op9_url_filter, op10_mixing, op11_collocations, op12_hard_negatives, op13_decontamination]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": op4_sql(), "op8_size_tiered_shards": op8_sql(), "op9_url_filter": op9_sql(), "op10_mixing": OP10_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_decontamination": OP13_SQL}
