"""The queries of this subpackage and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoveil.llm import (bpe, chat, collocations, decontaminate, fingerprint, language, learning, merkle, ngram_join, packing, secrets,
                            token_codec, toxicity, warc)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SECRET_KINDS = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
     r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24)]

_SECRETS_SQL = "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), e as (" + " union all ".join(
    f"select r, {i} as k, '{kind}' as kind, {least} as least, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as ms, "
    f"regexp_extract_all(t, '{p}', {g}) as vs from d" for i, (kind, p, g, least) in enumerate(_SECRET_KINDS)) + """),
u as (select r, k, kind, least, unnest(gaps[1:len(ms)]) as gap, unnest(ms) as m, unnest(vs) as v, unnest(range(1, len(ms) + 1)) as i from e),
g as (select r, k, kind, length(m) as width, length(v) as value, least,
  sum(length(gap) + length(m)) over (partition by r, k order by i) as stop from u),
s as (select r, k, kind, (stop - width)::bigint as start, stop::bigint as stop from g where value >= least),
a as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans
  from s group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (r)"""


@query("op8_secret_ledger", _SECRETS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans_per_document(table(spark, sf_dir, "documents")))


_CHAT_SQL = """
with t as (select conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') as text,
    coalesce(floor(turn / 256), -4611686018427387904)::bigint as block from conversations),
n as (select *, row_number() over (partition by conv_id, block order by turn nulls first, role nulls first, text) as place from t),
p as (select distinct conv_id, role as participant from t where role is not null and role <> 'system'),
s as (select n.conv_id, participant, block, (place - 1) // 256 as sub, place, text || '<|im_end|>' as body,
    n.role is not distinct from participant as own,
    case when n.role is not distinct from participant then '<|im_start|>assistant' || chr(10)
         when n.role = 'system' then '<|im_start|>system' || chr(10)
         else '<|im_start|>user name=' || coalesce(n.role, 'unknown') || chr(10) end as head
  from n join p on n.conv_id is not distinct from p.conv_id),
o as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, participant order by block, sub, place)
    - length(body) - 1 as begun from s),
g as (select conv_id, participant, block, sub, string_agg(head || body || chr(10), '' order by place) as text,
    min(begun - length(head)) as start,
    coalesce(string_agg(begun::bigint || ':' || (begun + length(body))::bigint, ',' order by place) filter (own), '') as mask
  from o group by conv_id, participant, block, sub)
select conv_id, participant, row_number() over (partition by conv_id, participant order by block, sub) - 1 as part,
  start::bigint as start, text, mask from g"""


@query("op10_perspectives", _CHAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query("op7_slack_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.round_trip(table(spark, sf_dir, "documents"))


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * i + 1}, 5))::int >> {shift}) & 31) + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))


@query("op3_archive_merge", f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select *, min(page_id) over (partition by sha) as first from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes, {_BASE32_SQL} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_phrase_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query("op1_byte_network")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_toxicity_network")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.with_scores(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op6_spaced_seeds")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of the decimal id: 8 shifts for each byte.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1),
    lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

_MERKLE_SQL = f"""
with recursive claims as (select *, case when {_CRC_SQL} % 7 = 0 then n_chars + 1 else n_chars end as claimed from documents),
leaves as (select doc_id, lang, {_leaf('n_chars')} as leaf, {_leaf('claimed')} as claim from claims),
numbered as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from leaves),
nodes as (select 0 as level, lang, idx, leaf as h, n from numbered union all
  select level + 1, lang, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from nodes where n > 1 group by level, lang, idx // 2, n),
subroots as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops as (select 0 as level, idx, subroot as h, n from subroots union all
  select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from tops where n > 1 group by level, idx // 2, n),
steps as (
  select m.doc_id, m.lang, m.leaf, m.idx as place, l.level, (m.idx >> l.level) & 1 as odd, s.h from numbered m
    join (select distinct lang, level from nodes where n > 1) l on m.lang is not distinct from l.lang
    left join nodes s on s.lang is not distinct from m.lang and s.level = l.level and s.idx = xor(m.idx >> l.level, 1)
  union all
  select m.doc_id, m.lang, m.leaf, m.idx, 1000 + l.level, (r.idx >> l.level) & 1, s.h from numbered m
    join subroots r on m.lang is not distinct from r.lang join (select distinct level from tops where n > 1) l on true
    left join tops s on s.level = l.level and s.idx = xor(r.idx >> l.level, 1)),
paths as (select lang, place, list(case when h is null then 'N' when odd = 1 then 'L' || h else 'R' || h end order by level) as path,
  coalesce(string_agg(h, '' order by level), '') as siblings from steps group by lang, place),
folded as (select m.*, coalesce(siblings, '') as siblings, list_reduce(list_prepend(claim, coalesce(path, [])), lambda a, x: sha256(
    case when x[1] = 'L' then x[2:] || a when x[1] = 'R' then a || x[2:] else a end)) as folded_root
  from numbered m left join paths p on m.lang is not distinct from p.lang and m.idx = p.place)
select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, folded_root, folded_root = root as verified
from folded f join subroots r on f.lang is not distinct from r.lang, (select h as root from tops where n = 1)"""


@query("op11_postorder_manifest", _MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(merkle.build(docs, {"n_chars": merkle.tampered(F.col("doc_id"), F.col("n_chars"))}))


_PHRASE_SQL = """
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select r, lang, unnest(range(len(s))) as piece, unnest(s) as body from (select r, lang, string_split_regex(t, '[.,;:!?\n-\r]') as s from d)),
w as (select r, lang, piece, unnest(range(len(s))) as pos, unnest(s) as w1 from (select *, regexp_extract_all(body, '[^ \t]+') as s from p)),
g as (select lang, w1, """ + ", ".join(
    f"lead(w1, {i}) over (partition by r, piece order by pos) as w{i + 1}" for i in range(1, 5)) + """ from w),
f as (""" + " union all ".join(
    f"select lang, [{', '.join(f'w{i}' for i in range(1, k + 1))}] as ws, count(*) as n from g where w{k} is not null group by all"
    for k in range(1, 6)) + """),
total as (select lang, sum(n)::bigint as n from f where len(ws) = 1 group by lang),
c as (select lang, ws, n as a from f where len(ws) > 1 and n >= 100),
v as (select i, j from range(1, 6) a(i), range(1, 6) b(j) where i < j),
gone as (select distinct lang, ws from (select lang, a as b, ws[i:j] as ws from c join v on j <= len(ws) and j - i + 1 < len(ws))
  join c using (lang, ws) where 100 * b >= 100 * a),
cuts as (select lang, ws, a, unnest(range(1, len(ws))) as k from c anti join gone using (lang, ws)),
s as (select cuts.lang, cuts.ws, cuts.a, k, x.n as l, y.n as r, total.n as n, (1000::hugeint * a * total.n) // (x.n::hugeint * y.n) as score
  from cuts join f x on x.lang = cuts.lang and x.ws = cuts.ws[:k] join f y on y.lang = cuts.lang and y.ws = cuts.ws[k + 1:] join total on total.lang = cuts.lang),
b as (select *, array_to_string(ws, ' ') as phrase from s qualify row_number() over (partition by lang, ws order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from b qualify rank <= 2000"""


@query("op12_setm_phrases", _PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_folded_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents")))
