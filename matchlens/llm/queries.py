"""The registered query of each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import (
    context_trees, conversations, embedding_neighbours, id_files, lexical_search, mixing, packing, quality_classifier, quality_rules, repeats, simhash,
    token_counts, web_archive,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_stats(table(spark, sf_dir, "documents"))


@query
def op4_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.score(table(spark, sf_dir, "documents"))


@query
def op5_hyperplane_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (size, sizes, goals, uses) = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col(size).alias("size"),
        F.col(sizes)[0].alias("source_size"),
        F.col(goals)[0].alias("target"),
        (F.col(size) * F.col(uses)).alias("taken"),
    )


@query
def op8_segment_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_perfect_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = id_files.write_id_files(docs)
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return files.records(keys).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = web_archive.build_index(web_archive.write_archives(pages))
    return index.records(pages.select("url"))


@query
def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_all(conversations.damage(rows), rows)


@query
def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Plain SQL of the queries that have one, over whole tables.
CHECKS["op5_hyperplane_links"] = """with recursive v as (
  select row_number() over () as rid, vec_id, label, cast(embedding as double[]) as e from embeddings
), s as (
  select rid, vec_id, label, e,
    vec_id is not null and label is not null and coalesce(len(e), 0) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 as able
  from v
), l as (
  select a.rid as a, b.rid as b from s a join s b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e)
  where a.able and b.able and list_cosine_similarity(a.e, b.e) >= 0.98
), r as (
  select rid, rid as other from s
  union
  select r.rid, l.b from r join l on l.a = r.other
), n as (select a as rid, count(*) as n_links from l group by a),
c as (select r.rid, min(s.vec_id) as component_id from r join s on s.rid = r.other group by r.rid)
select s.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, coalesce(s.vec_id = c.component_id, true) as kept
from s join c on c.rid = s.rid left join n on n.rid = s.rid
"""

CHECKS["op6_run_length_index"] = """with d as (
  select row_number() over () as rid, coalesce(doc_id, 9223372036854775807) as o, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
  select rid, o, i, substr(h, 2 * i + 1, 100) as s from (select rid, o, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from d) x
), f as (select s, min(o) as o from w group by s having min(o) < max(o)),
m as (
  select w.rid, w.i, w.i - lag(w.i) over (partition by w.rid order by w.i) as step from w join f on f.s = w.s where w.o > f.o
), g as (select rid, i, sum(case when step <= 50 then 0 else 1 end) over (partition by rid order by i) as span from m),
p as (select rid, span, min(i) as a, max(i) + 50 as b from g group by rid, span),
k as (
  select rid, a, coalesce(lag(b) over (partition by rid order by a), 0) as since, b from p
  union all select d.rid, len(d.h) // 2, coalesce(max(p.b), 0), null from d left join p on p.rid = d.rid group by d.rid, d.h
), t as (
  select d.rid, sum(k.b - k.a) as n_removed, count(k.b) as n_spans,
    sha256(unhex(string_agg(substr(d.h, 2 * k.since + 1, 2 * (k.a - k.since)), '' order by k.a, k.since))) as kept
  from k join d on d.rid = k.rid group by d.rid
)
select d.doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, t.n_spans, t.kept as kept_sha256 from d join t on t.rid = d.rid
"""

CHECKS["op11_capture_index"] = """with p as (
  select page_id, coalesce(html, '') as html, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), l as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) end as leader from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
  case when leader is not null and page_id is distinct from leader then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from leader then leader end as refers_to
from l
"""

CHECKS["op12_hirschberg_repair"] = """with recursive crc as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as t
  from (select unnest(range(0, 256)) as n) x
), given as (
  select dense_rank() over (order by conv_id nulls first) as cid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations
), faulty as (
  select g.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: cast(ascii(ch) as bigint))),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as fault
  from given g, crc
), damaged as (
  select cid, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from faulty where fault <> 0
), numbered as (
  select *, row_number() over (partition by cid order by turn nulls first, role, text, copy) as i from damaged
), flags as (
  select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by cid, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, substr(role, 1, 1) as r
  from numbered
), figures as (
  select cid, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not blank and not again) as truncated
  from flags group by cid
), pairs as (
  select cid, count(*) as illegal from (select cid, lag(r) over (partition by cid order by i) || r as two, i from flags) x
  where i > 1 and two not in ('su', 'ua', 'au') group by cid
), inserts(p, q, cost, word, said) as (
  values (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'),
    (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')
), edits(q, r, s, cost, word, name) as (
  select q, cast(null as varchar), q, 3, 'D', cast(null as varchar) from (values (0), (1), (2), (3)) t(q)
  union all select * from (values (0, cast(null as varchar), 2, 2, 'R', 'user'), (1, null, 2, 2, 'R', 'user'), (2, null, 3, 2, 'R', 'assistant'), (3, null, 2, 2, 'R', 'user'),
    (0, 's', 1, 0, 'K', cast(null as varchar)), (0, 'u', 2, 0, 'K', null), (1, 'u', 2, 0, 'K', null), (3, 'u', 2, 0, 'K', null), (2, 'a', 3, 0, 'K', null)) k
), walk as (
  select distinct cid, cast(0 as bigint) as i, 0 as s, {'cost': cast(0 as bigint), 'audit': '', 'said': ''} as best from given
  union all
  select f.cid, f.i, e.s, min({
    'cost': cast(w.best.cost + n.cost + e.cost + case when e.word <> 'D' and f.cut then 1 else 0 end as bigint),
    'audit': w.best.audit || n.word || e.word,
    'said': w.best.said || n.said || case e.word when 'D' then '' else chr(10) || coalesce(e.name, f.role) || ':' || f.text end
  })
  from walk w join flags f on f.cid = w.cid and f.i = w.i + 1
  join inserts n on n.p = w.s
  join edits e on e.q = n.q and (e.r is null or e.r = f.r) and (e.word = 'D' or not (f.blank or f.again))
  group by f.cid, f.i, e.s
), ends as (
  select w.cid, min({'cost': cast(w.best.cost + n.cost as bigint), 'audit': w.best.audit || n.word, 'said': w.best.said || n.said}) as best
  from walk w join (select cid, max(i) as i from walk group by cid) m on m.cid = w.cid and m.i = w.i
  join inserts n on n.p = w.s and n.q in (0, 3) group by w.cid
)
select c.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated,
  coalesce(p.illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit, sha256(substr(e.best.said, 2)) as repaired_sha256
from (select distinct cid, conv_id from given) c join ends e on e.cid = c.cid
left join figures f on f.cid = c.cid left join pairs p on p.cid = c.cid
"""

CHECKS["op13_geometric_blocks"] = r"""with items as (
  select row_number() over () as rid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark
), asked as (select rid, item_id, term, count(*) as times from (select rid, item_id, unnest(terms) as term from items) x group by all),
d as (
  select row_number() over () as did, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), s as (select count(*) as big_n, cast(sum(len(terms)) as bigint) as big_l from d where len(terms) > 0),
p as (select did, doc_id, len(terms) as n, term, count(*) as tf from (select did, doc_id, terms, unnest(terms) as term from d) x where term in (select term from asked) group by did, doc_id, len(terms), term),
w as (select term, cast(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term),
v as (select p.did, p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))) as x from p join w on w.term = p.term, s),
t as (select a.rid, a.item_id, v.did, v.doc_id, cast(sum(a.times * v.x) as bigint) as score from asked a join v on v.term = a.term group by all),
r as (select *, row_number() over (partition by rid order by score desc, doc_id nulls last) as rank from t where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""
