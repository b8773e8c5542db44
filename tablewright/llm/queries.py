"""The registered queries of this package and their SQL twins, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES, ORACLES = {}, {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; every executor has them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_winnowing_fingerprints")
def _(spark, sf_dir):
    from tablewright.llm.winnowing import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


@query("op6_bpe_round_trip")
def _(spark, sf_dir):
    from tablewright.llm.bpe import VOCABULARY, encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


@query("op9_warc_bundles", """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
o as (select payload_digest, payload_bytes, max(page_id) as owner from d where payload_bytes >= 1000 group by all)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when owner is null or owner = d.page_id then 'response' else 'revisit' end as record_type,
  case when owner <> d.page_id then owner end as refers_to
from d left join o using (payload_digest, payload_bytes)""")
def _(spark, sf_dir):
    from tablewright.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op10_hypergeometric_mix")
def _(spark, sf_dir):
    from tablewright.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query("op3_link_graph_verdicts")
def _(spark, sf_dir):
    from tablewright.llm.url_graph import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def _license_sql() -> str:
    """Phrases by word position and templates by comparing every line with each of them."""
    from tablewright.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, words_of

    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"({quoted(words_of(p))}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {quoted(sorted(set(words_of(t))))})" for label, t in TEMPLATES)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {words("coalesce(text, '')")} as w from documents),
p as (select * from (values {phrases}) v(pw, label)),
s as (select r, i - 1 as pos, label from d, p, unnest(generate_series(1, len(w))) u(i) where w[i] = pw[1] and list_slice(w, i, i + len(pw) - 1) = pw),
b as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as base from s group by r),
t as (select * from (values {templates}) v(label, tw)),
l as (select r, {words("line")} as lw from (select r, unnest(string_split(text, chr(10))) as line from d)),
m as (select r, label, len(list_intersect(lw, tw)) / len(tw) as c from l, t where len(lw) > 0),
h as (select r, list(distinct label) as found, max(c) as c from m where c >= {THRESHOLD} - 1e-9 group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(c, 0.0)::double end as score
from d left join b using (r) left join h using (r)"""


@query("op5_license_set_join", _license_sql())
def _(spark, sf_dir):
    from tablewright.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_byte_cnn_language")
def _(spark, sf_dir):
    from tablewright.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op8_adaptive_dimension_scan")
def _(spark, sf_dir):
    from tablewright.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


_WORDS_SQL = r"""select doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') as w from documents"""
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near_sql(shingle: int, percent: int, more: str = "") -> str:
    """Sets of shingles, pairs by shared shingles, and everything that is reachable."""
    return f"""
with recursive d as ({_WORDS_SQL.format(text=_LOWER_SQL)}),
s as (select distinct doc_id, array_to_string(w[i: i + {shingle - 1}], ' ') as g from d, unnest(generate_series(1, greatest(len(w) - {shingle - 1}, 1))) u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id{more}
from d left join n using (doc_id) join (select node as doc_id, min(seen) as component_id from r group by node) c using (doc_id)"""


_SUBSTRINGS_SQL = f"""
with d as ({_WORDS_SQL.format(text="coalesce(text, '')")}),
v as (select doc_id, i, array_to_string(w[i: i + 19], ' ') as v from d, unnest(generate_series(1, len(w) - 19)) u(i)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by v order by doc_id, i) as c from v) where c > 1),
gone as (select distinct doc_id, i + j as i from again, range(20) x(j)),
k as (select d.doc_id, i, w[i] as w, gone.i is not null as removed from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d) d left join gone using (doc_id, i))
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join (select doc_id, count(*) filter (removed) as n, string_agg(w, ' ' order by i) filter (not removed) as kept from k group by doc_id) using (doc_id)"""


@query("op1_substring_dedup", _SUBSTRINGS_SQL)
def _(spark, sf_dir):
    from tablewright.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_circulant_minhash", _near_sql(5, 75, ", c.component_id = d.doc_id as kept"))
def _(spark, sf_dir):
    from tablewright.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("_n")


@query("op13_periodic_runs")
def _(spark, sf_dir):
    from tablewright.llm.periodic_runs import detect_runs, runs_text

    found = detect_runs(table(spark, sf_dir, "documents"), looping=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(runs_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


_CONVERSATIONS_SQL = r"""
with recursive crc(i, k, v) as (
  select i::bigint, 0, i::bigint from range(256) r(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc where k < 8),
codes as (select list(v order by i) as codes from crc where k = 8),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as bytes from conversations),
faulty as (select g.*, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda x, y: xor(x >> 8, codes[(xor(x, y) & 255) + 1])), 4294967295) % 20 as f from given g, codes),
damaged as (select conv_id, turn, case when f = 4 then 'user' else role end as role,
  case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from faulty, lateral (select unnest(range(case f when 0 then 0 when 3 then 2 else 1 end))) c(copy)),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed from damaged),
e as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
  lag(role[1]) over (partition by conv_id order by i) as before from r),
k as (select *, case when trimmed = '' then 'blank' when again then 'duplicate' when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from e),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (i > 1 and before || role[1] not in ('su', 'ua', 'au') or i > 1 and (before = '' or role = '')) as illegal, max(i) as n from k group by conv_id),
-- 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
inserts(q, q2, c, a, t) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
kept(q, initial, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
made(q, role, q2) as (values (0, 'user', 2), (1, 'user', 2), (3, 'user', 2), (2, 'assistant', 3)),
edits as (
  select conv_id, i, q, q as q2, 2 as c, 'D' as a, '' as t from k, (values (0), (1), (2), (3)) v(q)
  union all select conv_id, i, q, q2, case fault when 'truncated' then 5 else 0 end, 'K', chr(10) || role || ':' || text from k, kept where role[1] = initial and fault not in ('blank', 'duplicate')
  union all select conv_id, i, q, q2, 1 + case fault when 'truncated' then 5 else 0 end, 'R', chr(10) || m.role || ':' || text from k, made m where fault not in ('blank', 'duplicate')),
steps as (select e.conv_id, e.i, s.q, e.q2, s.c + e.c as c, s.a || e.a as a, s.t || e.t as t from edits e join inserts s on s.q2 = e.q),
least as (
  select conv_id, 0::bigint as i, 0 as q, {'c': 0, 'a': '', 't': ''} as best from counted
  union all select l.conv_id, l.i + 1, s.q2, min({'c': l.best.c + s.c, 'a': l.best.a || s.a, 't': l.best.t || s.t})
  from least l join steps s on s.conv_id is not distinct from l.conv_id and s.i = l.i + 1 and s.q = l.q group by l.conv_id, l.i, s.q2),
ended as (select l.conv_id, min({'c': l.best.c + s.c, 'a': l.best.a || s.a, 't': l.best.t || s.t}) as best
  from least l join counted n on n.conv_id is not distinct from l.conv_id and n.n = l.i join inserts s on s.q = l.q and s.q2 in (0, 3) group by l.conv_id)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counted n on n.conv_id is not distinct from d.conv_id left join ended e on e.conv_id is not distinct from d.conv_id"""


@query("op12_conversation_repair", _CONVERSATIONS_SQL)
def _(spark, sf_dir):
    from tablewright.llm.conversations import damage_and_repair

    return damage_and_repair(table(spark, sf_dir, "conversations"))


@query("op11_count_tree_join", _near_sql(3, 90))
def _(spark, sf_dir):
    from tablewright.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))
