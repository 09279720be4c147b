"""One registered query per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_root
from . import bpe, collocations, decontaminate, difference_cover, embedding_dedup, langid, pii, rans, simhash, spelling, suffix_dedup, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@query()
def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


#: SHA-1 as 160 binary digits, five at a time into the base-32 alphabet.
ARCHIVE_SQL = """with p as (select page_id, coalesce(html, '') as h from pages),
  f as (select h, min(page_id) as first from p group by h),
  d as (select h, first, (unhex(sha1(h))::bit)::varchar as b from f),
  e as (select h, first, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16*substr(b, 5*i + 1, 1)::int + 8*substr(b, 5*i + 2, 1)::int + 4*substr(b, 5*i + 3, 1)::int + 2*substr(b, 5*i + 4, 1)::int
      + substr(b, 5*i + 5, 1)::int, 1)), '') as digest from d)
  select page_id, strlen(p.h)::bigint as payload_bytes, digest as payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
  from p join e using (h)"""


@query(ARCHIVE_SQL)
def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), target)
    return warc.read_archives(spark, target).drop("url")


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "token-files")
    rans.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target)
    return rans.read_files(spark, target)


@query()
def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Windows of fifty words by list slices; a hit's words up to the next hit.
WINDOWS_SQL = r"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
  win as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
  h as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as s from win),
  f as (select s, min(doc_id) as d from h group by s),
  hit as (select h.doc_id, i, lead(i) over (partition by h.doc_id order by i) as nxt from h join f on f.s = h.s where d < h.doc_id),
  gone as (select doc_id, unnest(range(i, least(i + 50, coalesce(nxt, i + 50)))) as p from hit),
  word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
  kept as (select k.doc_id, string_agg(word, ' ' order by k.p) as t from word k anti join gone g on g.doc_id = k.doc_id and g.p = k.p group by k.doc_id)
  select w.doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
  from w left join (select doc_id, count(*) as n from gone group by doc_id) using (doc_id) left join kept using (doc_id)"""

#: Texts in hexadecimal digits, so that cuts may fall inside a character; runs of
#: hits merge to removed spans, and what lies between them is kept.
BYTES_SQL = r"""with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  win as (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from b where len(h) >= 200),
  s as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as k from win),
  f as (select k, min(struct_pack(d := doc_id, i := i)) as first from s group by k),
  hit as (select s.doc_id, s.i, lag(s.i) over w as prev, lead(s.i) over w as nxt from s join f on f.k = s.k
    where struct_pack(d := s.doc_id, i := s.i) > first window w as (partition by s.doc_id order by s.i)),
  run as (select doc_id, i, sum(case when prev is null or i - prev > 100 then 1 else 0 end) over (partition by doc_id order by i) as r from hit),
  span as (select doc_id, min(i) as a, max(i) + 100 as z from run group by doc_id, r),
  cut as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as z0 from span),
  part as (select c.doc_id, a, substr(h, 2 * z0 + 1, 2 * (a - z0)) as t from cut c join b on b.doc_id = c.doc_id
    union all select c.doc_id, max(z), any_value(substr(h, 2 * (select max(z) from span s where s.doc_id = c.doc_id) + 1)) from span c join b on b.doc_id = c.doc_id group by c.doc_id),
  kept as (select doc_id, string_agg(t, '' order by a) as t from part group by doc_id)
  select b.doc_id, len(b.h) // 2 as n_bytes, coalesce(n, 0) as n_removed, coalesce(r, 0) as n_spans, sha256(unhex(coalesce(t, b.h))) as kept_sha256
  from b left join (select doc_id, sum(z - a)::bigint as n, count(*) as r from span group by doc_id) using (doc_id) left join kept using (doc_id)"""


@query(WINDOWS_SQL)
def op10_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover.remove_repeats(table(spark, sf_dir, "documents"), scratch(spark, "windows"))


@query("""with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
  links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
    and list_cosine_similarity(a.e, b.e) >= 0.95e0),
  reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
  least as (select a, min(b) as c from reach group by a)
  select e.vec_id, coalesce(n, 0) as n_links, c as component_id, e.vec_id = c as kept from embeddings e join least on a = e.vec_id
    left join (select a as k, count(*) as n from links group by a) on k = e.vec_id""")
def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@query()
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query(BYTES_SQL)
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), scratch(spark, "suffixes"))


#: Words with their place, pairs and triples by the words that follow in the piece.
COLLOCATIONS_SQL = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
  w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
  g as (select lang, 1 as m, unnest(ws) as phrase from w
    union all select lang, 2, array_to_string(ws[i:i + 1], ' ') from (select lang, ws, unnest(range(1, len(ws))) as i from w)
    union all select lang, 3, array_to_string(ws[i:i + 2], ' ') from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from w)),
  f as (select lang, m, phrase, count(*) as a from g group by all),
  n as (select lang, sum(a)::bigint as n from f where m = 1 group by lang),
  c as (select *, string_split(phrase, ' ') as ws from f where m > 1 and a >= 10),
  longer as (select lang, array_to_string(ws[i:i + 1], ' ') as phrase, max(a) as longer from (select *, unnest([1, 2]) as i from c where m = 3) group by all),
  k as (select c.*, unnest(range(1, m)) as k from c left join longer using (lang, phrase) where longer is null or 100*longer < 50*a),
  s as (select k.lang, k.phrase, k.a, k, x.a as l, y.a as r, (1000000::hugeint*k.a*k.a // (x.a::hugeint*y.a))::bigint as score
    from k join f x on x.lang = k.lang and x.phrase = array_to_string(ws[1:k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(ws[k + 1:], ' ')),
  b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from b join n using (lang) qualify rank <= 2000"""


@query(COLLOCATIONS_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Rules of the query: (host, start of the path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URL_RULES_SQL = f"""with u as (select page_id, coalesce(url, '') as url from pages),
  p as (select page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) as path from u),
  r(h, p, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
  best as (select page_id, host, path, max(struct_pack(n := length(h) + length(r.p), m := length(h), rule := h || r.p, verdict := verdict)) as b
    from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id, host, path)
  select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict from p left join best on best.page_id = p.page_id and best.host = p.host and best.path = p.path"""


@query(URL_RULES_SQL)
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


#: CRC-32 bit by bit, once per document and run; near words by equal remainders: at
#: one place for a replaced letter, the whole shorter word for a deleted one.
SPELLING_SQL = """with r as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
  d as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from r group by all),
  x as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as bytes from d),
  h as (select run, n, xor(4294967295, list_reduce(list_transform(range(4*len(bytes)), lambda i:
      case when i % 8 = 0 then ('0x' || substr(bytes, i//4 + 1, 2))::bigint else 0 end),
    lambda c, b: xor(xor(c, b) >> 1, case when xor(c, b) % 2 = 1 then 3988292384 else 0 end), 4294967295)) as h from x),
  e as (select n, case when h % 199 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end as word from h),
  w as (select word, sum(n)::bigint as n from e where len(word) >= 6 group by word having sum(n) >= 5),
  c as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, len(word) + 1)) as i from w)),
  p as (select a.word as u, b.word as v from c a join c b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select c.word, w.word from c join w on c.rest = w.word union select w.word, c.word from c join w on c.rest = w.word),
  k as (select u, v, w.n as v_n from p join w on w.word = v),
  b as (select u, count(*) as n_near, min(struct_pack(m := -v_n, form := v)) as best from k group by u),
  j as (select word, n, coalesce(n_near, 0) as n_near, case when -b.best.m >= 5*n then b.best.form end as form, case when -b.best.m >= 5*n then -b.best.m end as form_n
    from w left join b on u = word),
  t as (with recursive f as (select word, word as root, form as next from j union all select f.word, j.word, j.form from f join j on j.word = f.next)
    select word, root from f where next is null)
  select word, form, root, n, n_near, form_n from j join t using (word)"""


@query(SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), noise=199)
