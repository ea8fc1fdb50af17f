"""One thin query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtally.llm.bpe import encode_decode
from seqtally.llm.chroma import align
from seqtally.llm.collocations import collocations
from seqtally.llm.common import table
from seqtally.llm.decontamination import decontaminate
from seqtally.llm.digests import crc_of_ids
from seqtally.llm.neighbours import near_vectors
from seqtally.llm.packing import pack
from seqtally.llm.passages import remove_repeats
from seqtally.llm.pii import find_personal_data
from seqtally.llm.sharding import shard_documents
from seqtally.llm.simhash import near_duplicates
from seqtally.llm.tokenfiles import read_tokens, write_tokens
from seqtally.llm.toxicity import held_out, score, train
from seqtally.llm.tries import conversations, prefix_trie, with_shared_openings


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: a document's bytes stand in for a recording with unsigned 8-bit samples."""
    return align(table(spark, sf_dir, "documents"), "doc_id", F.encode("text", "UTF-8")).withColumnRenamed("id", "doc_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_of_ids(read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"))))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_openings(conversations(table(spark, sf_dir, "conversations"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_passages, op4_toxicity, op5_chroma, op6_personal_data, op7_token_files, op8_bpe, op9_simhash, op10_vectors, op11_collocations, op12_prefix_trie, op13_decontamination)}


#: op3: every window of 13 words, the smallest document that has it, and the words under windows of a smaller one.
OP3_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13)),
firsts as (select g, min(doc_id) as least from windows group by g),
gone as (select doc_id, i from windows join firsts using (g) where least < doc_id),
covered as (select words.doc_id, word, words.i, max(gone.i) over (partition by words.doc_id order by words.i rows between 12 preceding and current row) is not null as removed
 from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i),
sums as (select doc_id, count(*) as n, count(*) filter (removed) as r, coalesce(string_agg(word, ' ' order by i) filter (not removed), '') as kept from covered group by doc_id)
select docs.doc_id, coalesce(n, 0) as n_words, coalesce(r, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join sums using (doc_id)
"""


#: op11: all phrases of up to five words that stand within pieces, counted; the least score of the cuts of the frequent ones.
OP11_SQL = r"""
with docs as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as p from docs)),
grams as (select lang, list_slice(w, i, i + k - 1) as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest(range(1, 6)) as k) where len(w) >= k)),
f as (select lang, g, count(*) as f from grams group by lang, g),
totals as (select lang, sum(f)::bigint as n from f where len(g) = 1 group by lang),
cand as (select lang, g, f as a from f where len(g) > 1 and f >= 100),
inner_ as (select lang, list_slice(g, i, i + k - 1) as g, max(a) as most from (select lang, g, a, k, unnest(range(1, len(g) - k + 2)) as i from cand, (select unnest(range(2, 5)) as k) where k < len(g)) group by all),
kept as (select cand.* from cand left join inner_ using (lang, g) where most is null or 100 * most < 100 * a),
cuts as (select lang, g, a, unnest(range(1, len(g))) as k from kept),
scored as (select cuts.*, x.f as l, y.f as r, n, (1000::hugeint * a * n // (x.f::hugeint * y.f))::bigint as score
 from cuts join f x on x.lang = cuts.lang and x.g = list_slice(cuts.g, 1, k) join f y on y.lang = cuts.lang and y.g = list_slice(cuts.g, k + 1, len(cuts.g)) join totals on totals.lang = cuts.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score from lowest)
select * from ranked where rank <= 2000
"""

#: op12: rebuilt conversations, all their prefixes, and sums over the prefixes below each.  crc32 is eight shifts a byte.
OP12_SQL = r"""
with own as (select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as w from conversations where conv_id is not null group by conv_id),
crc as (select c, w, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, v: case when (case when v >= 0 then xor(a, v) else a end) % 2 = 1 then xor((case when v >= 0 then xor(a, v) else a end) // 2, 3988292384) else (case when v >= 0 then xor(a, v) else a end) // 2 end), 4294967295) % 6 as h from own),
built as (select crc.c, list_concat(list_slice(coalesce(own.w, []), 1, h), list_slice(crc.w, h + 1, len(crc.w))) as w from crc left join own on own.c = crc.c - crc.c % 100),
pre as (select c, w, d, list_slice(w, 1, d) as p from (select c, w, unnest(range(0, len(w) + 1)) as d from built)),
node as (select d, p, min(c) as c, count(*) as n, coalesce(string_agg(c::varchar, ',' order by c) filter (len(w) = d), '') as ends, case when d > 0 then length(p[d].t) else 0 end as chars from pre group by d, p),
kids as (select d - 1 as d, list_slice(p, 1, d - 1) as p, count(*) as k from node where d > 0 group by all),
one as (select node.*, coalesce(k, 0) as k from node left join kids using (d, p)),
below as (select a as d, list_slice(p, 1, a) as p, sum((n - 1) * chars) as saved, count(*) filter (k = 0) as leaves from (select *, unnest(range(0, d + 1)) as a from one) group by all)
select one.c as conv_id, one.d as depth, up.c as parent_conv_id, one.n as n_convs, one.k as n_children, leaves as n_leaves, saved::bigint as saved_tokens, sha256(one.ends) as ends_sha256, case when one.d = 0 then '' else substring(sha256(strlen(one.p[one.d].r)::varchar || ':' || one.p[one.d].r || one.p[one.d].t), 1, 32) end as turn_digest
from one join below on below.d = one.d and below.p = one.p left join node up on up.d = one.d - 1 and up.p = list_slice(one.p, 1, one.d - 1)
"""

#: op13: every window of ten words of items (or all words of shorter ones), where it stands in documents, and the words under it.
OP13_SQL = r"""
with docs as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
spots as (select r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct k from wins) where len(w) >= k)),
found as (select r, i, item_id, wins.k from spots join wins using (k, g)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from found) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item_id::varchar as item from found where item_id is not null) group by r)
select docs.doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""


def oracle_sql() -> dict[str, str]:
    """The other queries need tokenizers, trained models, XXH64 or graph searches; tests hold them against brute force."""
    return {"op3_passages": OP3_SQL, "op11_collocations": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_decontamination": OP13_SQL}
