"""Registered queries of the subpackage: thin ``opN_<name>`` wrappers, production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import backoff_scores
from .bpe import encode_documents
from .embedding_dedup import embedding_components
from .language_id import held_out, identify_languages
from .license_index import AGREE, LOOKUPS, TEMPLATES, scan_licenses
from .line_templates import drop_recurring_lines
from .minhash_dedup import minhash_components
from .phrase_mining import mine_phrases
from .source_mix import mix_sources
from .substring_dedup import remove_repeats
from .trie_counts import count_tokens, load_piece_scores
from . import turn_repair
from .turn_repair import damaged_turns, repair_report
from .winnowing import edited_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: 4-word shingles, Jaccard similarity 0.8 or more."""
    return minhash_components(_table(spark, sf_dir, "documents"), width=4, percent=80)


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` left after the removal of every repeated window of 35 words."""
    return (remove_repeats(_table(spark, sf_dir, "documents"), width=35, want_text=False)
            .select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")))


ORACLES["op4_substring_dedup"] = r"""
with words as (
  select rowid as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from (select row_number() over (order by doc_id) as rowid, doc_id, text from documents)),
starts as (select r, unnest(range(1, len(w) - 33)) as i, w from words where len(w) >= 35),
windows as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from starts),
places as (select r, i from windows where h in (select h from windows group by h having count(*) > 1)),
gone as (select distinct r, i + j as i from places, (select unnest(range(0, 35)) as j)),
kept as (
  select r, array_to_string(list(word order by i), ' ') as kept, count(*) as n from (
    select r, unnest(w) as word, generate_subscripts(w, 1) as i from words) s
  where not exists (select 1 from gone g where g.r = s.r and g.i = s.i) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from words left join kept using (r)
"""


@_query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of ``documents`` and what they decode to, as digests."""
    return encode_documents(_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                            outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weight by label: 1.5 for good quality, 0.5 for bad (documents without a label count as 1)."""
    return _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 0.5).alias("weight"))


@_query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of ``documents`` mixed at weights 1, 2, 3, repeating; at most three epochs."""
    return (mix_sources(_table(spark, sf_dir, "documents"), label_weights(spark, sf_dir))
            .select("doc_id", "size", "source_size", "target", "taken"))


ORACLES["op8_source_mix"] = r"""
with weight as (select doc_id, avg(quality + 0.5) as q from labels group by doc_id),
sized as (
  select d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         case when q > 0 then q else 1.0 end as q,
         (('0x' || md5(coalesce(d.doc_id::varchar, '') || ':' || coalesce(md5(text), ''))[1:12])::bigint + 0.5)
           / 281474976710656.0 as u
  from documents d left join weight w on d.doc_id = w.doc_id),
keyed as (select *, -ln(u) / q as key from sized),
totals as (select source, sum(size) as source_size from sized group by source),
ranked as (select *, (row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 as weight,
                  3 * source_size as cap from totals),
ratio as (select *, cap / weight as r from ranked),
filled as (
  select *, sum(cap) over below + r * (sum(weight) over () - sum(weight) over below) <= sum(source_size) over () as is_full
  from ratio window below as (order by r range between unbounded preceding and current row)),
targets as (
  select source, source_size,
         case when is_full then cap::double
              else least(cap::double, weight * (sum(source_size) over () - coalesce(sum(cap) filter (is_full) over (), 0))
                   / sum(weight) filter (not is_full) over ()) end as target
  from filled),
running as (
  select k.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
         sum(size) over (partition by k.source order by key, doc_id) as upto
  from keyed k join targets t on k.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target::double as target,
       (case when size = 0 then 0 else size * (epochs
         + (upto - size / 2 <= target - epochs * source_size)::int) end)::bigint as taken
from running
"""


@_query
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` left after the removal of templates that recur across documents."""
    return (drop_recurring_lines(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")))


ORACLES["op6_line_templates"] = r"""
with docs as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as parts from documents),
cut as (
  select r, text, i, trim(parts[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as line
  from (select *, unnest(range(1, len(parts) + 1)) as i from docs)),
lines as (
  select *, regexp_split_to_array(line, '[\x20\x09-\x0D]+') as w from cut where line <> ''),
words as (
  select *, case when regexp_matches(w[1], '[0-9]') then '<*>' else w[1] end as w1,
            case when regexp_matches(w[2], '[0-9]') then '<*>' else w[2] end as w2,
            case when regexp_matches(w[3], '[0-9]') then '<*>' else w[3] end as w3 from lines),
leafed as (select *, concat_ws('|', len(w)::varchar, w1, w2, w3) as leaf from words),
hits as (select * from leafed where leaf in (select leaf from leafed group by leaf having count(distinct text) >= 8)),
uniq as (select leaf, line, any_value(w) as w, count(distinct text) as texts from hits group by leaf, line),
cells as (
  select leaf, line, texts, pos, case when regexp_matches(word, '[0-9]') then '<*>' else word end as word
  from (select leaf, line, texts, unnest(w) as word, generate_subscripts(w, 1) as pos from uniq)),
const as (select leaf, pos, word from cells where word <> '<*>' group by all having sum(texts) >= 8),
templates as (
  select c.leaf, c.line, string_agg(coalesce(k.word, '<*>'), ' ' order by c.pos) as template
  from cells c left join const k on c.leaf = k.leaf and c.pos = k.pos and c.word = k.word
  group by c.leaf, c.line having count(k.word) >= 0.5 * count(*)),
placed as (select h.r, h.text, h.i, t.template from hits h join templates t on h.leaf = t.leaf and h.line = t.line),
holders as (
  select distinct template, text from placed
  where template in (select template from placed group by template having count(distinct text) >= 8)),
own_lines as (
  select distinct text, line, len(line) as chars, w from lines where text in (select text from holders)),
ends as (
  select text, line, chars, ('0x' || md5(unnest(['<' || array_to_string(w[1:6], ' '),
                                                 '>' || array_to_string(w[greatest(len(w) - 5, 1):], ' ')]))[1:15])::bigint as e
  from own_lines),
shared as (select e from ends group by e having count(distinct text) > 1),
marked as (select text, line, chars, e, e in (select e from shared) as is_shared from ends),
copies as (
  select text, min(e) as start
  from (select text, line, any_value(chars) as chars, min(e) filter (is_shared) as e from marked group by text, line)
  group by text having 100 * sum(chars) filter (e is not null) >= 80 * sum(chars)),
held as (
  select text, e, c.start, sum(chars) as chars from marked m join copies c using (text) where is_shared group by text, e, c.start),
starts as (select e, start, count(*) as n from held group by e, start),
named as (
  select e, start as name
  from (select *, row_number() over (partition by e order by n desc, start desc) as k, sum(n) over (partition by e) as total
        from starts) where k = 1 and 2 * n > total),
votes as (select text, h.start, name, sum(chars) as chars from held h left join named using (e) group by text, h.start, name),
families as (
  select text, coalesce(name, start) as family
  from (select *, row_number() over (partition by text order by name is null, chars desc, name desc) as k from votes) where k = 1),
recurring as (
  select template from holders h left join families f on h.text = f.text
  group by template having count(distinct coalesce('family ' || f.family, 'text ' || h.text)) >= 8),
gone as (select distinct r, i from placed where template in (select template from recurring)),
kept as (
  select d.r, string_agg(d.part, chr(10) order by d.i) as kept
  from (select r, unnest(parts) as part, generate_subscripts(parts, 1) as i from docs) d
  where not exists (select 1 from gone g where g.r = d.r and g.i = d.i) group by d.r)
select doc_id, coalesce(len(parts), 0)::bigint as n_lines,
       (select count(*) from gone g where g.r = docs.r)::bigint as n_dropped,
       sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (r)
"""


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op2_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of ``documents``, of their edited texts and of the next documents, compared."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``embeddings``: equal labels and cosine 0.98 or more."""
    return embedding_components(_table(spark, sf_dir, "embeddings"), least=0.98)


ORACLES["op1_embedding_near_dedup"] = r"""
with recursive unit as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null),
links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other)
select r.vec_id, (select count(*) from links l where l.a = r.vec_id)::bigint as n_links,
       min(r.other) as component_id, min(r.other) = r.vec_id as kept
from reach r group by r.vec_id
"""


@_query
def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff trigram score of every document by the counts of all others."""
    return backoff_scores(_table(spark, sf_dir, "documents"), order=3)


@_query
def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram reading of a public piece vocabulary."""
    return count_tokens(_table(spark, sf_dir, "documents"),
                        load_piece_scores(public_tokenizers.path("piece_bpe_32k.model")))


ORACLES["op10_minhash_near_dedup"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by all),
links as (
  select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, min(other) = d.doc_id as kept
from reach d left join sizes using (doc_id) group by d.doc_id
"""


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after planted damage."""
    return repair_report(damaged_turns(_table(spark, sf_dir, "conversations")), alive="alive")


@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document, found by a positional index of rare words."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TEMPLATE_ROWS = ",\n  ".join(
    f"({n}, '{t.label}', {str(t.base).lower()}, {_sql_list(t.words)}, "
    + "[" + ", ".join(f"{{'q': {q}, 'k': {_sql_list(k)}}}" for q, k in t.key_places) + "])"
    for n, t in enumerate(TEMPLATES))

ORACLES["op12_license_scan"] = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
templates(t, label, base, words, keys) as (values
  {_TEMPLATE_ROWS}),
cells as (
  select t, word, min(q) - 1 as q
  from (select t, unnest(words) as word, generate_subscripts(words, 1) as q from templates) group by all),
hits as (
  select r, word, i - 1 as i from (select r, unnest(w) as word, generate_subscripts(w, 1) as i from docs)
  where word in (select word from cells)),
df as (select word, count(distinct r) as df from hits group by word),
rare as (
  select t, word, q, count(*) over (partition by t) as m
  from (select *, row_number() over (partition by t order by df, q) as rank from cells join df using (word))
  where rank <= {LOOKUPS}),
starts as (
  select h.r, x.t, h.i - x.q as start from hits h join rare x on h.word = x.word
  group by all having count(*) >= ceil({AGREE} * any_value(x.m))),
places as (
  select s.r, p.label, p.base, s.start,
         len(list_filter(range(1, len(p.words) + 1), lambda j: s.start + j >= 1 and d.w[s.start + j] = p.words[j]))
           / len(p.words)::double as share
  from starts s join templates p on s.t = p.t join docs d on s.r = d.r
  where len(list_filter(p.keys, lambda k: s.start + k.q >= 0 and d.w[s.start + k.q + 1:s.start + k.q + len(k.k)] = k.k))
        = len(p.keys)),
found as (
  select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
         array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels,
         array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
  from places group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from docs left join found using (r)
"""


@_query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language of ``documents``."""
    return mine_phrases(_table(spark, sf_dir, "documents"), max_words=3, min_count=10, inside_percent=50, top=2000)


ORACLES["op13_phrase_collocations"] = r"""
with pieces as (
  select lang, unnest(parts) as piece, d * 1000000000 + generate_subscripts(parts, 1) as p from (
    select coalesce(lang, 'und') as lang, row_number() over () as d, regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as parts
    from documents)),
words as (
  select lang, p, unnest(w) as w1, generate_subscripts(w, 1) as i
  from (select lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces)),
next as (
  select lang, w1, lead(w1) over piece as w2, lead(w1, 2) over piece as w3 from words window piece as (partition by p order by i)),
one as (select lang, w1, count(*) as f from next group by all),
two as (select lang, w1, w2, count(*) as f from next where w2 is not null group by all),
three as (select lang, w1, w2, w3, count(*) as f from next where w3 is not null group by all having count(*) >= 10),
cuts as (
  select t.lang, t.w1, t.w2, null as w3, t.f as a, 1 as k, x.f as l, y.f as r
  from two t join one x on x.lang = t.lang and x.w1 = t.w1 join one y on y.lang = t.lang and y.w1 = t.w2 where t.f >= 10
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 1, x.f, y.f
  from three t join one x on x.lang = t.lang and x.w1 = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 2, x.f, y.f
  from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.w1 = t.w3),
scored as (select *, (1000000 * a::hugeint * a::hugeint) // (l::hugeint * r::hugeint) as score from cuts),
lowest as (
  select * from scored qualify row_number() over (partition by lang, w1, w2, w3 order by score, k) = 1),
held as (
  select lang, w1, w2, max(f) as f from (
    select lang, w1, w2, f from three union all select lang, w2, w3, f from three) group by all),
free as (
  select s.*, concat_ws(' ', s.w1, s.w2, s.w3) as phrase from lowest s
  left join held h on s.w3 is null and h.lang = s.lang and h.w1 = s.w1 and h.w2 = s.w2
  where h.f is null or 100 * h.f < 50 * s.a),
totals as (select lang, sum(f) as n from one group by lang)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from free)
join totals using (lang) where rank <= 2000
"""


def _crc_table() -> str:
    """The 256 values of CRC-32 by its rule: eight halvings of the byte."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return table


def _edit_rows() -> str:
    """(state, initial or null, piece of audit, state behind, cost): up to three inserts, then an edit of the row."""
    rows = []
    for state in range(4):
        at = state
        for inserts in range(4):
            cost, piece = inserts * turn_repair.INSERT_COST, turn_repair.INSERT * inserts
            rows.append((state, "null", piece + turn_repair.DELETE, at, cost + turn_repair.DELETE_COST))
            for initial in "suao":
                if (at, initial) in turn_repair.KEPT_STATE:
                    rows.append((state, f"'{initial}'", piece + turn_repair.KEEP, turn_repair.KEPT_STATE[at, initial], cost))
                rows.append((state, f"'{initial}'", piece + turn_repair.REROLE, turn_repair.NEXT_STATE[at],
                             cost + turn_repair.REROLE_COST))
            at = turn_repair.NEXT_STATE[at]
    return ", ".join(f"({q}, {i}, '{p}', {to}, {c})" for q, i, p, to, c in rows)


ORACLES["op11_conversation_repair"] = rf"""
with recursive
crc as (select {_crc_table()} as t),
keyed as (
  select dense_rank() over (order by conv_id nulls first) as c, conv_id, turn, coalesce(role, ' ') as role,
         coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
coded as (
  select k.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)),
                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as fault
  from keyed k, crc),
damaged as (
  select c, turn, case when fault = 4 then 'user' else role end as role,
         case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from coded where fault <> 0),
numbered as (
  select *, row_number() over (partition by c order by turn nulls first, md5(length(role) || ':' || role || ':' || text), copy) as i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as mark,
         case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as initial
  from damaged),
marked as (
  select *, mark = '' as blank, mark <> '' and row_number() over (partition by c, role, text order by i) > 1 as copied,
         lag(initial) over (partition by c order by i) as before
  from numbered),
turns as (select *, not blank and not copied and mark not in ('.', '!', '?') as cut from marked),
edits(q, initial, piece, q2, cost) as (values {_edit_rows()}),
best(c, i, q, b) as (
  select c, max(i) + 1, q, struct_pack(cost := cost, audit := audit)
  from turns, (values (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) e(q, cost, audit) group by c, q, cost, audit
  union all
  select t.c, t.i, e.q, min(struct_pack(cost := b.b.cost + e.cost
                                        + case when t.cut and e.initial is not null then 3 else 0 end, audit := e.piece || b.b.audit))
  from best b join turns t on t.c = b.c and t.i = b.i - 1
  join edits e on e.q2 = b.q and (e.initial is null or (not t.blank and not t.copied and e.initial = t.initial))
  group by t.c, t.i, e.q),
chosen as (select c, b.cost as cost, b.audit as audit from best where i = 1 and q = 0),
letters as (
  select c, unnest(string_split(audit, '')) as edit, generate_subscripts(string_split(audit, ''), 1) as j from chosen),
placed as (select *, count(*) filter (edit <> 'I') over (partition by c order by j) as i from letters),
left_rows as (
  select p.c, p.j, p.edit, case when p.edit = 'K' then t.role end as role, case when p.edit = 'I' then '' else t.text end as text,
         row_number() over (partition by p.c order by p.j) as e
  from placed p left join turns t on t.c = p.c and t.i = p.i and p.edit <> 'I' where p.edit <> 'D'),
headed as (
  select *, bool_or(e = 1 and edit = 'K' and left(role, 1) = 's') over (partition by c) as headed from left_rows),
repaired as (
  select c, string_agg(coalesce(role, case when (e - headed::int) % 2 = 1 then 'user' else 'assistant' end) || ':' || text,
                       chr(10) order by j) as text
  from headed group by c),
counted as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (copied) as duplicate, count(*) filter (cut) as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from turns group by c)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(r.text, '')) as repaired_sha256
from (select distinct c, conv_id from keyed) k
left join counted using (c) left join chosen using (c) left join repaired r using (c)
"""
