"""The queries that apply the operators of this subpackage to the test tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written into ZIP archives in the shared folder and read back by ranges."""
    from .common import gone_at_exit, new_folder
    from .warc import read_archives, write_archives

    path = new_folder(spark, "archives")
    write_archives(read(spark, sf_dir, "pages"), path)
    gone_at_exit(spark, path)
    found = read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links at a cosine of 0.95 or more, and its component."""
    from .vectors import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of fingerprints within four bits."""
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it is over 2048 tokens long."""
    from .tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of the size of the corpus holds each document, at 97 % of the sources' greatest entropy."""
    from .mixing import mixture

    docs = read(spark, sf_dir, "documents")
    return mixture(docs).drawn(docs.select("doc_id", "source"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence families, by the trained paragraph classifier and the templates."""
    from .licences import scan, train

    docs = read(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the documents."""
    from .langid import dictionaries, held_out, identify

    docs = read(spark, sf_dir, "documents")
    found = identify(docs, dictionaries(docs.where(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base kinds, and all spans with the linked parts."""
    from .secrets import BASE_KINDS, secret_spans

    found = secret_spans(read(spark, sf_dir, "documents"), reach=None)
    base = f"filter(spans, s -> s.kind in {BASE_KINDS})"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of low quality and, given that, of toxicity; the chain learns from labels."""
    from .toxicity import best_limit, score, train

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    chain, unseen = train(docs, labels.withColumn("low_quality", 1 - F.col("quality")), ("low_quality", "toxic"))
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= best_limit(unseen, "toxic"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, the items that they come from, and how many further items have a window
    of which each word is a place off at most."""
    from .decontam import benchmark_matches, contamination

    found = contamination(benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_ids").cast("long").alias("n_near"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by its cheapest edits."""
    from .conversations import damaged, digests, repair

    rows = read(spark, sf_dir, "conversations")
    return digests(repair(damaged(rows), rows.select("conv_id")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 50 best documents."""
    from .ranking import build, ranked, terms

    asked = terms(read(spark, sf_dir, "benchmark"), "item_id", "text")
    found = ranked(build(read(spark, sf_dir, "documents"), asked), asked, 50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens, packed into sequences of 2048."""
    from .packing import packed, pieces

    return packed(pieces(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_archives,
        op2_embedding_near_dedup,
        op3_simhash_near_dedup,
        op4_token_counts,
        op5_source_mixing,
        op6_licence_scan,
        op7_language_id,
        op8_secret_scan,
        op9_toxicity_chain,
        op10_benchmark_decontamination,
        op11_conversation_repair,
        op12_ranked_search,
        op13_best_fit_packing,
    )
}

_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archives": """
with page as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
first as (select digest, max(page_id) as first from page where n >= 1000 group by digest)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
    case when f.first <> page_id then 'revisit' else 'response' end as record_type,
    case when f.first <> page_id then f.first end as refers_to
from page left join first f using (digest)
""",
    "op2_embedding_near_dedup": """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a)
select e.vec_id, (select count(*) from link l where l.a = e.vec_id) as n_links, min(r.b) as component_id, min(r.b) = e.vec_id as kept
from embeddings e join reach r on r.a = e.vec_id group by e.vec_id
""",
    "op10_benchmark_decontamination": f"""
with item as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null and item_id is not null),
win as (
    select distinct item_id, least(len(w), 13) as n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') as phrase
    from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from item where len(w) > 0)
),
doc as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
gram as (
    select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as phrase
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from doc), (select distinct n from win) where k + n - 1 <= len(w)
),
found as (select a.doc_id, a.k, a.n, w.item_id from gram a join win w on a.n = w.n and a.phrase = w.phrase),
hit as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id
),
items as (
    select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
    from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id
),
place as (select doc_id, k, w[k] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from doc)),
part as (select phrase, n, unnest(range(0, n)) as j, unnest(string_split(phrase, ' ')) as word from (select distinct phrase, n from win)),
often as (select word, count(*) as often from place group by word),
rarest as (select phrase, n, least.j as j, least.word as word from (select phrase, n, arg_min({{'j': j, 'word': part.word}}, coalesce(often, 0)) as least from part left join often using (word) group by phrase, n)),
begin as (select distinct r.phrase, r.n, p.doc_id, p.k - r.j + x.off as s from rarest r join place p using (word), (values (-1), (0), (1)) x(off)),
close as (
    select b.phrase, b.n, b.doc_id, b.s from begin b join part a using (phrase) join place p on p.doc_id = b.doc_id and p.word = a.word
    where p.k between b.s + a.j - 1 and b.s + a.j + 1 group by b.phrase, b.n, b.doc_id, b.s having count(distinct a.j) = b.n
),
near as (
    select doc_id, count(*) as n_near from (select distinct c.doc_id, w.item_id from close c join win w using (phrase)) c
    where not exists (select 1 from found f where f.doc_id = c.doc_id and f.item_id = c.item_id) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated, coalesce(n_near, 0) as n_near
from doc d left join hit using (doc_id) left join items using (doc_id) left join near using (doc_id)
""",
    "op11_conversation_repair": r"""
with recursive crc as (
    select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
),
keyed as (select conv_id, turn, role, text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
dealt as (
    select conv_id, turn, role, coalesce(text, ' ') as text, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: cast(ascii(substr(k, i, 1)) as bigint))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as deal
    from keyed, crc
),
hurt as (
    select conv_id, turn, case when deal = 4 then 'user' else coalesce(role, ' ') end as role,
        case deal when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case deal when 0 then 0 when 3 then 2 else 1 end)) as copy
    from dealt
),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
    from hurt
),
line as (
    select *, case when last = '' then 'blank' when nth > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
        lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) as pair
    from placed
),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
    from line group by conv_id
),
ins(q, p, n, lines) as (
    values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (3, 2, 1, chr(10) || 'user:'),
        (2, 3, 1, chr(10) || 'assistant:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')
),
kept(p, initial, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
forced(p, q, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
edit as (
    select p, i, conv_id, p as q, 4 as cost, 'D' as e, '' as lines from line, (values (0), (1), (2), (3)) s(p)
    union all
    select p, i, conv_id, q, case when fault is null then 0 else 3 end, 'K', chr(10) || role || ':' || text
    from line join kept on initial = substr(role, 1, 1) where fault is null or fault = 'truncated'
    union all
    select p, i, conv_id, q, case when fault is null then 3 else 6 end, 'R', chr(10) || f.role || ':' || text
    from line, forced f where fault is null or fault = 'truncated'
),
way as (
    select conv_id, cast(0 as bigint) as i, 0 as q, {'cost': cast(0 as bigint), 'audit': '', 'lines': ''} as w from counts
    union all
    select v.conv_id, v.i + 1, e.q, min({'cost': cast(v.w.cost + 3 * ins.n + e.cost as bigint), 'audit': v.w.audit || repeat('I', ins.n) || e.e, 'lines': v.w.lines || ins.lines || e.lines})
    from way v join ins on ins.q = v.q join edit e on e.conv_id is not distinct from v.conv_id and e.i = v.i + 1 and e.p = ins.p
    group by v.conv_id, v.i, e.q
),
best as (
    select c.conv_id, min({'cost': cast(v.w.cost + 3 * ins.n as bigint), 'audit': v.w.audit || repeat('I', ins.n), 'lines': v.w.lines || ins.lines}) as w
    from counts c join way v on v.conv_id is not distinct from c.conv_id and v.i = c.n join ins on ins.q = v.q and ins.p in (0, 3) group by c.conv_id
)
select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(w.cost, 0) as cost, coalesce(w.audit, '') as audit, sha256(coalesce(substr(w.lines, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join counts c on c.conv_id is not distinct from k.conv_id left join best b on b.conv_id is not distinct from k.conv_id
""",
    "op12_ranked_search": f"""
with word as (select doc_id, unnest({_WORDS.format("text")}) as term from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from word group by doc_id, term),
len as (select doc_id, count(*) as n from word group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as length from len),
weight as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, total group by term, docs),
item as (select distinct item_id, unnest({_WORDS.format("text")}) as term from benchmark where text is not null),
scored as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length))))) as bigint) as score
    from item join tf using (term) join weight using (term) join len using (doc_id), total group by item_id, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
""",
}
