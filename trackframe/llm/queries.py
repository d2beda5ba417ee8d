"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from trackframe.llm.ann import nearest_neighbours
from trackframe.llm.bpe import decode_column, encode_documents
from trackframe.llm.common import in_fold, read
from trackframe.llm.divergence import source_divergence
from trackframe.llm.exact import exact_duplicates
from trackframe.llm.langid import language_model, predict_language
from trackframe.llm.lm import score_texts
from trackframe.llm.neardup import near_duplicates
from trackframe.llm.packing import pack_documents
from trackframe.llm.quality import quality_model, score_quality
from trackframe.llm.registry import ORACLES, QUERIES, query
from trackframe.llm.tokenfiles import read_documents, write_tokens
from trackframe.llm.toxicity import score_toxicity, toxicity_model
from trackframe.llm.trie import prefix_trie, turns_of, with_shared_starts
from trackframe.llm.urls import url_verdicts
from trackframe.session import scratch_path

#: Which hosts and paths are allowed or blocked.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def _classified(scored, folds, fold, least):
    return scored.select(
        "doc_id",
        in_fold("doc_id", folds, fold).alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
    )


@query("op1_quality_mil")
def quality_mil(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    return _classified(score_quality(docs, model), 3, 1, 0.5)


@query("op2_bag_minhash")
def bag_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).drop("key")


@query("op3_toxicity_subwords")
def toxicity_subwords(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return _classified(score_toxicity(docs, model), 3, 1, 0.7)


@query("op4_mixture_packing")
def mixture_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(read(spark, sf_dir, "documents"), path)


@query("op5_kmeans_tree")
def kmeans_tree(spark, sf_dir):
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_backoff_automaton")
def backoff_automaton(spark, sf_dir):
    held_out = in_fold("doc_id", 7, 2)
    return score_texts(read(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query(
    "op7_url_templates",
    r"""
    with rest as (
        select page_id, case when instr(url, '://') > 0
            then substr(url, instr(url, '://') + 3) else '' end as r from pages
    ), parsed as (
        select page_id,
            translate(regexp_extract(r, '^[^/?#]*', 0),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
        from rest
    ), ruled as (
        select *, case
            when (host = 'www.example.com' or host like '%.www.example.com')
                and starts_with(path, '/en/') then 'www.example.com/en/'
            when (host = 'example.com' or host like '%.example.com')
                and starts_with(path, '/en/') then 'example.com/en/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
            end as rule
        from parsed
    ), labelled as (
        select *, case when rule in ('com/', 'www.example.com/en/') then 'allow'
            when rule is not null then 'block' end as says from ruled
    ), paths as (
        select host, path, count(*) filter (says = 'allow') as good,
            count(*) filter (says = 'block') as bad,
            string_split(path, '/') as parts
        from labelled group by host, path
    ), shaped as (
        select *, list_transform(parts, lambda s: regexp_replace(regexp_replace(
            s, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g')) as shapes from paths
    ), steps as (
        select host, path, unnest(range(len(parts))) as pos, parts, shapes from shaped
    ), placed as (
        select host, path, pos, parts[pos + 1] as part, shapes[pos + 1] as shape,
            array_to_string(shapes[1:pos], '/') as before from steps
    ), variable as (
        select host, pos, before, shape from placed
        group by all having count(distinct part) > 8
    ), templates as (
        select p.host, p.path, string_agg(
            case when v.host is not null then '{' || p.shape || '}' else p.part end, '/'
            order by p.pos) as template
        from placed p left join variable v
            on v.host = p.host and v.pos = p.pos and v.before = p.before and v.shape = p.shape
        group by p.host, p.path
    ), known as (
        select s.host, s.path, array_to_string(s.shapes, '/') as shape, t.template, s.good, s.bad
        from shaped s join templates t using (host, path)
    ), branches as (
        select host, shape, template, sum(good) as good, sum(bad) as bad,
            case when sum(good) + sum(bad) = 0 then -1
                else floor(4 * (sum(good) + 1) / (sum(good) + sum(bad) + 2)) end as degree
        from known group by all
    ), merged as (
        select host, shape, degree, sum(good) as good, sum(bad) as bad from branches group by all
    ), hosts as (
        select host, (sum(good) + 2) / (sum(good) + sum(bad) + 4) as hp from branches group by host
    ), judged as (
        select b.host, b.shape, b.template,
            (m.good + 4 * h.hp) / (m.good + m.bad + 4) < 0.25 as reject
        from branches b join merged m using (host, shape, degree) join hosts h using (host)
    )
    select page_id, l.host, l.path, rule,
        coalesce(says, case when reject then 'block' else 'allow' end) as verdict, k.template
    from labelled l join known k using (host, path)
        join judged j on j.host = k.host and j.shape = k.shape and j.template = k.template
    """,
)
def url_templates(spark, sf_dir):
    return url_verdicts(read(spark, sf_dir, "pages"), RULES)


@query(
    "op8_exact_dedup",
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        row_number() over (same order by doc_id desc) = 1 as kept,
        sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
)
def exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents"))


@query("op9_language_cnn")
def language_cnn(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    judged = predict_language(docs, language_model(docs))
    return judged.select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


@query("op10_byte_bpe")
def byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    encoded = encode_documents(read(spark, sf_dir, "documents"), path, pattern)
    decoded = encoded.withColumn("bytes", decode_column(F.col("ids"), path, pattern))
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query(
    "op11_run_length_divergence",
    r"""
    with rows as (
        select row_number() over () as r, coalesce(lang, '') as lang,
            coalesce(source, '') as source, coalesce(text, '') as text from documents
    ), words as (
        select r, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from rows
    ), counted as (
        select lang, source, term, count(*) as n from words group by all
    ), kept as (
        select lang, term, count(*) as n from words group by all having count(distinct r) >= 10
    ), langs as (
        select lang, count(*) as v, sum(n) as total from kept group by lang
    ), groups as (
        select g.lang, g.source, coalesce(l.v, 0) as v, l.total, coalesce(sum(c.n), 0) as n
        from (select distinct lang, source from rows) g left join langs l using (lang)
            left join (select c.* from counted c semi join kept using (lang, term)) c
                on c.lang = g.lang and c.source = g.source
        group by all
    ), cells as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as own,
            1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) as p,
            1 + (1000000000::hugeint * (k.n + 2)) // (g.total + 2 * g.v) as q
        from groups g join kept k using (lang)
            left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term
    ), pairs as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
        from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source
        group by all
    ), found as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
        union all
        select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from cells
        where own > 0 and p > q
    ), ranked as (
        select lang, source, part, item, value::bigint as value, row_number() over (
            partition by lang, source, part order by value desc, item)::int as rank
        from found
    )
    select * from ranked where part = 'pair' or rank <= 10
    """,
)
def run_length_divergence(spark, sf_dir):
    return source_divergence(read(spark, sf_dir, "documents"))


@query("op12_token_files")
def token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    write_tokens(
        read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_documents(spark, path)


@query(
    "op13_prefix_trie",
    """
    with turns as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (partition by conv_id order by turn nulls first,
                sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
            ) as rn
        from conversations where conv_id is not null
    ), ids as (
        select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(
            list_prepend(4294967295::bigint,
                list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::bigint)),
                lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))
            ), 4294967295) % 9 as h
        from (select distinct conv_id from turns)
    ), rebuilt as (
        select i.conv_id, t.rn, t.role, t.text from ids i join turns t
            on t.conv_id = i.base and t.rn <= i.h
        union all
        select t.conv_id, t.rn, t.role, t.text from ids i join turns t
            on t.conv_id = i.conv_id and t.rn > i.h
    ), prefixes as (
        select conv_id, 0 as depth, []::struct(role varchar, text varchar)[] as path, 0 as size from ids
        union all
        select conv_id, row_number() over w, list({'role': role, 'text': text}) over w, strlen(text)
        from rebuilt window w as (partition by conv_id order by rn)
    ), nodes as (
        select path, depth, min(conv_id) as conv_id, count(*) as n, any_value(size) as size
        from prefixes group by path, depth
    ), children as (
        select path[1:depth - 1] as path, count(*) as n from nodes where depth > 0 group by 1
    ), ends as (
        select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha
        from (select conv_id, max_by(path, depth) as path from prefixes group by conv_id)
        group by path
    ), subtrees as (
        select a.path, sum((v.n - 1) * v.size) as saved, count(*) filter (c.n is null) as leaves
        from nodes v join prefixes a on a.conv_id = v.conv_id and a.depth <= v.depth
            left join children c on c.path = v.path
        group by a.path
    )
    select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n as n_convs,
        coalesce(c.n, 0) as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens,
        coalesce(e.sha, sha256('')) as ends_sha256
    from nodes v join subtrees s on s.path = v.path left join children c on c.path = v.path
        left join ends e on e.path = v.path
        left join nodes p on v.depth > 0 and p.path = v.path[1:v.depth - 1]
    """,
)
def conversation_trie(spark, sf_dir):
    turns = with_shared_starts(turns_of(read(spark, sf_dir, "conversations")))
    return prefix_trie(turns).drop("key", "parent_key")


def load():
    return QUERIES, ORACLES
