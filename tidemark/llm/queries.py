"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, language, lm_score, near_copies, packing, quality, secrets, spelling, suffixes, trie, vectors, warc

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_permutation_index": vectors.op2_permutation_index,
    "op3_multi_index_dedup": vectors.op3_multi_index_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_bpe": bpe.op6_bpe,
    "op7_warc": warc.op7_warc,
    "op8_chosen_path_join": near_copies.op8_chosen_path_join,
    "op9_language_id": language.op9_language_id,
    "op10_lm_scoring": lm_score.op10_lm_scoring,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_suffix_dedup": suffixes.op13_suffix_dedup,
}
ORACLE_SQL = {
    "op3_multi_index_dedup": """
        with recursive v as (
            select vec_id, embedding::double[] as e from embeddings
            where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach as (
            select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
        )
        select vec_id, (select count(*) from links where a = vec_id) as n_links,
               least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as component_id,
               vec_id = least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as kept
        from embeddings
    """,
    "op7_warc": """
        with p as (
            select page_id, coalesce(html, '') as payload from pages
        ), q as (
            select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
                   min(page_id) over (partition by sha256(payload)) as first from p
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and first is distinct from page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and first is distinct from page_id then first end as refers_to
        from q
    """,
    "op11_spelling_variants": """
        with recursive runs as (
            select coalesce(doc_id::varchar, '') || ':' as head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
            from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
        ), hashed as (
            select run, n, xor(4294967295, list_reduce(list_transform(range(strlen(head || run)), lambda i: (instr('0123456789ABCDEF', substr(hex(encode(head || run)), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(head || run)), 2 * i + 2, 1)) - 1),
                lambda c, b: list_reduce(range(8), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, xor(c, b)), 4294967295)) as h
            from runs where length(run) >= 6
        ), words as (
            select word, sum(n)::bigint as n from (
                select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed
            ) where length(word) >= 6 group by word having sum(n) >= 5
        ), holes as (
            select distinct word, n, i, substr(word, 1, i) || chr(1) || substr(word, i + 2) as swapped, substr(word, 1, i) || substr(word, i + 2) as shorter from (select word, n, unnest(range(length(word))) as i from words)
        ), pairs as (
            select a.word, b.word as near, b.n as m from holes a join holes b on a.swapped = b.swapped and a.word <> b.word
            union
            select a.word, b.word, b.n from holes a join words b on a.shorter = b.word
            union
            select b.word, a.word, a.n from holes a join words b on a.shorter = b.word
        ), best as (
            select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from pairs group by word
        ), forms as (
            select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 5 * w.n then b.near end as form, case when b.m >= 5 * w.n then b.m end as form_n from words w left join best b using (word)
        ), chain as (
            select word, word as at, form as next from forms union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next
        )
        select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word and c.next is null
    """,
    "op12_prefix_trie": """
        with recursive own as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null
        ), convs as (
            select conv_id, conv_id - conv_id % 5 as base, count(*) as n,
                   xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                       lambda c, b: list_reduce(range(8), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, xor(c, b)), 4294967295)) % 9 as h
            from own group by conv_id
        ), turns as (
            select c.conv_id, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.base and o.pos < c.h
            union all
            select c.conv_id, least(c.h, coalesce(b.n, 0)) + o.pos - c.h, o.role, o.text from convs c join own o on o.conv_id = c.conv_id and o.pos >= c.h left join convs b on b.conv_id = c.base
        ), paths as (
            select c.conv_id, coalesce(max(t.pos) + 1, 0) as length from convs c left join turns t on t.conv_id = c.conv_id group by c.conv_id
        ), prefixes as (
            select conv_id, 0::bigint as depth, 'root' as seq, 0::bigint as bytes, length from paths
            union all
            select p.conv_id, p.depth + 1, sha256(p.seq || strlen(t.role) || ':' || t.role || t.text), strlen(t.text)::bigint, p.length from prefixes p join turns t on t.conv_id = p.conv_id and t.pos = p.depth
        ), nodes as (
            select seq, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved,
                   sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = length), '')) as ends_sha256
            from prefixes group by seq
        ), edges as (
            select distinct p.seq as parent, c.seq as child from prefixes p join prefixes c on c.conv_id = p.conv_id and c.depth = p.depth + 1
        ), leaves as (
            select seq from nodes where seq not in (select parent from edges)
        ), below as (
            select seq as top, seq as node from nodes union all select b.top, e.child from below b join edges e on e.parent = b.node
        ), totals as (
            select b.top, sum(n.saved)::bigint as saved_tokens, (count(*) filter (where l.seq is not null))::bigint as n_leaves
            from below b join nodes n on n.seq = b.node left join leaves l on l.seq = b.node group by b.top
        )
        select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, (select count(*) from edges x where x.parent = n.seq) as n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
        from nodes n join totals t on t.top = n.seq left join edges e on e.child = n.seq left join nodes u on u.seq = e.parent
    """,
    "op13_suffix_dedup": """
        with texts as (
            select doc_id, hex(encode(coalesce(text, ''))) as t from documents
        ), starts as (
            select doc_id, p, substr(t, 2 * p + 1, 100) as s from (select doc_id, t, unnest(range(0, length(t) // 2 - 49)) as p from texts where doc_id is not null and length(t) >= 100)
        ), seen as (
            select s, min(doc_id) as first from starts group by s having count(*) > 1
        ), gone as (
            select doc_id, p, p + 50 as e, max(p + 50) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as before
            from (select distinct doc_id, p from starts join seen using (s) where first < doc_id)
        ), runs as (
            select doc_id, sum(case when before is null or p > before then 1 else 0 end) over (partition by doc_id order by p) as run, p, e from gone
        ), spans as (
            select doc_id, run, min(p) as a, max(e) as b from runs group by doc_id, run
        ), cuts as (
            select doc_id, a, b, lead(a) over (partition by doc_id order by a) as next, row_number() over (partition by doc_id order by a) as i from spans
        ), kept as (
            select c.doc_id, sum(c.b - c.a)::bigint as n_removed, count(*) as n_spans,
                   string_agg(case when c.i = 1 then substr(t.t, 1, 2 * c.a) else '' end || substr(t.t, 2 * c.b + 1, coalesce(2 * (c.next - c.b), length(t.t))), '' order by c.a) as rest
            from cuts c join (select doc_id, any_value(t) as t from texts group by doc_id) t using (doc_id) group by c.doc_id
        )
        select t.doc_id, (length(t.t) // 2)::bigint as n_bytes, coalesce(k.n_removed, 0)::bigint as n_removed, coalesce(k.n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k.rest, t.t))) as kept_sha256
        from texts t left join kept k using (doc_id)
    """,
}
