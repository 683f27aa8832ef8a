"""Queries over the test tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, counts, jaccard, lines, middle, mixing, pii, quality, search, substrings, toxicity
from .common import load, sha256_hex


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(load(spark, sf_dir, "documents"), keep_text=False)


def op3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_ngrams(load(spark, sf_dir, "documents"), keep_text=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # every row has these; the own rules' further measures are reached by rows left only
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = quality.cascade(docs, measures=base)
    failed = " or ".join(f"({r.reject})" for r in quality.BASE)
    return df.select("doc_id", *base, F.expr(failed).alias("base_failed"), "kept")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(load(spark, sf_dir, "documents"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.quantised(load(spark, sf_dir, "embeddings"))
    return search.top_k(rows.filter("s_id % 50 = 0"), rows, 5)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), digests=True)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_runs(docs).select("doc_id", "ld_lines_removed", F.length("text").alias("kept_chars"), sha256_hex(F.col("text")).alias("kept_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled rows whose crc32 of the id as text is not 0 modulo 5."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic").filter("crc32(cast(doc_id as string)) % 5 != 0 and toxic is not null")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.train(docs.join(F.broadcast(toxicity.sampled(labels)), "doc_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    df = toxicity.score(docs, toxicity_model(spark, sf_dir))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    df = pii.find_pii(docs)
    base = [k for k in pii.KINDS if k.base]
    count = lambda kinds: [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in kinds]
    more = [k for k in pii.KINDS if not k.base]
    return df.select("doc_id", *count(base), F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(pii.KINDS).alias("spans"), *count(more))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = counts.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return df.select("*", (F.col("n_tokens") > 512).alias("over_limit"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = middle.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c[4:]}_chars")
    back = middle.restored(F.col("fim_text"), F.col("fim_form"))
    return df.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), chars("fim_prefix"), chars("fim_middle"), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    df = alignment.scored(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digests=True)
    return df.withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op3_ngrams": op3_ngrams,
    "op2_quality": op2_quality,
    "op4_jaccard": op4_jaccard,
    "op5_search": op5_search,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_counts": op11_counts,
    "op12_middle": op12_middle,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SQL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""list_sum(list_transform(range(1, len({_SQL_DIGITS}) + 1), lambda i: case when i % 2 = 1 then reverse({_SQL_DIGITS})[i]::int
    when reverse({_SQL_DIGITS})[i]::int > 4 then 2 * reverse({_SQL_DIGITS})[i]::int - 9 else 2 * reverse({_SQL_DIGITS})[i]::int end)) % 10 = 0"""
_SQL_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(replace(x, ' ', '')[5:] || replace(x, ' ', '')[1:4], ''),
    lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end)), lambda a, v: case when v < 10 then (a * 10 + v) % 97 else (a * 100 + v) % 97 end) = 1"""
_SQL_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(x, '.'), lambda p: len(regexp_replace(p, '^0+', '')) > 3 or try_cast(p as bigint) > 255)) = 0",
    "card": f"len({_SQL_DIGITS}) between 16 and 19 and {_SQL_LUHN}",
    "phone": f"len({_SQL_DIGITS}) between 8 and 15",
    "iban": f"contains('{pii.IBAN_SIZES}', replace(x, ' ', '')[1:2] || len(replace(x, ' ', ''))::varchar) and {_SQL_MOD97}",
    "ssn": "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}') and not regexp_matches(x, '^(000|666|9)') and not regexp_matches(x, '^...-00|-0000$')",
    "secret": "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z]')",
}
# The base patterns, as the operator has them but for look-behind and
# possessive repeats, which change what is tried and not what is found.
_SQL_FIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9-]+",
    "secret": r"[A-Za-z0-9_+/=-]{20,}",
}


def _pii_sql() -> str:
    parts, names = [], [k.name for k in pii.KINDS]
    for k in pii.KINDS:
        find = f"(?s)(.*?)({_SQL_FIND[k.name]})"
        score = "true" if k.base else f"""{k.prior} + case when regexp_matches(lower(substr(t, greatest(z[i] - len(m[i]) - {pii.NEAR}, 0) + 1,
            least(z[i] - len(m[i]), {pii.NEAR}))), '(^|[^a-z])({k.context})') then {k.bonus} else 0 end >= {pii.LEAST}"""
        valid = _SQL_VALID[k.name]
        if k.whole:
            score += " and not regexp_matches(case when z[i] > len(m[i]) then substr(t, z[i] - len(m[i]), 1) else '' end || ' ' || substr(t, z[i] + 1, 1), '[A-Za-z0-9]')"
        parts.append(f"""{k.name}_ as (select doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: ok[i] and {score}),
            lambda i: '{k.name}:' || (z[i] - len(m[i]))::varchar || ':' || z[i]::varchar) as {k.name} from (select doc_id, t, m,
            list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda s: len(s)))::bigint) as z,
            list_transform(m, lambda x: {valid}) as ok from (select doc_id, coalesce(text, '') as t,
            regexp_extract_all(coalesce(text, ''), '{find}', 0) as p, regexp_extract_all(coalesce(text, ''), '{find}', 2) as m from documents)))""")
    count = lambda base: ", ".join(f"len({k.name})::bigint as n_{k.name}" for k in pii.KINDS if k.base == base)
    base = " || ".join(k.name for k in pii.KINDS if k.base)
    joins = " ".join(f"join {n}_ using (doc_id)" for n in names[1:])
    return f"""with {', '.join(parts)} select doc_id, {count(True)}, sha256(array_to_string({base}, ',')) as base_sha256,
        array_to_string({' || '.join(names)}, ',') as spans, {count(False)} from {names[0]}_ {joins}"""


SQL: dict[str, str] = {
    "op2_quality": f"""
        with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
        tri as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
        twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
        rep as (select doc_id, count(distinct j)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id),
        m as (select d.doc_id, t, w, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(rep.n, 0)::bigint as n_repeat_words,
            list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from d left join rep using (doc_id)),
        two as (select doc_id, count(distinct w[i] || chr(1) || w[i + 1])::bigint as n_distinct_pairs
            from (select doc_id, w, unnest(range(1, len(w))) as i from d) group by doc_id),
        n as (select m.*, coalesce(n_distinct_pairs, 0) as n_distinct_pairs, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
            len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09\\x0B-\\x0D]*$'))) as n_ellipsis_lines,
            len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '^[\\x20\\x09\\x0B-\\x0D]*[-*\\x{{2022}}]'))) as n_bullet_lines,
            len(regexp_extract_all(t, '[\\x00-\\x08\\x0E-\\x1F\\x21-\\x40\\x5B-\\x60\\x7B-\\x7F]')) as n_marks, len(list_distinct(w)) as n_distinct_words,
            len(list_intersect(w, [{quality._STOP}])) as n_stop_words
            from m left join two using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            {' or '.join(f'({r.reject})' for r in quality.BASE)} as base_failed,
            not ({' or '.join(f'({r.reject})' for r in quality.BASE + quality.EXTRA)}) as kept from n""",
    "op3_ngrams": f"""
        with d as (select doc_id, {WORDS} as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
        hit as (select doc_id, i from (select *, min(doc_id) over (partition by g) as f from win) where f < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from hit),
        each as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as x from d),
        kept as (select doc_id, string_agg(x, ' ' order by j) as k, count(*) as c from each left join gone using (doc_id, j) where gone.doc_id is null group by doc_id)
        select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(c, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
        from d left join kept using (doc_id)""",
    "op9_pii": _pii_sql(),
    "op10_mixing": f"""
        with d as (select doc_id, source, len({WORDS})::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as key from documents),
        s as (select source, sum(size)::bigint as source_size, ([5.0, 2.0, 1.0])[(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as w
            from d group by source),
        c as (select *, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as total from s),
        o as (select *, coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as before,
            sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as rest from c),
        k as (select *, cap * rest <= w * (total - before) as capped from o),
        t as (select source, source_size, case when capped then cap else w * (total - coalesce(sum(cap) filter (where capped) over (), 0))
            / sum(w) filter (where not capped) over () end as target from k),
        r as (select d.*, source_size, target, floor(target)::bigint as budget, floor(target)::bigint // greatest(source_size, 1) as epochs,
            coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * greatest(source_size, 1) - start)))::bigint as taken from r""",
    "op5_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op12_middle": """
        with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
        h as (select doc_id, t, length(t)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::bigint) as h from d),
        c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
                when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
        p as (select *, t[:a] as p, t[a + 1:b] as m, t[b + 1:] as s from c)
        select doc_id, n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
            sha256(t) as restored_sha256 from p""",
    "op1_substrings": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from d)),
        hit as (select doc_id, i from (select *, row_number() over (partition by g order by doc_id, i) as r from win) where r > 1),
        cut as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from hit),
        span as (select doc_id, min(i) as a, max(i) + 100 as z from (select *, sum(fresh) over (partition by doc_id order by i) as s from cut) group by doc_id, s),
        edge as (select doc_id, a, lag(z, 1, 0) over (partition by doc_id order by a) as before from span),
        part as (select d.doc_id, before as o, substr(h, 2 * before + 1, 2 * (a - before)) as x from d join edge using (doc_id)
            union all select d.doc_id, coalesce(z, 0), substr(h, 2 * coalesce(z, 0) + 1) from d left join (select doc_id, max(z) as z from span group by all) using (doc_id)),
        kept as (select doc_id, string_agg(x, '' order by o) as x from part group by all),
        gone as (select doc_id, sum(z - a)::bigint as n_removed, count(*)::bigint as n_spans from span group by all)
        select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(x)) as kept_sha256
        from d join kept using (doc_id) left join gone using (doc_id)""",
    "op4_jaccard": f"""
        with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
        g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
        n as (select doc_id, count(*)::bigint as n from g group by all),
        met as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b using (g) where a.doc_id <> b.doc_id group by all),
        link as materialized (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        reach as (select doc_id, doc_id as c from d union select b, c from reach join link on a = doc_id where c < b)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id from d left join n using (doc_id) join (select doc_id, min(c) as c from reach group by all) using (doc_id)""",
}
