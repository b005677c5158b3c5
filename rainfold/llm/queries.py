"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, _tokenizer("piece_bpe_32k.model"), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Rules of the url query: host, path, whether it allows.
URL_RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, allow boolean")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import protect

    out = protect(table(spark, sf_dir, "documents").select("doc_id", "text"), support=1)
    base = F.filter("spans", lambda x: x["kind"] != "term")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("term"), F.size("spans").cast("long").alias("n_spans"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = score(docs, docs.where(~held_out).select("text"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A conversation whose texts hold the template's own marks and escapes.
HARD_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, loss_text, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(HARD_CHAT, rows.schema))
    read = read_back(format_chats(rows)).withColumn("loss", loss_text())
    told = F.array_join(F.transform("read_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, labelled, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.coalesce(crc_fold(F.col("doc_id"), 3), F.lit(0))
    labels = table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = fit(labelled(docs, labels))
    return score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def rebuilt(packed: DataFrame) -> DataFrame:
    """Each conversation c of ``packed`` with the first turns of conversation c - c % 20 in place of as many of its own, up to three."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = packed.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    both = packed.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import packed_turns, prefix_trie

    return prefix_trie(rebuilt(packed_turns(table(spark, sf_dir, "conversations"))))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth text by its id's checksum becomes periodic from some word on; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("w"), F.floor(h / 10)
    chosen = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumn("a", F.when(n > 0, (g % n).cast("int")))
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % p)))
    return chosen.withColumn("text", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text"))).drop("w", "a")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import collapse_runs

    out = collapse_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = out.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.a")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.b")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.b")).alias("exponent_milli"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: By query; texts of the conversations and rules of the urls are repeated here as plain SQL.
ORACLE = {
    "op11_trie": r"""
        with recursive crc_table as (
            select list(c order by k) as t from (select k, list_reduce(list_concat([k], range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as c from (select unnest(range(256)) as k))
        ),
        ids as (select distinct conv_id from conversations where conv_id is not null),
        h as (
            select conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::int])), 4294967295) % 4 as h
            from ids, crc_table
        ),
        own as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(md5(coalesce(role, '')) || coalesce(text, ''))) as place
            from conversations where conv_id is not null
        ),
        turns as (
            select h.conv_id, 0 as part, place, role, text from h join own on own.conv_id = h.conv_id and own.place > h.h
            union all select h.conv_id, -1, place, role, text from h join own on own.conv_id = h.conv_id - h.conv_id % 20 and own.place <= h.h
        ),
        numbered as (select conv_id, row_number() over (partition by conv_id order by part, place) as d, sha256(sha256(role) || text) as said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from turns),
        paths(conv_id, d, node, parent, words) as (
            select conv_id, 0, '', null::varchar, 0 from ids
            union all select p.conv_id, n.d::int, sha256(p.node || n.said), p.node, n.words::int from paths p join numbered n on n.conv_id = p.conv_id and n.d = p.d + 1
        ),
        sizes as (select conv_id, max(d) as depth from paths group by conv_id),
        nodes as (
            select p.node, any_value(p.parent) as parent, any_value(p.d)::bigint as depth, min(p.conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(p.words) as saved,
                sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (s.depth = p.d), '')) as ends_sha256
            from paths p join sizes s on s.conv_id = p.conv_id group by p.node
        ),
        kids as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
        over_(node, top) as (select node, node from nodes union all select o.node, n.parent from over_ o join nodes n on n.node = o.top where n.parent is not null),
        sums as (select o.top as node, sum(n.saved)::bigint as saved_tokens, sum(case when k.node is null then 1 else 0 end)::bigint as n_leaves from over_ o join nodes n on n.node = o.node left join kids k on k.node = o.node group by o.top)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        from nodes n left join nodes p on p.node = n.parent left join kids k on k.node = n.node join sums s on s.node = n.node
    """,
    "op12_vectors": """
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
            where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from embeddings where vec_id is not null union select r.a, p.b from reach r join pairs p on p.a = r.b),
        least as (select a, min(b) as component_id from reach group by a),
        degree as (select a, count(*) as n_links from pairs group by a)
        select e.vec_id, coalesce(d.n_links, 0) as n_links, l.component_id, coalesce(e.vec_id = l.component_id, false) as kept
        from embeddings e left join least l on l.a = e.vec_id left join degree d on d.a = e.vec_id
    """,
    "op7_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)
    """,
    "op8_chat": r"""
        with c as (
            select conv_id, turn, role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(length('### ' || role || ':' || chr(10) || '</turn>' || chr(10))
                + length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':' || chr(10), '\c')))::bigint as formatted_chars,
            case when bool_and(moved) then arg_max(role, place) else '!' end as state, bool_and(moved) and arg_max(role, place) = 'assistant' as valid
        from (
            select *, coalesce(lag(role) over w, '') || '>' || role in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') as moved, row_number() over w as place
            from c window w as (partition by conv_id order by turn, role, text)
        ) group by conv_id
    """,
    "op2_urls": r"""
        with recursive rules(rule_host, rule_path, allow) as (values ('net', '/', false), ('example.net', '/en/', true), ('example.com', '/de/', false), ('org', '/fr/', true)),
        p as (
            select page_id, url, coalesce(html, '') as html,
                translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
            from pages
        ),
        nodes as (select distinct url, split_part(url, '#', 1) as node, host, path from p where contains(url, '://')),
        links as (
            select split_part(url, '#', 1) as src, split_part(x, '#', 1) as dst from (
                select url, unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')) as x from p)
            where contains(x, '://') and contains(url, '://')
        ),
        sym as (select src, dst from links union select dst, src from links),
        reach(a, b) as (select src, src from sym union select r.a, s.dst from reach r join sym s on r.b = s.src),
        fits as (
            select n.host, n.path, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) as rule, arg_max(r.allow, length(r.rule_host || r.rule_path)) as allow
            from (select distinct host, path from nodes) n join rules r on (n.host = r.rule_host or ends_with(n.host, '.' || r.rule_host)) and starts_with(n.path, r.rule_path)
            group by n.host, n.path
        ),
        passed as (
            select r.a as node, bool_or(f.allow) as allow from reach r join nodes n on n.node = r.b join fits f on f.host = n.host and f.path = n.path group by r.a
        )
        select p.page_id, p.host, p.path, f.rule,
            case when coalesce(f.allow, g.allow, true) then 'allow' else 'block' end as verdict
        from p left join fits f on f.host = p.host and f.path = p.path left join passed g on g.node = split_part(p.url, '#', 1)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
