"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import crc_bucket, table


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint 0, repeated rows come out each, an empty table gives no rows."""
    from sievemark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null page gives the empty text, repeated rows come out each."""
    from sievemark.llm.extract import extracted

    found = extracted(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back: size and digest of its payload, and whether it is a response or a revisit; a null page is an empty payload."""
    from sievemark.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Tools of the derived calls: name and schema.
TOOLS = (
    ("measure", '{"properties":{"size":{"type":"integer"},"role":{"type":"string"}},"required":["size"],"additionalProperties":false}'),
    ("quote", '{"properties":{"size":{"type":"integer"},"text":{"type":"string"}},"required":["size","text"]}'),
)


def with_calls(messages: DataFrame) -> DataFrame:
    """The conversations with a tool call after each of their messages, and results of most.

    The call of turn t measures or quotes the message, or asks for a tool that there isn't. It depends on
    the calls of the two turns before, within blocks of five turns; in every seventh conversation the
    second and third call of a block need each other. Arguments lack a key, hold one too many or one of
    the wrong type by turn and conversation. Calls of every fourth kind stay without a result, and every
    eleventh message has a result that nobody has asked for.
    """
    c, t = F.col("conv_id"), F.col("turn")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    kind = (c + t) % 3
    size = F.length(text).cast("long")
    measure = F.when(c % 4 == 1, F.to_json(F.struct(role.alias("role")))).when(c % 4 == 2, F.to_json(F.struct(role.alias("role"), size.cast("string").alias("size")))).when(c % 4 == 3, F.to_json(F.struct(size.alias("size"), role.alias("role"), F.lit(None).cast("string").alias("no"), F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(size.alias("size"), role.alias("role"))))
    arguments = F.when(kind == 0, measure).when(kind == 1, F.to_json(F.struct(text.alias("text"), size.alias("size")))).otherwise("{}")
    tool = F.when(kind == 0, "measure").when(kind == 1, "quote").otherwise("absent")
    needs = F.filter(F.array(F.when(t % 5 >= 1, name(t - 1)), F.when(t % 5 >= 2, name(t - 2)), F.when((c % 7 == 0) & (t % 5 == 1), name(t + 1))), lambda x: x.isNotNull())
    call = F.concat(F.lit('{"tool_calls": [{"name":"'), tool, F.lit('", "id":"'), name(t), F.lit('", "depends_on":'), F.to_json(needs), F.lit(', "arguments":'), arguments, F.lit("}]}"))
    result = lambda key: F.concat(F.lit('{"tool_call_id":"'), key, F.lit('","content":'), size.cast("string"), F.lit("}"))
    row = lambda turn, role, text: F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    added = F.array(
        F.struct(t.alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")),
        row(t, "assistant", call),
        F.when((c + t) % 4 != 3, row(t + 1, "tool", result(name(t)))),
        F.when((c + t) % 11 == 5, row(t, "tool", result(F.concat(F.lit("x"), name(t))))),
    )
    return messages.select("conv_id", F.inline(F.filter(added, lambda x: x.isNotNull())))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with the calls and results that with_calls() derives, linked, ordered, validated and as canonical JSON."""
    from sievemark.llm.chat import linked

    tools = spark.createDataFrame(TOOLS, "name string, schema string")
    found = linked(with_calls(table(spark, sf_dir, "conversations")), tools)
    return found.select("conv_id", "turn", "position", "kind", "role", "call_id", "linked", "level", F.array_join("errors", "; ").alias("errors"), "json")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; a null text has no words and fails."""
    from sievemark.llm.quality import judged

    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the labelled documents that are not held out; a text that is null or has no letter is und, a row without an id is not held out."""
    from sievemark.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return identify(docs, fit(docs.where("not held_out")), keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of every document against the whole benchmark; a null text has no words, an empty benchmark hits nothing."""
    from sievemark.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"), "longest")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; a null text has none."""
    from sievemark.llm.pii import KINDS, joined, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out; a null text is the end token alone, a row without an id is not held out."""
    from sievemark.llm.lm import fit, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 1, F.lit(False))
    model = fit(docs.where(~held_out), every_word=True)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence; a null text is the end id alone."""
    from sievemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_extraction, op2_warc, op3_chat, op4_quality, op5_language_id, op6_decontamination, op7_pii, op8_lm, op9_packing, op10_simhash, pipeline)}

def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _quality_sql() -> str:
    # Fixed values, as the rules state them.
    phrases = ("all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript", "javascript is disabled", "sign up for our newsletter", "click here", "share this", "powered by", "lorem ipsum", "without warranty", "warranties or conditions", "redistribution and use", "permission is hereby granted", "spdx-license-identifier", "copyright (c)")
    ends = "[.!?:;…。！？][\"'’”»)\\]]*$"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    boiler = " or ".join(f"contains(lower(t), {_text(p)})" for p in phrases)
    return f"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from d),
        g as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        r as (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, a, b, c) as k from g) where k > 1),
        rep as (select doc_id, count(distinct p) as n from r group by all),
        l as (select doc_id, line, trim(line, {space}) as t from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
        m as (select *, len(list_filter(string_split(t, ' '), lambda x: x <> '')) as n, length(t) - length(translate(t, '#*$%&|<>!{{}}[]=~^\\', '')) as marks, regexp_matches(t, {_text(ends)}) as ended from l where t <> ''),
        f as (select doc_id, line, length(t) as c, (marks > n * 0.3 + 1) or (not ended and n < 4) or (length(t) - length(translate(t, '|»›·•', '')) >= greatest(2, n * 0.2)) or (t = upper(t) and t <> lower(t) and n >= 3) or {boiler} as fails from m),
        s as (select doc_id, sum(c) as total, coalesce(sum(case when fails then c end), 0) as lost, count(*) - count(distinct line) as dup from f group by all),
        b as (select w.doc_id, len(w) as n_words, length(list_aggregate(w, 'string_agg', '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(dup, 0) as dup, coalesce(rep.n, 0) as rep, coalesce(lost, 0) as lost, coalesce(total, 0) as total
              from w left join rep on rep.doc_id = w.doc_id left join s on s.doc_id = w.doc_id)
        select doc_id, cast(n_words as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(dup as bigint) as n_dup_lines, cast(rep as bigint) as n_repeat_words,
               (n_words < 50 or 100 * rep > 50 * n_words) as base_failed, not (n_words < 50 or 100 * rep > 50 * n_words) and lost <= total * 0.5 as kept, cast(lost as bigint) as lost_chars from b"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_quality": _quality_sql(),
    "op6_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
        bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as i from (select *, least(8, len(w)) as k from b where len(w) > 0))),
        dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
        m as (select doc_id, dw.k, i, item_id from dw join bw on bw.k = dw.k and bw.g = dw.g),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by all),
        t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from m group by all),
        runs as (select doc_id, max(n) as longest from (select doc_id, item_id, k, j, count(*) + k - 1 as n from (select doc_id, item_id, k, i, i - row_number() over (partition by doc_id, item_id order by i) as j from (select distinct doc_id, item_id, k, i from m)) group by doc_id, item_id, k, j) group by all)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated, cast(coalesce(longest, 0) as bigint) as longest
        from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id left join runs on runs.doc_id = d.doc_id""",
    "op3_chat": """
        with m as (select conv_id as c, turn as t, coalesce(role, '') as role, coalesce(text, '') as text, length(coalesce(text, '')) as size, 'c' || turn as id, (conv_id + turn) % 3 as kind from conversations),
        has as (select distinct c, t from m),
        needs as (select c, t, d from (select c, t, unnest([case when t % 5 >= 1 then t - 1 end, case when t % 5 >= 2 then t - 2 end, case when c % 7 = 0 and t % 5 = 1 then t + 1 end]) as d from has) where (c, d) in (select (c, t) from has)),
        l0 as (select c, t, 0 as level from has where (c, t) not in (select (c, t) from needs)),
        l1 as (select n.c, n.t, 1 as level from needs n left join l0 on l0.c = n.c and l0.t = n.d group by all having count(*) = count(l0.t)),
        a1 as (from l0 union all from l1),
        l2 as (select n.c, n.t, 2 as level from needs n left join a1 on a1.c = n.c and a1.t = n.d where (n.c, n.t) not in (select (c, t) from a1) group by all having count(*) = count(a1.t)),
        a2 as (from a1 union all from l2),
        l3 as (select n.c, n.t, 3 as level from needs n left join a2 on a2.c = n.c and a2.t = n.d where (n.c, n.t) not in (select (c, t) from a2) group by all having count(*) = count(a2.t)),
        a3 as (from a2 union all from l3),
        l4 as (select n.c, n.t, 4 as level from needs n left join a3 on a3.c = n.c and a3.t = n.d where (n.c, n.t) not in (select (c, t) from a3) group by all having count(*) = count(a3.t)),
        levels as (from a3 union all from l4),
        calls as (select m.*, level, case kind when 0 then 'measure' when 1 then 'quote' else 'absent' end as tool,
                         case when kind = 1 then json_object('size', size, 'text', text) when kind = 2 then json('{}')
                              when c % 4 = 1 then json_object('role', role) when c % 4 = 2 then json_object('role', role, 'size', cast(size as varchar))
                              when c % 4 = 3 then json_object('extra', 1, 'role', role, 'size', size) else json_object('role', role, 'size', size) end as args,
                         case when kind = 2 then 'unknown tool' when kind = 1 then '' when c % 4 = 1 then 'missing size' when c % 4 = 2 then 'type of size' when c % 4 = 3 then 'unexpected extra' else '' end as errors,
                         list_filter([case when t % 5 >= 1 then 'c' || (t - 1) end, case when t % 5 >= 2 then 'c' || (t - 2) end, case when c % 7 = 0 and t % 5 = 1 then 'c' || (t + 1) end], lambda x: x is not null) as depends
                  from m left join levels using (c, t)),
        results as (select c, t + 1 as t, id, size, true as linked, level from calls where (c + t) % 4 <> 3 union all select c, t, 'x' || id, size, false, null from calls where (c + t) % 11 = 5)
        select c as conv_id, t as turn, cast(-1 as bigint) as position, 'message' as kind, role, cast(null as varchar) as call_id, cast(null as boolean) as linked, cast(null as bigint) as level, cast(null as varchar) as errors,
               cast(json_object('content', text, 'role', role) as varchar) as json from m
        union all
        select c, t, -1, 'message', 'assistant', null, null, null, null,
               cast(json_object('content', json_object('tool_calls', json_array(json_object('arguments', args, 'depends_on', to_json(depends), 'id', id, 'name', tool))), 'role', 'assistant') as varchar) from calls
        union all
        select c, t, 0, 'call', 'assistant', id, (c + t) % 4 <> 3, level, errors, cast(json_object('arguments', args, 'id', id, 'name', tool) as varchar) from calls
        union all
        select c, t, -1, 'result', 'tool', id, linked, level, null, cast(json_object('content', json_object('content', size, 'tool_call_id', id), 'role', 'tool') as varchar) from results""",
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as bytes from pages),
        m as (select *, max(page_id) over (partition by digest) as last from p)
        select page_id, cast(bytes as bigint) as payload_bytes, digest as payload_digest,
               case when bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
               case when bytes >= 1000 and page_id < last then last end as refers_to
        from m""",
}
