"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.llm import convtrie, langid, lmscore, mixing, ordermin, outliers, packing, pieces, quality, runs, shards, simhash, tokencount
from namesake.llm.common import crc_fold, documents, text_of
from namesake.llm.stats import words_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf))
    first, second = F.get("positions", F.lit(0)), F.get("positions", F.lit(1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"), F.round(second, 9).alias("second_position"))


def op3_attention(spark: SparkSession, sf: str) -> DataFrame:
    return lmscore.score(documents(spark, sf))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf))


def op5_shards(spark: SparkSession, sf: str) -> DataFrame:
    index, folder = shards.write_shards(documents(spark, sf))
    found = shards.read_slots(index, folder, with_ids=False).select("slot", "ids_crc32")
    return index.join(found, "slot")


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.train_and_identify(documents(spark, sf))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.components(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return ordermin.edited_pairs(documents(spark, sf))


def op10_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.judge(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return convtrie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


def op12_pieces(spark: SparkSession, sf: str) -> DataFrame:
    both = pieces.round_trip(documents(spark, sf))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    # Every tenth text by its hash repeats a period from some word on.
    h, n = crc_fold(1 << 32), F.size("_words")
    g = F.floor(h / 10)
    at = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))).cast("int")
    chosen = (h % 10 == 0) & (n > 0)
    docs = documents(spark, sf).select("doc_id", "text").withColumn("_words", F.when(h % 10 == 0, words_of(text_of())))
    docs = docs.withColumn("text", F.when(chosen, F.array_join(runs.with_period(F.col("_words"), at, period), " ")).otherwise(F.col("text")))
    # Of the longest runs the one that starts first, of those the one of the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = runs.find_runs(docs.select("doc_id", "text")).withColumn("_top", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"),
        F.floor(F.col("_top.length") * 1000 / -F.col("_top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_attention": op3_attention,
    "op4_packing": op4_packing,
    "op5_shards": op5_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_order_minhash": op9_order_minhash,
    "op10_outliers": op10_outliers,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_pieces": op12_pieces,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op2_mixing": r"""
    with sized as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             md5(coalesce(doc_id::varchar, '')) as o
      from documents
    ),
    sources as (
      select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as k
      from sized group by source
    ),
    weighed as (select *, [5, 2, 1][k + 1] as w, 2 * source_size as cap, sum(source_size) over () as total from sources),
    filled as (
      select *, sum(cap) over f - cap as caps, sum(w) over () - sum(w) over f + w as rest
      from weighed window f as (order by cap / w, source nulls last rows unbounded preceding)
    ),
    levels as (select *, (3 * total - 2 * caps)::double / (2 * rest)::double as level from filled),
    leveled as (
      select *, first_value(level) over (order by case when level * w <= cap then 0 else 1 end, caps) as top,
             max(case when level * w <= cap then 1 else 0 end) over () as any_fits
      from levels
    ),
    targets as (
      select source, source_size, k, case when any_fits = 0 then cap::double else least(cap::double, top * w) end as target
      from leveled
    ),
    placed as (
      select s.doc_id, s.size, t.source_size, t.k, t.target, floor(t.target)::bigint as words,
             (sum(s.size) over (partition by s.source order by s.o, s.doc_id, s.size rows unbounded preceding) - s.size)::bigint as start
      from sized s join targets t on s.source is not distinct from t.source
    ),
    taken as (
      select *, greatest(0, least(size, words - start)) as first, greatest(0, least(size, words - start - source_size)) as second
      from placed
    ),
    shares as (
      select *, (start + first / 2) / target as p1, (start + source_size + second / 2) / target as p2 from taken
    )
    select doc_id, size, source_size, target, (first + second)::bigint as taken,
      case when first > 0 then round(case k
        when 0 then case when p1 <= 0.625 then 2 * p1 / (sqrt(greatest(0, 2.25 - 2 * p1)) + 1.5)
                    else least(1, 0.5 + 2 * (p1 - 0.625) / (sqrt(greatest(0, 1 - 2 * (p1 - 0.625))) + 1)) end
        when 1 then p1
        else case when p1 <= 0.375 then 2 * p1 / (sqrt(0.25 + 2 * p1) + 0.5)
             else least(1, 0.5 + 2 * (p1 - 0.375) / (sqrt(1 + 2 * (p1 - 0.375)) + 1)) end end, 9) end as position,
      case when second > 0 then round(case k
        when 0 then case when p2 <= 0.625 then 2 * p2 / (sqrt(greatest(0, 2.25 - 2 * p2)) + 1.5)
                    else least(1, 0.5 + 2 * (p2 - 0.625) / (sqrt(greatest(0, 1 - 2 * (p2 - 0.625))) + 1)) end
        when 1 then p2
        else case when p2 <= 0.375 then 2 * p2 / (sqrt(0.25 + 2 * p2) + 0.5)
             else least(1, 0.5 + 2 * (p2 - 0.375) / (sqrt(1 + 2 * (p2 - 0.375)) + 1)) end end, 9) end as second_position
    from shares
    """,
    "op11_conversation_trie": r"""
    with turns as (
      select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text,
             row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
      from conversations where conv_id is not null
    ),
    convs as (
      select conv, conv - conv % 5 as first, xor(list_reduce(
          list_concat([4294967295::bigint], list_transform(range(1, length(conv::varchar) + 1), lambda i: ascii((conv::varchar)[i])::bigint)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384::bigint))
        ), 4294967295::bigint) % 9 as h
      from (select distinct conv from turns)
    ),
    joined as (
      select c.conv, 0 as part, t.place, t.role, t.text from convs c join turns t on t.conv = c.first where t.place < c.h
      union all
      select c.conv, 1, t.place, t.role, t.text from convs c join turns t on t.conv = c.conv where t.place >= c.h
    ),
    lined as (select *, row_number() over (partition by conv order by part, place) as depth from joined),
    visits as (
      select conv, 0 as depth, []::struct(role varchar, text varchar)[] as path, 0 as bytes from convs
      union all
      select conv, depth, list({'role': role, 'text': text}) over (partition by conv order by depth), strlen(text) from lined
    ),
    lengths as (select conv, max(depth) as len from visits group by conv),
    named as (select *, min(conv) over (partition by depth, path) as rep from visits),
    nodes as (select rep, depth, count(*) as n_convs, any_value(bytes) as bytes from named group by rep, depth),
    edges as (
      select n.rep, n.depth, n.n_convs, (n.n_convs - 1) * n.bytes as saved, p.rep as parent_rep
      from nodes n left join named p on p.conv = n.rep and p.depth = n.depth - 1
    ),
    children as (select parent_rep as rep, depth - 1 as depth, count(*) as n_children from edges where depth > 0 group by 1, 2),
    valued as (select e.*, coalesce(c.n_children, 0) as n_children from edges e left join children c on c.rep = e.rep and c.depth = e.depth),
    totals as (
      select a.rep, a.depth, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum(v.saved) as saved_tokens
      from valued v join named a on a.conv = v.rep and a.depth <= v.depth group by a.rep, a.depth
    ),
    ends as (
      select n.rep, n.depth, sha256(string_agg(n.conv::varchar, ',' order by n.conv)) as ends_sha256
      from named n join lengths l on l.conv = n.conv and l.len = n.depth group by n.rep, n.depth
    )
    select v.rep::bigint as conv_id, v.depth::bigint as depth, v.parent_rep::bigint as parent_conv_id, v.n_convs::bigint as n_convs,
           v.n_children::bigint as n_children, t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens,
           coalesce(e.ends_sha256, sha256('')) as ends_sha256
    from valued v join totals t on t.rep = v.rep and t.depth = v.depth left join ends e on e.rep = v.rep and e.depth = v.depth
    """,
}
