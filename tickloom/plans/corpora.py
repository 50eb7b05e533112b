"""Queries over documents and other texts: sources, sinks, corpora, tokens, generators, evaluation."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.functions import codec
from tickloom.functions.hashing import pick_sql
from tickloom.operators import bpe as B
from tickloom.operators import corpus as K
from tickloom.operators import curriculum as U
from tickloom.operators import detect as D
from tickloom.operators import evaluate as E
from tickloom.operators import generate as G
from tickloom.operators import mixer as M
from tickloom.operators import ngram as N
from tickloom.operators import tokens as X
from tickloom.sources import readers, sinks
from tickloom.sources.sinks import materialised, scratch

from . import market, vocab
from . import sql as Q
from .market import TEXTS, bars, candles, charts
from .registry import register, table
from .samples import SAMPLES, samples
from .vocab import IDS, TRAINED, ids, vocabulary


def docs(spark, d):
    return table(spark, d, "documents")


WS = "'[ \\t\\n\\x0B\\f\\r]+'"
NORM = f"trim(regexp_replace(text, {WS}, ' ', 'g'))"
LETTER_SHARE = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"

# sources and sinks


def _csv_bars(spark, d):
    """All bars through CSV files, a folder a symbol; written by ranges of position, so that files are in order, and read at once."""
    path = scratch(spark)
    b = bars(spark, d).where("symbol is not null")
    rows = b.repartitionByRange("symbol", "idx").sortWithinPartitions("symbol", "idx")
    rows.select("symbol", *(F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close"))).write.partitionBy("symbol").csv(path, header=True)
    return readers.ohlc_csv(spark, path)


@register("s1_csv_scan", Q.query(Q.BARS, "SELECT symbol, idx, round(open, 6) AS open, round(close, 6) AS close FROM bars WHERE symbol IS NOT NULL"))
def _(spark, d):
    return _csv_bars(spark, d).select("symbol", "idx", "open", "close")


@register("s1_csv_scan_all", Q.query(Q.BARS, "SELECT symbol, idx, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars WHERE symbol IS NOT NULL"))
def _(spark, d):
    return _csv_bars(spark, d)


@register("s2_parquet_scan", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def _(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@register("s3_pruned_scan", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def _(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet", ["doc_id", "n_chars"], F.col("lang") == "en")


@register("s4_row_groups", "SELECT lang AS category, source AS file, doc_id // 50 AS row_group, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY ALL")
def _(spark, d):
    return M.units_of(units(spark, d), "n_chars")


def units(spark, d):
    return docs(spark, d).select(F.col("lang").alias("category"), F.col("source").alias("file"), F.floor(F.col("doc_id") / 50).alias("row_group"), "n_chars", "doc_id")


@register("s4_footer_groups", "SELECT 'documents' AS kind, count(*)::BIGINT AS rows, sum(n_chars)::BIGINT AS tokens FROM documents UNION ALL SELECT 'events', count(*), sum(event_id)::BIGINT FROM events")
def _(spark, d):
    of = lambda kind, column: readers.row_groups(spark, f"{d}/{kind}.parquet", column).agg(F.lit(kind).alias("kind"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    return of("documents", "n_chars").unionByName(of("events", "event_id"))


@register("s4_unit_rows", "SELECT doc_id, md5(text) AS digest, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def _(spark, d):
    path = scratch(spark)
    sinks.write_parquet(docs(spark, d).select("doc_id", "text", "n_chars"), path)
    with_groups = readers.row_groups(spark, path)
    first = with_groups.where("row_group % 2 = 0")  # a reader that stops here resumes with the units that are left
    rest = with_groups.join(first, ["file", "row_group"], "left_anti")
    schema = "doc_id long, text string, n_chars long"
    both = readers.unit_rows(first, schema).unionByName(readers.unit_rows(rest, schema))
    return both.select("doc_id", F.md5("text").alias("digest"), "n_chars")


@register("s5_glob_scan", "SELECT 'nation' AS kind, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(spark, d):
    both = readers.with_file(spark.read.option("mergeSchema", "true").parquet(f"{d}/{{nation,region}}.parquet"))
    return both.groupBy(F.when(F.col("n_nationkey").isNotNull(), "nation").otherwise("region").alias("kind")).agg(F.count("*").alias("n"))


@register("s6_missing_files", "SELECT count(*)::BIGINT AS n FROM benchmark")
def _(spark, d):
    found = readers.existing(spark, [f"{d}/benchmark.parquet", f"{d}/no_such_table.parquet"])
    return found.agg(F.count("*").alias("n"))


@register("s7_row_count", "SELECT count(*)::BIGINT AS n FROM documents")
def _(spark, d):
    return spark.createDataFrame([(readers.row_count(spark, f"{d}/documents.parquet"),)], "n long")


@register("s8_domain_filter", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def _(spark, d):
    return readers.by_domain(docs(spark, d), "source", ["src1", "src3", "src5"]).select("doc_id", "source")


@register("s8_curated_resume", f"SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 60 AND source IN ('src1', 'src3', 'src5') AND length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 200")
def _(spark, d):
    rows = K.curated(docs(spark, d), "doc_id", "text", "source", ["src1", "src3", "src5"], 200, 3, 20)
    return rows.select("doc_id", F.md5("text").alias("digest"))


@register("s9_filtered_scan", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 500 AND lang <> 'en'")
def _(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet", ["doc_id", "n_chars"], lambda df: (df["n_chars"] > 500) & (df["lang"] != "en"))


@register("s12_token_lines", "SELECT DISTINCT event_type AS token FROM events")
def _(spark, d):
    path = scratch(spark)
    lines = table(spark, d, "events").select(F.explode(F.array(F.concat(F.lit(" "), "event_type", F.lit(" ")), F.lit("   "))).alias("value")).distinct()
    lines.write.text(path)
    return readers.token_lines(spark, path)


@register("s13_choice_items", "SELECT item_id, 'item ' || item_id % 3 || ': ' || text AS ctx FROM benchmark ORDER BY item_id LIMIT 10")
def _(spark, d):
    b = table(spark, d, "benchmark").withColumn("label", F.concat(F.lit("item "), F.col("item_id") % 3))
    return readers.choice_items(b, "label", "text", 10, "item_id").select("item_id", "ctx")


@register("k1_parquet_round_trip", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    path = scratch(spark)
    sinks.write_parquet(docs(spark, d).select("doc_id", "lang"), path, one_file=True)
    return spark.read.parquet(path)


@register("k2_corpus_schema", "SELECT md5(text) AS digest, source, n_chars AS token_length, '{}' AS meta FROM documents")
def _(spark, d):
    path = scratch(spark)
    sinks.write_parquet(sinks.to_corpus(docs(spark, d).withColumn("token_length", F.col("n_chars"))), path)
    return spark.read.parquet(path).select(F.md5("text").alias("digest"), "source", "token_length", "meta")


@register("k2_resumed_append", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def _(spark, d):
    source, target, state = scratch(spark), scratch(spark), scratch(spark)
    sinks.write_parquet(docs(spark, d).select("doc_id", "text", "lang").repartition(6), source)

    def stop(number: int) -> None:
        if number == 1:
            raise RuntimeError("stopped between a batch and its commit")

    change = lambda df: df.select("doc_id", F.md5("text").alias("digest"), "lang")
    schema = spark.read.parquet(source).schema
    try:
        sinks.append_stream(spark, source, schema, target, state, change, 2, stop)
    except StreamingQueryException:
        pass
    sinks.append_stream(spark, source, schema, target, state, change, 2)
    return spark.read.schema("doc_id long, digest string, lang string").option("recursiveFileLookup", "true").parquet(target)


@register("k3_csv_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name"), path)
    return spark.read.schema("n_nationkey long, n_name string").csv(path, header=True)


@register(
    "k4_compaction_parts",
    """WITH RECURSIVE f AS (SELECT printf('%06d', doc_id) AS name, n_chars AS bytes, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
    p(rn, name, part, now) AS (SELECT rn, name, 0, bytes FROM f WHERE rn = 1 UNION ALL SELECT f.rn, f.name, CASE WHEN now + bytes > 20000 THEN part + 1 ELSE part END, CASE WHEN now + bytes > 20000 THEN bytes ELSE now + bytes END FROM p JOIN f ON f.rn = p.rn + 1)
    SELECT name, part::BIGINT AS part FROM p""",
)
def _(spark, d):
    files = docs(spark, d).select(F.format_string("%06d", "doc_id").alias("name"), F.col("n_chars").alias("bytes"))
    return K.compaction_parts(files, 20_000).select("name", "part")


@register("k5_stats_json", "SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def _(spark, d):
    one = sinks.stats_json(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")))
    return one.select(F.explode(F.from_json("json", "array<struct<source:string,n:bigint>>")).alias("s")).select("s.*")


@register("k6_appended_log", "SELECT lang || ': ' || count(*) AS value FROM documents GROUP BY lang")
def _(spark, d):
    path = scratch(spark)
    by = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    for part in (F.col("lang") == "en", F.col("lang") != "en"):
        sinks.append_log(by.where(part), path)
    return spark.read.text(path)


@register("k9_preview", "SELECT doc_id, text[1:200] AS text FROM documents ORDER BY doc_id LIMIT 3")
def _(spark, d):
    return sinks.preview(docs(spark, d).select("doc_id", "text"), "doc_id")


# text scalars and corpora


@register("p12_first_fields", Q.query(SAMPLES, "SELECT symbol, start_idx, sample_type, regexp_extract(eval, '(^|[ _>])C=(\\d+)', 2)::BIGINT AS c, regexp_extract(eval, '(^|[ _>])T=([^ <]+)', 2) AS t FROM samples"))
def _(spark, d):
    inner = F.regexp_extract("eval", "(?s)<eval>(.*)</eval>", 1)
    return samples(spark, d).select("symbol", "start_idx", "sample_type", E.first_field(inner, "C").cast("long").alias("c"), E.first_field(inner, "T").alias("t"))


@register("p14_normalised_texts", f"SELECT doc_id, md5({NORM}) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(K.normalised(F.col("text"))).alias("digest"))


@register("p15_noise", f"SELECT doc_id, length(text) < 120 OR {LETTER_SHARE} < 0.5::DOUBLE * length(text) AS noise FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.is_noise(F.col("text"), 120).alias("noise"))


@register("p16_long_texts", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 200")
def _(spark, d):
    return K.long_enough(docs(spark, d), "text").select("doc_id")




@register("p17_section_counts", "SELECT doc_id, (len(string_split(repeat('=== x ===', doc_id::INT % 4) || '===', '===')) - 1) // 2 AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.section_count(F.concat(F.expr("repeat('=== x ===', cast(doc_id % 4 as int))"), F.lit("==="))).alias("n"))


@register("u1_union", "SELECT kind, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'doc' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations UNION ALL SELECT 'item', text FROM benchmark) GROUP BY kind")
def _(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), "text") for k, t in (("doc", "documents"), ("turn", "conversations"), ("item", "benchmark"))]
    return K.union_corpora(parts).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("u6_array_sets", f"WITH {IDS} SELECT doc_id, len(list_filter(list_distinct(ids), lambda x: list_contains([12, 13, 14], x)))::BIGINT AS both, len(list_filter(list_distinct(ids), lambda x: NOT list_contains([12, 13, 14], x)))::BIGINT AS rest FROM ids")
def _(spark, d):
    some = F.array(*map(F.lit, (12, 13, 14)))
    return ids(spark, d).select("doc_id", F.size(F.array_intersect("ids", some)).alias("both"), F.size(F.array_except("ids", some)).alias("rest"))


@register("a9_dataset_stats", "SELECT lang, source, count(*)::BIGINT AS n, round_even(avg(n_chars) FILTER (n_chars > 0), 1) AS mean, min(n_chars) FILTER (n_chars > 0) AS least, max(n_chars) FILTER (n_chars > 0) AS greatest, (sum(n_chars) FILTER (n_chars > 0))::BIGINT AS total FROM documents GROUP BY lang, source")
def _(spark, d):
    return K.dataset_report(docs(spark, d), "source", "n_chars", "lang")


@register("o3_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return docs(spark, d).select("doc_id", "lang").orderBy("doc_id").limit(25)


_RANK = f"row_number() OVER (ORDER BY {pick_sql(42, 'doc_id')}, doc_id)"


@register("o4_shuffled", f"SELECT doc_id, {_RANK}::BIGINT AS rank FROM documents")
def _(spark, d):
    return K.shuffled(docs(spark, d).select("doc_id"), ["doc_id"])


@register("o5_split", f"SELECT doc_id, CASE WHEN {_RANK} <= greatest(floor(count(*) OVER () * 0.05::DOUBLE), 1) THEN 'val' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    return K.split(docs(spark, d).select("doc_id"), ["doc_id"])


@register("o6_tail_split", """WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS n, row_number() OVER (PARTITION BY chunk ORDER BY doc_id) AS p FROM r)
    SELECT doc_id, chunk, CASE WHEN p > n - CASE WHEN floor(n * 0.01::DOUBLE) > 0 THEN floor(n * 0.01::DOUBLE) ELSE least(5, n) END THEN 'val' ELSE 'train' END AS split FROM n""")
def _(spark, d):
    return K.tail_split(docs(spark, d).select("doc_id"), "doc_id", 300, 0.01)


@register("o7_min_length", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000")
def _(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").where("n_chars >= 1000")


@register("o10_offset", "SELECT doc_id FROM documents ORDER BY doc_id OFFSET 120")
def _(spark, d):
    return K.skip(docs(spark, d).select("doc_id"), "doc_id", 120)


_ROUND = "r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents), e AS (SELECT min(n) AS lo, max(n) AS hi FROM r)"


@register("u3_interleaved", f"WITH {_ROUND} SELECT source, doc_id, rn - 1 AS round FROM r, e WHERE rn <= lo")
def _(spark, d):
    return K.interleave(docs(spark, d).select("source", "doc_id"), "source", "doc_id")


@register("s10_interleaved_all", f"WITH {_ROUND} SELECT source, doc_id, unnest(range(rn - 1, hi, n)) AS round FROM r, e")
def _(spark, d):
    return K.interleave(docs(spark, d).select("source", "doc_id"), "source", "doc_id", "all_exhausted")


@register("u3_weighted", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) / w AS turn, count(*) OVER (PARTITION BY source) / w AS e FROM (SELECT source, doc_id, 1.5::DOUBLE + ascii(right(source, 1)) % 3 AS w FROM documents WHERE source <> '')) SELECT source, doc_id, round(turn, 6) AS turn FROM r WHERE turn <= (SELECT min(e) FROM r) + 1e-9")
def _(spark, d):
    weight = F.when(F.col("source") != "", 1.5 + F.ascii(F.right("source", F.lit(1))) % 3)
    return K.interleave_weighted(docs(spark, d).select("source", "doc_id"), "source", "doc_id", weight)


RATIOS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


@register("u4_ratio_check", "SELECT true AS good, false AS bad")
def _(spark, d):
    def fits(ratios):
        try:
            M.check_ratios(ratios)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(fits(RATIOS), fits(RATIOS | {"en": 0.6}))], "good boolean, bad boolean")


#: The plan unit by unit: what each category was given (g), its next unit (p), tokens in the chunk and part, and the turn that is on.
_MIX = f"""WITH RECURSIVE un AS (SELECT lang AS category, source AS file, doc_id // 50 AS row_group, coalesce(sum(n_chars), 0)::BIGINT AS tokens FROM documents GROUP BY ALL),
ranked AS MATERIALIZED (SELECT category, k, file, row_group, tokens, row_number() OVER (PARTITION BY k ORDER BY file NULLS FIRST, row_group) AS pos FROM un JOIN (VALUES {', '.join(f"('{c}', {k})" for k, c in enumerate(RATIOS, 1))}) x(category, k) USING (category)),
counts AS MATERIALIZED (SELECT [{', '.join(f"(SELECT count(*) FROM ranked WHERE k = {k})" for k in range(1, len(RATIOS) + 1))}] AS n),
st(seq, category, file, row_group, tokens, chunk, part, g, p, ic, ip, ac, ap, pick, taken) AS (
  SELECT -1::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, [0, 0, 0, 0]::BIGINT[], [1, 1, 1, 1]::BIGINT[], 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL SELECT seq, category, file, row_group, tokens, oc, op, CASE WHEN full_chunk THEN [0, 0, 0, 0]::BIGINT[] WHEN over THEN g2 ELSE g END, p2, CASE WHEN full_chunk THEN 0 WHEN over THEN ic + taken2 ELSE ic END,
    CASE WHEN full_part OR full_chunk THEN 0 WHEN over THEN ip + taken2 ELSE ip END, CASE WHEN full_chunk THEN ac + 1 ELSE ac END, CASE WHEN full_chunk THEN 0 WHEN full_part THEN ap + 1 ELSE ap END, CASE WHEN over THEN 0 ELSE kk END, CASE WHEN over THEN 0 ELSE taken2 END
  FROM (SELECT *, over AND ip + taken2 >= least(50000, 400000 - (ic - ip)) AS full_part, over AND ic + taken2 >= 400000 AS full_chunk, [CASE WHEN k = kk THEN g[k] + taken2 ELSE g[k] END FOR k IN range(1, 5)] AS g2
    FROM (SELECT *, taken2 >= greatest(1, least(5000, least(50000, 400000 - (ic - ip)) - ip)) OR p2[kk] > n[kk] AS over
      FROM (SELECT s.seq + 1 AS seq, u.category, u.file, u.row_group, u.tokens, ac AS oc, ap AS op, g, ic, ip, ac, ap, kk, taken + u.tokens AS taken2, n, [CASE WHEN k = kk THEN p[k] + 1 ELSE p[k] END FOR k IN range(1, 5)] AS p2
        FROM (SELECT st.*, n, CASE WHEN pick > 0 THEN pick ELSE list_min([{{'v': g[k] / greatest(ic, 1) - ({list(RATIOS.values())}::DOUBLE[])[k], 'k': k}} FOR k IN range(1, 5) IF p[k] <= n[k]]).k END AS kk FROM st, counts) s
        JOIN ranked u ON u.k = kk AND u.pos = p[kk]))))
SELECT category, file, row_group, tokens, chunk, part, seq FROM st WHERE seq >= 0"""


@register("u2_mix_plan", _MIX)
def _(spark, d):
    M.check_ratios(RATIOS)
    return M.mix_plan(M.units_of(units(spark, d), "n_chars"), RATIOS, 5_000, 50_000, 400_000)


@register("u5_mixed_rows", "SELECT doc_id, lang AS category FROM documents")
def _(spark, d):
    rows = units(spark, d)
    plan = M.mix_plan(M.units_of(rows, "n_chars"), RATIOS, 5_000, 50_000, 400_000)
    return M.apply_plan(rows, plan).select("doc_id", "category")


@register("a14_unit_tokens", "SELECT source AS file, sum(coalesce(n_chars, 0))::BIGINT AS tokens FROM documents GROUP BY source")
def _(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("file")).agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("tokens"))


LINES = """lines AS (SELECT user_id AS doc, 0 AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type || '  ' || (event_id % 7) AS text, epoch_us(ts)::DOUBLE / 1000000 AS top FROM events),
gaps_ AS (SELECT *, top - lag(top) OVER (PARTITION BY doc, page ORDER BY line_no) AS gap FROM lines),
med AS (SELECT doc, page, quantile_cont(gap, 0.5) AS m FROM gaps_ WHERE gap > 0 GROUP BY ALL),
para AS (SELECT g.*, sum(CASE WHEN gap > greatest(1.8::DOUBLE * coalesce(m, 1), coalesce(m, 1) + 2) THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc, g.page ORDER BY line_no) AS paragraph FROM gaps_ g LEFT JOIN med USING (doc, page)),
paras AS MATERIALIZED (SELECT doc, page, paragraph, trim(regexp_replace(string_agg(text, ' ' ORDER BY line_no), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM para GROUP BY ALL)"""


def lines(spark, d):
    """Events of a user as lines of a page: where in time they are is where on the page."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    top = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("doc"), F.lit(0).alias("page"), no.alias("line_no"), F.concat("event_type", F.lit("  "), (F.col("event_id") % 7).cast("string")).alias("text"), top.alias("top"), top.alias("bottom"))


@register("r15_paragraphs", f"WITH {LINES} SELECT doc, page::BIGINT AS page, paragraph::BIGINT AS paragraph, text FROM paras")
def _(spark, d):
    return K.paragraphs(lines(spark, d))


@register("a15_gap_medians", f"WITH {LINES} SELECT doc, page::BIGINT AS page, round(m, 6) AS median FROM med")
def _(spark, d):
    from pyspark.sql import Window

    gap = F.col("top") - F.lag("bottom").over(Window.partitionBy("doc", "page").orderBy("line_no"))
    return lines(spark, d).withColumn("gap", gap).where("gap > 0").groupBy("doc", "page").agg(F.percentile("gap", F.lit(0.5)).alias("median"))


_MERGED = f"""{LINES}, listed AS (SELECT doc, list(text ORDER BY page, paragraph) AS ps FROM paras GROUP BY doc),
st(doc, k, rest, out) AS (SELECT doc, 0, '', []::VARCHAR[] FROM listed UNION ALL SELECT s.doc, k + 1, CASE WHEN length(trim(rest || ' ' || ps[k + 1])) >= 60 THEN '' ELSE trim(rest || ' ' || ps[k + 1]) END,
  CASE WHEN length(trim(rest || ' ' || ps[k + 1])) >= 60 THEN list_append(out, trim(rest || ' ' || ps[k + 1])) ELSE out END FROM st s JOIN listed l ON l.doc = s.doc WHERE k < len(ps)),
fin AS (SELECT s.doc, CASE WHEN rest = '' THEN out WHEN len(out) > 0 THEN list_append(out[:len(out) - 1], out[len(out)] || ' ' || rest) ELSE [rest] END AS parts FROM st s JOIN listed l ON l.doc = s.doc WHERE k = len(ps)),
merged AS (SELECT doc, unnest(range(len(parts))) AS part, unnest(parts) AS text FROM fin)"""


@register("r16_merged_paragraphs", f"WITH RECURSIVE {_MERGED} SELECT doc, part, text FROM merged")
def _(spark, d):
    return K.merge_short(K.paragraphs(lines(spark, d)), 60)


@register("r17_book_rows", f"WITH RECURSIVE {_MERGED} SELECT text, 'book' AS source, 0::BIGINT AS token_length, '{{\"page_number\":0,\"paragraph_index\":' || part || ',\"char_length\":' || length(text) || '}}' AS meta FROM merged WHERE NOT (length(text) < 30 OR {LETTER_SHARE} < 0.5::DOUBLE * length(text))")
def _(spark, d):
    merged = K.merge_short(K.paragraphs(lines(spark, d)), 60).withColumn("page", F.lit(0))
    return K.book_rows(merged, "doc", "book")


_PAGED = LINES.replace("0 AS page,", "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 12 AS page,")
_PAGED = f"""{_PAGED}, listed AS (SELECT doc, page, list(text ORDER BY paragraph) AS ps FROM paras WHERE text <> '' GROUP BY doc, page),
st(doc, page, k, rest, out) AS (SELECT doc, page, 0, '', []::VARCHAR[] FROM listed UNION ALL SELECT s.doc, s.page, k + 1, CASE WHEN length(trim(rest || ' ' || ps[k + 1])) >= 60 THEN '' ELSE trim(rest || ' ' || ps[k + 1]) END,
  CASE WHEN length(trim(rest || ' ' || ps[k + 1])) >= 60 THEN list_append(out, trim(rest || ' ' || ps[k + 1])) ELSE out END FROM st s JOIN listed l ON l.doc = s.doc AND l.page = s.page WHERE k < len(ps)),
fin AS (SELECT s.doc, s.page, CASE WHEN rest = '' THEN out WHEN len(out) > 0 THEN list_append(out[:len(out) - 1], out[len(out)] || ' ' || rest) ELSE [rest] END AS parts FROM st s JOIN listed l ON l.doc = s.doc AND l.page = s.page WHERE k = len(ps)),
merged AS (SELECT doc, page, unnest(range(len(parts))) AS k, unnest(parts) AS text FROM fin)"""


@register("r17_paged_rows", f"WITH RECURSIVE {_PAGED} SELECT doc, page::BIGINT AS page, row_number() OVER (PARTITION BY doc ORDER BY page, k) - 1 AS part, text FROM merged")
def _(spark, d):
    paged = lines(spark, d).withColumn("page", F.floor((F.col("line_no") - 1) / 12))
    return K.book_paragraphs(K.paragraphs(paged), 60)


@register("s11_line_tables", f"WITH {LINES} SELECT doc, count(*)::BIGINT AS n, max(line_no)::BIGINT AS last FROM lines GROUP BY doc")
def _(spark, d):
    return lines(spark, d).groupBy("doc").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))


def _packed_lines(content: bytes):
    """Lines of a packed file: document, page, number and text, by tabs; where on its page a line is follows from its number."""
    for line in content.split(b"\n")[:-1]:
        doc, page, number, text = line.decode().split("\t", 3)
        top = float(int(number) % PAGE_LINES)
        yield int(page), int(number), f"{doc}\t{text}", top, top + 1


PAGE_LINES = 40


@register("s11_page_lines", f"SELECT doc_id, ((k - 1) // {PAGE_LINES})::BIGINT AS page, (k - 1)::BIGINT AS line_no, ((k - 1) % {PAGE_LINES})::DOUBLE AS top, md5(line) AS digest FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))")
def _(spark, d):
    path = scratch(spark)
    rows = docs(spark, d).where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    packed = rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.floor(F.col("k") / PAGE_LINES).cast("string"), F.col("k").cast("string"), "line").alias("value"))
    packed.write.option("maxRecordsPerFile", 50_000).text(path)  # a file is read whole by one task
    found = readers.page_lines(spark, path, _packed_lines, "part-*")
    both = F.split("text", "\t", 2)
    return found.select(both[0].cast("long").alias("doc_id"), "page", "line_no", "top", F.md5(both[1]).alias("digest"))


@register("j2_window_rows", Q.query(Q.wins(), "SELECT symbol, start_idx, i::BIGINT AS i, idx FROM wins"))
def _(spark, d):
    return market.wins(spark, d).select("symbol", "start_idx", "i", "idx")


@register("j4_preceding_swings", Q.query(Q.near(2, 5), "SELECT symbol, start_idx, i::BIGINT AS i, nh.idx::BIGINT AS swing_idx, (i - nh.idx)::BIGINT AS age FROM near WHERE nh IS NOT NULL"))
def _(spark, d):
    n = market.near(spark, d, 2, 5).where("near_high is not null")
    return n.select("symbol", "start_idx", "i", F.col("near_high.idx").alias("swing_idx"), (F.col("i") - F.col("near_high.idx")).alias("age"))


@register("j7_new_tokens", f"SELECT DISTINCT w AS token FROM (SELECT unnest(string_split({NORM}, ' ')) AS w FROM documents) WHERE w <> '' AND w NOT IN (SELECT unnest(string_split({NORM}, ' ')) FROM benchmark)")
def _(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(F.split(K.normalised(F.col("text")), " ")).alias("token")).where("token <> ''").distinct()
    return words("documents").join(words("benchmark"), "token", "left_anti")


@register("n13_shifted_charts", Q.query(
    f"""{Q.candles()}, ends AS (SELECT symbol, start_idx, min(least(o, h, l, c)) AS lo, max(greatest(o, h, l, c)) AS hi FROM candles GROUP BY ALL), moves AS (SELECT symbol, start_idx, unnest(range(-lo, 1024 - hi))::BIGINT AS x FROM ends),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_idx ORDER BY {pick_sql(42, 'symbol', 'start_idx', 'x')}, x) AS rn FROM moves WHERE x <> 0), chosen AS (SELECT symbol, start_idx, x AS "by" FROM ranked WHERE rn <= 10 UNION ALL SELECT symbol, start_idx, 0 FROM ends)""",
    """SELECT symbol, start_idx, "by", md5('<chart> ' || string_agg(format('O_{} H_{} L_{} C_{}', o + "by", h + "by", l + "by", c + "by"), ' ' ORDER BY i) || ' </chart>') AS digest FROM chosen JOIN candles USING (symbol, start_idx) GROUP BY ALL""",
))
def _(spark, d):
    return G.shifted_charts(charts(spark, d)).select("symbol", "start_idx", "by", F.md5("text").alias("digest"))


@register("r18_raw_chart_rows", Q.query(TEXTS, "SELECT symbol, start_idx, regexp_replace(text, '([OHLC]_\\d+)', '<px_\\1>', 'g') AS text FROM charts"))
def _(spark, d):
    return charts(spark, d).select("symbol", "start_idx", codec.chart_text(codec.parse_candles(F.col("text")), pixel=True).alias("text"))


# generators


@register("r11_price_facts", f"SELECT i::BIGINT AS i, letter, CASE WHEN {pick_sql(42, 'letter', 'i')} % 2 = 0 THEN letter || '_' || i || ' is a ' || name || ' at bin ' || i || '.' ELSE 'A ' || name || ' at bin ' || i || ' is written ' || letter || '_' || i || '.' END AS text FROM range(1024) t(i), (VALUES ('O', 'open'), ('H', 'high'), ('L', 'low'), ('C', 'close')) x(letter, name)")
def _(spark, d):
    return G.price_facts(spark).select("i", "letter", "text")


def _rnd(lo: str, hi: str, *keys: str) -> str:
    return f"({lo} + {pick_sql(42, *keys)} % ({hi} - {lo} + 1))"


@register(
    "r12_full_candles",
    f"""WITH b AS (SELECT id // 10 AS i, id % 10 AS k FROM range(10240) t(id)), h AS (SELECT *, least(i + {_rnd('0', '20', 'i', 'k', "'a'", "'h'")}, 1023) AS high, greatest(i - {_rnd('0', '20', 'i', 'k', "'a'", "'l'")}, 0) AS low FROM b)
    SELECT i::BIGINT AS i, k::BIGINT AS k, high::BIGINT AS high, low::BIGINT AS low, {_rnd('low', 'high', 'i', 'k', "'a'", "'c'")}::BIGINT AS close FROM h""",
)
def _(spark, d):
    return G.full_candles(spark, each=10).select("i", "k", "high", "low", "close")


_AK = ("i", "j || '/' || way")
@register(
    "r13_gap_pairs",
    f"""WITH b AS (SELECT id // 5 AS i, id % 5 AS j, way FROM range(5120) t(id), (VALUES ('GAP_UP'), ('GAP_DOWN')) x(way)),
    h AS (SELECT *, least(i + {_rnd('0', '20', *_AK, "'a'", "'h'")}, 1023) AS high, greatest(i - {_rnd('0', '20', *_AK, "'a'", "'l'")}, 0) AS low FROM b),
    c AS (SELECT *, {_rnd('low', 'high', *_AK, "'a'", "'c'")} AS close, {_rnd('1', '10', *_AK, "'gap'")} AS gap FROM h), o AS (SELECT *, CASE WHEN way = 'GAP_UP' THEN close + gap ELSE close - gap END AS open2 FROM c)
    SELECT i::BIGINT AS i, j::BIGINT AS j, way, least(close, open2)::BIGINT AS gap_low, greatest(close, open2)::BIGINT AS gap_high FROM o WHERE open2 BETWEEN 0 AND 1023""",
)
def _(spark, d):
    return G.gap_pairs(spark).select("i", "j", "way", "gap_low", "gap_high")


@register(
    "r14_arithmetic",
    f"""WITH b AS (SELECT x, op, abs(x - {_rnd('0', '20', 'x', 'op')}) AS c FROM range(1024) t(x), (VALUES ('sub'), ('dist')) y(op)), m AS (SELECT x, op, greatest(x, c) AS a, least(x, c) AS b FROM b)
    SELECT x::BIGINT AS x, op, CASE WHEN op = 'sub' THEN a || ' minus ' || b || ' is ' || (a - b) || '.' ELSE 'From bin ' || b || ' to bin ' || a || ' it is ' || (a - b) || ' bins.' END AS text FROM m""",
)
def _(spark, d):
    return G.arithmetic(spark).select("x", "op", "text")


def _way1(o: str = "o", c: str = "c") -> str:
    return f"CASE WHEN {c} - {o} > 1 THEN 'BULL' WHEN {o} - {c} > 1 THEN 'BEAR' ELSE 'DOJI' END"


_SPAN = "(CASE WHEN h = l THEN 1 ELSE h - l END)"
CURRICULUM = f"""{Q.near()}, base AS (SELECT *, i + 1 AS no, {_way1()} AS way, lag(o) OVER w AS po, lag(c) OVER w AS pc, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM sw WINDOW w AS ({Q.CW})),
marked AS (SELECT *, CASE WHEN l > h2 THEN 'rising' WHEN h < l2 THEN 'falling' END AS gap, coalesce(
  CASE WHEN abs(c - o) <= 0.3::DOUBLE * {_SPAN} AND least(o, c) - l >= 0.6::DOUBLE * {_SPAN} AND h - greatest(o, c) < 0.5::DOUBLE * (least(o, c) - l) THEN 'hammer' WHEN abs(c - o) <= 0.3::DOUBLE * {_SPAN} AND h - greatest(o, c) >= 0.6::DOUBLE * {_SPAN} AND least(o, c) - l < 0.5::DOUBLE * (h - greatest(o, c)) THEN 'shooting_star' END,
  CASE WHEN {_way1('po', 'pc')} = 'BEAR' AND way = 'BULL' AND o <= pc AND c >= po THEN 'bullish_engulfing' WHEN {_way1('po', 'pc')} = 'BULL' AND way = 'BEAR' AND o >= pc AND c <= po THEN 'bearish_engulfing' END) AS pattern,
  concat_ws(', ', CASE WHEN swing_high THEN 'swing high' END, CASE WHEN swing_low THEN 'swing low' END, CASE WHEN l > h2 OR h < l2 THEN 'gap' END) AS roles FROM base),
layers AS MATERIALIZED (SELECT symbol, start_idx, '{U.CONCEPT}' AS layer0, string_agg('Candle ' || no || ': ' || lower(way) || '.', chr(10) ORDER BY i) AS layer1, 'The last close is at ' || max_by(c, i) || '.' AS layer2,
  coalesce(string_agg('Candle ' || no || ': ' || concat_ws(', ', CASE WHEN swing_high THEN 'high at ' || h END, CASE WHEN swing_low THEN 'low at ' || l END) || '.', chr(10) ORDER BY i) FILTER (swing_high OR swing_low), 'None.') AS layer3,
  coalesce(string_agg('Candle ' || no || ': ' || gap || '.', chr(10) ORDER BY i) FILTER (gap IS NOT NULL), 'None.') AS layer4,
  coalesce(string_agg('Candle ' || no || ': ' || lower(way) || ', ' || roles || '.', chr(10) ORDER BY i) FILTER (way <> 'DOJI' AND roles <> ''), 'None.') AS layer5,
  coalesce(string_agg('Candle ' || no || ': ' || pattern || '.', chr(10) ORDER BY i) FILTER (pattern IS NOT NULL), 'None.') AS layer6 FROM marked GROUP BY symbol, start_idx)"""


@register("r8_curriculum_layers", Q.query(CURRICULUM, "SELECT * FROM layers"))
def _(spark, d):
    return U.layers(candles(spark, d))


@register("r9_assembled_curricula", Q.query(CURRICULUM, "SELECT symbol, start_idx, 7::BIGINT AS num_layers, " + " || chr(10) || chr(10) || ".join(f"'=== {h} ===' || chr(10) || layer{n}" for n, h in enumerate(U.HEADS)) + " AS text FROM layers"))
def _(spark, d):
    every = F.sequence(F.lit(0), F.lit(len(U.HEADS) - 1))
    return U.assemble(U.layers(candles(spark, d)), every)


_SIZE = f"(2 + {pick_sql(42, 'symbol', 'start_idx', chr(39) + 'size' + chr(39))} % 6)"
_START = f"({pick_sql(42, 'symbol', 'start_idx', chr(39) + 'start' + chr(39))} % (7 - {_SIZE} + 1))"
_MODE = f"{pick_sql(42, 'symbol', 'start_idx', chr(39) + 'mode' + chr(39))} % 2"
_LAYER = f"{pick_sql(42, 'symbol', 'start_idx', chr(39) + 'layer' + chr(39) + ' || k')}"


@register(
    "o9_random_layers",
    Q.query(f"{Q.wins()}, ch AS (SELECT DISTINCT symbol, start_idx FROM wins), r AS (SELECT symbol, start_idx, k, row_number() OVER (PARTITION BY symbol, start_idx ORDER BY {_LAYER}, k) AS rn FROM ch, range(7) t(k))",
    f"SELECT symbol, start_idx, string_agg(k::VARCHAR, ',' ORDER BY k) AS layers FROM r WHERE CASE WHEN {_MODE} = 0 THEN k >= {_START} AND k < {_START} + {_SIZE} ELSE rn <= {_SIZE} END GROUP BY symbol, start_idx"),
)
def _(spark, d):
    k = market.wins(spark, d).select("symbol", "start_idx").distinct()
    return k.select("symbol", "start_idx", F.array_join(U.random_layers("symbol", "start_idx").cast("array<string>"), ",").alias("layers"))


_CHOSEN = f"""{CURRICULUM}, rnk AS (SELECT symbol, start_idx, k, row_number() OVER (PARTITION BY symbol, start_idx ORDER BY {_LAYER}, k) AS rn FROM layers, range(7) t(k)),
chosen AS (SELECT symbol, start_idx, list(k ORDER BY k) AS ks FROM rnk WHERE CASE WHEN {_MODE} = 0 THEN k >= {_START} AND k < {_START} + {_SIZE} ELSE rn <= {_SIZE} END GROUP BY symbol, start_idx),
rows_ AS (SELECT start_idx, ks, array_to_string(list_transform(ks, lambda k: '=== ' || {list(U.HEADS)}[k + 1] || ' ===' || chr(10) || [layer0, layer1, layer2, layer3, layer4, layer5, layer6][k + 1]), chr(10) || chr(10)) AS text FROM layers JOIN chosen USING (symbol, start_idx))"""


@register("r10_curriculum_rows", Q.query(_CHOSEN, """SELECT text, 'curriculum' AS source, length(text)::BIGINT AS token_length, '{"source_chart_index":' || start_idx || ',"slice_start":0,"slice_end":20,"num_candles":20,"num_layers":' || len(ks) || '}' AS meta FROM rows_"""))
def _(spark, d):
    k = candles(spark, d)
    text = U.assemble(U.layers(k), U.random_layers("symbol", "start_idx"))
    meta = F.to_json(F.struct(F.col("start_idx").alias("source_chart_index"), F.lit(0).alias("slice_start"), F.lit(20).alias("slice_end"), F.lit(20).alias("num_candles"), "num_layers"))
    return text.select("text", F.lit("curriculum").alias("source"), F.length("text").cast("long").alias("token_length"), meta.alias("meta"))


@register("r2_projected_fields", Q.query(Q.events(), "SELECT symbol, start_idx, seq::BIGINT AS seq, kind, (candle_idx + 1)::BIGINT AS c, (swing_idx + 1)::BIGINT AS sc FROM facts"))
def _(spark, d):
    return D.events(candles(spark, d), "BULL").select("symbol", "start_idx", "seq", "kind", (F.col("candle_idx") + 1).alias("c"), (F.col("swing_idx") + 1).alias("sc"))


def _field_sql(key: str) -> str:
    return f"nullif(regexp_extract(inner_, '(?:^|[ _]){key}=(\\S+)', 1), '')"


def _changed(inner: str, key: str, value: str) -> str:
    return f"regexp_replace({inner}, '^((?s:.*?)(?:^|[ _]){key}=)\\S+', '\\1' || ({value})::VARCHAR)"


def _flip(x: str, *pairs: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in (p.split("/") for p in pairs)) + " END"


def _stepped(key: str, steps) -> str:
    return f"{list(steps)}[{pick_sql(42, 'symbol', 'start_idx', 'sample_type', _quoted(key))} % {len(steps)} + 1]"


def _quoted(text: str) -> str:
    return f"'{text}'"


_NEGATIVES = f"""plain AS (SELECT *, replace(replace(eval, '<eval>', ''), '</eval>', '') AS inner_ FROM samples WHERE sample_type <> 'synthesis'),
fs AS (SELECT *, {_field_sql('T')} AS ft, {_field_sql('DIR')} AS fd, {_field_sql('C')}::BIGINT AS fc, {_field_sql('SL')}::BIGINT AS fl, {_field_sql('GS')}::BIGINT AS fg FROM plain),
ng AS (SELECT *, list_filter([CASE WHEN ft IN ('SWEEP_HIGH', 'SWEEP_LOW', 'BULL', 'BEAR') THEN {_changed('inner_', 'T', _flip('ft', 'SWEEP_HIGH/SWEEP_LOW', 'BULL/BEAR'))} WHEN ft IN ('BOS', 'CHoCH') AND fd IS NOT NULL THEN {_changed(_changed('inner_', 'T', _flip('ft', 'BOS/CHoCH')), 'DIR', _flip('fd', 'BULL/BEAR'))} END,
  CASE WHEN fc IS NOT NULL THEN {_changed('inner_', 'C', f"fc + {_stepped('C', E._CANDLE_STEPS)}")} END, CASE WHEN fl IS NOT NULL THEN {_changed('inner_', 'SL', f"fl + {_stepped('SL', E._LEVEL_STEPS)}")} END,
  CASE WHEN fg IS NOT NULL THEN {_changed('inner_', 'GS', f"greatest(fg + {_stepped('GS', E._SIZE_STEPS)}, 1)")} END], lambda x: x IS NOT NULL) AS negatives FROM fs)"""


@register("r19_bench_items", Q.query(f"{SAMPLES}, {_NEGATIVES}", "SELECT symbol, start_idx, sample_type AS note, inner_ AS positive, CASE WHEN event_count > 1 THEN 'multi' ELSE 'single' END AS template_mode, event_count::BIGINT AS n_events, len(negatives)::BIGINT AS n_negatives, array_to_string(negatives, '|') AS negatives FROM ng WHERE len(negatives) > 0"))
def _(spark, d):
    items = E.bench_items(samples(spark, d), ["symbol", "start_idx", "sample_type"])
    return items.select("symbol", "start_idx", "note", "positive", "template_mode", "n_events", F.size("negatives").alias("n_negatives"), F.array_join("negatives", "|").alias("negatives"))


@register(
    "o11_nucleus",
    f"""WITH {vocab.lm("SELECT u, v, one.w FROM (SELECT t[len(t) - 1] AS u, t[len(t)] AS v FROM items WHERE len(t) >= 2), one", True).replace("chance AS", vocab._ITEMS + ", chance AS")},
    l AS (SELECT u || ' ' || v AS context, w::VARCHAR AS w, round(ln(p), 9) AS logit FROM chance), r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY logit DESC, w) AS r FROM l),
    e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY context)) / 0.8::DOUBLE) AS e FROM r WHERE r <= 20), p AS (SELECT *, e / sum(e) OVER (PARTITION BY context) AS p FROM e),
    b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY context ORDER BY logit DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
    SELECT context, w AS token, round(p / sum(p) OVER (PARTITION BY context), 6) AS p FROM b WHERE b < 0.7::DOUBLE""",
)
def _(spark, d):
    last = vocab.items(spark, d).where(F.size("tokens") >= 2).select(F.element_at("tokens", -2).alias("u"), F.element_at("tokens", -1).alias("v"))
    chances = N.next_chances(last, vocab.model(spark, d)).select(F.concat_ws(" ", "u", "v").alias("context"), F.when(F.col("w") == vocab.END, "</s>").otherwise(F.col("w").cast("string")).alias("token"), F.round(F.log("p"), 9).alias("logit"))
    return E.nucleus(chances, "context", "token", "logit", 20, 0.7, 0.8)


@register("k7_saved_state", "SELECT count(*)::BIGINT AS done, sum(n_chars)::BIGINT AS tokens FROM documents")
def _(spark, d):
    path = f"{scratch(spark)}/state.json"
    total = docs(spark, d).agg(F.count("*").alias("done"), F.sum("n_chars").alias("tokens")).first()
    sinks.save_state(spark, path, {"done": 0, "tokens": 0})
    sinks.save_state(spark, path, total.asDict())
    state = sinks.load_state(spark, path)
    return spark.createDataFrame([(state["done"], state["tokens"])], "done long, tokens long")


@register("k8_cached_table", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 100")
def _(spark, d):
    path = scratch(spark)
    build = lambda: docs(spark, d).select("doc_id", "n_chars").where("n_chars > 100")
    sinks.cached(spark, path, build)
    return sinks.cached(spark, path, lambda: build().limit(0))  # it is there, so this is not built


@register("k8_cached_shards", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE doc_id IS NOT NULL")
def _(spark, d):
    source, path = scratch(spark), scratch(spark)
    rows = docs(spark, d).select("doc_id", "text")
    sinks.write_parquet(rows.where("doc_id IS NOT NULL").withColumn("text", F.lit("old")).limit(10), f"{source}/a")
    build = lambda df: df.select("doc_id", F.length("text").alias("n"), "shard_")
    sinks.cached_shards(spark, path, source, build).count()
    sinks.write_parquet(rows.where("doc_id IS NOT NULL"), f"{source}/a", mode="overwrite")  # all that was there has changed
    return sinks.cached_shards(spark, path, source, build)


# tokens


def _closed(x: str) -> str:
    return f"CASE WHEN {x} = '<chart>' THEN 4 WHEN {x} = '</chart>' THEN 5 WHEN regexp_full_match({x}, '[OHLC]_\\d{{1,4}}') AND {x}[3:]::INT < 1024 THEN 6 + (strpos('OHLC', {x}[1]) - 1) * 1024 + {x}[3:]::INT ELSE 3 END"


@register("x1_price_vocabulary", "SELECT letter || '_' || bin AS token, (50000 + (strpos('OHLC', letter) - 1) * 1024 + bin)::BIGINT AS id FROM (VALUES ('O'), ('H'), ('L'), ('C')) a(letter), range(1024) t(bin)")
def _(spark, d):
    v = spark.range(1024).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*map(F.lit, codec.LETTERS))).alias("letter"))
    return v.select(F.concat_ws("_", "letter", "bin").alias("token"), X.price_id(F.col("letter"), F.col("bin"), 50_000).alias("id"))


@register("x2_closed_ids", Q.query(TEXTS, f"SELECT symbol, start_idx, list_sum(list_transform(string_split(text, ' '), lambda x: {_closed('x')}))::BIGINT AS total, len(string_split(text, ' '))::BIGINT AS n FROM charts"))
def _(spark, d):
    i = X.closed_ids(F.col("text"))
    return charts(spark, d).select("symbol", "start_idx", F.aggregate(i, F.lit(0), lambda a, x: a + x).alias("total"), F.size(i).alias("n"))


@register("x3_price_segments", Q.query(TEXTS, "SELECT symbol, start_idx, 81::BIGINT AS loose, 80::BIGINT AS strict FROM charts"))
def _(spark, d):
    t = F.concat("text", F.lit(" then O_5 and O_2000 end"))
    return charts(spark, d).select("symbol", "start_idx", F.size(X.price_segments(t)).alias("loose"), F.size(X.price_segments(t, strict=True)).alias("strict"))


@register("x4_decoded_ids", Q.query(TEXTS, "SELECT symbol, start_idx, text FROM charts"))
def _(spark, d):
    return charts(spark, d).select("symbol", "start_idx", X.closed_text(X.closed_ids(F.col("text"))).alias("text"))


@register("x4_encoded_ids", Q.query(f"{TEXTS}, {TRAINED}", "SELECT symbol, start_idx, (len(string_split(text, ' ')) * (256 + (SELECT max(r) FROM st)) + list_sum(list_transform(string_split(text, ' '), lambda x: CASE WHEN x = '<chart>' THEN 4096 WHEN x = '</chart>' THEN 4097 ELSE (strpos('OHLC', x[1]) - 1) * 1024 + x[3:]::INT END)))::BIGINT AS total, len(string_split(text, ' '))::BIGINT AS n FROM charts"))
def _(spark, d):
    rows = B.encoded(charts(spark, d).select("symbol", "start_idx", "text"), "text", vocabulary(spark, d))
    return rows.select("symbol", "start_idx", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("ids").alias("n"))


@register("x4_token_ids", f"WITH {IDS} SELECT doc_id, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS ids_md5 FROM ids")
def _(spark, d):
    return ids(spark, d).select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@register("x4_text_round_trip", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def _(spark, d):
    merges = vocabulary(spark, d)
    rows = B.encoded(docs(spark, d).select("doc_id", "text"), "text", merges, prices=False)
    return B.spelt(rows.drop("text"), "ids", merges, "text").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@register("x5_token_lengths", f"WITH {IDS} SELECT doc_id, len(ids)::BIGINT AS token_length FROM ids")
def _(spark, d):
    return ids(spark, d).select("doc_id", F.size("ids").alias("token_length"))


@register("x6_end_marks", f"WITH {IDS} SELECT doc_id, len(ids)::BIGINT + 1 AS n, coalesce(list_sum(ids), 0)::BIGINT + 2 AS total FROM ids")
def _(spark, d):
    e = X.with_eos(F.col("ids"))
    return ids(spark, d).select("doc_id", F.size(e).alias("n"), F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_SUMS = "len(b)::BIGINT AS n, list_sum(b)::BIGINT AS total, b[1]::BIGINT AS first, md5(array_to_string(b, ',')) AS digest"


def _sums(df, *keep):
    return df.select(*keep, F.size("b").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("b")[0].alias("first"), F.md5(F.array_join(F.col("b").cast("array<string>"), ",")).alias("digest"))


@register("x7_packed_blocks", f"WITH {IDS}, g AS (SELECT doc_id // 100 AS grp, flatten(list(list_append(ids, 2) ORDER BY doc_id)) AS a FROM ids GROUP BY 1), c AS (SELECT grp, a, unnest(range(greatest(len(a) // 256, 1))) AS block FROM g), x AS (SELECT grp, block, a[block * 256 + 1 : block * 256 + 256] AS b FROM c) SELECT grp, block, {_SUMS} FROM x")
def _(spark, d):
    p = X.packed(ids(spark, d).withColumn("grp", F.floor(F.col("doc_id") / 100)), "grp", "doc_id", "ids", 256)
    return _sums(p.withColumnRenamed("ids", "b"), "grp", "block")


@register("x8_segments", f"""WITH {IDS}, f AS (SELECT doc_id, ids, len(ids) // 129 AS n FROM ids WHERE len(ids) >= 8), s AS (SELECT doc_id, k, ids[k * 129 + 1 : k * 129 + 129] AS b FROM (SELECT *, unnest(range(n)) AS k FROM f)
    UNION ALL SELECT doc_id, n, ids[greatest(len(ids) - 128, 1) : len(ids)] FROM f WHERE len(ids) - n * 129 >= 65) SELECT doc_id, k::BIGINT AS k, {_SUMS} FROM s""")
def _(spark, d):
    return _sums(ids(spark, d).select("doc_id", F.posexplode(X.segments(F.col("ids"), 128)).alias("k", "b")), "doc_id", "k")


@register("x9_strided_windows", f"""WITH {IDS}, f AS (SELECT doc_id, ids, CASE WHEN len(ids) >= 129 THEN (len(ids) - 129) // 64 + 1 ELSE 0 END AS n FROM ids WHERE len(ids) >= 8), s AS (SELECT doc_id, k, ids[k * 64 + 1 : k * 64 + 129] AS b FROM (SELECT *, unnest(range(n)) AS k FROM f)
    UNION ALL SELECT doc_id, n, ids[greatest(len(ids) - 128, 1) : len(ids)] FROM f WHERE len(ids) - (greatest(n - 1, 0) * 64 + 129) >= 64) SELECT doc_id, k::BIGINT AS k, {_SUMS} FROM s""")
def _(spark, d):
    return _sums(ids(spark, d).select("doc_id", F.posexplode(X.strided(F.col("ids"), 128, 64)).alias("k", "b")), "doc_id", "k")


@register("x10_collated", f"""WITH {IDS}, m AS (SELECT doc_id, ids, max(len(ids) - 1) OVER (PARTITION BY doc_id // 8) AS n FROM ids)
    SELECT doc_id, n::BIGINT AS n, (list_sum(ids) - ids[len(ids)])::BIGINT AS inputs, (list_sum(ids) - ids[1] - 100 * (n - len(ids) + 1))::BIGINT AS labels FROM m""")
def _(spark, d):
    own = F.when(F.col("doc_id").isNotNull(), F.col("ids")).otherwise(F.array().cast("array<int>"))  # the SQL finds ids by doc_id
    c = X.collated(ids(spark, d).select("doc_id", own.alias("ids"), F.expr("doc_id div 8").alias("batch")), ["batch"], "ids")
    total = lambda x: F.when(F.size("ids") > 0, F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))
    return c.select("doc_id", F.col("length").alias("n"), total("input_ids").alias("inputs"), total("labels").alias("labels"))


@register("x11_fixed_length", f"WITH {IDS} SELECT doc_id, 402::BIGINT AS n, coalesce(list_sum(ids[1:402]), 0)::BIGINT AS total FROM ids")
def _(spark, d):
    f = X.fixed(F.col("ids"))
    return ids(spark, d).select("doc_id", F.size(f).alias("n"), F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("x12_chunks", f"WITH {IDS} SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk FROM ids WHERE length(trim(text)) >= 200 AND len(ids) >= 2")
def _(spark, d):
    return X.chunked(ids(spark, d), "text", "ids", "doc_id", 128).select("doc_id", "chunk")


@register("x13_bpe_merges", f"WITH RECURSIVE {TRAINED} SELECT r - 1 AS rank, min(unicode(p[1]))::BIGINT AS left, min(unicode(p[2]))::BIGINT AS right, min(c)::BIGINT AS count FROM st WHERE r > 0 GROUP BY r")
def _(spark, d):
    return B.merges_frame(spark, vocabulary(spark, d)).drop("token")


@register("x14_vocabulary_check", "SELECT 4102::BIGINT AS size, 4160::BIGINT AS padded")
def _(spark, d):
    X.check_vocabulary(X.CLOSED_SIZE, {"pad": X.PAD, "bos": X.BOS, "eos": X.EOS, "unk": X.UNK})
    return spark.createDataFrame([(X.FIRST_PRICE + 4 * codec.BINS, -(-X.CLOSED_SIZE // 64) * 64 if X.CLOSED_SIZE % 64 else X.CLOSED_SIZE)], "size long, padded long")


@register("x15_step_budget", "SELECT source, sum(n_chars)::BIGINT // (512 * 4) AS steps, floor((sum(n_chars)::BIGINT // (512 * 4)) * 0.01::DOUBLE)::BIGINT AS warmup FROM documents GROUP BY source")
def _(spark, d):
    steps, warm = E.step_budget(F.sum("n_chars"), 512, 4)
    return docs(spark, d).groupBy("source").agg(steps.alias("steps"), warm.alias("warmup"))


_LOSSES = "l AS MATERIALIZED (SELECT doc_id, lang, held, count(*) AS n, sum(-ln(p)) AS loss FROM g JOIN chance USING (u, v, w) GROUP BY ALL)"


@register("x16_weighted_loss", f"WITH {vocab.lm('SELECT u, v, w FROM g')}, {_LOSSES} SELECT lang, held, round(sum(loss) / sum(n), 6) AS loss, round(exp(least(sum(loss) / sum(n), 20)), 6) AS perplexity FROM l GROUP BY ALL")
def _(spark, d):
    found = vocab.document_losses(spark, d, "doc_id", "lang", "held")
    return E.weighted_loss(found, "loss", "n", "lang", "held")


@register("x17_perplexity", f"WITH {vocab.lm('SELECT u, v, w FROM g')}, {_LOSSES} SELECT doc_id, held, n::BIGINT AS n, round(exp(least(loss / n, 20)), 4) AS perplexity FROM l")
def _(spark, d):
    found = vocab.document_losses(spark, d, "doc_id", "held")
    return found.select("doc_id", "held", "n", F.round(F.exp(F.least(F.col("loss") / F.col("n"), F.lit(20.0))), 4).alias("perplexity"))


@register("x17_chances_of_contexts", f"WITH {vocab.lm('SELECT u, v, w FROM g')} SELECT held, count(*)::BIGINT AS n, round(min(p), 9) AS least, round(avg(p), 6) AS mean FROM g JOIN chance USING (u, v, w) GROUP BY held")
def _(spark, d):
    grams = materialised(N.counted(vocab.sequences(spark, d), "tokens", "held", marks=(vocab.BEGIN, vocab.END)).withColumnRenamed("c", "n"))
    model = N.fit_counts(grams.where("NOT held").select("u", "v", "w", F.col("n").alias("c")), vocab.BEGIN, vocab.END)
    p = N.with_chance(grams, model).select(*(F.col(c).alias(f"{c}_") for c in "uvw"), "p")
    both = grams.join(p, (F.col("u") == F.col("u_")) & (F.col("v") == F.col("v_")) & (F.col("w") == F.col("w_")))
    return both.groupBy("held").agg(F.sum("n").alias("n"), F.round(F.min("p"), 9).alias("least"), F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("mean"))


@register("x18_learning_rates", "SELECT step, round(CASE WHEN step < 50 THEN step / 50.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * ((step - 50) % 300) / 300.0::DOUBLE)) END, 6) AS rate FROM range(1000) t(step)")
def _(spark, d):
    return spark.range(1000).select(F.col("id").alias("step"), E.learning_rate(F.col("id"), 50, 300).alias("rate"))


@register("x19_converted_tokens", Q.query(TEXTS, "SELECT symbol, start_idx, md5(regexp_replace(text, '([OHLC]_\\d+)', '<px_\\1>', 'g')) AS digest FROM charts"))
def _(spark, d):
    return charts(spark, d).select("symbol", "start_idx", F.md5(codec.pixel_tokens(F.col("text"))).alias("digest"))


# evaluation


@register(
    "a10_language_metrics",
    f"""WITH {IDS}, t AS (SELECT lang, unnest(ids) AS t FROM ids), o AS (SELECT lang, count(*) AS n1, count(DISTINCT t) AS d1 FROM t GROUP BY lang),
    p AS (SELECT lang, unnest(list_zip(ids[1:len(ids) - 1], ids[2:len(ids)])) AS p FROM ids WHERE len(ids) >= 2), q AS (SELECT lang, count(*) AS n2, count(DISTINCT p) AS d2, count(*) FILTER (p[1] = p[2]) AS same FROM p GROUP BY lang)
    SELECT lang, round(d1::DOUBLE / n1, 6) AS distinct1, round(d2::DOUBLE / n2, 6) AS distinct2, round(same::DOUBLE / (n1 - 1), 6) AS repeat_ratio, round((d1::DOUBLE / n1 + d2::DOUBLE / n2) / 2 - same::DOUBLE / (n1 - 1), 6) AS language_score FROM o JOIN q USING (lang)""",
)
def _(spark, d):
    return E.language_metrics(ids(spark, d), "ids", "lang")


@register("a11_total_scores", "SELECT doc_id, round(0.2::DOUBLE * (doc_id % 7) + 0.2::DOUBLE * (doc_id % 5) + 0.3::DOUBLE * (doc_id % 3) + 0.2::DOUBLE * (doc_id % 2) + 0.1::DOUBLE * (doc_id % 11), 6) AS total FROM documents")
def _(spark, d):
    parts = {n: F.col("doc_id") % k for n, k in zip(E.WEIGHTS, (7, 5, 3, 2, 11), strict=True)}
    return docs(spark, d).withColumns(parts).select("doc_id", E.total_score().alias("total"))


@register("a12_score_report", "SELECT coalesce(lang, 'ALL') AS mode, round(avg((doc_id % 9 - 3)::DOUBLE), 6) AS avg, round(avg((doc_id % 9 > 3)::INT::DOUBLE), 6) AS pass_rate, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (lang)")
def _(spark, d):
    return E.score_report(docs(spark, d).withColumn("score", (F.col("doc_id") % 9 - 3).cast("double")), "score", "lang")


@register("a13_accuracy", f"WITH {vocab.lm('SELECT u, v, w FROM cg', True).replace('chance AS', vocab._CHOICES + ', chance AS')}, s AS (SELECT item_id, r % 4 AS label, k, round(sum(ln(p)) / count(*), 9) AS score FROM cg JOIN chance USING (u, v, w) GROUP BY ALL), b AS (SELECT item_id, label, arg_min(k, {{'s': -score, 'k': k}}) AS best FROM s GROUP BY ALL) SELECT count(*)::BIGINT AS n, round(avg((best = label)::INT::DOUBLE), 6) AS accuracy, round(avg((best = label)::INT::DOUBLE) - 0.25, 6) AS over_chance FROM b")
def _(spark, d):
    found = N.losses(vocab.choices(spark, d), "tokens", vocab.model(spark, d), "item_id", "label", "k", whole=False)
    scored = found.groupBy("item_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.round(-F.col("loss") / F.col("n"), 9).alias("s")))), lambda x: x["s"]).alias("scores"))
    return E.accuracy(scored, "scores", "label")
