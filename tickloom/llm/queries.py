"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, fingerprint, language, line_dedup, mixing, near_dup, pii, secrets, toxicity, trie, warc
from .common import held_out, stash, working


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.col("predicted"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "version")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    spans = F.array_join(F.transform(F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), spans.alias("spans"), *(f"n_{v}" for v in secrets.VERDICTS), "most_repositories")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(extra)).withColumn("back", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.learned(F.col("segments"))
    agrees = learned == F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    out = out.withColumns({"learned": learned, "mask_agrees": agrees})
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn", "mask_agrees")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", "n_copied", F.sha2("text", 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added", "mean_chance")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _rebuilt(convs: DataFrame) -> DataFrame:
    """``conv_id, cells``: the first h turns of the conversation that opens the hundred, h by a hash of the id, then the own turns from there on."""
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("cells", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    own = F.slice("cells", h + 1, F.size("cells"))
    return convs.join(heads, base == F.col("base"), "left").select("conv_id", F.concat(head, own).alias("cells"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_rebuilt(trie.turn_cells(_table(spark, sf_dir, "conversations"))))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(_table(spark, sf_dir, "documents")).drop("groups")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with working(spark) as keep:
        archives = stash(warc.write_archives(_table(spark, sf_dir, "pages")), "manifest")
        records = warc.resolved(stash(warc.read_archives(archives), "read"))  # read once, used on both sides of a join
        return keep(stash(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"), "records"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprint": op2_fingerprint,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_align": op12_align,
    "op13_warc": op13_warc,
}

_TEMPLATE = chat.ChatTemplate()


def _chat_sql() -> str:
    """Op 4 from the turns themselves: what is read back must be what went in."""
    escaped = lambda c: f"(length({c}) + " + " + ".join(f"length({c}) - length(replace({c}, '{x}', ''))" for x in ("\\", *_TEMPLATE.heads)) + ")"
    marks = " ".join(f"WHEN role = '{r}' THEN {len(b) + len(a)}" for r, (b, a) in _TEMPLATE.markers.items())
    other = f"{sum(len(m) for m in _TEMPLATE.other)} + {escaped('role')}"
    loss = "FILTER (role IN (" + ", ".join(f"'{r}'" for r in _TEMPLATE.loss) + "))"
    moves = ", ".join(f"'{m}'" for m in _TEMPLATE.moves)
    ends = ", ".join(f"'{r}'" for r in _TEMPLATE.end)
    return f"""WITH probe AS (SELECT '</s>[INST] ok [/INST]' AS x), t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', x FROM probe UNION ALL SELECT -1, 1, 'assistant', x FROM probe),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) {loss}, '') AS learned,
  sum({escaped('text')} + CASE {marks} ELSE {other} END)::BIGINT AS formatted_chars FROM t GROUP BY conv_id),
m AS (SELECT conv_id, role, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, '') || '>' || role AS move, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT conv_id, coalesce(min(CASE WHEN move NOT IN ({moves}) THEN place END), max(CASE WHEN place = n - 1 AND role NOT IN ({ends}) THEN n END))::INTEGER AS bad_turn FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, bad_turn IS NULL AS valid, bad_turn, true AS mask_agrees FROM g JOIN b USING (conv_id)"""


#: Op 5 by comparing all sets that share a shingle.
_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Op 11 with a row for each conversation and depth; crc32 by its table of 256 remainders.
_TRIE_SQL = """WITH RECURSIVE bits(i, x, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, length(text) AS len, md5(length(role) || ':' || role || text) AS turn FROM r),
y AS (SELECT conv_id, d, len, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM q UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
x AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) = d AS last FROM y),
n AS (SELECT k, min(conv_id) AS conv_id, min(d) AS d, min(up) AS up, count(*) AS n, min(len) AS len, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM x GROUP BY k),
m AS (SELECT up, count(*) AS n FROM n GROUP BY up),
s AS (SELECT n.*, coalesce(m.n, 0) AS children FROM n LEFT JOIN m ON m.up = n.k),
a AS (SELECT x.k, sum((s.children = 0)::INT) AS leaves, sum((s.n - 1) * s.len) AS saved FROM s JOIN x ON x.conv_id = s.conv_id AND x.d <= s.d GROUP BY x.k)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n::BIGINT AS n_convs, s.children::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256 FROM s JOIN a ON a.k = s.k LEFT JOIN n p ON p.k = s.up"""

_WARC_SQL = """SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha256(x) AS payload_digest, CASE WHEN strlen(x) >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(x) >= 100 AND page_id <> least THEN least END AS refers_to, true AS verified
FROM (SELECT page_id, x, min(page_id) OVER (PARTITION BY x) AS least FROM (SELECT page_id, coalesce(html, '') AS x FROM pages))"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": _TRIE_SQL,
    "op13_warc": _WARC_SQL,
    "op4_chat_format": _chat_sql(),
    "op5_minhash_near_dedup": _NEAR_SQL,
}
