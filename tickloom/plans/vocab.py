"""The vocabulary that token queries train on their documents, and the documents' ids by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.hashing import pick, pick_sql
from tickloom.functions.ranking import with_order
from tickloom.operators import bpe, ngram

from .registry import table

#: Merges of the vocabulary, and the special ids before its own.
MERGES, SPECIALS = 48, 4
#: Marks of the language model, as ids.
BEGIN, END = -1, -2

_WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = "chr(57344)"
#: Training as a recursion over all words, a merge a step; a character stands for a token. A mark is put where white space
#: before a word is cut, as these patterns do not look ahead.
_TRAINING = rf"""pieces AS MATERIALIZED (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '([{_WHITE}])([{_WHITE}][^{_WHITE}])', '\1' || {_MARK} || '\2', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}\x{{E000}}]+|\x{{E000}}|[{_WHITE}]+'), lambda x: x <> {_MARK}) AS ws FROM (SELECT doc_id, text FROM documents{{more}}) WHERE text IS NOT NULL),
words AS (SELECT w, count(*) FILTER ({{counted}}) AS n, hex(w) AS h FROM (SELECT doc_id, unnest(ws) AS w FROM pieces) GROUP BY w),
st(r, w, s, n, p, c) AS (SELECT 0::BIGINT, w, array_to_string(list_transform(range(length(h) // 2), lambda i: chr(('0x' || substring(h, 2 * i + 1, 2))::INT)), ''), n, NULL::VARCHAR, NULL::HUGEINT FROM words
  UNION ALL SELECT r + 1, w, replace(s, b.p, chr(256 + r::INT)), n, b.p, b.c FROM st, (SELECT p, sum(n) AS c FROM (SELECT unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS p, n FROM st) GROUP BY p
    HAVING sum(n) >= 2 ORDER BY c DESC, unicode(p[1]), unicode(p[2]) LIMIT 1) b WHERE r < {MERGES})"""
TRAINED = _TRAINING.replace("{more}", "").replace("{counted}", "true")
_SPELT = f"""
spelt AS (SELECT w, list_transform(range(1, length(s) + 1), lambda i: unicode(substring(s, i, 1)) + {SPECIALS}) AS ids FROM st WHERE r = (SELECT max(r) FROM st)),
ids AS MATERIALIZED (SELECT d.doc_id, lang, source, text, coalesce(g.ids, []) AS ids FROM documents d
  LEFT JOIN (SELECT doc_id, flatten(list(spelt.ids ORDER BY k)) AS ids FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM pieces) JOIN spelt USING (w) GROUP BY doc_id) g USING (doc_id))"""
IDS = f"RECURSIVE {TRAINED},{_SPELT}"

#: A share of documents trains nothing of the language model; benchmark items are sequences too, with negative ids in ``pieces``, and train nothing.
HELD = 10
_BENCH = _TRAINING.replace("{more}", " UNION ALL SELECT -1 - item_id, text FROM benchmark").replace("{counted}", "doc_id >= 0")


def _order(count: str, total: str, kinds: str, d: str, below: str) -> str:
    return f"CASE WHEN {total} IS NULL THEN {below} ELSE greatest(coalesce({count}, 0) - {d}, 0) / {total} + {d} * {kinds} / {total} * {below} END"


_P1 = "(greatest(coalesce(one.c, 0) - d1, 0) / n1 + d1 * k1 / n1 * (1.0::DOUBLE / (k1 + 1)))"
_P2 = f"({_order('two.c', 'a2.total', 'a2.kinds', 'd2', _P1)})"
_D = "count(*) FILTER (c = 1)::DOUBLE / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2))"
#: Counts of the model, by the definition, and the probabilities of the trigrams of ``asked``, which ``lm`` takes.
_COUNTS = f"""
g AS MATERIALIZED (SELECT doc_id, lang, held, t[i] AS u, t[i + 1] AS v, t[i + 2] AS w FROM (SELECT doc_id, lang, held, t, unnest(range(1, len(t) - 1)) AS i FROM
  (SELECT doc_id, lang, {pick_sql(17, "doc_id")} % {HELD} = 0 AS held, ['<s>', '<s>'] || ids::VARCHAR[] || ['</s>'] AS t FROM ids))),
three AS MATERIALIZED (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held GROUP BY ALL), two AS MATERIALIZED (SELECT v, w, count(*) AS c FROM three GROUP BY ALL), one AS MATERIALIZED (SELECT w, count(*) AS c FROM two GROUP BY ALL),
a3 AS MATERIALIZED (SELECT u, v, sum(c)::DOUBLE AS total, count(*) AS kinds FROM three GROUP BY ALL), a2 AS MATERIALIZED (SELECT v, sum(c)::DOUBLE AS total, count(*) AS kinds FROM two GROUP BY ALL),
d AS MATERIALIZED (SELECT * FROM (SELECT {_D} AS d1, sum(c)::DOUBLE AS n1, count(*) AS k1 FROM one), (SELECT {_D} AS d2 FROM two), (SELECT {_D} AS d3 FROM three))"""


def lm(asked: str, bench: bool = False) -> str:
    """CTEs up to ``chance`` (u, v, w, p); ``asked`` is a query of u, v, w."""
    return f"""RECURSIVE {_BENCH if bench else TRAINED},{_SPELT},{_COUNTS},
chance AS MATERIALIZED (SELECT q.u, q.v, q.w, {_order('three.c', 'a3.total', 'a3.kinds', 'd3', _P2)} AS p FROM (SELECT DISTINCT u, v, w FROM ({asked})) q CROSS JOIN d
  LEFT JOIN three ON three.u = q.u AND three.v = q.v AND three.w = q.w LEFT JOIN a3 ON a3.u = q.u AND a3.v = q.v LEFT JOIN two ON two.v = q.v AND two.w = q.w LEFT JOIN a2 ON a2.v = q.v LEFT JOIN one ON one.w = q.w)"""


#: Tokens of benchmark items, by place; the second half of an item is its ending.
_ITEMS = "items AS MATERIALIZED (SELECT -1 - doc_id AS item_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS r, count(*) OVER () AS n, flatten(list(spelt.ids ORDER BY k))::VARCHAR[] AS t FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM pieces WHERE doc_id < 0) JOIN spelt USING (w) GROUP BY doc_id)"
_CHOICES = f"""{_ITEMS},
choices AS MATERIALIZED (SELECT a.item_id, a.r, k, list_slice(a.t, len(a.t) // 2 - 1, len(a.t) // 2) || list_slice(b.t, len(b.t) // 2 + 1, len(b.t)) AS t FROM items a, range(4) x(k) JOIN items b ON b.r = (a.r + ((k - a.r % 4 + 4) % 4) * 7) % a.n WHERE len(a.t) >= 4),
cg AS MATERIALIZED (SELECT item_id, r, k, t[i] AS u, t[i + 1] AS v, t[i + 2] AS w FROM (SELECT *, unnest(range(1, len(t) - 1)) AS i FROM choices))"""

_trained: dict[tuple[str, str], list[bpe.Merge]] = {}


def vocabulary(spark, d) -> list[bpe.Merge]:
    """The merges of the documents at ``d``; trained once an application, as every query of tokens asks for them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _trained:
        _trained[key] = bpe.train(bpe.words_of(table(spark, d, "documents"), "text"), MERGES)
    return _trained[key]


def ids(spark, d):
    """Documents with token ids, after ``SPECIALS`` special ones; a null text has none."""
    rows = bpe.encoded(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "text", vocabulary(spark, d), prices=False, first=SPECIALS)
    return rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def sequences(spark, d) -> DataFrame:
    """Documents with ``tokens``, and ``held`` where they train nothing."""
    return ids(spark, d).select("doc_id", "lang", F.col("ids").alias("tokens"), (pick(17, "doc_id") % HELD == 0).alias("held"))


def model(spark, d) -> ngram.Model:
    return ngram.fit(sequences(spark, d).where("NOT held"), "tokens", BEGIN, END)


def document_losses(spark, d, *keep: str) -> DataFrame:
    """``*keep, n, loss`` of the documents; texts are encoded and their trigrams counted once, for the model and for its losses."""
    packs = ngram.packed(sequences(spark, d), "tokens", *keep, marks=(BEGIN, END), apart="held")
    return ngram.losses_of(packs, ngram.fit_counts(packs.counts(False), BEGIN, END))


def items(spark, d) -> DataFrame:
    """``item_id, r, n, tokens`` of the benchmark's texts, ``r`` their place and ``n`` their number."""
    b = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", "text")
    rows = bpe.encoded(b, "text", vocabulary(spark, d), prices=False, out="tokens", first=SPECIALS).where(F.size("tokens") > 0)
    return with_order(rows, "item_id", "r", total="n").select("item_id", (F.col("r") - 1).alias("r"), "n", "tokens")


def choices(spark, d) -> DataFrame:
    """Four endings an item, ``k`` of them the item's own at place ``label``: the last two tokens of its first half, then the second half of an item."""
    i = items(spark, d)
    half = F.floor(F.size("tokens") / 2).cast("int")
    ends = i.select(F.col("r").alias("r_"), F.slice("tokens", half + 1, F.size("tokens")).alias("end"))
    own = i.where(F.size("tokens") >= 4).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    at = (F.col("r") + F.pmod(F.col("k") - F.col("r") % 4, F.lit(4)) * 7) % F.col("n")
    return own.join(ends, at == F.col("r_")).select("item_id", (F.col("r") % 4).cast("int").alias("label"), "k", F.concat(F.slice("tokens", half - 1, F.lit(2)), "end").alias("tokens"))
