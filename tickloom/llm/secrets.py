"""Secret scan with corpus-wide ownership frequency, in native columns only.

Candidates are the assignments, access keys and hex strings of the base rules, and long strings of
mixed letters and digits. Their values are hashed, and each hash is counted over the corpus: in how
many repositories and under how many owners it occurs. A value in one repository looks live; one in
several repositories of one owner is that owner's, reused; one that several owners have, or two with
many repositories, is an example that people copy. Candidates of the last kind become spans only
where they are one owner's; base spans always stay, with their verdict beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash
from .spans import apart, how_many, listed, located, matches

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{24,}"
BASE = ("assign", "access", "hex")
VERDICTS = ("live", "reused", "shared", "copied")


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base`` and ``mixed``: arrays of ``rank, kind, start, end, value``; a null text is empty."""
    m = fresh(docs, "t_", "m0_", "m1_", "m2_", "m3_", "base", "mixed", "varied_")
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(m[0], t)
    patterns = (ASSIGN, ACCESS, HEX, MIXED)
    out = out.withColumns({m[1 + k]: matches(F.col(m[0]), p) for k, p in enumerate(patterns)})
    found = [located(F.col(m[0]), F.col(m[1 + k]), p) for k, p in enumerate(patterns)]
    found[0] = F.filter(found[0], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    secret = F.transform(found[0], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["value"], ASSIGN, 2).alias("value")))
    base = F.concat(_ranked(secret, 0, "assign"), _ranked(found[1], 1, "access"), _ranked(found[2], 2, "hex"))
    out = out.withColumn(m[5], base)
    varied = F.filter(found[3], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    # a column of its own: it is used more than once
    out = out.withColumn(m[7], _ranked(varied, 3, "mixed")).withColumn(m[6], apart(F.col(m[7]), F.col(m[5])))
    return out.withColumnsRenamed({x: y for x, y in ((m[5], "base"), (m[6], "mixed")) if x != y})


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
    copied_from: int = 3,
    copied_repositories: int = 6,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, counts by base kind, ``base_spans``, ``spans``
    (with verdicts and both counts in ``found``), how many are live, reused, shared or copied, and
    ``most_repositories`` that any of its values is in (0 without spans).

    A value is ``copied`` with ``copied_from`` owners or more, or with more than one owner and
    ``copied_repositories`` repositories or more; ``shared`` with fewer; ``reused`` with one owner
    in several repositories; ``live`` with one owner and one repository. A repository is its name
    and its owner. Owners and repositories are by default the column ``source``; null ones count as
    one. A null or empty text has no spans. Repeated rows count once a repository, and each gets its
    own result; of spans with the same start the order is that of the kinds, then of the ends. No
    table is broadcast by hint and nothing is collected.
    """
    owner = F.coalesce((owner if owner is not None else F.col("source")).cast("string"), F.lit(""))
    repository = F.coalesce((repository if repository is not None else F.col("source")).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), repository.alias("repository"), owner.alias("owner"))
    rows = candidates(rows, "text").select("doc_id", "repository", "owner", F.xxhash64("text").alias("version"), F.transform(F.concat("base", "mixed"), lambda s: F.struct(s["rank"].alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("digest"))).alias("all"))
    rows = stash(rows, "candidates")

    each = rows.select("doc_id", "version", "repository", "owner", F.explode("all").alias("s")).select("doc_id", "version", "repository", "owner", "s.*")
    # two steps, so that a value with very many copies is counted before it is dealt out
    places = each.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    seen = owners.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    judged = each.select("doc_id", "version", "rank", "kind", "start", "end", "digest").distinct()
    # joined by another key than that of the counts, so that both sides are dealt anew and a value with very many copies can be split
    seen = seen.select(F.reverse("digest").alias("turned"), "n_owners", "n_repositories")
    judged = judged.join(seen, F.reverse("digest") == F.col("turned"))
    widely = (F.col("n_owners") >= copied_from) | (F.col("n_owners") > 1) & (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(widely, "copied").when(F.col("n_owners") > 1, "shared").when(F.col("n_repositories") > 1, "reused").otherwise("live")
    judged = judged.withColumn("verdict", verdict).where("rank < 3 or n_owners = 1")
    span = F.struct("rank", "kind", "start", "end", "verdict", "n_owners", "n_repositories")
    found = judged.groupBy("doc_id", "version").agg(F.collect_set(span).alias("found"))

    keyed = found.select(F.col("doc_id").alias("d_"), F.col("version").alias("v_"), "found")
    out = rows.join(keyed, rows["doc_id"].eqNullSafe(F.col("d_")) & (rows["version"] == F.col("v_")), "left")
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int,verdict:string,n_owners:bigint,n_repositories:bigint>>")
    out = out.select("doc_id", F.filter("all", lambda s: s["rank"] < 3).alias("base"), F.coalesce("found", none).alias("found"))
    counts = [how_many("base", "rank", k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    verdicts = [how_many("found", "verdict", v).alias(f"n_{v}") for v in VERDICTS]
    most = F.coalesce(F.array_max(F.transform("found", lambda s: s["n_repositories"])), F.lit(0)).alias("most_repositories")
    return out.select("doc_id", *counts, listed(F.col("base"), "start").alias("base_spans"), listed(F.col("found"), "start").alias("spans"), *verdicts, most, "found")
