"""Operators on corpora: rows of ``text, source, token_length, meta`` and their making."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.hashing import pick
from tickloom.functions.ranking import with_index, with_order, with_rank
from tickloom.sources.sinks import dropped, materialised

SPACE = r"[ \t\n\x0B\f\r]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0B\f\r"))


def is_noise(text: Column, least: int = 30) -> Column:
    """Too short, or less than half letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.length(text) < least) | (letters < 0.5 * F.length(text))


def long_enough(df: DataFrame, text: str, least: int = 200) -> DataFrame:
    return df.where(F.length(F.trim(F.col(text))) >= least)


def section_count(text: Column) -> Column:
    """Half the number of ``===`` marks, rounded down."""
    return F.floor((F.size(F.split(text, "===")) - 1) / 2).cast("long")


def union_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_report(df: DataFrame, source: str, length: str, *by: str) -> DataFrame:
    """Rows by source and, of those with a positive length, mean (1 place), least, greatest and sum."""
    some = F.when(F.col(length) > 0, F.col(length))
    return df.groupBy(*by, source).agg(F.count("*").alias("n"), F.bround(F.avg(some), 1).alias("mean"), F.min(some).alias("least"), F.max(some).alias("greatest"), F.sum(some).alias("total"))


def shuffled(df: DataFrame, keys: Sequence[str], seed: int | str = 42, out: str = "rank") -> DataFrame:
    """``df`` with each row's place in a hashed order."""
    return with_rank(df, pick(seed, *keys), list(keys), out)


def split(df: DataFrame, keys: Sequence[str], ratio: float = 0.05, seed: int | str = 42) -> DataFrame:
    """Adds ``split``: of the hashed order the head is ``val``, the share ``ratio`` rounded down but one row at least."""
    r = with_rank(df, pick(seed, *keys), list(keys), "r_", total="t_")
    return r.withColumn("split", F.when(F.col("r_") <= F.greatest(F.floor(F.col("t_") * ratio), F.lit(1)), "val").otherwise("train")).drop("r_", "t_")


def tail_split(df: DataFrame, order: str, chunk: int, ratio: float = 0.05, fallback: int = 5) -> DataFrame:
    """Adds ``chunk`` (of ``chunk`` rows in order) and ``split``: each chunk's last rows are ``val``, ``fallback`` if the ratio gives none."""
    r = with_order(df, order, "r_").withColumn("chunk", F.floor((F.col("r_") - 1) / chunk))
    w = Window.partitionBy("chunk")
    n = F.count("*").over(w)
    size = F.floor(n * ratio)
    size = F.when(size > 0, size).otherwise(F.least(F.lit(fallback), n))
    place = F.row_number().over(w.orderBy(order))
    return r.withColumns({"p_": place, "n_": n, "s_": size}).withColumn("split", F.when(F.col("p_") > F.col("n_") - F.col("s_"), "val").otherwise("train")).drop("r_", "p_", "n_", "s_")


def skip(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``df`` without its first rows in order: where a reader resumes."""
    return with_order(df, order, "r_").where(F.col("r_") > rows).drop("r_")


def interleave(df: DataFrame, source: str, order: str, stop: str = "first_exhausted") -> DataFrame:
    """Adds ``round`` (from 0): the sources take turns, by name, each in its order.

    ``first_exhausted`` ends with the last round that all sources have; ``all_exhausted`` goes on to
    the longest source's end, and shorter ones begin anew.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(stop)
    r = with_order(df, order, "r_", [source], "t_")
    ends = r.groupBy(source).agg(F.first("t_").alias("t")).agg(F.min("t").alias("lo_"), F.max("t").alias("hi_"))
    r = r.crossJoin(F.broadcast(ends))  # one row
    if stop == "first_exhausted":
        return r.where(F.col("r_") <= F.col("lo_")).withColumn("round", F.col("r_") - 1).drop("r_", "t_", "lo_", "hi_")
    turns = F.sequence(F.col("r_") - 1, F.col("hi_") - 1, F.col("t_"))
    return r.withColumn("round", F.explode(turns)).drop("r_", "t_", "lo_", "hi_")


def interleave_weighted(df: DataFrame, source: str, order: str, weights: Mapping[str, float] | Column, stop: str = "first_exhausted") -> DataFrame:
    """Adds ``turn``: a source's k-th row has its turn at k over the source's weight, so that sources come in their weights.

    ``first_exhausted`` ends where the first source does; ``all_exhausted`` goes on to the longest
    one's end, and others begin anew. Weights are given by source, or as a column that is one for a source. Sources without a positive weight are left out.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(stop)
    if not isinstance(weights, Column):
        weights = F.try_element_at(F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, float(w)))), F.col(source))
    r = with_order(df, order, "r_", [source], "t_").withColumn("w_", weights.cast("double")).where("w_ > 0")
    ends = r.groupBy(source).agg((F.first("t_") / F.first("w_")).alias("e")).agg(F.min("e").alias("lo_"), F.max("e").alias("hi_"))
    r = r.crossJoin(F.broadcast(ends))  # one row
    if stop == "all_exhausted":
        last = F.greatest(F.floor(F.col("hi_") * F.col("w_") + 1e-9), F.col("t_"))
        r = r.where(F.col("r_") <= last).withColumn("r_", F.explode(F.sequence(F.col("r_"), last, F.col("t_")))).withColumn("lo_", F.col("hi_"))
    return r.withColumn("turn", F.col("r_") / F.col("w_")).where(F.col("turn") <= F.col("lo_") + 1e-9).drop("r_", "t_", "w_", "lo_", "hi_")


def curated(df: DataFrame, order: str, text: str, domain: str | None = None, domains: Sequence[str] | None = None, least: int = 1, start_chunk: int = 0, chunk_size: int = 1) -> DataFrame:
    """Rows of a streamed source from chunk ``start_chunk`` on, of the ``domains``, whose trimmed texts have ``least`` characters or more.

    As a reader resumes by rows of the source, those of earlier chunks are passed over before anything is filtered.
    """
    rows = skip(df, order, start_chunk * chunk_size) if start_chunk else df
    if domain is not None and domains:
        rows = rows.where(F.col(domain).isin(*domains))
    return rows.withColumn(text, stripped(F.col(text))).where(F.length(text) >= max(1, least))


def book_paragraphs(paras: DataFrame, least: int, doc: str = "doc") -> DataFrame:
    """``doc, page, part, text``: paragraphs merged within their pages, numbered on from page to page of a document."""
    merged = merge_short(paras, least, (doc, "page"), ("paragraph",))
    running = F.row_number().over(Window.partitionBy(doc).orderBy("page", "part")) - 1
    return merged.withColumn("running_", running).select(doc, "page", F.col("running_").alias("part"), "text")


def paragraphs(lines: DataFrame, page: Sequence[str] = ("doc", "page")) -> DataFrame:
    """``doc, page, paragraph, text``: lines of a page up to a gap that is wide for the page.

    Wide is over 1.8 times the median of the page's positive gaps, and over that median plus 2. Empty paragraphs are left out.
    """
    w = Window.partitionBy(*page).orderBy("line_no")
    gap = F.col("top") - F.lag("bottom").over(w)
    g = lines.withColumn("gap", gap)
    median = g.where("gap > 0").groupBy(*page).agg(F.percentile("gap", F.lit(0.5)).alias("median"))
    g = g.join(median, list(page), "left").withColumn("m", F.coalesce("median", F.lit(1.0)))
    wide = (F.col("gap") > F.greatest(1.8 * F.col("m"), F.col("m") + 2)).cast("int")
    g = g.withColumn("paragraph", F.sum(F.coalesce(wide, F.lit(0))).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return g.groupBy(*page, "paragraph").agg(normalised(joined).alias("text")).where("text <> ''")


def merge_short(paras: DataFrame, least: int, doc: Sequence[str] = ("doc",), order: Sequence[str] = ("page", "paragraph")) -> DataFrame:
    """``doc, part, text``: paragraphs joined until they have ``least`` characters; what is left over goes to the last.

    A fold over the paragraphs of one document, in order.
    """
    rows = paras.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("rows"))
    start = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        both = F.trim(F.concat(acc["rest"], F.lit(" "), x["text"]))
        full = F.struct(F.lit("").alias("rest"), F.concat(acc["out"], F.array(both)).alias("out"))
        return F.when(F.length(both) >= least, full).otherwise(F.struct(both.alias("rest"), acc["out"].alias("out")))

    def done(acc: Column) -> Column:
        n = F.size(acc["out"])
        last = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["out"], -1), F.lit(" "), acc["rest"])))
        return F.when(acc["rest"] == "", acc["out"]).when(n > 0, last).otherwise(F.array(acc["rest"]))

    return rows.select(*doc, F.posexplode(F.aggregate("rows", start, step, done)).alias("part", "text"))


def book_rows(paras: DataFrame, doc: str, source: str) -> DataFrame:
    """Corpus rows of paragraphs that are not noise; meta has page, running index and length."""
    meta = F.to_json(F.struct(F.col("page").alias("page_number"), F.col("part").alias("paragraph_index"), F.length("text").alias("char_length")))
    return paras.where(~is_noise(F.col("text"))).select("text", F.lit(source).alias("source"), F.lit(0).cast("long").alias("token_length"), meta.alias("meta"))


def compaction_parts(files: DataFrame, target: int, order: str = "name", size: str = "bytes") -> DataFrame:
    """``files`` with ``part``: in order, a new part begins where the next file would exceed the target.

    Files are never split, so that a part is over the target only by a single file. With sums of sizes up to each
    file, the part that begins at a file ends before the first file whose sum exceeds what is before the part by more than the target, so
    each file has a next start, found by sorting those bounds among the sums. The starts that are reached from the first file are found by doubling: after k
    rounds jumps are 2**k long, so their number is logarithmic in that of parts, and the driver sees none of them. Null sizes count nothing; files of one name are
    dealt in any order.
    """
    total = "upto_"
    f = materialised(with_index(files.withColumn("size_", F.coalesce(F.col(size), F.lit(0)).cast("long")), [order], "i_", {total: "size_"}))
    count = f.count()
    # how many sums do not exceed each bound: bounds rise with the file, so its place among both, less its place among bounds
    sums = f.select(F.col(total).alias("v_"), F.lit(0).alias("kind_"), "i_")
    bounds = f.select((F.col(total) - F.col("size_") + F.lit(int(target))).alias("v_"), F.lit(1).alias("kind_"), "i_")
    both = with_index(sums.unionByName(bounds), ["v_", "kind_", "i_"], "place_").where("kind_ = 1")
    jump = materialised(both.select("i_", F.greatest(F.col("place_") - F.col("i_"), F.col("i_") + 1).alias("next_")))
    reached = materialised(files.sparkSession.range(1 if count else 0).select(F.col("id").alias("start_")))
    while True:
        first = jump.where("i_ = 0").select("next_").first()
        if first is None:
            break
        more = reached.join(jump, F.col("start_") == F.col("i_")).select(F.col("next_").alias("start_")).where(F.col("start_") < count)
        new = materialised(reached.unionByName(more))
        dropped(reached)
        reached = new
        if first[0] >= count:
            break
        far = jump.select(F.col("i_").alias("j_"), F.col("next_").alias("far_"))
        new = materialised(jump.join(far, F.col("next_") == F.col("j_"), "left").select("i_", F.coalesce("far_", F.lit(count)).alias("next_")))
        dropped(jump)
        jump = new
    starts = f.join(reached.distinct(), F.col("i_") == F.col("start_"), "left").withColumn("begins_", F.col("start_").isNotNull().cast("long"))
    out = with_index(starts, ["i_"], "place_", {"nth_": "begins_"})
    return out.select(*(F.col(f"`{c}`") for c in files.columns), (F.col("nth_") - 1).cast("int").alias("part"))
