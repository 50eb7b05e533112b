"""Document fingerprints as invertible Bloom lookup sketches, in native columns only.

A text is the set of the hashes of its paragraphs (runs between line breaks and full stops, so that
short documents have several). A sketch has three tables of cells; a paragraph's hash is added to
one cell of each: cells hold a count, the exclusive-or of the hashes and the exclusive-or of their
checks. The cells of two versions are subtracted, which leaves the paragraphs that only one has;
peeling reads them off cells with one paragraph, takes those out of their other cells, and goes on. Where a
sketch is too small to be peeled to the end, its paragraphs are dealt to parts with larger ones, and after the largest come the sets themselves.

All paragraphs of a text are in cells. So that the work grows with their number and not with its square,
they are dealt to groups by bits of the hash, about ``GROUP`` of them each, and each group has a small sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Paragraphs a group has at most on average, bits of the hash that choose the group, and the cells a table of each try.
GROUP = 8
GROUP_BITS = 20
WIDTHS = (5, 13, 31, 97)
ROUNDS = 16
_CELL = "struct<c:int,k:bigint,h:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """Hashes of the paragraphs of a text, in order; a null text has none."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.\n\r]+"), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(pieces, lambda p: F.xxhash64(p))


def level(count: Column) -> Column:
    """Bits that number the groups of ``count`` hashes."""
    bits = F.ceil(F.log2(F.greatest(count, F.lit(1)) / F.lit(float(GROUP))))
    return F.least(F.greatest(bits, F.lit(0)), F.lit(GROUP_BITS - 4)).cast("int")


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bits)


def _deal(keys: Column, last: Column, bits: Column) -> Column:
    """Keys by the ``bits`` bits of the hash from bit ``GROUP_BITS - last`` on."""
    digit = lambda k: F.call_function("shiftrightunsigned", k, F.lit(GROUP_BITS) - last).bitwiseAND((_power(bits) - 1).cast("long"))
    return F.transform(F.sequence(F.lit(0), _power(bits) - 1), lambda i: F.filter(keys, lambda k: digit(k) == i))


def groups(keys: Column, bits: Column, after: Column | int = 0) -> Column:
    """Keys in ``2 ** bits`` groups by the bits ``after`` those that dealt them already, in two steps, each by about half of the bits."""
    half = F.shiftright(bits, 1)
    return F.when(bits == 0, F.array(keys)).otherwise(F.flatten(F.transform(_deal(keys, half + after, half), lambda part: _deal(part, bits + after, bits - half))))


def _place(key: Column, table: int, width: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20 + 12 * table), F.lit(width).cast("long")).cast("int")


def _placed(key: Column, width: int) -> list[Column]:
    """The cells of a key, in the three tables one after the other."""
    return [(_place(key, t, width) + t * width).alias(x) for t, x in enumerate("xyz")]


def sketch(keys: Column, width: int, less: Column | None = None) -> Column:
    """Cells of three tables of ``width`` each; those of the keys ``less`` are subtracted."""
    nothing = F.struct(F.lit(0).alias("c"), F.expr("0L").alias("k"), F.expr("0L").alias("h"))

    def add(cell: Column, p: Column) -> Column:
        return F.struct((cell["c"] + p["s"]).alias("c"), cell["k"].bitwiseXOR(p["k"]).alias("k"), cell["h"].bitwiseXOR(p["h"]).alias("h"))

    def tables(placed: Column) -> Column:
        def table(t: int, x: str) -> Column:
            held = lambda i: F.aggregate(F.filter(placed, lambda p: p[x] == i), nothing, add)
            cells = F.sequence(F.lit(t * width), F.lit((t + 1) * width - 1))
            if width == WIDTHS[0]:  # few cells are empty
                return F.transform(cells, held)
            # most are: they are told apart before any key is looked at
            return _let(F.transform(placed, lambda p: p[x]), lambda used: F.transform(cells, lambda i: F.when(F.array_contains(used, i), held(i)).otherwise(nothing)))

        return F.concat(*(table(t, x) for t, x in enumerate("xyz")))

    place = lambda keys, sign: F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k).alias("h"), F.lit(sign).alias("s"), *_placed(k, width)))
    placed = place(keys, 1) if less is None else F.concat(place(keys, 1), place(less, -1))
    return _let(placed, tables).cast(f"array<{_CELL}>")


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: F.struct((a["c"] - b["c"]).alias("c"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h"))).cast(f"array<{_CELL}>")


def peel(cells: Column, width: int) -> Column:
    """``cells`` that are left and the hashes ``found``; all cells are empty if peeling came to its end."""
    pure_type = "array<struct<k:bigint,h:bigint,s:int,x:int,y:int,z:int>>"
    state = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("on"))

    def pure(cells: Column) -> Column:
        one = F.filter(cells, lambda c: (F.abs(c["c"]) == 1) & (F.xxhash64(c["k"]) == c["h"]))
        named = F.transform(one, lambda c: F.struct(c["k"].alias("k"), c["h"].alias("h"), c["c"].alias("s"), *_placed(c["k"], width)))
        return F.array_distinct(named).cast(pure_type)

    def take(cells: Column, out: Column) -> Column:
        def less(c: Column, i: Column) -> Column:
            mine = F.filter(out, lambda p: (p["x"] == i) | (p["y"] == i) | (p["z"] == i))
            return F.aggregate(mine, c, lambda x, p: F.struct((x["c"] - p["s"]).alias("c"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["h"].bitwiseXOR(p["h"]).alias("h")).cast(_CELL))

        # the cells of no key of ``out`` stay as they are
        used = F.flatten(F.transform(out, lambda p: F.array(p["x"], p["y"], p["z"])))
        return _let(used, lambda used: F.transform(cells, lambda c, i: F.when(F.array_contains(used, i), less(c, i)).otherwise(c))).cast(f"array<{_CELL}>")

    def step(acc: Column, _: Column) -> Column:
        def go(out: Column) -> Column:
            rest = F.struct(take(acc["cells"], out).alias("cells"), F.concat(acc["found"], F.transform(out, lambda p: p["k"])).alias("found"), F.lit(True).alias("on"))
            return F.when(F.size(out) > 0, rest).otherwise(F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("on")))

        return F.when(acc["on"], _let(pure(acc["cells"]), go)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step)


def _empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["c"] == 0) & (c["k"] == 0))


def _recover(cells: Column, one: Column, other: Column, bits: Column) -> Column:
    """Hashes that only one of two groups has, from their subtracted cells of the least width; ``bits`` dealt the groups.

    Where that fails, the groups are dealt on until their parts have about ``GROUP`` keys, so that the work grows with the keys
    and not with their number times that of cells; a part's larger sketches follow one that fails, and after the largest the difference of the sets themselves.
    """

    def part(one: Column, other: Column) -> Column:
        tries = [_found(peel(sketch(one, width, other), width)) for width in WIDTHS[1:]]
        return F.coalesce(*tries, F.concat(F.array_except(one, other), F.array_except(other, one)))

    more = F.least(level(F.size(one) + F.size(other)), F.lit(GROUP_BITS) - bits)
    deal = F.struct(more.alias("more"), bits.alias("bits"))
    rest = _let(deal, lambda d: F.flatten(F.zip_with(groups(one, d["more"], d["bits"]), groups(other, d["more"], d["bits"]), part)))
    # cells that are all in use, or of sets whose sizes are further apart than the cells can tell, are hardly ever peeled to the end
    full = F.forall(cells, lambda c: (c["c"] != 0) | (c["k"] != 0)) | (F.abs(F.size(one) - F.size(other)) > 3 * WIDTHS[0])
    return F.coalesce(F.when(~full, _found(peel(cells, WIDTHS[0]))), rest)


def _found(peeled: Column) -> Column:
    """The hashes found, or null where peeling did not come to its end; the next of several tries is made then only."""
    return _let(peeled, lambda p: F.when(_empty(p["cells"]), p["found"]))


def differing(one: Column, other: Column) -> Column:
    """Hashes that only one of two key sets of any size has, by peeling group by group."""
    bits = level(F.size(one) + F.size(other))
    cells = lambda a, b: subtract(sketch(a, WIDTHS[0]), sketch(b, WIDTHS[0]))
    return F.flatten(F.zip_with(groups(one, bits), groups(other, bits), lambda a, b: _recover(cells(a, b), a, b, bits)))


def likeness(one: Column, other: Column, missing: Column) -> Column:
    """1 less the share of the ``missing`` differing paragraphs of two sets; two empty ones are alike."""
    total = F.size(one) + F.size(other)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - F.size(missing) / total)


def grouped(keys: Column) -> Column:
    """All keys in the groups that their number asks for."""
    return groups(keys, level(F.size(keys)))


def sketches(parts: Column) -> Column:
    """A sketch of the least width for each group of keys; equal sets have equal ones."""
    return F.transform(parts, lambda g: sketch(g, WIDTHS[0]))


def folded(cells: Column, bits: Column) -> Column:
    """Sketches of ``2 ** bits`` groups from those of as many or more: neighbours are added."""
    ratio = (F.size(cells) / _power(bits)).cast("int")

    def plus(one: Column, other: Column) -> Column:
        return F.zip_with(one, other, lambda a, b: F.struct((a["c"] + b["c"]).alias("c"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h"))).cast(f"array<{_CELL}>")

    def merge(i: Column) -> Column:
        return F.aggregate(F.slice(cells, i * ratio + 2, ratio - 1), F.element_at(cells, i * ratio + 1), plus)

    return F.when(ratio == 1, cells).otherwise(F.transform(F.sequence(F.lit(0), _power(bits) - 1), merge))


def joined(parts: Column, bits: Column) -> Column:
    """Keys in ``2 ** bits`` groups from as many or more: neighbours are put together."""
    ratio = (F.size(parts) / _power(bits)).cast("int")
    return F.when(ratio == 1, parts).otherwise(F.transform(F.sequence(F.lit(0), _power(bits) - 1), lambda i: F.flatten(F.slice(parts, i * ratio + 1, ratio))))


def differing_of(cells_one: Column, cells_other: Column, one: Column, other: Column) -> Column:
    """``differing`` of two sets in groups, from the sketches that each has already, at the fewer groups of the two; the keys serve where a group's fails."""
    bits = F.log2(F.least(F.size(one), F.size(other)).cast("double")).cast("int")
    cells = F.zip_with(folded(cells_one, bits), folded(cells_other, bits), lambda a, b: subtract(a, b))
    keys = F.zip_with(joined(one, bits), joined(other, bits), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.zip_with(cells, keys, lambda c, g: _recover(c, g["a"], g["b"], bits)))


def serialised(order: Column, keys: Column, cells: Column) -> Column:
    """The fingerprint as text: number of paragraphs, exclusive-or of all hashes, a hash of all paragraphs in order, and the sketches of all groups.

    Groups are apart by ``/``, cells by ``;``, a cell's count, hashes and checks by ``:``, all in hexadecimal.
    """
    show = lambda c: F.concat(F.hex(c["c"]), F.lit(":"), F.hex(c["k"]), F.lit(":"), F.hex(c["h"]))
    body = F.array_join(F.transform(cells, lambda g: F.array_join(F.transform(g, show), ";")), "/")
    return F.concat_ws("|", F.hex(F.size(keys)), F.hex(F.aggregate(keys, F.expr("0L"), lambda a, k: a.bitwiseXOR(k))), F.hex(F.xxhash64(order)), body)


def successors(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id`` for every distinct id, in ascending order; after the last comes the first.

    Ids are dealt to ranges of like numbers of ids, whatever their values; within a range a window
    gives the next id, and the first ids of the ranges, as few as the ranges, give it across their ends.
    """
    ids = ids.select("doc_id").where("doc_id is not null").distinct()
    # written, so that the ranges are the same for both readers
    ids = stash(ids.repartitionByRange("doc_id").withColumn("block", F.spark_partition_id()), "ids")
    within = F.lead("doc_id").over(Window.partitionBy("block").orderBy("doc_id"))
    firsts = ids.groupBy("block").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("block")  # a row a range
    firsts = firsts.select("block", F.coalesce(F.lead("first").over(every), F.min("first").over(Window.partitionBy())).alias("across"))
    return ids.withColumn("within", within).join(firsts, "block").select("doc_id", F.coalesce("within", "across").alias("next_id"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited version and the next document.

    The edit replaces the last quarter (rounded down) of the code points by as many from the
    beginning of the next document. Returns ``doc_id, version`` (a hash of the text), ``n_chars, edited`` and for the three texts the
    hashes of all paragraphs: in order ``order, edited_order``, each once ``keys, edited_keys, next_keys``.

    Null texts are empty. Rows that share an id each get a result; as a next document such an id
    stands with one of its texts, the one of the smallest hash. A row without id has no next
    document: its edit ends in nothing.
    """
    every = docs.select(F.col(id_col).cast("long").alias("key_"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = every.withColumn("version", F.xxhash64("text"))
    rows = every.where("key_ is not null")
    heads = rows.select("key_", "version", F.length("text").alias("n")).groupBy(F.col("key_").alias("doc_id")).agg(F.min("version").alias("head"), F.max("n").alias("n"))
    after = successors(heads)
    needed = after.join(heads.select("doc_id", F.floor(F.col("n") / 4).cast("int").alias("need")), "doc_id").select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "need")
    needed = needed.join(heads.select("doc_id", "head"), "doc_id")
    # texts are dealt by id once: both joins with them have the same columns and keys and so share the exchange
    given = rows.hint("merge").join(needed, F.col("key_") == F.col("doc_id")).where(F.col("version").bitwiseXOR(F.col("head")) == 0)
    order = paragraphs(F.col("text"))
    given = given.select("before", F.substring("text", F.lit(1), F.col("need")).alias("beginning"), F.array_distinct(order).alias("next_keys"))
    # repeated rows give the same values
    parts = ("beginning", "next_keys")
    given = given.groupBy("before").agg(*(F.first(c).alias(c) for c in parts))
    out = rows.hint("merge").join(given, F.col("key_") == F.col("before"), "left").drop("before")
    out = out.unionByName(every.where("key_ is null").select("*", *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in parts)))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.coalesce(F.substring("beginning", F.lit(1), quarter), F.lit("")))
    out = out.select(F.col("key_").alias("doc_id"), "version", n.cast("long").alias("n_chars"), order.alias("order"), edited.alias("edited"), "next_keys").withColumn("edited_order", paragraphs(F.col("edited")))
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "version", "n_chars", "order", F.array_distinct("order").alias("keys"), "edited", "edited_order", F.array_distinct("edited_order").alias("edited_keys"), F.coalesce("next_keys", none).alias("next_keys"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` for every row; see ``compare_with_edit``.

    Both likenesses are peeled from the sketches in the fingerprints: the text's less the edited text's, and less the
    next document's. The order of paragraphs is in the fingerprint and does not count for likeness.
    """
    out = compare_with_edit(docs, id_col, text_col)
    kinds = ("", "edited_", "next_")
    out = out.withColumns({f"{k}parts": grouped(F.col(f"{k}keys")) for k in kinds}).withColumns({f"{k}cells": sketches(F.col(f"{k}parts")) for k in kinds})
    near = [likeness(F.col("keys"), F.col(f"{k}keys"), differing_of(F.col("cells"), F.col(f"{k}cells"), F.col("parts"), F.col(f"{k}parts"))).alias(f"near_{k[:-1]}") for k in kinds[1:]]
    prints = [serialised(F.col(f"{k}order"), F.col(f"{k}keys"), F.col(f"{k}cells")).alias(f"{k}fingerprint") for k in kinds[:2]]
    return out.select("doc_id", "version", "n_chars", "edited", *prints, *near)
