"""Operator 4: sources mixed to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, unique_name

#: Parts of the output's characters that go to each source; all others get DEFAULT parts.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
DEFAULT = 1.0
SEED = 4
UNIT = 1 << 32
_SLICES = 12  # bits of a document's place that name its slice
_GROUP = 12  # bits of a copy's number that are counted within a group of copies


def mix_sources(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, default: float = DEFAULT, total: float = 1.0, seed: int = SEED, copy_column: str | None = None) -> DataFrame:
    """Copies of docs so that each source has its share of characters.

    A source of weight w gets w / (sum of weights) of ``total`` times the
    input's characters, so each of its documents expects
    share * total * (all characters) / (the source's characters) copies, in
    units of 2**-32.  Documents of a source stand in the order of
    md5(doc_id), doc_id, md5(text), and a row is emitted once for each integer
    that the running sum of copies, plus one offset a source from
    md5(seed/source), crosses in it.  A source's copies so differ from the
    expected number by less than one.

    Slices of a source (by the first 12 bits of the md5) are summed first, so
    that running sums need no more than a slice on one task, hot sources too.
    Sums run over the fractions of a copy only, whole copies are added to them,
    so nothing overflows however often a small source is repeated: with n
    characters it gets at most ``total`` times all characters / n copies of
    each row.

    Sources that are null form one source of the default weight.  A null text
    has no characters; a source without characters gets no copies, nor does
    one of weight 0 or below.  A null doc_id sorts by the md5 of the empty
    text.  Repeated rows are rows of their own.  Columns and types are those
    of docs, whose names may be any; with ``copy_column``, one more that
    numbers a row's copies from 0.  No documents, no rows.
    """
    weights = WEIGHTS if weights is None else weights
    source, place, part, each, whole_copies, base, end, copies, group = (unique_name(docs, k) for k in ("mix_source", "mix_place", "mix_slice", "mix_each", "mix_whole", "mix_base", "mix_end", "mix_copies", "mix_group"))
    own = docs.select(*docs.columns, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias(source), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(place))
    own = own.withColumn(part, F.substring(place, 1, _SLICES // 4))
    slices = own.groupBy(source, part).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.char_length("text").cast("long"), F.lit(0))).alias("chars"))
    slices = scratch.save(slices, "slices")
    weight = F.lit(float(default))
    for k, w in weights.items():
        weight = F.when(F.col(source) == F.lit(f"={k}"), F.lit(float(w))).otherwise(weight)
    sums = slices.groupBy(source).agg(F.sum("chars").alias("chars")).select(source, "chars", F.greatest(weight, F.lit(0.0)).alias("w")).where("chars > 0 AND w > 0")
    whole = sums.agg(F.sum("chars").cast("double").alias("all_chars"), F.sum("w").alias("all_w"))
    rate = F.col("w") / F.col("all_w") * F.col("all_chars") * F.lit(float(total)) / F.col("chars")
    # one row, then one row a source; a product with a power of two is exact
    rates = sums.crossJoin(whole).select(source, F.floor(rate).cast("long").alias(whole_copies), F.floor((rate - F.floor(rate)) * F.lit(float(UNIT))).cast("long").alias(each))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(source))), 1, 8), 16, 10).cast("long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only the part of a running sum beyond the last integer matters
    start = F.pmod(before.cast("decimal(38,0)") * F.col(each).cast("decimal(20,0)") + offset.cast("decimal(20,0)"), F.lit(UNIT).cast("decimal(20,0)")).cast("long")
    starts = slices.join(rates, source).select(source, part, each, whole_copies, start.alias(base))
    order = Window.partitionBy(source, part).orderBy(place, F.col("doc_id"), F.md5("text"))
    ranked = own.join(starts, [source, part]).withColumn(end, F.row_number().over(order).cast("long") * F.col(each) + F.col(base))
    # whole units: division and remainder of longs, not of doubles
    crossed = F.shiftright(F.col(end), 32) - F.shiftright(F.col(end) - F.col(each), 32)
    emitted = ranked.withColumn(copies, crossed + F.col(whole_copies)).where(F.col(copies) > 0)
    # in groups, so that no array has all copies of a row
    groups = emitted.select(*docs.columns, copies, F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col(copies) - 1, _GROUP))).alias(group))
    first = F.shiftleft(F.col(group), _GROUP)
    number = F.explode(F.sequence(first, F.least(first + (1 << _GROUP) - 1, F.col(copies) - 1)))
    out = groups.select(*docs.columns, number.alias(copy_column or copies))
    return out if copy_column else out.drop(copies)
