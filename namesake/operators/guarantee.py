"""Exact-key matches, kept in grouped form.

Records of one key are all matched with each other when the later row's year
minus the earlier row's year stays below a bound. The number of such pairs is
quadratic in the size of a group, so they are never listed. Everything asked of
them follows from the key, order and year of the records: whether two given
records match, how many matches a record has, and which records hang together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.functions.text import key_of
from namesake.operators.ordered import dense_index, run_starts, running_totals
from namesake.operators.tokens import convert_columns
from namesake.session import cut
from namesake.spec import LinkageSpec


def guarantee_table(records: DataFrame, spec: LinkageSpec, variants: DataFrame | None = None) -> DataFrame:
    """(record_id, seq, year, gkey); records without a key are left out."""
    cols = spec.guarantee_cols
    df = records.select(spec.record_id, spec.edition_seq, spec.year, *cols)
    names = cols
    if variants is not None:
        df = convert_columns(df, cols, variants, "_processed")
        names = tuple(f"{c}_processed" for c in cols)
    key = key_of([F.col(c) for c in names], spec.require_present)
    return df.select(
        F.col(spec.record_id).alias("record_id"),
        F.col(spec.edition_seq).alias("seq"),
        F.col(spec.year).cast("double").alias("year"),
        key.alias("gkey"),
    ).filter(F.col("gkey").isNotNull())


def matches(earlier_key: Column, earlier_year: Column, later_key: Column, later_year: Column, max_diff: float) -> Column:
    """Whether two records match, given which one comes first."""
    return F.coalesce((earlier_key == later_key) & (later_year - earlier_year < max_diff), F.lit(False))


def linked_runs(table: DataFrame, max_diff: float) -> DataFrame:
    """(gkey, year) -> hub: the first record of the connected part it lies in.

    Non-matches order the rows of a key, so its connected parts are runs that
    follow each other both in row order and, at least ``max_diff`` apart, in
    year. It suffices to look between neighbouring years of a key for such a
    cut, on one row per key and year.
    """
    order = F.struct("seq", "record_id")
    cells = table.groupBy("gkey", "year").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    years = Window.partitionBy("gkey").orderBy("year")
    before = F.max("last").over(years.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("first").over(years.rowsBetween(0, Window.unboundedFollowing))
    gap = F.col("year") - F.lag("year").over(years) >= max_diff
    parted = cells.withColumn("_cut", F.coalesce(gap & (before < after), F.lit(False)).cast("int"))
    runs = parted.withColumn("_run", F.sum("_cut").over(years))
    hub = F.min("first").over(Window.partitionBy("gkey", "_run"))["record_id"]
    return runs.select("gkey", "year", hub.alias("hub"))


def guarantee_links(table: DataFrame, max_diff: float) -> DataFrame:
    """One edge per record, to the hub of its part: same components as all pairs."""
    joined = table.join(linked_runs(table, max_diff), ["gkey", "year"])
    return joined.filter(F.col("hub") != F.col("record_id")).select(
        F.least("hub", "record_id").alias("src"),
        F.greatest("hub", "record_id").alias("dst"),
        F.lit(1.0).alias("weight"),
    )


def _behind(by: tuple[str, ...], max_diff: float) -> Column:
    """Whether some earlier edition of the key lies ``max_diff`` or more ahead in year."""
    earlier = Window.partitionBy(*by).orderBy("seq", "year").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max("year").over(earlier) - F.col("year") >= max_diff, F.lit(False))


def placed(table: DataFrame, max_diff: float) -> DataFrame:
    """``table`` with ``seq`` made fine enough that years of one place never span the bound.

    Records of a key and edition normally stand in one place. Where their years
    span the bound (a mistyped year does it), the order within the edition
    decides over matches: then every run of records with one year, in the order
    of their ids, is a place of its own, named by its first record.
    """
    keyed = table.filter(F.col("gkey").isNotNull())
    spread = F.max("year") - F.min("year")
    wide = cut(keyed.groupBy("gkey", "seq").agg(spread.alias("spread")).filter(F.col("spread") >= max_diff).select("gkey", "seq"))
    if wide.isEmpty():
        return table
    marked = table.join(wide.withColumn("_wide", F.lit(True)), ["gkey", "seq"], "left")
    runs = run_starts(marked.filter("_wide"), ["gkey", "seq"], ["record_id"], "year", "record_id", "_first")
    fine = runs.withColumn("seq", F.struct("seq", F.col("_first").cast("long").alias("run")))
    coarse = marked.filter(F.col("_wide").isNull()).withColumn("seq", F.struct("seq", F.lit(0).cast("long").alias("run")))
    return fine.select(*table.columns).unionByName(coarse.select(*table.columns))


def follows_order(table: DataFrame, max_diff: float) -> bool:
    """Whether no key of a ``placed`` table has years that run against the row order by the bound."""
    cells = table.filter(F.col("gkey").isNotNull()).select("gkey", "seq", "year").distinct()
    found = cells.select(_behind(("gkey",), max_diff).alias("behind")).agg(F.coalesce(F.max("behind"), F.lit(False)).alias("behind")).first()
    return not found["behind"]


def _against_order(cells: DataFrame, counts: list[str], max_diff: float, by: tuple[str, ...]) -> DataFrame:
    """(by, seq, year, extra_...): sums over cells that lie the bound or more ahead in year though earlier in order, or the reverse.

    The editions of a key are ranked, and the ranks before one are ranges whose
    lengths are powers of two. A cell is entered in one range of every length
    and asked for in as many as its rank has bits, so n log n rows replace the
    pairs; sums over the years within a range are running totals.
    """
    places = cut(dense_index(cells.select(*by, "seq").distinct(), [*by, "seq"], "_at"))
    span = places.groupBy(*by).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    ranked = cut(cells.join(places, [*by, "seq"]).join(span, list(by)))
    most = ranked.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0
    levels = range(int(most).bit_length())
    if not levels:
        return cells.limit(0).select(*by, "seq", "year", *[F.col(c).alias(f"extra_{c}") for c in counts])
    lengths = F.array(*[F.lit(level) for level in levels])
    sides = []
    # Earlier in order and ahead in year; then the same with both turned round.
    for rank, sign in ((F.col("_at") - F.col("_low"), 1), (F.col("_high") - F.col("_at"), -1)):
        spread = ranked.withColumn("_rank", rank).withColumn("_level", F.explode(lengths))
        own = F.call_function("shiftright", F.col("_rank"), F.col("_level"))
        entered = spread.withColumn("_range", own).filter(F.col("_range") % 2 == 0)
        asking = spread.withColumn("_range", own - 1).filter(F.col("_range") % 2 == 0)
        nothing = [F.lit(0).cast(cells.schema[c].dataType).alias(c) for c in counts]
        rows = entered.select(*by, "seq", "year", "_level", "_range", (-F.col("year") * sign).alias("_order"), F.lit(0).alias("_asks"), *counts).unionByName(
            asking.select(*by, "seq", "year", "_level", "_range", (-(F.col("year") * sign + max_diff)).alias("_order"), F.lit(1).alias("_asks"), *nothing)
        )
        summed = running_totals(rows, [*by, "_level", "_range"], ["_order", "_asks", "seq", "year"], counts)
        sides.append(summed.filter("_asks = 1").select(*by, "seq", "year", *counts))
    return sides[0].unionByName(sides[1]).groupBy(*by, "seq", "year").agg(*[F.sum(c).alias(f"extra_{c}") for c in counts])


def match_counts(
    cells: DataFrame, counts: list[str], max_diff: float, by: tuple[str, ...] = ("gkey",), ordered: bool = False
) -> DataFrame:
    """Sum ``counts`` over all cells a cell matches with, its own included.

    ``cells`` has one row per ``by``, seq and year. Cells closer than the bound
    match; cells further apart match only where years run against row order.
    Those are looked for in just the keys where it occurs, and not at all when
    ``ordered`` says that ``follows_order`` found none.
    """
    keys = ", ".join(by)
    bound = f"{float(max_diff)}D"

    def near(c: str) -> Column:
        def frame(lo: str, hi: str) -> str:
            return (
                f"coalesce(sum({c}) over (partition by {keys} order by year "
                f"range between {lo} and {hi}), 0)"
            )
        return F.expr(
            frame(f"{bound} preceding", f"{bound} following")
            + " - " + frame(f"{bound} preceding", f"{bound} preceding")
            + " - " + frame(f"{bound} following", f"{bound} following")
        )

    if ordered:
        return cells.select(*by, "seq", "year", *[near(c).alias(c) for c in counts])
    out = cells.select(
        *by, "seq", "year", *[near(c).alias(f"near_{c}") for c in counts], *counts, _behind(by, max_diff).alias("_behind")
    )
    out = out.withColumn("_mixed", F.max("_behind").over(Window.partitionBy(*by)))
    extra = cut(_against_order(out.filter("_mixed").select(*by, "seq", "year", *counts), counts, max_diff, by))
    joined = out.join(extra, [*by, "seq", "year"], "left")
    return joined.select(
        *by, "seq", "year",
        *[(F.col(f"near_{c}") + F.coalesce(f"extra_{c}", F.lit(0))).alias(c) for c in counts],
    )


def guarantee_degrees(table: DataFrame, max_diff: float) -> DataFrame:
    """(record_id, n_matches): exact-key matches of every record."""
    table = cut(placed(table, max_diff))
    cells = table.groupBy("gkey", "seq", "year").agg(F.count("*").alias("n"))
    totals = match_counts(cells, ["n"], max_diff, ordered=follows_order(table, max_diff))
    return table.join(totals, ["gkey", "seq", "year"]).select("record_id", (F.col("n") - 1).alias("n_matches"))
