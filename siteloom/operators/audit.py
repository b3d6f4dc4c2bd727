"""Fidelity audits: page ladder, heading match, section gate, score card."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text

# Python workers receive the code itself, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEVERITY_MARK = {3: "🔴", 2: "🟠", 1: "🟡", 0: "🟢"}


def _two_digits(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))  # half-even, like the reports


def audit_pages(local: DataFrame, reference: DataFrame, new_section: str | None = None) -> DataFrame:
    """(page, severity, class, text/image counts, note) per local page.

    ``local(page, text_len, imgs)``; ``reference(page, t, i, error)``, unique by page. The ladder
    order decides: an invented page is reported before a thin one.
    """
    ref = reference.select("page", "t", "i", "error", F.lit(True).alias("_ref"))
    j = local.join(ref, "page", "left")
    lt, li = F.coalesce("text_len", F.lit(0)), F.coalesce("imgs", F.lit(0))
    rt, ri = F.col("t"), F.col("i")
    ratio = F.when(rt == 0, F.lit(99.0)).otherwise(lt / rt)
    times = _two_digits(ratio)
    ladder = [
        ("N/A", 0, F.col("_ref").isNull(), F.lit("no reference fingerprint captured")),
        ("N/A-REF", 0, F.col("error").isNotNull(), F.lit("reference page errors")),
        ("FABRICATED", 3, (rt < 120) & (lt > 400),
         F.format_string("reference is nearly empty (%d chars); local has %d chars", rt, lt)),
        ("STUB", 3, (rt >= 400) & (ratio < 0.35),
         F.format_string("thin stub: %d vs %d chars (x%s)", lt, rt, times)),
        ("THIN", 2, (rt >= 400) & (ratio < 0.6),
         F.format_string("thinner than reference: %d vs %d chars (x%s)", lt, rt, times)),
        ("MISSING-IMG", 2, ri - li >= 8, F.format_string("reference has %d images, local has %d", ri, li)),
        ("OK", 0, ratio.between(0.6, 1.8) & (F.abs(ri - li) <= 6),
         F.format_string("comparable (%d vs %d chars, %d vs %d images)", lt, rt, li, ri)),
    ]
    if new_section:
        ladder.insert(0, ("N/A-NEW", 0, F.col("page").startswith(new_section), F.lit("new section, no reference")))
    rest = (
        "REVIEW", 1,
        F.format_string("%d vs %d chars (x%s), %d vs %d images", lt, rt, times, li, ri),
    )

    def column(i: int, default) -> Column:
        out = None
        for step in ladder:
            value = step[i] if isinstance(step[i], Column) else F.lit(step[i])
            out = F.when(step[2], value) if out is None else out.when(step[2], value)
        return out.otherwise(default if isinstance(default, Column) else F.lit(default))

    return j.select(
        "page",
        column(1, rest[1]).alias("severity"),
        column(0, rest[0]).alias("class"),
        lt.alias("local_text"),
        rt.alias("ref_text"),
        li.alias("local_imgs"),
        ri.alias("ref_imgs"),
        column(3, rest[2]).alias("note"),
    )


def punch_list(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("severity"), "page")


def class_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class")


def contained(needles: list[str], hay: str) -> int:
    """How many of ``needles`` occur in ``hay``; repeated needles count each time."""
    if len(needles) < 4:
        return sum(n in hay for n in needles)
    import ahocorasick

    counts: dict[str, int] = {}
    for n in needles:
        counts[n] = counts.get(n, 0) + 1
    found = counts.pop("", 0)
    automaton = ahocorasick.Automaton()
    for n in counts:
        automaton.add_word(n, n)
    if not counts:
        return found
    automaton.make_automaton()
    return found + sum(counts[n] for n in {n for _, n in automaton.iter(hay)})


def _count_contained(batches):
    for batch in batches:
        # iterated, not listed: only one page at a time is held as Python objects, however many an Arrow batch has
        pairs = ((own.as_py(), hay.as_py()) for own, hay in zip(batch.column("_headings"), batch.column("text")))
        hits = [0 if hay is None else contained([x for x in own if x is not None], hay) for own, hay in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("headings"), pa.array(hits, pa.int64())], names=["_key", "headings", "matched"])


def heading_match(
    reference: DataFrame, local: DataFrame, key: str = "page", min_pct: int = rules.HEADING_MIN_PCT
) -> DataFrame:
    """(key, headings, matched, pct, status) per reference page.

    ``reference(key, heading)`` holds distinct normalised headings; ``local(key, text)`` the
    normalised page text. A page's headings meet its text in one row, and one pass of an automaton over the text
    finds all of them, so the work is linear in text and headings. Fewer than three reference headings cannot be scored.
    """
    wanted = reference.groupBy(key).agg(F.collect_list("heading").alias("_headings"))
    both = wanted.join(local.select(key, "text"), key, "left")
    packed = both.select(F.struct(key).alias("_key"), F.size("_headings").cast("long").alias("headings"), "_headings", "text")
    counted = packed.mapInArrow(_count_contained, packed.select("_key", "headings", F.lit(0).cast("long").alias("matched")).schema)
    counted = counted.select("_key.*", "headings", "matched")
    pct = F.bround(F.col("matched") * 100 / F.col("headings")).cast("int")
    status = F.when(F.col("headings") < rules.HEADING_MIN_COUNT, "unscorable").when(
        pct < min_pct, "fail"
    ).otherwise("pass")
    return counted.select(key, "headings", "matched", pct.alias("pct"), status.alias("status"))


def heading_set_missing(ref_headings: Column, local_headings: Column) -> Column:
    """Reference headings (arrays, normalised) with no exact local counterpart."""
    return F.array_except(ref_headings, local_headings)


def same_order(ref_headings: Column, local_headings: Column) -> Column:
    """Common headings appear in the same order; two or fewer common ones cannot differ."""
    common = F.filter(ref_headings, lambda h: F.array_contains(local_headings, h))
    mine = F.array_distinct(F.filter(local_headings, lambda h: F.array_contains(ref_headings, h)))
    return (F.size(common) <= 2) | (common == mine)


def section_gate(reference: DataFrame, local: DataFrame, key: str = "page") -> DataFrame:
    """(key, fails, warns) from two signal rows per page.

    Both sides: ``(key, headings array, max_cards, facet_options array, imgs)``.
    """
    # normalised below the join, so that each page's arrays are normalised once

    def lowered(c: str) -> Column:
        return F.transform(F.col(c), lambda x: text.norm(x))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            key, lowered("headings").alias(f"{p}h"), lowered("facet_options").alias(f"{p}f"),
            F.transform("headings", lambda x: F.length(x)).alias(f"{p}n"),
            F.transform("facet_options", lambda x: F.length(x)).alias(f"{p}m"),
            F.col("max_cards").alias(f"{p}cards"), F.col("imgs").alias(f"{p}imgs"),
        )

    j = side(reference, "r").join(side(local, "l"), key)
    ref_h, loc_h, ref_f, loc_f = F.col("rh"), F.col("lh"), F.col("rf"), F.col("lf")

    def absent(mine: Column, lengths: Column, theirs: Column, over: int) -> Column:
        """How many entries longer than ``over`` the other side lacks, repeats counted."""
        return F.size(F.filter(F.arrays_zip(mine.alias("v"), lengths.alias("n")), lambda x: (x["n"] > over) & ~F.array_contains(theirs, x["v"])))

    missing = absent(ref_h, F.col("rn"), loc_h, 3)
    miss_f = absent(ref_f, F.col("rm"), loc_f, 1)
    fails = [
        ((F.size(ref_h) > 0) & (missing > F.size(ref_h) * 0.15), F.format_string("missing %d/%d sections", missing, F.size(ref_h))),
        (
            (F.col("rcards") >= 3) & (F.col("lcards") < F.col("rcards") * 0.5),
            F.format_string("listing shortfall %d vs %d", F.col("lcards"), F.col("rcards")),
        ),
    ]
    warns = [
        ((F.size(ref_f) > 0) & (miss_f > F.size(ref_f) * 0.2), F.format_string("missing %d facet values", miss_f)),
        (
            (F.col("rimgs") >= 4) & (F.col("limgs") < F.col("rimgs") * 0.6),
            F.format_string("image shortfall %d vs %d", F.col("limgs"), F.col("rimgs")),
        ),
        (~same_order(ref_h, loc_h), F.lit("section order differs")),
    ]

    def pack(checks) -> Column:
        return F.filter(F.array(*[F.when(c, m) for c, m in checks]), lambda x: x.isNotNull())

    return j.select(key, pack(fails).alias("fails"), pack(warns).alias("warns"))


def score_card(scored: DataFrame, status: str = "status") -> DataFrame:
    """One row of pass / fail / unscorable counts; nothing scored is a failure."""
    counts = scored.agg(
        F.count_if(F.col(status) == "pass").alias("passed"),
        F.count_if(F.col(status) == "fail").alias("failed"),
        F.count_if(F.col(status) == "unscorable").alias("unscorable"),
    )
    gated = F.col("passed") + F.col("failed")
    return counts.withColumn("ok", (gated > 0) & (F.col("failed") == 0))


def report_lines(audit: DataFrame) -> DataFrame:
    """Markdown table rows of the punch list, ordered."""
    mark = F.create_map(*[F.lit(x) for pair in SEVERITY_MARK.items() for x in pair])

    def shown(c: str, none: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(none))

    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.element_at(mark, F.col("severity")),
            F.concat(F.lit("`"), F.col("page"), F.lit("`")),
            F.col("class"),
            shown("local_text", "-"),
            shown("ref_text", "-"),
            shown("local_imgs", "-"),
            shown("ref_imgs", "-"),
            F.col("note"),
        ),
        F.lit(" |"),
    )
    return punch_list(audit).select("severity", "page", line.alias("value"))


def structure_gate(reference: DataFrame, local: DataFrame, key: str = "page", least: int = rules.MIN_CARDS) -> DataFrame:
    """(key, ref_cards, local_cards, status): fails where less than half of at least ``least`` repeated
    structures are there; a page that is missing has none."""
    ref = reference.select(key, F.col("cards").alias("ref_cards"))
    both = ref.join(local.select(key, F.col("cards").alias("_l")), key, "left").withColumn("local_cards", F.coalesce("_l", F.lit(0)))
    fails = (F.col("ref_cards") >= least) & (F.col("local_cards") * 2 < F.col("ref_cards"))
    return both.select(key, "ref_cards", "local_cards", F.when(fails, "fail").otherwise("pass").alias("status"))


def punch_summary(audit: DataFrame) -> DataFrame:
    """(rank, value): the summary lines above the punch list, one for each class and a total."""
    counts = audit.rollup("class").agg(F.count(F.lit(1)).alias("n"), F.grouping("class").alias("_all"))
    named = F.when(F.col("_all") == 1, "pages").otherwise(F.col("class"))
    return counts.select(
        F.when(F.col("_all") == 1, -1).otherwise(F.col("n") * 0).cast("int").alias("rank"),
        F.concat(F.lit("- "), named, F.lit(": "), F.col("n").cast("string")).alias("value"),
    )
