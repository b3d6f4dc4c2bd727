"""Listing queries over the node table: filter, order, page, facet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import number_rows, pick
from .tree import descendants_of, of_type


def listing(
    nodes: DataFrame,
    closure: DataFrame | None = None,
    type: str | None = None,
    root: str | None = None,
    criteria: str = "created",
    direction: str = "desc",
    limit: int | None = None,
    categories: list | None = None,
    exclude: list | None = None,
    category_col: str = "categories",
    id_col: str = "uuid",
    path_col: str = "path",
    tiebreak: str | None = None,
) -> DataFrame:
    """Nodes of a type below ``root`` in any of ``categories``, without ``exclude``, ordered.

    Every excluded id is excluded. A missing, zero or negative ``limit`` means all rows. Unlimited
    results carry a total order through a range sort; limited ones become a top-k.
    """
    out = of_type(nodes, closure, type) if type and closure is not None else nodes
    if type and closure is None:
        out = out.where(F.col("primary_type") == type)
    if root:
        out = out.where(descendants_of(F.col(path_col), root))
    wanted = [c for c in categories or [] if c is not None]
    if wanted:
        out = out.where(F.arrays_overlap(category_col, F.array(*[F.lit(c) for c in wanted])))
    drop = [e for e in exclude or [] if e is not None]
    if drop:
        out = out.where(~F.col(id_col).isin(drop))
    key = F.col(criteria)
    out = out.orderBy(key.asc() if (direction or "desc").lower() == "asc" else key.desc(), tiebreak or path_col)
    return out.limit(limit) if limit and limit > 0 else out


def newest(nodes: DataFrame, criteria: str, n: int = 3, tiebreak: str = "path") -> DataFrame:
    return nodes.orderBy(F.col(criteria).desc(), tiebreak).limit(n)


def page_of(rn: Column, size: int = 6) -> Column:
    return F.floor((rn - 1) / size)


def paginate(
    rows: DataFrame, order: list, size: int = 6, predicate: Column | None = None
) -> DataFrame:
    """Adds ``rn``, ``page_no`` (from 0) and ``remaining`` after that page, within the filtered rows.

    Writes the ordered rows once (see ``number_rows``); no single-task window over the whole result.
    """
    kept = rows.where(predicate) if predicate is not None else rows
    numbered = number_rows(kept, order)
    total = numbered.agg(F.max("rn").alias("_total"))  # one row
    shown = (page_of(F.col("rn"), size) + 1) * size
    return (
        numbered.crossJoin(F.broadcast(total))
        .withColumn("page_no", page_of(F.col("rn"), size))
        .withColumn("remaining", F.greatest(F.col("_total") - shown, F.lit(0)))
        .drop("_total")
    )


def page_count(n: Column, size: int = 6) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size))


def slots(rows: DataFrame, order: list, names: list[str]) -> DataFrame:
    """The first ``len(names)`` rows, each with its slot name."""
    top = rows.orderBy(*order).limit(len(names))
    from pyspark.sql import Window as W

    table = F.array(*[F.lit(n) for n in names])
    ranked = top.withColumn("rn", F.row_number().over(W.orderBy(*order)))  # len(names) rows
    return ranked.withColumn("slot", F.element_at(table, F.col("rn")))


def facet_columns(
    rows: DataFrame, categories: DataFrame, branches: dict[str, str], id_col: str = "uuid", category_col: str = "categories"
) -> DataFrame:
    """Adds ``<facet>_name`` and ``<facet>_title`` per branch of the category tree.

    A node's categories are looked up (unresolvable ids skipped) and sorted into facets by the
    branch substring of the category path; the last one listed wins. A category belongs to the
    first branch that matches. The lookup runs once per distinct category id.
    """
    from .joins import skew_join

    branch = None
    for facet, part in branches.items():
        hit = F.col("path").contains(part)
        branch = F.when(hit, facet) if branch is None else branch.when(hit, facet)
    dim = categories.select(
        F.col("category_uuid").alias("_cat"),
        F.struct(
            F.col("name").alias("name"),
            F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("name")).alias("title"),
        ).alias("_entry"),
        branch.alias("_branch"),
    ).where(F.col("_branch").isNotNull())
    each = rows.select(id_col, F.posexplode(category_col).alias("_pos", "_cat"))
    found = skew_join(each, dim, ["_cat"], "inner")
    wide = found.groupBy(id_col).agg(
        *[
            F.max_by(F.when(F.col("_branch") == f, F.col("_entry")), F.when(F.col("_branch") == f, F.col("_pos"))).alias(f"_{f}")
            for f in branches
        ]
    )
    out = rows.join(wide, id_col, "left")
    for f in branches:
        out = out.withColumn(f"{f}_name", F.col(f"_{f}.name")).withColumn(f"{f}_title", F.col(f"_{f}.title")).drop(f"_{f}")
    return out


def parse_facet(spec: str) -> tuple[str, str, str]:
    """'field|label' -> (field, label, attribute)."""
    field, _, label = spec.partition("|")
    label = label.partition("|")[0] if "|" in spec else field
    low = field.lower()
    if "theme" in low:
        attr = "theme"
    elif "type" in low:
        attr = "type"
    else:
        attr = "".join(c if c.isascii() and c.isalnum() else "-" for c in low)
    return field, label, attr


def facet_attribute(field: Column) -> Column:
    """The attribute of ``parse_facet`` for a column of field names."""
    low = F.lower(field)
    plain = F.regexp_replace(low, r"[^a-z0-9]", "-")
    return F.when(low.contains("theme"), "theme").when(low.contains("type"), "type").otherwise(plain)


def facet_spec(spec: Column) -> Column:
    """struct<field, label, attr> of 'field|label', as ``parse_facet`` for a column."""
    field = F.substring_index(spec, "|", 1)
    label = F.when(F.contains(spec, F.lit("|")), F.split_part(spec, F.lit("|"), F.lit(2))).otherwise(field)
    return F.struct(field.alias("field"), label.alias("label"), facet_attribute(field).alias("attr"))


def facets(rows: DataFrame, attrs: dict[str, tuple[str, str]], order: str) -> DataFrame:
    """(attr, value, label, n) for each facet attribute; the label is the first one seen by ``order``.

    ``attrs`` maps the attribute name to its (value column, label column).
    """
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("attr"), F.col(v).cast("string").alias("value"), F.col(lbl).cast("string").alias("label"))
                for a, (v, lbl) in attrs.items()
            ]
        )
    ).alias("f")
    flat = rows.select(each, F.col(order).alias("_o")).select("f.*", "_o")
    flat = flat.where(F.coalesce(F.col("value"), F.lit("")) != "")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("value"))
    return (
        flat.withColumn("label", label)
        .groupBy("attr", "value")
        .agg(F.min_by("label", "_o").alias("label"), F.count(F.lit(1)).alias("n"))
    )


def apply_facets(rows: DataFrame, selected: dict[str, object]) -> DataFrame:
    """AND over the chosen values; empty choices are ignored. Array columns match by membership."""
    types = dict(rows.dtypes)
    tests = [
        F.array_contains(c, v) if types[c].startswith("array") else F.col(c) == v
        for c, v in selected.items()
        if v not in (None, "")
    ]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def available_categories(rows: DataFrame, order: str, category_col: str = "categories", names: DataFrame | None = None) -> DataFrame:
    """Distinct categories of a result in first-seen order; unresolvable ids keep the id as name."""
    each = rows.select(F.col(order).alias("_o"), F.posexplode(category_col).alias("_i", "category"))
    first = each.groupBy("category").agg(F.min(F.struct("_o", "_i")).alias("_first"))
    if names is not None:
        dim = names.select(F.col("category_uuid").alias("category"), F.col("name").alias("_name"))
        first = first.join(dim, "category", "left")
    else:
        first = first.withColumn("_name", F.lit(None).cast("string"))
    return first.orderBy("_first").select("category", F.coalesce("_name", F.col("category").cast("string")).alias("name"))


def present_categories(rows: DataFrame, category: str, fixed_order: list[str]) -> DataFrame:
    """The members of ``fixed_order`` that occur, in that order."""
    place = F.array_position(F.array(*[F.lit(c) for c in fixed_order]), F.col(category)).cast("int")
    seen = rows.select(F.col(category), place.alias("place")).where("place > 0").distinct()
    return seen.orderBy("place")


def group_by_category(rows: DataFrame, category: str, order: list, keep: list[str]) -> DataFrame:
    """Per category ('' for none): row count and first member, in one grouping."""
    cat = F.coalesce(F.col(category), F.lit("")).alias("_cat")
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    grouped = rows.groupBy(cat).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*keep), rank).alias("_first"))
    return grouped.select(F.col("_cat").alias(category), "n", "_first.*")


def category_members(rows: DataFrame, category: str, order: list, keep: list[str]) -> DataFrame:
    """The children grouped by category ('' for none), a row each: category, position in its group (from 1), ``keep``.

    ``order`` must identify a row within its category. A group is never gathered, so any size will do.
    """
    cat = F.coalesce(F.col(category), F.lit(""))
    numbered = number_rows(rows.withColumn(category, cat), order, [category], "position")
    return numbered.select(category, F.col("position").cast("long").alias("position"), *keep)


def type_counts(nodes: DataFrame, type_col: str = "primary_type") -> DataFrame:
    return nodes.groupBy(type_col).agg(F.count(F.lit(1)).alias("n")).orderBy(type_col)
