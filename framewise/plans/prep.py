"""From flagged, multi-valued, hand-coded records to the clean fact.

Records carry ``subject, frame, item, reason``; ``KEYS`` identify a frame and are never
NULL.  All steps keep a frame's records together, so in a chain that starts from
``colocate`` later joins on the frame, distinct rows and frame windows find them in place;
dictionary joins that are not broadcast shuffle by item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.domain import Domain, ordinal
from framewise.functions.nulls import blank_where_set, if_known
from framewise.operators.joins import heavy_values, look_up, non_members, outside
from framewise.operators.reshape import explode_list
from framewise.operators.tasks import dealt

KEYS = ["subject", "frame"]
RECORD = [*KEYS, "item", "reason"]

# Fixed values of the published coding scheme.
REASON_FLAGS = {"none": "None", "exclude": "Exclude", "unsure": "Unsure", "experimenter": "Experimenter"}
EXPERIMENTER_TEXT = "exclude"
# The published scheme reads at most so many entries of raw, dictionary and correction lists.
PUBLISHED_CAPS = (3, 2, 3)
CONFLICT_REASON = "None"


def text_flag(df: DataFrame, column: str, pattern: str, out: str) -> DataFrame:
    """0/1 flag: does the lower-cased text match; NULL text gives NULL."""
    return df.withColumn(out, if_known(F.lower(column).rlike(pattern), F.lit(1), F.lit(0)))


def reasons_of(flags: dict[str, str], strict: bool = False) -> Column:
    """Array of the distinct reasons of a row, with NULL standing for an unset flag.

    ``strict`` leaves NULL only in rows with no flag set.
    """
    named = F.array_distinct(F.array(*[F.when(F.col(c) == 1, n) for c, n in flags.items()]))
    if not strict:
        return named
    set_only = F.array_compact(named)
    return F.when(F.size(set_only) > 0, set_only).otherwise(F.array(F.lit(None).cast("string")))


def flags_to_reason(df: DataFrame, flags: dict[str, str], strict: bool = False) -> DataFrame:
    """One row per distinct reason of each record.

    A record with an unset flag also keeps a row without reason, so an excluded frame may
    look usable too; ``strict=True`` prevents that.  Each record unfolds into its few
    distinct reasons rather than one row per flag.
    """
    return unfold_reasons(df, flags, strict).distinct()


def unfold_reasons(df: DataFrame, flags: dict[str, str], strict: bool = False) -> DataFrame:
    """``flags_to_reason`` without removing repeated rows, so without a shuffle."""
    return df.select(*KEYS, "item", F.explode(reasons_of(flags, strict)).alias("reason"))


def overlay_each_flag(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Overlay rows from a checked list: one per distinct reason, NULL included."""
    return df.select(
        *KEYS, F.col("item").alias("new_item"), F.explode(reasons_of(flags)).alias("new_reason")
    ).distinct()


def overlay_first_flag(df: DataFrame, priority: list[tuple[str, str]]) -> DataFrame:
    """Overlay rows whose reason is the first set flag; an unknown flag gives no reason."""
    reason = F.lit(None).cast("string")
    for column, name in reversed(priority):
        reason = if_known(F.col(column) == 1, F.lit(name), reason)
    return df.select(*KEYS, F.col("item").alias("new_item"), reason.alias("new_reason"))


def colocate(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash the records by frame, over ``tasks`` partitions that adaptive execution does not join."""
    return df.repartition(*KEYS) if tasks is None else dealt(df, KEYS, tasks)


def apply_overlay(base: DataFrame, overlay: DataFrame, how: str = "left") -> DataFrame:
    """Replace the records of every frame the overlay lists, even by NULL.

    A listed frame first collapses to one empty row and then takes the overlay's rows, so
    base and overlay rows of a frame are never paired.  ``how="full"`` also adds frames
    the base lacks.
    """
    listed = overlay.select(*KEYS).distinct().withColumn("_listed", F.lit(True))
    marked = base.select(*RECORD).join(listed, KEYS, "left")
    untouched = F.col("_listed").isNull()
    collapsed = marked.select(
        *KEYS,
        F.when(untouched, F.col("item")).alias("item"),
        F.when(untouched, F.col("reason")).alias("reason"),
    ).distinct()
    rows = overlay.select(*KEYS, "new_item", "new_reason").withColumn("_hit", F.lit(True))
    joined = collapsed.join(rows, KEYS, how)
    if how == "full":  # a full join forgets its partitioning
        joined = colocate(joined)
    hit = F.col("_hit").isNotNull()
    picked = joined.select(
        *KEYS,
        F.when(hit, F.col("new_item")).otherwise(F.col("item")).alias("item"),
        F.when(hit, F.col("new_reason")).otherwise(F.col("reason")).alias("reason"),
    )
    return picked.withColumn("item", blank_where_set(F.col("reason"), F.col("item"))).distinct()


def _stacked(base: DataFrame, overlays: list[tuple[DataFrame, str]]) -> DataFrame:
    """Base records and overlay rows as ``RECORD`` with their turn and whether they add frames."""
    parts = [base.select(*RECORD, F.lit(0).alias("_turn"), F.lit(True).alias("_adds"))]
    parts += [_turns(overlay, turn, how) for turn, (overlay, how) in enumerate(overlays, 1)]
    return reduce(DataFrame.unionByName, parts)


def _turns(overlay: DataFrame, turn: int, how: str) -> DataFrame:
    new = [F.col(f"new_{c}").alias(c) for c in ("item", "reason")]
    return overlay.select(*KEYS, *new, F.lit(turn).alias("_turn"), F.lit(how == "full").alias("_adds"))


def fold_overlays(base: DataFrame, overlays: list[tuple[DataFrame, str]], tasks: int | None = None) -> DataFrame:
    """Several overlays at once, with the result of ``apply_overlay`` one after the other.

    Of a frame's rows those of its last overlay win, or the base's if none lists it; a frame that
    the base lacks needs one ``"full"`` overlay among its own.  All rows are stacked and one window
    per frame picks the winners: one shuffle and no join, however many overlays there are.
    """
    frame = Window.partitionBy(*KEYS)
    rows = dealt(_stacked(base, overlays), KEYS, tasks).withColumns(
        {"_last": F.max("_turn").over(frame), "_there": F.max("_adds").over(frame)}
    )
    won = rows.where((F.col("_turn") == F.col("_last")) & F.col("_there")).select(*RECORD)
    return won.withColumn("item", blank_where_set(F.col("reason"), F.col("item"))).distinct()


def worklist(df: DataFrame, checked: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Rows that need review and are not among those already checked."""
    return non_members(df.where(where), checked, keys)


def split_items(df: DataFrame, max_items: int | None = None, tasks: int | None = None) -> DataFrame:
    """One record per listed item; rows with neither item nor reason disappear.

    With ``tasks``, here and in the steps below, rows are dealt over so many by frame (``colocate``).
    """
    rows = explode_list(dealt(df.select(*RECORD), KEYS, tasks), "item", max_items, keep_if=F.col("reason").isNotNull())
    return rows.withColumn("item", blank_where_set(F.col("reason"), F.col("item"))).distinct()


def regularise_labels(
    df: DataFrame, labels: DataFrame, max_items: int | None = None, heavy: list | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Swap raw labels for their dictionary form, which may itself list items.

    ``heavy`` names items that many rows share (default: those of ``df``).
    """
    return split_items(_renamed(df, labels, heavy), max_items, tasks)


def _renamed(df: DataFrame, labels: DataFrame, heavy: list | None) -> DataFrame:
    heavy = heavy_values(df, "item") if heavy is None else heavy
    named = look_up(df, labels.select("item", "new_item"), "item", [*KEYS, "reason"], heavy)
    return named.withColumn("item", F.coalesce("new_item", "item")).select(*df.columns)


def apply_corrections(
    df: DataFrame, corrections: DataFrame, max_items: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Authoritative overlay whose items may be lists."""
    return split_items(apply_overlay(dealt(df, KEYS, tasks), corrections), max_items)


def relabel_by_frame(
    df: DataFrame,
    records: DataFrame,
    pattern: str,
    rules: list[tuple[str, str]],
    only_matching: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Rename the items of frames whose raw text matches and whose flag is set.

    The first rule that applies to a frame wins and renames every row of the frame, or
    only rows whose item matches with ``only_matching``.  Without rules nothing changes.
    """
    if not rules:
        return df
    marks = (
        records.where(F.col("item").rlike(pattern))
        .groupBy(*KEYS)
        .agg(*[F.max(F.col(flag) == 1).alias(f"_{flag}") for flag, _ in rules])
    )
    scope = F.col("item").rlike(pattern) if only_matching else F.lit(True)
    item = F
    for flag, name in rules:
        item = item.when(F.col(f"_{flag}") & scope, F.lit(name))
    renamed = dealt(df, KEYS, tasks).join(marks, KEYS, "left").withColumn("item", item.otherwise(F.col("item")))
    return renamed.select(*df.columns)


def audit_exclusive(records: DataFrame, pattern: str, one: str, other: str) -> DataFrame:
    """How many matching records set two flags that exclude each other."""
    both = (F.col(one) == 1) & (F.col(other) == 1)
    return records.where(F.col("item").rlike(pattern)).agg(F.count_if(both).alias("n_conflicts"))


def assign_category(
    df: DataFrame, categories: DataFrame, heavy: list | None = None, tasks: int | None = None
) -> DataFrame:
    """Look up the category of each item; excluded rows keep neither.

    ``heavy`` names items that many rows share (default: those of ``df``).
    """
    heavy = heavy_values(df, "item") if heavy is None else heavy
    found = look_up(df, categories.select("item", "category"), "item", [*KEYS, "reason"], heavy)
    reason = F.col("reason")
    return dealt(found, KEYS, tasks).select(
        *KEYS,
        "reason",
        blank_where_set(reason, F.col("category")).alias("category"),
        blank_where_set(reason, F.col("item")).alias("item"),
    ).distinct()


def resolve_reasons(df: DataFrame, conflict: str = CONFLICT_REASON) -> DataFrame:
    """Frames with several different reasons get one common reason on all rows."""
    frame = Window.partitionBy(*KEYS)
    differ = F.min("reason").over(frame) != F.max("reason").over(frame)
    return df.withColumn(
        "reason", F.when(differ, F.lit(conflict)).otherwise(F.col("reason"))
    ).distinct()


def pick_one(df: DataFrame, group: str, member: str, seed: int) -> DataFrame:
    """One member per group, arbitrary but fixed by the seed."""
    lot = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(member).cast("string")).cast("binary"))
    return (
        df.select(group, member)
        .distinct()
        .groupBy(group)
        .agg(F.min_by(member, F.struct(lot, F.col(member))).alias(member))
    )


def clean_fact(
    df: DataFrame,
    participants: DataFrame,
    timestamps: DataFrame,
    dropped: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add subject and time columns, leave out dropped subjects, order the columns.

    Times that carry a ``duration`` (``agree.frame_durations``) hand it on as the last column.
    Repeated rows go before the subject's columns come, so the wider rows are only joined.
    """
    times = [c for c in ("ts", "duration") if c in timestamps.columns]
    if dropped is not None:
        df = non_members(df, dropped, ["subject"])
    people = participants.select("subject", "site", "age", "sex", "wearer").distinct()
    reason = F.col("reason")
    rows = dealt(df, KEYS, tasks).join(timestamps.select(*KEYS, *times), KEYS, "left").select(
        *KEYS,
        "reason",
        blank_where_set(reason, F.col("category")).alias("category"),
        blank_where_set(reason, F.col("item")).alias("item"),
        *times,
    )
    joined = dealt(rows.distinct(), ["subject"], tasks).join(people, ["subject"], "left")
    return joined.select("site", "subject", "age", "sex", "wearer", "frame", "reason", "category", "item", *times)


def prepare(
    records: DataFrame,
    overlays: list[tuple[DataFrame, str]],
    labels: DataFrame,
    corrections: DataFrame,
    pattern: str,
    rules: list[tuple[str, str]],
    categories: DataFrame,
    participants: DataFrame,
    timestamps: DataFrame,
    dropped: DataFrame | None = None,
    flags: dict[str, str] = REASON_FLAGS,
    strict: bool = False,
    caps: tuple[int | None, int | None, int | None] = (None, None, None),
    tasks: int | None = None,
) -> DataFrame:
    """The whole chain from raw records to the clean fact, with one shuffle of the records by frame.

    ``overlays`` are applied in order, each with its join kind.  ``pattern`` and ``rules``
    relabel frames by their raw text and flags.  Lists of items are read whole; ``caps`` limits
    raw, dictionary and correction lists, as ``PUBLISHED_CAPS`` does.

    The rows of records and overlays are split and renamed where they are, then stacked with the
    corrections, and one window per frame picks those that stand: of the overlays as in
    ``fold_overlays``, and the corrections where the frame has a row otherwise.  A row that splits
    to nothing keeps its turn until then.  With ``tasks`` every step by frame or subject has so many.
    """
    flagged = text_flag(records, "item", EXPERIMENTER_TEXT, "experimenter")
    heavy, renamed = _heavy_items(records, labels, caps[0])
    rows = _entries(_stacked(unfold_reasons(flagged, flags, strict), overlays), caps[0])
    named = _renamed(rows.withColumn("_has", F.col("item").isNotNull()), labels, heavy)
    rows = _entries(named.withColumn("item", F.when(F.col("_has"), F.col("item"))).drop("_has"), caps[1])
    patch = _entries(_turns(corrections, len(overlays) + 1, "left"), caps[2])
    rows = rows.unionByName(patch)
    rows = _standing(dealt(rows, KEYS, tasks), len(overlays))
    rows = resolve_reasons(relabel_by_frame(rows, records, pattern, rules))
    rows = assign_category(rows, categories, sorted({*heavy, *renamed, *[name for _, name in rules]}), tasks)
    return clean_fact(rows, participants, timestamps, dropped, tasks)


def _entries(df: DataFrame, max_items: int | None) -> DataFrame:
    """One row per listed item; a row without any keeps one, empty.  Excluded rows have no item."""
    blanked = df.withColumn("item", blank_where_set(F.col("reason"), F.col("item")))
    return explode_list(blanked, "item", max_items, keep_if=F.lit(True))


def _heavy_items(records: DataFrame, labels: DataFrame, max_items: int | None) -> tuple[list, list]:
    """Items that many raw records list, and their dictionary forms (few, as the former are)."""
    heavy = heavy_values(explode_list(records.select("item"), "item", max_items), "item")
    if not heavy:
        return [], []
    forms = explode_list(labels.where(F.col("item").isin(heavy)).select(F.col("new_item").alias("item")), "item")
    return heavy, [r["item"] for r in forms.distinct().collect()]


def _standing(rows: DataFrame, overlays: int) -> DataFrame:
    """Records that stand after the overlays' turns and the corrections' turn after them."""
    frame = Window.partitionBy(*KEYS)
    turn, whole = F.col("_turn"), F.col("item").isNotNull() | F.col("reason").isNotNull()
    corrected = turn > overlays
    rows = rows.withColumns(
        {
            "_last": F.max(F.when(~corrected, turn)).over(frame),
            "_there": F.max(F.when(~corrected, F.col("_adds"))).over(frame),
            "_patched": F.max(corrected).over(frame),
        }
    )
    won = (turn == F.col("_last")) & F.col("_there")
    rows = rows.withColumn("_alive", F.coalesce(F.max(won & whole).over(frame), F.lit(False)))
    stands = F.when(F.col("_patched") & F.col("_alive"), corrected).otherwise(won)
    return rows.where(stands & whole).select(*RECORD).distinct()


def analysis_view(
    fact: DataFrame, excluded_items: tuple[str, ...] = (), domain: Domain | None = None
) -> DataFrame:
    """Usable, categorised rows with the hour of day.

    With a ``domain``, sites and categories outside it become NULL and ``site_level`` and
    ``category_level`` give their places in it.
    """
    usable = fact.where(F.col("reason").isNull() & F.col("category").isNotNull())
    view = usable.where(outside(F.col("item"), excluded_items)).withColumn("hour", F.hour("ts").cast("long"))
    if domain is None:
        return view
    levels = {"site": domain.sites, "category": domain.categories}
    view = view.withColumns({f"{c}_level": ordinal(F.col(c), names) for c, names in levels.items()})
    return view.withColumns({c: F.when(F.col(f"{c}_level").isNotNull(), F.col(c)) for c in levels})
