"""Time to classification windows, the schedule they come from, and checks of the window registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardloom.functions.rules import client_patch, is_masked, patch_order
from boardloom.operators.ranks import as_of, spread_row_number
from boardloom.sources.shared import staged

PACIFIC = "America/Los_Angeles"
DAY_MS = 86_400_000


def classify(rows: DataFrame, registry: DataFrame, at: str = "game_datetime") -> DataFrame:
    """``rows`` with the registry row whose half-open window covers ``at``; gaps stay null.

    Windows that overlap are refused, so the latest one that has started is the only one that can cover a time.
    """
    windows = registry.where("ends_at > starts_at")
    if not _with_next(windows).where("next_start < ends_at").isEmpty():
        raise ValueError("windows of the registry overlap")
    found = as_of(rows, windows, at, "starts_at")
    covered = F.col(at) < F.col("ends_at")
    return found.select(*rows.columns, *[F.when(covered, F.col(c)).alias(c) for c in windows.columns if c not in rows.columns])


def _with_next(registry: DataFrame) -> DataFrame:
    """``registry`` with ``next_start``, the start of the window that follows in order of (start, end, label)."""
    placed = staged(spread_row_number(registry, [], [F.col("starts_at"), F.col("ends_at"), F.col("label") if "label" in registry.columns else F.lit(0)], "__n"))
    after = placed.select((F.col("__n") - 1).alias("__n"), F.col("starts_at").alias("next_start"))
    return placed.join(after, "__n", "left").drop("__n")


def resolved_patches(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """``matches`` with ``patch``: the version's own, or for a masked version the window that covers its time.

    A masked version outside all windows has no patch.
    """
    usable = registry.select("starts_at", "ends_at", F.col("label").alias("__label"))
    found = classify(matches, usable)
    patch = F.when(is_masked(F.col("game_version")), F.col("__label")).otherwise(client_patch(F.col("game_version")))
    return found.withColumn("patch", patch).select(*matches.columns, "patch")


def reclassify(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """``stored`` (with ``patch``) under a registry that has grown: only rows without a patch are looked up again."""
    open_, done = stored.where("patch is null"), stored.where("patch is not null")
    return done.unionByName(resolved_patches(open_.drop("patch"), registry).select(*stored.columns))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Windows that overlap their successor, end before they start, or define a label again."""
    marked = _with_next(registry).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("label")))
    reason = F.when(F.col("ends_at") <= F.col("starts_at"), "empty").when(F.col("next_start") < F.col("ends_at"), "overlap").when(F.col("same") > 1, "redefined")
    return marked.withColumn("reason", reason).where("reason is not null").select("label", "starts_at", "ends_at", "reason")


def current_window(registry: DataFrame, now_ms: int) -> DataFrame:
    """The latest started window if it has not ended; else no row."""
    latest = registry.where(F.col("starts_at") <= now_ms).orderBy(F.desc("starts_at"), "label").limit(1)
    return latest.where(F.col("ends_at") > now_ms)


def utc_text(ms: Column) -> Column:
    """Epoch milliseconds as ISO text in UTC, to the second."""
    return F.date_format(F.from_unixtime(F.floor(ms / 1000), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pacific_local(ms: Column) -> Column:
    """Wall-clock time of the US Pacific zone at an instant, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(PACIFIC), F.timestamp_millis(ms).cast("timestamp_ntz"))


def pacific_instant_ms(day: Column, hour: int) -> Column:
    """Epoch milliseconds of an hour of a Pacific day; saving time is the zone's own."""
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(0), F.lit(0))
    utc = F.convert_timezone(F.lit(PACIFIC), F.lit("UTC"), local)
    return F.datediff(F.to_date(utc), F.lit("1970-01-01")).cast("long") * DAY_MS + (F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)).cast("long") * 1000


#: fixed formats of schedule rows
LABEL = r"^TFT\s+(\d{1,3})\.(\d{1,2})([A-Za-z])?$"
DATE = r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})(?:\s*\(\s*([A-Za-z]+)\s*\))?$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def schedule_rows(raw: DataFrame) -> DataFrame:
    """Typed schedule rows from (raw_patch, raw_date); ``problem`` says why a row can't be read.

    A weekday that the date does not fall on makes the row ambiguous: it may be the written day or
    the nearest one of that weekday.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    patch, date = tidy(F.col("raw_patch")), tidy(F.col("raw_date"))
    label = lambda i: F.regexp_extract(patch, LABEL, i)
    piece = lambda i: F.lower(F.regexp_extract(date, DATE, i))
    index = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c)
    number = lambda c: c.try_cast("int")
    month, weekday = index(MONTHS, piece(1)), index(WEEKDAYS, piece(4))
    day = F.expr("try_make_timestamp_ntz(__y, __m, __d, 0, 0, 0)").cast("date")
    rows = raw.withColumns({"__y": number(piece(3)), "__m": F.when(month > 0, month.cast("int")), "__d": number(piece(2)), "__w": weekday}).withColumn("scheduled_date", day)
    suffix = F.upper(label(3))
    base = F.concat(number(label(1)).cast("string"), F.lit("."), number(label(2)).cast("string"))
    delta = F.pmod(F.col("__w") - 1 - F.weekday("scheduled_date"), F.lit(7))
    other = F.when((F.col("__w") > 0) & (delta > 0), F.date_add("scheduled_date", F.when(delta <= 3, delta).otherwise(delta - 7).cast("int"))).otherwise(F.col("scheduled_date"))
    problem = (
        F.when(label(1) == "", "unexpected label")
        .when(F.col("__m").isNull(), "unexpected date")
        .when(F.col("scheduled_date").isNull(), "impossible date")
        .when(~F.col("__y").between(2020, 2100), "implausible year")
        .when((piece(4) != "") & (F.col("__w") == 0), "unexpected annotation")
    )
    out = rows.withColumns(
        {
            "label": F.concat(base, suffix),
            "base_patch": base,
            "suffix": F.when(suffix != "", suffix),
            "kind": F.when(suffix != "", "balance").otherwise("patch"),
            "earliest_date": F.least("scheduled_date", other),
            "latest_date": F.greatest("scheduled_date", other),
            "problem": problem,
        }
    )
    return out.drop("__y", "__m", "__d", "__w")


def _in_order(events: DataFrame) -> Window:
    return Window.orderBy("scheduled_date", "label")


def schedule_violations(events: DataFrame) -> DataFrame:
    """(label, reason) of schedule rows that break its order; a schedule has some dozens of rows."""
    by_date = _in_order(events)
    last_patch = F.last(F.when(F.col("kind") == "patch", F.col("base_patch")), ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumns({"before": F.lag("latest_date").over(by_date), "last_patch": last_patch, "same": F.count(F.lit(1)).over(Window.partitionBy("label"))})
    plain = F.col("kind") == "patch"
    reason = (
        F.when(F.col("same") > 1, "label repeats")
        .when(F.col("earliest_date") <= F.col("before"), "not later than the row before")
        .when(plain & (patch_order(F.col("base_patch")) <= patch_order(F.col("last_patch"))), "patch does not increase")
        .when(~plain & ~F.coalesce(F.col("base_patch") == F.col("last_patch"), F.lit(False)), "balance row without its patch")
    )
    return marked.withColumn("reason", reason).where("reason is not null").select("label", "reason")


def schedule_fingerprint(events: DataFrame) -> DataFrame:
    """One row with a digest of the schedule's rows in order."""
    row = F.concat_ws("|", "label", "kind", F.col("scheduled_date").cast("string"), F.col("earliest_date").cast("string"), F.col("latest_date").cast("string"))
    lines = events.select(F.struct("scheduled_date", "label", row.alias("row")).alias("s"))
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["row"]), "\n"), 256).alias("fingerprint"))


def windows_from_schedule(events: DataFrame, *, hours: int = 24) -> DataFrame:
    """A window for each patch row with a successor: from the day after its latest reading to two days before the successor's earliest."""
    by_date = _in_order(events)
    nxt = events.withColumns({"until_label": F.lead("label").over(by_date), "until_date": F.lead("earliest_date").over(by_date)})
    start = pacific_instant_ms(F.date_add("latest_date", 1), 0)
    end = pacific_instant_ms(F.date_sub("until_date", 2), 17)
    rows = nxt.where("kind = 'patch' and until_date is not null").withColumns({"starts_at": start, "ends_at": end})
    return rows.where(F.col("ends_at") - F.col("starts_at") >= hours * 3_600_000).select(F.col("base_patch").alias("label"), "starts_at", "ends_at", "until_label", "until_date")


def window_facts(matches: DataFrame, participants: DataFrame, registry: DataFrame) -> DataFrame:
    """Matches, boards and the latest time inside each window of the registry."""
    inside = classify(matches, registry).where("label is not null")
    boards = participants.join(inside.select("match_id", "label"), "match_id").groupBy("label").agg(F.count(F.lit(1)).alias("boards"))
    n = inside.groupBy("label").agg(F.count(F.lit(1)).alias("matches"), F.max("game_datetime").alias("latest"))
    return registry.select("label").join(n, "label", "left").join(boards, "label", "left").select("label", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("boards", F.lit(0)).alias("boards"), "latest")


def publication_choice(live: DataFrame, published: DataFrame, current: str, *, least_alone: int, least_new: int, least_first: int) -> DataFrame:
    """(window, matches, published, decision) for the current window and, while it is small, the one before it.

    A window is published when it has ``least_first`` matches for the first time or ``least_new`` more than before.
    """
    here = F.max(F.when(F.col("balance_window") == current, F.col("matches")))
    state = live.agg(F.coalesce(here, F.lit(0)).alias("here"), F.max(F.when(F.col("balance_window") < current, F.col("balance_window"))).alias("previous"))
    wanted = live.crossJoin(state).where((F.col("balance_window") == current) | ((F.col("here") < least_alone) & (F.col("balance_window") == F.col("previous"))))
    both = wanted.join(published.select("balance_window", F.col("matches").alias("published")), "balance_window", "left")
    old = F.coalesce("published", F.lit(0))
    decision = F.when((old == 0) & (F.col("matches") >= least_first), "first").when((old > 0) & (F.col("matches") - old >= least_new), "update").otherwise("wait")
    return both.select("balance_window", "matches", old.alias("published"), decision.alias("decision"))
