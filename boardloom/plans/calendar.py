"""Registered queries: versions, schedules, windows.

A schedule is bound to ``nation`` (25 rows): its key makes patch and date, some with a balance
suffix, a wrong weekday or text that is no schedule row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.functions import rules
from boardloom.operators import windows as wi
from boardloom.plans.registry import query, rounded  # noqa: F401
from boardloom.sources.binding import Boards

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = [m.capitalize() for m in wi.MONTHS]

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
_DAY_LIST = "[" + ", ".join(f"'{d}'" for d in DAYS) + "]"
SCHEDULE_SQL = f"""dated AS (SELECT n_nationkey AS k, DATE '2026-01-14' + CAST(14 * n_nationkey AS INTEGER) AS d FROM nation),
raw AS (SELECT k, d, CASE WHEN k = 20 THEN 'Patch twenty' ELSE 'TFT  ' || (16 + (k - k % 3) // 12) || '.' || (1 + (k - k % 3) % 12) || CASE WHEN k % 3 = 1 THEN 'b' ELSE '' END END AS raw_patch,
  CASE WHEN k = 22 THEN 'TBD' WHEN k = 23 THEN 'February 30, 2027' ELSE {_MONTH_LIST}[month(d)] || ' ' || day(d) || ', ' || year(d) || CASE WHEN k % 4 = 0 THEN ' (' || {_DAY_LIST}[(isodow(d) + k // 4) % 7 + 1] || ')' WHEN k = 21 THEN ' (Someday)' ELSE '' END END AS raw_date FROM dated),
typed AS (SELECT k, d, (16 + (k - k % 3) // 12) || '.' || (1 + (k - k % 3) % 12) AS base_patch, CASE WHEN k % 3 = 1 THEN 'balance' ELSE 'patch' END AS kind, CASE WHEN k % 3 = 1 THEN 'B' ELSE '' END AS suffix,
  CASE WHEN k % 4 = 0 THEN ((isodow(d) + k // 4) % 7 - (isodow(d) - 1) + 7) % 7 ELSE 0 END AS delta FROM raw WHERE k < 20 AND k % 3 < 2),
events AS (SELECT *, base_patch || suffix AS label, CAST(least(d, d + other) AS DATE) AS earliest_date, CAST(greatest(d, d + other) AS DATE) AS latest_date FROM (SELECT *, CAST(CASE WHEN delta = 0 THEN 0 WHEN delta <= 3 THEN delta ELSE delta - 7 END AS INTEGER) AS other FROM typed)),
following AS (SELECT *, lead(label) OVER (ORDER BY d, label) AS until_label, lead(earliest_date) OVER (ORDER BY d, label) AS until_date FROM events),
derived AS (SELECT base_patch AS label, epoch_ms(timezone('America/Los_Angeles', CAST(latest_date + 1 AS TIMESTAMP))) AS starts_at, epoch_ms(timezone('America/Los_Angeles', CAST(until_date - 2 AS TIMESTAMP) + INTERVAL 17 HOUR)) AS ends_at, until_label, CAST(until_date AS VARCHAR) AS until_date
  FROM following WHERE kind = 'patch' AND until_date IS NOT NULL)"""


def _raw(b: Boards) -> DataFrame:
    k = F.col("n_nationkey")
    d = F.date_add(F.lit("2026-01-14").cast("date"), (14 * k).cast("int"))
    base = k - k % 3
    number = F.concat(F.lit("TFT  "), (16 + F.floor(base / 12)).cast("string"), F.lit("."), (1 + base % 12).cast("string"), F.when(k % 3 == 1, "b").otherwise(""))
    named = F.element_at(F.array(*map(F.lit, DAYS)), ((F.weekday(d) + 1 + F.floor(k / 4)) % 7 + 1).cast("int"))
    note = F.when(k % 4 == 0, F.concat(F.lit(" ("), named, F.lit(")"))).when(k == 21, " (Someday)").otherwise("")
    written = F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.lit(" "), F.day(d).cast("string"), F.lit(", "), F.year(d).cast("string"), note)
    text = F.when(k == 22, "TBD").when(k == 23, "February 30, 2027").otherwise(written)
    return b.read("nation").select(k.alias("k"), F.when(k == 20, "Patch twenty").otherwise(number).alias("raw_patch"), text.alias("raw_date"))


def _events(b: Boards) -> DataFrame:
    """The readable rows, without every third one."""
    return wi.schedule_rows(_raw(b)).where("problem is null and k < 20 and k % 3 < 2")


@query("f16_schedule_rows", f"WITH {SCHEDULE_SQL} SELECT k, label, base_patch, kind, CAST(d AS VARCHAR) AS scheduled_date, CAST(earliest_date AS VARCHAR) AS earliest_date, CAST(latest_date AS VARCHAR) AS latest_date FROM events", raw=True)
def schedule_rows(b):
    return _events(b).select("k", "label", "base_patch", "kind", *[F.col(c).cast("string").alias(c) for c in ("scheduled_date", "earliest_date", "latest_date")])


@query("f16_schedule_problems", "SELECT * FROM (VALUES (20, 'unexpected label'), (21, 'unexpected annotation'), (22, 'unexpected date'), (23, 'impossible date')) v(k, problem) WHERE k IN (SELECT n_nationkey FROM nation)", raw=True)
def schedule_problems(b):
    return wi.schedule_rows(_raw(b)).where("problem is not null").select("k", "problem")


@query("w10_windows_from_schedule", f"WITH {SCHEDULE_SQL} SELECT * FROM derived WHERE ends_at - starts_at >= 86400000", raw=True)
def windows_from_schedule(b):
    return wi.windows_from_schedule(_events(b)).withColumn("until_date", F.col("until_date").cast("string"))


_BROKEN_SQL = f"""{SCHEDULE_SQL}, broken AS (SELECT CASE k WHEN 6 THEN '16.4' ELSE label END AS label, CASE k WHEN 9 THEN '15.1' WHEN 13 THEN '15.9' ELSE base_patch END AS base_patch, kind, d, CASE k WHEN 15 THEN CAST(earliest_date - 30 AS DATE) ELSE earliest_date END AS earliest_date, latest_date FROM events),
ordered AS (SELECT *, lag(latest_date) OVER w AS before, last_value(CASE WHEN kind = 'patch' THEN base_patch END IGNORE NULLS) OVER (ORDER BY d, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_patch, count(*) OVER (PARTITION BY label) AS same FROM broken WINDOW w AS (ORDER BY d, label)),
judged AS (SELECT label, CASE WHEN same > 1 THEN 'label repeats' WHEN earliest_date <= before THEN 'not later than the row before'
  WHEN kind = 'patch' AND list_transform(string_split(base_patch, '.'), lambda x: CAST(x AS INTEGER)) <= list_transform(string_split(last_patch, '.'), lambda x: CAST(x AS INTEGER)) THEN 'patch does not increase'
  WHEN kind = 'balance' AND base_patch IS DISTINCT FROM last_patch THEN 'balance row without its patch' END AS reason FROM ordered)"""


@query("w11_schedule_checks", f"WITH {_BROKEN_SQL} SELECT label, reason FROM judged WHERE reason IS NOT NULL", raw=True)
def schedule_checks(b):
    """The bound schedule with a repeated label, two wrong patches and a date moved back."""
    k = F.col("k")
    broken = _events(b).withColumns(
        {
            "label": F.when(k == 6, "16.4").otherwise(F.col("label")),
            "base_patch": F.when(k == 9, "15.1").when(k == 13, "15.9").otherwise(F.col("base_patch")),
            "earliest_date": F.when(k == 15, F.date_sub("earliest_date", 30)).otherwise(F.col("earliest_date")),
        }
    )
    return wi.schedule_violations(broken)


@query("f16_schedule_fingerprint", f"WITH {SCHEDULE_SQL} SELECT sha256(string_agg(label || '|' || kind || '|' || CAST(d AS VARCHAR) || '|' || CAST(earliest_date AS VARCHAR) || '|' || CAST(latest_date AS VARCHAR), chr(10) ORDER BY d, label)) AS fingerprint FROM events", raw=True)
def schedule_fingerprint(b):
    return wi.schedule_fingerprint(_events(b))


_REGISTRY_SQL = "years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), registry AS (SELECT CASE y WHEN 1994 THEN '1993' ELSE CAST(y AS VARCHAR) END AS label, epoch_ms(make_timestamp(y, 1, 15, 0, 0, 0)) AS starts_at, epoch_ms(make_timestamp(CASE y WHEN 1995 THEN 1996 WHEN 1997 THEN 1996 ELSE y END, 11, 1, 0, 0, 0)) AS ends_at FROM years)"
_GOOD_SQL = "years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), good AS (SELECT CAST(y AS VARCHAR) AS label, epoch_ms(make_timestamp(y, 1, 15, 0, 0, 0)) AS starts_at, epoch_ms(make_timestamp(y, 11, 1, 0, 0, 0)) AS ends_at FROM years)"


def _day_ms(year, month: int, day: int):
    return F.datediff(F.make_date(year, F.lit(month), F.lit(day)), F.lit("1970-01-01")).cast("long") * wi.DAY_MS


def _registry(b: Boards, broken: bool = False) -> DataFrame:
    y = F.col("y")
    years = b.read("orders").select(F.year("o_orderdate").alias("y")).distinct()
    if not broken:
        return years.select(y.cast("string").alias("label"), _day_ms(y, 1, 15).alias("starts_at"), _day_ms(y, 11, 1).alias("ends_at"))
    label = F.when(y == 1994, "1993").otherwise(y.cast("string"))
    return years.select(label.alias("label"), _day_ms(y, 1, 15).alias("starts_at"), _day_ms(F.when(y.isin(1995, 1997), 1996).otherwise(y), 11, 1).alias("ends_at"))


@query("w12_registry_checks", f"WITH {_REGISTRY_SQL}, l AS (SELECT *, lead(starts_at) OVER (ORDER BY starts_at, ends_at, label) AS nxt, count(*) OVER (PARTITION BY label) AS same FROM registry) SELECT * FROM (SELECT label, starts_at, ends_at, CASE WHEN ends_at <= starts_at THEN 'empty' WHEN nxt < ends_at THEN 'overlap' WHEN same > 1 THEN 'redefined' END AS reason FROM l) WHERE reason IS NOT NULL", raw=True)
def registry_checks(b):
    return wi.registry_violations(_registry(b, broken=True))


NOW = 858_000_000_000  # in March 1997


@query("w13_current_window", f"WITH {_GOOD_SQL} SELECT * FROM (SELECT * FROM good WHERE starts_at <= {NOW} ORDER BY starts_at DESC LIMIT 1) WHERE ends_at > {NOW}", raw=True)
def current_window(b):
    return wi.current_window(_registry(b), NOW)


_MASKED = "CASE WHEN length(match_id) % 2 = 0 THEN 'TFT Unreal Version ?.?.?.?' WHEN CAST(match_id AS BIGINT) % 7 = 0 THEN 'Release 14.6' WHEN CAST(match_id AS BIGINT) % 11 = 0 THEN '' ELSE game_version END"
_PATCHED = f"{_GOOD_SQL}, shown AS (SELECT *, {_MASKED} AS v FROM matches), patched AS (SELECT match_id, game_datetime, v, CASE WHEN v = '' THEN NULL WHEN v LIKE '%?.?.?.?%' THEN label WHEN v LIKE 'Version%' THEN regexp_extract(v, '(\\d+\\.\\d+)', 1) ELSE v END AS patch FROM shown LEFT JOIN good ON game_datetime >= starts_at AND game_datetime < ends_at)"


def _masked(b: Boards) -> DataFrame:
    """Matches with versions that are masked, of another form, or empty."""
    n = F.col("match_id").cast("long")
    shown = F.when(F.length("match_id") % 2 == 0, "TFT Unreal Version ?.?.?.?").when(n % 7 == 0, "Release 14.6").when(n % 11 == 0, "").otherwise(F.col("game_version"))
    return b.matches.select("match_id", "game_datetime", shown.alias("game_version"))


@query("f01_masked_patch", f", {_PATCHED} SELECT match_id, coalesce(patch, '-') AS patch FROM patched")
def masked_patch(b):
    return wi.resolved_patches(_masked(b), _registry(b)).select("match_id", F.coalesce("patch", F.lit("-")).alias("patch"))


@query("g04_late_reclassification", f", {_PATCHED}, stored AS (SELECT *, CASE WHEN v LIKE '%?.?.?.?%' AND patch >= '1995' THEN NULL ELSE patch END AS old FROM patched) SELECT match_id, coalesce(CASE WHEN old IS NULL AND v LIKE '%?.?.?.?%' THEN patch || '' ELSE old END, '-') AS patch FROM stored")
def late_reclassification(b):
    """Classified under the windows before 1995, then again when the others are known."""
    registry = _registry(b)
    stored = wi.resolved_patches(_masked(b), registry.where("label < '1995'"))
    return wi.reclassify(stored, registry).select("match_id", F.coalesce("patch", F.lit("-")).alias("patch"))


@query("f11_epoch_and_zone", "SELECT match_id, strftime(make_timestamp(game_datetime * 1000), '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(timezone('America/Los_Angeles', timezone('UTC', make_timestamp(game_datetime * 1000))), '%Y-%m-%d %H:%M:%S') AS pacific, epoch_ms(timezone('America/Los_Angeles', CAST(CAST(make_timestamp(game_datetime * 1000) AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR)) AS five_pm FROM matches")
def epoch_and_zone(b):
    ms = F.col("game_datetime")
    day = F.to_date(F.timestamp_millis(ms))
    return b.matches.select("match_id", wi.utc_text(ms).alias("utc"), F.date_format(wi.pacific_local(ms), "yyyy-MM-dd HH:mm:ss").alias("pacific"), wi.pacific_instant_ms(day, 17).alias("five_pm"))


@query("a29_window_facts", f", {_GOOD_SQL} SELECT label, count(DISTINCT m.match_id) AS matches, count(p.match_id) AS boards, max(game_datetime) AS latest FROM good LEFT JOIN matches m ON game_datetime >= starts_at AND game_datetime < ends_at LEFT JOIN participants p ON p.match_id = m.match_id GROUP BY label")
def window_facts(b):
    return wi.window_facts(b.matches, b.participants, _registry(b))


@query("s26_publication_choice", ", live AS (SELECT balance_window, count(*) AS matches FROM matches GROUP BY ALL), old AS (SELECT balance_window, matches - 100 AS published FROM live WHERE balance_window < '1998'), cur AS (SELECT coalesce(max(matches) FILTER (balance_window = '1998'), 0) AS here, max(balance_window) FILTER (balance_window < '1998') AS previous FROM live) "
       "SELECT l.balance_window, matches, coalesce(published, 0) AS published, CASE WHEN coalesce(published, 0) = 0 AND matches >= 50 THEN 'first' WHEN coalesce(published, 0) > 0 AND matches - published >= 40 THEN 'update' ELSE 'wait' END AS decision FROM live l CROSS JOIN cur LEFT JOIN old USING (balance_window) WHERE l.balance_window = '1998' OR (here < 5000 AND l.balance_window = previous)")
def publication_choice(b):
    live = b.matches.groupBy("balance_window").agg(F.count(F.lit(1)).alias("matches"))
    old = live.where("balance_window < '1998'").withColumn("matches", F.col("matches") - 100)
    return wi.publication_choice(live, old, "1998", least_alone=5000, least_new=40, least_first=50)


@query("f10_size_bands", ", n AS (SELECT balance_window, character_id, count(*) AS boards, count(*) FILTER (placement > 6) AS below FROM carries GROUP BY ALL) SELECT *, CASE WHEN boards <= 1 THEN '1' WHEN boards <= 4 THEN '2-4' WHEN boards <= 9 THEN '5-9' WHEN boards <= 29 THEN '10-29' WHEN boards <= 59 THEN '30-59' WHEN boards <= 189 THEN '60-189' ELSE '190+' END AS band, "
       "CASE WHEN below = 0 THEN '0' WHEN below = 1 THEN 'exactly 1' WHEN below / boards <= 0.01 THEN '2+, <= 1%' WHEN below / boards <= 0.05 THEN '2+, (1%, 5%]' WHEN below / boards <= 0.10 THEN '2+, (5%, 10%]' ELSE '2+, > 10%' END AS tail FROM n")
def size_bands(b):
    from boardloom.plans.carries import _carries

    n = _carries(b).groupBy("balance_window", "character_id").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("placement") > 6).alias("below"))
    return n.withColumns({"band": rules.size_band(F.col("boards")), "tail": rules.tail_band(F.col("below"), F.col("boards"))})


@query("f15_json_items", "SELECT match_id, participant_index, unit_index, len(items) AS n, items[1] AS first FROM units")
def json_items(b):
    items = rules.json_items(F.to_json("items"))
    return b.units.select("match_id", "participant_index", "unit_index", F.size(items).alias("n"), F.element_at(items, 1).alias("first"))


_MASK = "18446744073709551615::UHUGEINT"


def _splitmix_sql(x: str) -> str:
    """SplitMix64 of an unsigned value, in steps; each step names the one before once by a list element."""
    step = lambda value, body: f"list_transform([{value}], lambda v: {body})[1]"
    start = step(x, f"(v + 11400714819323198485::UHUGEINT) & {_MASK}")
    first = step(start, f"(xor(v, v >> 30) * 13787848793156543929::UHUGEINT) & {_MASK}")
    second = step(first, f"(xor(v, v >> 27) * 10723151780598845931::UHUGEINT) & {_MASK}")
    return step(second, "xor(v, v >> 31)")


@query("f13_tie_hash", f"SELECT l_orderkey, l_linenumber, CAST({_splitmix_sql('xor(' + _splitmix_sql('xor(' + _splitmix_sql('7::UHUGEINT') + ', l_orderkey::UHUGEINT)') + ', l_linenumber::UHUGEINT)')} AS VARCHAR) AS draw FROM lineitem")
def tie_hash(b):
    """A seeded draw for every unit's two numbers, as an unsigned number in text."""
    rows = b.read("lineitem").select("l_orderkey", "l_linenumber")
    signed = rules.tie_hash(7, F.col("l_orderkey"), F.col("l_linenumber")).cast("decimal(20,0)")
    return rows.withColumn("draw", F.when(signed < 0, signed + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(signed).cast("string"))


@query("f03_accented_names", "SELECT p_partkey, regexp_replace(lower(strip_accents(translate(p_name, 'aeiou', 'àéîõü'))), '[^a-z0-9]', '', 'g') AS key FROM part")
def accented_names(b):
    return b.read("part").select("p_partkey", rules.name_key(F.translate("p_name", "aeiou", "àéîõü")).alias("key"))
