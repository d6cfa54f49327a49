"""Registered queries: families of boards.

Bound boards are grouped by their set of shapes (``start``), refined once; what describes groups
is computed on that partition, so that SQL can follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.operators import families as fa
from boardloom.operators import group_pages as gp
from boardloom.operators import groups as gr
from boardloom.operators import merge_reports as mr
from boardloom.operators import merging as me
from boardloom.operators import refinement as rf
from boardloom.plans.groups import GROUPS_SQL, KEY, _members, _vectors, _with_profiles
from boardloom.plans.registry import query, rounded
from boardloom.sources.binding import ITEM_SETS, Boards
from boardloom.sources.shared import discard, staged

#: Bound groups are small next to real ones.
BIG = 25


def _start(vectors: DataFrame) -> DataFrame:
    """Boards of three shapes or more, grouped by their set of shapes."""
    sets = vectors.groupBy(*KEY).agg(F.array_sort(F.collect_list("unit")).alias("s"))
    return sets.where(F.size("s") >= 3).select(*KEY, F.array_join("s", "+").alias("group"))


def _units(b: Boards) -> DataFrame:
    rows = b.units.join(b.windows, "match_id")
    return rows.select(*KEY, F.col("shape_id").alias("unit"), "tier", F.col("completed_item_count").alias("held"), F.array_sort("items").alias("items"))


def _boards(b: Boards) -> DataFrame:
    return b.participants.join(b.windows, "match_id").select(*KEY, "placement")


START_SQL = f"""{GROUPS_SQL}, start AS (SELECT balance_window, match_id, participant_index, string_agg(unit, '+' ORDER BY unit) AS grp FROM vectors GROUP BY ALL HAVING count(*) >= 3),
sized AS (SELECT balance_window, grp, count(*) AS boards FROM start GROUP BY ALL),
means AS (SELECT balance_window, grp, unit, sum(weight) / any_value(boards) AS weight, count(*) / any_value(boards) AS presence FROM vectors JOIN start USING (balance_window, match_id, participant_index) JOIN sized USING (balance_window, grp) GROUP BY ALL),
totals AS (SELECT balance_window, grp, sum(weight) AS g FROM means GROUP BY ALL), board_totals AS (SELECT balance_window, match_id, participant_index, sum(weight) AS a FROM vectors GROUP BY ALL),
own AS (SELECT s.balance_window, s.match_id, s.participant_index, s.grp, round(low / (a + g - low), 9) AS similarity FROM (SELECT s.balance_window, s.match_id, s.participant_index, s.grp, sum(least(v.weight, m.weight)) AS low FROM start s JOIN vectors v USING (balance_window, match_id, participant_index) JOIN means m ON m.balance_window = s.balance_window AND m.grp = s.grp AND m.unit = v.unit GROUP BY ALL) s
  JOIN totals USING (balance_window, grp) JOIN board_totals USING (balance_window, match_id, participant_index)),
copies AS (SELECT balance_window, match_id, participant_index, shape_id AS unit, max(struct_pack(h := completed_item_count, t := tier)) AS c FROM units JOIN matches USING (match_id) GROUP BY ALL),
shares AS (SELECT s.balance_window, s.grp, unit, count(*) AS n, count(*) / any_value(boards) AS presence, count(*) FILTER (c.h >= 2) / count(*) AS itemized, count(*) FILTER (c.t >= 3) / count(*) AS three_star FROM copies JOIN start s USING (balance_window, match_id, participant_index) JOIN sized z ON z.balance_window = s.balance_window AND z.grp = s.grp GROUP BY ALL)"""


def _partition(b: Boards) -> tuple[DataFrame, DataFrame]:
    vectors = staged(_vectors(b))
    return vectors, staged(_start(vectors))


@query("c04_candidates", f', {GROUPS_SQL} SELECT v.balance_window, match_id, participant_index, grp AS "group" FROM vectors v JOIN profiles p USING (balance_window, unit) WHERE presence >= 0.3 GROUP BY ALL HAVING count(*) >= 2')
def candidates(b):
    vectors, profiles = _with_profiles(b)
    profiles = staged(profiles)
    return gr.over_kinds([vectors], KEY, ["balance_window"], lambda own: gr.candidates(own, profiles, KEY, within=["balance_window"], group="group")).select(*KEY, "group")


_TRAIT_BLEND = f"""{GROUPS_SQL}, tv AS MATERIALIZED (SELECT balance_window, match_id, participant_index, trait_name AS unit, 1.0 AS weight FROM traits JOIN matches USING (match_id) WHERE tier_current >= 1),
tp AS MATERIALIZED (SELECT balance_window, grp, unit, sum(weight) / any_value(n) AS weight FROM tv JOIN members USING (balance_window, match_id, participant_index) JOIN (SELECT balance_window, grp, count(*) AS n FROM members GROUP BY ALL) USING (balance_window, grp) GROUP BY ALL),
tlow AS MATERIALIZED (SELECT s.balance_window, s.match_id, s.participant_index, s.grp, sum(least(v.weight, p.weight)) AS low FROM scores s JOIN tv v USING (balance_window, match_id, participant_index) JOIN tp p ON p.balance_window = s.balance_window AND p.grp = s.grp AND p.unit = v.unit GROUP BY ALL),
ta AS (SELECT balance_window, match_id, participant_index, sum(weight) AS a FROM tv GROUP BY ALL), tg AS (SELECT balance_window, grp, sum(weight) AS g FROM tp GROUP BY ALL),
blend AS (SELECT s.balance_window, s.match_id, s.participant_index, s.grp, s.similarity, coalesce(CASE WHEN coalesce(ta.a, 0) + coalesce(tg.g, 0) - coalesce(l.low, 0) > 0 THEN round(coalesce(l.low, 0) / (coalesce(ta.a, 0) + coalesce(tg.g, 0) - coalesce(l.low, 0)), 9) END, 0) AS t FROM scores s LEFT JOIN tlow l ON l.balance_window = s.balance_window AND l.match_id = s.match_id AND l.participant_index = s.participant_index AND l.grp = s.grp
  LEFT JOIN ta ON ta.balance_window = s.balance_window AND ta.match_id = s.match_id AND ta.participant_index = s.participant_index LEFT JOIN tg ON tg.balance_window = s.balance_window AND tg.grp = s.grp)"""


@query("c02_trait_blend", f', {_TRAIT_BLEND} SELECT balance_window, match_id, participant_index, grp AS "group", round(round(0.75 * similarity + 0.25 * t, 9), 6) AS similarity FROM blend')
def trait_blend(b):
    """A quarter of the similarity by active traits."""
    held = b.traits.where("tier_current >= 1").join(b.windows, "match_id").select(*KEY, F.col("trait_name").alias("unit"), F.lit(1.0).alias("weight"))
    members = _members(b)
    trait_profiles = gr.mean_profiles(held, members, KEY, ["balance_window", "group"])
    rows = gr.blended(*_with_profiles(b), held, trait_profiles, KEY, within=["balance_window"], group="group")
    return rounded(rows.select(*KEY, "group", "similarity"))


@query("c06_leader_seeding")
def leader_seeding(b):
    """How many boards each leader's group has; groups are numbered in the order in which they start."""
    rows = rf.leader_groups(_vectors(b), least_units=3)
    return rows.groupBy("balance_window", "group").agg(F.count(F.lit(1)).alias("boards"))


_REFINED = f""", {START_SQL}, kept AS (SELECT * FROM sized WHERE boards >= 2), close AS (SELECT v.balance_window, v.match_id, v.participant_index, m.grp FROM vectors v JOIN means m USING (balance_window, unit) JOIN kept k ON k.balance_window = m.balance_window AND k.grp = m.grp WHERE presence >= 0.3 GROUP BY ALL HAVING count(*) >= 2),
lows AS (SELECT c.balance_window, c.match_id, c.participant_index, c.grp, sum(least(v.weight, m.weight)) AS low FROM close c JOIN vectors v USING (balance_window, match_id, participant_index) JOIN means m ON m.balance_window = c.balance_window AND m.grp = c.grp AND m.unit = v.unit GROUP BY ALL),
sims AS (SELECT l.*, round(low / (a + g - low), 9) AS s FROM lows l JOIN totals USING (balance_window, grp) JOIN board_totals USING (balance_window, match_id, participant_index)),
refined AS (SELECT balance_window, match_id, participant_index, grp FROM sims WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY balance_window, match_id, participant_index ORDER BY s DESC, grp) = 1)"""


@query("c07_refine_pass", _REFINED + ' SELECT balance_window, match_id, participant_index, grp AS "group" FROM refined')
def refine_pass(b):
    vectors, start = _partition(b)
    return fa.refine_pass(vectors, start)


@query("c07_moves", _REFINED + ", both_sides AS (SELECT coalesce(s.balance_window, r.balance_window) AS balance_window, s.grp AS o, r.grp AS g FROM start s FULL JOIN refined r USING (balance_window, match_id, participant_index)), lone AS (SELECT balance_window, count(*) AS n FROM both_sides WHERE o IS NULL OR g IS NULL GROUP BY ALL), cells2 AS (SELECT balance_window, g, o, count(*) AS n FROM both_sides WHERE o IS NOT NULL AND g IS NOT NULL GROUP BY ALL), kept2 AS (SELECT balance_window, sum(m) AS m FROM (SELECT balance_window, g, sum(n) - max(n) AS m FROM cells2 GROUP BY ALL) GROUP BY ALL) SELECT balance_window, CAST(coalesce(n, 0) + coalesce(m, 0) AS BIGINT) AS moved FROM kept2 FULL JOIN lone USING (balance_window)")
def moves(b):
    vectors, start = _partition(b)
    return fa.moves(start, fa.refine_pass(vectors, start))


@query("c07_refine")
def refine(b):
    """Every pass of every window until few boards move, a partition comes back or ten passes are made."""
    vectors, start = _partition(b)
    _, log = rf.refine(vectors, fa.stable_ids(start, vectors), least_units=3)
    return log


@query("c07_refined_groups")
def refined_groups(b):
    vectors, start = _partition(b)
    found, _ = rf.refine(vectors, fa.stable_ids(start, vectors), least_units=3)
    return found.groupBy("balance_window", "group").agg(F.count(F.lit(1)).alias("boards"))


@query(
    "c08_stable_ids",
    f", {START_SQL}, firsts AS (SELECT balance_window, grp, min(struct_pack(m := match_id, p := participant_index)) AS f FROM start GROUP BY ALL), common AS (SELECT balance_window, grp, list_sort(list(unit)) AS c FROM means WHERE presence >= 0.5 GROUP BY ALL), ids AS (SELECT balance_window, grp, CAST(row_number() OVER (PARTITION BY balance_window ORDER BY boards DESC, c, f) - 1 AS VARCHAR) AS id FROM sized JOIN firsts USING (balance_window, grp) LEFT JOIN common USING (balance_window, grp)) "
    'SELECT balance_window, match_id, participant_index, id AS "group" FROM start JOIN ids USING (balance_window, grp)',
)
def stable_ids(b):
    vectors, start = _partition(b)
    return fa.stable_ids(start, vectors)


@query("c09_prune_audit")
def prune_audit(b):
    vectors, start = _partition(b)
    return fa.prune_audit(vectors, start)


@query("c19_group_units", f', {START_SQL} SELECT balance_window, grp AS "group", unit, n, round(presence, 6) AS presence, round(itemized, 6) AS itemized, round(three_star, 6) AS three_star FROM shares')
def group_units(b):
    _, start = _partition(b)
    return rounded(fa.group_units(start, _units(b)))


_SUMMARY_SQL = f"""{START_SQL}, results AS (SELECT s.balance_window, grp, count(*) AS boards, avg(placement) AS mean, count(*) FILTER (placement <= 4) AS top4, count(*) FILTER (placement >= 7) AS low, count(*) - count(DISTINCT s.match_id) AS same_lobby FROM start s JOIN participants USING (match_id, participant_index) GROUP BY ALL),
gapped AS (SELECT *, presence - lead(presence) OVER (PARTITION BY balance_window, grp ORDER BY presence DESC, unit) AS gap FROM shares), named AS (SELECT balance_window, grp, coalesce(list_sort(list(unit) FILTER (presence >= 0.75)), []) AS core, arg_max(unit, struct_pack(a := itemized, b := presence, c := unit)) AS "primary", coalesce(max(gap), 0) AS gap FROM gapped GROUP BY ALL),
summaries AS (SELECT * FROM results JOIN named USING (balance_window, grp))"""
_BAND = "CASE WHEN boards <= 1 THEN '1' WHEN boards <= 4 THEN '2-4' WHEN boards <= 9 THEN '5-9' WHEN boards <= 29 THEN '10-29' WHEN boards <= 59 THEN '30-59' WHEN boards <= 189 THEN '60-189' ELSE '190+' END"


def _summaries(b: Boards) -> DataFrame:
    _, start = _partition(b)
    return fa.group_summary(start, _units(b), _boards(b))


@query("c19_group_summary", f', {_SUMMARY_SQL} SELECT balance_window, grp AS "group", boards, round(mean, 6) AS mean, top4, low, same_lobby, array_to_string(core, \'+\') AS core, "primary", round(gap, 6) AS gap, {_BAND} AS band FROM summaries')
def group_summary(b):
    return rounded(_summaries(b).withColumn("core", F.array_join("core", "+")))


@query(
    "c20_group_item_sets",
    f', {START_SQL}, best_copy AS (SELECT balance_window, match_id, participant_index, shape_id AS unit, max(struct_pack(h := completed_item_count, t := tier, i := list_sort(items))) AS c FROM units JOIN matches USING (match_id) GROUP BY ALL), sets AS (SELECT s.balance_window, s.grp, unit, array_to_string(c.i, \'+\') AS item_set, count(*) AS n, count(*) FILTER (placement <= 4) AS top4 FROM best_copy JOIN start s USING (balance_window, match_id, participant_index) JOIN participants USING (match_id, participant_index) GROUP BY ALL) SELECT balance_window, grp AS "group", unit, item_set, n, top4, row_number() OVER (PARTITION BY balance_window, grp, unit ORDER BY n DESC, item_set) AS place FROM sets QUALIFY place <= 5',
)
def group_item_sets(b):
    _, start = _partition(b)
    rows = fa.group_item_sets(start, _units(b), _boards(b))
    return rows.withColumn("place", F.col("place").cast("long"))


_NEAR_SQL = f"""{START_SQL}, pairs AS (SELECT x.balance_window, x.grp, y.grp AS nearest FROM means x JOIN means y USING (balance_window, unit) WHERE x.grp <> y.grp AND y.presence >= 0.3 GROUP BY ALL HAVING count(*) >= 2), pair_low AS (SELECT p.balance_window, p.grp, p.nearest, sum(least(x.weight, y.weight)) AS low FROM pairs p JOIN means x ON x.balance_window = p.balance_window AND x.grp = p.grp JOIN means y ON y.balance_window = p.balance_window AND y.grp = p.nearest AND y.unit = x.unit GROUP BY ALL),
pair_sims AS (SELECT l.balance_window, l.grp, nearest, round(low / (a.g + b.g - low), 9) AS s FROM pair_low l JOIN totals a ON a.balance_window = l.balance_window AND a.grp = l.grp JOIN totals b ON b.balance_window = l.balance_window AND b.grp = l.nearest),
near AS (SELECT t.balance_window, t.grp, coalesce(max(s), 0) AS similarity FROM totals t LEFT JOIN pair_sims USING (balance_window, grp) GROUP BY ALL)"""


@query("c21_nearest_groups", f', {_NEAR_SQL} SELECT balance_window, grp AS "group", round(similarity, 6) + 0.0 AS similarity FROM near')
def nearest_groups(b):
    vectors, start = _partition(b)
    return rounded(fa.nearest_groups(gr.mean_profiles(vectors, start, KEY, ["balance_window", "group"])).select("balance_window", "group", "similarity"))


_METRICS = f", {_NEAR_SQL}, m AS (SELECT balance_window, (SELECT count(*) FROM board_totals t WHERE t.balance_window = o.balance_window) AS boards, count(*) AS grouped, (SELECT count(*) FROM sized z WHERE z.balance_window = o.balance_window) AS groups, (SELECT max(boards) FROM sized z WHERE z.balance_window = o.balance_window) AS largest, round(avg(similarity), 6) AS within, count(*) FILTER (similarity < 0.6) AS below, (SELECT count(*) FROM near n WHERE n.balance_window = o.balance_window AND similarity >= 0.6) AS close_groups FROM own o GROUP BY balance_window)"


@query("c21_global_metrics", _METRICS + " SELECT * FROM m")
def global_metrics(b):
    vectors, start = _partition(b)
    return rounded(fa.global_metrics(vectors, start))


@query("c22_final_diagnostics", f', {START_SQL} SELECT balance_window, grp AS "group", count(*) AS boards, count(*) FILTER (similarity < 0.6) AS below, round(min(similarity), 6) AS weakest, arg_min(match_id, struct_pack(a := similarity, b := match_id, c := participant_index)) AS match_id, arg_min(participant_index, struct_pack(a := similarity, b := match_id, c := participant_index)) AS participant_index FROM own GROUP BY ALL')
def final_diagnostics(b):
    vectors, start = _partition(b)
    return rounded(fa.final_diagnostics(vectors, start))


@query("c23_control_comparison", _METRICS + ", l AS (SELECT balance_window, unnest(['boards', 'grouped', 'groups', 'largest', 'within', 'below', 'close_groups']) AS metric, unnest([boards, grouped, groups, largest, within, below, close_groups]::DOUBLE[]) AS v FROM m), d AS (SELECT balance_window, metric, v FROM l) SELECT balance_window, metric, round(v, 6) AS control, round(2 * v, 6) AS other, round(v, 6) AS change FROM d")
def control_comparison(b):
    """The metrics of the bound partition against doubled ones."""
    vectors, start = _partition(b)
    metrics = staged(rounded(fa.global_metrics(vectors, start)))
    doubled = metrics.select("balance_window", *[(2 * F.col(c)).alias(c) for c in metrics.columns if c != "balance_window"])
    return rounded(fa.control_comparison(metrics, doubled, ["balance_window"]))


_OVERLAP = f"{_SUMMARY_SQL}, pairs2 AS (SELECT x.balance_window, x.grp AS a, y.grp AS b, x.\"primary\" AS pa, y.\"primary\" AS pb, x.boards AS na, y.boards AS nb, len(list_intersect(x.core, y.core)) AS shared, len(list_distinct(x.core || y.core)) AS either FROM summaries x JOIN summaries y ON x.balance_window = y.balance_window AND x.grp < y.grp)"


@query("u03_core_overlap", f", {_OVERLAP} SELECT balance_window, a, b, round(shared / either, 6) AS overlap FROM pairs2 WHERE shared > 0")
def core_overlap(b):
    return rounded(fa.core_pairs(_summaries(b)))


@query("c24_shell_cases", f", {_OVERLAP}, big AS (SELECT *, CASE WHEN either > 0 THEN shared / either ELSE 0 END AS overlap FROM pairs2 WHERE na >= {BIG} AND nb >= {BIG}) SELECT balance_window, 'same unit' AS kind, a, b FROM big WHERE pa = pb AND overlap <= 0.5 UNION ALL SELECT balance_window, 'same shell', a, b FROM big WHERE pa <> pb AND overlap >= 0.6")
def shell_cases(b):
    return fa.shell_cases(_summaries(b), least=BIG)


@query("c25_anchored_groups", f', {_SUMMARY_SQL}, anchors AS (SELECT p_type AS name, [p_type, \'SMALL\'] AS us FROM (SELECT DISTINCT p_type FROM part)) SELECT balance_window, name AS anchor, grp AS "group" FROM summaries JOIN anchors ON len(list_filter(us, lambda u: NOT list_contains(core, u))) = 0')
def anchored_groups(b):
    anchors = b.read("part").select(F.col("p_type").alias("name")).distinct().withColumn("units", F.array("name", F.lit("SMALL")))
    return fa.anchored_groups(_summaries(b), anchors)


_MERGE_SQL = f"""{START_SQL}, cores AS (SELECT balance_window, grp, list_sort(list(unit)) AS core FROM shares WHERE presence >= 0.75 GROUP BY ALL),
mp AS (SELECT x.balance_window, x.grp AS a, y.grp AS b, x.core AS ca, y.core AS cb, len(list_intersect(x.core, y.core)) AS shared, list_filter(x.core, lambda u: NOT list_contains(y.core, u)) AS da, list_filter(y.core, lambda u: NOT list_contains(x.core, u)) AS db FROM cores x JOIN cores y ON x.balance_window = y.balance_window AND x.grp < y.grp),
near_core AS (SELECT *, len(da) AS na, len(db) AS nb FROM mp WHERE shared >= greatest(3, ceil(0.6 * greatest(len(ca), len(cb)))) AND least(len(da), len(db)) <= 1),
odd AS (SELECT balance_window, a, b, unnest(da) AS unit, a AS own_grp, b AS other_grp FROM near_core UNION ALL SELECT balance_window, a, b, unnest(db), b, a FROM near_core),
unexplained AS (SELECT DISTINCT o.balance_window, o.a, o.b FROM odd o JOIN shares i ON i.balance_window = o.balance_window AND i.grp = o.own_grp AND i.unit = o.unit LEFT JOIN shares p ON p.balance_window = o.balance_window AND p.grp = o.other_grp AND p.unit = o.unit WHERE NOT (coalesce(p.presence, 0) >= 0.15 OR i.itemized < 0.5))"""


@query("c11_merge_candidates", f", {_MERGE_SQL} SELECT n.balance_window, n.a, n.b, n.shared, round(n.shared / len(list_distinct(ca || cb)), 6) AS overlap FROM near_core n LEFT JOIN unexplained u ON u.balance_window = n.balance_window AND u.a = n.a AND u.b = n.b WHERE u.a IS NULL OR (n.shared >= 5 AND na + nb = 1)")
def merge_candidates(b):
    _, start = _partition(b)
    rows = fa.merge_candidates(fa.group_units(start, _units(b)))
    return rounded(rows.select("balance_window", "a", "b", F.col("shared").cast("long").alias("shared"), "overlap"))


#: Bound boards have six shapes and are alike; a stricter threshold lets the rules decide something.
RULES = me.MergeRules(tau=0.85, tails="s2")
CONTROL = me.MergeRules(tau=0.85, tails="all")
_RUNS: dict[tuple, object] = {}


def _once(b: Boards, what: str, make):
    """``make()`` once for each application and store: several queries read one run's staged tables."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir, what)
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def _variants(b: Boards) -> tuple[DataFrame, DataFrame]:
    """Boards of three shapes or more, by their shapes and how many of them hold two items; numbered."""

    def make():
        vectors = staged(_vectors(b))
        held = vectors.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("unit", "weight"))).alias("vector"), F.count_if(F.col("weight") >= 2).alias("two"), F.sum("weight").alias("total")).where(F.size("vector") >= 3)
        sets = staged(held.select(*KEY, F.concat_ws("+", "vector.unit", F.col("two").cast("string")).alias("group"), "vector", "total"))
        variants = staged(fa.stable_ids(sets, None))
        discard(sets)
        return vectors, variants

    return _once(b, "variants", make)


def _merged(b: Boards, rules: me.MergeRules = RULES) -> me.MergeRun:
    return _once(b, f"merged {rules.tails}", lambda: me.merge_in_order(*_variants(b), rules=rules))


def _details(b: Boards) -> DataFrame:
    return _once(b, "details", lambda: staged(mr.attempt_details(_merged(b), rules=RULES)))


def _page_units(b: Boards) -> DataFrame:
    return b.units.join(b.windows, "match_id").select(*KEY, "unit_index", F.col("shape_id").alias("unit"), "items", "tier", F.col("completed_item_count").alias("held"), "committed")


_PAGES = f"""{START_SQL}, page AS (SELECT s.*, unit, c, boards FROM (SELECT balance_window, match_id, participant_index, shape_id AS unit, arg_max(struct_pack(items := items, committed := committed, tier := tier, h := completed_item_count), struct_pack(a := completed_item_count, b := tier, c := -unit_index)) AS c FROM units JOIN matches USING (match_id) GROUP BY ALL) JOIN start s USING (balance_window, match_id, participant_index) JOIN sized z ON z.balance_window = s.balance_window AND z.grp = s.grp)"""


def _ranks_sql(x: str, ranks: dict[str, float]) -> str:
    return ", ".join(f"{x}[CAST(least(len({x}) - 1, round_even({p} * (len({x}) - 1), 0)) AS INTEGER) + 1] AS {name}" for name, p in ranks.items())


@query("c19_unit_rows", f", {_PAGES} SELECT balance_window, grp AS \"group\", unit, round(count(*) / any_value(boards), 6) AS presence, " + ", ".join(f"round(count(*) FILTER ({test}) / any_value(boards), 6) AS {name}" for name, test in (("two_items", "c.h >= 2"), ("qualified", "c.committed"), ("defensive", "list_has_any(c.items, ['R_N','R_R','T_2','T_3','T_4','D_3','D_4'])"), ("gloves", "list_contains(c.items, 'T_8')"), ("adaptive", "list_contains(c.items, 'D_5')"))) + ", " + ", ".join(f"round(count(*) FILTER (c.tier = {k}) / count(*), 6) AS stars_{k}" for k in (1, 2, 3)) + " FROM page GROUP BY ALL")
def unit_rows(b):
    return rounded(gp.unit_rows(_partition(b)[1], _page_units(b), ITEM_SETS))


@query("c19_trait_rows", f', {START_SQL} SELECT s.balance_window, s.grp AS "group", trait_name, round(count(*) / any_value(boards), 6) AS share, row_number() OVER (PARTITION BY s.balance_window, s.grp ORDER BY count(*) DESC, trait_name) AS place FROM traits JOIN start s USING (match_id, participant_index) JOIN sized z ON z.balance_window = s.balance_window AND z.grp = s.grp WHERE tier_current >= 1 GROUP BY s.balance_window, s.grp, trait_name QUALIFY place <= 10')
def trait_rows(b):
    held = b.traits.join(b.windows, "match_id")
    return rounded(gp.trait_rows(_partition(b)[1], held).withColumn("place", F.col("place").cast("long")))


@query("c19_group_shape", f", {START_SQL}, per AS (SELECT balance_window, grp, list_sort(list(k)) AS x, avg(k) AS mean FROM (SELECT balance_window, grp, match_id, participant_index, count(*) AS k FROM vectors JOIN start USING (balance_window, match_id, participant_index) GROUP BY ALL) GROUP BY ALL), stepped AS (SELECT *, presence - lead(presence) OVER w AS step, row_number() OVER w AS r FROM means WINDOW w AS (PARTITION BY balance_window, grp ORDER BY presence DESC, unit)), told AS (SELECT balance_window, grp, max(struct_pack(s := step, r := r)) FILTER (step IS NOT NULL) AS g, coalesce(list_sort(list(unit) FILTER (presence >= 0.15 AND presence < 0.75)), []) AS other, count(*) FILTER (presence >= 0.75) AS core FROM stepped GROUP BY ALL), every AS (SELECT balance_window, count(*) AS n FROM board_totals GROUP BY ALL) SELECT balance_window, grp AS \"group\", CAST(len(x) AS BIGINT) AS boards, round(len(x) / n, 6) AS share, " + _ranks_sql("x", {"units_p10": 0.1, "units_median": 0.5, "units_p90": 0.9}) + ", array_to_string(other, '+') AS other_units, round(coalesce(g.s, 0), 6) AS step, coalesce(g.r, 0) AS after_rank, round(core / mean, 6) AS stable_slots FROM per JOIN told USING (balance_window, grp) JOIN every USING (balance_window)")
def group_shape(b):
    vectors, start = _partition(b)
    rows = gp.group_shape(start, vectors)
    return rounded(rows.withColumns({"other_units": F.array_join("other_units", "+"), "after_rank": F.col("after_rank").cast("long")}))


@query("c19_placements", f', {START_SQL} SELECT s.balance_window, grp AS "group", placement, count(*) AS boards FROM start s JOIN participants USING (match_id, participant_index) GROUP BY ALL')
def placements(b):
    return gp.placements(_partition(b)[1], _boards(b))


@query("c20_item_pairs", f", {_PAGES}, owned AS (SELECT p.*, placement, list_sort(list_filter(c.items, lambda i: i <> '' AND i NOT IN ('D_0','D_1','D_2','T_0','T_1'))) AS own FROM page p JOIN participants USING (match_id, participant_index)), two AS (SELECT * FROM owned WHERE len(own) >= 2), population AS (SELECT balance_window, grp, unit, count(*) AS population FROM two GROUP BY ALL), spread AS (SELECT balance_window, grp, unit, placement, c, unnest(list_distinct(flatten(list_transform(range(1, len(own)), lambda a: list_transform(range(a + 1, len(own) + 1), lambda z: own[a] || '+' || own[z]))))) AS pair FROM two) SELECT balance_window, grp AS \"group\", unit, pair, count(*) AS n, round(avg(placement), 6) AS mean, round(avg(CAST(placement <= 4 AS INTEGER)), 6) AS top4, round(avg(CAST(placement = 1 AS INTEGER)), 6) AS wins, round(avg(CAST(c.tier >= 3 AS INTEGER)), 6) AS three_star, round(avg(CAST(c.committed AS INTEGER)), 6) AS qualified, row_number() OVER (PARTITION BY balance_window, grp, unit ORDER BY count(*) DESC, pair) AS place, round(count(*) / any_value(population), 6) AS share, array_to_string(list_filter([CASE WHEN list_contains(string_split(pair, '+'), 'T_8') THEN 'gloves' END, CASE WHEN count(*) < 10 THEN 'small sample' END], lambda f: f IS NOT NULL), '+') AS flags FROM spread JOIN population USING (balance_window, grp, unit) GROUP BY balance_window, grp, unit, pair QUALIFY place <= 5")
def item_pairs(b):
    rows = gp.item_pairs(_partition(b)[1], _page_units(b), _boards(b), ITEM_SETS)
    return rounded(rows.withColumns({"place": F.col("place").cast("long"), "flags": F.array_join("flags", "+")}))


@query("c21_size_bands", f", {START_SQL} SELECT balance_window, {_BAND} AS band, count(*) AS groups, CAST(sum(boards) AS BIGINT) AS boards FROM sized GROUP BY ALL")
def size_bands(b):
    return gp.size_bands(_partition(b)[1])


@query("c21_metric_quantiles", f", {_NEAR_SQL}, measures AS (SELECT balance_window, 'nearest' AS measure, CAST(similarity AS DOUBLE) AS v FROM near UNION ALL SELECT balance_window, 'within', similarity FROM own UNION ALL SELECT balance_window, 'size', boards FROM sized), sorted AS (SELECT balance_window, measure, list_sort(list(v)) AS x FROM measures GROUP BY ALL) SELECT balance_window, measure, CAST(len(x) AS BIGINT) AS n, round(n_min, 6) AS min, round(n_max, 6) AS max, " + ", ".join(f"round({name}, 6) AS {name}" for name in mr.RANKS) + " FROM (SELECT *, x[1] AS n_min, x[len(x)] AS n_max, " + _ranks_sql("x", mr.RANKS) + " FROM sorted)")
def metric_quantiles(b):
    vectors, start = _partition(b)
    return rounded(gp.metric_quantiles(vectors, start))


@query("c25_anchor_changes", f", {_SUMMARY_SQL}, anchors AS (SELECT p_type AS name, [p_type, 'SMALL'] AS us FROM (SELECT DISTINCT p_type FROM part)), met AS (SELECT balance_window, name, boards FROM summaries JOIN anchors ON len(list_filter(us, lambda u: NOT list_contains(core, u))) = 0), x AS (SELECT balance_window, name, count(*) AS base_groups, count(*) FILTER (boards >= {BIG}) AS other_groups FROM met GROUP BY ALL) SELECT balance_window, name AS anchor, base_groups, other_groups, CASE WHEN base_groups = 0 THEN 'gained' WHEN other_groups = 0 THEN 'lost' WHEN base_groups = other_groups THEN 'unchanged' WHEN base_groups < other_groups THEN 'split' ELSE 'joined' END AS change FROM x")
def anchor_changes(b):
    """What becomes of anchors when only large groups are kept."""
    summaries = staged(_summaries(b))
    anchors = b.read("part").select(F.col("p_type").alias("name")).distinct().withColumn("units", F.array("name", F.lit("SMALL")))
    return fa.anchor_changes(fa.anchored_groups(summaries, anchors), fa.anchored_groups(summaries.where(F.col("boards") >= BIG), anchors))


@query("c12_merge_variants")
def merge_variants(b):
    """Greedy merges under the rule for tails; boards and variants of each family."""
    return _merged(b).families.groupBy("balance_window", "group").agg(F.count(F.lit(1)).alias("boards"), F.count_distinct("variant").alias("variants"))


@query("c12_merge_control")
def merge_control(b):
    """The same variants merged only where no board falls below the threshold."""
    return _merged(b, CONTROL).families.groupBy("balance_window", "group").agg(F.count(F.lit(1)).alias("boards"), F.count_distinct("variant").alias("variants"))


#: Every order of ids under every tie rule, "" being none.
STUDY = [(rule, mode, seed) for rule in ("", *me.TIE_RULES) for mode, seed in (("baseline", 0), ("reversed", 0), ("seeded", 1), ("seeded", 2), ("seeded", 3))]
_HOW = ["balance_window", "rule", "mode", "seed"]


def _study(b: Boards) -> me.MergeRun:
    def make():
        vectors, variants = _variants(b)
        runs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(m).alias("mode"), F.lit(s).alias("seed")) for r, m, s in STUDY])
        return me.merge_in_order(vectors, variants, within=_HOW, rules=RULES, tie_rule=F.col("rule"), mode=F.col("mode"), seed=F.col("seed"), orders=runs, keep_posts=False)

    return _once(b, "study", make)


@query("c13_tie_rules")
def tie_rules(b):
    """Merges, refusals and families of each order under each tie rule."""
    run = _study(b)
    groups = run.groups.groupBy(*_HOW).agg(F.count_distinct("group").alias("groups"))
    counts = run.attempts.groupBy(*_HOW).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("accepted", "similarity", "core")])
    return groups.join(counts, _HOW, "left").fillna(0, ["accepted", "similarity", "core"])


@query("c14_merge_attempts")
def merge_attempts(b):
    rows = _details(b)
    return rounded(rows.select(*[F.array_join(c, "+").alias(c) if t == "array<string>" else F.col(c) for c, t in rows.dtypes if c != "round"]))


@query("c15_shadow_rules")
def shadow_rules(b):
    """What other rules would have accepted of the attempts: recovered, lost, dangers, and recoveries in common."""
    return mr.shadow_evaluation(mr.shadow_rules(_details(b), rules=RULES))


@query("c16_merge_histograms")
def merge_histograms(b):
    return mr.merge_histograms(_details(b))


@query("c16_merge_quantiles")
def merge_quantiles(b):
    """Nearest-rank quantiles of the attempts' measures by outcome."""
    return rounded(mr.measure_quantiles(_details(b), ["balance_window", "verdict"]))


@query("c17_merge_trajectory")
def merge_trajectory(b):
    return rounded(mr.merge_trajectory(_details(b)))


@query("c18_tail_lock_in")
def tail_lock_in(b):
    """Each attempt: boards that earlier merges took in below the threshold, and the verdict without them."""
    _, entries = mr.tail_lock_in(_merged(b), rules=RULES)
    return rounded(entries.select(*[F.array_join(c, "+").alias(c) if t == "array<string>" else F.col(c) for c, t in entries.dtypes]))


@query("c18_lock_in_counts")
def lock_in_counts(b):
    return mr.lock_in_counts(*mr.tail_lock_in(_merged(b), rules=RULES))


@query("c22_family_lineage")
def family_lineage(b):
    """Variants merged into each family, its boards below the threshold, and how far its core has drifted."""
    rows = mr.family_lineage(_variants(b)[0], _merged(b).families, rules=RULES)
    return rounded(rows.withColumn("core", F.array_join("core", "+")))


@query("c23_merge_control")
def compared_with_control(b):
    """Metrics of the families against those of the control, in which no board may fall below the threshold."""
    vectors, variants = _variants(b)
    both = F.array(*[F.struct(F.lit(r.tails).alias("tails")) for r in (CONTROL, RULES)])
    families = staged(me.merge_in_order(vectors, variants, within=["balance_window", "tails"], rules=RULES, tails=F.col("tails"), orders=both, keep_posts=False).families)
    metrics = lambda rules: fa.global_metrics(vectors, families.where(F.col("tails") == rules.tails).drop("tails", "variant"), tau=RULES.tau)
    return rounded(fa.control_comparison(staged(metrics(CONTROL)), staged(metrics(RULES)), ["balance_window"]))


@query("c26_stability_study")
def stability_study(b):
    """Each order against the baseline order of the same tie rule, by pairs of boards; boards of a variant stay together."""
    families = _study(b).groups
    base = families.where("mode = 'baseline'").drop("mode", "seed")
    key = ["balance_window", "variant", "rule"]
    replays = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(s).alias("seed")) for _, m, s in STUDY[1:5]])
    base = base.select(*key, "group", "boards", F.inline(replays))
    other = families.where("mode <> 'baseline'").select(*key, "mode", "seed", "group")
    return gr.partition_disagreement(base, other, [*key, "mode", "seed"], within=_HOW, boards="boards")


@query("c27_family_candidate")
def family_candidate(b):
    """Led, refined for up to 20 passes, then merged; one row a window with how it ended."""
    vectors = _variants(b)[0]
    start = rf.leader_groups(vectors, least_units=3)
    return rf.family_candidate(vectors, start, rules=me.MergeRules(tails="s2"), least_units=3)[1]
