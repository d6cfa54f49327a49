"""Registered queries: checks of the store."""

from __future__ import annotations

from boardloom.operators import quality
from boardloom.plans.registry import query


_SETTINGS = '{"floor": 10, "sizes": [3, 4]}'


@query("s22_source_fingerprint", f"SELECT balance_window, count(*) AS matches, max(game_datetime) AS latest, CAST(sum(game_datetime) AS BIGINT) AS time_sum, sha256('{_SETTINGS}') AS version FROM matches GROUP BY ALL")
def source_fingerprint(b):
    return quality.source_fingerprint(b.matches, {"sizes": [3, 4], "floor": 10})


@query("j11_orphan_check", "SELECT match_id, participant_index, 'child' AS missing FROM participants p WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.match_id = p.match_id AND u.participant_index = p.participant_index)")
def orphan_check(b):
    return quality.orphans(b.units, b.participants, ["match_id", "participant_index"])
