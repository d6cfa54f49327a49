"""Row rules as Column expressions: items, commitment, levels, versions, labels."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ItemSets:
    """Item ids by what they say about a unit; in production read from the item dimension."""

    components: tuple[str, ...]
    no_evidence: tuple[str, ...]
    adaptive: tuple[str, ...]
    corroborating: tuple[str, ...]
    gloves: tuple[str, ...]


def _held(items: Column, ids: tuple[str, ...]) -> Column:
    return F.arrays_overlap(items, F.array(*map(F.lit, ids))) if ids else F.lit(False)


def completed_items(items: Column, sets: ItemSets) -> Column:
    """Number of non-empty items that are no components; unknown ids count."""
    return F.size(F.filter(items, lambda x: (x != "") & ~x.isin(*sets.components)))


def completed_list(items: Column, sets: ItemSets) -> Column:
    """Sorted completed items that the unit equips: a gloves holder equips just the gloves."""
    full = F.filter(items, lambda x: (x != "") & ~x.isin(*sets.components))
    gloves = F.filter(items, lambda x: x.isin(*sets.gloves))
    return F.array_sort(F.when(_held(items, sets.gloves), gloves).otherwise(full))


def generated_items(items: Column, sets: ItemSets) -> Column:
    """Items the game generated for a gloves holder; empty for anyone else."""
    return F.when(_held(items, sets.gloves), F.filter(items, lambda x: ~x.isin(*sets.gloves) & (x != ""))).otherwise(F.array().cast("array<string>"))


def is_commitment(items: Column, sets: ItemSets, least: int = 2) -> Column:
    """At least ``least`` completed items, no gloves, and carry evidence among the items."""
    done = completed_items(items, sets)
    mute = F.size(F.filter(items, lambda x: x.isin(*sets.no_evidence)))
    evidence = F.when(_held(items, sets.adaptive), _held(items, sets.corroborating)).otherwise(done > mute)
    return (done >= least) & ~_held(items, sets.gloves) & evidence


def unit_cost(known: Column, rarity: Column) -> Column:
    """The dimension's cost, else rarity + 1 for rarities 0-4, else null."""
    return F.coalesce(known, F.when(rarity.between(0, 4), rarity + 1))


def valid_level(level: Column) -> Column:
    """Levels 1-10; 0, null and anything else are unknown."""
    return F.coalesce(level.between(1, 10), F.lit(False))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def shrink(successes: Column, attempts: Column, prior: Column, strength: float) -> Column:
    return (successes + prior * strength) / (attempts + strength)


def client_patch(version: Column) -> Column:
    """``Version X.Y...`` to ``X.Y``; other text stays, empty text is null."""
    found = F.regexp_extract(version, "Version\\s+(\\d+\\.\\d+)", 1)
    return F.when(F.coalesce(version, F.lit("")) == "", None).when(found == "", version).otherwise(found)


def is_masked(version: Column) -> Column:
    """Whether a version text hides its numbers behind question marks."""
    return version.contains("?.?.?.?") & (F.regexp_extract(version, "Version\\s+(\\d+\\.\\d+)", 1) == "")


def window_suffix(patch: Column, at: Column, cutoffs: Column) -> Column:
    """Patch plus a, b, c... by the number of cutoffs passed; the bare patch without cutoffs."""
    passed = F.size(F.filter(cutoffs, lambda c: at >= c))
    return F.when(cutoffs.isNull() | at.isNull() | (F.size(cutoffs) == 0), patch).otherwise(F.concat(patch, F.char(97 + passed)))


def patch_order(patch: Column) -> Column:
    """(major, minor, suffix); text that is no patch sorts first."""
    part = lambda i: F.regexp_extract(patch, "^(\\d+)\\.(\\d+)([a-z]*)$", i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int")).otherwise(-1)
    return F.struct(number(1).alias("major"), number(2).alias("minor"), part(3).alias("suffix"))


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: to one character, and to several."""
    one, several = {}, {}
    for point in range(0x80, 0x10000):
        c = chr(point)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()
        plain = "".join(x for x in plain if x.isalnum())
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            several[c] = plain
    return one, several


_ONE, _SEVERAL = _decompositions()


def name_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only, after compatibility decomposition; null is empty."""
    # few texts hold a character that stands for several letters
    folds = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    long = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(folds[c], c)), "")
    text = F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), long).otherwise(text)
    plain = F.lower(F.translate(text, "".join(_ONE), "".join(_ONE.values())))
    return F.coalesce(F.regexp_replace(plain, "[^a-z0-9]", ""), F.lit(""))


#: fixed format: set and item prefixes, form suffixes and trailing digits of raw ids
ID_NOISE = "^(?:TFT\\d*_Item_|TFT\\d*_|DA_\\d*_?)|(?:_(?:AD|AP|Base))$|\\d+$"


def id_key(identifier: Column) -> Column:
    """:func:`name_key` of an id without its noise, which may stand in three layers."""
    for _ in range(3):
        identifier = F.regexp_replace(identifier, ID_NOISE, "")
    return name_key(identifier)


#: fixed formats: marks in item ids, leading parts of ids, and words that names write small
ARTIFACT_PART, RADIANT_END, EMBLEM_MARK, ITEM_PART = "Artifact", "Radiant", "Emblem", "Item"
SET_PART, NUMBER_PART = "^(DA|TFT[0-9]*)$", "^[0-9]+$"
SMALL_WORDS = ["A", "An", "And", "In", "Of", "The", "To"]


def item_kind(item: Column, component: Column, known: Column) -> Column:
    """artifact, radiant, emblem, component, standard or unknown, by the id's parts and the dimension."""
    parts = F.split(item, "_")
    named = F.when(F.array_contains(parts, ARTIFACT_PART), "artifact").when(item.endswith(RADIANT_END), "radiant").when(item.contains(EMBLEM_MARK), "emblem")
    return named.when(F.coalesce(component, F.lit(False)), "component").when(F.coalesce(known, F.lit(False)), "standard").otherwise("unknown")


NORMAL_KINDS = ("standard", "emblem")


def is_normal_build(kinds: Column) -> Column:
    """Every item of a row is of a kind that a player can craft."""
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: k.isin(*NORMAL_KINDS))


#: a word inside a part: capitals before a capitalised word, or letters up to the next capital
WORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]*[^A-Z]+|[A-Z]+"


def readable_id(identifier: Column) -> Column:
    """Words of an id: its leading set, item and number parts and its marks left out, small words in lower case.

    An id is a list of parts; one that would leave no word is shown as it is.
    """
    parts = F.split(identifier, "_")
    last = F.size(parts) - 1
    at = lambda i, test: F.coalesce((i < last) & test(F.get(parts, i)), F.lit(False)).cast("int")
    of_set = at(F.lit(0), lambda p: p.rlike(SET_PART))
    of_item = of_set + of_set * at(of_set, lambda p: p == ITEM_PART)
    start = of_item + of_set * at(of_item, lambda p: p.rlike(NUMBER_PART))
    own = F.filter(parts, lambda p, i: (i >= start) & ((p != ARTIFACT_PART) | (i == last)))
    plain = F.transform(own, lambda p: F.regexp_replace(p, f"{RADIANT_END}$", ""))
    plain = F.when(F.size(own) > 0, F.concat(F.slice(own, 1, F.size(own) - 1), F.slice(plain, F.size(own), 1))).otherwise(own)
    words = F.filter(F.flatten(F.transform(plain, lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), F.lower(w)).otherwise(w)), " ")
    return F.when(shown == "", identifier).otherwise(shown)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plus(x: Column, constant: int) -> Column:
    """The sum modulo 2**64, by halves, since a plain sum of longs may not overflow."""
    low = F.expr("4294967295L")
    carry = x.bitwiseAND(low) + F.lit(constant & 0xFFFFFFFF)
    return _let(carry, lambda c: F.shiftleft(F.shiftrightunsigned(x, 32) + F.lit(constant >> 32) + F.shiftrightunsigned(c, 32), 32).bitwiseOR(c.bitwiseAND(low)))


def _times(x: Column, constant: int) -> Column:
    """The product modulo 2**64, by 16-bit limbs: no partial sum leaves 35 bits."""
    limb = F.lit(0xFFFF).cast("long")
    parts = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(limb) for i in range(4)]
    factors = [constant >> 16 * i & 0xFFFF for i in range(4)]
    rows = []
    for place in range(4):
        row = parts[0] * F.lit(factors[place]).cast("long")
        for i in range(1, place + 1):
            row = row + parts[i] * F.lit(factors[place - i]).cast("long")
        rows.append(row)
    carried = lambda row, below: row + F.shiftrightunsigned(below, 16)
    put = lambda value, place: F.shiftleft(value.bitwiseAND(limb), 16 * place)
    top = lambda a, b, c: put(a, 0).bitwiseOR(put(b, 1)).bitwiseOR(put(c, 2)).bitwiseOR(put(carried(rows[3], c), 3))
    return _let(rows[0], lambda a: _let(carried(rows[1], a), lambda b: _let(carried(rows[2], b), lambda c: top(a, b, c))))


#: fixed values: the constants and shifts of the public SplitMix64 generator
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(x: Column) -> Column:
    """SplitMix64 of a long; both are read as 64 unsigned bits."""
    folded = lambda v, by: v.bitwiseXOR(F.shiftrightunsigned(v, by))
    start = _let(x, lambda v: _plus(v, _STEP))
    first = _let(_let(start, lambda v: folded(v, 30)), lambda v: _times(v, _FIRST))
    second = _let(_let(first, lambda v: folded(v, 27)), lambda v: _times(v, _SECOND))
    return _let(second, lambda v: folded(v, 31))


def tie_hash(seed: int | Column, *keys: Column) -> Column:
    """A seeded order for ties: SplitMix64 chained over whole numbers, as 64 bits in a long."""
    start = (F.lit(seed) if isinstance(seed, int) else seed).cast("long")
    return F.aggregate(F.array(*[k.cast("long") for k in keys]), splitmix64(start), lambda h, key: splitmix64(h.bitwiseXOR(key)))


def unsigned_order(x: Column) -> Column:
    """A long that sorts as ``x`` does when its bits are read without a sign."""
    return x.bitwiseXOR(F.expr("-9223372036854775807L - 1L"))


def idea_signature(*parts: tuple[str, Column]) -> Column:
    """``name=a,b;...`` of sorted distinct keys; empty parts are left out."""
    shown = [F.when(F.size(keys) > 0, F.concat(F.lit(f"{name}="), F.array_join(F.array_sort(F.array_distinct(keys)), ","))) for name, keys in parts]
    return F.concat_ws(";", *shown)


def json_items(text: Column) -> Column:
    """A JSON text list as an array; null or unreadable text is an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def banded(value: Column, edges: list[tuple[str, float]], last: str) -> Column:
    """The label of the first edge that ``value`` does not exceed, else ``last``."""
    out = F.lit(last)
    for label, edge in reversed(edges):
        out = F.when(value <= edge, label).otherwise(out)
    return out


#: fixed values: size bands of groups
SIZE_EDGES = [("1", 1), ("2-4", 4), ("5-9", 9), ("10-29", 29), ("30-59", 59), ("60-189", 189)]


def size_band(n: Column) -> Column:
    return banded(n, SIZE_EDGES, "190+")


#: fixed values: labels of how many boards lie below a threshold
TAIL_NONE, TAIL_ONE, TAIL_MOST = "0", "exactly 1", "2+, > 10%"
TAIL_EDGES = [("2+, <= 1%", 0.01), ("2+, (1%, 5%]", 0.05), ("2+, (5%, 10%]", 0.10)]


def tail_band(below: Column, n: Column) -> Column:
    """How many boards of ``n`` lie below the threshold: none, one, or a share."""
    return F.when(below == 0, TAIL_NONE).when(below == 1, TAIL_ONE).otherwise(banded(below / n, TAIL_EDGES, TAIL_MOST))


def is_supported(games: Column, without: Column, top4: Column, top4_without: Column, delta: Column, least: int = 10) -> Column:
    """Both sides sampled, a positive adjusted difference and a higher raw rate."""
    return ~is_limited(games, without, least) & (without > 0) & (F.coalesce(delta, F.lit(0.0)) > 0) & (top4 > F.coalesce(top4_without, F.lit(0.0)))


def is_limited(games: Column, without: Column, least: int = 10) -> Column:
    """Whether the smaller side has fewer than ``least`` boards; a missing side does not count."""
    return F.when(without > 0, F.least(games, without)).otherwise(games) < least


def trait_count_key(trait: Column, count: Column) -> Column:
    return F.concat(trait, F.lit(":"), count.cast("string"))


def split_trait_count_key(key: Column) -> tuple[Column, Column]:
    pattern = "^(.*):(-?\\d+)$"
    return F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2).cast("int")


def evidence_band(games: Column) -> Column:
    """A from 60 boards, B from 30, C from 10, else D."""
    return F.when(games >= 60, "A").when(games >= 30, "B").when(games >= 10, "C").otherwise("D")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, clamped to 0..1; null for no boards."""
    p, zz = successes / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = clamp(middle - half), clamp(middle + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def package_label(key: Column, names: Column) -> Column:
    """Names of a ``+``-joined key through a map; unknown ids stay."""
    return F.array_join(F.transform(F.split(key, "\\+"), lambda k: F.coalesce(names[k], k)), " + ")
