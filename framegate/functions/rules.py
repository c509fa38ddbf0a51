"""Rules as data, compiled to Column predicates.

A rule is a mapping in the manifest's own key format: ``current_source``, ``candidate_source_group``,
``candidate_pools``, ``current_required_flags``, ``min_current_<name>``, ``max_candidate_<name>``,
``selection_key``, ``selection_direction``. Rules are configuration, so their number is small and fixed;
compiling them keeps the check inside generated code and needs no rule join at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from framegate.functions.keys import candidate_source_group, source_matches

Rule = dict[str, object]


@dataclass(frozen=True)
class Item:
    """A winner or candidate held in a struct column.

    It has a ``features`` map and a ``flags`` array; ``extra`` is an optional map of values noted on the way.
    """

    name: str
    fields: frozenset[str]

    def __getitem__(self, field: str) -> Column:
        return F.col(f"{self.name}.{field}")

    def number(self, key: str) -> Column:
        """The item's own value, else a noted one, else the feature of that name."""
        places = [self["features"].getItem(key)]
        if "extra" in self.fields:
            places.insert(0, self["extra"].getItem(key))
        if key in self.fields:
            places.insert(0, self[key].cast("double"))
        return F.coalesce(*places)

    def has_flag(self, flag: str) -> Column:
        if not flag:
            return F.lit(True)
        return F.coalesce(F.array_contains(self["flags"], flag.removeprefix("selected_via_")), F.lit(False))


def all_of(checks: Sequence[Column]) -> Column:
    result = F.lit(True)
    for check in checks:
        result = result & F.coalesce(check, F.lit(False))
    return result


def any_of(checks: Sequence[Column]) -> Column:
    result = F.lit(False)
    for check in checks:
        result = result | F.coalesce(check, F.lit(False))
    return result


def in_band(value: Column, low: float | None, high: float | None) -> Column:
    """Score band of a stage: ``low <= value < high``."""
    checks = ([] if low is None else [value >= low]) + ([] if high is None else [value < high])
    return all_of(checks)


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Rule threshold: ``low <= value <= high``; a missing value never matches."""
    checks = ([] if low is None else [value >= low]) + ([] if high is None else [value <= high])
    return all_of(checks)


def thresholds(item: Item, rule: Rule, prefix: str = "") -> Column:
    """Every ``min_<prefix><name>`` and ``max_<prefix><name>`` of the rule; null thresholds are ignored."""
    checks = []
    for key, limit in rule.items():
        if limit is None:
            continue
        for bound in ("min_", "max_"):
            start = bound + prefix
            if key.startswith(start):
                value = item.number(key[len(start):])
                checks.append(value >= float(limit) if bound == "min_" else value <= float(limit))
    return all_of(checks)


def flags_present(item: Item, required: object) -> Column:
    wanted = required if isinstance(required, (list, tuple)) else [required] if required else []
    return all_of([item.has_flag(str(flag)) for flag in wanted])


def pool_matches(item: Item, expected: object) -> Column:
    if expected is None:
        return F.lit(True)
    pools = [expected] if isinstance(expected, str) else [str(p) for p in expected]
    return F.coalesce(item["selector_pool"].isin(*pools), F.lit(False))


def _pick(rule: Rule, *keys: str) -> object:
    return next((rule[k] for k in keys if rule.get(k) is not None), None)


def current_side(current: Item, rule: Rule) -> Column:
    """The part of a rule that looks at the current winner."""
    exact, group = rule.get("current_source"), rule.get("current_source_group")
    checks = [current["candidate_source"].isNotNull()]
    if exact is not None or group is not None:
        checks.append(source_matches(current["candidate_source"], exact, group))
    checks.append(flags_present(current, _pick(rule, "current_required_flags", "current_required_flag")))
    checks.append(thresholds(current, rule, "current_"))
    return all_of(checks)


def candidate_side(candidate: Item, rule: Rule, source_required: bool = True) -> Column:
    """The part of a rule that looks at a candidate."""
    exact, group = rule.get("candidate_source"), rule.get("candidate_source_group")
    checks = [candidate["candidate_source"].isNotNull()]
    if source_required or exact is not None or group is not None:
        checks.append(source_matches(candidate["candidate_source"], exact, group))
    checks.append(pool_matches(candidate, _pick(rule, "candidate_pools", "candidate_pool")))
    checks.append(thresholds(candidate, rule, "candidate_"))
    return all_of(checks)


def different_item(current: Item, candidate: Item) -> Column:
    return ~(
        candidate["candidate_id"].eqNullSafe(current["candidate_id"])
        & candidate["selector_pool"].eqNullSafe(current["selector_pool"])
    )


def first_matching(predicates: Sequence[Column]) -> Column:
    """1-based number of the first true predicate, null when none is."""
    number = F.lit(None).cast("int")
    for i, predicate in reversed(list(enumerate(predicates, 1))):
        number = F.when(F.coalesce(predicate, F.lit(False)), F.lit(i)).otherwise(number)
    return number


def by_number(number: Column, values: Sequence[Column]) -> Column:
    """The value that belongs to a rule number."""
    picked = F.lit(None)
    for i, value in reversed(list(enumerate(values, 1))):
        picked = F.when(number == i, value).otherwise(picked)
    return picked


def selection_order(candidate: Item, rule: Rule) -> Column:
    """Larger is better: the selection value, negated when the rule wants the smallest."""
    value = candidate.number(str(rule.get("selection_key", "score")))
    signed = -value if rule.get("selection_direction") == "min" else value
    return F.coalesce(signed, F.lit(float("-inf")))


def exempted(item: Item, exemptions: Sequence[Rule]) -> Column:
    """True when any exemption's source, flags and thresholds all hold."""
    hits = []
    for rule in exemptions:
        exact, group = _pick(rule, "source", "current_source"), _pick(rule, "source_group", "current_source_group")
        checks = [thresholds(item, rule)]
        if exact is not None or group is not None:
            checks.append(source_matches(item["candidate_source"], exact, group))
        checks.append(
            flags_present(item, _pick(rule, "required_flags", "current_required_flags", "current_required_flag"))
        )
        hits.append(all_of(checks))
    return any_of(hits)


def by_source(item: Item, table: dict[str, object]) -> Column:
    """Per-source value: the exact source first, then its folded group; null when neither is listed."""
    source = item["candidate_source"]
    group = candidate_source_group(source)
    value = F.lit(None)
    for name, limit in table.items():
        value = F.when(group == name, F.lit(limit)).otherwise(value)
    for name, limit in table.items():
        value = F.when(source == name, F.lit(limit)).otherwise(value)
    return value
