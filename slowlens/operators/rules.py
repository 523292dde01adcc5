"""Rules as data: what a rule set finds on a row is one expression.

A rule names a condition and the fields of its finding; each is a constant or a
function of the row, a struct that holds what all rules of a set look at and
that is computed once.  A rule with ``each`` looks at the elements of an array
of that struct.  ``findings`` compiles a set into one array column, so a set
costs one projection, and a rule of one's own is one more entry in its list.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: A constant, or what follows from a row (or element) given as a struct.
Value = Callable[[Column], Column] | Column | str | int | float | None


@dataclass(frozen=True)
class Rule:
    """A finding ``(rule_no, severity, type, *fields)`` wherever ``when`` holds."""

    no: int
    type: str
    when: Callable[[Column], Column]
    severity: Value
    fields: Mapping[str, Value] = field(default_factory=dict)
    each: str | None = None


@dataclass(frozen=True)
class Findings:
    """The fields of a set's findings and their types, after number, severity and type."""

    fields: Mapping[str, str]

    @property
    def element(self) -> str:
        own = "".join(f",{name}:{kind}" for name, kind in self.fields.items())
        return f"struct<rule_no:bigint,severity:string,type:string{own}>"

    def of(self, rule: Rule, row: Column) -> Column:
        """The finding of a rule on a row, null where it does not apply."""
        unknown = set(rule.fields) - set(self.fields)
        if unknown:
            raise ValueError(f"rule {rule.no} has fields that its set does not know: {sorted(unknown)}")

        def value(v: Value) -> Column:
            found = v(row) if callable(v) and not isinstance(v, Column) else v
            return found if isinstance(found, Column) else F.lit(found)

        parts = [
            F.lit(rule.no).cast("bigint").alias("rule_no"),
            value(rule.severity).cast("string").alias("severity"),
            F.lit(rule.type).alias("type"),
            *[value(rule.fields.get(name)).cast(kind).alias(name) for name, kind in self.fields.items()],
        ]
        return F.when(rule.when(row), F.struct(*parts))

    def findings(self, rules: Sequence[Rule | Sequence[Rule]], row: Column) -> Column:
        """All findings of a row: in the order of the rules, within a rule in that of the elements.

        Rules listed together as one entry look at an element one after the other.
        """
        parts = [self._entry([entry] if isinstance(entry, Rule) else list(entry), row) for entry in rules]
        none = F.array().cast(f"array<{self.element}>")
        return F.concat(*parts) if parts else none

    def _entry(self, rules: Sequence[Rule], row: Column) -> Column:
        sources = {rule.each for rule in rules}
        if len(sources) > 1:
            raise ValueError("rules of one entry look at the same array")

        none = F.array().cast(f"array<{self.element}>")

        def found(x: Column) -> Column:
            each = [F.when(rule.when(x), F.array(self.of(rule, x))).otherwise(none) for rule in rules]
            return each[0] if len(each) == 1 else F.concat(*each)

        source = sources.pop()
        if source is None:
            return found(row)
        # most elements have no finding
        hits = F.filter(row[source], lambda x: reduce(Column.__or__, [rule.when(x) for rule in rules]))
        if len(rules) > 1:
            return F.flatten(F.transform(hits, found))
        return F.transform(hits, lambda x: self.of(rules[0], x))


def rows_of_relations(
    rules: Sequence[tuple[str, Rule]], relations: Mapping[str, Callable[[], DataFrame]], shape: Findings, keys: Sequence[str]
) -> DataFrame:
    """Findings as rows: rules on one relation are evaluated in one pass over it."""
    frames = []
    for name in dict.fromkeys(relation for relation, _ in rules):
        frame = relations[name]()
        row = F.struct(*frame.columns)
        found = shape.findings([rule for relation, rule in rules if relation == name], row)
        frames.append(frame.select(*keys, F.inline(found)))
    return reduce(DataFrame.unionByName, frames)
