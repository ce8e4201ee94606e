"""The registry of per-language rule sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.operators.dutch import dutch_rules
from verbarium.schemas import DECODED

# A rule set makes of a title and a template an array of structs with the fields of ``DECODED``:
# as many rows as the template stands for, none for an empty or a null array.
RuleSet = Callable[[Column, Column], Column]

RULES: dict[str, RuleSet] = {"dutch": dutch_rules}


def by_lower_name(rules: Mapping[str, RuleSet]) -> dict[str, RuleSet]:
    """The registry with lower-case names, as sections and dictionary have them."""
    return {name.lower(): rule for name, rule in rules.items()}


def decoded_rows(language: Column, title: Column, template: Column, rules: Mapping[str, RuleSet]) -> Column:
    """What the rule set of the template's language makes of it; null for other languages.

    Languages that share a rule set share its expression, so its size grows with the rule sets
    and not with the languages.
    """
    shared: dict[RuleSet, list[str]] = {}
    for name, rule in by_lower_name(rules).items():
        shared.setdefault(rule, []).append(name)

    def shaped(row: Column) -> Column:
        return F.struct(*[row[f.name].cast(f.dataType).alias(f.name) for f in DECODED.fields])

    chosen = F.when(F.lit(False), F.array().cast(f"array<{DECODED.simpleString()}>"))
    for rule, names in shared.items():
        chosen = chosen.when(language.isin(names), F.transform(rule(title, template), shaped))
    return chosen


def conjugate(templates: DataFrame, rules: Mapping[str, RuleSet] = RULES) -> DataFrame:
    """Apply to each template the rule set of its language; other languages yield nothing.

    All languages are served in one pass over ``templates``.
    """
    rows = decoded_rows(F.col("language"), F.col("title"), F.col("template"), rules)
    return templates.select(*templates.columns, F.inline(rows))
