"""The parts of a composed prompt, each a Column; a part whose input is empty is empty.

No part tells a threshold: who measures must not know what passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _unless_empty(items: Column, text: Column) -> Column:
    return F.when(F.size(items) > 0, text).otherwise(F.lit(""))


def role(task: Column, subject: Column) -> Column:
    return _text("You do one task, ", task, ", for one target: ", subject, ".")


def output_reply(language: str = "json") -> Column:
    return F.lit(f"Answer with one fenced {language} block and nothing around it. Write no files.")


def output_file(path: Column, receipt: str = "the number of records written") -> Column:
    return _text("Write the result to ", path, f" and answer with one line: {receipt}.")


def schema(block: Column, language: str = "yaml") -> Column:
    return _text(f"## Schema\n\n```{language}\n", block, "\n```")


def census(described: Column, criterion: Column) -> Column:
    return _text("List every one of the ", described, " where ", criterion, "; a sample is not enough.")


def self_report(source: Column) -> Column:
    return _text("Begin with the line `# verification: N of M items from ", source, ". Excluded: names or none.`")


def grounding(verb: str = "fetch") -> Column:
    return F.lit(f"State only what you saw in a source that you did {verb}, and name the source.")


def blocked(places: Column) -> Column:
    return _unless_empty(places, _text("Do not use:\n", _bullets(places)))


def anti_list(items: Column) -> Column:
    return _unless_empty(items, _text("These are already known and do not count:\n", _bullets(items)))


def field_rules(rules: Column) -> Column:
    """``rules``: array of struct(field, rule)."""
    return _unless_empty(rules, _text("Fields:\n", F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r["field"], F.lit(": "), r["rule"])), "\n")))


def verdict_guide(vocabulary: str) -> Column:
    """Only the values that an agent may report."""
    return F.lit("Allowed verdicts:\n" + "\n".join(f"- {v}" for v in K.offered(vocabulary)))


def scalar_request(item: Column) -> Column:
    return _text("Count the items that the source of ", item, " lists. Report the count and a status; judge nothing.")


def refute(claim: Column) -> Column:
    return _text("Try to refute: ", claim)


def process(steps: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return _unless_empty(steps, F.array_join(numbered, "\n"))


def restatement(output: Column) -> Column:
    """The first line of the output rule once more, to end with."""
    return _text("Remember: ", F.element_at(F.split(output, "\n"), 1))
