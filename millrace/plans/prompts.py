"""Prompts for providers that ask a language model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two prompt texts.
EXTRACT = """Extract templates from the given logs. Keep the constants in the logs unchanged and replace the variables with <*>.
If there are no variable (all contents are constants), the template is same as the log.
Every logs and templates are put between tags <START> and <END>.
For example:
{examples}
Based on the above examples and templates, please extract templates from the logs.
Just extract templates from logs. Never output other informations.
Log:
<START>{log}<END>
Template:
"""
MERGE = """Determine whether the two given logs belong to the same template. 
If any of the differences between them is a constant, then answer 'No'. 
If all the differences between them are variables, then answer 'Yes'. 
Each log is placed between the tags <START> and <END>.
For example:
{examples}

Based on the above examples, do you think the following two logs belong to the same template? 
Please provide your response in "Answer" (choose between "Yes" and "No"). Do not output any other information. 
Log 1: <START>{log1}<END>
Log 2: <START>{log2}<END>
Answer:
"""
EXTRACT_EXAMPLE = "Log:\n<START>{content}<END>\nTemplate:\n<START>{template}<END>\n\n"
MERGE_EXAMPLE = "Log 1:\n<START>{content}<END>\nLog 2:\n<START>{other}<END>\nAnswer:<START>{answer}<END>\n\n"


def filled(text: str, **values: Column) -> Column:
    """A text with its ``{name}`` places filled by columns."""
    parts, rest = [], text
    while (at := min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)) >= 0:
        name = next(n for n in values if rest.startswith("{" + n + "}", at))
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def extract_prompt(message: Column, examples: Column) -> Column:
    """``examples``: an array of structs with content and template, the best last."""
    shown = F.transform(examples, lambda e: filled(EXTRACT_EXAMPLE, content=e["content"], template=e["template"]))
    return filled(EXTRACT, examples=F.array_join(shown, ""), log=message)


def merge_prompt(message: Column, other: Column, examples: Column) -> Column:
    """``examples``: an array of structs with content, positive and negative; each gives a yes and a no."""
    shown = F.transform(
        examples,
        lambda e: F.concat(
            filled(MERGE_EXAMPLE, content=e["content"], other=e["positive"], answer=F.lit("Yes")),
            filled(MERGE_EXAMPLE, content=e["content"], other=e["negative"], answer=F.lit("No")),
        ),
    )
    return filled(MERGE, examples=F.array_join(shown, ""), log1=message, log2=other)


def fill(text: str, **values: str) -> str:
    """A text with its ``{name}`` places filled, all at once."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), text)


def extract_text(message: str, examples: list[dict]) -> str:
    """``extract_prompt`` for one message; examples have content and template."""
    shown = "".join(fill(EXTRACT_EXAMPLE, content=e["content"], template=e["template"]) for e in examples)
    return fill(EXTRACT, examples=shown, log=message)


def merge_text(message: str, other: str, examples: list[dict]) -> str:
    """``merge_prompt`` for one pair; of an example's positive and negative those that there are."""
    shown = "".join(
        fill(MERGE_EXAMPLE, content=e["content"], other=e[side], answer=answer)
        for e in examples
        for side, answer in (("positive", "Yes"), ("negative", "No"))
        if e.get(side)
    )
    return fill(MERGE, examples=shown, log1=message, log2=other)
