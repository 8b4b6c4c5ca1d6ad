"""Expressions on prompts, token lists and encoded token ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
# Families in match order; the last one is also the fallback.
PROMPT_TEMPLATES = [
    ("llama2", "<s>[INST] <<SYS>>\n{system_prompt}\n<</SYS>>\n\n{user_message} [/INST]"),
    (
        "llama3",
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
        "{system_prompt}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
        "{user_message}<|eot_id|><|start_header_id|>assistant<|end_header_id|>",
    ),
    ("deepseek", "{system_prompt}\n\n{user_message}"),
    ("smollm", "{system_prompt}\n\nHuman: {user_message}\n\nAssistant:"),
]
DEFAULT_SYSTEM_PROMPT = "You are an AI assistant."
# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# --- end of fixed values ----------------------------------------------------------


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def model_family(path: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """First family whose pattern occurs in the lower-case path, else the last family."""
    rules = patterns or [(name, name) for name, _ in PROMPT_TEMPLATES]
    text, case = F.lower(path), F
    for name, pattern in rules:
        case = case.when(text.contains(pattern), F.lit(name))
    return case.otherwise(F.lit(rules[-1][0]))


def fill_template(template: str, **columns: Column) -> Column:
    """Template text with ``{name}`` places filled; the text is never parsed per row."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def render(family: Column, system: Column, user: Column) -> Column:
    case = F
    for name, template in PROMPT_TEMPLATES:
        case = case.when(family == name, fill_template(template, system_prompt=system, user_message=user))
    return strip(case.otherwise(fill_template(PROMPT_TEMPLATES[-1][1], system_prompt=system, user_message=user)))


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def sentence_lines(c: Column) -> Column:
    """Stripped text with a line break after each sentence end."""
    return F.regexp_replace(strip(c), r"([.!?])\s+", "$1\n")


def hex_ids(c: Column) -> Column:
    """Little-endian int32 ids of a hex text; null when the text is malformed."""

    def word(w: Column) -> Column:
        big_endian = F.concat(*[F.substring(w, i, 2) for i in (7, 5, 3, 1)])
        value = F.conv(big_endian, 16, 10).cast("long")
        return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")

    ok = c.rlike("^([0-9a-fA-F]{8})*$")
    return F.when(ok, F.transform(F.regexp_extract_all(c, F.lit("(.{8})"), F.lit(1)), word))


def score_tokens(c: Column) -> Column:
    """Lower-case letter and digit runs, with line breaks kept as their own tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+|\n)"), F.lit(1))
