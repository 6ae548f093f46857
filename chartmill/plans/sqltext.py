"""Text helpers for the check queries (CASE chains from the fixed values)."""

from __future__ import annotations

import re
from decimal import Decimal

from chartmill.functions import fixed


def q(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def case_contains(expr: str, rules, default) -> str:
    """CASE: first rule with a contained word; ``default`` is SQL text."""
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({expr}, {q(w)})' for w in words)} THEN {q(value)}" for value, words in rules
    )
    return f"CASE {whens} ELSE {default} END"


def case_map(expr: str, table: dict, default="NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def words(expr: str, keywords) -> str:
    """Whole-word test with optional plural s."""
    pattern = r"\b(?:" + "|".join(re.sub(r"([.+?()])", r"\\\1", k) for k in keywords) + r")s?\b"
    return f"coalesce(regexp_matches(lower({expr}), {q(pattern)}), false)"


def date_tries(expr: str) -> str:
    formats = [
        "%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y",
        "%Y/%m/%d", "%m/%d/%y", "%d/%m/%y",
    ]
    tries = []
    for f in formats:
        text = f"trim({expr})"
        if f.startswith("%Y") or f.endswith("%Y"):  # this parser also takes short years for %Y
            side = "^" if f.startswith("%Y") else ""
            text = f"CASE WHEN regexp_matches({text}, '{side}\\d{{4}}{'' if side else '$'}') THEN {text} END"
        tries.append(f"try_strptime({text}, '{f}')")
    return "coalesce(" + ", ".join(tries) + ")::DATE::STRING"


def price_rows() -> str:
    def per_token(price):
        return f"'{Decimal(price) / 1000}'::DECIMAL(12,9)"

    tokens = ", ".join(f"('{p}', '{m}', {per_token(i)}, {per_token(o)})" for (p, m), (i, o) in fixed.TOKEN_PRICES.items())
    pages = ", ".join(f"('aws_textract', '{m}', '{p}'::DECIMAL(12,9), 0)" for m, p in fixed.PAGE_PRICES.items())
    return f"(VALUES {tokens}, {pages}) AS price(provider, model, price_in, price_out)"


COST = "CAST(coalesce(price_in * input_tokens + price_out * output_tokens, 0) AS DECIMAL(20,9))"
PRICED = f"""priced AS (
    SELECT u.*, {COST} AS cost
    FROM usage_log u LEFT JOIN {price_rows()}
      ON price.provider = lower(u.provider) AND price.model = lower(u.model))"""


def pct(part: str, whole: str, digits: int = 1) -> str:
    return (
        f"CASE WHEN {whole} = 0 THEN 0.0 ELSE CAST(round(CAST(CAST({part} AS DOUBLE) * 100 / {whole} "
        f"AS DECIMAL(28,8)), {digits}) AS DOUBLE) END"
    )


def half(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"
