"""Compact text forms of small results."""

from __future__ import annotations

import json


def _cell(value: object) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)
    return json.dumps(text, ensure_ascii=False) if any(c in text for c in ',"\n') else text


def tabular(rows: list[dict]) -> str:
    """Rows of the same keys as a header and one line each; JSON where that isn't shorter."""
    plain = json.dumps(rows, ensure_ascii=False, separators=(",", ":"), default=str)
    if not rows or any(r.keys() != rows[0].keys() for r in rows):
        return plain
    head = f"[{len(rows)}]{{{','.join(rows[0])}}}:"
    made = "\n".join([head, *("  " + ",".join(_cell(v) for v in r.values()) for r in rows)])
    return made if len(made) < len(plain) else plain
