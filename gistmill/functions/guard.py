"""Gate for regular expressions that users give: what could take exponential time is not run."""

from __future__ import annotations

import json
import re
from re import _constants as C
from re import _parser

#: Longest pattern, and most repetitions in one.
MOST_CHARS, MOST_REPEATS = 500, 25


def _repeats(node, depth: int = 0) -> tuple[int, int]:
    """(nesting of repetitions, their number) of a parsed pattern."""
    deepest, count = depth, 0
    for op, value in node:
        inner = []
        below = depth
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = value
            count += 1
            below += high == C.MAXREPEAT or high > 1
            inner = [body]
        elif op is C.SUBPATTERN:
            inner = [value[-1]]
        elif op is C.BRANCH:
            inner = value[1]
        elif op in (C.ASSERT, C.ASSERT_NOT):
            inner = [value[1]]
        deepest = max(deepest, below)
        for body in inner:
            d, n = _repeats(body, below)
            deepest, count = max(deepest, d), count + n
    return deepest, count


def safe_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(patterns to use, warnings): too long, nested repetitions, too many repetitions and invalid ones are left out."""
    kept, warnings = [], []
    for p in patterns:
        shown = json.dumps(p[:50], ensure_ascii=False)
        try:
            deepest, count = (2, 0) if len(p) > MOST_CHARS else _repeats(_parser.parse(p))
        except (re.error, RecursionError, OverflowError):
            warnings.append(f"Skipped invalid regex pattern: {shown}")
            continue
        if deepest > 1 or count > MOST_REPEATS:
            warnings.append(f"Skipped unsafe regex pattern (ReDoS risk): {shown}")
        else:
            kept.append(p)
    return kept, warnings
