"""Small parsers: argument lists, nested lookups, runs of integers."""

from __future__ import annotations

import ast


def runs(values) -> str:
    """Sorted integers as runs: [1, 2, 3, 7] is ``1-3,7``."""
    out: list[list[int]] = []
    for v in sorted(set(values)):
        if out and v == out[-1][1] + 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def evaluate(text: str):
    """A literal if the text is one, else the text itself; nothing is executed."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def pairs(items: list[str]) -> dict:
    """Alternating keys and values; an odd number raises ``ValueError``."""
    if len(items) % 2:
        raise ValueError(f"{len(items)} items are no pairs")
    return {k.lstrip("-"): evaluate(v) for k, v in zip(items[::2], items[1::2], strict=True)}


def chunks(argv: list[str], flag: str) -> list[list[str]]:
    """The stretches of an argument list that follow each ``flag``."""
    out: list[list[str]] = []
    for a in argv:
        if a == flag:
            out.append([])
        elif out:
            out[-1].append(a)
    return out


def lookup(tree: dict, *keys: str):
    """A nested entry; a wrong path raises ``KeyError`` that names it."""
    at = tree
    for i, k in enumerate(keys):
        if not isinstance(at, dict) or k not in at:
            raise KeyError("/".join(keys[: i + 1]))
        at = at[k]
    return at
