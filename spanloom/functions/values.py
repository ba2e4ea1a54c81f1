"""Operations on JSON values that expressions can't say, for use in Python batches."""

from __future__ import annotations

import json
from typing import Any


def flattened(value: Any, path: str = "") -> dict[str, Any]:
    """Leaf paths and their values; empty objects and lists are leaves."""
    if isinstance(value, dict) and value:
        return {k2: v2 for k, v in value.items() for k2, v2 in flattened(v, f"{path}.{k}" if path else str(k)).items()}
    if isinstance(value, list) and value:
        return {k2: v2 for i, v in enumerate(value) for k2, v2 in flattened(v, f"{path}[{i}]").items()}
    return {path: value}


def state_match(want: Any, got: Any) -> float:
    """Share of the leaves of both that agree in path, type and value."""
    a, b = flattened(want), flattened(got)
    keys = a.keys() | b.keys()
    return sum(k in a and k in b and type(a[k]) is type(b[k]) and a[k] == b[k] for k in keys) / len(keys) if keys else 1.0


def applied(state: Any, ops: list[dict]) -> tuple[Any, list[str]]:
    """(state, errors) after set, delete and append at dotted paths; the state passed in stays as it is."""
    state, errors = json.loads(json.dumps(state)), []
    for n, op in enumerate(ops):
        steps = [int(p) if p.isdigit() else p for p in str(op.get("path", "")).split(".") if p != ""]
        at = state
        try:
            for i, p in enumerate(steps[:-1]):
                if isinstance(at, dict) and p not in at and op.get("op") != "delete":
                    at[p] = [] if isinstance(steps[i + 1], int) else {}
                at = at[p]
            if op.get("op") == "set":
                at[steps[-1]] = op.get("value")
            elif op.get("op") == "delete":
                del at[steps[-1]]
            elif op.get("op") == "append":
                if isinstance(at, dict):
                    at.setdefault(steps[-1], [])
                at[steps[-1]].append(op.get("value"))
            else:
                errors.append(f"{n}: unknown op")
        except (KeyError, IndexError, TypeError, AttributeError) as e:
            errors.append(f"{n}: {type(e).__name__}")
    return state, errors


def json_in(text: str) -> Any:
    """The first JSON object or list in prose, fenced or bare; None if there is none."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c in "{[":
            try:
                return decoder.raw_decode(text, i)[0]
            except ValueError:
                continue
    return None


def repaired_arguments(text: Any) -> dict | None:
    """Call arguments as an object: JSON, JSON in a string, fenced, or with single quotes and trailing commas."""
    import ast
    import re

    for _ in range(3):
        if isinstance(text, dict):
            return text
        if not isinstance(text, str):
            return None
        s = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
        try:
            text = json.loads(s)
            continue
        except ValueError:
            pass
        try:
            text = json.loads(re.sub(r",\s*([}\]])", r"\1", s))
            continue
        except ValueError:
            pass
        try:
            text = ast.literal_eval(s.strip())  # literals only
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return json_in(s) if isinstance(json_in(s), dict) else None
    return text if isinstance(text, dict) else None


def tool_set(value: Any) -> list[dict] | None:
    """Offered tools from a list, its JSON, or names; [] means none were offered, None that it can't be read."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if not isinstance(value, list):
        return None
    out = []
    for t in value:
        if isinstance(t, str):
            t = repaired_arguments(t) or {"name": t}
        f = t.get("function", t) if isinstance(t, dict) else {}
        if not isinstance(f, dict) or not isinstance(f.get("name"), str):
            return None
        out.append({"name": f["name"], "description": f.get("description"), "parameters": f.get("parameters", f.get("input_schema")), "output_schema": f.get("output_schema")})
    return out


def transcript_turn(text: str) -> tuple[str | None, list[dict], str | None]:
    """(said, calls, issue) of generated text with calls in <tool_call> elements or a fenced JSON block."""
    import re

    calls, issue = [], None
    for m in re.finditer(r"<tool_call>(.*?)(?:</tool_call>|\Z)", text, re.S):
        x = repaired_arguments(m.group(1))
        if x is None or not isinstance(x.get("name"), str):
            issue = "unreadable_call"
            continue
        args = repaired_arguments(x.get("arguments", {}))
        calls.append({"name": x["name"], "arguments": {} if args is None else args})
        issue = issue or ("unreadable_arguments" if args is None else None)
    said = re.sub(r"<tool_call>.*?(?:</tool_call>|\Z)", "", text, flags=re.S).strip()
    return said or None, calls, issue
