"""What a model call was given and gave back, from whichever attributes hold it, as one list of messages.

Candidates of each direction are looked at in a fixed order and the first with a part counts: declared
GenAI messages, flattened gen_ai.prompt.N / completion.N, flattened llm.*_messages.N, span events, an SDK
response, the declared input or output value. A text that opens like JSON but is cut off is counted as
unparsed, never read as prose.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from spanloom.sources.chat import normal_message

# Keys of declared values, in order.
DECLARED = {"input": ("gen_ai.input.messages",), "output": ("gen_ai.output.messages",)}
FLAT = {"input": ("gen_ai.prompt.", "llm.input_messages."), "output": ("gen_ai.completion.", "llm.output_messages.")}
VALUES = {
    "input": ("input.value", "traceloop.entity.input", "ai.prompt.messages", "ai.prompt", "braintrust.input_json", "gen_ai.prompt", "input", "inputs"),
    "output": ("output.value", "traceloop.entity.output", "ai.response.text", "ai.response.toolCalls", "braintrust.output_json", "gen_ai.completion", "output", "outputs"),
}
EVENTS = {"input": {"gen_ai.system.message": "system", "gen_ai.user.message": "user", "gen_ai.assistant.message": "assistant", "gen_ai.tool.message": "tool"}, "output": {"gen_ai.choice": "assistant"}}
SCHEMA = "trace_id string, span_id string, direction string, n int, role string, content string, calls string, call_id string, found_in string, unparsed boolean"
_CUT = re.compile(r'^\s*(?:\{"|\[\{|\["|\[\[)')


def opened(text):
    """(value, cut): the JSON in a text, or the text itself; cut if it opens like JSON but can't be read."""
    if not isinstance(text, str):
        return text, False
    s = text.strip()
    if s[:1] in ("{", "["):
        try:
            return json.loads(s), False
        except ValueError:
            return text, bool(_CUT.match(text))
    return text, False


def unflattened(attributes: dict, prefix: str) -> list:
    """prefix.0.role, prefix.0.content … as a list of objects, nested numbers as lists."""
    root: dict = {}
    for k, v in attributes.items():
        if k.startswith(prefix) and k[len(prefix) :].split(".")[0].isdigit():
            at = root
            *path, last = k[len(prefix) :].split(".")
            for p in path:
                nxt = at.setdefault(p, {})
                at = nxt if isinstance(nxt, dict) else at.__setitem__(p, {"": nxt}) or at[p]
            at[last] = v

    def listed(x):
        if isinstance(x, dict) and x and all(k.isdigit() for k in x):
            return [listed(x[k]) for k in sorted(x, key=int)]
        return {k: listed(v) for k, v in x.items()} if isinstance(x, dict) else x

    out = listed(root)
    return [x.get("message", x) if isinstance(x, dict) else x for x in out] if isinstance(out, list) else []


def _read(found, direction: str) -> list[tuple]:
    """Normal messages with something in them."""
    default = "user" if direction == "input" else "assistant"
    value, _ = opened(found)
    if isinstance(value, dict):
        for k in ("messages", "choices", "candidates", "generations"):
            if isinstance(value.get(k), list):
                value = [c.get("message", c.get("content", c)) if isinstance(c, dict) else c for c in value[k]]
                break
    rows = []
    for m in value if isinstance(value, list) else [value]:
        if isinstance(m, str):
            m = {"role": default, "content": m}
        if not isinstance(m, dict):
            continue
        if not ({"role", "from", "type"} & set(m)) and ({"content", "parts", "text"} & set(m)):
            m = {"role": default, "content": m.get("content", m.get("parts", m.get("text")))}
        role, content, calls, call_id, _, images, _ = normal_message(m)
        if role is None and {"content", "parts", "value"} & set(m) == set():
            content = json.dumps(m, ensure_ascii=False)  # an object that is no message is one text
        if content or calls or images:
            rows.append((role or default, content, calls, call_id))
    return rows


def span_messages(attributes: dict, events: list | None = None) -> list[tuple]:
    """(direction, n, role, content, calls, call_id, found_in, unparsed) of one span."""
    out = []
    for direction in ("input", "output"):
        candidates = [(k, attributes[k]) for k in DECLARED[direction] if k in attributes]
        candidates += [(p + "N", unflattened(attributes, p)) for p in FLAT[direction]]
        told = [({"role": EVENTS[direction][e["name"]]} | (e.get("attributes") or {})) for e in events or [] if isinstance(e, dict) and e.get("name") in EVENTS[direction]]
        candidates += [("events", told)] if told else []
        candidates += [(k, attributes[k]) for k in VALUES[direction] if k in attributes]
        cut = False
        for where, found in candidates:
            value, broken = opened(found)
            cut |= broken
            rows = [] if broken else _read(value, direction)
            if rows:
                out += [(direction, n, r, c, json.dumps(k, ensure_ascii=False) if k else None, i, where, False) for n, (r, c, k, i) in enumerate(rows)]
                break
        else:
            if cut:
                out.append((direction, 0, None, None, None, None, None, True))
    return out


def normalised(spans: DataFrame) -> DataFrame:
    """Messages of spans (trace_id, span_id, attributes as JSON and, if there, events as JSON)."""
    has_events = "events" in spans.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                a, _ = opened(r.attributes)
                e, _ = opened(r.events) if has_events else (None, False)
                rows += [(r.trace_id, r.span_id, *m) for m in span_messages(a if isinstance(a, dict) else {}, e if isinstance(e, list) else None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spans.select("trace_id", "span_id", "attributes", *(["events"] if has_events else [])).mapInPandas(run, SCHEMA)


def new_user_turns(m: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, n, text): the users' messages after the last other one in a call's input."""
    from pyspark.sql import functions as F

    x = m.where("direction = 'input' and role is not null")
    last = x.where("role <> 'user'").groupBy("trace_id", "span_id").agg(F.max("n").alias("_last"))
    x = x.join(last, ["trace_id", "span_id"], "left").where("role = 'user' and n > coalesce(_last, -1)")
    return x.join(spans.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi").select("trace_id", "span_id", "n", F.col("content").alias("text"))
