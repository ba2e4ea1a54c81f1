"""Chats and session logs to messages, turns and calls.

messages() brings the message shapes of several providers to one form; calls() pairs calls with their
results; turns() anchors what the user said. Roles, wrappers and block types that aren't known come out
as issues, never dropped in silence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import without_scaffold

# Wrappers, roles and the elements a harness puts around user text.
WRAPPERS = ("messages", "conversations", "conversation", "contents", "chat", "dialog", "turns")
ROLES = {
    "user": "user", "human": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant", "function_call": "assistant",
    "system": "system", "developer": "system", "tool": "tool", "function": "tool", "observation": "tool", "tool_result": "tool", "function_response": "tool",
}
SCAFFOLD = ("system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr")
SCHEMA = "file string, pos int, idx int, role string, content string, calls string, call_id string, name string, images int, issue string"


def conversations(value, known=WRAPPERS) -> list[list]:
    """The message lists in a record, whichever wrapper it has."""
    if isinstance(value, list):
        if value and all(isinstance(x, dict) and _is_message(x) for x in value):
            return [value]
        return [c for x in value for c in conversations(x)]
    if isinstance(value, dict):
        if _is_message(value):
            return [[value]]
        for w in known:
            if isinstance(value.get(w), list):
                lists = value[w]
                return [c for x in lists for c in conversations(x)] if lists and isinstance(lists[0], list) else [lists]
    return []


def _is_message(x: dict) -> bool:
    return ("role" in x and ("content" in x or "tool_calls" in x or "parts" in x or "function_call" in x)) or ("from" in x and "value" in x) or (x.get("type") in ("human", "ai", "tool", "system") and ("content" in x or "data" in x))


def normal_message(m) -> tuple:
    """(role, content, calls, call_id, name, images, issue) of one message of any provider."""
    if not isinstance(m, dict):
        return None, None, [], None, None, 0, "not_an_object"
    if isinstance(m.get("data"), dict) and "content" in m["data"]:
        m = m | m["data"]
    said = m.get("role", m.get("from", m.get("type")))
    role = ROLES.get(str(said).lower())
    issue = None if role else f"unknown_role: {said}"
    body = m.get("content", m.get("value", m.get("parts")))
    texts, calls, images, call_id = [], [], 0, m.get("tool_call_id")
    for part in body if isinstance(body, list) else [body]:
        if part is None:
            continue
        if isinstance(part, str):
            texts.append(part)
            continue
        if not isinstance(part, dict):
            texts.append(json.dumps(part))
            continue
        kind = part.get("type")
        if kind in ("text", "input_text", "output_text") or (kind is None and "text" in part):
            texts.append(part.get("text") or "")
        elif kind in ("image", "image_url", "input_image") or "inline_data" in part or "inlineData" in part:
            images += 1
        elif kind == "tool_use":
            calls.append({"id": part.get("id"), "name": part.get("name"), "arguments": part.get("input") or {}})
        elif "functionCall" in part or "function_call" in part:
            f = part.get("functionCall") or part["function_call"]
            calls.append({"id": f.get("id"), "name": f.get("name"), "arguments": f.get("args") or {}})
        elif kind == "tool_result" or "functionResponse" in part:
            f = part.get("functionResponse") or {}
            role, call_id = "tool", part.get("tool_use_id") or f.get("id")
            texts.append(_plain(part.get("content", f.get("response"))))
        elif kind in ("thinking", "reasoning", "redacted_thinking"):
            pass
        else:
            issue = issue or f"unknown_block: {kind}"
    for c in m.get("tool_calls") or []:
        f = c.get("function", c) if isinstance(c, dict) else {}
        calls.append({"id": c.get("id") if isinstance(c, dict) else None, "name": f.get("name"), "arguments": _arguments(f.get("arguments", f.get("args")))})
    if isinstance(m.get("function_call"), dict):
        calls.append({"id": None, "name": m["function_call"].get("name"), "arguments": _arguments(m["function_call"].get("arguments"))})
    if str(said).lower() == "function_call" and texts:
        x = _arguments(texts[0])
        calls, texts = [{"id": None, "name": x.get("name") if isinstance(x, dict) else None, "arguments": x.get("arguments", {}) if isinstance(x, dict) else x}], []
    return role, "\n".join(texts) if texts else None, calls, call_id, m.get("name"), images, issue


def _plain(x) -> str:
    if isinstance(x, list):
        return "\n".join(_plain(y.get("text") if isinstance(y, dict) and "text" in y else y) for y in x)
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _arguments(x):
    if isinstance(x, str):
        try:
            return json.loads(x)
        except ValueError:
            return {"_text": x}
    return x or {}


def messages(records: DataFrame) -> DataFrame:
    """One row a message, in order; conversation numbers continue within a record. A record without any gives an issue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, pos, record in zip(f["file"], f["pos"], f["record"]):
                found = conversations(json.loads(record))
                if not found:
                    rows.append((file, pos, 0, None, None, None, None, None, 0, "no_conversation"))
                idx = 0
                for c in found:
                    for m in c:
                        role, content, calls, call_id, name, images, issue = normal_message(m)
                        rows.append((file, pos, idx, role, content, json.dumps(calls, ensure_ascii=False) if calls else None, call_id, name, images, issue))
                        idx += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return records.where("record is not null").where(F.try_parse_json("record").isNotNull()).select("file", "pos", "record").mapInPandas(run, SCHEMA)


def calls(m: DataFrame) -> DataFrame:
    """(file, pos, call_idx, n, id, name, arguments, result_idx, output, matched): each call with its result.

    By id first; calls and results without id pair by name in order, then, if none of a conversation's
    calls has an id and there are as many results, by place. A result serves one call only.
    """
    conv = ["file", "pos"]
    c = m.where("calls is not null").select(*conv, F.col("idx").alias("call_idx"), F.posexplode(F.from_json("calls", "array<struct<id: string, name: string, arguments: variant>>")).alias("n", "c"))
    c = c.select(*conv, "call_idx", "n", "c.id", "c.name", F.to_json("c.arguments").alias("arguments"))
    r = m.where("role = 'tool'").select(*conv, F.col("idx").alias("result_idx"), F.col("call_id").alias("rid"), F.col("name").alias("rname"), F.col("content").alias("output"))
    nth = lambda *by, order: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    has = c.groupBy(*conv).agg(F.count("id").alias("ids"), F.count(F.lit(1)).alias("n_calls")).join(r.groupBy(*conv).agg(F.count("rid").alias("rids"), F.count(F.lit(1)).alias("n_results")), conv, "left")
    c = c.join(has, conv, "left")
    plain = (F.col("ids") == 0) & (F.coalesce("rids", F.lit(0)) == 0)
    kind = F.when(F.col("id").isNotNull(), "id").when(plain & (F.col("n_calls") == F.col("n_results")), "place").otherwise("name")
    c = c.withColumn("how", kind)
    key = F.when(F.col("how") == "id", F.col("id")).when(F.col("how") == "name", F.col("name")).otherwise("")
    c = c.withColumn("k", key)
    c = c.withColumn("rank", nth(*conv, "how", "k", order=["call_idx", "n"]))
    r = r.join(has.select(*conv, "ids", "rids", "n_calls", "n_results"), conv, "left").withColumn("how", F.when(F.col("rid").isNotNull(), "id").when(plain & (F.col("n_calls") == F.col("n_results")), "place").otherwise("name"))
    r = r.withColumn("k", F.when(F.col("how") == "id", F.col("rid")).when(F.col("how") == "name", F.col("rname")).otherwise(""))
    r = r.withColumn("rank", nth(*conv, "how", "k", order=["result_idx"])).select(*conv, "how", "k", "rank", "result_idx", "output")
    x = c.join(r, [*conv, "how", "k", "rank"], "left")
    return x.select(*conv, "call_idx", "n", "id", "name", "arguments", "result_idx", "output", F.when(F.col("result_idx").isNotNull(), F.col("how")).alias("matched"))


def stray_results(m: DataFrame) -> DataFrame:
    """Results that name a call there isn't."""
    known = m.where("calls is not null").select("file", "pos", F.explode(F.from_json("calls", "array<struct<id: string>>")).alias("c")).select("file", "pos", F.col("c.id").alias("call_id"))
    return m.where("role = 'tool' and call_id is not null").join(known, ["file", "pos", "call_id"], "left_anti").select("file", "pos", "idx", "call_id")


def turns(m: DataFrame, *conv: str) -> DataFrame:
    """(conv, idx, text, after_idx): what users said, each after the assistant message before it, if any.

    The scaffold of the harness is taken off; turns of nothing else are left out.
    """
    conv = conv or ("file", "pos")
    w = W.partitionBy(*conv).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    x = m.withColumn("after_idx", F.max(F.when(F.col("role") == "assistant", F.col("idx"))).over(w))
    return x.where("role = 'user'").select(*conv, "idx", without_scaffold(F.coalesce("content", F.lit("")), SCAFFOLD).alias("text"), "after_idx", "images").where("text <> '' or images > 0").drop("images")


def unanswered(m: DataFrame, *conv: str) -> DataFrame:
    """(conv, idx): user turns that no assistant message follows before the next user turn or the end."""
    conv = conv or ("file", "pos")
    w = W.partitionBy(*conv).orderBy("idx")
    x = m.where("role in ('user', 'assistant')").withColumn("next", F.lead("role").over(w))
    return x.where("role = 'user' and (next is null or next = 'user')").select(*conv, "idx")


def session_messages(records: DataFrame) -> DataFrame:
    """Session logs, one message a row, in the form of messages(); a session is one conversation ordered by time."""
    g = lambda p: F.get_json_object("record", p)
    x = records.where(g("$.sessionId").isNotNull() & g("$.message").isNotNull()).select(F.col("file").alias("src"), F.col("pos").alias("line"), g("$.sessionId").alias("session"), g("$.timestamp").alias("at"), g("$.message").alias("record"))
    order = W.partitionBy("session").orderBy("at", "src", "line")
    y = messages(x.select(F.concat_ws("\u001f", "src", "session", "at").alias("file"), F.col("line").alias("pos"), "record"))
    key = F.split("file", "\u001f")
    y = y.select(key[0].alias("src"), key[1].alias("session"), key[2].alias("at"), F.col("pos").alias("line"), *[c for c in y.columns if c not in ("file", "pos", "idx")])
    return y.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).select(F.col("session").alias("file"), F.lit(0).alias("pos"), "idx", "role", "content", "calls", "call_id", "name", "images", "issue")


def to_sharegpt(m: DataFrame, *conv: str) -> DataFrame:
    """(conv, conversations): messages as ShareGPT JSON. A conversation has to fit a row."""
    conv = conv or ("file", "pos")
    who = F.when(F.col("role") == "user", "human").when((F.col("role") == "assistant") & F.col("calls").isNotNull(), "function_call").when(F.col("role") == "assistant", "gpt").when(F.col("role") == "tool", "observation").otherwise(F.col("role"))
    row = F.struct("idx", who.alias("from"), F.coalesce(F.when(F.col("role") == "assistant", F.col("calls")), F.col("content"), F.lit("")).alias("value"))
    x = m.where("role is not null").groupBy(*conv).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return x.select(*conv, F.to_json(F.transform("rows", lambda r: F.struct(r["from"].alias("from"), r["value"].alias("value")))).alias("conversations"))
