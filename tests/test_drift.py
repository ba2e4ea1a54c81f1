import json

from spanloom.operators import drift as D

T = "collector string, file_name string, file_seq int, delivery_id bigint, attributes string, name string"


def chat(**more):
    return json.dumps({"gen_ai.completion": "x", **more})


OP, MODEL, TOKENS = "gen_ai.operation.name", "gen_ai.request.model", "gen_ai.usage.input_tokens"


def test_changes_between_files(spark):
    files = [
        [chat(**{OP: "chat", MODEL: "m", TOKENS: 1})] * 3 + ['{"cut', None, "[]", json.dumps({OP: "execute_tool", "gen_ai.tool.call.arguments": {}})],
        [chat(**{"gen_ai.operation_name": "chat", MODEL: {"id": "m"}, TOKENS: "1", "client.build": "b"})] * 2,
        [chat(**{"gen_ai.operation_name": "chat", "tokens.input": [1]})] * 2 + [chat(**{OP: "chat", MODEL: "m", TOKENS: 1})],  # a late line changes nothing
        [chat(**{OP: ["chat"], MODEL: "m", "usage.input_tokens": 2})] * 2,  # a name nobody approved that shares its words
    ]
    rows = [("c", f"f{i}", i, i * 10 + k, a, "clash") for i, f in enumerate(files) for k, a in enumerate(f)] + [("d", "g0", 0, 99, chat(**{OP: "chat"}), "")]
    got = {(r.file_name, r.field_path.removeprefix("attributes."), r.change_kind) for r in D.changes(spark.createDataFrame(rows, T), D.TRACES).collect()}
    assert got == {
        ("f1", OP, "renamed"), ("f1", MODEL, "type_changed"), ("f1", TOKENS, "type_changed"),
        ("f2", MODEL, "removed"), ("f2", TOKENS, "renamed"),
        ("f3", OP, "renamed"), ("f3", MODEL, "added"), ("f3", TOKENS, "renamed"),
    }


def test_steady_table_keeps_everything(spark):
    rows = [
        ("c", "f", 0, 1, chat(**{OP: "chat", MODEL: "m", TOKENS: 5, "extra": {"a": 1}}), ""),
        ("c", "f", 0, 2, chat(**{"operation.name": ["chat"], "llm.model": {"id": "m2"}, "tokens.input": "7"}), ""),
        ("c", "f", 0, 3, chat(**{OP: "chat", MODEL: "m", TOKENS: "many"}), ""),
        ("c", "f", 0, 4, '{"cut', ""), ("c", "f", 0, 5, None, ""), ("c", "f", 0, 6, "{}", ""),
    ]
    df = spark.createDataFrame(rows, T)
    got = {r.delivery_id: (r.gen_ai_operation_name, r.gen_ai_request_model, r.gen_ai_usage_input_tokens, r._rescued and json.loads(r._rescued)) for r in D.steady_table(df, D.TRACES, "attributes", ("delivery_id",)).collect()}
    assert got == {
        1: ("chat", "m", 5, {"extra": {"a": 1}}), 2: ("chat", "m2", 7, None), 3: ("chat", "m", None, {TOKENS: "many"}),
        4: (None, None, None, {"_raw": '{"cut'}), 5: (None, None, None, {"_raw": "null"}), 6: (None, None, None, None),
    }
    first = {r.delivery_id: r._rescued and json.loads(r._rescued) for r in D.ingest(df, D.TRACES, "attributes", ("delivery_id",)).collect()}
    assert first[2] == {"operation.name": ["chat"], "llm.model": {"id": "m2"}, "tokens.input": "7"}


def test_nested_feed_and_empty(spark):
    schema = "collector string, file_name string, file_seq int, line_id bigint, payload string"
    line = lambda scope, span: json.dumps({"resourceSpans": [{"resource": {}, "scopeSpans": [{"scope": scope, "spans": [span, span]}, {"spans": None}]}]})
    rows = [("c", "f0", 0, 1, line({"name": "n"}, {"name": "a", "kind": 1})), ("c", "f1", 1, 2, line({"name": "n"}, {"spanName": "a", "kind": "K"})), ("c", "f1", 1, 3, "{"), ("c", "f2", 2, 4, line({"library": "n"}, {"spanName": "a"}))]
    got = {(r.file_name, r.field_path, r.change_kind) for r in D.changes(spark.createDataFrame(rows, schema), D.VERCEL).collect()}
    # of the two scopes a line has here, one says nothing: of equally frequent forms the first by name counts
    assert got == {("f1", "scopeSpans.spans.name", "renamed"), ("f1", "scopeSpans.spans.kind", "type_changed"), ("f2", "scopeSpans.spans.kind", "removed"), ("f2", "scopeSpans.scope.name", "renamed")}
    assert D.changes(spark.createDataFrame([], schema), D.VERCEL).count() == 0


def test_test_tables_against_brute_force(spark):
    """Every change of every feed at the small size, told again with dicts."""
    import collections

    import duckdb

    from spanloom.plans.core_problems import p5_found

    d = "/root/testdata/sf0.01"
    kind = lambda v: {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}.get(type(v))
    want, con = set(), duckdb.connect()
    for feed in D.FEEDS:
        forms, names = collections.defaultdict(lambda: collections.defaultdict(collections.Counter)), {}
        for c, f, s, p in con.execute(f"select collector, file_name, file_seq, {feed.payload} from '{d}/{feed.name}.parquet'").fetchall():
            names[c, s] = f
            try:
                o = json.loads(p)
            except ValueError:
                continue
            for level, fields in feed.level.items():
                objects = [o] if level == "attributes" else [x for r in o["resourceSpans"] for sc in r.get("scopeSpans") or [] for x in ([sc.get("scope") or {}] if level == "scope" else sc.get("spans") or [])]
                for w in fields:
                    for x in objects:
                        if w.where != "true" and "gen_ai.tool.call.arguments" in x:
                            continue
                        k = next((k for k in (w.key, *w.approved) if k in x), None)
                        forms[c][s][w.path, k and (k, kind(x[k]))] += 1
        for c, files in forms.items():
            before = {}
            for s in sorted(files):
                for path in {p for p, _ in files[s]}:
                    usual = max((n, k) for (p, k), n in files[s].items() if p == path)[1] if len({k for p, k in files[s] if p == path}) > 1 else next(k for p, k in files[s] if p == path)
                    if path in before and before[path] != usual:
                        a, b = before[path], usual
                        want.add((feed.name, names[c, s], path, "added" if a is None else "removed" if b is None else "renamed" if a[0] != b[0] else "type_changed"))
                    before[path] = usual
    assert {tuple(r) for r in p5_found(spark, d).collect()} == want and want


def _again(row, feed, level):
    """The record of a row of steady_table, from its columns and _rescued."""
    out = json.loads(row["_rescued"]) if row["_rescued"] else {}
    for w in feed.level[level]:
        if row[D.column_name(w)] is not None:
            out.setdefault("*", {})[w.key] = row[D.column_name(w)]
    for k, kind in feed.known[level].items():
        c = D.known_column(level, k)
        if c in row and row[c] is not None and k not in {w.key for w in feed.level[level]}:
            out[k] = json.loads(row[c]) if kind == "json" else row[c]
    return out


def test_nothing_is_lost(spark):
    """Every record, field and value of the small tables is in its row; unreadable lines are there as they were."""
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for feed in D.FEEDS:
        key = "delivery_id" if feed is D.TRACES else "line_id"
        lines = dict(con.execute(f"select {key}, {feed.payload} from '{d}/{feed.name}.parquet'").fetchall())
        for level, fields in feed.level.items():
            rows = D.steady_table(spark.read.parquet(f"{d}/{feed.name}.parquet"), feed, level, (key,)).collect()
            assert {r[key] for r in rows} == set(lines)
            names = {x for w in fields for x in (w.key, *w.approved)}
            seen = 0
            for r in rows:
                try:
                    o = json.loads(lines[r[key]])
                except (ValueError, TypeError):
                    assert json.loads(r._rescued) == {"_raw": lines[r[key]] or "null"}
                    continue
                if level != "attributes":
                    o = o["resourceSpans"][r.resource_pos]["scopeSpans"][r.scope_pos]
                    o = o["spans"][r.span_pos] if level == "spans" else o.get("scope") or {}
                got = _again(r.asDict(), feed, level)
                typed = got.pop("*", {})
                assert {k: v for k, v in got.items() if k not in names} == {k: v for k, v in o.items() if k not in names and v is not None}
                assert len(typed) == len([k for k in names if o.get(k) is not None]) - len([k for k in got if k in names and got[k] is not None])
                for w in fields:  # a value under its usual name and type is the column's
                    if w.key in typed and isinstance(o.get(w.key), (str, int)):
                        assert str(typed[w.key]) == str(o[w.key])
                seen += 1
            assert seen > 0


def test_odd_lines_and_entries(spark):
    lines = ["[]", "7", "{}", '{"resourceSpans": 5, "v": 1}', '{"resourceSpans": [3, null, {"scopeSpans": "x", "schemaUrl": "u"}]}',
             '{"z": 1, "resourceSpans": [{"resource": {"a": 1}, "scopeSpans": [{"scope": 4, "spans": [5, null, {"name": "n", "q": [1]}], "url": "s"}, 9]}]}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, payload string")
    load = lambda r: r._rescued and json.loads(r._rescued)
    spans = [(r.line_id, r.span_pos, r.spans_name, load(r)) for r in D.steady_table(df, D.VERCEL, "spans", ("line_id",)).orderBy("line_id", "span_pos").collect()]
    assert spans == [*[(i, None, None, {"_raw": lines[i]}) for i in range(5)], (5, 0, None, {"_raw": "5"}), (5, 1, None, {"_raw": "null"}), (5, 2, "n", {"q": [1]})]
    scopes = [(r.line_id, r.resource_pos, r.scope_pos, r.resource, load(r)) for r in D.steady_table(df, D.VERCEL, "scope", ("line_id",)).orderBy("line_id", "resource_pos", "scope_pos").collect()]
    assert scopes == [
        *[(i, None, None, None, {"_raw": lines[i]}) for i in range(4)],
        (4, 0, None, None, {"_raw": "3"}), (4, 1, None, None, {"_raw": "null"}), (4, 2, None, None, {"resourceSpans.scopeSpans": "x", "resourceSpans.schemaUrl": "u"}),
        (5, 0, 0, '{"a":1}', {"scopeSpans.scope": 4, "scopeSpans.url": "s", "line.z": 1}), (5, 0, 1, '{"a":1}', {"_raw": "9", "line.z": 1}),
    ]


def test_changes_come_out_of_the_rescue_column(spark, monkeypatch):
    """Without what replay() finds in _rescued, a renaming is not told."""
    rows = [("c", "f0", 0, 1, chat(**{OP: "chat"}), ""), ("c", "f1", 1, 2, chat(**{"operation.name": "chat"}), "")]
    df = spark.createDataFrame(rows, T)
    kinds = lambda: [r.change_kind for r in D.changes(df, D.TRACES).where("field_path like '%operation%'").collect()]
    assert kinds() == ["renamed"]
    ingest = D.ingest
    monkeypatch.setattr(D, "ingest", lambda *a: ingest(*a).withColumn("_rescued", D.F.lit(None).cast("string")))
    assert kinds() == ["removed"]
