import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import nested as N
from tests.conftest import SMALL

INNER = pa.struct([("k", pa.string()), ("v", pa.list_(pa.struct([("n", pa.int64()), ("d", pa.list_(pa.float64()))])))])
KIND = pa.list_(pa.struct([("a", pa.struct([("s", pa.string()), ("xs", pa.list_(INNER))])), ("b", pa.list_(pa.string()))]))
text = st.none() | st.text(max_size=3)


def maybe(x):
    return st.none() | x


inner = maybe(st.fixed_dictionaries({"k": text, "v": maybe(st.lists(maybe(st.fixed_dictionaries({"n": maybe(st.integers(-9, 9)), "d": maybe(st.lists(maybe(st.just(1.5)), max_size=2))})), max_size=3))}))
record = maybe(st.lists(maybe(st.fixed_dictionaries({"a": maybe(st.fixed_dictionaries({"s": text, "xs": maybe(st.lists(inner, max_size=3))})), "b": maybe(st.lists(text, max_size=3))})), max_size=3))


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=5))
def test_round_trip(rows):
    array = pa.array(rows, KIND)
    assert N.assemble(N.shred(array, "c"), len(rows), KIND, "c") == rows
    whole = pa.array([None, [None], *rows], KIND).slice(2)
    assert N.assemble(N.shred(whole, "c"), len(rows), KIND, "c") == rows


def exports(spark, rows):
    schema = spark.read.parquet(f"{SMALL}/langchain.parquet").select("resource_spans").schema
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([T.StructField("export_id", T.StringType()), T.StructField("present", T.IntegerType()), *schema.fields]))


def span(t, s, p):
    return {"traceId": t, "spanId": s, "parentSpanId": p, "attributes": [], "events": None}


def test_links_positions_and_nulls(spark):
    rs = [
        None,
        {"resource": {"attributes": [None, {"key": "service.name", "value": None}, {"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [None, {"scope": {"name": "n"}, "spans": [None, span("t", "a", None), span("t", "b", "a"), span("u", "c", "a")]}]},
        {"resource": None, "scopeSpans": [{"scope": None, "spans": [span("t", "d", "0000"), span(None, None, "a"), span("t", "e", "zz")]}, {"scope": {"name": "m"}, "spans": []}]},
    ]
    x = {(r.resource_pos, r.scope_pos, r.span_pos): r for r in N.linked_spans(exports(spark, [("e1", 7, rs), ("e2", 7, None), ("e3", 7, [])])).collect()}
    got = {k: (r.span_id, r.parent_span_id, r.link_kind, r.scope_name, r.service_name) for k, r in x.items()}
    assert got == {
        (1, 1, 1): ("a", "", "root", "n", "svc"), (1, 1, 2): ("b", "a", "linked", "n", "svc"), (1, 1, 3): ("c", "a", "orphan", "n", "svc"),
        (2, 0, 0): ("d", "", "root", "", ""), (2, 0, 1): ("", "a", "orphan", "", ""), (2, 0, 2): ("e", "zz", "orphan", "", ""),
    }


def test_tables_of_an_empty_table(spark):
    e = exports(spark, [])
    assert all(N.flat_table(e, t).count() == 0 for t in N.TABLES)
    assert N.linked_spans(e).count() == 0


def test_every_span_attribute_and_event_comes_out(spark):
    df = spark.read.parquet(f"{SMALL}/langchain.parquet")
    rows = pq.read_table(f"{SMALL}/langchain.parquet").column("resource_spans").to_pylist()
    spans = [s for rs in rows for r in rs or [] if r for sc in r["scopeSpans"] or [] if sc for s in sc["spans"] or []]
    assert N.flat_table(df, "spans").count() == len(spans)
    for table, field in (("span_attributes", "attributes"), ("events", "events")):
        assert N.flat_table(df, table).count() == sum(len(s[field] or []) for s in spans if s)


def test_lists_in_attributes_have_their_own_rows(spark):
    """Every attribute value of the small table is in a table: scalars in theirs, the entries of lists under their place."""
    df = spark.read.parquet(f"{SMALL}/langchain.parquet")
    rows = pq.read_table(f"{SMALL}/langchain.parquet").select(["export_id", "resource_spans"]).to_pylist()
    want = {"array": {}, "kvlist": {}}
    scalars = 0
    for e in rows:
        for i, r in enumerate(e["resource_spans"] or []):
            for k, a in enumerate(((r or {}).get("resource") or {}).get("attributes") or []):
                v = (a or {}).get("value") or {}
                scalars += any(v.get(s) is not None for s in N.SCALARS.values())
                for kind in want:
                    for j, x in enumerate((v.get(f"{kind}Value") or {}).get("values") or []):
                        want[kind][e["export_id"], i, k, j] = x["stringValue"] if kind == "array" else (x["key"], x["value"]["stringValue"])
    assert want["array"] and want["kvlist"]
    at = lambda r: (r.export_id, r.resource_pos, r.attribute_pos, r.item_pos)
    assert {at(r): r.value for r in N.flat_table(df, "resource_attribute_array_items").collect()} == want["array"]
    assert {at(r): (r.key, r.value) for r in N.flat_table(df, "resource_attribute_kvlist_items").collect()} == want["kvlist"]
    kinds = {k: n for k, n in N.flat_table(df, "resource_attributes").groupBy("value_kind").count().collect()}
    assert sum(kinds.get(k, 0) for k in N.SCALARS) == scalars
    assert kinds["array"] == len({k[:3] for k in want["array"]}) and kinds["kvlist"] == len({k[:3] for k in want["kvlist"]})


def test_hot_parent_and_wide_records(spark):
    """A third of all spans name one parent; one record has many resources, another one scope list of many entries."""
    rows = [("e1", 1, [{"resource": None, "scopeSpans": [{"scope": {"name": f"s{i}"}, "spans": [span("t", f"x{i}", "hot" if i % 3 else None)]}]} for i in range(300)])]
    rows += [("e2", 1, [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"scope": {"name": f"n{i}"}, "spans": [span("t", "hot" if i == 7 else f"y{i}", "none")]} for i in range(300)]}])]
    got = {r.span_id: r for r in N.linked_spans(exports(spark, rows)).collect()}
    assert len(got) == 600 and got["x1"].link_kind == "linked" and got["x3"].link_kind == "root" and got["y8"].link_kind == "orphan"
    assert all(got[f"x{i}"].scope_name == f"s{i}" and got[f"x{i}"].service_name == "" for i in range(300)) and got["y8"].scope_name == "n8" and got["y9"].service_name == "svc"
