import json
import threading

import pytest
from pyspark.sql import functions as F

from weftline import queries as Q
from weftline.operators import TOOLS, Context, ToolError
from weftline.plans import Flow, Registry, compile_workflow, parse_text, register_tool
from weftline.plans.cli import main
from weftline.plans.document import kind_of_plugin
from weftline.plans.report import markdown, overview
from weftline.sources import classify
from weftline.sources.io import qualify, split_connection


@pytest.fixture
def ctx(spark):
    return Context(spark)


def test_plugins():
    assert kind_of_plugin("VendorGui.VendorSelect.VendorSelect") == "select"
    assert kind_of_plugin("VendorGui.MultiRowFormula.MultiRowFormula") == "multi_row_formula"
    assert kind_of_plugin("VendorGui.RecordID.RecordID") == "record_id"
    assert kind_of_plugin("A.RegEx.RegEx") == "reg_ex"
    assert kind_of_plugin("Other.Thing") == "thing"


def test_connections():
    assert classify("s3://b/x.csv") == "Amazon S3"
    assert classify("C:/x.CSV") == "CSV/Text File"
    assert classify("aka:db") == "SQL Database"
    assert split_connection("odbc:DATABASE=d;|||select 1;") == ("odbc:DATABASE=d;", "select 1")
    assert qualify("select * from t join [u] on 1 = 1", "d", {"d.t": "v", "d.u": "w"}) == "select * from v join w on 1 = 1"


def test_nested_and_disabled_tools():
    inner = Q.node(2, "BrowseV2", "")
    text = Q.document([Q.node(1, "TextInput", ""), f'<Node ToolID="9"><GuiSettings Plugin="G.ToolContainer.ToolContainer" /><Properties><Configuration><Disabled value="True" /></Configuration></Properties><ChildNodes>{inner}</ChildNodes></Node>'], [Q.edge("1:Output", "2:Input")])
    w = parse_text(text)
    assert [t.id for t in w.tools] == [1]
    assert not w.connections


def test_graph_errors():
    with pytest.raises(ValueError, match="not in the workflow"):
        parse_text(Q.document([Q.node(1, "A.B.C", "")], [Q.edge("1:Output", "7:Input")])).graph()
    with pytest.raises(ValueError, match="cycle"):
        parse_text(Q.document([Q.node(1, "A.B.C", ""), Q.node(2, "A.B.C", "")], [Q.edge("1:Output", "2:Input"), Q.edge("2:Output", "1:Input")])).graph()


def test_order_and_chains():
    g = parse_text(Q.SHIPPED).graph()
    assert g.order == [1, 2, 3, 4, 5, 6, 7]
    assert g.chains() == [[1, 2, 3, 4, 5, 6, 7]]
    assert g.sources == [1]
    assert g.sinks == [7]
    assert "7 tools" in overview(parse_text(Q.SHIPPED))
    wide = parse_text(Q.WIDE).graph()
    place = {i: k for k, i in enumerate(wide.order)}
    assert all(place[c.origin] < place[c.destination] for edges in wide.into.values() for c in edges)


def test_report_tells_rewrites(spark):
    for name in ("orders", "customer"):
        spark.sql("select 1L o_custkey, 2L o_orderkey, 3D o_totalprice" if name == "orders" else "select 1L c_custkey, 'n' c_name, 1 c_nationkey, 1D c_acctbal, 'BUILDING' c_mktsegment").createOrReplaceTempView(name)
    run = compile_workflow(spark, parse_text(Q.WIDE))
    assert run.joins == {5: "left"}
    assert "left join" in markdown(run)


def test_formula_positions_and_null_filter(ctx, spark):
    df = spark.sql("select * from values (1, 'a'), (2, null) t(id, s)")
    out = TOOLS["formula"]({"Input": df}, Q.fields(("S", "[s] + 'x'"), ("n", "[id] * 2", "Int32")), ctx)["Output"]
    assert out.columns == ["id", "s", "n"]
    sides = TOOLS["filter"]({"Input": df}, {"Expression": "[s] = 'a'"}, ctx)
    assert sides["True"].count() == 1
    assert sides["False"].count() == 0
    ctx.options["null_to_false"] = True
    assert TOOLS["filter"]({"Input": df}, {"Expression": "[s] = 'a'"}, ctx)["False"].count() == 1


def test_clashing_names(ctx, spark):
    a, b = spark.sql("select 1 k, 'l' v"), spark.sql("select 1 k, 'r' v")
    assert TOOLS["join"]({"Left": a, "Right": b}, Q.on(["k"], ["k"]), ctx)["Join"].columns == ["k", "v", "Right_k", "Right_v"]
    assert TOOLS["append_fields"]({"Source": b, "Targets": a}, {}, ctx)["Output"].columns == ["k", "v", "Source_k", "Source_v"]


def test_stubs_and_handlers(spark, ctx):
    flow = Flow()
    a = flow.add("text_input", {"Fields": {"Field": {"name": "x"}}, "Data": {"r": {"c": "1"}}})
    flow.add("mystery", {}, a)
    with pytest.raises(ToolError, match="no handler"):
        compile_workflow(spark, flow.workflow())
    run = compile_workflow(spark, flow.workflow(), context=Context(spark, allow_stubs=True))
    assert run.stubs == [2]
    assert run.output(2).count() == 1
    register_tool("mystery", lambda inputs, config, c: {"Output": inputs["Input"].withColumn("y", F.lit(2))})
    assert compile_workflow(spark, flow.workflow()).output(2).columns == ["x", "y"]
    from weftline.plans import registry

    registry.HANDLERS.pop("mystery")


def test_registry(spark, tmp_path):
    r = Registry(tmp_path / "tools.json")
    r.put("A.Odd.Odd", "select x, x || '!' as y from {input0}", {"a": 1})
    flow = Flow()
    a = flow.add("text_input", {"Fields": {"Field": {"name": "x"}}, "Data": {"r": {"c": "1"}}})
    flow.add("A.Odd.Odd", {}, a)
    assert compile_workflow(spark, flow.workflow(), registry=r).output(2).first().y == "1!"
    assert r.get("A.Odd.Odd").uses == 1
    threads = [threading.Thread(target=r.put, args=(f"p{i}", "select 1")) for i in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(r.all()) == 21
    (tmp_path / "tools.json").write_text("{")
    assert r.get("p1") is None
    assert r.clear() == 0
    assert json.loads((tmp_path / "tools.json").read_text()) == {}


def test_macro_expansion(spark, tmp_path):
    inner = Q.document([Q.node(1, "F.MacroInput.MacroInput", "<Name>In</Name>"), Q.node(2, "F.Formula.Formula", '<FormulaFields><FormulaField expression="[x] + \'?\'" field="x" /></FormulaFields>'), Q.node(3, "F.MacroOutput.MacroOutput", "<Name>Out</Name>")], [Q.edge("1:Output", "2:Input"), Q.edge("2:Output", "3:Input")])
    (tmp_path / "Own.yxmc").write_text(inner)
    flow = Flow()
    a = flow.add("text_input", {"Fields": {"Field": {"name": "x"}}, "Data": {"r": {"c": "1"}}})
    flow.add("macro", {}, a, macro="Own.yxmc")
    assert compile_workflow(spark, flow.workflow(), macro_dirs=[tmp_path]).output(2).first().x == "1?"


def test_repair_columns(spark):
    flow = Flow()
    a = flow.add("text_input", {"Fields": {"Field": [{"name": "x"}, {"name": "y"}]}, "Data": {"r": {"c": ["1", "2"]}}})
    s = flow.add("select", Q.selecting(Q.keep("x"), {"field": "y", "selected": "False"}), a)
    flow.add("formula", Q.fields(("z", "[x] + [y]")), s)
    with pytest.raises(ValueError, match="no column"):
        compile_workflow(spark, flow.workflow())
    assert compile_workflow(spark, flow.workflow(), repair_columns=True).output(3).first().z == "12"


def test_output_and_cli(spark, tmp_path, capsys):
    spark.sql("select 'R' l_returnflag, timestamp '1995-02-03' l_shipdate, 40D l_quantity, 200D l_extendedprice, 0.5D l_discount").createOrReplaceTempView("lineitem")
    (tmp_path / "a.yxmd").write_text(Q.SHIPPED)
    assert main([str(tmp_path), "--dry-run"]) == 0
    assert "7 tools" in capsys.readouterr().out
    assert main([str(tmp_path / "a.yxmd"), "--output-dir", str(tmp_path / "out"), "--no-registry"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/a/tool_7")).first().largest == 100
    assert "Summarize" in (tmp_path / "out/a_docs.md").read_text() or "summarize" in (tmp_path / "out/a_docs.md").read_text()
    assert main([str(tmp_path / "none.yxmd")]) == 2


def test_hooks(spark, tmp_path, monkeypatch, capsys):
    """An expression that can't be compiled, a tool that nothing knows and the report's text, from a module of the user."""
    asked = []
    ctx = Context(spark, {"HOME": "/h"}, rewrite=lambda said, schema: asked.append((said, schema.names)) or "x * 2")
    df = spark.sql("select 3 x")
    out = TOOLS["formula"]({"Input": df}, Q.fields(("y", "Mystery([x])"), ("z", "GetEnvironmentVariable('HOME')")), ctx)["Output"].first()
    assert (out.y, out.z) == (6, "/h")
    assert asked == [("Mystery([x])", ["x"])]
    with pytest.raises(ValueError, match="(?i)mystery"):
        TOOLS["formula"]({"Input": df}, Q.fields(("y", "Mystery([x])")), Context(spark))
    (tmp_path / "own_hooks.py").write_text("def fallback(tool, inputs, ctx):\n    return {'Output': inputs['Input'].limit(0)}\n\ndef narrate(run):\n    return 'told by a hook'\n")
    monkeypatch.syspath_prepend(tmp_path)
    (tmp_path / "b.yxmd").write_text(Q.document([Q.node(1, "TextInput", '<Fields><Field name="x" /></Fields><Data><r><c>1</c></r></Data>'), Q.node(2, "Odd", "")], [Q.edge("1:Output", "2:Input")]))
    assert main([str(tmp_path / "b.yxmd"), "--output-dir", str(tmp_path / "out"), "--no-registry", "--hooks", "own_hooks"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/b/tool_2")).count() == 0
    assert "told by a hook" in (tmp_path / "out/b_docs.md").read_text()


def test_jdbc(spark, ctx):
    """Over the database that comes with Spark, kept in memory."""
    url = "jdbc:derby:memory:weftline;create=true"
    spark.range(5).selectExpr("id K", "id * 2 V").write.format("jdbc").option("url", url).option("dbtable", "T").save()
    flow = Flow()
    a = flow.add("db_file_input", {"File": f"{url}|||select K, V from T where V > 2"})
    b = flow.add("db_file_input", {"File": f"{url}|||T"})
    run = compile_workflow(spark, flow.workflow())
    assert sorted(tuple(r) for r in run.output(a).collect()) == [(2, 4), (3, 6), (4, 8)]
    assert run.output(b).count() == 5


def test_union_by_position_pads(ctx, spark):
    a, b = spark.sql("select 1 x"), spark.sql("select 2 p, 'q' X, 3.5D z")
    out = TOOLS["union"]({"#1": a, "#2": b}, {"Mode": "ByPos"}, ctx)["Output"]
    assert out.columns == ["x", "X_2", "z"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, None), (2, "q", 3.5)]
    assert any("missing" in w for w in ctx.warnings)


def test_duplicates_without_keys(ctx, spark):
    df = spark.sql("select * from values (1, null), (1, null), (1, null), (2, 'a'), (null, null), (null, null) t(a, b)")
    out = TOOLS["unique"]({"Input": df}, {}, ctx)
    assert sorted(map(tuple, out["Unique"].collect()), key=repr) == [(1, None), (2, "a"), (None, None)]
    assert sorted(map(tuple, out["Duplicates"].collect()), key=repr) == [(1, None), (1, None), (None, None)]


def test_multi_row_over_runs(ctx, spark, monkeypatch):
    """Windows over runs of rows give what one window over all rows gives."""
    from pyspark.sql import Window

    from weftline.operators import rows

    monkeypatch.setattr(rows, "RUN", 7)
    df = ctx.ordered(spark.range(50).selectExpr("id", "if(id % 5 = 0, null, id * id) v"), [("id", True)])
    w = Window.orderBy("id")
    for others, edge in (("Null", None), ("Empty", 0), ("Closest", "v")):
        got = TOOLS["multi_row_formula"]({"Input": df}, {"CreateField_Name": "x", "CreateField_Type": "Double", "OtherRows": others, "Expression": "[Row-3:v] + [Row+2:v]"}, ctx)["Output"]
        back, ahead = F.lag("v", 3).over(w), F.lead("v", 2).over(w)
        if edge == 0:
            back, ahead = F.when(F.col("id") < 3, 0).otherwise(back), F.when(F.col("id") > 47, 0).otherwise(ahead)
        elif edge:
            back, ahead = F.when(F.col("id") < 3, F.lit(None)).otherwise(back), F.when(F.col("id") > 47, F.lit(49 * 49)).otherwise(ahead)
        want = df.select("id", (back + ahead).alias("x")).collect()
        assert sorted((r.id, r.x) for r in got.collect()) == [(r.id, r.x) for r in want]
    got = TOOLS["multi_row_formula"]({"Input": df}, {"CreateField_Name": "x", "CreateField_Type": "Double", "Expression": "IIF([v] > 100, [Row-1:x], [Row-1:x] + [id])"}, ctx)["Output"]
    want, total = [], 0
    for r in df.collect():
        total += 0 if r.v is not None and r.v > 100 else r.id
        want.append((r.id, total))
    assert sorted((r.id, r.x) for r in got.collect()) == want


def test_tiles_over_all_rows(ctx, spark):
    for n, tiles in ((10, 4), (3, 5), (12, 4), (0, 3)):
        df = ctx.ordered(spark.range(n), [("id", True)])
        got = TOOLS["tile"]({"Input": df}, {"NumTiles": str(tiles)}, ctx)["Output"]
        want = [tuple(r) for r in spark.sql(f"select id, ntile({tiles}) over (order by id) t from range({n}) order by id").collect()]
        assert sorted((r.id, r.Tile_Num) for r in got.collect()) == want


def test_reshaping_odd_rows(ctx, spark):
    df = spark.sql("select * from values ('a b', 1), (null, 2), ('a-b', null), ('a b', 3) t(h, v)")
    tab = TOOLS["cross_tab"]({"Input": df}, {"HeaderField": {"field": "h"}, "DataField": {"field": "v"}, "Methods": {"Method": [{"method": "Sum"}]}}, ctx)["Output"]
    assert tab.columns == ["Null", "a_b", "a_b_"]
    assert tuple(tab.first()) == (2, 4, None)
    assert TOOLS["cross_tab"]({"Input": df.limit(0)}, {"HeaderField": {"field": "h"}, "DataField": {"field": "v"}}, ctx)["Output"].count() == 0
    rows = TOOLS["transpose"]({"Input": df}, {"DataFields": {"Field": [{"field": "*Unknown", "selected": "True"}]}}, ctx)["Output"]
    assert sorted(map(tuple, rows.collect()), key=repr)[:2] == [("h", "a b"), ("h", "a b")]
    named = TOOLS["dynamic_rename"]({"Input": ctx.ordered(spark.sql("select * from values (1, 'x', null), (1, 'x', null), (2, 'y', 'z') t(a, b, c)"), [("a", True)])}, {"RenameMode": "FirstRow"}, ctx)["Output"]
    assert named.columns == ["1", "x", "c"]
    assert sorted(map(tuple, named.collect())) == [(1, "x", None), (2, "y", "z")]


def test_streaming(spark, tmp_path):
    from weftline.streaming import apply

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    ctx = Context(spark)
    out = apply("filter", apply("formula", stream, Q.fields(("x", "[id] * 2")), ctx)["Output"], {"Expression": "[x] > 2"}, ctx)["True"]
    q = out.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == 3
    with pytest.raises(ToolError):
        apply("sort", stream, {}, ctx)
