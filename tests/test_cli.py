"""From a folder of sources to answers."""

import zipfile

import pytest

from loomgraph import cli
from loomgraph.sources import office, scip


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    (root / "app.py").write_text("from lib import helper\n\ndef main():\n    helper()\n    second()\n\ndef second():\n    helper()\n")
    (root / "lib.py").write_text("def helper():\n    return 1\n\ndef _unused():\n    _unused()\n    return 2\n")
    (root / "README.md").write_text("# Title\n\n## Usage\n")
    (root / ".env").write_text("SECRET=1")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("def hidden(): pass")
    path = str(tmp_path_factory.mktemp("graph"))
    cli.main(["extract", str(root), path])
    return path


def run(capsys, *argv):
    cli.main(list(argv))
    return capsys.readouterr().out


def test_commands(spark, built, capsys, tmp_path):
    assert "helper" in run(capsys, "query", built, "where is helper?")
    assert "app_main" in run(capsys, "affected", built, "lib_helper") and "app_second" in run(capsys, "blast-radius", built, "lib_helper") + run(capsys, "affected", built, "lib_helper")
    assert "app_main -> lib_helper" in run(capsys, "path", built, "app_main", "lib_helper")
    assert "hidden" not in run(capsys, "gods", built) and run(capsys, "explain", built, "app_main")
    assert run(capsys, "diff", built, built) == ""
    assert "# Graph report" in run(capsys, "report", built) and run(capsys, "stats", built) and run(capsys, "diagnose", built)
    for kind in ("json", "cypher", "graphml", "wiki"):
        run(capsys, "export", built, kind, f"{tmp_path}/{kind}")
        assert spark.read.text(f"{tmp_path}/{kind}").count() > 0
    run(capsys, "merge", built, built, f"{tmp_path}/m")
    assert run(capsys, "diff", built, f"{tmp_path}/m") == ""
    with pytest.raises(SystemExit):
        run(capsys, "explain", built, "nobody by this name")


def test_office(tmp_path):
    docx = tmp_path / "a.docx"
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Top</w:t></w:p><w:p><w:t>Body </w:t><w:t>text</w:t></w:p></w:d>')
    assert office.office_text("a.docx", docx.read_bytes()) == "# Top\n\nBody text"
    xlsx = tmp_path / "b.xlsx"
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/workbook.xml", '<w><sheets><sheet name="S"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<w><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></w>')
    assert "| name | 5 |" in office.office_text("b.xlsx", xlsx.read_bytes())
    assert office.office_text("c.docx", b"not a zip") == ""


def test_scip(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"documents": [{"relative_path": "a.py", "symbols": [{"symbol": "A", "relationships": [{"symbol": "B", "is_implementation": true}, {"symbol": "gone"}]}]}, {"relative_path": "b.py", "symbols": [{"symbol": "B"}]}]}')
    nodes, edges = scip.read_scip(spark, f"{tmp_path}/i.json")
    assert {r["id"] for r in nodes.collect()} == {"a.py#A", "b.py#B", "stub:gone"}
    assert {tuple(r) for r in edges.collect()} == {("a.py#A", "b.py#B", "scip_impl"), ("a.py#A", "stub:gone", "scip_ref")}


def test_more_commands(spark, built, capsys, tmp_path):
    assert "hidden" not in run(capsys, "gods", built, "--by", "pagerank") and "tokens of text" in run(capsys, "benchmark", built, "helper")
    for kind, mark in (("svg", "<svg"), ("html", "<input"), ("callflow-html", "flowchart"), ("wiki", "# Index")):
        run(capsys, "export", built, kind, f"{tmp_path}/{kind}")
        assert any(mark in r["value"] for r in spark.read.text(f"{tmp_path}/{kind}").collect())
    run(capsys, "export", built, "lines", f"{tmp_path}/lines")
    run(capsys, "tree", built, f"{tmp_path}/tree")
    assert "<ul>" in spark.read.text(f"{tmp_path}/tree", wholetext=True).first()["value"]
    with pytest.raises(SystemExit):
        run(capsys, "export", built, "nothing", f"{tmp_path}/x")
    assert run(capsys, "global-add", f"{tmp_path}/g", built, "one").strip() == "0" and run(capsys, "global-add", f"{tmp_path}/g", built, "one").strip() == "unchanged"
    run(capsys, "global-add", f"{tmp_path}/g", built, "two")
    assert [line.split("\t")[0] for line in run(capsys, "global-list", f"{tmp_path}/g").splitlines()] == ["one", "two"]
    run(capsys, "global-remove", f"{tmp_path}/g", "one")
    assert [line.split("\t")[0] for line in run(capsys, "global-list", f"{tmp_path}/g").splitlines()] == ["two"]
    run(capsys, "merge-chunks", f"{tmp_path}/c", built, built)
    assert spark.read.parquet(f"{tmp_path}/c/nodes").count() == spark.read.parquet(f"{built}/nodes").count()
    run(capsys, "merge-driver", built, f"{tmp_path}/c", built)
    run(capsys, "save-result", f"{tmp_path}/m", "where is it?", "there", "lib_helper", "--outcome", "useful")
    run(capsys, "save-result", f"{tmp_path}/m", "and now?", "there", "lib_helper", "--outcome", "useful")
    assert "preferred" in run(capsys, "reflect", f"{tmp_path}/m", built)
    assert run(capsys, "add", "https://arxiv.org/abs/1706.03762", f"{tmp_path}/urls").strip() == "arxiv"
    assert run(capsys, "label", built)


def test_tools(spark, built, tmp_path):
    import io
    import json

    from loomgraph import server

    prs = spark.createDataFrame([(1, "a", "main", "SUCCESS", "APPROVED", False, 1, "app.py"), (2, "b", "main", "FAILURE", None, False, 2, "lib.py"), (3, "c", "dev", "SUCCESS", None, False, 2, "lib.py")], "number long, title string, base string, ci string, review string, draft boolean, days_old int, path string")
    tools = server.Tools(spark, lambda: (*cli.load(spark, built), cli.communities(spark, built)), f"{tmp_path}/m", prs)

    def call(name, **arguments):
        found = tools.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
        return ("error: " if found.get("isError") else "") + found["content"][0]["text"]

    assert "helper" in call("query_graph", question="where is helper?") and "lib_helper" in call("get_node", label="lib_helper")
    assert "calls" in call("get_neighbors", label="app_main", relation_filter="calls") and call("get_community", community_id=0) != "nothing"
    assert call("god_nodes") and "nodes: " in call("graph_stats") and call("dead_code")
    assert "app_main" in call("blast_radius", label="lib_helper") and "->" in call("shortest_path", source="main", target="helper")
    assert call("save_result", question="q", answer="a", nodes=["lib_helper"], outcome="useful") == "saved" and call("save_result", question="q", answer="a", outcome="odd").startswith("error")
    assert [line.split()[0] for line in call("list_prs").splitlines()] == ["3", "2", "1"] and [line.split()[0] for line in call("triage_prs").splitlines()] == ["2", "1"]
    assert call("get_pr_impact", number=2).split()[0] == "2" and call("get_node", label="nobody at all").startswith("error") and call("get_node").startswith("error")
    for name in tools.resources:
        assert tools.handle({"id": 2, "method": "resources/read", "params": {"uri": f"graph://{name}"}})["result"]["contents"][0]["text"]
    sink = io.StringIO()
    server.serve_lines(tools, io.StringIO('{"jsonrpc": "2.0", "id": 1, "method": "initialize"}\nnot json\n{"method": "notifications/initialized"}\n{"id": 3, "method": "tools/list"}\n{"id": 4, "method": "odd"}\n'), sink)
    answers = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, None, 3, 4] and len(answers[2]["result"]["tools"]) == 13 and "error" in answers[3]


def test_tools_over_http(spark, built):
    import json
    import threading
    import urllib.error
    import urllib.request

    from loomgraph import server

    s = server.http_server(server.Tools(spark, lambda: (*cli.load(spark, built), cli.communities(spark, built))), port=0, key="k")
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def post(key):
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}/mcp", json.dumps({"id": 1, "method": "ping"}).encode(), {"Authorization": f"Bearer {key}"})
        return json.loads(urllib.request.urlopen(r, timeout=10).read())

    assert post("k") == {"jsonrpc": "2.0", "id": 1, "result": {}}
    with pytest.raises(urllib.error.HTTPError):
        post("other")
    s.shutdown()
