import pytest

from millrace.operators import quality
from millrace.plans import agent, tools


def test_tool_validation():
    t = tools.Tool("t", "", lambda a, b: a * b, [tools.Parameter("a", "integer"), tools.Parameter("b", "integer", "", False, 2, (2, 3))])
    assert t(a=4).output == 8 and t(a=4, b=3).output == 12
    assert not t().ok and not t(a="x").ok and not t(a=True).ok and not t(a=1, b=9).ok
    assert t.schema()["parameters"]["required"] == ["a"]
    broken = tools.Tool("b", "", lambda: 1 / 0)
    assert broken().error and "error" in broken().text()
    assert not tools.Registry([t]).run("missing").ok


def test_spark_tools(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    r = tools.spark_tools(spark)
    assert r.run("execute_sql", query="SELECT * FROM five").output["total_rows"] == 5
    assert not r.run("execute_sql", query="DROP TABLE five").ok
    assert r.run("profile_data", table_name="five").output["id"]["max"] == 4
    (tmp_path / "a.txt").write_text("x\ny")
    assert len(r.run("read_file", path=str(tmp_path / "a.txt"), max_lines=1).output) == 1
    assert {s["name"] for s in r.schemas()} == {"execute_sql", "table_info", "profile_data", "read_file"}


def test_agent_with_scripted_client(spark):
    spark.range(7).createOrReplaceTempView("seven")
    script = iter(['Thought: count\nAction: execute_sql\nAction Input: {"query": "SELECT count(*) AS n FROM seven"}', "Thought: done\nAction: Final Answer\nAction Input: seven rows"])
    client = agent.Client(lambda p: next(script))
    answer, trace = agent.solve("how many?", client, tools.spark_tools(spark))
    assert answer == "seven rows" and '"n": 7' in trace[0].observation and client.usage()["calls"] == 2
    assert agent.trace_table(spark, trace).count() == 2
    endless = agent.Client(lambda p: "Thought: x\nAction: nothing\nAction Input: {}")
    answer, trace = agent.solve("x", endless, tools.Registry(), 3)
    assert answer is None and len(trace) == 3


def test_memory_and_chat():
    m = agent.Memory(keep=2)
    for k in range(4):
        m.add("user", str(k))
    m.learn("a")
    m.learn("a")
    m.context["k"] = "v" * 200
    assert [x["content"] for x in m.messages] == ["2", "3"] and m.summary() == "- a\nk: " + "v" * 100

    def fail(prompt):
        raise RuntimeError("down")

    c = agent.Client(lambda p: "ok")
    assert c.chat("hi") == "ok" and len(c.conversations["default"]) == 2
    c.answer = fail
    with pytest.raises(RuntimeError):
        c.chat("again")
    assert len(c.conversations["default"]) == 2


def test_table_expectations_and_parsing(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (None, 2)], "k int, p int")
    checks = [quality.Expectation("u", "k", "unique"), quality.Expectation("r", "p", "referential", "high", {"table": "parent", "key": "id"})]
    got = quality.table_violations(df, checks, {"parent": spark.createDataFrame([(1,), (2,)], "id int")})
    assert {r.name: r.violations for r in got.collect()} == {"u": 1, "r": 1}
    reply = 'Sure: [{"column": "k", "type": "NOT_NULL"}, {"column": "zz", "type": "unique"}, {"column": "p", "type": "in_range", "parameters": {"min": 0}}] ok'
    assert [e.kind for e in quality.parse_expectations(reply, ["k", "p"])] == ["not_null", "in_range"]
    assert quality.parse_expectations("none", ["k"]) == [] and quality.parse_expectations("[bad", ["k"]) == []
