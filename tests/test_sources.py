"""The replay client, and the text of representations."""

import json

import pytest

from corpuscle.sources import disassembly
from corpuscle.sources.client import ReplayClient, chat_id
from corpuscle.sources.shared import shared_dir


def line(cid, text):
    return ("openai", json.dumps({"custom_id": cid, "response": {"body": {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}}, "error": None}))


def test_queue_and_batches(spark, tmp_path):
    recorded = spark.createDataFrame([line("m_file_0000", "int a;"), line("m_file_0001", ""), line("other", "x")], "provider string, raw string")
    c = ReplayClient(spark, "gpt-4o", recorded, str(tmp_path))
    talk = c.craftConversationHistory("u", "a")
    assert talk == {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}
    for i in range(3):
        assert c.add_to_batch_queue("decompile", f"m_file_{i:04d}", talk) == f"m_file_{i:04d}"
    assert len(talk["messages"]) == 2
    body = c.get_batch_queue()[0]["body"]
    assert c.get_batch_queue_size() == 3 and body["temperature"] == 0.0
    assert body["messages"] == [*talk["messages"], {"role": "user", "content": "decompile"}]
    made = c.add_to_batch_queue("again", top_p=0.5)
    assert c.get_batch_queue()[-1]["custom_id"] == made and c.get_batch_queue()[-1]["body"]["top_p"] == 0.5
    assert c.get_batch_queue()[-1]["body"]["messages"] == [{"role": "user", "content": "again"}]
    assert c.remove_from_batch_queue(made) is True and c.remove_from_batch_queue("none") is False
    batch = c.submit_batch_request("first", {"k": 1})
    assert c.get_batch_queue_size() == 0
    with pytest.raises(ValueError, match="empty"):
        c.submit_batch_request()
    status = c.check_batch_status(batch)
    assert (status["status"], status["progress"]) == ("in_progress", {"total": 3, "completed": 1, "failed": 1, "processing": 1})
    assert status["provider_raw"]["metadata"] == {"k": 1} and status["created_at"] > 0
    with pytest.raises(ValueError, match="not completed"):
        c.download_batch_results(batch)
    for i in range(2):
        c.add_to_batch_queue("decompile", f"m_file_{i:04d}")
    batch = c.submit_batch_request()
    got = c.download_batch_results(batch, save_to_file=True, file_path=str(tmp_path / "saved"))
    assert {(r["custom_id"], r["response"], r["total_tokens"]) for r in got.collect()} == {("m_file_0000", "int a;", 3), ("m_file_0001", "", 3)}
    assert all(json.loads(r["provider_raw"])["custom_id"] == r["custom_id"] for r in got.collect())
    assert spark.read.json(str(tmp_path / "saved")).count() == 2
    c.add_to_batch_queue("x")
    c.clear_batch_queue()
    assert c.get_batch_queue() == []
    reasoning = ReplayClient(spark, "o3-mini", recorded, str(tmp_path))
    reasoning.add_to_batch_queue("m")
    assert "temperature" not in reasoning.get_batch_queue()[0]["body"]


def test_chat_carries_the_conversation(spark, tmp_path):
    first = [{"role": "user", "content": "hi"}]
    second = [*first, {"role": "assistant", "content": "hello"}, {"role": "user", "content": "more"}]
    recorded = spark.createDataFrame([line(chat_id(first), "hello"), line(chat_id(second), "there")], "provider string, raw string")
    c = ReplayClient(spark, "gpt-4o", recorded, str(tmp_path))
    answer, talk = c.chat("hi")
    assert answer == "hello" and talk == c.craftConversationHistory("hi", "hello")
    answer, more = c.chat("more", talk)
    assert answer == "there" and more["messages"][-1] == {"role": "assistant", "content": "there"} and len(talk["messages"]) == 2
    with pytest.raises(LookupError):
        c.chat("something else")


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert shared_dir(Cluster).startswith("file:")


def test_representations(spark):
    text = "Function Name: f\nArchitecture: x86_64\nEntry Point: 0x10\ncode:\n0x10: push rbp\n\n0x11: ret\nplain\n"
    files = spark.createDataFrame([(1, text), (2, "code:\nint f() {}\n"), (3, "")], "id int, content string")
    got = {r["id"]: r for r in disassembly.parse_representation(files).collect()}
    assert (got[1]["function_name"], got[1]["architecture"], got[1]["entry_point"]) == ("f", "x86_64", "0x10")
    assert (got[2]["function_name"], got[2]["code"]) == (None, "int f() {}\n")
    lines = disassembly.code_lines(disassembly.parse_representation(files).where("id = 1")).orderBy("line").collect()
    assert [(r["address"], r["instruction"]) for r in lines] == [("0x10", "push rbp"), ("0x11", "ret"), (None, "plain")]
    good, bad = disassembly.split_empty(files)
    assert (good.count(), bad.first()["id"]) == (2, 3)
    blocks = spark.createDataFrame([("f", "0x100", "c"), ("f", "0x20", "b"), ("f", "0x9", "a")], "name string, start string, text string")
    assert disassembly.listing(blocks).first()["content"] == "a\nb\nc"
    functions = spark.createDataFrame([("a", True, None), ("b", None, False)], "name string, is_plt boolean, is_simprocedure boolean")
    assert [r["name"] for r in disassembly.own_functions(functions).collect()] == ["b"]
    good, bad = disassembly.split_undefined(spark.createDataFrame([("x",), ("",), (None,)], "func_def string"))
    assert (good.count(), bad.count()) == (1, 2)
