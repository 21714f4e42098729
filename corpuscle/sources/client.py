"""A model client over recorded results: the calls of the chat and batch workflows, without a network."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.batch import join_requests, standard_results

#: Tokens of an answer at most, where a provider asks for the number.
MAX_TOKENS = 4096


def chat_id(messages: list[dict]) -> str:
    """The id under which the answer to a conversation is recorded."""
    return "chat_" + hashlib.sha256(json.dumps([[m["role"], m["content"]] for m in messages]).encode()).hexdigest()


class ReplayClient:
    """Answers come from a table of raw result lines (provider, raw), as a provider returned them; those of chats are recorded under
    chat_id() of their messages. Submitted batches are JSON lines below `folder`, one folder a batch, so another session finds them."""

    def __init__(self, spark: SparkSession, model: str, recorded: DataFrame, folder: str):
        self.spark, self.model, self.folder = spark, model, folder
        self.recorded = recorded
        self.results = standard_results(recorded)
        self.queue: list[dict] = []

    # conversations

    @staticmethod
    def craftConversationHistory(user_message: str, assistant_message: str) -> dict:  # noqa: N802  the name of the public API
        """A conversation of a user's message and its answer."""
        return {"messages": [{"role": "user", "content": user_message}, {"role": "assistant", "content": assistant_message}]}

    @staticmethod
    def _asked(prompt: str, conversation_history: dict | None) -> list[dict]:
        return [*(conversation_history or {}).get("messages", []), {"role": "user", "content": prompt}]

    def chat(self, prompt: str, conversation_history: dict | None = None) -> tuple[str, dict]:
        """The recorded answer, and the conversation with prompt and answer added; the history given stays as it is. LookupError if no
        answer is recorded."""
        messages = self._asked(prompt, conversation_history)
        row = self.results.where(F.col("custom_id") == chat_id(messages)).select("response").first()
        if row is None or row["response"] is None:
            raise LookupError("no answer is recorded for this conversation")
        return row["response"], {"messages": [*messages, {"role": "assistant", "content": row["response"]}]}

    # the queue

    def add_to_batch_queue(self, prompt: str, custom_id: str | None = None, conversation_history: dict | None = None, **more: object) -> str:
        """Queues a request and gives its id, a new one if none is given; `more` goes into its body. Reasoning models get no temperature."""
        custom_id = custom_id or str(uuid.uuid4())
        body = {"model": self.model, "messages": self._asked(prompt, conversation_history), "max_tokens": MAX_TOKENS}
        if not any(x in self.model.lower() for x in ("o1", "o3")):
            body["temperature"] = 0.0
        self.queue.append({"custom_id": custom_id, "method": "POST", "url": "/v1/chat/completions", "body": body | more})
        return custom_id

    def get_batch_queue(self) -> list[dict]:
        return list(self.queue)

    def get_batch_queue_size(self) -> int:
        return len(self.queue)

    def clear_batch_queue(self) -> None:
        self.queue = []

    def remove_from_batch_queue(self, custom_id: str) -> bool:
        before = len(self.queue)
        self.queue = [r for r in self.queue if r["custom_id"] != custom_id]
        return len(self.queue) < before

    # batches

    def submit_batch_request(self, batch_name: str | None = None, metadata: dict | None = None) -> str:
        """Writes the queue as a batch with its name, metadata and time, empties it, and gives the batch's id. An empty queue raises."""
        if not self.queue:
            raise ValueError("the queue is empty")
        batch = f"batch_{uuid.uuid4().hex}"
        told = {"name": batch_name, "metadata": metadata or {}, "created_at": int(time.time())}
        self._lines([json.dumps(r) for r in self.queue], f"{self.folder}/{batch}/requests")
        self._lines([json.dumps(told)], f"{self.folder}/{batch}/about")
        self.clear_batch_queue()
        return batch

    def _lines(self, lines: list[str], path: str) -> None:
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)

    def requests(self, batch: str) -> DataFrame:
        return self.spark.read.text(f"{self.folder}/{batch}/requests").select(F.get_json_object("value", "$.custom_id").alias("custom_id"))

    def check_batch_status(self, batch: str) -> dict:
        """Counts of a batch's requests that have a recorded result; completed when none is open. Nobody recorded when it ended."""
        about = json.loads(self.spark.read.text(f"{self.folder}/{batch}/about").first()["value"])
        rows = self.requests(batch).join(join_requests(self.results, self.requests(batch)), "custom_id", "left")
        r = rows.agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("completed"), F.count_if("failed").alias("failed")).first()
        left = r["total"] - r["completed"] - r["failed"]
        status = "in_progress" if left else "completed"
        return {"status": status, "progress": {**r.asDict(), "processing": left}, "created_at": about["created_at"], "completed_at": None, "provider_raw": about}

    def download_batch_results(self, batch: str, save_to_file: bool = False, file_path: str | None = None) -> DataFrame:
        """custom_id, response, error, tokens and the provider's line (provider_raw) of a batch's requests. With save_to_file they are
        written as JSON lines, to a folder of the batch if none is named. ValueError while requests are open."""
        if self.check_batch_status(batch)["status"] != "completed":
            raise ValueError(f"{batch} is not completed")
        raw = self.recorded.select(F.get_json_object("raw", "$.custom_id").alias("custom_id"), F.col("raw").alias("provider_raw"))
        out = self.results.join(raw, "custom_id").join(self.requests(batch), "custom_id", "left_semi")
        if save_to_file:
            out.write.mode("overwrite").json(file_path or f"{self.folder}/{batch}/results")
        return out

