"""Model calls that are made once, however often the job around them is run again."""

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, functions as F

from colloquy.plans.scoring import client_scorer
from colloquy.streaming.runs import for_each_batch


class Ledger:
    """Outcomes of model calls under a folder all executors reach: a small file per call, written as soon as it has ended.

    A call is known by its request and the prompt. A file is put under its name
    when it is whole, so a task that dies leaves an outcome or none; a task
    that runs again reads the outcome instead of asking. Failed calls are
    outcomes too. Speculative tasks would ask side by side: leave them off.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def _path(self, request: dict) -> str:
        name = hashlib.sha256(f"{request['request_id']}\0{request['user_prompt']}".encode("utf-8", "surrogatepass")).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def find(self, request: dict) -> dict | None:
        try:
            with self.system.open_input_stream(self._path(request)) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def keep(self, request: dict, outcome: dict) -> None:
        path = self._path(request)
        part = f"{path}.{uuid.uuid4().hex}"
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(part) as file:
            file.write(json.dumps(outcome).encode())
        self.system.move(part, path)


def asked_once(make_client, folder: str):
    """``make_client`` of clients that look into the ledger at ``folder`` before they ask, and write every outcome there."""
    def make():
        ledger, made = Ledger(folder), []

        def call(request):
            outcome = ledger.find(request)
            if outcome is None:
                if not made:
                    made.append(make_client())
                try:
                    response, usage = made[0](request)
                    outcome = {"response": response, "usage": usage}
                except Exception as problem:
                    outcome = {"error": str(problem) or type(problem).__name__}
                ledger.keep(request, outcome)
            if "error" in outcome:
                raise RuntimeError(outcome["error"])
            return outcome["response"], outcome["usage"]
        return call
    return make


def score_batches(requests: DataFrame, make_client, folder: str, checkpoint: str, live=False):
    """Answer a stream of requests (see ``contexts.with_parameters``) and keep the answers under ``folder``/answers.

    Every micro-batch has a folder of its own, ``batch=<id>``, that a restart
    writes anew, and every call is in the ledger under ``folder``/calls: a
    batch that failed halfway is finished without asking anything twice, and
    its answers are there once.
    """
    score = client_scorer(asked_once(make_client, f"{folder}/calls"))

    def hook(batch, batch_id):
        score(batch).write.mode("overwrite").parquet(f"{folder}/answers/batch={batch_id}")

    return for_each_batch(requests, hook, checkpoint, live)


def answers(spark, folder: str) -> DataFrame:
    """The answers of :func:`score_batches` so far, with the micro-batch of each."""
    return spark.read.parquet(f"{folder}/answers").withColumn("batch", F.col("batch").cast("bigint"))
