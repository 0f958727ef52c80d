"""A client of the image backend that runs where Spark deals the requests.

The transport is a function (method, url, body) -> (status, bytes), given by the caller and sent to the executors; it
raises OSError where the backend can't be reached. A function (url) -> connection, if given, opens a socket of the
request's own before its run is submitted, and the run's end message is waited for there; text messages are JSON,
others are passed over. Without one, the runs' histories are polled. A task submits many runs before it waits, so it
takes as long as the slowest of them. Where no task should wait at all, `submit_runs` and `fetch_results` are steps of
their own, with `streaming.runs` between them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.config import Settings

Transport = Callable[[str, str, bytes | None], tuple[int, bytes]]


class Connection(Protocol):
    """An open socket: `recv` gives the next message, and raises OSError or StopIteration when no more come."""

    def recv(self) -> str | bytes: ...

    def close(self) -> None: ...


Connect = Callable[[str], Connection]
#: Runs that a task has under way at once.
WIDTH = 100


def queue_payload(workflow: Column, client_id: Column) -> Column:
    """What a run is submitted with; workflow is JSON."""
    return F.concat(F.lit('{"prompt":'), workflow, F.lit(',"client_id":"'), client_id, F.lit('"}'))


def view_url(base: str, filename: Column, subfolder: Column, kind: Column) -> Column:
    one = lambda name, c: F.concat(F.lit(name + "="), F.url_encode(c))
    return F.concat(F.lit(f"{base}/view?"), one("filename", filename), F.lit("&"), one("subfolder", subfolder), F.lit("&"), one("type", kind))


def _first_image(outputs: dict) -> dict:
    for node in outputs.values():
        if "images" in node:
            if not node["images"]:
                raise ValueError("empty list of images")
            return node["images"][0]
    raise ValueError("no output images")


def _ends(message: str | bytes, run: str) -> bool:
    """Whether a message says that nothing of the run is executing any more."""
    if not isinstance(message, str):
        return False
    found = json.loads(message)
    return found["type"] == "executing" and found["data"]["node"] is None and found["data"].get("prompt_id") == run


def _submit(payload: str, base: str, send: Transport) -> str:
    status, body = send("POST", f"{base}/prompt", payload.encode())
    if status != 200:
        raise ValueError(f"backend refused the run: {body.decode(errors='replace')}")
    return json.loads(body)["prompt_id"]


def _history(run: str, base: str, send: Transport) -> dict | None:
    """The run's record, once it has one."""
    return json.loads(send("GET", f"{base}/history/{run}", None)[1]).get(run)


def _image(record: dict, base: str, send: Transport) -> bytes:
    image = _first_image(record["outputs"])
    status, body = send("GET", f"{base}/view?" + urlencode({k: image[k] for k in ("filename", "subfolder", "type")}), None)
    if status != 200:
        raise ValueError("the result image can't be had")
    return body


def _opened(connect: Connect, url: str) -> Connection:
    found = connect(url)
    if not hasattr(found, "recv"):
        raise TypeError("connect must return an open connection; a generator opens nothing before it is read")
    return found


def _await_end(connection: Connection, run: str) -> None:
    try:
        while not _ends(connection.recv(), run):
            pass
    except StopIteration:
        raise ValueError(f"run {run}: the messages stopped before its end") from None


class _Runs:
    """Requests of a task that are under way together: all are submitted, then all are waited for."""

    def __init__(self, base: str, socket: str, send: Transport, connect: Connect | None):
        self.base, self.socket, self.send, self.connect = base, socket, send, connect
        self.out: list[tuple] = []
        self.open: dict[int, tuple] = {}

    def attempt(self, request: object, step: Callable[[], object]) -> object:
        """What the step gives; None where it failed, which is then the request's answer."""
        try:
            return step()
        except OSError as e:
            self.out.append((request, None, f"connection: {e}"))
        except (ValueError, KeyError) as e:
            self.out.append((request, None, str(e)))
        return None

    def submit(self, request: object, payload: str) -> None:
        client, connection = str(uuid.uuid4()), None
        if self.connect and (connection := self.attempt(request, lambda: _opened(self.connect, f"{self.socket}?clientId={client}"))) is None:
            return
        run = self.attempt(request, lambda: _submit(client.join(payload.rsplit("__client__", 1)), self.base, self.send))
        if run is not None:
            self.open[len(self.open)] = (request, run, connection)
        elif connection:
            connection.close()

    def finish(self, tries: int | None, pause: float) -> list[tuple]:
        for k, (request, run, connection) in list(self.open.items()):
            if connection:
                if self.attempt(request, lambda: (_await_end(connection, run), True)) is None:  # noqa: B023
                    del self.open[k]
                connection.close()
        rounds = 0
        while self.open:
            for k, (request, run, _) in list(self.open.items()):
                record = self.attempt(request, lambda: (_history(run, self.base, self.send),))  # noqa: B023
                if record is None or record[0] is not None:
                    del self.open[k]
                if record and record[0] is not None and (image := self.attempt(request, lambda: _image(record[0], self.base, self.send))) is not None:  # noqa: B023
                    self.out.append((request, image, None))
            rounds += 1
            if self.open and tries is not None and rounds >= tries:
                self.out += [(request, None, f"run {run} hasn't ended") for request, run, _ in self.open.values()]
                break
            if self.open:
                time.sleep(pause)
        return self.out


def remote_backend(settings: Settings, send: Transport, tries: int | None = None, pause: float = 1.0, connect: Connect | None = None, width: int = WIDTH) -> Callable[[DataFrame], DataFrame]:
    """A backend for `requests.inpaint`: from (request_id, workflow, ...) to (request_id, result, failed). Each request
    has a client of its own. tries: rounds of polling until what hasn't ended fails; by default there is no limit."""
    base, socket = settings.http_url, settings.ws_url

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), width):
                runs = _Runs(base, socket, send, connect)
                for r in pdf.iloc[at : at + width].itertuples(index=False):
                    runs.submit(r.request_id, r.payload)
                yield pd.DataFrame(runs.finish(tries, pause), columns=["request_id", "result", "failed"])

    def backend(ready: DataFrame) -> DataFrame:
        return _payloads(ready).mapInPandas(run, f"request_id {_id_kind(ready)}, result binary, failed string")

    return backend


def _id_kind(rows: DataFrame) -> str:
    return rows.schema["request_id"].dataType.simpleString()


def _payloads(ready: DataFrame) -> DataFrame:
    return ready.select("request_id", queue_payload(F.col("workflow"), F.lit("__client__")).alias("payload"))


def submit_runs(ready: DataFrame, settings: Settings, send: Transport) -> DataFrame:
    """(request_id, client_id, prompt_id, ts, failed) of requests (request_id, workflow): every run is submitted, none
    waited for. Write it before it is used twice: a task that runs again submits again."""
    base = settings.http_url

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                client, runs = str(uuid.uuid4()), _Runs(base, "", send, None)
                found = runs.attempt(r.request_id, lambda: _submit(client.join(r.payload.rsplit("__client__", 1)), base, send))  # noqa: B023
                out.append((r.request_id, client, found, pd.Timestamp.now("UTC"), runs.out[0][2] if runs.out else None))
            yield pd.DataFrame(out, columns=["request_id", "client_id", "prompt_id", "ts", "failed"])

    return _payloads(ready).mapInPandas(run, f"request_id {_id_kind(ready)}, client_id string, prompt_id string, ts timestamp, failed string")


def fetch_results(ended: DataFrame, settings: Settings, send: Transport) -> DataFrame:
    """(request_id, result, failed) of runs (request_id, prompt_id) that have ended: one look at each history, and the
    image."""
    base = settings.http_url

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                runs = _Runs(base, "", send, None)
                record = runs.attempt(r.request_id, lambda: (_history(r.prompt_id, base, send),))  # noqa: B023
                if record and record[0] is None:
                    runs.out.append((r.request_id, None, f"run {r.prompt_id} hasn't ended"))
                elif record and (image := runs.attempt(r.request_id, lambda: _image(record[0], base, send))) is not None:  # noqa: B023
                    runs.out.append((r.request_id, image, None))
                out += runs.out
            yield pd.DataFrame(out, columns=["request_id", "result", "failed"])

    return ended.select("request_id", "prompt_id").mapInPandas(run, f"request_id {_id_kind(ended)}, result binary, failed string")
