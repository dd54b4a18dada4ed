"""Calls of a slow function from tasks, that end: a bound on those in flight, a time limit, retries, and answers kept by question.

A call that is over its limit is given up: its thread goes on as a daemon, and what it returns late is dropped. Threads are used again, as one
a prompt would cost more than a quick answer. With a folder that
driver and executors share, an answer is written under the digest of its question before it is used, so a task that runs again, or a
second run, asks only what was never answered.
"""

from __future__ import annotations

import hashlib
import json
import math
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs

Client = Callable[[str], str | None]


@dataclass(frozen=True)
class Limits:
    """seconds of one attempt (180 suit large models), attempts, calls in flight per task, and the pause before the second attempt, which doubles."""

    seconds: float = 90.0
    attempts: int = 2
    in_flight: int = 8
    pause: float = 1.0


class Answers:
    """Answers in a folder, one file a question."""

    def __init__(self, uri: str | None):
        self.uri = uri
        if uri:
            self.fs, self.top = pa.fs.FileSystem.from_uri(uri)
            self.fs.create_dir(self.top, recursive=True)

    def _place(self, prompt: str) -> str:
        return f"{self.top}/{hashlib.sha256(prompt.encode()).hexdigest()}.json"

    def get(self, prompt: str) -> str | None:
        if not self.uri or self.fs.get_file_info(self._place(prompt)).type != pa.fs.FileType.File:
            return None
        with self.fs.open_input_stream(self._place(prompt)) as f:
            return json.loads(f.read())["answer"]

    def put(self, prompt: str, answer: str) -> None:
        """The file appears whole or not at all; of two writers the last one stays."""
        if not self.uri:
            return
        place = self._place(prompt)
        beside = f"{place}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps({"answer": answer}).encode())
        self.fs.move(beside, place)


class _Round:
    """One attempt at each prompt by a few threads that take one prompt after the other; a thread whose call is over its limit is given up and replaced."""

    def __init__(self, client: Client, prompts: list[str], turn: int, limits: Limits, answers: Answers):
        self.client, self.turn, self.limits, self.answers = client, turn, limits, answers
        self.waiting = deque(prompts)
        self.found: dict[str, str | None] = {}
        self.changed = threading.Condition()
        self.running: dict[threading.Thread, tuple[str, float]] = {}  # its prompt, and when its call must have ended

    def _begin(self) -> None:
        """A new thread with the next prompt; the lock is held."""
        thread = threading.Thread(target=self._work, daemon=True)
        self.running[thread] = (self.waiting.popleft(), math.inf)
        thread.start()

    def _work(self) -> None:
        me = threading.current_thread()
        while True:
            with self.changed:
                prompt = self.running[me][0]
            answer = None
            try:
                answer = self.answers.get(prompt) if not self.turn else None
                if answer is None and self.turn < self.limits.attempts:
                    with self.changed:
                        self.running[me] = (prompt, time.monotonic() + self.limits.seconds)
                    try:
                        answer = self.client(prompt)
                    except Exception:  # whatever a client raises is no answer
                        answer = None
                    with self.changed:
                        if me not in self.running:  # given up: too late
                            return
                        self.running[me] = (prompt, math.inf)
                    if answer is not None:
                        self.answers.put(prompt, answer)
            except Exception:  # the folder fails: no answer
                answer = None
            with self.changed:
                self.found[prompt] = answer
                if not self.waiting:
                    del self.running[me]
                    self.changed.notify()
                    return
                self.running[me] = (self.waiting.popleft(), math.inf)

    def run(self) -> dict[str, str | None]:
        with self.changed:
            while self.waiting and len(self.running) < self.limits.in_flight:
                self._begin()
            while self.running:
                now = time.monotonic()
                for thread, (prompt, end) in list(self.running.items()):
                    if end <= now:
                        del self.running[thread]
                        self.found[prompt] = None
                        if self.waiting:
                            self._begin()
                if self.running:  # a call that begins from now on ends no sooner than its whole limit
                    self.changed.wait(min(max(min(end for _, end in self.running.values()) - now, 0.001), self.limits.seconds))
        return self.found


def ask_all(client: Client, prompts: list[str], limits: Limits = Limits(), folder: str | None = None) -> list[str | None]:
    """The answers in the order of the prompts, None where there is none after all attempts. Equal prompts are asked once.

    What got no answer is asked again when all others have had their turn, so the pause is waited once an attempt and not once a prompt.
    """
    answers = Answers(folder)
    found: dict[str, str | None] = {}
    left = list(dict.fromkeys(prompts))
    for turn in range(max(limits.attempts, 1)):
        if turn and left:
            time.sleep(limits.pause * 2 ** (turn - 1))
        found |= _Round(client, left, turn, limits, answers).run()
        left = [p for p in left if found.get(p) is None]
    return [found.get(p) for p in prompts]
