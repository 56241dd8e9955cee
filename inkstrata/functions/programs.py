"""Translators that are programs: one process a task, kept open over all its batches, one JSON line each way."""

from __future__ import annotations

import json
import os
import select
import subprocess
import time
from collections.abc import Sequence
from typing import Any


class ProgramError(Exception):
    """The program ended, stayed silent, or answered with an error."""


class Program:
    """A translator behind ``command``.

    A request is a line ``{"id", "command": "translate" or "warmup", "texts",
    "from", "to"}``, an answer a line ``{"id", "translations"}`` or ``{"id",
    "error"}``.  The program is started at the first request of a task.  One that
    ends or stays silent for ``timeout`` seconds is started again once for each
    request; answers to earlier requests are passed over by their number.
    """

    def __init__(self, command: Sequence[str], timeout: float = 60.0) -> None:
        self.command, self.timeout = list(command), timeout
        self._process: subprocess.Popen[bytes] | None = None
        self._rest, self._number = b"", 0

    def __getstate__(self) -> dict[str, Any]:
        return {"command": self.command, "timeout": self.timeout, "_process": None, "_rest": b"", "_number": 0}

    def _line(self, deadline: float) -> bytes:
        out = self._process.stdout.fileno()
        while b"\n" not in self._rest:
            left = deadline - time.monotonic()
            if left <= 0 or not select.select([out], [], [], left)[0]:
                raise ProgramError("no answer in time")
            more = os.read(out, 1 << 16)
            if not more:
                raise ProgramError("the program ended")
            self._rest += more
        line, _, self._rest = self._rest.partition(b"\n")
        return line

    def _exchange(self, request: dict[str, Any]) -> dict[str, Any]:
        if self._process is None or self._process.poll() is not None:
            self.close()
            self._process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self._number += 1
        try:
            self._process.stdin.write(json.dumps({"id": self._number, **request}).encode() + b"\n")
            self._process.stdin.flush()
        except OSError as gone:
            raise ProgramError("the program ended") from gone
        deadline = time.monotonic() + self.timeout
        while True:
            try:
                answer = json.loads(self._line(deadline))
            except ValueError:
                continue  # a line that is no answer
            if isinstance(answer, dict) and answer.get("id") == self._number:
                return answer

    def ask(self, request: dict[str, Any]) -> dict[str, Any]:
        """The answer to one request; ``ProgramError`` if there is none, or an error."""
        for again in (True, False):
            try:
                answer = self._exchange(request)
                break
            except (ProgramError, OSError) as failed:
                self.close()
                if not again:
                    raise ProgramError(str(failed)) from failed
        if answer.get("error"):
            raise ProgramError(str(answer["error"]))
        return answer

    def warm(self, source: str | None, target: str) -> None:
        """Loads what the program needs for a language pair."""
        self.ask({"command": "warmup", "texts": [], "from": source, "to": target})

    def __call__(self, texts: list[str], source: str | None, target: str) -> list[str]:
        """Translations in order; blank texts stay blank and are not asked, what an answer lacks is empty."""
        at = [i for i, t in enumerate(texts) if t and t.strip()]
        out = [""] * len(texts)
        if at:
            answers = self.ask({"command": "translate", "texts": [texts[i] for i in at], "from": source, "to": target}).get("translations")
            for i, t in zip(at, answers if isinstance(answers, list) else [], strict=False):
                out[i] = str(t or "")
        return out

    def close(self) -> None:
        process, self._process, self._rest = self._process, None, b""
        if process is not None:
            process.stdin.close()
            try:
                process.wait(1)
            except subprocess.TimeoutExpired:
                process.kill()
                process.wait()
            process.stdout.close()
