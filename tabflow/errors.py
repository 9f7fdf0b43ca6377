"""Refusals: everything the engine doesn't fully understand is refused with a code and a line."""

from __future__ import annotations


class Refusal(Exception):
    """A script, plan or run that is refused.  ``bucket`` decides the exit status."""

    def __init__(self, code: str, message: str, line: int | None = None, bucket: str = "parse"):
        super().__init__(f"{code}: {message}" + (f" (line {line})" if line else ""))
        self.code, self.message, self.line, self.bucket = code, message, line, bucket


#: The exit status of each outcome.
EXIT = {"ok": 0, "warnings": 10, "parse": 30, "validate": 31, "capability": 32, "runtime": 50}


def runtime(code: str, message: str, line: int | None = None) -> Refusal:
    return Refusal(code, message, line, "runtime")


def invalid(code: str, message: str, line: int | None = None) -> Refusal:
    return Refusal(code, message, line, "validate")
