"""SCL-31: calls that end in time: a function runs in a child process, which is killed and begun again when a call takes too long."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable


class Died(RuntimeError):
    """The child ended during a call (out of memory, or a crash below Python)."""


class Child:
    """A process that serves calls of ``f`` one after another, forked when first needed, so that ``f`` needs no pickling.

    ``child(*args, seconds=s)`` returns f(*args); it raises TimeoutError after ``s`` seconds, Died if the process ended, and
    RuntimeError with the text of what ``f`` raised. After the first two the next call has a new process. Only arguments and
    results cross the pipe.
    """

    def __init__(self, f: Callable) -> None:
        self.f, self.process, self.pipe = f, None, None

    def __enter__(self) -> Child:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def _start(self) -> None:
        # Fork: the function is a closure over extractors. The child takes no lock of the parent's threads: it runs only ``f``.
        context = multiprocessing.get_context("fork")
        self.pipe, end = context.Pipe()
        self.process = context.Process(target=_serve, args=(self.f, end, self.pipe), daemon=True)
        self.process.start()
        end.close()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = self.pipe = None

    def __call__(self, *args, seconds: float):
        if self.process is None:
            self._start()
        try:
            self.pipe.send(args)
            if not self.pipe.poll(seconds):
                self.stop()
                raise TimeoutError(f"no result after {seconds} seconds")
            done, got = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError) as e:
            self.process.join()
            code = self.process.exitcode
            self.stop()
            raise Died(f"exit code {code}") from e
        if not done:
            raise RuntimeError(got)
        return got


def _serve(f: Callable, end, other) -> None:
    other.close()  # else the parent's end would stay open here, and its closing go unseen
    while True:
        try:
            args = end.recv()
        except EOFError:
            return
        try:
            answer = True, f(*args)
        except Exception as e:  # noqa: BLE001  the caller gets it
            answer = False, f"{type(e).__name__}: {e}"
        end.send(answer)
