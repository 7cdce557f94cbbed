"""What a Python source imports and defines, and whether it compiles, found in a child process that can be ended.

A source may make the parser hang or end its process. So each task has a child that parses and compiles in memory, writes
no file, and is killed when a step takes longer than the deadline; the next source gets a new one. Standard library only,
so that a child starts at once.
"""

from __future__ import annotations

import ast
import json
import os
import resource
import select
import struct
import subprocess
import sys
import time
import warnings

DEADLINE_S = 3.0
#: Address space of a child.
CHILD_MB = 2048


def defined(source: str) -> tuple[list[str], list[str], list[str], str | None]:
    """Imports, functions and classes in order of the syntax tree, or none of them and the syntax error."""
    imports, functions, classes = [], [], []
    try:
        for node in ast.walk(ast.parse(source)):
            match node:
                case ast.Import():
                    imports += [a.name.partition(".")[0] for a in node.names]
                case ast.ImportFrom(module=str() as module):
                    imports.append(module.partition(".")[0])
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    functions.append(node.name)
                case ast.ClassDef():
                    classes.append(node.name)
    except SyntaxError as e:
        return [], [], [], f"Line {e.lineno}: {e.msg}"
    except (ValueError, RecursionError, MemoryError) as e:
        return [], [], [], str(e)
    return imports, functions, classes, None


def compiled(source: str) -> tuple[str | None, int | None]:
    """Error and line, null if it compiles. This refuses more than the parser, such as return outside of a function."""
    try:
        compile(source, "<source>", "exec")
    except SyntaxError as e:
        return f"SyntaxError: {e.msg} (line {e.lineno})", e.lineno
    except (ValueError, RecursionError, MemoryError) as e:
        return str(e), None
    return None, None


def serve() -> None:
    """The child: a source comes as its length and bytes; a line of JSON goes out for each of the two steps."""
    resource.setrlimit(resource.RLIMIT_AS, (CHILD_MB << 20, CHILD_MB << 20))
    warnings.simplefilter("ignore")
    read, write = sys.stdin.buffer, sys.stdout.buffer
    while len(head := read.read(4)) == 4:
        source = read.read(struct.unpack(">I", head)[0]).decode("utf-8", "surrogatepass")
        for step in (defined, compiled):
            write.write(json.dumps(step(source)).encode() + b"\n")
            write.flush()


class Checker:
    """Checks sources one after the other in a child; use as a context manager."""

    def __init__(self, deadline_s: float = DEADLINE_S, command: list[str] | None = None):
        self.deadline_s = deadline_s
        self.command = command or [sys.executable, "-c", f"from {__name__} import serve; serve()"]
        self.child: subprocess.Popen | None = None
        self.rest = b""  # what the child has sent beyond the last line taken
        self.started = 0

    def __enter__(self) -> Checker:
        return self

    def __exit__(self, *_) -> None:
        self.end()

    def end(self) -> int | None:
        """Kills the child; its exit code if it had ended by itself."""
        if not self.child:
            return None
        code = self.child.poll()
        self.child.kill()
        self.child.wait()
        for pipe in (self.child.stdin, self.child.stdout):
            try:
                pipe.close()
            except OSError:
                pass  # what was not sent to a dead child
        self.child, self.rest = None, b""
        return code

    def _line(self) -> bytes | None:
        """The next line of the child: b"" if it has ended, None if the time is over. Both lines of a source may come at
        once; the second is kept."""
        until = time.monotonic() + self.deadline_s
        while b"\n" not in self.rest:
            if not select.select([self.child.stdout], [], [], max(0.0, until - time.monotonic()))[0]:
                return None
            if not (part := os.read(self.child.stdout.fileno(), 1 << 16)):
                self.child.wait(1)
                return b""
            self.rest += part
        line, _, self.rest = self.rest.partition(b"\n")
        return line

    def check(self, source: str) -> tuple:
        """imports, functions, classes, syntax_error, compile_error, compile_line, timed_out.

        A source that a step of does not end in time has timed_out and no error. One that ends the child has a syntax
        error (if parsing did it) and a compile error that say so.
        """
        if not self.child:
            path = os.pathsep.join(p for p in sys.path if p)
            self.child = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0, env=os.environ | {"PYTHONPATH": path})
            self.started += 1
            warm = max(self.deadline_s, 30.0)  # the interpreter's start is no source's fault
        else:
            warm = self.deadline_s
        raw = source.encode("utf-8", "surrogatepass")
        found, known = [[], [], [], None], [None, None]
        try:
            self.child.stdin.write(struct.pack(">I", len(raw)))
            view = memoryview(raw)
            while view:
                view = view[self.child.stdin.write(view) :]
            deadline, self.deadline_s = self.deadline_s, warm
            try:
                first = self._line()
            finally:
                self.deadline_s = deadline
            second = self._line() if first else first
        except BrokenPipeError:
            first = second = b""
        if first:
            found = json.loads(first)
        if second:
            known = json.loads(second)
            return *found, *known, False
        code = self.end()
        if second is None:
            return *found, None, None, True
        error = f"the parser ended with {code}"
        return *found[:3], found[3] if first else error, error, None, False
