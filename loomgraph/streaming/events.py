"""Answers of a model that come as pieces of an event stream, put together with state.

A body of `data: ` lines is cut anywhere, within a line or a character too. Rows are answer, pos (the number of the piece,
from 0), ts and body (binary). The state of an answer is the unfinished line, what has been said so far, the last confidence,
and pieces that came before their turn. At `[DONE]` the answer is emitted once, with status done; later pieces of it are
ignored. One that gets no piece for `patience_s` seconds of event time is emitted as broken, with what it has. The result
of a done answer is that of `functions.text.streamed_answer` over its whole body. A repeated piece counts once.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "answer string, content string, confidence double, status string"
STATE = "turn long, line binary, content string, confidence double, done boolean, waiting binary"


def packed(waiting: dict[int, bytes]) -> bytes:
    return b"".join(struct.pack(">qI", pos, len(body)) + body for pos, body in sorted(waiting.items()))


def unpacked(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at < len(raw):
        pos, size = struct.unpack_from(">qI", raw, at)
        out[pos] = raw[at + 12 : at + 12 + size]
        at += 12 + size
    return out


def said(line: bytes) -> tuple[str, float | None, bool]:
    """Content, confidence and whether the answer is done, of one whole line."""
    text = line.decode("utf-8", "replace")
    if not text.startswith("data: "):
        return "", None, False
    payload = text[6:].strip(" ")
    if payload == "[DONE]":
        return "", None, True
    try:
        parsed = json.loads(payload)
    except ValueError:
        return "", None, False
    if not isinstance(parsed, dict):
        return "", None, False
    content, confidence = parsed.get("content"), parsed.get("confidence")
    return content if isinstance(content, str) else "", float(confidence) if isinstance(confidence, int | float) else None, False


def _folded(patience_s: float):
    def folded(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, line, content, confidence, done, waiting = state.get if state.exists else (0, b"", "", None, False, b"")
        result = lambda status: pd.DataFrame([(key[0], content, confidence, status)], columns=["answer", "content", "confidence", "status"])
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield result("broken")
            return
        held, latest = unpacked(bytes(waiting)), 0
        for frame in frames:
            for pos, ts, body in zip(frame["pos"], frame["ts"], frame["body"], strict=True):
                latest = max(latest, int(ts.timestamp() * 1000))
                if pos >= turn and not done:
                    held[int(pos)] = bytes(body)
        finished = done
        line = bytes(line)
        while not finished and turn in held:
            *whole, line = (line + held.pop(turn)).split(b"\n")
            turn += 1
            for one in whole:
                more, sure, finished = said(one)
                if finished:
                    break
                content += more
                confidence = confidence if sure is None else sure
            if not finished and said(line)[2]:
                finished = True  # the last line needs no end
        if finished and not done:
            yield result("done")
            line, content, held = b"", "", {}
        state.update((turn, line, content, confidence, finished, packed(held)))
        state.setTimeoutTimestamp(max(latest + int(patience_s * 1000), state.getCurrentWatermarkMs() + 1))

    return folded


def streamed_answers(pieces: DataFrame, late: str = "1 minute", patience_s: float = 60) -> DataFrame:
    """pieces: a stream of answer, pos, ts and body. A row of RESULT for each answer that is done or broken."""
    grouped = pieces.select("answer", "pos", "ts", "body").withWatermark("ts", late).groupBy("answer")
    return grouped.applyInPandasWithState(_folded(patience_s), RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
