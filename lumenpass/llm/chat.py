"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpass.llm.common import small_batches, written


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles under loss, and the machine: from each state the states that may follow.

    Inside texts a backslash and the first two signs of a control string (``<|``) are escaped by a backslash, so no text
    can hold a mark, and ``unescape`` undoes it exactly.
    """

    begin: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.begin + self.escape_role(role) + self.role_end, False), (self.escape(text), role in self.loss_roles), (self.end, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.begin, at):
                raise ValueError("a turn must begin here")
            mid = formatted.index(self.role_end, at)
            end = formatted.index(self.end, mid)
            turns.append((self.unescape_role(formatted[at + len(self.begin) : mid]), self.unescape(formatted[mid + len(self.role_end) : end])))
            at = end + len(self.end)
        return turns


CHATML = Template()
SEGMENTS = "conv_id long, pos long, role string, ok boolean, text string, loss boolean"


def format_conversations(df: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv_id, pos, role, ok, text, loss), three for each turn.

    Turns are ordered by turn, then role and text where turns tie; null turns come first, null roles and texts are
    empty, rows without a conversation id form one conversation. ``ok`` says whether the machine allows the turn after
    the one before; a turn that breaks the order is formatted all the same. A conversation is streamed through one
    task, a turn at a time with the machine's state alone, so its length is no matter of memory.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    ordered = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, pos = object(), "", 0
        for b in batches:
            out = []
            for c, r, x in zip(*[v.to_pylist() for v in b.columns]):
                if c != at:
                    at, state, pos = c, "", 0
                ok = r in template.follows.get(state, ())
                for text, loss in template.segments(r, x):
                    out.append((c, pos, r, ok, text, loss))
                    pos += 1
                state = r
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["conv_id", "pos", "role", "ok", "text", "loss"])

    return ordered.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), parsed from the segments' text.

    Streams each conversation's segments in order; hashes are carried, nothing is gathered. ``valid``: the machine
    allows every turn and the last state is an assistant's.
    """
    small_batches(segments.sparkSession)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "text", "loss")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = object(), None

        def close():
            return (at, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["ok"] and s["role"] in template.loss_roles)

        for b in batches:
            out = []
            for c, text, loss in zip(*[v.to_pylist() for v in b.columns]):
                if s is None or c != at:
                    if s is not None:
                        out.append(close())
                    at, s = c, {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "ok": True, "role": "", "turn": ""}
                s["chars"] += len(text)
                if loss:
                    plain = template.unescape(text)
                    s["loss_n"] += len(plain)
                    s["loss"].update(plain.encode("utf-8"))
                s["turn"] += text
                if text == template.end and s["turn"] != text:
                    for role, body in template.parse(s["turn"]):
                        s["n"] += 1
                        s["turns"].update(f"{role}\n{body}\n".encode())
                        s["ok"] &= role in template.follows.get(s["role"], ())
                        s["role"] = role
                    s["turn"] = ""
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), kinds)], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def digest_conversations(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """Format, write the segments to the shared folder, and read them back (see ``read_back``)."""
    return read_back(written(format_conversations(df, template), "chat"), template)
