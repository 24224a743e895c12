"""Chat formatting: typed content parts, flattened by a visitor."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that a template or a model may read as control. Fixed values; none holds a backslash.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
CONTROL = (TURN, BODY, END, *PLACEHOLDERS.values(), *FOREIGN)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_SEGMENT = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*){re.escape(END)}", re.S)


def escape(text: str) -> str:
    r"""Doubles each backslash and puts one behind the first character of each control string, so none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class PartVisitor:
    """Flattens a turn's parts in order: escaped text, or a placeholder with its attachment and expanded token count.

    Neighbouring texts are escaped as one, so that no control string arises where two of them meet; they share a span.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out, self.texts, self.attachments, self.length, self.waiting = [], [], [], 0, []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, max(1, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"no such kind of part: {part['type']}")

    def finish(self) -> None:
        """Put the texts that wait for a neighbour."""
        if self.waiting:
            body = escape("".join(self.waiting))
            self.texts.append((self.length, len(body)))
            self._put(body)
            self.waiting = []

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.finish()
        self.attachments.append({"start": self.length, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self._put(PLACEHOLDERS[kind])


#: Type of a column of parts.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict], list[dict], list[dict]]:
    """(segment, text spans, loss spans, attachments); spans count code points from the segment's start."""
    head = TURN + escape(role or "") + BODY
    v = PartVisitor()
    for p in parts:
        v.visit(p)
    v.finish()
    spans = [{"start": len(head) + s, "length": n} for s, n in v.texts]
    held = [a | {"start": a["start"] + len(head)} for a in v.attachments]
    return head + "".join(v.out) + END, spans, spans if role == "assistant" else [], held


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """One row per row: id, turn, segment, loss (spans of the segment), attachments, expanded_tokens.

    A conversation's formatted text is its segments in the order of turn, then role, then segment. With
    parts_col (of type PARTS) a turn is its parts in order, else its text alone. A null text or part list is
    empty, a null role is an empty one, a null turn comes first, a null id is a conversation of its own;
    repeated rows are turns like others; an empty table gives no rows. Other columns are not read. A part of
    unknown type stops the job. Texts are whole, whatever their length. Narrow: no shuffle.
    """
    if parts_col is None:
        text = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
        parts = F.array(text)
    else:
        parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (id_col, turn_col)}
    d = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parts.alias("parts"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_turn(r.as_py(), [p for p in ps.as_py() if p is not None]) for r, ps in zip(b.column("role"), b.column("parts"))]
            cols = list(zip(*rows)) or [(), (), (), ()]
            tokens = pa.array([sum(a["tokens"] for a in x) for x in cols[3]], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("turn"), b.column("role"), pa.array(cols[0], pa.string()), pa.array(cols[2], _SPAN), pa.array(cols[3], _ATTACHED), tokens], ["id", "turn", "role", "segment", "loss", "attachments", "expanded_tokens"])

    out = d.mapInArrow(made, f"id {kinds[id_col]}, turn {kinds[turn_col]}, role string, segment string, loss array<struct<start:long,length:long>>, attachments array<struct<start:long,kind:string,ref:string,tokens:long>>, expanded_tokens long")
    return out.select(F.col("id").alias(id_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "segment", "loss", "attachments", "expanded_tokens")


def read_back(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation, read from the segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments stream through the task in order and feed running digests, so a conversation of any length
    takes constant memory. Placeholders stay in a turn's text as they are. Null turns come first, a null id is a
    conversation of its own, repeated rows are turns like others, ties go by role and segment, an empty table gives
    no rows; other columns are not read. A segment that format_turns() didn't make stops the job.
    """
    kind = formatted.schema[id_col].dataType.simpleString()
    d = formatted.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), "segment", "loss")
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, "id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "segment")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        none, now, seen = object(), None, []
        current = none

        def end() -> None:
            turns, n, loss, chars, total = now
            seen.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush(kinds) -> pa.RecordBatch:
            cols = list(zip(*seen)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
            seen.clear()
            return out

        for b in batches:
            kinds = [b.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, segment, loss in zip(b.column("id").to_pylist(), b.column("segment").to_pylist(), b.column("loss").to_pylist()):
                if current is none or conv != current:
                    if now:
                        end()
                    current, now = conv, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, body = (unescape(x) for x in _SEGMENT.fullmatch(segment).groups())
                now[0].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                now[1] += 1
                for span in loss:
                    text = unescape(segment[span["start"] : span["start"] + span["length"]])
                    now[2].update(text.encode("utf-8", "surrogatepass"))
                    now[3] += len(text)
                now[4] += len(segment)
            yield flush(kinds)
        if now:
            end()
            yield flush(kinds)

    out = d.mapInArrow(read, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)
